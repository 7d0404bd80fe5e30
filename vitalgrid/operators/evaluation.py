"""Model evaluation: splits, class weights, epoch metrics, confusion, reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitalgrid.functions.arrays import literals
from vitalgrid.session import materialize

# Hex digits of the draw that one look resolves (3 digits: 4096 buckets, few enough that a task's rows shrink
# to counts before they are shuffled), and those it has.
BUCKET_DIGITS, DRAW_DIGITS = 3, 32
# Distinct ids of a border bucket that are ordered; above it the bucket is divided again.
ORDERED_IDS = 10_000


def stratified_split(df: DataFrame, label: str, id_col: str, ratio: float, seed: int) -> DataFrame:
    """``subset``: per label the first ``round(n * ratio)`` ids in hash order are 'val'.

    The order is that of md5(seed|id), halves of the cut round to even. Copies of one id
    stay together. Equal to a rank per label, but no label's rows are brought together:
    rows are counted per label and hash bucket, the bucket the cut falls into is divided
    again until it holds few ids, those are ordered, and the resulting last 'val' id of each
    label is compared with every row in place. What is ordered is bounded at any size.
    """
    draw = F.md5(F.concat(F.lit(f"{seed}|"), F.col(id_col).cast("string")))
    inside = df.select(F.col(label).alias("_label"), draw.alias("draw"), F.col(id_col).cast("string").alias("id"), F.lit(1).cast("long").alias("n"))
    state = None
    for level in range(-(-DRAW_DIGITS // BUCKET_DIGITS)):
        bucketed = inside.withColumn("_bucket", F.substring("draw", 1 + level * BUCKET_DIGITS, BUCKET_DIGITS))
        counts = bucketed.groupBy("_label", "_bucket").agg(F.sum("n").alias("n"))
        # at most labels x 4096 rows in the windows
        by_label = Window.partitionBy("_label")
        upto = by_label.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
        running = counts.withColumns({"upto": F.sum("n").over(upto), "total": F.sum("n").over(by_label)})
        if state is None:
            cut, earlier = F.rint(F.col("total") * F.lit(ratio)).cast("long"), F.lit(0).cast("long")
        else:
            running = running.join(state.select(F.col("_label").alias("_of"), "cut", "earlier"), F.col("_label").eqNullSafe(F.col("_of")))
            cut, earlier = F.col("cut"), F.col("earlier")
        placed = running.select("_label", "_bucket", cut.alias("cut"), (earlier + F.col("upto") - F.col("n")).alias("earlier"), (earlier + F.col("upto")).alias("reached"))
        # Stored, one row per label: Spark knows their size and does not shuffle rows by label
        # to join them, unless there are too many labels to broadcast.
        state = materialize(placed.filter("reached >= cut AND earlier < cut").drop("reached"), "split-buckets")
        border = state.select(F.col("_label").alias("_of"), F.col("_bucket").alias("_in"))
        # copies of an id are brought together here, where few rows are left, not in the whole table
        within = bucketed.join(border, F.col("_label").eqNullSafe(F.col("_of")) & (F.col("_bucket") == F.col("_in")), "left_semi")
        inside = materialize(within.groupBy("_label", "draw", "id").agg(F.sum("n").alias("n")), "split-inside")
        most = inside.groupBy("_label").count().agg(F.max("count")).first()[0]
        if most is None or most <= ORDERED_IDS:
            break

    ordered = inside.join(state.select(F.col("_label").alias("_of"), "cut", "earlier"), F.col("_label").eqNullSafe(F.col("_of")))
    ordered = ordered.withColumn("_place", F.struct("draw", "id"))
    ahead = Window.partitionBy("_label").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("earlier") + F.coalesce(F.sum("n").over(ahead), F.lit(0))
    last = ordered.withColumn("before", before).filter("before < cut").groupBy("_label").agg(F.max("_place").alias("_last"))
    last = materialize(last, "split-borders")

    # <=> so that rows without a label are split like any other class
    joined = df.join(last, F.col(label).eqNullSafe(F.col("_label")), "left")
    place = F.struct(draw.alias("draw"), F.col(id_col).cast("string").alias("id"))
    chosen = F.coalesce(place <= F.col("_last"), F.lit(False))
    return joined.select(*df.columns, F.when(chosen, "val").otherwise("train").alias("subset"))


def class_weights(df: DataFrame, label: str, labels: Sequence[str] | None = None) -> DataFrame:
    """``total / (k * n)`` per class. Listed classes without rows count as one row."""
    counts = df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("rows"))
    if labels:
        grid = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(l) for l in labels])).alias("label"))
        counts = grid.join(counts, "label", "left").select("label", F.coalesce("rows", F.lit(0)).alias("rows"))
    # one row per class: the window is as small as the number of classes
    all_classes = Window.partitionBy(F.lit(1))
    total, k = F.sum("rows").over(all_classes), F.count(F.lit(1)).over(all_classes)
    weight = total / (k * F.greatest("rows", F.lit(1)))
    return counts.select("label", F.col("rows").cast("long").alias("rows"), weight.alias("weight"))


def weighted_epoch_metrics(batches: DataFrame) -> DataFrame:
    """Loss and accuracy per epoch, weighted by batch size.

    ``batches`` has epoch, n, correct and loss_sum (the batch loss times n).
    """
    size = F.greatest(F.sum("n"), F.lit(1))
    return batches.groupBy("epoch").agg(
        F.sum("n").alias("rows"),
        (F.sum("loss_sum") / size).alias("loss"),
        (F.sum("correct") / size).alias("accuracy"),
    )


def best_epoch(history: DataFrame) -> DataFrame:
    """``improved`` (beats every earlier epoch) and ``is_best`` (first of the greatest).

    ``history`` is one row per epoch, so the ordered window over it stays small.
    """
    earlier = Window.partitionBy(F.lit(1)).orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1)
    before = F.max("accuracy").over(earlier)
    marked = history.withColumns(
        {"best_before": before, "improved": before.isNull() | (F.col("accuracy") > before)}
    )
    winner = F.max_by("epoch", F.struct("accuracy", -F.col("epoch"))).over(Window.partitionBy(F.lit(1)))
    return marked.withColumn("is_best", F.col("epoch") == winner)


def confusion_matrix(df: DataFrame, actual: str, predicted: str, labels: Sequence[str]) -> DataFrame:
    """One row per pair of labels, zeros included; rows with other labels do not count.

    Rows are counted by label position (0 for any other label), at most (k + 2)^2 groups,
    and the cells look their count up. Filtering or joining on labels that are themselves
    computed would make the optimizer push, and so repeat, that computation.
    """
    names, base = literals(labels), len(labels) + 1
    places = df.select(
        F.array_position(names, F.col(actual)).alias("a"), F.array_position(names, F.col(predicted)).alias("p")
    )
    counts = places.groupBy("a", "p").agg(F.count(F.lit(1)).alias("n"))
    cells = counts.select((F.col("a") * base + F.col("p")).alias("cell"), "n").agg(
        F.map_from_entries(F.collect_list(F.when(F.col("cell").isNotNull(), F.struct("cell", "n")))).alias("cells")
    )
    grid = df.sparkSession.range(1).select(cells.scalar().alias("cells"), F.posexplode(names).alias("i", "actual"))
    grid = grid.select("cells", "i", "actual", F.posexplode(names).alias("j", "predicted"))
    cell = ((F.col("i") + 1) * base + F.col("j") + 1).cast("long")
    rows = F.coalesce(F.try_element_at("cells", cell), F.lit(0)).cast("long")
    return grid.select("actual", "predicted", rows.alias("rows"))


def confusion_table(df: DataFrame, actual: str, predicted: str, labels: Sequence[str]) -> DataFrame:
    """The matrix with one column per predicted label."""
    cells = confusion_matrix(df, actual, predicted, labels)
    return cells.groupBy("actual").pivot("predicted", list(labels)).agg(F.sum("rows"))


def report_from_matrix(matrix: DataFrame) -> DataFrame:
    """Precision, recall, f1 and support per label, accuracy, macro and weighted averages.

    Ratios without a denominator are 0. The accuracy row carries its value in all three.
    """

    def ratio(part: Column, whole: Column) -> Column:
        return F.coalesce(F.try_divide(part, whole), F.lit(0.0))

    ends = matrix.select(
        F.explode(
            F.array(
                F.struct(F.col("actual").alias("label"), F.col("rows").alias("actual_rows"), F.lit(0).cast("long").alias("predicted_rows"),
                         F.when(F.col("actual") == F.col("predicted"), F.col("rows")).otherwise(0).alias("hits")),
                F.struct(F.col("predicted").alias("label"), F.lit(0).cast("long").alias("actual_rows"), F.col("rows").alias("predicted_rows"),
                         F.lit(0).cast("long").alias("hits")),
            )
        ).alias("e")
    ).select("e.*")
    sums = ends.groupBy("label").agg(
        F.sum("actual_rows").alias("support"), F.sum("predicted_rows").alias("chosen"), F.sum("hits").alias("hits")
    )
    per_label = sums.withColumns(
        {"precision": ratio(F.col("hits"), F.col("chosen")), "recall": ratio(F.col("hits"), F.col("support"))}
    ).withColumn(
        "f1_score",
        ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")),
    )
    measures = ("precision", "recall", "f1_score")
    support = F.sum("support").alias("support")
    accuracy = ratio(F.sum("hits"), F.sum("support"))
    row = F.struct
    summary = per_label.agg(
        F.array(
            row(F.lit("accuracy").alias("label"), *[accuracy.alias(m) for m in measures], support),
            row(F.lit("macro avg").alias("label"), *[F.avg(m).alias(m) for m in measures], support),
            row(
                F.lit("weighted avg").alias("label"),
                *[ratio(F.sum(F.col(m) * F.col("support")), F.sum("support")).alias(m) for m in measures],
                support,
            ),
        ).alias("rows")
    ).select(F.inline("rows"))
    return per_label.select("label", *measures, "support").unionByName(summary)


def classification_report(df: DataFrame, actual: str, predicted: str, labels: Sequence[str]) -> DataFrame:
    return report_from_matrix(confusion_matrix(df, actual, predicted, labels))


def accuracy(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    hits = F.count_if(F.col(actual) == F.col(predicted))
    return df.agg(F.try_divide(hits, F.count(F.lit(1))).alias("accuracy"))
