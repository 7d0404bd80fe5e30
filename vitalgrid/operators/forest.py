"""Triage model: a weighted random forest with isotonic calibration, on MLlib."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import partial, reduce
from multiprocessing.pool import ThreadPool
from time import perf_counter

import pyarrow as pa
from pyspark import Broadcast, inheritable_thread_target
from pyspark.errors import AnalysisException
from pyspark.ml.classification import DecisionTreeClassificationModel, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitalgrid import domain
from vitalgrid.functions.arrays import literals, nth
from vitalgrid.functions.records import document
from vitalgrid.operators import evaluation, tree_growth
from vitalgrid.operators.curves import Curve, calibrated
from vitalgrid.operators.flat_trees import flatten, lists_of, matrix_of
from vitalgrid.operators.triage import feature_vector, model_answer
from vitalgrid.session import materialize, scratch_path, shared_dir, spread

TREES, DEPTH, SEED, FOLDS, TEST_RATIO = 400, 12, 42, 5, 0.2
# Rows of the published training set, for a caller who wants a trial fit of that size. Unless one
# is asked for, forests are fitted on all labelled rows, as the queries do.
FIT_ROWS = 8000
# Decimal places of the grid that scores are calibrated on, unless told otherwise (those that
# probabilities are reported with). Each class then fits on at most 10 001 weighted points,
# whatever the number of rows. Stored with the model.
SCORE_DIGITS = 4
# Trees that one fit grows; a forest is several fits side by side. Each has one job after the
# other, with as many partitions as its rows need, so only several of them fill the cores.
GROUP_TREES = 100
# Bits of a row's hash that are left out of its range: 65 536 ranges of the other 16.
HASH_RANGE_BITS = 48
# Rows of one partition that trees are grown on. A partition holds statistics of every open node,
# however few rows it has, and all of them are added up: small partitions multiply that.
PARTITION_ROWS = 10_000
# Rows up to which MLlib grows the trees. It takes some 0.7 microseconds for a row, a tree and a level, and keeps
# a number for each row and tree; beyond, tasks grow whole trees (``tree_growth``).
MLLIB_ROWS = 10_000


class Group(RandomForestClassificationModel):
    """Trees that one fit has grown; they are wrapped for Python when somebody asks for them. PySpark wraps
    them, each with many calls of the JVM, whenever it makes a model: it reads a cached property to look for parameters."""

    @property
    def trees(self) -> list[DecisionTreeClassificationModel]:
        return [DecisionTreeClassificationModel(tree) for tree in self._call_java("trees")]

    @property
    def depth(self) -> int:
        return max(tree.depth() for tree in self._call_java("trees"))


class GroupClassifier(RandomForestClassifier):
    def _create_model(self, java_model) -> Group:
        return Group(java_model)


@dataclass(frozen=True)
class Forest:
    """Trees in groups that were grown side by side; all trees count alike. ``stored``: the folder they are in, if any."""

    groups: tuple[Group, ...]
    stored: str | None = None

    @property
    def trees(self) -> int:
        return sum(g.getNumTrees for g in self.groups)

    @property
    def classes(self) -> int:
        return self.groups[0].numClasses

    @property
    def depth(self) -> int:
        return max(g.depth for g in self.groups)

    def importances(self) -> list[float]:
        """Mean over the groups, weighted by their trees; adds up to 1 unless no tree splits."""
        weighted = [[float(v) * g.getNumTrees for v in g.featureImportances.toArray()] for g in self.groups]
        sums = [sum(column) for column in zip(*weighted)]
        return [v / sum(sums) if sum(sums) else 0.0 for v in sums]

    def sent(self, spark: SparkSession) -> Broadcast:
        """The trees as flat arrays, broadcast once: MLlib would send its models to every task anew."""
        if "_sent" not in self.__dict__:
            at = self if self.stored else self.save(scratch_path(spark, "forest"))
            paths = [f"{at.stored}/group_{n}" for n in range(len(self.groups))]
            trees = flatten(spark, paths, self.groups[0].numFeatures, self.classes)
            self.__dict__["_sent"] = spark.sparkContext.broadcast(trees)  # beside the fields, which are frozen
        return self.__dict__["_sent"]

    def votes(self, spark: SparkSession, features: Column) -> Column:
        """Probabilities by class of an array column, the mean of the class shares in the leaves of all trees."""
        sent = self.sent(spark)

        @F.arrow_udf(T.ArrayType(T.DoubleType()))
        def shares_of(features: pa.Array) -> pa.Array:
            return lists_of(sent.value.shares(matrix_of(features)))

        return shares_of(features)

    def shares(self, rows: DataFrame, vector: str, out: str) -> DataFrame:
        """``out``: the ``votes`` on the column ``vector``, a vector or an array."""
        return rows.withColumn(out, self.votes(rows.sparkSession, _as_array(rows, vector)))

    def save(self, path: str) -> Forest:
        """This forest, stored in ``path``; where it has been put there before, it stays."""
        if self.stored == path:
            return self
        for number, group in enumerate(self.groups):
            group.write().overwrite().save(f"{path}/group_{number}")
        return replace(self, stored=path)


def _as_array(rows: DataFrame, features: str) -> Column:
    return F.col(features) if dict(rows.dtypes)[features].startswith("array") else vector_to_array(features)


def load_forest(path: str, groups: int) -> Forest:
    return Forest(tuple(_load_group(f"{path}/group_{n}") for n in range(groups)), path)


def _load_group(path: str) -> Group:
    group = Group(RandomForestClassificationModel.read()._jread.load(path))
    group._transfer_params_from_java()
    return group


@dataclass(frozen=True)
class CalibratedForest:
    """``base`` for importances; per fold a forest and one calibrator per label."""

    base: Forest
    folds: tuple[tuple[Forest, tuple[IsotonicRegressionModel, ...]], ...]
    labels: tuple[str, ...] = domain.RISK_LABELS
    score_digits: int = SCORE_DIGITS

    def curves(self) -> list[list[Curve]]:
        """The calibrators' curves by fold and label: at most 10 001 corners each with four decimal places."""
        return [[Curve(c.boundaries.toArray(), c.predictions.toArray()) for c in calibrators] for _, calibrators in self.folds]

    def probabilities(self, spark: SparkSession, features: Column) -> Column:
        """Probabilities by label of an array column. Calibrated where the shares are, in the task's batches:
        five arrays and twenty functions a row cost the JVM as much as the trees do."""
        sent, digits = [forest.sent(spark) for forest, _ in self.folds], self.score_digits
        if "_curves" not in self.__dict__:
            self.__dict__["_curves"] = spark.sparkContext.broadcast(self.curves())  # beside the fields, which are frozen
        curves = self.__dict__["_curves"]

        @F.arrow_udf(T.ArrayType(T.DoubleType()))
        def probabilities_of(features: pa.Array) -> pa.Array:
            matrix = matrix_of(features)
            return lists_of(calibrated([trees.value.shares(matrix) for trees in sent], curves.value, digits))

        return probabilities_of(features)


def feature_table(labelled: DataFrame, label: str) -> DataFrame:
    """triage_id, features and label of the requests, computed once and stored.

    Training passes over its input many times. A filter or join on a stored label also
    stays one: on a computed label it would repeat the whole derivation of the label.
    """
    columns = feature_vector(spread(labelled, "triage_id")).select("triage_id", "features", label)
    return materialize(columns, "features")


def _class_index(label: str, labels: Sequence[str]) -> Column:
    return (F.array_position(literals(labels), F.col(label)) - 1).cast("double")


def calibration_rows(table: DataFrame, label: str, labels: Sequence[str] = domain.RISK_LABELS) -> DataFrame:
    """``features`` array and numeric ``label`` of a feature table: calibration takes no weights, and scoring no vectors."""
    return table.filter(F.col(label).isin(*labels)).select("triage_id", "features", _class_index(label, labels).alias("label"))


def training_rows(table: DataFrame, label: str, labels: Sequence[str] = domain.RISK_LABELS) -> DataFrame:
    """``features`` vector, numeric ``label`` and balanced ``weight`` of a feature table."""
    attribute = {"ml_attr": {"type": "nominal", "name": "label", "vals": list(labels)}}
    weights = materialize(evaluation.class_weights(table, label, labels), "class-weights")
    index = _class_index(label, labels)
    rows = table.withColumn("_vector", array_to_vector("features"))
    return (
        rows.filter(F.col(label).isin(*labels))
        .join(weights.select(F.col("label").alias("_class"), "weight"), F.col(label) == F.col("_class"))
        .select("triage_id", F.col("_vector").alias("features"), index.alias("label", metadata=attribute), "weight")
    )


def _side_by_side(spark: SparkSession, jobs: Sequence) -> list:
    """Results of functions without arguments. Each waits for many short jobs; others fill the gaps."""
    if not jobs:
        return []
    with ThreadPool(min(len(jobs), spark.sparkContext.defaultParallelism)) as threads:
        return threads.map(inheritable_thread_target(spark)(lambda job: job()), jobs, chunksize=1)


def _classifier(trees: int, depth: int, seed: int) -> GroupClassifier:
    return GroupClassifier(
        featuresCol="features",
        labelCol="label",
        weightCol="weight",
        numTrees=trees,
        maxDepth=depth,
        featureSubsetStrategy="sqrt",
        seed=seed,
        cacheNodeIds=True,
        checkpointInterval=5,
    )


def _fits(rows: DataFrame, *, trees: int, depth: int, seed: int, group_trees: int = GROUP_TREES, partition_rows: int = PARTITION_ROWS, path: str | None = None) -> list:
    """Functions that each grow one group of a forest's trees, and store it below ``path`` if there is one:
    what the driver does for one group is done while the tasks of others run.

    The node that a row has reached in every tree is kept with the row, and checkpointed in
    the shared folder; without that, each level would send all trees to the tasks.
    """
    context = rows.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(rows.sparkSession))
    dealt = rows.coalesce(max(1, -(-rows.count() // partition_rows)))

    def fit(number: int) -> Group:
        grown = _classifier(min(group_trees, trees - number * group_trees), depth, seed + number).fit(dealt)
        if path is not None:
            grown.write().overwrite().save(f"{path}/group_{number}")
        return grown

    return [partial(fit, number) for number in range(-(-trees // group_trees))]


def train_forest(rows: DataFrame, *, trees: int = TREES, depth: int = DEPTH, seed: int = SEED, group_trees: int = GROUP_TREES, path: str | None = None) -> Forest:
    """The forest of ``rows`` (features, label, weight), its groups of trees grown side by side; stored in ``path`` if given."""
    return _grown(rows, [(None, path)], trees=trees, depth=depth, seed=seed, group_trees=group_trees)[0]


def _grown(rows: DataFrame, wanted: Sequence[tuple[int | None, str | None]], *, trees: int, depth: int, seed: int, folds: int = FOLDS, group_trees: int = GROUP_TREES) -> list[Forest]:
    """For each of ``wanted`` the forest of the rows outside a fold, or of all rows for None, stored in the path beside it if there is one.

    Few rows are left to MLlib. With many, a forest is always stored, as MLlib would store it, and read back from there.
    """
    spark = rows.sparkSession
    if rows.count() <= MLLIB_ROWS:
        part = lambda fold: rows if fold is None else rows.filter(_fold(folds, seed) != fold)
        return _forests(spark, [(_fits(part(fold), trees=trees, depth=depth, seed=seed, group_trees=group_trees, path=path), path) for fold, path in wanted])
    left_out, paths = zip(*[(fold, path or scratch_path(spark, "forest")) for fold, path in wanted])
    fold = F.lit(0) if set(left_out) == {None} else _fold(folds, seed)
    width, known = len(rows.select("features").first()[0]), rows.schema["label"].metadata.get("ml_attr", {}).get("vals")
    classes = len(known) if known else int(rows.agg(F.max("label")).first()[0]) + 1
    grown = tree_growth.grown(rows, left_out, fold=fold, width=width, classes=classes, trees=trees, depth=depth, seed=seed)

    def group(forest: int, number: int) -> Group:
        numbers, path = range(number * group_trees, min(trees, (number + 1) * group_trees)), f"{paths[forest]}/group_{number}"
        estimator = _classifier(len(numbers), depth, seed + number)
        tree_growth.store_group(grown.filter(F.col("forest") == forest), path, estimator, numbers, width, classes)
        return _load_group(path)

    count = -(-trees // group_trees)
    groups = _side_by_side(spark, [partial(group, forest, number) for forest in range(len(paths)) for number in range(count)])
    return [Forest(tuple(groups[n * count : (n + 1) * count]), path) for n, path in enumerate(paths)]


def _forests(spark: SparkSession, planned: Sequence[tuple[list, str | None]]) -> list[Forest]:
    """The forests of several ``_fits`` and their paths, all groups of all of them side by side."""
    grown = iter(_side_by_side(spark, [fit for fits, _ in planned for fit in fits]))
    return [Forest(tuple(next(grown) for _ in fits), path) for fits, path in planned]


def _fold(folds: int, seed: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), F.col("triage_id")), F.lit(folds))


def _fold_paths(folds: int, path: str | None) -> list[tuple[int, str | None]]:
    return [(n, None if path is None else f"{path}/fold_{n}") for n in range(folds)]


def train_folds(rows: DataFrame, *, folds: int = FOLDS, seed: int = SEED, trees: int = TREES, depth: int = DEPTH, path: str | None = None) -> list[Forest]:
    """For each fold the forest of the other folds' rows; the groups of all forests side by side."""
    return _grown(rows, _fold_paths(folds, path), folds=folds, seed=seed, trees=trees, depth=depth)


def calibrate(forests: Sequence[Forest], held: DataFrame, *, seed: int = SEED, score_digits: int = SCORE_DIGITS):
    """Each forest with the isotonic calibrators of its fold, the one it was not grown on.

    ``held``: all rows to calibrate on. The held-out scores, rounded to ``score_digits``
    places, shrink to counts per class and score before they are fitted.
    """
    spark, folds = held.sparkSession, len(forests)

    def fit(number: int):
        scored = forests[number].shares(held.filter(_fold(folds, seed) == number), "features", "_scores")
        points = scored.select("label", F.posexplode_outer("_scores").alias("class", "score")).groupBy(
            "class", F.round("score", score_digits).alias("features")
        ).agg(F.count(F.lit(1)).cast("double").alias("weight"), F.count_if(F.col("label") == F.col("class")).alias("hits"))
        points = materialize(points.withColumn("label", F.col("hits") / F.col("weight")), "calibration-points")
        return forests[number], tuple(_calibrator(points, index) for index in range(forests[number].classes))

    return tuple(_side_by_side(spark, [partial(fit, number) for number in range(folds)]))


def _calibrator(points: DataFrame, index: int) -> IsotonicRegressionModel:
    own = points.filter(F.col("class") == index)
    return IsotonicRegression(featuresCol="features", labelCol="label", weightCol="weight").fit(own)


def isotonic_curve(points: DataFrame) -> DataFrame:
    """``points`` (features, label, weight) with ``fitted``: the weighted isotonic regression at each."""
    model = IsotonicRegression(featuresCol="features", labelCol="label", weightCol="weight", predictionCol="fitted").fit(points)
    return model.transform(points)


def curves_rise(model: CalibratedForest) -> bool:
    """Whether every stored calibration curve never falls and stays between 0 and 1."""
    curves = [list(c.predictions) for _, calibrators in model.folds for c in calibrators]
    return all(0 <= a <= b <= 1 for curve in curves for a, b in zip(curve, curve[1:]))


def train_calibrated(rows: DataFrame, held: DataFrame | None = None, *, base: Forest | None = None, path: str | None = None, trees: int = TREES, depth: int = DEPTH, seed: int = SEED, folds: int = FOLDS, score_digits: int = SCORE_DIGITS) -> CalibratedForest:
    """``held``: all rows to calibrate on, ``rows`` itself unless given; a fold holds the same
    ids in both, so that no forest judges a row it was grown on. ``base``: the forest of all
    ``rows``, if there is one already; else it grows beside those of the folds. ``path``: where the
    forests are stored."""
    wanted = _fold_paths(folds, path)
    if base is None:
        wanted.insert(0, (None, None if path is None else f"{path}/base"))
    forests = _grown(rows, wanted, folds=folds, trees=trees, depth=depth, seed=seed)
    if base is None:
        base, *forests = forests
    return CalibratedForest(base, calibrate(forests, rows if held is None else held, seed=seed, score_digits=score_digits), score_digits=score_digits)


def score(model: CalibratedForest, rows: DataFrame) -> DataFrame:
    """``probabilities`` array: calibrated per label, normalised, averaged over the folds.

    A fold that calibrates every label to zero gives equal probabilities. One pass
    without a shuffle; ``features`` may be an array or a vector. Store the result before
    filtering on it: a filter is pushed below the scoring and would repeat it.
    """
    return rows.select(*rows.columns, model.probabilities(rows.sparkSession, _as_array(rows, "features")).alias("probabilities"))


def assess(model: CalibratedForest, requests: DataFrame) -> DataFrame:
    """The forest's answer to every request, complete with contributors, alerts and note."""
    scored = score(model, feature_vector(requests))
    return model_answer(scored, model.base.importances())


def feature_importances(base: Forest, spark: SparkSession) -> DataFrame:
    """Importance of every feature in the uncalibrated forest, with its rank."""
    values = base.importances()
    order = sorted(range(len(values)), key=lambda i: (-values[i], -i))
    rows = [(rank + 1, domain.FEATURES[i], values[i]) for rank, i in enumerate(order)]
    return spark.createDataFrame(rows, "rank int, feature string, importance double")


def with_prediction(scored: DataFrame, labels: Sequence[str] = domain.RISK_LABELS) -> DataFrame:
    position = F.array_position("probabilities", F.array_max("probabilities")).cast("int")
    return scored.withColumn("predicted", nth(literals(labels), position))


def training_metrics(scored: DataFrame, model: CalibratedForest, *, actual: str, training_rows: int, fitted_rows: int | None = None, seconds: float = 0.0) -> DataFrame:
    """One metrics document of a scored test set: sizes, accuracy, report, matrix, importances."""
    judged = with_prediction(scored, model.labels)
    matrix = materialize(evaluation.confusion_matrix(judged, actual, "predicted", model.labels), "test-matrix")
    report = evaluation.report_from_matrix(matrix).agg(
        F.map_from_entries(
            F.collect_list(F.struct("label", F.struct("precision", "recall", "f1_score", "support")))
        ).alias("m")
    )
    cells = matrix.agg(
        F.map_from_entries(F.collect_list(F.struct(F.concat_ws(">", "actual", "predicted"), "rows"))).alias("m")
    )
    hits = matrix.agg(F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("rows")).otherwise(0)).alias("h"))
    importances = model.base.importances()
    body = matrix.agg(F.sum("rows").alias("test_samples")).select(
        F.lit(domain.FOREST_MODEL_NAME).alias("model"),
        F.lit(domain.FOREST_MODEL_VERSION).alias("version"),
        F.lit(training_rows).cast("long").alias("training_samples"),
        F.lit(training_rows if fitted_rows is None else fitted_rows).cast("long").alias("fitted_samples"),
        "test_samples",
        F.lit(float(seconds)).alias("duration_seconds"),
        F.try_divide(hits.scalar(), F.col("test_samples")).alias("accuracy"),
        report.scalar().alias("classification_report"),
        cells.scalar().alias("confusion_matrix"),
        literals(model.labels).alias("labels_order"),
        F.create_map(*[c for f, v in zip(domain.FEATURES, importances) for c in (F.lit(f), F.lit(v))]).alias("feature_importances"),
        F.lit(domain.SYNTHETIC_BASIS).alias("synthetic_basis"),
        F.lit(domain.CLINICAL_READING_HINT).alias("clinical_reading_hint"),
    )
    return body.withColumn("document", document(F.struct(*body.columns)))


def split_rows(table: DataFrame, label: str, seed: int = SEED) -> DataFrame:
    """The table with ``subset``: a fifth of each label is 'val'.

    Drawn with the next seed: labels may have been moved by a draw with this one, and
    the same draw would put all of those on one side.
    """
    return evaluation.stratified_split(table, label, "triage_id", TEST_RATIO, seed + 1)


def class_quotas(counts: dict[str, int], rows: int) -> dict[str, int]:
    """Rows to take of each class: equal shares; what a small class leaves goes to the larger ones."""
    quotas, left = {}, rows
    for place, label in enumerate(sorted(counts, key=lambda c: (counts[c], str(c)))):
        quotas[label] = min(counts[label], left // (len(counts) - place))
        left -= quotas[label]
    return quotas


def bounded_rows(table: DataFrame, rows: int | None, label: str, seed: int = SEED) -> DataFrame:
    """At most ``rows`` rows of a labelled table to fit a forest on, drawn per class by the hash of their ids; all if None.

    Rows are counted per class and range of the hash. Only those up to the range that a class's
    quota ends in are read with their features, once for all classes, and put in order.
    """
    if rows is None:
        return table
    place = F.xxhash64(F.lit(seed), F.col("triage_id"))
    ranges = table.groupBy(F.col(label).alias("_class"), F.shiftright(place, HASH_RANGE_BITS).alias("_range")).agg(F.count(F.lit(1)).alias("n"))
    ranges = materialize(ranges, "hash-ranges")
    counts = {r["_class"]: r["n"] for r in ranges.groupBy("_class").agg(F.sum("n").alias("n")).collect()}
    if sum(counts.values()) <= rows:
        return table
    quotas = {c: n for c, n in class_quotas(counts, rows).items() if n}
    upto = F.sum("n").over(Window.partitionBy("_class").orderBy("_range").rowsBetween(Window.unboundedPreceding, 0))
    ends = ranges.withColumn("_upto", upto).filter(F.col("_upto") >= _by_class("_class", quotas)).groupBy("_class").agg(F.min("_range").alias("end"))
    last = {r["_class"]: r["end"] for r in ends.collect()}
    near = materialize(table.filter(F.shiftright(place, HASH_RANGE_BITS) <= _by_class(label, last)), "rows-to-draw")
    drawn = [near.filter(F.col(label).eqNullSafe(F.lit(c))).orderBy(place, "triage_id").limit(n) for c, n in quotas.items()]
    return reduce(DataFrame.unionByName, drawn)


def _by_class(column: str, numbers: dict) -> Column:
    """The number of the class in ``column``, NULL for other classes."""
    return F.coalesce(*[F.when(F.col(column).eqNullSafe(F.lit(c)), F.lit(n).cast("long")) for c, n in numbers.items()])


def prepare(table: DataFrame, label: str, seed: int = SEED, fit_rows: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of a feature table: the training part, the rows to fit on (all of it, or at most ``fit_rows``; stored), the test part.

    The parts of a large table are not stored: a hash and a comparison in place cost less than another
    copy. Where all rows may be fitted on, the parts are, and trees grow on them as they were stored.
    """
    parts = split_rows(table, label, seed)
    if fit_rows is None or table.count() <= 2 * fit_rows:
        parts = materialize(parts, "parts")
    part = parts.filter("subset = 'train'")
    rows = materialize(training_rows(bounded_rows(part, fit_rows, label, seed), label), "training-rows")
    return part, rows, parts.filter("subset = 'val'")


def train_and_report(
    table: DataFrame,
    label: str,
    path: str,
    *,
    trees: int = TREES,
    depth: int = DEPTH,
    seed: int = SEED,
    folds: int = FOLDS,
    fit_rows: int | None = None,
    score_digits: int = SCORE_DIGITS,
    prepared: tuple[DataFrame, DataFrame, DataFrame] | None = None,
    base: Forest | None = None,
):
    """Split a feature table, train, save and evaluate: the model and its metrics document.

    The forests are fitted on the training part (on at most ``fit_rows`` rows of it, if given) and
    calibrated on all of it; the model is judged on the whole rest. ``prepared`` and ``base`` may be given
    where the split has been made or the uncalibrated forest grown before; a forest that is not
    given grows beside those of the folds.
    """
    started = perf_counter()
    part, rows, test = prepared or prepare(table, label, seed, fit_rows)
    model = train_calibrated(rows, calibration_rows(part, label), base=base, path=path, trees=trees, depth=depth, seed=seed, folds=folds, score_digits=score_digits)
    save(model, table.sparkSession, path)
    scored = score(model, test)
    metrics = training_metrics(scored, model, actual=label, training_rows=part.count(), fitted_rows=rows.count(), seconds=round(perf_counter() - started, 2))
    return model, metrics


def save(model: CalibratedForest, spark: SparkSession, path: str) -> None:
    jobs = [partial(model.base.save, f"{path}/base")]
    for number, (forest, calibrators) in enumerate(model.folds):
        jobs.append(partial(forest.save, f"{path}/fold_{number}"))
        jobs += [partial(c.write().overwrite().save, f"{path}/fold_{number}/calibrator_{i}") for i, c in enumerate(calibrators)]
    _side_by_side(spark, jobs)
    pairs = [c for risk, priority in domain.PRIORITY_BY_RISK.items() for c in (F.lit(risk), F.lit(priority))]
    spark.range(1).select(
        F.lit(domain.FOREST_MODEL_NAME).alias("model_name"),
        F.lit(domain.FOREST_MODEL_VERSION).alias("model_version"),
        F.lit(domain.FOREST_MODEL_FAMILY).alias("model_family"),
        literals(model.labels).alias("risk_labels"),
        F.create_map(*pairs).alias("priority_by_risk"),
        literals(domain.FEATURES).alias("feature_order"),
        literals(model.base.importances()).alias("feature_importances"),
        F.lit(len(model.folds)).alias("folds"),
        F.lit(len(model.base.groups)).alias("groups"),
        F.lit(model.score_digits).alias("score_digits"),
    ).write.mode("overwrite").parquet(f"{path}/metadata")


def load(spark: SparkSession, path: str) -> CalibratedForest:
    about = spark.read.parquet(f"{path}/metadata").first()
    labels = tuple(about.risk_labels)
    calibrators = lambda n: tuple(IsotonicRegressionModel.load(f"{path}/fold_{n}/calibrator_{i}") for i in range(len(labels)))
    fold = lambda n: (load_forest(f"{path}/fold_{n}", about.groups), calibrators(n))
    base, *folds = _side_by_side(spark, [partial(load_forest, f"{path}/base", about.groups), *[partial(fold, n) for n in range(about.folds)]])
    return CalibratedForest(base, tuple(folds), labels, about.score_digits)


def model_metadata(spark: SparkSession, path: str) -> DataFrame:
    """One row about the stored model, or ``loaded = false`` with the reason."""
    try:
        about = spark.read.parquet(f"{path}/metadata")
    except AnalysisException:
        return spark.range(1).select(
            F.lit(False).alias("loaded"), F.lit(f"artefacto no encontrado en {path}").alias("reason")
        )
    return about.select(F.lit(True).alias("loaded"), "*", F.lit(path).alias("path"))
