"""Mixing sources to target weights with hash-threshold histograms.

Every document has a fixed 60-bit hash. A source that is to give a part of its words
takes its documents below a threshold, so a smaller budget always takes a subset of a
larger one. The thresholds come from histograms of words by source and hash bucket; only
the bucket in which the budget ends is looked at more closely. Nothing is sorted, and no
source is brought together in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitalgrid.llm.common import SPACED_WORD
from vitalgrid.session import materialize

#: Hex digits of the hash, and how many of them one histogram resolves (4096 buckets a source).
HASH_DIGITS, LEVEL_DIGITS = 15, 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(SPACED_WORD)), F.lit(0)).cast("long")


def document_hash(doc_id: Column, text: Column) -> Column:
    """60 bits as 15 hex digits, from the id and the text. Rows equal in both share their fate."""
    return F.substring(F.md5(F.concat_ws(":", doc_id.cast("string"), text).cast("binary")), 1, HASH_DIGITS)


def targets(sizes: DataFrame, weights: DataFrame, share: float = 1.0, max_repeats: float = 3.0) -> DataFrame:
    """Words to take from each source: (source, source_size, target).

    ``sizes``: (source, source_size); ``weights``: (source, weight). The budget is
    ``share`` of all sizes, divided by weight. No target exceeds ``max_repeats`` times its
    source; what is cut off goes to the others by weight, until none is above. That is the
    level at which ``sum(least(limit, level * weight))`` is the budget, and it can be read
    off the sources in the order of limit by weight. One row per source, so the window
    below holds as many rows as there are sources to weigh.

    Sources without a weight, or with one of 0, get nothing. An empty table has no targets.
    """
    sized = (
        sizes.join(weights, sizes["source"].eqNullSafe(weights["source"]), "left")
        .select(sizes["source"], sizes["source_size"], F.coalesce(weights["weight"].cast("double"), F.lit(0.0)).alias("weight"))
        .withColumn("limit", F.lit(float(max_repeats)) * F.col("source_size"))
    )
    fill = F.when(F.col("weight") > 0, F.col("limit") / F.col("weight"))
    everything = Window.partitionBy()
    before = Window.orderBy(F.col("fill").asc_nulls_last(), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    used = F.when(F.col("fill").isNotNull(), F.col("limit")).otherwise(F.lit(0.0))
    levels = sized.withColumn("fill", fill).select(
        "*",
        (F.lit(float(share)) * F.sum("source_size").over(everything) - F.coalesce(F.sum(used).over(before), F.lit(0.0))).alias("left"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))).alias("weight_left"),
    )
    # the first source, in this order, whose limit lies above the level that remains for it and those behind
    level = F.when(F.col("weight_left") > 0, F.col("left") / F.col("weight_left"))
    reached = levels.withColumn("level", F.when(F.col("fill") >= level, level))
    reached = reached.withColumn("level", F.max("level").over(everything))
    # no level: the limits together stay below the budget, and all are reached
    target = F.when(F.col("fill").isNull(), F.lit(0.0)).otherwise(F.least("limit", F.coalesce(F.col("level"), F.lit(float("inf"))) * F.col("weight")))
    return reached.select("source", "source_size", F.greatest(target, F.lit(0.0)).alias("target"))


def _digits(level: int) -> Column:
    return F.substring("hash", 1 + level * LEVEL_DIGITS, LEVEL_DIGITS)


def thresholds(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Repeats and hash threshold of each source: (source, source_size, target, repeats, threshold).

    ``rows``: (source, size, hash); ``wanted``: the result of ``targets``. A source gives all
    its rows ``repeats`` times, and those with ``hash < threshold`` once more. The rest of
    the target is met as closely as whole documents allow, from below or above.
    """
    repeats = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    state = wanted.withColumn("repeats", repeats).select(
        "*", (F.col("target") - F.col("repeats") * F.col("source_size")).alias("rest"), F.lit(0).cast("long").alias("below"), F.lit("").alias("prefix")
    )
    inside = rows
    for level in range(HASH_DIGITS // LEVEL_DIGITS):
        histogram = inside.groupBy("source", _digits(level).alias("bucket")).agg(F.sum("size").alias("words"))
        running = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        joined = histogram.join(state.withColumnRenamed("source", "of"), histogram["source"].eqNullSafe(F.col("of")))
        start = F.col("below") + F.coalesce(F.sum("words").over(running), F.lit(0))
        # the last bucket that begins at or below the rest: the budget ends in it
        begins = joined.select("*", start.alias("start")).where(F.col("start") <= F.col("rest"))
        border = begins.groupBy("source").agg(F.max_by(F.struct("bucket", "start", "words"), "bucket").alias("b"))
        border = border.select(F.col("source").alias("of"), "b.*")
        state = materialize(
            state.join(border, state["source"].eqNullSafe(border["of"]), "left").select(
                "source", "source_size", "target", "repeats", "rest",
                F.coalesce("start", "below").alias("below"),
                F.concat("prefix", F.coalesce("bucket", F.lit("0" * LEVEL_DIGITS))).alias("prefix"),
                F.coalesce("words", F.lit(0)).cast("long").alias("words"),
            ),
            "mix-border",
        )
        if level < HASH_DIGITS // LEVEL_DIGITS - 1:
            borders = state.select(F.col("source").alias("of"), "prefix")
            found = rows["source"].eqNullSafe(F.col("of")) & (F.substring("hash", 1, (level + 1) * LEVEL_DIGITS) == F.col("prefix"))
            kept = (rows if level == 0 else inside).join(borders, found, "left_semi")
            inside = rows = materialize(kept, "mix-inside")
            state = state.drop("words")
    # what is left is one hash: all its rows or none, whichever ends nearer to the rest
    over = (F.col("below") + F.col("words") - F.col("rest")) < (F.col("rest") - F.col("below"))
    threshold = F.when(F.col("rest") <= 0, F.lit("")).when(over, F.concat("prefix", F.lit("~"))).otherwise(F.col("prefix"))
    return state.select("source", "source_size", "target", "repeats", threshold.alias("threshold"))


def sized_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size, hash), stored: the texts are read once."""
    doc_id, text = docs[id_col], docs[text_col]
    return materialize(docs.select(doc_id.alias("doc_id"), docs[source_col].alias("source"), word_count(text).alias("size"), document_hash(doc_id, text).alias("hash")), "mix-sizes")


def cuts(rows: DataFrame, weights: DataFrame, share: float = 1.0, max_repeats: float = 3.0) -> DataFrame:
    """(of, source_size, target, repeats, threshold) for every source of ``rows`` (source, size, hash)."""
    sizes = materialize(rows.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sources")
    wanted = materialize(targets(sizes, weights, share, max_repeats), "mix-targets")
    return thresholds(rows.select("source", "size", "hash"), wanted).withColumnRenamed("source", "of")


def copies() -> Column:
    return F.col("repeats") + (F.col("hash") < F.col("threshold")).cast("long")


def mix(sized: DataFrame, weights: DataFrame, share: float = 1.0, max_repeats: float = 3.0) -> DataFrame:
    """How many words of each document a mix takes: (doc_id, source, size, source_size, target, taken, copies).

    ``sized``: the result of ``sized_documents``, ``weights``: (source, weight). One row per row
    of ``sized``. NULL text has no words, a NULL source is a source of its own, NULL ids are ids
    like others; a source's documents of one hash, as rows equal in id and text, are taken all or
    none. Empty tables give empty results.
    """
    cut = cuts(sized, weights, share, max_repeats)
    joined = sized.join(cut, sized["source"].eqNullSafe(cut["of"]))
    return joined.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * copies()).alias("taken"), copies().alias("copies"))


ADDED = ("size", "source_size", "target", "taken", "copies")


def mixed_documents(
    docs: DataFrame,
    weights: DataFrame | None = None,
    share: float = 1.0,
    max_repeats: float = 3.0,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """The documents that a mix takes, with their columns and ADDED: what ``mix`` says of them.

    Documents of which nothing is taken are left out; ``copies`` says how often one is to be
    used. ``weights`` are those of ``cycle_weights`` if not given. Columns of ``docs`` named
    like one of ADDED give way to it.
    """
    sized = sized_documents(docs, id_col, text_col, source_col)
    cut = cuts(sized, weights if weights is not None else cycle_weights(sized), share, max_repeats)
    text = docs[text_col]
    rows = docs.select(F.struct("*").alias("doc"), docs[source_col].alias("source"), word_count(text).alias("size"), document_hash(docs[id_col], text).alias("hash"))
    joined = rows.join(cut, rows["source"].eqNullSafe(cut["of"])).where(copies() > 0)
    taken = joined.withColumns({"taken": F.col("size") * copies(), "copies": copies()})
    return taken.select(*[F.col("doc")[c].alias(c) for c in docs.columns if c.lower() not in ADDED], *ADDED)


def cycle_weights(sources: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0)) -> DataFrame:
    """(source, weight): the weights in turn, over the distinct sources by code point, NULL last."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    cycle = F.array(*[F.lit(w) for w in weights])
    return sources.select("source").distinct().select("source", F.element_at(cycle, (F.pmod(place, F.lit(len(weights))) + 1).cast("int")).alias("weight"))
