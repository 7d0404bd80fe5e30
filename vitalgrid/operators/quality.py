"""Study batches: normalise, find repeated keys, split into accepted and rejected."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalgrid import domain
from vitalgrid.functions.arrays import present
from vitalgrid.session import materialize

# Repeated keys are broadcast while they stay below both sizes.
BROADCAST_KEYS = 500_000
BROADCAST_BYTES = 64 * 1024 * 1024
# Beyond them this many of the most frequent keys are still broadcast, so that the
# keys left for the shuffled join hold at most 1/1001 of the rows each.
HOT_KEYS = 1000


def normalize(df: DataFrame, required: Sequence[str] = domain.REQUIRED_COLUMNS) -> DataFrame:
    """The required columns in order, spaces trimmed."""
    return df.select([F.trim(F.col(name)).alias(name) for name in required])


def is_complete(required: Sequence[str] = domain.REQUIRED_COLUMNS) -> Column:
    return reduce(and_, [F.col(c).isNotNull() & (F.col(c) != "") for c in required])


def has_valid_label(labels: Sequence[str] = domain.VALID_LABELS) -> Column:
    return F.coalesce(F.col("label").isin(*labels), F.lit(False))


def complete_rows(df: DataFrame, required: Sequence[str] = domain.REQUIRED_COLUMNS) -> DataFrame:
    return df.filter(is_complete(required))


def valid_label_rows(df: DataFrame, labels: Sequence[str] = domain.VALID_LABELS) -> DataFrame:
    return df.filter(has_valid_label(labels))


def duplicate_keys(df: DataFrame, key: str = domain.OBJECT_KEY) -> DataFrame:
    """Keys held by more than one row, with their row count; blank keys never count.

    Reads one column. Frequent keys shrink to one row per task before the shuffle.
    """
    return (
        df.filter(F.col(key) != "")
        .groupBy(key)
        .agg(F.count(F.lit(1)).alias("records"))
        .filter("records > 1")
    )


def _fits_broadcast(keys: DataFrame, key: str) -> bool:
    size = keys.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length(key)), F.lit(0)).alias("b")).first()
    return size.n <= BROADCAST_KEYS and size.b <= BROADCAST_BYTES


def flag_duplicates(
    df: DataFrame, key: str = domain.OBJECT_KEY, repeated: DataFrame | None = None
) -> DataFrame:
    """``df`` with ``is_duplicate``: every row whose key occurs more than once.

    ``repeated`` is a stored result of ``duplicate_keys``; without it the keys are
    computed here, once, and written to the shared folder. While they are few they are
    broadcast and the rows do not move. Otherwise the most frequent ones are broadcast,
    which is a bounded table, and only rows with other keys look for a partner in a
    shuffled join; the rest is spread over the join's tasks by partition.
    """
    if repeated is None:
        repeated = materialize(duplicate_keys(df, key), "repeated-keys")
    columns = [F.col(name) for name in df.columns]
    if _fits_broadcast(repeated, key):
        marks = repeated.select(F.col(key).alias("_key"), F.lit(True).alias("_seen"))
        joined = df.join(F.broadcast(marks), F.col(key) == F.col("_key"), "left")
        return joined.select(*columns, F.col("_seen").isNotNull().alias("is_duplicate"))

    hottest = repeated.orderBy(F.desc("records"), key).limit(HOT_KEYS)
    hot = hottest.select(F.col(key).alias("_hot_key"), F.lit(True).alias("_hot"))
    routed = df.join(F.broadcast(hot), F.col(key) == F.col("_hot_key"), "left")
    searching = F.col("_hot").isNull() & (F.col(key) != "")
    # 'p<number>' matches no 'k<key>'; it only deals these rows out over the join's tasks
    elsewhere = F.concat(F.lit("p"), F.spark_partition_id().cast("string"))
    routed = routed.withColumn("_search", F.when(searching, F.concat(F.lit("k"), key)).otherwise(elsewhere))
    others = repeated.select(F.concat(F.lit("k"), key).alias("_key"))
    joined = routed.join(others, F.col("_search") == F.col("_key"), "left")
    flagged = F.col("_hot").isNotNull() | F.col("_key").isNotNull()
    return joined.select(*columns, flagged.alias("is_duplicate"))


def duplicate_exclusion(df: DataFrame, key: str = domain.OBJECT_KEY) -> DataFrame:
    """Rows whose key is unique or blank: all copies of a repeated key go."""
    return flag_duplicates(df, key).filter(~F.col("is_duplicate")).drop("is_duplicate")


def duplicate_members(df: DataFrame, key: str = domain.OBJECT_KEY) -> DataFrame:
    return flag_duplicates(df, key).filter("is_duplicate").drop("is_duplicate")


def judge(
    df: DataFrame,
    required: Sequence[str] = domain.REQUIRED_COLUMNS,
    labels: Sequence[str] = domain.VALID_LABELS,
) -> DataFrame:
    """Columns ``is_accepted`` and ``reject_reasons`` for rows with ``is_duplicate``."""
    reasons = present(
        F.when(~is_complete(required), domain.REASON_INCOMPLETE),
        F.when(~has_valid_label(labels), domain.REASON_LABEL),
        F.when(F.col("is_duplicate"), domain.REASON_DUPLICATE),
    )
    accepted = is_complete(required) & has_valid_label(labels) & ~F.col("is_duplicate")
    return df.withColumns({"is_accepted": accepted, "reject_reasons": reasons})


def assess_batch(
    df: DataFrame,
    required: Sequence[str] = domain.REQUIRED_COLUMNS,
    labels: Sequence[str] = domain.VALID_LABELS,
    key: str = domain.OBJECT_KEY,
) -> DataFrame:
    """Every normalised row once, with is_duplicate, is_accepted and reject_reasons."""
    return judge(flag_duplicates(normalize(df, required), key), required, labels)


def accepted(assessed: DataFrame) -> DataFrame:
    return assessed.filter("is_accepted").drop("is_duplicate", "is_accepted", "reject_reasons")


def rejected(assessed: DataFrame) -> DataFrame:
    return assessed.filter("NOT is_accepted").drop("is_duplicate", "is_accepted", "reject_reasons")


def reject_reason_counts(assessed: DataFrame) -> DataFrame:
    return (
        assessed.select(F.explode_outer("reject_reasons").alias("reason"))
        .filter("reason IS NOT NULL")
        .groupBy("reason")
        .agg(F.count(F.lit(1)).alias("rows"))
    )


def rejected_samples(assessed: DataFrame, n: int = domain.REJECTED_SAMPLE_ROWS) -> DataFrame:
    """The first ``n`` rejected rows by study id (then by the other columns)."""
    rows = rejected(assessed)
    return rows.orderBy(*rows.columns).limit(n)


def accept_reject_counts(assessed: DataFrame) -> DataFrame:
    return assessed.agg(
        F.count_if("is_accepted").alias("processed_count"),
        F.count_if(~F.col("is_accepted")).alias("rejected_count"),
    )


def class_distribution(accepted_rows: DataFrame) -> DataFrame:
    return accepted_rows.groupBy("label").agg(F.count(F.lit(1)).alias("rows"))


def _side(rows: DataFrame, columns: Sequence[str], i: Column | int, a: Column | int, r: Column | int) -> DataFrame:
    tags = {"i": i, "a": a, "r": r}
    return rows.select(*columns, *[(t if isinstance(t, Column) else F.lit(t)).cast("int").alias(n) for n, t in tags.items()])


def _balance(tagged: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Copies are counted, not listed: one shuffle of distinct rows, combined beforehand."""
    per_row = tagged.groupBy(*columns).agg(F.sum("i").alias("i"), F.sum("a").alias("a"), F.sum("r").alias("r"))
    zero = F.lit(0)

    def total(value: Column) -> Column:
        return F.coalesce(F.sum(value), zero).cast("long")

    return per_row.agg(
        total(F.col("i")).alias("input_rows"),
        total(F.col("a") + F.col("r")).alias("output_rows"),
        total(F.greatest(F.col("i") - F.col("a") - F.col("r"), zero)).alias("missing_rows"),
        total(F.greatest(F.col("a") + F.col("r") - F.col("i"), zero)).alias("excess_rows"),
        total(F.least("a", "r")).alias("rows_on_both_sides"),
    )


def partition_invariant(normalized: DataFrame, accepted_rows: DataFrame, rejected_rows: DataFrame) -> DataFrame:
    """One row: rows missing from both sides, rows in excess, rows on both sides.

    All three are zero for a proper split.
    """
    columns = normalized.columns
    tagged = _side(normalized, columns, 1, 0, 0).unionByName(_side(accepted_rows, columns, 0, 1, 0))
    return _balance(tagged.unionByName(_side(rejected_rows, columns, 0, 0, 1)), columns)


def verdict_invariant(normalized: DataFrame, assessed: DataFrame) -> DataFrame:
    """``partition_invariant`` of an assessed batch, which is read once: its verdict tells the side."""
    columns, good = normalized.columns, F.col("is_accepted")
    return _balance(_side(normalized, columns, 1, 0, 0).unionByName(_side(assessed, columns, 0, good, ~good)), columns)
