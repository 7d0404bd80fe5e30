"""What the text operators share: reading tables, row keys, folds, repeated rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the text operators: runs of anything but ASCII white space.
SPACED_WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Two columns, ``doc_id`` and ``text`` (NULL as empty); all other columns are left out."""
    return docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))


def text_key(text: Column) -> Column:
    """128 bits that stand for a text: rows of one id and one text have one result."""
    return F.unhex(F.md5(text.cast("binary")))


def fold(id_col: Column, parts: int) -> Column:
    """``crc32`` of the id's text modulo ``parts``; a NULL id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(parts))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else; texts of ASCII alone take the faster function."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, letters, letters.lower()))


def repeat_rows(df: DataFrame, times: str) -> DataFrame:
    """Every row ``times`` times; in two steps, so that no array holds a large count."""
    step = 10_000
    outer = df.withColumn("_block", F.explode(F.sequence(F.lit(0), F.floor((F.col(times) - 1) / step))))
    left = F.least(F.lit(step), F.col(times) - F.col("_block") * step)
    return outer.withColumn("_row", F.explode(F.sequence(F.lit(1), left.cast("int")))).drop("_block", "_row", times)


def map_batches(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``mapInArrow`` with a function of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := function(batch)) is not None:
                yield out

    return df.mapInArrow(run, schema)
