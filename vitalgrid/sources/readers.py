"""Readers for study batches and image folders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitalgrid import domain
from vitalgrid.functions.binary import byte_length, checksum
from vitalgrid.functions.arrays import lookup
from vitalgrid.functions.text import file_suffix


class MissingColumnsError(ValueError):
    pass


class UnknownFoldersError(ValueError):
    pass


def missing_columns(actual: Sequence[str], required: Sequence[str]) -> list[str]:
    return [name for name in required if name not in actual]


def require_columns(df: DataFrame, required: Sequence[str] = domain.REQUIRED_COLUMNS) -> DataFrame:
    """``df`` itself, or an error naming the missing columns in the required order."""
    missing = missing_columns(df.columns, required)
    if missing:
        raise MissingColumnsError(f"Missing required columns: {', '.join(missing)}")
    return df


def scan_studies(spark: SparkSession, path: str, required: Sequence[str] = domain.REQUIRED_COLUMNS) -> DataFrame:
    """Header CSV with every column a string.

    Only the first header row is read ahead, for the column names. Files whose header
    differs from it fail instead of being read by position.
    """
    batch = spark.read.option("header", True).option("enforceSchema", False).csv(path)
    return require_columns(batch, required)


def scan_images(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Image objects below ``path``. Queries that leave out ``content`` read no bytes."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .load(path)
    )


def image_catalog(objects: DataFrame) -> DataFrame:
    """Size, checksum and suffix of every object in (path, content)."""
    return objects.select(
        "path",
        byte_length(F.col("content")).alias("file_size_bytes"),
        checksum(F.col("content")).alias("checksum_sha256"),
        file_suffix(F.col("path")).alias("extension"),
    )


def labelled_images(objects: DataFrame) -> DataFrame:
    """Split, class folder and label read off ``.../<split>/<class>/<file>`` paths.

    ``label`` is NULL for folders that stand for no class, see ``unknown_folders``.
    """
    parts = objects.select("path", F.split("path", "/").alias("parts"))
    folder = F.try_element_at("parts", F.lit(-2))
    return parts.select(
        "path",
        F.try_element_at("parts", F.lit(-3)).alias("folder_split"),
        folder.alias("folder"),
        lookup(folder, domain.FOLDER_LABELS).alias("label"),
    )


def unknown_folders(images: DataFrame) -> DataFrame:
    return (
        images.filter(F.col("label").isNull())
        .groupBy("folder_split", "folder")
        .agg(F.count(F.lit(1)).alias("files"))
    )


def scan_labelled_images(spark: SparkSession, path: str) -> DataFrame:
    """``labelled_images`` of a dataset folder; an unknown class folder is an error.

    Their number and at most ten of their names come back to the driver.
    """
    images = labelled_images(scan_images(spark, path))
    names = unknown_folders(images).select("folder").distinct()
    strangers = [row.folder for row in names.orderBy("folder").limit(10).collect()]
    if strangers:
        raise UnknownFoldersError(
            f"{names.count()} unknown folders {strangers}, expected {sorted(domain.FOLDER_LABELS)}"
        )
    return images


PREDICTION_PAYLOAD = T.StructType(
    [
        T.StructField("class", T.StringType()),
        T.StructField("probabilities", T.MapType(T.StringType(), T.StringType())),
        T.StructField("study_id", T.StringType()),
        T.StructField("created_at", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("quality_status", T.StringType()),
        T.StructField("quality_flags", T.ArrayType(T.StringType())),
    ]
)
