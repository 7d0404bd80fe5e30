"""Checks of uploaded images and of labelled image folders."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalgrid import domain
from vitalgrid.functions.binary import image_format
from vitalgrid.functions.text import file_suffix, last_extension, strip

_EXTENSIONS = [e for group in domain.IMAGE_FORMATS.values() for e in group]


def _mismatch(extension: Column, found: Column) -> Column:
    """An extension of another format than the one found."""
    fits = [(found == name) & extension.isin(*group) for name, group in domain.IMAGE_FORMATS.items()]
    return found.isNotNull() & ~reduce(lambda a, b: a | b, fits)


def validate_images(
    objects: DataFrame, name: str = "path", content: str = "content", mime_type: str | None = None
) -> DataFrame:
    """``image_error``: first failing check, NULL for a good image.

    Checks come in this order: name, extension, MIME type (may be absent), empty, size,
    format by leading bytes, format allowed, extension against format.
    """
    title = strip(F.coalesce(F.col(name), F.lit("")))
    suffix = F.col("_suffix")
    wrong_mime = F.lit(False)
    if mime_type:
        given = F.lower(F.coalesce(F.col(mime_type), F.lit("")))
        wrong_mime = (given != "") & ~given.isin(*domain.IMAGE_MIME_TYPES)
    size = F.coalesce(F.length(content), F.lit(0))
    error = (
        F.when(title == "", domain.IMAGE_NAME_MISSING)
        .when(~suffix.isin(*[f".{e}" for e in _EXTENSIONS]) | wrong_mime, domain.IMAGE_TYPE_UNSUPPORTED)
        .when(size == 0, domain.IMAGE_EMPTY)
        .when(size > domain.MAX_IMAGE_BYTES, domain.IMAGE_TOO_LARGE)
        .when(F.col("_format").isNull(), domain.IMAGE_UNREADABLE)
        .when(~F.col("_format").isin(*domain.IMAGE_FORMATS), domain.IMAGE_FORMAT_UNSUPPORTED)
        .when(_mismatch(F.substr(suffix, F.lit(2)), F.col("_format")), domain.IMAGE_MISMATCH)
    )
    prepared = objects.withColumns({"_suffix": file_suffix(title), "_format": image_format(F.col(content))})
    return prepared.withColumn("image_error", error).drop("_suffix", "_format")


def validate_uploads(objects: DataFrame, name: str = "path", content: str = "content") -> DataFrame:
    """``upload_error`` and ``mime_type``: the same checks as the upload form words them."""
    title = F.coalesce(F.col(name), F.lit(""))
    size = F.coalesce(F.length(content), F.lit(0))
    extension = F.col("_extension")
    error = (
        F.when(strip(title) == "", domain.UPLOAD_NAME_INVALID)
        .when(extension.isNull(), domain.UPLOAD_NO_EXTENSION)
        .when(~extension.isin(*_EXTENSIONS), domain.UPLOAD_FORMAT)
        .when(size == 0, domain.UPLOAD_EMPTY)
        .when(size > domain.MAX_IMAGE_BYTES, domain.UPLOAD_TOO_LARGE)
        .when(F.col("_format").isNull(), domain.UPLOAD_UNREADABLE)
        .when(~F.col("_format").isin(*domain.IMAGE_FORMATS), domain.UPLOAD_FORMAT)
        .when(_mismatch(extension, F.col("_format")), domain.UPLOAD_MISMATCH)
    )
    prepared = objects.withColumns(
        {"_extension": last_extension(title), "_format": image_format(F.col(content))}
    )
    checked = prepared.withColumn("upload_error", error)
    mime = F.when(F.col("upload_error").isNull(), F.concat(F.lit("image/"), F.lower("_format")))
    return checked.withColumn("mime_type", mime).drop("_extension", "_format")


def dataset_class_parity(images: DataFrame, split: str = "folder_split", label: str = "label") -> DataFrame:
    """Classes that occur in only one of train and test, with the split they miss.

    A split without any class misses all of them, so an absent split shows as well.
    """
    sides = images.groupBy(F.col(label).alias("label")).agg(
        F.coalesce(F.bool_or(F.col(split) == "train"), F.lit(False)).alias("in_train"),
        F.coalesce(F.bool_or(F.col(split) == "test"), F.lit(False)).alias("in_test"),
    )
    missing = F.when(~F.col("in_train"), "train").when(~F.col("in_test"), "test")
    return sides.withColumn("missing_split", missing).filter("missing_split IS NOT NULL").select("label", "missing_split")


def split_class_counts(
    images: DataFrame, splits: tuple = ("train", "test"), labels: tuple = domain.MODEL_CLASSES,
    split: str = "folder_split", label: str = "label",
) -> DataFrame:
    """Rows per split and class of a fixed grid, zeros included."""
    spark = images.sparkSession
    grid = spark.range(1).select(F.explode(F.array(*[F.lit(s) for s in splits])).alias("folder_split")).select(
        "folder_split", F.explode(F.array(*[F.lit(l) for l in labels])).alias("label")
    )
    counts = images.groupBy(F.col(split).alias("folder_split"), F.col(label).alias("label")).agg(
        F.count(F.lit(1)).alias("rows")
    )
    return grid.join(counts, ["folder_split", "label"], "left").select(
        "folder_split", "label", F.coalesce("rows", F.lit(0)).cast("long").alias("rows")
    )
