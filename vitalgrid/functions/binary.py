"""Expressions over bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vitalgrid import domain
from vitalgrid.functions.numeric import round_exact


def checksum(content: Column) -> Column:
    return F.sha2(content, 256)


def byte_length(content: Column) -> Column:
    return F.length(content).cast("long")


def size_text(size: Column) -> Column:
    return F.format_string("%.1f MB", round_exact(size / F.lit(1048576.0), 1))


def data_url(content: Column, mime_type: Column) -> Column:
    """``base64`` breaks its text into lines, which a URL must not have."""
    encoded = F.replace(F.base64(content), F.lit("\r\n"), F.lit(""))
    return F.concat(F.lit("data:"), mime_type, F.lit(";base64,"), encoded)


def image_format(content: Column) -> Column:
    """Image format by its leading bytes, NULL when they are of no known format.

    Formats of several magics are named by their first.
    """
    head = F.hex(F.substring(content, 1, 12))
    found = F.lit(None).cast("string")
    for name, magic in reversed(domain.IMAGE_MAGIC.items()):
        # two "?" of a magic stand for one byte
        fits = head.rlike("^" + magic.replace("?", "."))
        found = F.when(fits, _MAIN_NAME.get(name, name)).otherwise(found)
    return found


_MAIN_NAME = {"GIF89A": "GIF", "TIFF_MM": "TIFF"}
