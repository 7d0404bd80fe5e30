"""Timestamps, identifiers and JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vitalgrid.functions.text import strip


def iso_time(ts: Column) -> Column:
    """ISO-8601 text in UTC, whatever the session's zone; microseconds appear only when they are not zero.

    A time without zone is taken as UTC.
    """
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    in_utc = F.timestamp_add("MICROSECOND", F.unix_micros(ts.cast("timestamp")), epoch)
    plain = F.when(F.typeof(ts) == "timestamp_ntz", ts.cast("timestamp_ntz")).otherwise(in_utc).cast("string")
    whole = F.translate(plain, " ", "T")
    return F.concat(F.when(F.contains(whole, F.lit(".")), F.rpad(whole, 26, "0")).otherwise(whole), F.lit("+00:00"))


def utc_now() -> Column:
    return F.current_timestamp()


def new_id() -> Column:
    return F.uuid()


def derived_id(*parts: Column) -> Column:
    """Repeatable identifier: reruns and retried tasks give the same one."""
    return F.md5(F.concat_ws("|", *parts))


def document(value: Column) -> Column:
    """JSON text that keeps NULL fields."""
    return F.to_json(value, {"ignoreNullFields": "false"})


def json_text(payload: Column, path: str, default: str | None = None) -> Column:
    found = F.get_json_object(payload, path)
    return F.coalesce(found, F.lit(default)) if default is not None else found


def json_number(payload: Column, path: str, default: float) -> Column:
    return F.coalesce(F.get_json_object(payload, path).try_cast("double"), F.lit(default))


def has_text(value: Column) -> Column:
    return F.coalesce(strip(value) != "", F.lit(False))
