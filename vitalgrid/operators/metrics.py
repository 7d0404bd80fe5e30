"""Operational metrics, recent rows, current event state and the platform snapshot."""

from __future__ import annotations

import json

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalgrid import domain
from vitalgrid.functions.arrays import literals
from vitalgrid.functions.numeric import round_exact
from vitalgrid.functions.records import document, iso_time

DEFAULT_LIMIT, HIGHEST_LIMIT = 10, 100

STUDY_HISTORY = (
    "study_id", "created_at", "original_filename", "content_type", "file_size_bytes", "image_bucket",
    "image_object_key", "prediction_class", "probabilities", "model_name", "model_version",
    "confidence", "quality_status", "quality_messages", "report_bucket", "report_object_key",
)
TRIAGE_HISTORY = (
    "triage_id", "patient_id", "patient_name", "created_at", "risk_level", "recommended_priority",
    "score", "confidence", "report_bucket", "report_object_key",
)
EVENT_HISTORY = (
    "event_id", "created_at", "source", "severity", "event_type", "message", "metadata", "resolved",
)


class LimitError(ValueError):
    pass


def checked_limit(n: int = DEFAULT_LIMIT) -> int:
    if not 1 <= n <= HIGHEST_LIMIT:
        raise LimitError(f"limit must be between 1 and {HIGHEST_LIMIT}, not {n}")
    return n


def radiology_summary(studies: DataFrame) -> DataFrame:
    """One row of totals in one pass; zeros and a NULL time for an empty table."""
    is_class = {name: F.col("prediction_class") == name for name in domain.DISPLAY_CLASSES}
    totals = studies.agg(
        F.count(F.lit(1)).alias("total_studies"),
        F.count_if(is_class["Sana"]).alias("healthy_count"),
        F.count_if(is_class["Neumonia"]).alias("pneumonia_count"),
        F.count_if(is_class["COVID-19"]).alias("covid_count"),
        F.count_if(F.col("quality_status") != "accepted").alias("warning_count"),
        F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("average_confidence"),
        F.max("created_at").alias("last_study_at"),
    )
    return totals.withColumns(
        {
            "average_confidence": round_exact(F.col("average_confidence"), 4),
            "last_study_at": iso_time(F.col("last_study_at")),
        }
    )


def triage_total(triages: DataFrame) -> DataFrame:
    return triages.agg(F.count(F.lit(1)).alias("total_triage"))


def open_events_by_severity(events: DataFrame) -> DataFrame:
    """Unresolved events per severity, ordered by severity."""
    return (
        events.filter(~F.col("resolved"))
        .groupBy("severity")
        .agg(F.count(F.lit(1)).alias("events"))
        .orderBy("severity")
    )


def recent(df: DataFrame, n: int = DEFAULT_LIMIT, id_col: str = "id") -> DataFrame:
    """The ``n`` newest rows, later ids first among equal times, times as text.

    Every task keeps ``n`` rows and one task merges them; nothing is sorted as a whole.
    """
    rows = checked_limit(n)
    newest = df.orderBy(F.desc("created_at"), F.desc(id_col)).limit(rows)
    return newest.withColumn("created_at", iso_time(F.col("created_at")))


def history(df: DataFrame, columns: Sequence[str], n: int = DEFAULT_LIMIT) -> DataFrame:
    """``recent`` over the listed columns only, so heavy ones are never read.

    A stored ``id`` is shown under the name of the first identifier of ``columns``.
    """
    id_col = next(name for name in columns if name.endswith("_id"))
    renamed = df.withColumnRenamed("id", id_col) if "id" in df.columns else df
    return recent(renamed.select([c for c in columns if c in renamed.columns]), n, id_col)


def latest_run(runs: DataFrame, id_col: str = "run_id") -> DataFrame:
    return recent(runs, 1, id_col)


def current_events(event_log: DataFrame, id_col: str = "event_id") -> DataFrame:
    """Newest version of every event of an append-only log.

    A maximum per event, combined before the shuffle, however many versions one has.
    """
    others = [c for c in event_log.columns if c not in (id_col, "version")]
    newest = F.max(F.struct("version", *others)).alias("_newest")
    return event_log.groupBy(id_col).agg(newest).select(id_col, "_newest.*")


def resolved_version(event_log: DataFrame, ids: DataFrame, id_col: str = "event_id") -> DataFrame:
    """Versions to append so that the given events are resolved.

    An event that is resolved already gets no further version, and one the log does not hold
    yields no row; ``missing_ids`` names those.
    """
    current = current_events(event_log, id_col).where(~F.col("resolved"))
    chosen = current.join(ids.select(id_col).distinct(), id_col, "left_semi")
    return chosen.withColumns({"version": F.col("version") + 1, "resolved": F.lit(True)})


def rows_by_id(df: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """Rows of the requested ids, at any number of ids."""
    return df.join(ids.select(id_col), id_col, "left_semi")


def missing_ids(df: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """Requested ids without a row."""
    return ids.select(id_col).distinct().join(df.select(id_col), id_col, "left_anti")


def report_lookup(records: DataFrame, documents: DataFrame) -> DataFrame:
    """Records with their stored document, by report_object_key."""
    return records.join(documents.select("report_object_key", "document"), "report_object_key")


def platform_snapshot(
    studies: DataFrame, triages: DataFrame, runs: DataFrame, events: DataFrame, model_status: Column | None = None
) -> DataFrame:
    """One row with the sections radiology, triage, pipeline, quality and services.

    Each section is its own single-row query, put together as scalar subqueries.
    """
    summary = radiology_summary(studies)
    run = latest_run(runs)
    open_counts = open_events_by_severity(events).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("severity", "events")))).alias("m")
    )
    status = model_status if model_status is not None else F.struct(F.lit(False).alias("loaded"), F.lit(None).cast("string").alias("model_name"))
    distribution = F.map_from_arrays(
        literals(domain.DISPLAY_CLASSES), F.array("healthy_count", "pneumonia_count", "covid_count")
    )
    return summary.select(
        F.struct(
            "total_studies",
            distribution.alias("class_distribution"),
            "warning_count",
            "average_confidence",
            "last_study_at",
        ).alias("radiology"),
        F.struct(triage_total(triages).scalar().alias("total_records")).alias("triage"),
        F.struct(run.select(F.struct(*run.columns)).scalar().alias("latest_run")).alias("pipeline"),
        F.struct(open_counts.scalar().alias("open_events_by_severity")).alias("quality"),
        F.struct(status.alias("triage_model")).alias("services"),
    )


# sections as JSON texts; the status is a text already
DEFAULT_SECTIONS = {name: value if isinstance(value, str) else json.dumps(value, separators=(",", ":")) for name, value in domain.DEFAULT_SECTIONS.items()}


def with_snapshot_defaults(snapshot: DataFrame) -> DataFrame:
    """One row of JSON sections; what ``snapshot`` lacks, or has as NULL, is a default.

    ``snapshot`` may have no row at all. It is evaluated once: its row and the row of
    defaults are merged by an aggregate that prefers the former.
    """

    def found(name: str) -> Column:
        if name == "triage_model" and "services" in snapshot.columns:
            return document(F.col("services")["triage_model"])
        if name not in snapshot.columns:
            return F.lit(None).cast("string")
        return F.col(name) if name == "backend_status" else document(F.col(name))

    given = snapshot.select(F.lit(0).alias("_order"), *[found(n).alias(n) for n in DEFAULT_SECTIONS])
    defaults = snapshot.sparkSession.range(1).select(
        F.lit(1).alias("_order"), *[F.lit(text).alias(n) for n, text in DEFAULT_SECTIONS.items()]
    )
    return given.unionByName(defaults).agg(
        *[F.min_by(n, F.when(F.col(n).isNotNull(), F.col("_order"))).alias(n) for n in DEFAULT_SECTIONS]
    )


def history_feed(studies: DataFrame, events: DataFrame, triages: DataFrame, n: int = 6) -> DataFrame:
    """The ``n`` newest studies, events and triages as (kind, id, created_at, headline)."""

    def tagged(df: DataFrame, kind: str, id_col: str, headline: str) -> DataFrame:
        rows = recent(df.select(F.col(id_col).cast("string").alias("id"), "created_at", F.col(headline).alias("headline")), n)
        return rows.select(F.lit(kind).alias("kind"), "id", "created_at", "headline")

    return (
        tagged(studies, "study", "study_id", "prediction_class")
        .unionByName(tagged(events, "event", "event_id", "severity"))
        .unionByName(tagged(triages, "triage", "triage_id", "risk_level"))
    )
