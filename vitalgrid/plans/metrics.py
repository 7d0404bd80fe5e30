"""Queries over stored tables: totals, recent rows, event state, snapshot."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitalgrid.functions.records import iso_time
from vitalgrid.operators import metrics, radiology, triage
from vitalgrid.plans.radiology import records
from vitalgrid.plans.registry import query
from vitalgrid.plans.triage import requests
from vitalgrid.plans.views import iso, round_exact
from vitalgrid.sources import clinical

_SUMMARY = f"""
    SELECT count(*) AS total_studies, count(*) FILTER (WHERE prediction_class = 'Sana') AS healthy_count,
           count(*) FILTER (WHERE prediction_class = 'Neumonia') AS pneumonia_count,
           count(*) FILTER (WHERE prediction_class = 'COVID-19') AS covid_count,
           count(*) FILTER (WHERE quality_status <> 'accepted') AS warning_count,
           {round_exact('coalesce(avg(confidence), 0e0)', 4)} AS average_confidence, {iso('max(created_at)')} AS last_study_at FROM v_flagged"""


def flagged(spark, d):
    return radiology.quality_status(radiology.quality_flags(clinical.predictions(spark, d)))


def scored(spark, d):
    return triage.rules_risk(requests(spark, d))


@query("radiology_summary", _SUMMARY)
def radiology_summary(spark, d):
    return metrics.radiology_summary(flagged(spark, d))


@query("triage_total", "SELECT count(*) AS total_triage FROM v_triage")
def triage_total(spark, d):
    return metrics.triage_total(requests(spark, d))


@query("open_events_by_severity", "SELECT severity, count(*) AS events FROM v_events WHERE NOT resolved GROUP BY severity ORDER BY severity")
def open_events_by_severity(spark, d):
    return metrics.open_events_by_severity(clinical.quality_events(spark, d))


@query("recent_studies", f"""
    SELECT study_id, {iso('created_at')} AS created_at, original_filename, file_size_bytes, prediction_class, confidence, quality_status, messages, report_object_key
    FROM v_flagged ORDER BY v_flagged.created_at DESC, study_id DESC LIMIT 10""")
def recent_studies(spark, d):
    rows = metrics.history(records(spark, d), metrics.STUDY_HISTORY)
    return rows.select(
        "study_id", "created_at", "original_filename", "file_size_bytes", "prediction_class", "confidence", "quality_status",
        F.array_join("quality_messages", " | ").alias("messages"), "report_object_key",
    )


@query("recent_triages", f"""
    SELECT triage_id, {iso('created_at')} AS created_at, patient_name, risk_level, recommended_priority, score, confidence
    FROM v_rules ORDER BY v_rules.created_at DESC, triage_id DESC LIMIT 10""")
def recent_triages(spark, d):
    rows = metrics.history(scored(spark, d), metrics.TRIAGE_HISTORY)
    return rows.select("triage_id", "created_at", "patient_name", "risk_level", "recommended_priority", "score", "confidence")


@query("recent_events", f"""
    SELECT event_id, {iso('created_at')} AS created_at, source, severity, event_type, resolved
    FROM v_events ORDER BY v_events.created_at DESC, event_id DESC LIMIT 100""")
def recent_events(spark, d):
    return metrics.history(clinical.quality_events(spark, d), metrics.EVENT_HISTORY, 100)


@query("latest_run", f"SELECT run_id, {iso('created_at')} AS created_at, status, processed_count, rejected_count FROM v_runs ORDER BY v_runs.created_at DESC, run_id DESC LIMIT 1")
def latest_run(spark, d):
    return metrics.latest_run(clinical.runs(spark, d))


@query("event_current_state", f"""
    SELECT event_id, CAST(version AS INTEGER) AS version, {iso('created_at')} AS created_at, source, severity, event_type, resolved
    FROM v_event_log QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY version DESC) = 1""")
def event_current_state(spark, d):
    current = metrics.current_events(clinical.event_log(spark, d))
    return current.withColumn("created_at", iso_time(F.col("created_at")))


@query("event_resolve", """
    SELECT event_id, CAST(max(version) + 1 AS INTEGER) AS version, TRUE AS resolved FROM v_event_log
    WHERE event_id IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY event_id HAVING NOT bool_or(resolved)""")
def event_resolve(spark, d):
    """Resolving a list of events: the versions to append."""
    toxic = clinical.table(spark, d, "labels").filter("toxic = 1").select(F.col("doc_id").alias("event_id"))
    return metrics.resolved_version(clinical.event_log(spark, d), toxic).select("event_id", "version", "resolved")


@query("platform_snapshot", f"""
    SELECT s.*, (SELECT count(*) FROM v_triage) AS total_triage,
           (SELECT run_id FROM v_runs ORDER BY created_at DESC, run_id DESC LIMIT 1) AS latest_run_id,
           (SELECT status FROM v_runs ORDER BY created_at DESC, run_id DESC LIMIT 1) AS latest_status,
           (SELECT count(*) FROM v_events WHERE NOT resolved AND severity = 'high') AS open_high,
           (SELECT count(*) FROM v_events WHERE NOT resolved AND severity = 'medium') AS open_medium, FALSE AS model_loaded
    FROM ({_SUMMARY}) s""")
def platform_snapshot(spark, d):
    snapshot = _snapshot(spark, d)
    distribution, open_events = F.col("radiology.class_distribution"), F.col("quality.open_events_by_severity")
    return snapshot.select(
        "radiology.total_studies", distribution["Sana"].alias("healthy_count"), distribution["Neumonia"].alias("pneumonia_count"),
        distribution["COVID-19"].alias("covid_count"), "radiology.warning_count", "radiology.average_confidence", "radiology.last_study_at",
        F.col("triage.total_records").alias("total_triage"), F.col("pipeline.latest_run.run_id").alias("latest_run_id"),
        F.col("pipeline.latest_run.status").alias("latest_status"), open_events["high"].alias("open_high"),
        open_events["medium"].alias("open_medium"), F.col("services.triage_model.loaded").alias("model_loaded"),
    )


def _snapshot(spark, d):
    return metrics.platform_snapshot(
        flagged(spark, d), requests(spark, d), clinical.runs(spark, d), clinical.quality_events(spark, d)
    )


@query("snapshot_defaults", """
    SELECT (SELECT count(*) FROM v_predictions) AS total_studies, (SELECT count(*) FROM v_triage) AS total_triage,
           '{"latest_run":null}' AS pipeline, '[]' AS recent_studies, '[]' AS recent_triages, 'no disponible' AS backend_status""")
def snapshot_defaults(spark, d):
    """A snapshot whose pipeline section and lists are missing."""
    filled = metrics.with_snapshot_defaults(_snapshot(spark, d).drop("pipeline"))
    return filled.select(
        F.get_json_object("radiology", "$.total_studies").cast("long").alias("total_studies"),
        F.get_json_object("triage", "$.total_records").cast("long").alias("total_triage"),
        "pipeline", "recent_studies", "recent_triages", "backend_status",
    )


@query("history_feed", f"""
    SELECT * FROM (SELECT 'study' AS kind, study_id AS id, {iso('created_at')} AS created_at, prediction_class AS headline FROM v_predictions ORDER BY v_predictions.created_at DESC, id DESC LIMIT 6) a
    UNION ALL SELECT * FROM (SELECT 'event', CAST(event_id AS VARCHAR) AS id, {iso('created_at')} AS created_at, severity FROM v_events ORDER BY v_events.created_at DESC, id DESC LIMIT 6) b
    UNION ALL SELECT * FROM (SELECT 'triage', triage_id AS id, {iso('created_at')} AS created_at, risk_level FROM v_rules ORDER BY v_rules.created_at DESC, id DESC LIMIT 6) c""")
def history_feed(spark, d):
    return metrics.history_feed(clinical.predictions(spark, d), clinical.quality_events(spark, d), scored(spark, d))
