"""Streaming queries, driven over the tables until nothing new is available."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitalgrid import domain
from vitalgrid.plans.registry import query
from vitalgrid.session import scratch_path
from vitalgrid.sources import clinical
from vitalgrid.streaming import flows


def _appended(spark, stream, name):
    path, checkpoint = scratch_path(spark, name), scratch_path(spark, f"{name}-progress")
    flows.append_to(stream, path, checkpoint).awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


@query("stream_quality_events", "SELECT study_id, md5(study_id || '|' || event_type) AS event_id, severity, event_type, message FROM v_study_events")
def stream_quality_events(spark, d):
    events = flows.stream_quality_events(clinical.prediction_stream(spark, d))
    return _appended(spark, events, "stream-events").select("study_id", "event_id", "severity", "event_type", "message")


@query("stream_triage_assess", f"SELECT triage_id, score, risk_level, recommended_priority, confidence, '{domain.RULES_MODEL_NAME}' AS model_name FROM v_rules")
def stream_triage_assess(spark, d):
    columns = ("triage_id", "score", "risk_level", "recommended_priority", "confidence", "model_name")
    return _appended(spark, flows.stream_assess(clinical.triage_stream(spark, d)).select(*columns), "stream-triage")


@query("stream_open_event_counts", "SELECT severity, count(*) AS events FROM v_events WHERE NOT resolved GROUP BY severity")
def stream_open_event_counts(spark, d):
    """The log in eight files and micro-batches, every sixth event resolved twice."""
    log = clinical.event_log(spark, d)
    again = log.where("resolved AND event_id % 6 = 0").withColumn("version", F.col("version") + 1)
    incoming, path, checkpoint = (scratch_path(spark, n) for n in ("event-log", "open-changes", "open-progress"))
    log.unionByName(again).repartition(8, "event_id", "version").write.parquet(incoming)
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(incoming)
    flows.store_open_counts(stream, path, checkpoint).awaitTermination()
    return flows.open_counts(spark, path)


_BATCH_COLUMNS = ", ".join(f"nullif({c}, '') AS {c}" for c in domain.REQUIRED_COLUMNS)


@query("stream_ingest_studies", f"SELECT CASE WHEN is_accepted THEN 'accepted' ELSE 'rejected' END AS outcome, {_BATCH_COLUMNS} FROM v_assessed")
def stream_ingest_studies(spark, d):
    """Five files in as many micro-batches; settled, the rows are those of the batch job."""
    names = ("incoming", "stream-outcome", "stream-store", "stream-progress")
    source, output, store, checkpoint = (scratch_path(spark, name) for name in names)
    clinical.studies_raw(spark, d).repartition(5, "study_id").write.option("header", True).csv(source)
    flows.stream_ingest(spark, source, output, store, checkpoint, files_per_batch=1).awaitTermination()
    columns = [F.nullif(F.col(c), F.lit("")).alias(c) for c in domain.REQUIRED_COLUMNS]
    sides = [flows.settled_outcome(spark, output, store, side).select(F.lit(side).alias("outcome"), *columns) for side in ("accepted", "rejected")]
    return sides[0].unionByName(sides[1])
