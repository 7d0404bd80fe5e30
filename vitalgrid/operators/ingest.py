"""The batch job: study file in, accepted rows, run report, run row and event out."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitalgrid import domain
from vitalgrid.functions.arrays import literals
from vitalgrid.functions.records import derived_id, document, iso_time
from vitalgrid.functions.text import report_key
from vitalgrid.operators import quality
from vitalgrid.schemas import STUDY_BATCH
from vitalgrid.session import materialize
from vitalgrid.sources import tables
from vitalgrid.sources.readers import scan_studies


def store_keys(repeated: DataFrame, store: str, run_id: str) -> tuple[DataFrame, str]:
    """The complete table of a run's repeated keys, stored and read back, and its place."""
    path = f"{store}/duplicate_keys/run_id={run_id}"
    repeated.write.mode("overwrite").parquet(path)
    return repeated.sparkSession.read.schema(repeated.schema).parquet(path), path


def stored_keys(spark: SparkSession, store: str) -> DataFrame:
    """Repeated keys of all runs, with their run_id."""
    return spark.read.schema(f"{domain.OBJECT_KEY} string, records long, run_id string").parquet(f"{store}/duplicate_keys")


def _status(rejected_count: Column) -> Column:
    return F.when(rejected_count > 0, domain.STATUS_WARNINGS).otherwise(domain.STATUS_COMPLETED)


def batch_counts(labels: Sequence[str] = domain.VALID_LABELS) -> list[Column]:
    """Aggregates over assessed rows: both totals, and accepted rows per label."""
    return [
        F.count_if("is_accepted").alias("processed_count"),
        F.count_if(~F.col("is_accepted")).alias("rejected_count"),
        *[
            F.count_if(F.col("is_accepted") & (F.col("label") == label)).alias(f"label_{i}")
            for i, label in enumerate(labels)
        ],
    ]


def _distribution(labels: Sequence[str]) -> Column:
    entries = F.array(*[F.struct(F.lit(l).alias("key"), F.col(f"label_{i}").alias("value")) for i, l in enumerate(labels)])
    return F.map_from_entries(F.filter(entries, lambda e: e["value"] > 0))


def compose_report(
    counts: DataFrame,
    duplicates: DataFrame,
    duplicates_uri: str,
    samples: DataFrame,
    *,
    run_id: str,
    created_at: Column,
    finished_at: Column,
    input_uri: str,
    output_uri: str,
    required: Sequence[str] = domain.REQUIRED_COLUMNS,
    labels: Sequence[str] = domain.VALID_LABELS,
) -> DataFrame:
    """One report row from the one row of ``counts``.

    ``samples`` is a bounded sample of rejected rows. The repeated keys are a table of their
    own, whatever their number; the report says how many there are and where.
    """
    sample = samples.agg(F.sort_array(F.collect_list(F.struct(*samples.columns))).alias("rows"))
    base = counts.withColumns(
        {
            "duplicate_key_count": duplicates.agg(F.count(F.lit(1))).scalar(),
            "rejected_samples": sample.scalar(),
        }
    )
    return base.select(
        F.lit(run_id).alias("run_id"),
        iso_time(created_at).alias("created_at"),
        iso_time(finished_at).alias("finished_at"),
        _status(F.col("rejected_count")).alias("status"),
        F.lit(input_uri).alias("input_uri"),
        F.lit(output_uri).alias("output_uri"),
        F.col("processed_count").cast("long").alias("processed_count"),
        F.col("rejected_count").cast("long").alias("rejected_count"),
        F.struct(
            literals(required).alias("required_columns"),
            literals(labels).alias("valid_labels"),
            F.lit(duplicates_uri).alias("duplicate_object_keys_uri"),
            F.col("duplicate_key_count"),
            _distribution(labels).alias("class_distribution"),
            F.col("rejected_samples"),
        ).alias("metadata"),
    )


def run_report(
    normalized: DataFrame, store: str, *, run_id: str, key: str = domain.OBJECT_KEY, labels: Sequence[str] = domain.VALID_LABELS, **details
) -> DataFrame:
    """Report of a normalised batch, without running the whole job.

    The batch is read for its keys, then once more to be assessed; counts and samples come
    from the stored assessment.
    """
    repeated, path = store_keys(quality.duplicate_keys(normalized, key), store, run_id)
    assessed = materialize(quality.judge(quality.flag_duplicates(normalized, key, repeated), labels=labels), "assessed")
    samples = quality.rejected_samples(assessed)
    return compose_report(assessed.agg(*batch_counts(labels)), repeated, path, samples, run_id=run_id, labels=labels, **details)


def failure_report(
    spark: SparkSession, *, run_id: str, created_at: Column, finished_at: Column, input_uri: str, output_uri: str, error: str
) -> DataFrame:
    return spark.range(1).select(
        F.lit(run_id).alias("run_id"),
        iso_time(created_at).alias("created_at"),
        iso_time(finished_at).alias("finished_at"),
        F.lit(domain.STATUS_FAILED).alias("status"),
        F.lit(input_uri).alias("input_uri"),
        F.lit(output_uri).alias("output_uri"),
        F.lit(0).cast("long").alias("processed_count"),
        F.lit(0).cast("long").alias("rejected_count"),
        F.struct(F.lit(error).alias("error")).alias("metadata"),
    )


def run_rows(report: DataFrame, bucket: str) -> DataFrame:
    """Rows of the run table for reports."""
    return report.select(
        F.col("run_id").alias("id"),
        F.to_timestamp("created_at").alias("created_at"),
        F.to_timestamp("finished_at").alias("finished_at"),
        "status",
        "input_uri",
        "processed_count",
        "rejected_count",
        F.lit(bucket).alias("report_bucket"),
        report_key("pipeline", F.col("run_id")).alias("report_object_key"),
        document(F.col("metadata")).alias("metadata"),
    )


def run_quality_events(runs: DataFrame) -> DataFrame:
    """Events of runs: a medium one for rejected rows, a high one for a failed run."""
    failed = F.col("status") == domain.STATUS_FAILED
    run_id = F.col("run_id").cast("string")
    event_type = F.when(failed, "pipeline_failure").otherwise("data_quality_rejections")
    details = ["run_id", *(["input_uri"] if "input_uri" in runs.columns else []), "rejected_count", "processed_count"]
    return runs.filter(failed | (F.col("rejected_count") > 0)).select(
        derived_id(run_id, event_type).alias("event_id"),
        "created_at",
        F.lit("pipeline").alias("source"),
        F.when(failed, "high").otherwise("medium").alias("severity"),
        event_type.alias("event_type"),
        F.when(failed, domain.EVENT_RUN_FAILED).otherwise(domain.EVENT_REJECTIONS).alias("message"),
        document(F.struct(*details)).alias("metadata"),
        F.lit(False).alias("resolved"),
    )


def store_outcome(assessed: DataFrame, output_uri: str, labels: Sequence[str] = domain.VALID_LABELS) -> dict:
    """Write ``outcome=accepted`` and ``outcome=rejected`` JSON folders in one pass.

    The counts are observed on the way into the writer, so the batch is not read again.
    """
    seen = Observation()
    columns = [c for c in assessed.columns if c not in ("is_duplicate", "is_accepted", "reject_reasons")]
    (
        assessed.observe(seen, *batch_counts(labels))
        .select(*columns, F.when(F.col("is_accepted"), "accepted").otherwise("rejected").alias("outcome"))
        .write.mode("overwrite")
        .partitionBy("outcome")
        .json(output_uri)
    )
    return seen.get


def run_study_job(
    spark: SparkSession,
    input_uri: str,
    output_uri: str,
    store: str,
    *,
    bucket: str = "clinical-reports",
    run_id: str | None = None,
) -> DataFrame:
    """The whole job. Returns the report row; a failing run is recorded and re-raised.

    The batch is read twice: the key column for the repeated keys, then every column
    for the outcome.
    """
    run_id = run_id or str(uuid.uuid4())
    details = {"run_id": run_id, "input_uri": input_uri, "output_uri": output_uri}
    details["created_at"] = F.lit(datetime.now(timezone.utc))
    try:
        batch = quality.normalize(scan_studies(spark, input_uri))
        repeated, path = store_keys(quality.duplicate_keys(batch), store, run_id)
        assessed = quality.judge(quality.flag_duplicates(batch, repeated=repeated))
        counts = store_outcome(assessed, output_uri)
        lost = stored_outcome(spark, output_uri, "rejected")
        report = compose_report(
            spark.range(1).select(*[F.lit(n).alias(name) for name, n in counts.items()]),
            repeated,
            path,
            lost.orderBy(*lost.columns).limit(domain.REJECTED_SAMPLE_ROWS),
            finished_at=F.lit(datetime.now(timezone.utc)),
            **details,
        )
        return record_run(report, store, bucket, run_id)
    except Exception as error:
        finished_at = F.lit(datetime.now(timezone.utc))
        report = failure_report(spark, finished_at=finished_at, error=str(error), **details)
        record_run(report, store, bucket, run_id)
        raise


def stored_outcome(spark: SparkSession, output_uri: str, outcome: str) -> DataFrame:
    """Accepted or rejected rows of a finished run (only that folder is read)."""
    schema = T.StructType([*STUDY_BATCH.fields, T.StructField("outcome", T.StringType())])
    rows = spark.read.schema(schema).json(output_uri)
    return rows.filter(F.col("outcome") == outcome).drop("outcome")


def record_run(report: DataFrame, store: str, bucket: str, run_id: str) -> DataFrame:
    """Store the report document, its run row and its event. Repeating it changes nothing."""
    report = materialize(report, "run-report")
    documents = report.select(
        report_key("pipeline", F.col("run_id")).alias("report_object_key"),
        document(F.struct(*report.columns)).alias("document"),
        F.lit("pipeline").alias("kind"),
    )
    tables.write_documents(documents, store, run_id)
    tables.append(run_rows(report, bucket), store, "pipeline_runs", run_id)
    events = run_quality_events(report.withColumn("created_at", F.to_timestamp("created_at")))
    tables.append(events.withColumnRenamed("event_id", "id"), store, "quality_events", run_id)
    return report
