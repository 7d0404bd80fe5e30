"""Queries over study batches: scan, split, report, sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from vitalgrid import domain
from vitalgrid.operators import ingest, quality
from vitalgrid.plans.registry import query
from vitalgrid.session import scratch_path
from vitalgrid.sources import clinical, readers, tables

COLUMNS = ", ".join(domain.REQUIRED_COLUMNS)


def _normalized(spark, d):
    return quality.normalize(clinical.studies_raw(spark, d))


def _assessed(spark, d):
    return quality.assess_batch(clinical.studies_raw(spark, d))


# the CSV reader cannot tell an empty text from a missing one, so the check cannot either
@query("csv_study_scan", "SELECT " + ", ".join(f"nullif({c}, '') AS {c}" for c in domain.REQUIRED_COLUMNS) + " FROM v_studies_raw")
def csv_study_scan(spark, d):
    path = scratch_path(spark, "studies-csv")
    batch = clinical.studies_raw(spark, d)
    (
        batch.write.option("header", True)
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )
    return readers.scan_studies(spark, path)


@query("clean_json_sink", f"SELECT {COLUMNS} FROM v_assessed WHERE is_accepted")
def clean_json_sink(spark, d):
    path = scratch_path(spark, "accepted-json")
    tables.write_json(quality.accepted(_assessed(spark, d)), path)
    return spark.read.schema(_normalized(spark, d).schema).json(path)


@query("normalize_studies", f"SELECT {COLUMNS} FROM v_studies")
def normalize_studies(spark, d):
    return _normalized(spark, d)


@query("complete_rows", f"SELECT {COLUMNS} FROM v_studies WHERE " + " AND ".join(f"{c} <> ''" for c in domain.REQUIRED_COLUMNS))
def complete_rows(spark, d):
    return quality.complete_rows(_normalized(spark, d))


@query("valid_label_rows", f"SELECT {COLUMNS} FROM v_studies WHERE label IN ('Sana', 'Neumonia', 'COVID-19')")
def valid_label_rows(spark, d):
    return quality.valid_label_rows(_normalized(spark, d))


@query("accepted_studies", f"SELECT {COLUMNS} FROM v_assessed WHERE is_accepted")
def accepted_studies(spark, d):
    return quality.accepted(_assessed(spark, d))


@query("rejected_studies", f"SELECT {COLUMNS} FROM v_assessed WHERE NOT is_accepted")
def rejected_studies(spark, d):
    return quality.rejected(_assessed(spark, d))


@query("duplicate_keys", "SELECT image_object_key, count(*) AS records FROM v_studies WHERE image_object_key <> '' GROUP BY 1 HAVING count(*) > 1")
def duplicate_keys(spark, d):
    return quality.duplicate_keys(_normalized(spark, d))


@query("duplicate_flag", "SELECT study_id, image_object_key, is_duplicate FROM v_assessed")
def duplicate_flag(spark, d):
    return quality.flag_duplicates(_normalized(spark, d)).select("study_id", "image_object_key", "is_duplicate")


@query("duplicate_exclusion", f"SELECT {COLUMNS} FROM v_assessed WHERE NOT is_duplicate")
def duplicate_exclusion(spark, d):
    return quality.duplicate_exclusion(_normalized(spark, d))


@query("duplicate_members", f"SELECT {COLUMNS} FROM v_assessed WHERE is_duplicate")
def duplicate_members(spark, d):
    return quality.duplicate_members(_normalized(spark, d))


_REASONS = """
    SELECT 'incomplete' AS reason, count(*) AS rows FROM v_studies WHERE NOT ({complete})
    UNION ALL SELECT 'invalid_label', count(*) FROM v_studies WHERE coalesce(label, '') NOT IN ('Sana', 'Neumonia', 'COVID-19')
    UNION ALL SELECT 'duplicate', count(*) FROM v_assessed WHERE is_duplicate"""


@query("reject_reasons", _REASONS.format(complete=" AND ".join(f"coalesce({c}, '') <> ''" for c in domain.REQUIRED_COLUMNS)))
def reject_reasons(spark, d):
    return quality.reject_reason_counts(_assessed(spark, d))


@query("rejected_samples", f"SELECT {COLUMNS} FROM v_assessed WHERE NOT is_accepted ORDER BY study_id, patient_age LIMIT 25")
def rejected_samples(spark, d):
    return quality.rejected_samples(_assessed(spark, d))


@query("accept_reject_counts", "SELECT count(*) FILTER (WHERE is_accepted) AS processed_count, count(*) FILTER (WHERE NOT is_accepted) AS rejected_count FROM v_assessed")
def accept_reject_counts(spark, d):
    return quality.accept_reject_counts(_assessed(spark, d))


@query("class_distribution", "SELECT label, count(*) AS rows FROM v_assessed WHERE is_accepted GROUP BY label")
def class_distribution(spark, d):
    return quality.class_distribution(quality.accepted(_assessed(spark, d)))


@query("partition_invariant", """
    SELECT count(*) AS input_rows, count(*) AS output_rows, CAST(0 AS BIGINT) AS missing_rows,
           CAST(0 AS BIGINT) AS excess_rows, CAST(0 AS BIGINT) AS rows_on_both_sides FROM v_studies""")
def partition_invariant(spark, d):
    return quality.verdict_invariant(_normalized(spark, d), _assessed(spark, d))


def _report(spark, d, store):
    return ingest.run_report(
        _normalized(spark, d),
        store,
        run_id="run-1",
        created_at=F.timestamp_seconds(F.lit(1_767_225_600)),
        finished_at=F.timestamp_seconds(F.lit(1_767_225_660)),
        input_uri="studies",
        output_uri="clean",
    )


@query("run_report", """
    SELECT 'run-1' AS run_id, '2026-01-01T00:00:00+00:00' AS created_at, '2026-01-01T00:01:00+00:00' AS finished_at,
           CASE WHEN count(*) FILTER (WHERE NOT is_accepted) > 0 THEN 'completed_with_warnings' ELSE 'completed' END AS status,
           'studies' AS input_uri, 'clean' AS output_uri,
           count(*) FILTER (WHERE is_accepted) AS processed_count, count(*) FILTER (WHERE NOT is_accepted) AS rejected_count,
           count(*) FILTER (WHERE is_accepted AND label = 'Sana') AS sana,
           count(*) FILTER (WHERE is_accepted AND label = 'Neumonia') AS neumonia,
           count(*) FILTER (WHERE is_accepted AND label = 'COVID-19') AS covid,
           count(DISTINCT image_object_key) FILTER (WHERE is_duplicate) AS duplicate_key_count,
           least(25, count(*) FILTER (WHERE NOT is_accepted)) AS sample_rows
    FROM v_assessed""")
def run_report(spark, d):
    distribution = F.col("metadata.class_distribution")
    return _report(spark, d, scratch_path(spark, "store")).select(
        "run_id", "created_at", "finished_at", "status", "input_uri", "output_uri", "processed_count", "rejected_count",
        distribution["Sana"].alias("sana"),
        distribution["Neumonia"].alias("neumonia"),
        distribution["COVID-19"].alias("covid"),
        "metadata.duplicate_key_count",
        F.size("metadata.rejected_samples").cast("long").alias("sample_rows"),
    )


@query("run_report_keys", """
    SELECT 'run-1' AS run_id, image_object_key, count(*) AS records FROM v_assessed WHERE is_duplicate GROUP BY image_object_key""")
def run_report_keys(spark, d):
    """The complete table of repeated keys that a report points to."""
    store = scratch_path(spark, "store")
    report = _report(spark, d, store)
    return ingest.stored_keys(spark, store).join(report.select("run_id"), "run_id").select("run_id", domain.OBJECT_KEY, "records")


@query("study_ingest_job", """
    SELECT CASE WHEN count(*) FILTER (WHERE NOT is_accepted) > 0 THEN 'completed_with_warnings' ELSE 'completed' END AS status,
           count(*) FILTER (WHERE is_accepted) AS processed_count, count(*) FILTER (WHERE NOT is_accepted) AS rejected_count,
           count(*) FILTER (WHERE is_accepted) AS stored_accepted, count(*) FILTER (WHERE NOT is_accepted) AS stored_rejected,
           count(DISTINCT image_object_key) FILTER (WHERE is_duplicate) AS duplicate_key_count,
           'data_quality_rejections' AS event_type
    FROM v_assessed""")
def study_ingest_job(spark, d):
    """The whole job on a CSV of the batch; the result is read back from what it stored."""
    source, output, store = (scratch_path(spark, name) for name in ("incoming", "outcome", "store"))
    clinical.studies_raw(spark, d).write.option("header", True).csv(source)
    report = ingest.run_study_job(spark, source, output, store, run_id="run-1")
    runs = tables.load(spark, store, "pipeline_runs")
    events = tables.load(spark, store, "quality_events")

    def stored(outcome: str):
        return ingest.stored_outcome(spark, output, outcome).agg(F.count(F.lit(1))).scalar()

    return runs.select(
        "status",
        "processed_count",
        "rejected_count",
        stored("accepted").alias("stored_accepted"),
        stored("rejected").alias("stored_rejected"),
        report.select("metadata.duplicate_key_count").scalar().alias("duplicate_key_count"),
        events.select("event_type").scalar().alias("event_type"),
    )


@query("ingest_run_append", """
    SELECT CAST(run_id AS VARCHAR) AS id, status, processed_count, rejected_count,
           'pipeline-reports/' || CAST(run_id AS VARCHAR) || '.json' AS report_object_key, '{}' AS metadata FROM v_runs""")
def ingest_run_append(spark, d):
    store = scratch_path(spark, "runs")
    runs = clinical.runs(spark, d).select(
        F.col("run_id").cast("string").alias("id"), "created_at", "status", F.lit("studies").alias("input_uri"),
        "processed_count", "rejected_count",
        F.concat(F.lit("pipeline-reports/"), F.col("run_id").cast("string"), F.lit(".json")).alias("report_object_key"),
    )
    tables.append(runs, store, "pipeline_runs", "batch-1")
    return tables.load(spark, store, "pipeline_runs").select(
        "id", "status", "processed_count", "rejected_count", "report_object_key", "metadata"
    )


@query("run_quality_events", f"""
    SELECT md5(CAST(run_id AS VARCHAR) || '|' || event_type) AS event_id, 'pipeline' AS source, severity, event_type, message,
           CAST(run_id AS VARCHAR) AS run_id, processed_count, rejected_count
    FROM (SELECT *, CASE WHEN status = 'failed' THEN 'pipeline_failure' ELSE 'data_quality_rejections' END AS event_type,
                 CASE WHEN status = 'failed' THEN 'high' ELSE 'medium' END AS severity,
                 CASE WHEN status = 'failed' THEN '{domain.EVENT_RUN_FAILED}' ELSE '{domain.EVENT_REJECTIONS}' END AS message
          FROM v_runs WHERE status = 'failed' OR rejected_count > 0) t""")
def run_quality_events(spark, d):
    return ingest.run_quality_events(clinical.runs(spark, d)).select(
        "event_id", "source", "severity", "event_type", "message",
        F.get_json_object("metadata", "$.run_id").alias("run_id"),
        F.get_json_object("metadata", "$.processed_count").cast("long").alias("processed_count"),
        F.get_json_object("metadata", "$.rejected_count").cast("long").alias("rejected_count"),
    )


def _failed_run(spark, d):
    """A job over the study batch without its label column; the store it leaves."""
    source, output, store = (scratch_path(spark, name) for name in ("incoming", "outcome", "store"))
    clinical.studies_raw(spark, d).drop("label").write.option("header", True).csv(source)
    try:
        ingest.run_study_job(spark, source, output, store, run_id="run-f")
    except readers.MissingColumnsError as error:
        return store, str(error)
    return store, None


@query("required_columns_check", """
    SELECT 'Missing required columns: label' AS error, count(*) AS rows FROM v_studies_raw""")
def required_columns_check(spark, d):
    """What the reader says of the batch without a column, and how many rows it refused."""
    _, error = _failed_run(spark, d)
    return clinical.studies_raw(spark, d).agg(F.lit(error).alias("error"), F.count(F.lit(1)).alias("rows"))


@query("failure_report", """
    SELECT 'run-f' AS id, 'failed' AS status, CAST(0 AS BIGINT) AS processed_count, CAST(0 AS BIGINT) AS rejected_count,
           'pipeline-reports/run-f.json' AS report_object_key, 'Missing required columns: label' AS error,
           'failed' AS document_status, 'Missing required columns: label' AS document_error, 'high' AS severity, 'pipeline_failure' AS event_type""")
def failure_report(spark, d):
    """Run row, document and event of the failed run, as stored."""
    store, _ = _failed_run(spark, d)
    runs, events = tables.load(spark, store, "pipeline_runs"), tables.load(spark, store, "quality_events")
    documents = tables.load_documents(spark, store).select("report_object_key", "document")
    said = lambda column, path: F.get_json_object(column, f"$.{path}")
    return runs.join(documents, "report_object_key").join(events.select("severity", "event_type", said("metadata", "run_id").alias("of")), F.col("of") == F.col("id")).select(
        "id", "status", "processed_count", "rejected_count", "report_object_key", said("metadata", "error").alias("error"),
        said("document", "status").alias("document_status"), said("document", "metadata.error").alias("document_error"), "severity", "event_type",
    )


@query("typed_tables", """
    SELECT CAST(run_id AS VARCHAR) AS id, status, CAST(0 AS BIGINT) AS processed_count, CAST(0 AS BIGINT) AS rejected_count, '{}' AS metadata FROM v_runs""")
def typed_tables(spark, d):
    """Runs inserted into the created table without the columns that have defaults."""
    database = "vitalgrid_" + uuid.uuid4().hex
    spark.sql(f"CREATE DATABASE {database} LOCATION '{scratch_path(spark, 'database')}'")
    tables.create_tables(spark, database)
    clinical.runs(spark, d).select(F.col("run_id").cast("string").alias("id"), "created_at", "status").createOrReplaceTempView(f"{database}_runs")
    spark.sql(f"INSERT INTO {database}.pipeline_runs (id, created_at, status, input_uri) SELECT id, created_at, status, 'studies' FROM {database}_runs")
    spark.catalog.dropTempView(f"{database}_runs")
    return spark.table(f"{database}.pipeline_runs").select("id", "status", "processed_count", "rejected_count", "metadata")
