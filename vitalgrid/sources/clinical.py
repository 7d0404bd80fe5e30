"""Clinical inputs read off the benchmark tables.

Each function maps whole tables of ``sf_dir`` to the shape an operator takes. All of
them are row-local projections, apart from ``epochs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalgrid import domain
from vitalgrid.functions.arrays import present
from vitalgrid.session import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def studies_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr(
        "concat('XR-', CAST(doc_id AS STRING)) AS study_id",
        "CAST(n_chars % 100 AS STRING) AS patient_age",
        "CASE WHEN doc_id % 53 = 0 THEN '  ' WHEN doc_id % 2 = 0 THEN 'F' ELSE 'M' END AS patient_sex",
        "CASE WHEN doc_id % 41 <> 0 THEN concat('uploads/', md5(text), '.png') END AS image_object_key",
        "CASE lang WHEN 'en' THEN 'Sana' WHEN 'fr' THEN 'Neumonia' WHEN 'de' THEN ' COVID-19 ' "
        "ELSE 'Tuberculosis' END AS label",
        "concat('2026-0', CAST(1 + doc_id % 9 AS STRING), '-1', CAST(doc_id % 10 AS STRING)) AS acquisition_date",
        "source",
    )


def _prediction_columns(events: DataFrame) -> DataFrame:
    return events.selectExpr(
        "concat('S-', CAST(event_id AS STRING)) AS study_id",
        "ts AS created_at",
        "concat('scan_', CAST(event_id AS STRING), CASE event_id % 5 WHEN 0 THEN '.jpg' WHEN 1 THEN '.JPEG' "
        "WHEN 2 THEN '.png' WHEN 3 THEN '.gif' ELSE '' END) AS original_filename",
        "(event_id * 7919) % 6000000 AS file_size_bytes",
        "CASE event_type WHEN 'purchase' THEN 'COVID-19' WHEN 'click' THEN 'Neumonia' "
        "WHEN 'error' THEN 'Neumonia' ELSE 'Sana' END AS prediction_class",
        "1.0D / (1.0D + value / 100.0D) AS confidence",
        "value AS mean_intensity",
        "CAST(get_json_object(props, '$.k') AS DOUBLE) AS contrast",
        "concat('radiology-reports/S-', CAST(event_id AS STRING), '.json') AS report_object_key",
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prediction_columns(table(spark, sf_dir, "events"))


def prediction_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``predictions`` as files of the events table arrive."""
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(sf_dir)
    return _prediction_columns(stream)


def _triage_columns(lineitem: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    flat = lineitem.selectExpr(
        "concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING), '-', "
        "CAST(l_partkey AS STRING), '-', CAST(l_suppkey AS STRING)) AS triage_id",
        "l_shipdate AS created_at",
        "l_partkey AS ref_id",
        "CAST(l_orderkey % 98 AS STRING) AS age",
        "CASE WHEN l_partkey % 97 = 0 THEN 'abc' WHEN l_partkey % 89 = 0 THEN '' "
        "ELSE CAST(40 + 2 * CAST(l_quantity AS INT) AS STRING) END AS heart_rate",
        "CAST(CAST(round(100 - 200 * l_discount) AS INT) AS STRING) AS oxygen_saturation",
        "CAST(60 + l_partkey % 160 AS STRING) AS systolic_bp",
        "CAST(6 + l_suppkey % 30 AS STRING) AS respiratory_rate",
        "concat(CAST(34 + CAST(round(l_tax * 100) AS INT) AS STRING), "
        "CASE WHEN l_linenumber % 2 = 0 THEN ',5' ELSE '.2' END) AS temperature",
        "((l_orderkey * 31 + l_linenumber) % 1024) & (l_partkey % 1024) AS symptom_mask",
        *also,
    )
    chosen = [
        F.when(F.col("symptom_mask").bitwiseAND(1 << bit) != 0, name)
        for bit, name in enumerate(domain.SYMPTOMS)
    ]
    return flat.select(
        "triage_id",
        "created_at",
        "ref_id",
        F.concat(F.lit("Paciente "), "triage_id").alias("patient_name"),
        present(*chosen).alias("symptoms"),
        F.struct(*domain.VITALS).alias("vitals"),
        *also,
    )


def triage_requests(spark: SparkSession, sf_dir: str, over_cores: int = 0) -> DataFrame:
    """Requests with text vitals (struct) and their symptoms (array).

    ``over_cores`` is for long work on each row: where the scan has fewer tasks than so many for each
    core, its narrow rows are dealt out before anything is derived. A larger table stays put.
    """
    rows = table(spark, sf_dir, "lineitem")
    return _triage_columns(spread(rows, "l_orderkey", over_cores) if over_cores else rows)


def scored_triage_requests(spark: SparkSession, sf_dir: str, scores: DataFrame) -> DataFrame:
    """Requests dealt over the cores, with the ``probabilities`` that ``scores`` has for their ``ref_id``.

    Joined while the rows are a few numbers: a request with its texts is several times as wide, and a
    join with scores too large to broadcast moves all of them.
    """
    rows = spread(table(spark, sf_dir, "lineitem"), "l_orderkey")
    keyed = scores.select(F.col("vec_id").alias("_key"), "probabilities")
    return _triage_columns(rows.join(keyed, F.col("l_partkey") == F.col("_key"), "left"), ("probabilities",))


def triage_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "lineitem").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "lineitem*.parquet").parquet(sf_dir)
    return _triage_columns(stream)


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Radiology logits (first three) and triage logits (first four) per vector."""
    vector = F.col("embedding").cast("array<double>")
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.slice(vector, 1, 3).alias("logits"), F.slice(vector, 1, 4).alias("risk_logits")
    )


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("pixels")
    )


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Append-only versions: every event opens, every third one is resolved later."""
    return _event_versions(table(spark, sf_dir, "events"))


def event_log_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(sf_dir)
    return _event_versions(stream)


def _event_versions(events: DataFrame) -> DataFrame:
    versions = F.when(F.col("event_id") % 3 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return events.select(
        "event_id",
        F.explode(versions).alias("version"),
        F.col("ts").alias("created_at"),
        F.lit("radiology").alias("source"),
        F.when(F.col("event_type").isin("error", "purchase"), "high").otherwise("medium").alias("severity"),
        "event_type",
    ).withColumn("resolved", F.col("version") == 1)


def quality_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.col("ts").alias("created_at"),
        F.lit("radiology").alias("source"),
        F.when(F.col("event_type").isin("error", "purchase"), "high").otherwise("medium").alias("severity"),
        "event_type",
        (F.col("event_id") % 3 == 0).alias("resolved"),
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS run_id",
        "o_orderdate AS created_at",
        "CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'completed_with_warnings' "
        "ELSE 'failed' END AS status",
        "CASE o_orderstatus WHEN 'P' THEN 0L ELSE o_custkey % 1000 END AS processed_count",
        "CASE o_orderstatus WHEN 'O' THEN 1L + o_custkey % 7 ELSE 0L END AS rejected_count",
    )


def labelled_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predictions(spark, sf_dir).select(
        "study_id",
        F.col("prediction_class").alias("label"),
        F.when(F.col("file_size_bytes") % 5 == 0, "test").otherwise("train").alias("folder_split"),
    )


def epoch_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training batches: one per (day, user), losses in whole cents."""
    return (
        table(spark, sf_dir, "events")
        .groupBy(F.dayofmonth("ts").alias("epoch"), F.col("user_id").alias("batch_id"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.round(F.col("value") * 100).cast("long")).alias("loss_cents"),
            F.count_if(F.col("event_type").isin("view", "click", "signup")).alias("correct"),
        )
    )


def image_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr(
        "concat(CASE WHEN doc_id % 4 = 0 THEN 'test' ELSE 'train' END, '/', "
        "CASE lang WHEN 'en' THEN 'NORMAL' WHEN 'fr' THEN 'PNEUMONIA' WHEN 'de' THEN 'COVID19' ELSE 'OTHER' END, '/', "
        "CAST(doc_id AS STRING), CASE doc_id % 5 WHEN 0 THEN '.png' WHEN 1 THEN '.jpg' WHEN 2 THEN '.JPEG' "
        "WHEN 3 THEN '.gif' ELSE '' END) AS path",
        "CASE WHEN doc_id % 11 = 7 THEN concat(unhex('474946383961'), CAST(text AS BINARY)) "
        "WHEN doc_id % 11 = 8 THEN concat(unhex('49492A00'), CAST(text AS BINARY)) "
        "WHEN doc_id % 11 = 9 THEN concat(unhex('524946460A00000057454250'), CAST(text AS BINARY)) "
        "WHEN doc_id % 11 = 10 THEN concat(unhex('424D0A00000000000000'), CAST(text AS BINARY)) "
        "WHEN doc_id % 3 = 0 THEN concat(unhex('89504E470D0A1A0A'), CAST(text AS BINARY)) "
        "WHEN doc_id % 3 = 1 THEN concat(unhex('FFD8FF'), CAST(text AS BINARY)) ELSE CAST(text AS BINARY) END AS content",
    )
