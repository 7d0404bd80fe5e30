from __future__ import annotations

import json

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from vitalgrid import domain
from vitalgrid.operators import ingest, quality, triage
from vitalgrid.plans import radiology as radiology_plans
from vitalgrid.plans import triage as triage_plans
from vitalgrid.schemas import STUDY_BATCH
from vitalgrid.sources import readers, registered, tables
from vitalgrid.streaming import flows

ROWS = [
    ("X1", "34", "F", "uploads/h1.png", "Sana"),
    ("X2", "71", "M", "uploads/p1.png", "Neumonia"),
    ("X3", "58", "F", "uploads/c1.png", "COVID-19"),
    ("X4", "45", "M", "uploads/c2.png", "COVID-19"),
    ("X5", "62", "F", "uploads/p2.png", "Neumonia"),
    ("X6", "29", "F", "uploads/h2.png", "Sana"),
    ("X7", "53", "M", "uploads/twice.png", "Sana"),
    ("X8", "53", "M", "uploads/twice.png", "Neumonia"),
    ("X9", "40", "F", None, "Sana"),
    ("X10", "68", "M", "uploads/u1.png", "Tuberculosis"),
]


def batch(spark, rows=ROWS):
    return spark.createDataFrame([(*r, "2026-04-01", "site") for r in rows], ", ".join(f"{c} string" for c in domain.REQUIRED_COLUMNS))


def csv(spark, tmp_path, rows=ROWS, name="in"):
    path = str(tmp_path / name)
    batch(spark, rows).coalesce(1).write.option("header", True).csv(path)
    return path


def test_split_of_the_golden_batch(spark):
    assessed = quality.assess_batch(batch(spark))
    assert {r.study_id for r in quality.accepted(assessed).collect()} == {f"X{i}" for i in range(1, 7)}
    reasons = {r.study_id: r.reject_reasons for r in assessed.filter("NOT is_accepted").collect()}
    assert reasons == {"X7": ["duplicate"], "X8": ["duplicate"], "X9": ["incomplete"], "X10": ["invalid_label"]}
    assert dict(quality.class_distribution(quality.accepted(assessed)).collect()) == {"Sana": 2, "Neumonia": 2, "COVID-19": 2}


def test_blank_keys_never_count_as_duplicates(spark):
    rows = [("A", "1", "F", " ", "Sana"), ("B", "1", "F", " ", "Sana"), ("C", "1", "F", None, "Sana")]
    flagged = quality.flag_duplicates(quality.normalize(batch(spark, rows)))
    assert flagged.filter("is_duplicate").count() == 0


def test_hot_keys_take_the_same_result_through_the_join(spark, monkeypatch):
    """A third of the rows share one key, others are blank; both routes agree with a plain count."""
    df = spark.range(30_000).select(
        F.col("id").cast("string").alias("study_id"),
        F.when(F.col("id") % 3 == 0, "hot")
        .when(F.col("id") % 7 == 0, "")
        .when(F.col("id") % 11 == 0, F.lit(None))
        .otherwise(F.concat(F.lit("k"), (F.col("id") % 9000).cast("string")))
        .alias("image_object_key"),
    )
    few = quality.flag_duplicates(df)
    monkeypatch.setattr(quality, "BROADCAST_KEYS", 0)
    monkeypatch.setattr(quality, "HOT_KEYS", 5)
    many = quality.flag_duplicates(df)
    counts = {r.image_object_key: r["count"] for r in df.groupBy("image_object_key").count().collect()}
    expected = {
        r.study_id: bool(r.image_object_key) and counts[r.image_object_key] > 1 for r in df.collect()
    }
    for result in (few, many):
        rows = result.collect()
        assert len(rows) == 30_000
        assert {r.study_id: r.is_duplicate for r in rows} == expected


def test_hot_rows_are_spread_over_the_join(spark, monkeypatch):
    monkeypatch.setattr(quality, "BROADCAST_KEYS", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(0, 8000, 1, 8).select(F.lit("hot").alias("image_object_key"), "id")
        flagged = quality.flag_duplicates(df)
        sizes = flagged.groupBy(F.spark_partition_id()).count().collect()
        assert flagged.filter("is_duplicate").count() == 8000
        assert len(sizes) > 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_partition_invariant_sees_broken_splits(spark):
    rows = quality.normalize(batch(spark))
    good = rows.filter("label = 'Sana'")
    rest = rows.filter("label <> 'Sana'")
    assert quality.partition_invariant(rows, good, rest).first()[2:] == (0, 0, 0)
    assert quality.partition_invariant(rows, good, rest.limit(2)).first().missing_rows == rest.count() - 2
    assert quality.partition_invariant(rows, rows, rest).first().rows_on_both_sides == rest.count()


def test_missing_columns_are_named_in_order(spark, tmp_path):
    path = str(tmp_path / "bad")
    batch(spark).drop("label", "patient_age").write.option("header", True).csv(path)
    with pytest.raises(readers.MissingColumnsError, match="Missing required columns: patient_age, label"):
        readers.scan_studies(spark, path)


def test_job_stores_outcome_report_run_and_event(spark, tmp_path):
    store, output = str(tmp_path / "store"), str(tmp_path / "out")
    report = ingest.run_study_job(spark, csv(spark, tmp_path), output, store, run_id="r1").first()
    assert (report.status, report.processed_count, report.rejected_count) == ("completed_with_warnings", 6, 4)
    keys = spark.read.parquet(report.metadata.duplicate_object_keys_uri).collect()
    assert [k.image_object_key for k in keys] == ["uploads/twice.png"]
    assert report.metadata.class_distribution == {"Sana": 2, "Neumonia": 2, "COVID-19": 2}
    assert {r.study_id for r in report.metadata.rejected_samples} == {"X7", "X8", "X9", "X10"}
    assert ingest.stored_outcome(spark, output, "accepted").count() == 6
    run = tables.load(spark, store, "pipeline_runs").first()
    assert (run.id, run.status, run.report_object_key) == ("r1", "completed_with_warnings", "pipeline-reports/r1.json")
    assert json.loads(run.metadata)["valid_labels"] == ["Sana", "Neumonia", "COVID-19"]
    event = tables.load(spark, store, "quality_events").first()
    assert (event.severity, event.event_type, event.resolved) == ("medium", "data_quality_rejections", False)
    document = tables.load_documents(spark, store).first()
    assert json.loads(document.document)["processed_count"] == 6
    ingest.run_study_job(spark, str(tmp_path / "in"), output, store, run_id="r1")
    assert tables.load(spark, store, "pipeline_runs").count() == 1


def test_clean_and_empty_batches_complete(spark, tmp_path):
    clean = ingest.run_study_job(spark, csv(spark, tmp_path, ROWS[:6]), str(tmp_path / "o1"), str(tmp_path / "s1"), run_id="a").first()
    assert (clean.status, clean.rejected_count) == ("completed", 0)
    (tmp_path / "empty.csv").write_text(",".join(domain.REQUIRED_COLUMNS) + "\n")
    empty = ingest.run_study_job(spark, str(tmp_path / "empty.csv"), str(tmp_path / "o2"), str(tmp_path / "s2"), run_id="b").first()
    assert (empty.status, empty.processed_count, empty.rejected_count) == ("completed", 0, 0)


def test_failing_job_is_recorded_and_raised(spark, tmp_path):
    (tmp_path / "bad.csv").write_text("study_id,label\nX1,Sana\n")
    store = str(tmp_path / "store")
    with pytest.raises(readers.MissingColumnsError):
        ingest.run_study_job(spark, str(tmp_path / "bad.csv"), str(tmp_path / "out"), store, run_id="f1")
    run = tables.load(spark, store, "pipeline_runs").first()
    assert run.status == "failed" and "Missing required columns" in json.loads(run.metadata)["error"]
    event = tables.load(spark, store, "quality_events").first()
    assert (event.severity, event.event_type) == ("high", "pipeline_failure")


def test_report_has_all_keys_whatever_their_number(spark, tmp_path):
    rows = spark.range(50_000).select(
        F.concat(F.lit("S"), "id").alias("study_id"), F.lit("1").alias("patient_age"), F.lit("F").alias("patient_sex"),
        F.concat(F.lit("k"), F.col("id") % 12_500).alias("image_object_key"), F.lit("Sana").alias("label"),
        F.lit("2026-04-01").alias("acquisition_date"), F.lit("site").alias("source"),
    )
    details = {"run_id": "r", "created_at": F.current_timestamp(), "finished_at": F.current_timestamp(), "input_uri": "i", "output_uri": "o"}
    report = ingest.run_report(quality.normalize(rows), str(tmp_path), **details).first()
    assert (report.metadata.duplicate_key_count, report.rejected_count, len(report.metadata.rejected_samples)) == (12_500, 50_000, 25)
    keys = spark.read.parquet(report.metadata.duplicate_object_keys_uri)
    assert {(r.image_object_key, r.records) for r in keys.collect()} == {(f"k{i}", 4) for i in range(12_500)}
    assert ingest.stored_keys(spark, str(tmp_path)).where("run_id = 'r'").count() == 12_500


def test_stream_keeps_first_arrivals(spark, tmp_path):
    source, output, store = (tmp_path / n for n in ("incoming", "out", "store"))
    source.mkdir()
    header = ",".join(domain.REQUIRED_COLUMNS)

    def arrive(name, rows):
        lines = [",".join([*(v or "" for v in r), "2026-04-01", "site"]) for r in rows]
        (source / name).write_text("\n".join([header, *lines]) + "\n")

    def drain():
        flows.stream_ingest(spark, str(source), str(output), str(store), str(tmp_path / "progress"), files_per_batch=1).awaitTermination()

    arrive("a.csv", ROWS)
    drain()
    arrive("b.csv", [("Y1", "5", "F", "uploads/h1.png", "Sana"), ("Y2", "5", "F", "uploads/new.png", "Sana")])
    drain()
    runs = {r.id: (r.processed_count, r.rejected_count) for r in tables.load(spark, str(store), "pipeline_runs").collect()}
    assert runs == {"stream-0": (6, 4), "stream-1": (1, 1)}
    assert {r.study_id for r in ingest.stored_outcome(spark, f"{output}/batch=1", "accepted").collect()} == {"Y2"}
    settled = {side: {r.study_id for r in flows.settled_outcome(spark, str(output), str(store), side).collect()} for side in ("accepted", "rejected")}
    whole = {r.study_id: r.is_accepted for r in quality.assess_batch(batch(spark, [*ROWS, ("Y1", "5", "F", "uploads/h1.png", "Sana"), ("Y2", "5", "F", "uploads/new.png", "Sana")])).collect()}
    assert settled == {"accepted": {i for i, good in whole.items() if good}, "rejected": {i for i, good in whole.items() if not good}}
    assert "X1" in settled["rejected"]


def test_open_counts_read_two_folders_however_many_batches(spark, tmp_path):
    """Nine micro-batches of openings, repeats and resolutions leave two folders of totals."""
    source, totals = tmp_path / "log", tmp_path / "totals"
    expected = {}
    for n in range(9):
        severity = "high" if n % 2 else "medium"
        rows = [(f"e{n}", severity, False), (f"e{n}", severity, False)] + ([(f"e{n - 2}", severity, True)] * 2 if n > 4 else [])
        expected[severity] = expected.get(severity, 0) + 1 - (n > 4)
        spark.createDataFrame(rows, "event_id string, severity string, resolved boolean").coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema("event_id string, severity string, resolved boolean").option("maxFilesPerTrigger", 1).parquet(str(source))
    flows.store_open_counts(stream, str(totals), str(tmp_path / "progress")).awaitTermination()
    assert {r.severity: r.events for r in flows.open_counts(spark, str(totals)).collect()} == expected
    assert sorted(p.name for p in totals.iterdir()) == ["slot=0", "slot=1"]


def test_a_micro_batch_reads_nothing_of_earlier_ones(spark, tmp_path):
    """The writer gets totals with its rows; a key that came before is repeated, though it is alone in the batch."""
    rows = [Row(row=Row(study_id="s1", patient_age="4", patient_sex="F", image_object_key=" k1 ", label="Sana", acquisition_date="d", source="x"), key=None, total=None)]
    schema = flows.with_key_totals(spark.createDataFrame([], STUDY_BATCH)).schema
    batch = spark.createDataFrame(rows + [Row(row=None, key="k1", total=3)], schema)
    flows.study_batch_writer(str(tmp_path / "out"), str(tmp_path / "store"))(batch, 7)
    assert [r.image_object_key for r in spark.read.parquet(str(tmp_path / "store" / "returned_keys")).collect()] == ["k1"]
    assert ingest.stored_outcome(spark, f"{tmp_path}/out/batch=7", "rejected").count() == 1


def test_registered_rows_are_rows_of_the_tables(spark, tmp_path):
    """What is registered with its parts is loaded like what is appended."""
    store = str(tmp_path / "store")
    d = "/root/testdata/sf0.001"
    studies = radiology_plans.records(spark, d).limit(50)
    registered.register_studies(studies, store, "b1")
    events = registered.load_events(spark, store).count()
    assert tables.load(spark, store, "radiology_studies").count() == 50 and tables.load(spark, store, "quality_events").count() == events > 0
    triages = triage_plans.assessed(spark, d).limit(20)
    registered.register_triages(triage.triage_records(triages, "b"), store, "b1")
    assert tables.load(spark, store, "triage_records").count() == 20 == registered.load_triages(spark, store).count()
