from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from vitalgrid import domain
from vitalgrid.operators import images, metrics, presentation, radiology, triage
from vitalgrid.sources import readers, registered, tables

REQUEST = "triage_id string, patient_name string, symptoms array<string>, vitals map<string,string>"


def assess(spark, symptoms=(), vitals=None):
    df = spark.createDataFrame([("t", "Test", list(symptoms), vitals or {})], REQUEST)
    return triage.rules_risk(df).first()


@pytest.mark.parametrize(
    "symptoms, vitals, score, risk, priority",
    [
        ([], {}, 0, "low", "standard"),
        (["chest pain"], {}, 43, "medium", "priority"),
        ([], {"oxygen_saturation": "88"}, 25, "medium", "priority"),
        ([], {"systolic_bp": "80"}, 20, "low", "standard"),
        ([], {"heart_rate": "130"}, 15, "low", "standard"),
        (["fever"] * 20, {}, 8, "low", "standard"),
        (["chest pain"], {"heart_rate": "130", "oxygen_saturation": "80"}, 83, "critical", "immediate"),
        (["fever", "cough", "fatigue", "headache"], {"heart_rate": "130"}, 47, "medium", "priority"),
        (["fever", "cough", "fatigue", "headache", "dizziness"], {"heart_rate": "130"}, 55, "high", "urgent"),
        ([], {"heart_rate": "abc", "oxygen_saturation": None}, 0, "low", "standard"),
        ([], {"heart_rate": "nan", "oxygen_saturation": "nan"}, 0, "low", "standard"),
        (["", ""], {}, 0, "low", "standard"),
        (["  "], {}, 8, "low", "standard"),
        ([" CHEST pain\t", "chest pain"], {}, 43, "medium", "priority"),
        (
            ["chest pain", "shortness of breath", "loss of consciousness", "fever", "cough", "vomiting"],
            {"heart_rate": "140", "oxygen_saturation": "80", "systolic_bp": "70"}, 100, "critical", "immediate",
        ),
    ],
)
def test_rules(spark, symptoms, vitals, score, risk, priority):
    row = assess(spark, symptoms, vitals)
    assert (row.score, row.risk_level, row.recommended_priority) == (score, risk, priority)
    assert row.confidence == round(min(0.99, 0.65 + score / 200), 2)


def news2(v):
    bands = {
        "respiratory_rate": [(8, 3), (11, 1)], "oxygen_saturation": [(91, 3), (93, 2), (95, 1)],
        "systolic_bp": [(90, 3), (100, 2), (110, 1)], "heart_rate": [(40, 3), (50, 1)], "temperature": [(35.0, 3), (36.0, 1)],
    }
    upper = {
        "respiratory_rate": [(25, 3), (21, 2)], "systolic_bp": [(220, 3)], "heart_rate": [(131, 3), (111, 2), (91, 1)],
        "temperature": [(39.1, 2), (38.1, 1)],
    }
    total = 0
    for name, low in bands.items():
        hits = [p for limit, p in low if v[name] <= limit] + [p for limit, p in upper.get(name, []) if v[name] >= limit]
        total += hits[0] if hits else 0
    return total


def test_news2_on_every_edge(spark):
    normal = {"respiratory_rate": 16, "oxygen_saturation": 98, "systolic_bp": 120, "heart_rate": 80, "temperature": 37.0}
    edges = {
        "respiratory_rate": [8, 9, 11, 12, 20, 21, 24, 25], "oxygen_saturation": [91, 92, 93, 94, 95, 96],
        "systolic_bp": [90, 91, 100, 101, 110, 111, 219, 220], "heart_rate": [40, 41, 50, 51, 90, 91, 110, 111, 130, 131],
        "temperature": [35.0, 35.1, 36.0, 36.1, 38.0, 38.1, 39.0, 39.1],
    }
    cases = [{**normal, name: value} for name, values in edges.items() for value in values]
    rows = [(str(i), "n", [], {k: str(v) for k, v in c.items()}) for i, c in enumerate(cases)]
    got = {int(r.triage_id): r.news2 for r in triage.news2_score(spark.createDataFrame(rows, REQUEST)).collect()}
    assert got == {i: news2(c) for i, c in enumerate(cases)}


def test_severity_overrides(spark):
    rows = [
        ("flags", "n", ["bleeding", "chest pain"], {}), ("oxygen", "n", [], {"oxygen_saturation": "88"}),
        ("age", "n", ["bleeding"], {"age": "75"}), ("calm", "n", ["fever"], {}),
    ]
    got = {r.triage_id: r.severity_label for r in triage.severity_label(spark.createDataFrame(rows, REQUEST)).collect()}
    assert got == {"flags": "critical", "oxygen": "critical", "age": "medium", "calm": "low"}


def test_form_errors(spark):
    rows = [
        ("ok", "Ana", [], {"temperature": "37,5", "age": " "}), ("name", "  ", [], {"age": "x"}), ("text", "Ana", [], {"age": "x", "heart_rate": "999"}),
        ("range", "Ana", [], {"heart_rate": "999"}), ("nan", "Ana", [], {"heart_rate": "nan"}),
    ]
    got = {r.triage_id: r for r in triage.validate_vitals(spark.createDataFrame(rows, REQUEST)).collect()}
    assert got["ok"].form_error is None and (got["ok"].temperature, got["ok"].age) == (37.5, 45.0)
    assert got["name"].form_error == domain.NAME_REQUIRED
    assert got["text"].form_error == "El campo 'age' debe ser numerico."
    assert got["range"].form_error == "El campo 'heart_rate' debe estar entre 20 y 220."
    assert got["nan"].form_error is None


def test_model_assessment_alerts_and_fallback(spark):
    requests = spark.createDataFrame(
        [("a", "n", ["Chest Pain"], {}, 1), ("b", "n", ["fever"], {}, 2), ("c", "n", [], {}, None)], REQUEST + ", ref_id long"
    )
    scores = spark.createDataFrame([(1, [0.1, 0.2, 0.2, 0.5])], "vec_id long, probabilities array<double>")
    rows = {r.triage_id: r for r in triage.triage_alerts(triage.assess(requests, scores)).collect()}
    a = rows["a"]
    assert (a.risk_level, a.recommended_priority, a.score, a.confidence) == ("critical", "immediate", 50, 0.5)
    assert a.alerts == [domain.ALERT_CRITICAL, domain.ALERT_TRIAGE_CONFIDENCE, domain.ALERT_CHEST_PAIN]
    assert a.model_name == domain.FOREST_MODEL_NAME
    assert (rows["b"].model_name, rows["b"].score, rows["b"].risk_level) == (domain.RULES_MODEL_NAME, 8, "low")
    assert rows["c"].risk_level == "low"


def test_answers_of_the_rules_carry_nothing_of_the_model(spark):
    urgent = {"heart_rate": "130", "oxygen_saturation": "80", "systolic_bp": "80"}
    requests = spark.createDataFrame([("m", "n", ["Chest Pain"], urgent, 1), ("r", "n", ["Chest Pain"], urgent, 2)], REQUEST + ", ref_id long")
    scores = spark.createDataFrame([(1, [0.1, 0.2, 0.2, 0.5])], "vec_id long, probabilities array<double>")
    weights = [0.1] * len(domain.FEATURES)
    rows = {r.triage_id: r for r in triage.assess(requests, scores, importances=weights).collect()}
    assert rows["r"].risk_level == "critical" and rows["r"].alerts == []
    nothing = ("model_version", "model_family", "clinical_note", "contributors", "probability_map")
    assert [rows["r"][c] for c in nothing] == [None] * len(nothing)
    assert (rows["m"].model_version, rows["m"].model_family) == ("1.0.0", "random_forest_isotonic_calibration")
    assert rows["m"].clinical_note.startswith("Salida del modelo de triaje.") and len(rows["m"].contributors) == 3
    records = {r.id: json.loads(r.model_response) for r in triage.triage_records(triage.assess(requests, scores, importances=weights).withColumn("created_at", F.current_timestamp()), "b").collect()}
    assert set(records["r"]) == {"model_name", "risk_level", "recommended_priority", "score", "confidence"}
    assert set(records["m"]) == set(records["r"]) | {"model_version", "model_family", "probabilities", "top_contributors", "alerts", "clinical_note"}


def test_hot_requests_are_split_over_the_join(spark):
    """One key holds a third of the requests; its partition is read by several tasks."""
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1",
    }
    for key, value in conf.items():
        spark.conf.set(key, value)
    try:
        requests = spark.range(0, 12_000, 1, 8).select(
            F.col("id").cast("string").alias("triage_id"), F.lit("n").alias("patient_name"), F.array(F.lit("fever")).alias("symptoms"),
            F.create_map(F.lit("age"), F.lit("30")).alias("vitals"), F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") + 10).alias("ref_id"),
        )
        scores = spark.range(1, 20_000).select(F.col("id").alias("vec_id"), F.array(*[F.lit(p) for p in (0.1, 0.2, 0.3, 0.4)]).alias("probabilities"))
        result = triage.assess(requests, scores).select("triage_id", "ref_id", "model_name")
        rows = result.collect()
        assert "skew=true" in result._jdf.queryExecution().executedPlan().toString()
        assert len(rows) == 12_000 and {r.model_name for r in rows} == {domain.FOREST_MODEL_NAME}
    finally:
        for key in conf:
            spark.conf.unset(key)


def test_label_noise_moves_about_the_rate_by_one_step(spark):
    df = spark.range(20_000).select(F.col("id").cast("string").alias("id"), F.lit("medium").alias("label"))
    got = dict(triage.label_noise(df, "label", 0.1, 1, "id").groupBy("label").count().collect())
    assert set(got) == {"low", "medium", "high"} and 1700 < got["low"] + got["high"] < 2300


def test_contributors(spark):
    df = spark.createDataFrame([("x", [1.0, 0.0, 36.6]), ("none", [0.0, 0.0, 0.0])], "id string, features array<double>")
    names = ["a", "b", "c"]
    got = {r.id: [(c.feature, c.importance, c.value) for c in r.contributors] for r in triage.top_contributors(df, [0.2, 0.5, 0.2], 2, names).collect()}
    assert got == {"x": [("c", 0.2, 36.6), ("a", 0.2, 1.0)], "none": [("b", 0.5, 0.0), ("c", 0.2, 0.0)]}


STUDY = "study_id string, created_at timestamp, original_filename string, file_size_bytes long, prediction_class string, confidence double, mean_intensity double, contrast double"


def studies(spark):
    from datetime import datetime

    at = datetime(2026, 5, 14, 10)
    return spark.createDataFrame(
        [
            ("calm", at, "a.jpg", 10, "Sana", 0.9, 120.0, 40.0), ("covid", at, "a.jpg", 10, "COVID-19", 0.8, 120.0, 40.0),
            ("all", at, "a.jpg", 10, "COVID-19", 0.3, 10.0, 2.0), ("edge", at, "a.jpg", 10, "Sana", 0.55, 45.0, 18.0),
        ],
        STUDY,
    )


def test_events_match_their_conditions(spark, tmp_path):
    records = radiology.study_records(studies(spark), "bucket")
    events = radiology.derive_quality_events(records).collect()
    assert sorted((e.study_id, e.event_type, e.severity) for e in events) == [
        ("all", "clinical_alert", "high"), ("all", "image_quality", "medium"), ("all", "low_model_confidence", "medium"),
        ("covid", "clinical_alert", "high"),
    ]
    status = {r.study_id: (r.quality_status, len(r.alerts)) for r in records.collect()}
    assert status == {"calm": ("accepted", 0), "covid": ("accepted", 1), "all": ("warning", 3), "edge": ("accepted", 0)}
    for _ in range(2):
        registered.register_studies(records, str(tmp_path), "b1")
    assert registered.load_studies(spark, str(tmp_path)).count() == 4
    assert registered.load_events(spark, str(tmp_path)).count() == 4
    documents = registered.load_report_documents(spark, str(tmp_path))
    found = metrics.report_lookup(records.drop("document"), documents).filter("study_id = 'all'").first()
    body = json.loads(found.document)
    assert body["quality"]["status"] == "warning" and body["image"]["object_key"] is None


PNG, JPEG = bytes.fromhex("89504E470D0A1A0A") + b"x", bytes.fromhex("FFD8FFE0") + b"x"


@pytest.mark.parametrize(
    "name, mime, content, error",
    [
        ("scan.jpg", "image/jpeg", JPEG, None), ("scan.PNG", None, PNG, None), ("  ", None, PNG, domain.IMAGE_NAME_MISSING),
        ("a.gif", None, PNG, domain.IMAGE_TYPE_UNSUPPORTED), ("scan.jpg", "application/pdf", JPEG, domain.IMAGE_TYPE_UNSUPPORTED),
        ("scan.jpg", "", b"", domain.IMAGE_EMPTY), ("scan.jpg", "", b"\0" * (domain.MAX_IMAGE_BYTES + 1), domain.IMAGE_TOO_LARGE),
        ("scan.jpg", "", b"not-an-image", domain.IMAGE_UNREADABLE), ("scan.png", "image/png", JPEG, domain.IMAGE_MISMATCH),
    ],
)
def test_image_checks(spark, name, mime, content, error):
    df = spark.createDataFrame([(name, mime, bytearray(content))], "path string, mime string, content binary")
    assert images.validate_images(df, mime_type="mime").first().image_error == error


def test_upload_checks(spark):
    rows = [("", PNG), ("scan", PNG), ("scan.gif", PNG), ("scan.jpg", b""), ("scan.png", JPEG), ("Scan.JPG", JPEG), ("a.jpg", b"zz")]
    df = spark.createDataFrame([(n, bytearray(c)) for n, c in rows], "path string, content binary")
    got = [(r.upload_error, r.mime_type) for r in images.validate_uploads(df).collect()]
    assert got == [
        (domain.UPLOAD_NAME_INVALID, None), (domain.UPLOAD_NO_EXTENSION, None), (domain.UPLOAD_FORMAT, None), (domain.UPLOAD_EMPTY, None),
        (domain.UPLOAD_MISMATCH, None), (None, "image/jpeg"), (domain.UPLOAD_UNREADABLE, None),
    ]


def test_image_folders(spark, tmp_path):
    for split, folder in [("train", "NORMAL"), ("train", "COVID19"), ("test", "NORMAL")]:
        (tmp_path / split / folder).mkdir(parents=True)
        (tmp_path / split / folder / "a.png").write_bytes(PNG)
    found = readers.scan_labelled_images(spark, str(tmp_path))
    assert {(r.folder_split, r.label) for r in found.collect()} == {("train", "Sana"), ("train", "COVID-19"), ("test", "Sana")}
    assert [tuple(r) for r in images.dataset_class_parity(found).collect()] == [("COVID-19", "test")]
    catalog = readers.image_catalog(readers.scan_images(spark, str(tmp_path), "*.png")).first()
    assert (catalog.file_size_bytes, catalog.extension) == (len(PNG), ".png")
    (tmp_path / "train" / "ODD").mkdir()
    (tmp_path / "train" / "ODD" / "b.png").write_bytes(PNG)
    with pytest.raises(readers.UnknownFoldersError, match="ODD"):
        readers.scan_labelled_images(spark, str(tmp_path))


def test_display(spark):
    df = spark.createDataFrame([("critical",), ("ODD",), ("",), (None,)], "risk_level string")
    assert [r.risk_display for r in presentation.with_display_labels(df, "risk", "risk_level").collect()] == ["Critico", "Odd", "Sin clase", "Sin clase"]
    classes = spark.createDataFrame([("Sana",), (None,)], "prediction_class string")
    assert [r.state for r in presentation.with_class_result(classes).collect()] == ["healthy", "pending"]
    p = spark.createDataFrame([(1, {"Sana": 1.5, "Neumonia": -0.2})], "id int, p map<string,double>")
    rows = presentation.probability_rows(p, "id", "p").orderBy("position").collect()
    assert [(r.label, r.value, r.percent, r.tone) for r in rows] == [
        ("Sana", 1.0, 100.0, "healthy"), ("Neumonia", 0.0, 0.0, "pneumonia"), ("COVID-19", 0.0, 0.0, "covid"),
    ]


def test_payloads(spark):
    payloads = ['{"class":"Sana","probabilities":{"Sana":0.7}}', '{"probabilities":{}}', '{"class":"Sana","probabilities":{"Sana":"abc"}}', "broken", '{"class":"Sana","probabilities":[1]}']
    df = spark.createDataFrame([(p,) for p in payloads], "payload string")
    assert [r.is_valid for r in presentation.check_prediction_payloads(df, "payload").collect()] == [True, False, False, False, False]


def test_empty_tables_give_zeros(spark):
    none = studies(spark).limit(0).withColumn("quality_status", F.lit("accepted"))
    row = metrics.radiology_summary(none).first()
    assert (row.total_studies, row.average_confidence, row.last_study_at) == (0, 0.0, None)
    triages = spark.createDataFrame([], "triage_id string")
    runs = spark.createDataFrame([], "run_id string, created_at timestamp, status string")
    events = spark.createDataFrame([], "severity string, resolved boolean")
    snapshot = metrics.platform_snapshot(none, triages, runs, events)
    first = snapshot.first()
    assert first.pipeline.latest_run is None and first.triage.total_records == 0
    filled = metrics.with_snapshot_defaults(snapshot.limit(0)).first()
    assert json.loads(filled.radiology)["total_studies"] == 0
    assert (filled.recent_studies, filled.backend_status) == ("[]", "no disponible")
    given = spark.range(1).select(F.lit("ok").alias("backend_status"), F.array(F.struct(F.lit("s").alias("study_id"))).alias("recent_studies"))
    filled = metrics.with_snapshot_defaults(given).first()
    assert (filled.recent_studies, filled.backend_status) == ('[{"study_id":"s"}]', "ok")


def test_limits(spark):
    for n in (0, 101):
        with pytest.raises(metrics.LimitError):
            metrics.recent(spark.range(1), n)
    assert metrics.checked_limit() == 10


def test_event_versions(spark):
    from datetime import datetime

    at = datetime(2026, 1, 1)
    log = spark.createDataFrame(
        [(1, 0, at, "high", False), (2, 0, at, "high", False), (2, 1, at, "high", True)],
        "event_id long, version int, created_at timestamp, severity string, resolved boolean",
    )
    ids = spark.createDataFrame([(1,), (9,)], "event_id long")
    appended = log.unionByName(metrics.resolved_version(log, ids).select(*log.columns))
    assert {r.event_id: r.resolved for r in metrics.current_events(appended).collect()} == {1: True, 2: True}
    assert [r.event_id for r in metrics.missing_ids(log, ids, "event_id").collect()] == [9]


def test_tables(spark, tmp_path):
    from datetime import datetime

    root, at = str(tmp_path), datetime(2026, 1, 1)
    columns = "id string, created_at timestamp, source string, severity string, event_type string, message string, metadata string"
    events = spark.createDataFrame([("e1", at, "s", "high", "t", "m", "{}")], columns)
    for _ in range(2):
        tables.append(events, root, "quality_events", "b1")
    tables.append(events.withColumn("id", F.lit("e2")), root, "quality_events", "b2")
    loaded = tables.load(spark, root, "quality_events")
    assert sorted((r.id, r.resolved) for r in loaded.collect()) == [("e1", False), ("e2", False)]
    with pytest.raises(Exception, match="NULL in quality_events.message"):
        tables.append(events.withColumn("message", F.lit(None).cast("string")), root, "quality_events", "b3")
    with pytest.raises(tables.NullValueError, match="severity"):
        tables.append(events.drop("severity"), root, "quality_events", "b3")
    # an older file without the columns added later
    events.select("id", "created_at").write.parquet(f"{root}/triage_records/batch_id=old")
    assert tables.load(spark, root, "triage_records").first().patient_id == ""
    spark.sql("CREATE DATABASE clinic")
    for _ in range(2):
        tables.create_tables(spark, "clinic")
    spark.sql("INSERT INTO clinic.quality_events (id, created_at, source, severity, event_type, message, metadata) VALUES ('e', current_timestamp(), 's', 'high', 't', 'm', '{}')")
    assert spark.table("clinic.quality_events").first().resolved is False
