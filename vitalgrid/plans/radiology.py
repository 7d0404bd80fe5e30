"""Queries over scored studies, images and their reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitalgrid import domain
from vitalgrid.functions import arrays
from vitalgrid.functions.numeric import round_exact
from vitalgrid.functions.records import iso_time
from vitalgrid.operators import images, metrics, presentation, radiology
from vitalgrid.plans.registry import query
from vitalgrid.plans.views import case, iso, joined, quoted, round_exact as sql_round, text_list
from vitalgrid.session import scratch_path
from vitalgrid.sources import clinical, readers, registered, tables

BUCKET = "clinical-reports"


def records(spark, d):
    return radiology.study_records(clinical.predictions(spark, d), BUCKET)


def stored(df):
    """Study records under the column names of the study table."""
    return df.withColumnRenamed("study_id", "id")


@query("quality_flags", "SELECT study_id, messages FROM v_flagged")
def quality_flags(spark, d):
    flagged = radiology.quality_flags(clinical.predictions(spark, d))
    return flagged.select("study_id", F.array_join("quality_messages", " | ").alias("messages"))


@query("study_quality_status", "SELECT study_id, quality_status FROM v_flagged")
def study_quality_status(spark, d):
    flagged = radiology.quality_flags(clinical.predictions(spark, d))
    return radiology.quality_status(flagged).select("study_id", "quality_status")


_ALERTS = joined([
    f"CASE WHEN prediction_class = 'COVID-19' THEN {quoted(domain.STUDY_ALERT_CONTAGION)} END",
    f"CASE WHEN confidence < 0.55e0 THEN {quoted(domain.STUDY_ALERT_CONFIDENCE)} END",
    f"CASE WHEN messages <> '' THEN {quoted(domain.STUDY_ALERT_QUALITY)} END",
])


@query("study_alerts", f"SELECT study_id, {_ALERTS} AS alerts FROM v_flagged")
def study_alerts(spark, d):
    flagged = radiology.quality_flags(clinical.predictions(spark, d))
    return radiology.study_alerts(flagged).select("study_id", F.array_join("alerts", " | ").alias("alerts"))


@query("derive_quality_events", f"""
    SELECT study_id, md5(study_id || '|' || event_type) AS event_id, {iso('created_at')} AS created_at, 'radiology' AS source,
           severity, event_type, message, study_id AS metadata_study, FALSE AS resolved FROM v_study_events""")
def derive_quality_events(spark, d):
    events = radiology.derive_quality_events(radiology.quality_flags(clinical.predictions(spark, d)))
    return events.select(
        "study_id", "event_id", iso_time(F.col("created_at")).alias("created_at"), "source", "severity", "event_type",
        "message", F.get_json_object("metadata", "$.study_id").alias("metadata_study"), "resolved",
    )


_P = [f"exp({z} - m) / s" for z in ("z0", "z1", "z2")]
_SOFTMAX = f"""
    (SELECT vec_id, {', '.join(f'{sql_round(p, 4)} AS q{i}' for i, p in enumerate(_P))}
     FROM (SELECT *, exp(z0 - m) + exp(z1 - m) + exp(z2 - m) AS s
           FROM (SELECT vec_id, z0, z1, z2, greatest(z0, z1, z2) AS m FROM v_logits) a) b) c"""
_CLASS = "CASE greatest(q0, q1, q2) WHEN q0 THEN 'COVID-19' WHEN q1 THEN 'Sana' ELSE 'Neumonia' END"


@query("softmax_probabilities", f"SELECT vec_id, q0 AS p_covid, q1 AS p_sana, q2 AS p_neumonia, {_CLASS} AS prediction_class, greatest(q0, q1, q2) AS confidence FROM {_SOFTMAX}")
def softmax_probabilities(spark, d):
    p = F.col("probabilities")
    return radiology.softmax_probabilities(clinical.logits(spark, d)).select(
        "vec_id", p[0].alias("p_covid"), p[1].alias("p_sana"), p[2].alias("p_neumonia"), "prediction_class", "confidence"
    )


@query("argmax_class", "SELECT vec_id, CASE greatest(z0, z1, z2) WHEN z0 THEN 'COVID-19' WHEN z1 THEN 'Sana' ELSE 'Neumonia' END AS prediction_class, greatest(z0, z1, z2) AS confidence FROM v_logits")
def argmax_class(spark, d):
    best = radiology.argmax_class(clinical.logits(spark, d), "logits", domain.MODEL_CLASSES)
    return best.select("vec_id", "prediction_class", "confidence")


@query("ranked_probabilities", f"""
    SELECT vec_id, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY probability DESC, i) AS INTEGER) AS rank,
           {text_list(domain.MODEL_CLASSES)}[i] AS label, probability
    FROM (SELECT vec_id, i, [q0, q1, q2][i] AS probability FROM (SELECT *, unnest([1, 2, 3]) AS i FROM {_SOFTMAX}) t) u""")
def ranked_probabilities(spark, d):
    scored = radiology.softmax_probabilities(clinical.logits(spark, d))
    return radiology.ranked_probabilities(scored, "vec_id", "probabilities", domain.MODEL_CLASSES)


@query("probability_rows", f"""
    SELECT vec_id, CAST(i - 1 AS INTEGER) AS position, {text_list(domain.DISPLAY_CLASSES)}[i] AS label, [q1, q2, q0][i] AS value,
           {sql_round('[q1, q2, q0][i] * 100e0', 2)} AS percent, {text_list(domain.CLASS_TONES.values())}[i] AS tone
    FROM (SELECT *, unnest([1, 2, 3]) AS i FROM {_SOFTMAX}) t""")
def probability_rows(spark, d):
    scored = radiology.softmax_probabilities(clinical.logits(spark, d))
    mapped = scored.withColumn("by_label", arrays.labelled(domain.MODEL_CLASSES, F.col("probabilities")))
    return presentation.probability_rows(mapped, "vec_id", "by_label").select("vec_id", "position", "label", "value", "percent", "tone")


@query("class_result_texts", f"""
    SELECT study_id, {', '.join(f"{case('prediction_class', {c: t[i] for c, t in domain.CLASS_RESULTS.items()}, quoted(domain.CLASS_PENDING[i]))} AS {name}"
        for i, name in enumerate(('state', 'title', 'icon', 'description', 'eyebrow')))} FROM v_predictions""")
def class_result_texts(spark, d):
    shown = presentation.with_class_result(clinical.predictions(spark, d))
    return shown.select("study_id", "state", "title", "icon", "description", "eyebrow")


@query("intensity_stats", f"""
    SELECT vec_id, {sql_round('list_avg(p)', 4)} AS mean_intensity, {sql_round('list_stddev_pop(p)', 4)} AS contrast
    FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS p FROM embeddings) t""")
def intensity_stats(spark, d):
    stats = radiology.intensity_stats(clinical.pixels(spark, d))
    return stats.select(
        "vec_id", round_exact(F.col("mean_intensity"), 4).alias("mean_intensity"), round_exact(F.col("contrast"), 4).alias("contrast")
    )


_REPORT = f"""
    SELECT report_object_key, study_id, {iso('created_at')} AS created_at, original_filename, file_size_bytes, prediction_class,
           quality_status, messages, {_ALERTS} AS alerts, {sql_round('mean_intensity', 2)} AS mean_intensity,
           {case('prediction_class', domain.EXPLANATIONS, "''")} AS explanation FROM v_flagged"""


def report_fields(documents):
    texts = "array<string>"

    def field(path: str, name: str):
        return F.get_json_object("document", f"$.{path}").alias(name)

    return documents.select(
        "report_object_key", field("study_id", "study_id"), field("created_at", "created_at"),
        field("image.original_filename", "original_filename"),
        F.get_json_object("document", "$.image.file_size_bytes").cast("long").alias("file_size_bytes"),
        field("prediction.class", "prediction_class"), field("quality.status", "quality_status"),
        F.array_join(F.from_json(F.get_json_object("document", "$.quality.messages"), texts), " | ").alias("messages"),
        F.array_join(F.from_json(F.get_json_object("document", "$.automation.alerts"), texts), " | ").alias("alerts"),
        F.get_json_object("document", "$.prediction.features.mean_intensity").cast("double").alias("mean_intensity"),
        field("prediction.explanation", "explanation"),
    )


@query("report_documents", _REPORT)
def report_documents(spark, d):
    store = scratch_path(spark, "study-reports")
    tables.write_documents(records(spark, d).withColumn("kind", F.lit("radiology")), store, "batch-1")
    return report_fields(tables.load_documents(spark, store).filter("kind = 'radiology'"))


@query("report_lookup", f"SELECT study_id, confidence, report_object_key, quality_status AS document_status FROM v_flagged")
def report_lookup(spark, d):
    store = scratch_path(spark, "study-reports")
    tables.write_documents(records(spark, d).withColumn("kind", F.lit("radiology")), store, "batch-1")
    found = metrics.report_lookup(clinical.predictions(spark, d), tables.load_documents(spark, store))
    return found.select(
        "study_id", "confidence", "report_object_key", F.get_json_object("document", "$.quality.status").alias("document_status")
    )


@query("study_detail", f"""
    SELECT study_id, {iso('created_at')} AS created_at, original_filename, prediction_class, confidence, quality_status, messages,
           'unknown' AS model_name, prediction_class AS response_class, report_object_key FROM v_flagged""")
def study_detail(spark, d):
    detail = radiology.study_detail(stored(records(spark, d)))
    return detail.select(
        "study_id", "created_at", "original_filename", "prediction_class", "confidence", "quality_status",
        F.array_join("quality_messages", " | ").alias("messages"), F.col("model.name").alias("model_name"),
        F.get_json_object("model.response", "$.class").alias("response_class"), "report_object_key",
    )


@query("study_by_id", "SELECT study_id, prediction_class, confidence FROM v_predictions WHERE study_id IN (SELECT 'S-' || CAST(user_id AS VARCHAR) FROM events)")
def study_by_id(spark, d):
    """Lookup of a list of ids as long as the table, with repeats."""
    wanted = clinical.table(spark, d, "events").select(F.concat(F.lit("S-"), F.col("user_id").cast("string")).alias("study_id"))
    studies = clinical.predictions(spark, d).select("study_id", "prediction_class", "confidence")
    return metrics.rows_by_id(studies, wanted, "study_id")


@query("study_ids_not_found", "SELECT DISTINCT 'S-' || CAST(o_orderkey AS VARCHAR) AS study_id FROM orders WHERE o_orderkey NOT IN (SELECT event_id FROM events)")
def study_ids_not_found(spark, d):
    wanted = clinical.table(spark, d, "orders").select(F.concat(F.lit("S-"), F.col("o_orderkey").cast("string")).alias("study_id"))
    return metrics.missing_ids(clinical.predictions(spark, d), wanted, "study_id")


@query("study_append", "SELECT study_id AS id, original_filename, file_size_bytes, prediction_class, confidence, quality_status, messages, report_object_key FROM v_flagged")
def study_append(spark, d):
    store = scratch_path(spark, "studies")
    tables.append(stored(records(spark, d)), store, "radiology_studies", "batch-1")
    return tables.load(spark, store, "radiology_studies").select(
        "id", "original_filename", "file_size_bytes", "prediction_class", "confidence", "quality_status",
        F.array_join("quality_messages", " | ").alias("messages"), "report_object_key",
    )


@query("quality_event_append", "SELECT md5(study_id || '|' || event_type) AS id, severity, event_type, message, FALSE AS resolved FROM v_study_events")
def quality_event_append(spark, d):
    store = scratch_path(spark, "events")
    events = radiology.derive_quality_events(radiology.quality_flags(clinical.predictions(spark, d)))
    tables.append(events.withColumnRenamed("event_id", "id").drop("resolved"), store, "quality_events", "batch-1")
    return tables.load(spark, store, "quality_events").select("id", "severity", "event_type", "message", "resolved")


@query("register_study", """
    SELECT study_id, prediction_class, quality_status, (SELECT count(*) FROM v_study_events e WHERE e.study_id = f.study_id) AS events FROM v_flagged f""")
def register_study(spark, d):
    store = scratch_path(spark, "registered")
    registered.register_studies(records(spark, d), store, "batch-1")
    studies = registered.load_studies(spark, store)
    return studies.select(
        "study_id", "prediction_class", "quality_status", F.size("events").cast("long").alias("events")
    )


@query("registered_events", "SELECT study_id, severity, event_type FROM v_study_events")
def registered_events(spark, d):
    store = scratch_path(spark, "registered")
    registered.register_studies(records(spark, d), store, "batch-1")
    return registered.load_events(spark, store).select("study_id", "severity", "event_type")


@query("image_catalog", """
    SELECT path, octet_length(content) AS file_size_bytes, sha256(content) AS checksum_sha256,
           lower(regexp_extract(path, '[^/.][^/]*(\\.[^./]*)$', 1)) AS extension FROM v_objects""")
def image_catalog(spark, d):
    return readers.image_catalog(clinical.image_objects(spark, d))


_FOLDER = case("split_part(path, '/', 2)", domain.FOLDER_LABELS)


@query("image_folder_scan", f"SELECT path, split_part(path, '/', 1) AS folder_split, split_part(path, '/', 2) AS folder, {_FOLDER} AS label FROM v_objects")
def image_folder_scan(spark, d):
    return readers.labelled_images(clinical.image_objects(spark, d))


@query("unknown_folders", f"SELECT split_part(path, '/', 1) AS folder_split, split_part(path, '/', 2) AS folder, count(*) AS files FROM v_objects WHERE {_FOLDER} IS NULL GROUP BY 1, 2")
def unknown_folders(spark, d):
    return readers.unknown_folders(readers.labelled_images(clinical.image_objects(spark, d)))


_FOUND = "CASE WHEN starts_with(hex(content), '89504E470D0A1A0A') THEN 'PNG' WHEN starts_with(hex(content), 'FFD8FF') THEN 'JPEG' WHEN starts_with(hex(content), '47494638') THEN 'GIF' WHEN starts_with(hex(content), '49492A00') THEN 'TIFF' WHEN starts_with(hex(content), '52494646') AND substr(hex(content), 17, 8) = '57454250' THEN 'WEBP' WHEN starts_with(hex(content), '424D') AND substr(hex(content), 13, 8) = '00000000' THEN 'BMP' END"


@query("image_validate", f"""
    SELECT path, CASE WHEN extension NOT IN ('.jpg', '.jpeg', '.png') OR NOT (mime = '' OR lower(mime) IN ('image/jpeg', 'image/png')) THEN 'Unsupported file type'
                WHEN size = 0 THEN 'Empty file' WHEN size > 5242880 THEN 'File exceeds the size limit'
                WHEN found IS NULL THEN 'Invalid image file' WHEN found NOT IN ('PNG', 'JPEG') THEN 'Unsupported image format'
                WHEN (found = 'PNG') <> (extension = '.png') THEN 'File extension does not match the image content' END AS image_error
    FROM (SELECT path, lower(regexp_extract(path, '[^/.][^/]*(\\.[^./]*)$', 1)) AS extension, octet_length(content) AS size, {_FOUND} AS found,
                 CASE octet_length(content) % 3 WHEN 0 THEN 'image/PNG' WHEN 1 THEN '' ELSE 'application/pdf' END AS mime FROM v_objects) t""")
def image_validate(spark, d):
    mime = F.when(F.length("content") % 3 == 0, "image/PNG").when(F.length("content") % 3 == 1, "").otherwise("application/pdf")
    objects = clinical.image_objects(spark, d).withColumn("content_type", mime)
    return images.validate_images(objects, mime_type="content_type").select("path", "image_error")


@query("upload_validate", f"""
    SELECT path, CASE WHEN strpos(path, '.') = 0 THEN {quoted(domain.UPLOAD_NO_EXTENSION)} WHEN extension NOT IN ('jpg', 'jpeg', 'png') THEN {quoted(domain.UPLOAD_FORMAT)}
                WHEN size = 0 THEN {quoted(domain.UPLOAD_EMPTY)} WHEN size > 5242880 THEN {quoted(domain.UPLOAD_TOO_LARGE)}
                WHEN found IS NULL THEN {quoted(domain.UPLOAD_UNREADABLE)} WHEN found NOT IN ('PNG', 'JPEG') THEN 'Formato no permitido. Use JPG, JPEG o PNG.'
                WHEN (found = 'PNG') <> (extension = 'png') THEN {quoted(domain.UPLOAD_MISMATCH)} END AS upload_error,
           CASE WHEN extension IN ('jpg', 'jpeg') AND found = 'JPEG' THEN 'image/jpeg' WHEN extension = 'png' AND found = 'PNG' THEN 'image/png' END AS mime_type
    FROM (SELECT path, lower(regexp_extract(path, '\\.([^.]*)$', 1)) AS extension, octet_length(content) AS size, {_FOUND} AS found FROM v_objects) t""")
def upload_validate(spark, d):
    return images.validate_uploads(clinical.image_objects(spark, d)).select("path", "upload_error", "mime_type")


@query("dataset_class_parity", """
    SELECT batch AS label, CASE WHEN NOT in_train THEN 'train' ELSE 'test' END AS missing_split
    FROM (SELECT study_day AS batch, bool_or(folder_split = 'train') AS in_train, bool_or(folder_split = 'test') AS in_test
          FROM (SELECT folder_split, label || '-' || CAST(CAST(substr(study_id, 3) AS BIGINT) // 7 AS VARCHAR) AS study_day FROM v_split) t GROUP BY 1) u
    WHERE NOT (in_train AND in_test)""")
def dataset_class_parity(spark, d):
    """Parity over fine classes (label and group of seven studies), where some splits are missing."""
    group = F.floor(F.substr("study_id", F.lit(3)).cast("long") / 7).cast("string")
    images_ = clinical.labelled_split(spark, d).withColumn("label", F.concat("label", F.lit("-"), group))
    return images.dataset_class_parity(images_)


@query("split_class_counts", """
    SELECT s AS folder_split, l AS label, count(study_id) AS rows FROM (SELECT unnest(['train', 'val', 'test']) AS s) a
    CROSS JOIN (SELECT unnest(['COVID-19', 'Sana', 'Neumonia']) AS l) b LEFT JOIN v_split v ON v.folder_split = s AND v.label = l GROUP BY 1, 2""")
def split_class_counts(spark, d):
    return images.split_class_counts(clinical.labelled_split(spark, d), splits=("train", "val", "test"))


_PAYLOAD = """
    SELECT event_id, CASE event_id % 11 WHEN 0 THEN props
        WHEN 1 THEN '{"class":"' || event_type || '","probabilities":{"Sana":"abc"}}'
        WHEN 2 THEN '{"probabilities":{"Sana":0.5}}'
        WHEN 3 THEN '{"class":5,"probabilities":{"Sana":0.5}}'
        WHEN 4 THEN '{"class":{"a":1},"probabilities":{"Sana":0.5}}'
        WHEN 5 THEN '{"class":"x","probabilities":{"Sana":"1d"}}'
        WHEN 6 THEN '{"class":"x","probabilities":{"Sana":"1_0","k":true}}'
        WHEN 7 THEN '{"class":"x","probabilities":{"Sana":null}}'
        WHEN 8 THEN '{"class":"x","probabilities":[1]}'
        ELSE '{"class":"' || event_type || '","probabilities":{"Sana":0.25,"k":' || json_extract_string(props, '$.k') || '}}' END AS payload FROM events"""


@query("prediction_payload_check", f"""
    SELECT event_id, event_id % 11 IN (6, 9, 10) AS is_valid, CASE WHEN event_id % 11 IN (6, 9, 10) THEN json_extract_string(payload, '$.class') END AS class_label,
           CASE WHEN event_id % 11 > 8 THEN CAST(json_extract_string(payload, '$.probabilities.k') AS DOUBLE) WHEN event_id % 11 = 6 THEN 1e0 END AS k
    FROM ({_PAYLOAD}) t""")
def prediction_payload_check(spark, d):
    events = clinical.table(spark, d, "events")
    texts = {
        2: '{"probabilities":{"Sana":0.5}}',
        3: '{"class":5,"probabilities":{"Sana":0.5}}',
        4: '{"class":{"a":1},"probabilities":{"Sana":0.5}}',
        5: '{"class":"x","probabilities":{"Sana":"1d"}}',
        6: '{"class":"x","probabilities":{"Sana":"1_0","k":true}}',
        7: '{"class":"x","probabilities":{"Sana":null}}',
        8: '{"class":"x","probabilities":[1]}',
    }
    kind = F.col("event_id") % 11
    payload = F.when(kind == 0, F.col("props")).when(kind == 1, F.concat(F.lit('{"class":"'), "event_type", F.lit('","probabilities":{"Sana":"abc"}}')))
    for number, text in texts.items():
        payload = payload.when(kind == number, F.lit(text))
    payload = payload.otherwise(
        F.concat(F.lit('{"class":"'), "event_type", F.lit('","probabilities":{"Sana":0.25,"k":'), F.get_json_object("props", "$.k"), F.lit("}}"))
    )
    checked = presentation.check_prediction_payloads(events.select("event_id", payload.alias("payload")), "payload")
    return checked.select(
        "event_id", "is_valid", F.when(F.col("is_valid"), F.col("prediction.class")).alias("class_label"),
        F.when(F.col("is_valid"), F.try_element_at("shares", F.lit("k"))).alias("k"),
    )
