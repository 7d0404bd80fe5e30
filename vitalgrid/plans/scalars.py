"""Scalar expressions by group, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitalgrid import domain
from vitalgrid.functions import arrays, binary, numeric, records, text
from vitalgrid.plans.registry import query
from vitalgrid.plans.views import iso, number, round_exact, strip, text_list
from vitalgrid.sources import clinical

_SUFFIX = "lower(regexp_extract(original_filename, '[^/.][^/]*(\\.[^./]*)$', 1))"


@query("scalar_string", f"""
    SELECT study_id, {strip("' ' || chr(160) || prediction_class || chr(9)")} AS stripped, lower(prediction_class) AS folded,
           {_SUFFIX} AS suffix, 'uploads/' || study_id || CASE WHEN {_SUFFIX} = '' THEN '.jpg' ELSE {_SUFFIX} END AS upload_key,
           CASE WHEN strpos(original_filename, '.') > 0 THEN lower(split_part(original_filename, '.', -1)) END AS extension,
           'radiology-reports/' || study_id || '.json' AS report_key, 'PAC-' || upper(substr(md5(study_id), 1, 8)) AS patient_code,
           upper(substr(prediction_class, 1, 1)) || lower(substr(prediction_class, 2)) AS capitalized,
           CASE WHEN file_size_bytes % 2 = 0 THEN prediction_class END AS symptom, {number("replace('36,' || CAST(file_size_bytes AS VARCHAR), ',', '.')")} AS parsed
    FROM v_predictions""")
def scalar_string(spark, d):
    cls, name, study = F.col("prediction_class"), F.col("original_filename"), F.col("study_id")
    feature = F.concat(F.when(F.col("file_size_bytes") % 2 == 0, "symptom__").otherwise("vital__"), cls)
    size_text = F.concat(F.lit("36,"), F.col("file_size_bytes").cast("string"))
    return clinical.predictions(spark, d).select(
        "study_id",
        text.strip(F.concat(F.lit(" \xa0"), cls, F.lit("\t"))).alias("stripped"),
        text.fold(cls).alias("folded"),
        text.file_suffix(name).alias("suffix"),
        text.upload_key(study, name).alias("upload_key"),
        text.last_extension(name).alias("extension"),
        text.report_key("radiology", study).alias("report_key"),
        text.patient_code(F.md5("study_id")).alias("patient_code"),
        text.capitalized(cls).alias("capitalized"),
        text.symptom_feature(feature).alias("symptom"),
        numeric.parse_number(F.replace(size_text, F.lit(","), F.lit("."))).alias("parsed"),
    )


@query("scalar_binary", f"""
    SELECT path, sha256(content) AS checksum, octet_length(content) AS size,
           printf('%.1f MB', {round_exact('octet_length(content) / 1048576e0', 1)}) AS size_text,
           md5('data:image/png;base64,' || to_base64(content)) AS data_url_md5,
           CASE WHEN starts_with(hex(content), '89504E470D0A1A0A') THEN 'PNG' WHEN starts_with(hex(content), 'FFD8FF') THEN 'JPEG' WHEN starts_with(hex(content), '47494638') THEN 'GIF' WHEN starts_with(hex(content), '49492A00') THEN 'TIFF' WHEN starts_with(hex(content), '52494646') AND substr(hex(content), 17, 8) = '57454250' THEN 'WEBP' WHEN starts_with(hex(content), '424D') AND substr(hex(content), 13, 8) = '00000000' THEN 'BMP' END AS image_format
    FROM v_objects""")
def scalar_binary(spark, d):
    content = F.col("content")
    return clinical.image_objects(spark, d).select(
        "path",
        binary.checksum(content).alias("checksum"),
        binary.byte_length(content).alias("size"),
        binary.size_text(binary.byte_length(content)).alias("size_text"),
        F.md5(binary.data_url(content, F.lit("image/png"))).alias("data_url_md5"),
        binary.image_format(content).alias("image_format"),
    )


@query("scalar_math", f"""
    SELECT event_id, greatest(0e0, least(1e0, value / 100e0)) AS clamped, {round_exact('value / 300e0 * 100e0', 2)} AS percent_2,
           {round_exact('value / 300e0 * 100e0', 1)} AS percent_1, {round_exact('value / 3e0', 4)} AS rounded_4,
           {round_exact('(value / 100e0 - 0.485e0) / 0.229e0', 4)} AS standardized FROM events""")
def scalar_math(spark, d):
    value = F.col("value")
    return clinical.table(spark, d, "events").select(
        "event_id",
        numeric.clamp(value / F.lit(100.0), 0.0, 1.0).alias("clamped"),
        numeric.percent(value / F.lit(300.0), 2).alias("percent_2"),
        numeric.percent(value / F.lit(300.0), 1).alias("percent_1"),
        numeric.round_exact(value / F.lit(3.0), 4).alias("rounded_4"),
        numeric.round_exact(
            numeric.standardized(value / F.lit(100.0), F.lit(0.485), F.lit(0.229)), 4
        ).alias("standardized"),
    )


@query("scalar_time", f"SELECT event_id, {iso('ts')} AS iso FROM events")
def scalar_time(spark, d):
    return clinical.table(spark, d, "events").select("event_id", records.iso_time(F.col("ts")).alias("iso"))


@query("scalar_json", """
    SELECT event_id, json_extract_string(props, '$.k') AS k, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k_number,
           'none' AS missing, -1e0 AS missing_number, CAST(json_extract_string(props, '$.k') AS BIGINT) AS round_trip FROM events""")
def scalar_json(spark, d):
    props = F.col("props")
    again = F.from_json(records.document(F.from_json(props, "k long, absent string")), "k long, absent string")
    return clinical.table(spark, d, "events").select(
        "event_id",
        records.json_text(props, "$.k").alias("k"),
        records.json_number(props, "$.k", -1.0).alias("k_number"),
        records.json_text(props, "$.absent", "none").alias("missing"),
        records.json_number(props, "$.absent", -1.0).alias("missing_number"),
        again["k"].alias("round_trip"),
    )


@query("scalar_array_map", f"""
    SELECT triage_id, CAST(len(symptoms) AS INTEGER) AS symptom_count, list_contains(symptoms, 'fever') AS has_fever,
           array_to_string(list_transform({text_list(domain.SYMPTOMS)}, lambda s: CAST(CAST(list_contains(symptoms, s) AS INTEGER) AS VARCHAR)), '') AS multi_hot,
           CASE WHEN list_contains(symptoms, 'cough') THEN 1 ELSE 0 END AS cough_by_map,
           array_to_string(list_distinct(symptoms), ',') <> '' AS any_symptom FROM v_triage""")
def scalar_array_map(spark, d):
    symptoms = F.col("symptoms")
    hot = F.array(*[F.array_contains(symptoms, name).cast("int") for name in domain.SYMPTOMS])
    by_name = arrays.labelled(domain.SYMPTOMS, hot)
    return clinical.triage_requests(spark, d).select(
        "triage_id",
        F.size(arrays.text_items(symptoms)).alias("symptom_count"),
        F.array_contains(symptoms, "fever").alias("has_fever"),
        F.array_join(hot.cast("array<string>"), "").alias("multi_hot"),
        by_name["cough"].alias("cough_by_map"),
        (F.array_join(F.array_distinct(symptoms), ",") != "").alias("any_symptom"),
    )


@query("scalar_id", "SELECT study_id, md5(study_id || '|' || prediction_class) AS derived, TRUE AS fresh_is_uuid FROM v_predictions")
def scalar_id(spark, d):
    fresh = records.new_id().rlike("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$")
    return clinical.predictions(spark, d).select(
        "study_id", records.derived_id(F.col("study_id"), F.col("prediction_class")).alias("derived"), fresh.alias("fresh_is_uuid")
    )
