"""Radiology: probabilities, quality flags, alerts, events and study records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalgrid import domain
from vitalgrid.functions import arrays
from vitalgrid.functions.arrays import literals, lookup, nth, present
from vitalgrid.functions.records import derived_id, document, iso_time
from vitalgrid.functions.text import report_key


def argmax_class(df: DataFrame, probabilities: str, labels: Sequence[str]) -> DataFrame:
    """``prediction_class`` and its ``confidence``; the first label wins ties."""
    values = F.col(probabilities)
    return df.withColumns(
        {
            "prediction_class": nth(literals(labels), arrays.first_greatest(values)),
            "confidence": F.array_max(values),
        }
    )


def softmax_probabilities(
    df: DataFrame, logits: str = "logits", labels: Sequence[str] = domain.MODEL_CLASSES
) -> DataFrame:
    """Rounded ``probabilities`` of the logits, then class and confidence read off them."""
    probabilities = df.withColumn("_exact", arrays.softmax(F.col(logits))).withColumn(
        "probabilities", arrays.rounded(F.col("_exact"), 4)
    )
    return argmax_class(probabilities.drop("_exact"), "probabilities", labels)


def ranked_probabilities(df: DataFrame, id_col: str, probabilities: str, labels: Sequence[str]) -> DataFrame:
    """One row per label and id, best first; equal ones keep the order of ``labels``.

    Sorted within the row's own array, so nothing is shuffled.
    """
    pairs = F.transform(
        probabilities, lambda p, i: F.struct((-p).alias("negated"), i.alias("position"), p.alias("probability"))
    )
    ranked = df.select(id_col, F.posexplode_outer(F.array_sort(pairs)).alias("rank", "item"))
    ranked = ranked.filter("rank IS NOT NULL")
    return ranked.select(
        id_col,
        (F.col("rank") + 1).alias("rank"),
        nth(literals(labels), F.col("item.position") + 1).alias("label"),
        F.col("item.probability").alias("probability"),
    )


def intensity_stats(df: DataFrame, pixels: str = "pixels") -> DataFrame:
    """``mean_intensity`` and ``contrast`` (population deviation) of a pixel vector."""
    measured = df.withColumn("_stats", arrays.mean_and_spread(F.col(pixels)))
    named = {"mean_intensity": F.col("_stats.mean"), "contrast": F.col("_stats.spread")}
    return measured.withColumns(named).drop("_stats")


def quality_flags(df: DataFrame) -> DataFrame:
    """``quality_messages`` from mean_intensity, contrast and confidence, in fixed order."""
    return df.withColumn(
        "quality_messages",
        present(
            F.when(F.col("mean_intensity") < domain.DARK_BELOW, domain.FLAG_DARK),
            F.when(F.col("mean_intensity") > domain.BRIGHT_ABOVE, domain.FLAG_BRIGHT),
            F.when(F.col("contrast") < domain.FLAT_BELOW, domain.FLAG_FLAT),
            F.when(F.col("confidence") < domain.LOW_CONFIDENCE, domain.FLAG_CONFIDENCE),
        ),
    )


def quality_status(df: DataFrame) -> DataFrame:
    flagged = F.size("quality_messages") > 0
    return df.withColumn("quality_status", F.when(flagged, "warning").otherwise("accepted"))


def _conditions() -> tuple[Column, Column, Column]:
    return (
        F.col("prediction_class") == domain.CRITICAL_CLASS,
        F.col("confidence") < domain.LOW_CONFIDENCE,
        F.size("quality_messages") > 0,
    )


def study_alerts(df: DataFrame) -> DataFrame:
    """``alerts`` of the study report, in fixed order."""
    contagious, uncertain, flawed = _conditions()
    return df.withColumn(
        "alerts",
        present(
            F.when(contagious, domain.STUDY_ALERT_CONTAGION),
            F.when(uncertain, domain.STUDY_ALERT_CONFIDENCE),
            F.when(flawed, domain.STUDY_ALERT_QUALITY),
        ),
    )


def study_events(df: DataFrame) -> DataFrame:
    """``events``: up to three quality events nested in their study."""
    contagious, uncertain, flawed = _conditions()
    study, at = F.col("study_id"), F.col("created_at")

    def event(severity: str, event_type: str, message: str, metadata: Column) -> Column:
        return F.struct(
            derived_id(study, F.lit(event_type)).alias("event_id"),
            at.alias("created_at"),
            F.lit("radiology").alias("source"),
            F.lit(severity).alias("severity"),
            F.lit(event_type).alias("event_type"),
            F.lit(message).alias("message"),
            document(metadata).alias("metadata"),
            F.lit(False).alias("resolved"),
        )

    certainty = F.struct("study_id", "confidence")
    messages = F.struct("study_id", F.col("quality_messages").alias("messages"))
    candidates = F.array(
        F.when(contagious, event("high", "clinical_alert", domain.EVENT_COVID, certainty)),
        F.when(uncertain, event("medium", "low_model_confidence", domain.EVENT_CONFIDENCE, certainty)),
        F.when(flawed, event("medium", "image_quality", domain.EVENT_IMAGE, messages)),
    )
    return df.withColumn("events", F.array_compact(candidates))


def derive_quality_events(df: DataFrame) -> DataFrame:
    """Zero to three event rows per study with quality_messages.

    Unfolded as an outer generator and filtered afterwards: for an inner one the
    optimizer first tests the size of the array, for which it computes it a second time.
    """
    return study_events(df).select("study_id", F.inline_outer("events")).filter("event_id IS NOT NULL")


def study_records(scored: DataFrame, bucket: str) -> DataFrame:
    """Studies with flags, status, alerts, events and their report ``document``.

    ``scored`` needs study_id, created_at, original_filename, file_size_bytes,
    prediction_class, confidence, mean_intensity and contrast. What an image upload
    adds (content type, checksum, probabilities, model) is taken where present.
    """
    optional = {
        "content_type": F.lit("application/octet-stream"),
        "checksum_sha256": F.lit(""),
        "image_object_key": F.lit(None).cast("string"),
        "probabilities": F.create_map().cast("map<string,double>"),
        "model_name": F.lit("unknown"),
        "model_version": F.lit("unknown"),
        "model_family": F.lit("unknown"),
    }
    filled = scored.withColumns({c: v for c, v in optional.items() if c not in scored.columns})
    filled = filled.withColumns(
        {
            "report_object_key": report_key("radiology", F.col("study_id")),
            "image_bucket": F.lit(bucket),
            "report_bucket": F.lit(bucket),
            "explanation": lookup(F.col("prediction_class"), domain.EXPLANATIONS, F.lit("")),
        }
    )
    flagged = study_events(study_alerts(quality_status(quality_flags(filled))))
    prediction = F.struct(
        "model_name",
        "model_version",
        "model_family",
        F.col("prediction_class").alias("class"),
        "probabilities",
        "confidence",
        F.struct(
            arrays.round_exact(F.col("mean_intensity"), 2).alias("mean_intensity"),
            arrays.round_exact(F.col("contrast"), 2).alias("contrast"),
            F.col("file_size_bytes").alias("input_size_bytes"),
        ).alias("features"),
        F.col("quality_messages").alias("quality_flags"),
        "explanation",
        F.lit(domain.RADIOLOGY_NOTE).alias("clinical_note"),
    )
    report = F.struct(
        "study_id",
        iso_time(F.col("created_at")).alias("created_at"),
        F.struct(
            "original_filename",
            "content_type",
            "file_size_bytes",
            "checksum_sha256",
            F.col("image_bucket").alias("bucket"),
            F.col("image_object_key").alias("object_key"),
        ).alias("image"),
        prediction.alias("prediction"),
        F.struct(
            F.col("quality_status").alias("status"), F.col("quality_messages").alias("messages")
        ).alias("quality"),
        F.struct("report_object_key", "alerts").alias("automation"),
    )
    return flagged.withColumns({"model_response": document(prediction), "document": document(report)})


def study_detail(records: DataFrame) -> DataFrame:
    """Full projection of stored studies, the model nested as name, version, response."""
    model = F.struct(
        F.col("model_name").alias("name"),
        F.col("model_version").alias("version"),
        F.col("model_response").alias("response"),
    )
    return records.select(
        F.col("id").alias("study_id"),
        iso_time(F.col("created_at")).alias("created_at"),
        "original_filename",
        "content_type",
        "file_size_bytes",
        "checksum_sha256",
        "image_bucket",
        "image_object_key",
        "prediction_class",
        "probabilities",
        model.alias("model"),
        "confidence",
        "quality_status",
        "quality_messages",
        "report_bucket",
        "report_object_key",
    )
