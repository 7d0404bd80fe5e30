"""Display projections: texts for codes, probability rows, triage and prediction views."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalgrid import domain
from vitalgrid.functions.arrays import lookup
from vitalgrid.functions.numeric import clamp, parse_number, percent
from vitalgrid.functions.text import capitalized
from vitalgrid.sources.readers import PREDICTION_PAYLOAD

_DIMENSIONS = {
    "risk": (domain.RISK_DISPLAY, domain.RISK_MISSING),
    "priority": (domain.PRIORITY_DISPLAY, domain.PRIORITY_MISSING),
}


def display_text(code: Column, dimension: str) -> Column:
    """Text of a risk or priority code; unknown codes are capitalised, blank ones replaced."""
    table, missing = _DIMENSIONS[dimension]
    folded = F.lower(F.coalesce(code, F.lit("")))
    fallback = F.when(folded == "", missing).otherwise(capitalized(folded))
    return lookup(folded, table, fallback)


def with_display_labels(df: DataFrame, dimension: str, code_col: str) -> DataFrame:
    """``<dimension>_display``. The texts are constants of the plan, there is no join."""
    return df.withColumn(f"{dimension}_display", display_text(F.col(code_col), dimension))


def with_class_result(df: DataFrame, code_col: str = "prediction_class") -> DataFrame:
    """state, title, icon, description and eyebrow of a predicted class."""
    names = ("state", "title", "icon", "description", "eyebrow")
    code = F.col(code_col)
    return df.withColumns(
        {
            name: lookup(code, {c: texts[i] for c, texts in domain.CLASS_RESULTS.items()}, F.lit(domain.CLASS_PENDING[i]))
            for i, name in enumerate(names)
        }
    )


def probability_rows(
    df: DataFrame, id_col: str, probabilities: str, labels: Sequence[str] = domain.DISPLAY_CLASSES
) -> DataFrame:
    """One row per label in fixed order, values clamped to 0..1, absent ones zero.

    ``probabilities`` is a map; labels outside the list are left out.
    """
    rows = df.select(id_col, probabilities, F.posexplode(F.array(*[F.lit(l) for l in labels])).alias("position", "label"))
    raw = F.coalesce(F.try_element_at(F.col(probabilities), F.col("label")), F.lit(0.0))
    valued = rows.select(id_col, "position", "label", clamp(raw, 0.0, 1.0).alias("value"))
    tones = {**domain.CLASS_TONES, **{risk: risk for risk in domain.RISK_LABELS}}
    return valued.withColumns(
        {
            "percent": percent(F.col("value"), 2),
            "tone": lookup(F.col("label"), tones),
            "display": lookup(F.col("label"), domain.RISK_DISPLAY, F.col("label")),
        }
    )


def risk_probability_array(probabilities: Column, labels: Sequence[str] = domain.RISK_LABELS) -> Column:
    """The rows of ``probability_rows`` for risk levels, as an array; all zero for a NULL map."""

    def row(label: str) -> Column:
        value = clamp(F.coalesce(F.try_element_at(probabilities, F.lit(label)), F.lit(0.0)), 0.0, 1.0)
        display = F.lit(domain.RISK_DISPLAY.get(label, label.capitalize()))
        return F.struct(F.lit(label).alias("label"), display.alias("display"), F.lit(label).alias("tone"), value.alias("value"), percent(value, 2).alias("percent"))

    return F.array(*[row(label) for label in labels])


def triage_view(assessed: DataFrame) -> DataFrame:
    """Display projection of an assessment: texts, confidence percent, probability rows, the rest as is."""
    risk = F.lower(F.coalesce("risk_level", F.lit("")))
    priority = F.lower(F.coalesce("recommended_priority", F.lit("")))
    passed = [
        c for c in (
            "contributors", "alerts", "model_name", "model_version", "model_family", "score",
            "triage_id", "patient_id", "patient_name", "clinical_note",
        ) if c in assessed.columns
    ]
    shown = [risk_probability_array(F.col("probability_map")).alias("probability_rows")] if "probability_map" in assessed.columns else []
    return assessed.select(
        *passed,
        *shown,
        risk.alias("risk_level"),
        display_text(F.col("risk_level"), "risk").alias("risk_display"),
        priority.alias("priority"),
        display_text(F.col("recommended_priority"), "priority").alias("priority_display"),
        percent(F.coalesce("confidence", F.lit(0.0)), 1).alias("confidence"),
    )


#: Kinds of JSON values, as variants name them.
_NUMBER_KINDS = r"^(BIGINT|DOUBLE|FLOAT|DECIMAL\(.*\)|TINYINT|SMALLINT|INT)$"


def check_prediction_payloads(df: DataFrame, payload: str) -> DataFrame:
    """Parsed ``prediction``, its ``shares`` as numbers, and ``is_valid`` of JSON texts.

    Valid means that the class is a JSON text and the probabilities an object, each of whose
    values is a number, a truth value or a text that reads as a number. Whether 5 was written
    as a number or as a text is looked up in the JSON itself.
    """
    whole = F.try_parse_json(F.col(payload))
    of = lambda path, kind: F.try_variant_get(F.col("_json"), f"$.{path}", kind)
    kind = lambda v: F.coalesce(F.schema_of_variant(v), F.lit("VOID"))

    def share(v: Column) -> Column:
        text = F.try_variant_get(v, "$", "string")
        number = F.when(kind(v).rlike(_NUMBER_KINDS), F.try_variant_get(v, "$", "double"))
        return number.when(kind(v) == "BOOLEAN", F.try_variant_get(v, "$", "boolean").cast("double")).when(kind(v) == "STRING", parse_number(text))

    parsed = df.withColumn("_json", whole).withColumns(
        {
            "prediction": F.from_json(payload, PREDICTION_PAYLOAD),
            "shares": F.transform_values(of("probabilities", "map<string,variant>"), lambda _, v: share(v)),
        }
    )
    is_text = kind(of("class", "variant")) == "STRING"
    is_object = kind(of("probabilities", "variant")).startswith("OBJECT")
    numeric = F.forall(F.map_values("shares"), lambda v: v.isNotNull())
    return parsed.withColumn("is_valid", F.coalesce(is_text & is_object & numeric, F.lit(False))).drop("_json")
