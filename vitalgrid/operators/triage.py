"""Triage requests: validation, rule scores, early-warning labels, model assessment.

Requests have ``symptoms`` (array of texts) and ``vitals`` (map or struct of texts).
Everything here is row-local, apart from the join in ``assess``.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalgrid import domain
from vitalgrid.functions import arrays, numeric
from vitalgrid.functions.arrays import literals, lookup, nth, present
from vitalgrid.functions.numeric import comparable, parse_number, round_exact
from vitalgrid.functions.records import document, iso_time
from vitalgrid.functions.text import fold, patient_code, report_key, strip


def vital(name: str) -> Column:
    return F.col("vitals")[name].cast("string")


def lenient_vital(name: str, default: float) -> Column:
    """Number of a vital; anything that is not one counts as ``default``."""
    return F.coalesce(parse_number(vital(name)), F.lit(float(default)))


def parsed(df: DataFrame) -> DataFrame:
    """``df`` with what labels and features both begin with, the model's vitals as numbers and the symptom set:
    ``severity_label`` and ``feature_vector`` use the columns where they are there, and derive it otherwise."""
    numbers = {f"_number_{name}": lenient_vital(name, value) for name, value in domain.MODEL_DEFAULTS.items()}
    return df.withColumns({**numbers, "_symptom_set": arrays.symptom_set_strict(_symptoms())})


def _model_vital(df: DataFrame, name: str) -> Column:
    return F.col(f"_number_{name}") if f"_number_{name}" in df.columns else lenient_vital(name, domain.MODEL_DEFAULTS[name])


def _symptom_set(df: DataFrame) -> Column:
    return F.col("_symptom_set") if "_symptom_set" in df.columns else arrays.symptom_set_strict(_symptoms())


def _staged(df: DataFrame, defaults: Mapping[str, float]) -> DataFrame:
    """Columns ``_<vital>`` with NaN as NULL, parsed once however often they are compared."""
    return df.withColumns({f"_{n}": comparable(lenient_vital(n, v)) for n, v in defaults.items()})


def coerce_vitals(df: DataFrame, defaults: Mapping[str, float] = domain.MODEL_DEFAULTS) -> DataFrame:
    """One double column per vital in ``defaults``."""
    return df.withColumns({name: lenient_vital(name, value) for name, value in defaults.items()})


def validate_vitals(df: DataFrame) -> DataFrame:
    """Form values per vital (NULL where invalid) and ``form_error``, the first error.

    Blank means the default, a comma is a decimal point. The name is checked before the
    vitals, those in catalogue order. The texts are picked by number at the end, which
    keeps the generated code small enough for the JVM to compile.
    """
    numbers, blanks, values, codes, messages = {}, {}, {}, [], []
    for name, (default, low, high) in domain.VITAL_RANGES.items():
        number, blank = F.col(f"_number_{name}"), F.col(f"_blank_{name}")
        numbers[f"_number_{name}"] = parse_number(F.replace(vital(name), F.lit(","), F.lit(".")))
        blanks[f"_blank_{name}"] = number.isNull() & (F.coalesce(strip(vital(name)), F.lit("")) == "")
        inside = number.between(low, high) | F.isnan(number)
        values[name] = F.when(blank, F.lit(default)).when(inside, number)
        messages += [domain.NOT_NUMERIC % name, domain.OUT_OF_RANGE % (name, low, high)]
        wrong = F.when(number.isNull(), len(messages) - 1).otherwise(len(messages))
        codes.append(F.when(F.col(name).isNull(), wrong))
    error = F.when(~valid_name(), domain.NAME_REQUIRED).otherwise(
        nth(literals(messages), F.coalesce(*codes))
    )
    parsed = df.withColumns(numbers).withColumns(blanks).withColumns(values)
    return parsed.withColumn("form_error", error).drop(*numbers, *blanks)


def valid_name() -> Column:
    return F.coalesce(strip(F.col("patient_name")) != "", F.lit(False))


def named_patients(df: DataFrame) -> DataFrame:
    """Requests whose patient name is there and not longer than allowed."""
    return df.filter(valid_name() & (F.length("patient_name") <= domain.NAME_MAX_LENGTH))


def catalogued_symptoms(df: DataFrame) -> DataFrame:
    return df.withColumn("symptoms", arrays.catalogued(F.col("symptoms"), domain.SYMPTOMS))


# --- additive rules --------------------------------------------------------------


def rules_score(df: DataFrame) -> DataFrame:
    """``score`` 0..100: points for symptoms, for a red flag, and for three vitals."""

    def bonus(condition: Column, points: int) -> Column:
        return F.when(condition, points).otherwise(0)

    reported = F.col("_reported")
    points = [
        F.least(F.lit(domain.SYMPTOM_POINTS_CAP), F.size(reported) * domain.POINTS_PER_SYMPTOM),
        bonus(F.arrays_overlap(reported, literals(domain.RULE_RED_FLAGS)), domain.RED_FLAG_POINTS),
        bonus(F.col("_heart_rate") >= domain.HEART_RATE_AT_LEAST, domain.HEART_RATE_POINTS),
        bonus(F.col("_oxygen_saturation") < domain.OXYGEN_BELOW, domain.OXYGEN_POINTS),
        bonus(F.col("_systolic_bp") < domain.PRESSURE_BELOW, domain.PRESSURE_POINTS),
    ]
    staged = _staged(df, domain.RULE_DEFAULTS).withColumn("_reported", arrays.symptom_set(_symptoms()))
    scored = staged.withColumn("score", F.least(F.lit(domain.SCORE_CAP), reduce(add, points)))
    return scored.drop("_reported", *[f"_{name}" for name in domain.RULE_DEFAULTS])


def rules_risk(df: DataFrame) -> DataFrame:
    """Rule assessment: score, risk level, priority, confidence, model name."""
    score = F.col("score")
    highest, *others = domain.RISK_FROM_SCORE
    level = F.when(score >= highest[0], highest[1])
    for lowest_score, risk in others:
        level = level.when(score >= lowest_score, risk)
    certainty = F.least(
        F.lit(domain.CONFIDENCE_CEILING),
        F.lit(domain.CONFIDENCE_BASE) + score / F.lit(float(domain.CONFIDENCE_DIVISOR)),
    )
    scored = rules_score(df)
    scored = scored.withColumns({"risk_level": level, "confidence": round_exact(certainty, 2)})
    return with_priority(scored).withColumn("model_name", F.lit(domain.RULES_MODEL_NAME))


def with_priority(df: DataFrame, risk_col: str = "risk_level") -> DataFrame:
    priority = lookup(F.col(risk_col), domain.PRIORITY_BY_RISK, F.lit(domain.DEFAULT_PRIORITY))
    return df.withColumn("recommended_priority", priority)


# --- early-warning score and labels ----------------------------------------------


def band_points(value: Column, bands: Mapping[str, Sequence]) -> Column:
    """Points of the first band that holds, low side before high side; 0 for none."""
    tests = [(value <= limit, points) for limit, points in bands["up_to"]]
    tests += [(value >= limit, points) for limit, points in bands["from"]]
    chain = F.when(*tests[0])
    for condition, points in tests[1:]:
        chain = chain.when(condition, points)
    return chain.otherwise(0)


def news2_score(df: DataFrame) -> DataFrame:
    """``news2`` from the coerced vitals of the request."""
    return _with_news2(df).drop(*[f"_{name}" for name in domain.VITALS])


def _with_news2(df: DataFrame) -> DataFrame:
    points = [band_points(F.col(f"_{name}"), bands) for name, bands in domain.EARLY_WARNING_BANDS.items()]
    staged = df.withColumns({f"_{name}": comparable(_model_vital(df, name)) for name in domain.MODEL_DEFAULTS})
    return staged.withColumn("news2", reduce(add, points))


def severity_label(df: DataFrame) -> DataFrame:
    """``severity_label`` from news2, red flags, age and oxygen saturation."""
    reported = _symptom_set(df)
    severity = (
        F.col("news2")
        + F.col("red_flags") * domain.SEVERITY_RED_FLAG_POINTS
        + F.when(F.col("_age") >= domain.SEVERITY_AGE, domain.SEVERITY_AGE_POINTS).otherwise(0)
    )
    override = (F.col("red_flags") >= domain.CRITICAL_RED_FLAGS) | (
        F.col("_oxygen_saturation") <= domain.CRITICAL_OXYGEN
    )
    label = F.when(override, "critical")
    for threshold, name in domain.SEVERITY_LEVELS:
        label = label.when(F.col("severity") >= threshold, name)
    prepared = _with_news2(df).withColumn(
        "red_flags", F.size(F.array_intersect(reported, literals(domain.LABEL_RED_FLAGS)))
    )
    labelled = prepared.withColumn("severity", severity).withColumn("severity_label", label.otherwise("low"))
    return labelled.drop(*[f"_{name}" for name in domain.VITALS])


def _symptoms() -> Column:
    return F.coalesce(F.col("symptoms"), F.array().cast("array<string>"))


def risk_distribution(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.col(column).alias("risk_level")).agg(F.count(F.lit(1)).alias("rows"))


def label_noise(
    df: DataFrame, column: str, rate: float, seed: int, id_col: str, labels: Sequence[str] = domain.RISK_LABELS
) -> DataFrame:
    """Move a ``rate`` of the labels one step up or down, kept within the ends.

    The draw is a hash of seed and id: the same rows move however the data is
    partitioned. Eight hex digits decide whether, the next one which way.
    """
    draw = F.md5(F.concat(F.lit(f"{seed}|"), F.col(id_col).cast("string")))
    cut = f"{min(int(rate * 16**8), 16**8 - 1):08x}"
    moves = (F.substring(draw, 1, 8) < cut) if rate < 1 else F.lit(True)
    down = F.substring(draw, 9, 1) < "8"
    position = F.array_position(literals(labels), F.col(column)).cast("int")
    target = F.when(down, F.greatest(position - 1, F.lit(1))).otherwise(
        F.least(position + 1, F.lit(len(labels)))
    )
    return df.withColumn(column, F.when(moves & (position > 0), nth(literals(labels), target)).otherwise(F.col(column)))


# --- features and model assessment -----------------------------------------------


def feature_columns(df: DataFrame) -> DataFrame:
    """One double column per model feature, single-precision values."""
    single = {name: lenient_vital(name, default).cast("float").cast("double") for name, default in domain.MODEL_DEFAULTS.items()}
    hot = {
        f"symptom__{name}": F.array_contains("_reported", name).cast("double") for name in domain.SYMPTOMS
    }
    return df.withColumn("_reported", arrays.symptom_set_strict(_symptoms())).withColumns({**single, **hot}).drop("_reported")


def feature_vector(df: DataFrame, where: Column | None = None) -> DataFrame:
    """``features``: the model's doubles in their fixed order; computed only ``where`` it is true, if given."""
    only = (lambda value: value) if where is None else (lambda value: F.when(where, value))
    prepared = df.withColumn("_reported", only(_symptom_set(df)))
    items = [_model_vital(df, name).cast("float").cast("double") for name in domain.MODEL_DEFAULTS]
    items += [F.array_contains("_reported", name).cast("double") for name in domain.SYMPTOMS]
    return prepared.withColumn("features", only(F.array(*items))).drop("_reported")


def model_assessment(scored: DataFrame, labels: Sequence[str] = domain.RISK_LABELS) -> DataFrame:
    """Risk, priority, score, confidence and rounded probabilities from ``probabilities``.

    ``certainty`` keeps the unrounded confidence: alerts compare that one.
    """
    k = len(labels)
    placed = scored.withColumns(
        {
            "_class": arrays.first_greatest(F.col("probabilities")),
            "certainty": F.array_max("probabilities"),
        }
    )
    scaled = F.rint(F.col("certainty") * F.lit(100.0) * F.col("_class") / F.lit(float(k)))
    result = placed.withColumns(
        {
            "risk_level": nth(literals(labels), F.col("_class")),
            "score": numeric.clamp(scaled, 0.0, 100.0).cast("int"),
            "confidence": round_exact(F.col("certainty"), 4),
            "probability_map": F.map_from_arrays(literals(labels), arrays.rounded(F.col("probabilities"), 4)),
        }
    )
    return with_priority(result).drop("_class")


def triage_alerts(scored: DataFrame) -> DataFrame:
    """``alerts`` in fixed order, for rows with risk_level, certainty and symptoms.

    Only a model's answer, which has a ``certainty``, carries alerts; the rules' has none.
    """
    folded = F.transform(_symptoms(), fold)
    found = present(
        F.when(F.col("risk_level") == "critical", domain.ALERT_CRITICAL),
        F.when(F.col("certainty") < domain.LOW_CONFIDENCE, domain.ALERT_TRIAGE_CONFIDENCE),
        F.when(
            F.array_contains(folded, "chest pain") & F.col("risk_level").isin("high", "critical"),
            domain.ALERT_CHEST_PAIN,
        ),
    )
    by_model = F.col("certainty").isNotNull()
    return scored.withColumn("alerts", F.when(by_model, found).otherwise(F.array().cast("array<string>")))


def top_contributors(
    df: DataFrame, importances: Sequence[float], k: int = 3, features: Sequence[str] = domain.FEATURES, where: Column | None = None
) -> DataFrame:
    """``contributors``: the ``k`` most important features that are not zero in the row.

    Where none of them carries weight the plain importances rank. Ties go to the later
    feature. Rows on which ``where`` is not true get NULL, and nothing is computed for them.
    """
    only = (lambda value: value) if where is None else (lambda value: F.when(where, value))
    nothing = F.array().cast("array<struct<feature:string,importance:double,value:double>>")
    if not importances:
        return df.withColumn("contributors", only(nothing))
    # importances are known when the plan is made, and so is the order of the features
    order = sorted(range(len(features)), key=lambda i: (-importances[i], -i))

    def item(place: int) -> Column:
        return F.struct(F.lit(features[place]).alias("feature"), F.lit(round(float(importances[place]), 4)).alias("importance"), F.get("features", F.lit(place)).alias("value"))

    def those(places: Sequence[int], test: Callable[[Column], Column]) -> Column:
        """Items of the features whose value passes, in the order of ``places``."""
        return F.array_compact(F.array(*[F.when(test(F.get("features", F.lit(i))), item(i)) for i in places]))

    weighty = [i for i in order if importances[i] > 0]
    set_ = those(weighty, lambda v: v != 0) if weighty else nothing
    light = sorted(set(range(len(features))) - set(weighty), reverse=True)
    rest = F.concat(*[those([i], (lambda v: F.lit(True)) if i in light else (lambda v: v == 0)) for i in range(len(features) - 1, -1, -1)])
    plain = F.array(*[item(i) for i in order[:k]])
    ranked = F.when(F.size("_set") >= k, F.slice("_set", 1, k)).when(F.size("_set") == 0, plain).otherwise(F.slice(F.concat("_set", rest), 1, k))
    rounded = F.transform("_ranked", lambda x: F.struct(x["feature"].alias("feature"), x["importance"].alias("importance"), round_exact(x["value"], 2).alias("value")))
    return df.withColumn("_set", only(set_)).withColumn("_ranked", only(ranked)).withColumn("contributors", only(rounded)).drop("_set", "_ranked")


def model_answer(scored: DataFrame, importances: Sequence[float] = ()) -> DataFrame:
    """All a model says of rows with ``features`` and ``probabilities``."""
    answered = top_contributors(triage_alerts(model_assessment(scored)), importances)
    return answered.withColumns({name: F.lit(value) for name, value in _ABOUT_MODEL.items()})


_ABOUT_MODEL = {
    "model_name": domain.FOREST_MODEL_NAME,
    "model_version": domain.FOREST_MODEL_VERSION,
    "model_family": domain.FOREST_MODEL_FAMILY,
    "clinical_note": domain.TRIAGE_NOTE,
}


def assess(
    requests: DataFrame, scores: DataFrame | None = None, request_key: str = "ref_id", score_key: str = "vec_id", importances: Sequence[float] = ()
) -> DataFrame:
    """Model assessment where ``scores`` has probabilities for the request, else rules.

    The model's answer comes with version, family, contributors (from the ``importances`` of
    its features), alerts and note; on rows answered by the rules these are NULL or empty.
    ``scores`` holds one row per key. The join has no hint: Spark broadcasts scores it
    knows to be small, and otherwise splits the requests of a frequent key at run time. It
    comes before anything is derived, since it may move the rows. Without ``scores`` the
    requests have ``probabilities`` already, from a join of narrower rows.
    """
    joined = requests
    if scores is not None:
        keyed = scores.select(F.col(score_key).alias("_key"), F.col("probabilities"))
        joined = requests.join(keyed, F.col(request_key) == F.col("_key"), "left")
    joined = rules_risk(joined)
    rules = ["score", "risk_level", "confidence", "recommended_priority", "model_name"]
    renamed = joined.withColumnsRenamed({name: f"_rules_{name}" for name in rules})
    both = model_assessment(renamed).withColumn("model_name", F.lit(domain.FOREST_MODEL_NAME))
    by_model = F.col("probabilities").isNotNull()
    merged = both.withColumns(
        {name: F.when(by_model, F.col(name)).otherwise(F.col(f"_rules_{name}")) for name in rules}
    )
    about = {name: F.lit(value) for name, value in _ABOUT_MODEL.items() if name != "model_name"}
    ranked = top_contributors(feature_vector(triage_alerts(merged), by_model), importances, where=by_model).drop("features")
    complete = ranked.withColumns({name: F.when(by_model, value) for name, value in about.items()})
    return complete.drop("_key", *[f"_rules_{name}" for name in rules])


def triage_critical_events(triages: DataFrame, id_col: str = "triage_id") -> DataFrame:
    """A high event per triage assessed critical."""
    return triages.filter("risk_level = 'critical'").select(
        F.md5(F.concat(F.col(id_col), F.lit("|triage_critical"))).alias("event_id"),
        "created_at",
        F.lit("triage").alias("source"),
        F.lit("high").alias("severity"),
        F.lit("triage_critical").alias("event_type"),
        F.lit(domain.EVENT_TRIAGE_CRITICAL).alias("message"),
        document(F.struct(F.col(id_col).alias("triage_id"), F.col("score"))).alias("metadata"),
        F.lit(False).alias("resolved"),
    )


def triage_records(assessed: DataFrame, bucket: str, patient_uuid: Column | None = None) -> DataFrame:
    """Rows of the triage table, and their report ``document``.

    ``patient_uuid`` defaults to a hash of the triage id, so that a rerun repeats it.
    """
    patient_uuid = F.md5(F.concat(F.lit("patient|"), F.col("triage_id"))) if patient_uuid is None else patient_uuid
    request = F.struct("patient_name", "symptoms", "vitals", *(["notes"] if "notes" in assessed.columns else [F.lit(None).cast("string").alias("notes")]))
    basic = ("model_name", "risk_level", "recommended_priority", "score", "confidence")
    of_model = {
        "model_version": "model_version",
        "model_family": "model_family",
        "probability_map": "probabilities",
        "contributors": "top_contributors",
        "alerts": "alerts",
        "clinical_note": "clinical_note",
    }
    by_rules = F.struct(*basic)
    by_model = F.struct(*basic, *[F.col(c).alias(name) for c, name in of_model.items() if c in assessed.columns])
    is_model = F.col("certainty").isNotNull() if "certainty" in assessed.columns else F.lit(True)
    keyed = assessed.withColumns(
        {"patient_id": patient_code(patient_uuid), "report_object_key": report_key("triage", F.col("triage_id"))}
    )

    def report(answer: Column) -> Column:
        return F.struct(
            "triage_id",
            "patient_id",
            "patient_name",
            iso_time(F.col("created_at")).alias("created_at"),
            request.alias("request"),
            answer.alias("assessment"),
        )

    def either(form) -> Column:
        """An answer of the rules has no entries for what only a model says."""
        return F.when(is_model, document(form(by_model))).otherwise(document(form(by_rules)))

    return keyed.select(
        F.col("triage_id").alias("id"),
        "created_at",
        "patient_id",
        "patient_name",
        document(request).alias("request_payload"),
        either(lambda answer: answer).alias("model_response"),
        F.coalesce("risk_level", F.lit("unknown")).alias("risk_level"),
        F.coalesce("recommended_priority", F.lit("unknown")).alias("recommended_priority"),
        F.coalesce("score", F.lit(0)).alias("score"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        F.lit(bucket).alias("report_bucket"),
        "report_object_key",
        either(report).alias("document"),
    )
