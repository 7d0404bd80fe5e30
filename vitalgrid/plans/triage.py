"""Queries over triage requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitalgrid import domain
from vitalgrid.functions import arrays
from vitalgrid.operators import metrics, presentation, triage
from vitalgrid.plans.registry import query
from vitalgrid.plans.views import case, joined, number, quoted, round_exact as sql_round, strip, text_list
from vitalgrid.session import scratch_path
from vitalgrid.sources import clinical, registered, tables

# a stand-in for the importances of a trained forest: earlier features weigh more
IMPORTANCES = [round(0.12 - 0.007 * i, 4) for i in range(len(domain.FEATURES))]
NOISE_RATE, NOISE_SEED = 0.06, 42


def requests(spark, d):
    return clinical.triage_requests(spark, d)


def spread_requests(spark, d):
    """For queries with long work on each row."""
    return clinical.triage_requests(spark, d, over_cores=1)


def scores(spark, d):
    return clinical.logits(spark, d).select("vec_id", arrays.softmax(F.col("risk_logits")).alias("probabilities"))


def assessed(spark, d):
    return triage.assess(clinical.scored_triage_requests(spark, d, scores(spark, d)), importances=IMPORTANCES)


def _form_check() -> tuple[str, str]:
    values, errors = [], []
    for name, (default, low, high) in domain.VITAL_RANGES.items():
        blank = f"{strip(name)} = ''"
        n = number(f"replace({strip(name)}, ',', '.')")
        values.append(f"CASE WHEN {blank} THEN {default!r}e0 WHEN {n} >= {low} AND {n} <= {high} THEN {n} END AS {name}_value")
        errors.append(
            f"CASE WHEN {blank} THEN NULL WHEN {n} IS NULL THEN {quoted(domain.NOT_NUMERIC % name)} "
            f"WHEN {n} < {low} OR {n} > {high} THEN {quoted(domain.OUT_OF_RANGE % (name, low, high))} END"
        )
    return ", ".join(values), "coalesce(" + ", ".join(errors) + ")"


_VALUES, _ERROR = _form_check()


@query("vitals_validate", f"SELECT triage_id, {_VALUES}, {_ERROR} AS form_error FROM v_triage")
def vitals_validate(spark, d):
    checked = triage.validate_vitals(requests(spark, d))
    return checked.select("triage_id", *[F.col(n).alias(f"{n}_value") for n in domain.VITALS], "form_error")


_COERCED = ", ".join(
    [f"coalesce({number(n)}, {v!r}e0) AS model_{n}" for n, v in domain.MODEL_DEFAULTS.items()]
    + [f"coalesce({number(n)}, {v!r}e0) AS rules_{n}" for n, v in domain.RULE_DEFAULTS.items()]
)


@query("vitals_coerce", f"SELECT triage_id, {_COERCED} FROM v_triage")
def vitals_coerce(spark, d):
    return requests(spark, d).select(
        "triage_id",
        *[triage.lenient_vital(n, v).alias(f"model_{n}") for n, v in domain.MODEL_DEFAULTS.items()],
        *[triage.lenient_vital(n, v).alias(f"rules_{n}") for n, v in domain.RULE_DEFAULTS.items()],
    )


@query("patient_name_required", f"SELECT c_custkey AS patient_id, c_name AS patient_name FROM customer WHERE {strip('c_name')} <> '' AND length(c_name) <= 200")
def patient_name_required(spark, d):
    customers = clinical.table(spark, d, "customer")
    return triage.named_patients(customers.select(F.col("c_custkey").alias("patient_id"), F.col("c_name").alias("patient_name")))


_DIRTY = "list_concat(symptoms, ['fatigue', '', '  ', ' FEVER '])"


def _with_dirty_symptoms(df):
    extra = F.array(F.lit("fatigue"), F.lit(""), F.lit("  "), F.lit(" FEVER "))
    return df.withColumn("symptoms", F.concat("symptoms", extra))


@query("symptom_filter", f"SELECT triage_id, array_to_string(list_filter({_DIRTY}, lambda s: list_contains({text_list(domain.SYMPTOMS)}, s)), ',') AS kept FROM v_triage")
def symptom_filter(spark, d):
    kept = triage.catalogued_symptoms(_with_dirty_symptoms(requests(spark, d)))
    return kept.select("triage_id", F.array_join("symptoms", ",").alias("kept"))


_FOLDED = "list_transform(list_filter({d}, lambda s: {keep}), lambda s: lower({strip}))"


@query("symptom_normalize", f"""
    SELECT triage_id,
           array_to_string(list_sort(list_distinct({_FOLDED.format(d=_DIRTY, keep="s <> ''", strip=strip('s'))})), ',') AS for_rules,
           array_to_string(list_sort(list_distinct({_FOLDED.format(d=_DIRTY, keep=strip('s') + " <> ''", strip=strip('s'))})), ',') AS for_model
    FROM v_triage""")
def symptom_normalize(spark, d):
    rows = _with_dirty_symptoms(spread_requests(spark, d))
    return rows.select(
        "triage_id",
        F.array_join(F.array_sort(arrays.symptom_set(F.col("symptoms"))), ",").alias("for_rules"),
        F.array_join(F.array_sort(arrays.symptom_set_strict(F.col("symptoms"))), ",").alias("for_model"),
    )


@query("triage_rules_score", "SELECT triage_id, score FROM v_rules")
def triage_rules_score(spark, d):
    return triage.rules_score(requests(spark, d)).select("triage_id", "score")


@query("triage_rules_risk", f"SELECT triage_id, score, risk_level, recommended_priority, confidence, '{domain.RULES_MODEL_NAME}' AS model_name FROM v_rules")
def triage_rules_risk(spark, d):
    columns = ("triage_id", "score", "risk_level", "recommended_priority", "confidence", "model_name")
    return triage.rules_risk(requests(spark, d)).select(*columns)


@query("news2_score", "SELECT triage_id, CAST(news2 AS INTEGER) AS news2 FROM v_labels")
def news2_score(spark, d):
    return triage.news2_score(requests(spark, d)).select("triage_id", "news2")


@query("news2_severity_label", "SELECT triage_id, CAST(news2 AS INTEGER) AS news2, CAST(red_flags AS INTEGER) AS red_flags, CAST(severity AS INTEGER) AS severity, severity_label FROM v_labels")
def news2_severity_label(spark, d):
    return triage.severity_label(requests(spark, d)).select("triage_id", "news2", "red_flags", "severity", "severity_label")


@query("risk_distribution", """
    SELECT 'rules' AS labelling, risk_level, count(*) AS rows FROM v_labels GROUP BY 2
    UNION ALL SELECT 'news2', severity_label, count(*) FROM v_labels GROUP BY 2""")
def risk_distribution(spark, d):
    both = triage.rules_risk(triage.severity_label(requests(spark, d)))
    of = lambda name, column: triage.risk_distribution(both, column).select(F.lit(name).alias("labelling"), "risk_level", "rows")
    return of("rules", "risk_level").unionByName(of("news2", "severity_label"))


_LEVELS = text_list(domain.RISK_LABELS)
_CUT = f"{int(NOISE_RATE * 16**8):08x}"


@query("label_noise", f"""
    SELECT triage_id, severity_label AS original,
           CASE WHEN substr(draw, 1, 8) < '{_CUT}' THEN {_LEVELS}[CASE WHEN substr(draw, 9, 1) < '8' THEN greatest(place - 1, 1) ELSE least(place + 1, 4) END]
                ELSE severity_label END AS noisy
    FROM (SELECT *, md5('{NOISE_SEED}|' || triage_id) AS draw, list_position({_LEVELS}, severity_label) AS place FROM v_labels) t""")
def label_noise(spark, d):
    labelled = triage.severity_label(requests(spark, d)).select("triage_id", F.col("severity_label").alias("original"), F.col("severity_label").alias("noisy"))
    return triage.label_noise(labelled, "noisy", NOISE_RATE, NOISE_SEED, "triage_id")


_FEATURES = ", ".join(
    [f"CAST(CAST(coalesce({number(n)}, {v!r}e0) AS FLOAT) AS DOUBLE) AS {n}" for n, v in domain.MODEL_DEFAULTS.items()]
    + [f"CAST(symptom_mask & {1 << bit} <> 0 AS DOUBLE) AS symptom_{bit}" for bit in range(len(domain.SYMPTOMS))]
)


@query("feature_vector", f"SELECT triage_id, {_FEATURES} FROM v_triage")
def feature_vector(spark, d):
    vector = triage.feature_vector(spread_requests(spark, d))
    names = [*domain.VITALS, *[f"symptom_{bit}" for bit in range(len(domain.SYMPTOMS))]]
    return vector.select("triage_id", *[F.col("features")[i].alias(name) for i, name in enumerate(names)])


_MODEL = f"""
    SELECT vec_id, risk_level, recommended_priority, score, confidence, {', '.join(f'{sql_round(f"p{i + 1}", 4)} AS p_{risk}' for i, risk in enumerate(domain.RISK_LABELS))}
    FROM v_model"""


@query("model_assessment", _MODEL)
def model_assessment(spark, d):
    result = triage.model_assessment(scores(spark, d))
    return result.select(
        "vec_id", "risk_level", "recommended_priority", "score", "confidence",
        *[F.col("probability_map")[risk].alias(f"p_{risk}") for risk in domain.RISK_LABELS],
    )


@query("assessment_fallback", "SELECT triage_id, score, risk_level, recommended_priority, confidence, model_name FROM v_assess")
def assessment_fallback(spark, d):
    columns = ("triage_id", "score", "risk_level", "recommended_priority", "confidence", "model_name")
    return assessed(spark, d).select(*columns)


_ALERTS = "CASE WHEN certainty IS NULL THEN '' ELSE " + joined([
    f"CASE WHEN risk_level = 'critical' THEN {quoted(domain.ALERT_CRITICAL)} END",
    f"CASE WHEN certainty < 0.55e0 THEN {quoted(domain.ALERT_TRIAGE_CONFIDENCE)} END",
    f"CASE WHEN list_contains(symptoms, 'chest pain') AND risk_level IN ('high', 'critical') THEN {quoted(domain.ALERT_CHEST_PAIN)} END",
]) + " END"


@query("triage_alerts", f"SELECT triage_id, {_ALERTS} AS alerts FROM v_assess")
def triage_alerts(spark, d):
    """Alerts of all answers; those of the rules have none."""
    return triage.triage_alerts(assessed(spark, d)).select("triage_id", F.array_join("alerts", " | ").alias("alerts"))


@query("triage_critical_events", f"""
    SELECT md5(triage_id || '|triage_critical') AS event_id, 'triage' AS source, 'high' AS severity, 'triage_critical' AS event_type,
           {quoted(domain.EVENT_TRIAGE_CRITICAL)} AS message, triage_id, CAST(score AS BIGINT) AS score FROM v_assess WHERE risk_level = 'critical'""")
def triage_critical_events(spark, d):
    return triage.triage_critical_events(assessed(spark, d)).select(
        "event_id", "source", "severity", "event_type", "message",
        F.get_json_object("metadata", "$.triage_id").alias("triage_id"),
        F.get_json_object("metadata", "$.score").cast("long").alias("score"),
    )


_IMPORTANCE = "[" + ", ".join(f"{w!r}e0" for w in IMPORTANCES) + "]"
_VECTOR = (
    "[" + ", ".join([f"CAST(CAST(coalesce({number(n)}, {v!r}e0) AS FLOAT) AS DOUBLE)" for n, v in domain.MODEL_DEFAULTS.items()]
    + [f"CAST(symptom_mask & {1 << bit} <> 0 AS DOUBLE)" for bit in range(len(domain.SYMPTOMS))]) + "]"
)


@query("top_contributors", f"""
    SELECT triage_id, row_number() OVER (PARTITION BY request ORDER BY weight DESC, i DESC) AS rank,
           {text_list(domain.FEATURES)}[i] AS feature, {sql_round("importance", 4)} AS importance, {sql_round("v", 2)} AS value
    FROM (SELECT request, triage_id, i, {_IMPORTANCE}[i] AS importance, features[i] AS v, CASE WHEN features[i] <> 0 THEN {_IMPORTANCE}[i] ELSE 0e0 END AS weight
          FROM (SELECT request, triage_id, features, unnest(range(1, {len(domain.FEATURES) + 1})) AS i
                FROM (SELECT row_number() OVER () AS request, triage_id, {_VECTOR} AS features FROM v_triage) s) t) u
    QUALIFY rank <= 3""")
def top_contributors(spark, d):
    ranked = triage.top_contributors(triage.feature_vector(spread_requests(spark, d)), IMPORTANCES)
    exploded = ranked.select("triage_id", F.posexplode_outer("contributors").alias("position", "c"))
    return exploded.select("triage_id", (F.col("position") + 1).cast("long").alias("rank"), "c.*")


_COMPLETE = f"(SELECT *, {_VECTOR} AS features FROM v_assess) x"  # ids repeat, so nothing is joined by them
_CONTRIBUTORS = (
    f"CASE WHEN certainty IS NOT NULL THEN list_transform(list_slice(list_reverse_sort(list_transform(range(1, {len(domain.FEATURES) + 1}), "
    f"lambda i: {{'w': CASE WHEN features[i] <> 0 THEN {_IMPORTANCE}[i] ELSE 0e0 END, 'i': i}})), 1, 3), lambda s: {text_list(domain.FEATURES)}[s.i]) END"
)
_MODEL_ONLY = ", ".join(
    f"CASE WHEN certainty IS NOT NULL THEN {quoted(text)} END AS {name}"
    for name, text in (("model_version", "1.0.0"), ("model_family", "random_forest_isotonic_calibration"), ("clinical_note", domain.TRIAGE_NOTE))
)


_SAID = (
    "triage_id STRING, request STRUCT<symptoms: ARRAY<STRING>, vitals: STRUCT<heart_rate: STRING>>, "
    "assessment STRUCT<risk_level: STRING, model_version: STRING, model_family: STRING, clinical_note: STRING, "
    "top_contributors: ARRAY<STRUCT<feature: STRING>>, probabilities: STRUCT<critical: DOUBLE>, alerts: ARRAY<STRING>>"
)


@query("register_triage", f"""
    SELECT triage_id AS id, 'PAC-' || upper(substr(md5('patient|' || triage_id), 1, 8)) AS patient_id, patient_name, risk_level,
           recommended_priority, score, confidence, 'triage-reports/' || triage_id || '.json' AS report_object_key,
           triage_id AS document_id, risk_level AS document_risk, CAST(len(symptoms) AS INTEGER) AS document_symptoms, heart_rate AS document_heart_rate,
           {_MODEL_ONLY}, ({_CONTRIBUTORS})[1] AS first_contributor, {sql_round("p4", 4)} AS p_critical,
           CASE WHEN certainty IS NOT NULL THEN CAST(len(string_split({_ALERTS}, ' | ')) - CASE WHEN ({_ALERTS}) = '' THEN 1 ELSE 0 END AS INTEGER) END AS n_alerts
    FROM {_COMPLETE}""")
def register_triage(spark, d):
    """Records as stored, each with what its document says."""
    store = scratch_path(spark, "triage")
    registered.register_triages(triage.triage_records(assessed(spark, d), "clinical-reports"), store, "batch-1")
    said = F.from_json("document", _SAID)  # one pass over a text, however many of its parts are wanted
    about = ("model_version", "model_family", "clinical_note")
    return registered.load_triages(spark, store).withColumn("_said", said).select(
        "id", "patient_id", "patient_name", "risk_level", "recommended_priority", "score", "confidence", "report_object_key",
        F.col("_said.triage_id").alias("document_id"),
        F.col("_said.assessment.risk_level").alias("document_risk"),
        F.array_size("_said.request.symptoms").alias("document_symptoms"),
        F.col("_said.request.vitals.heart_rate").alias("document_heart_rate"),
        *[F.col(f"_said.assessment.{name}").alias(name) for name in about],
        F.get("_said.assessment.top_contributors", F.lit(0))["feature"].alias("first_contributor"),
        F.col("_said.assessment.probabilities.critical").alias("p_critical"),
        F.array_size("_said.assessment.alerts").alias("n_alerts"),
    )


@query("triage_append", """
    SELECT triage_id AS id, risk_level, recommended_priority, score, confidence, 'clinical-reports' AS report_bucket FROM v_rules""")
def triage_append(spark, d):
    store = scratch_path(spark, "triage-rows")
    tables.append(triage.triage_records(triage.rules_risk(requests(spark, d)), "clinical-reports"), store, "triage_records", "batch-1")
    return tables.load(spark, store, "triage_records").select("id", "risk_level", "recommended_priority", "score", "confidence", "report_bucket")


@query("triage_by_id", """
    SELECT triage_id, score, risk_level FROM v_rules WHERE triage_id IN (SELECT triage_id FROM v_rules WHERE ref_id IN (SELECT vec_id FROM v_logits))""")
def triage_by_id(spark, d):
    """Lookup of the requests that a model has scored, as a list of ids."""
    rows = triage.rules_risk(requests(spark, d)).select("triage_id", "score", "risk_level")
    wanted = requests(spark, d).join(clinical.logits(spark, d), F.col("ref_id") == F.col("vec_id"), "left_semi").select("triage_id")
    return metrics.rows_by_id(rows, wanted, "triage_id")


@query("priority_map", f"SELECT triage_id, risk_level, {case('risk_level', domain.PRIORITY_BY_RISK, quoted('standard'))} AS recommended_priority FROM v_labels")
def priority_map(spark, d):
    return triage.with_priority(triage.rules_risk(requests(spark, d)).select("triage_id", "risk_level"))


@query("display_labels", f"""
    SELECT triage_id, {case('risk_level', domain.RISK_DISPLAY)} AS risk_display, {case('recommended_priority', domain.PRIORITY_DISPLAY)} AS priority_display FROM v_rules""")
def display_labels(spark, d):
    scored = triage.rules_risk(requests(spark, d))
    shown = presentation.with_display_labels(presentation.with_display_labels(scored, "risk", "risk_level"), "priority", "recommended_priority")
    return shown.select("triage_id", "risk_display", "priority_display")


_PERCENTS = ", ".join(f"coalesce({sql_round('(' + sql_round(f'p{i + 1}', 4) + ') * 100e0', 2)}, 0e0) AS percent_{risk}" for i, risk in enumerate(domain.RISK_LABELS))


@query("triage_view", f"""
    SELECT triage_id, patient_name, risk_level, {case('risk_level', domain.RISK_DISPLAY)} AS risk_display, recommended_priority AS priority,
           {case('recommended_priority', domain.PRIORITY_DISPLAY)} AS priority_display, {sql_round("confidence * 100e0", 1)} AS confidence,
           {_ALERTS} AS alerts, score, model_name, {_MODEL_ONLY}, array_to_string({_CONTRIBUTORS}, ',') AS contributors, {_PERCENTS}
    FROM {_COMPLETE}""")
def triage_view(spark, d):
    view = presentation.triage_view(assessed(spark, d))
    shown = {"alerts": F.array_join("alerts", " | "), "contributors": F.array_join(F.col("contributors.feature"), ",")}
    percents = [F.col("probability_rows")[i]["percent"].alias(f"percent_{risk}") for i, risk in enumerate(domain.RISK_LABELS)]
    return view.withColumns(shown).select(
        "triage_id", "patient_name", "risk_level", "risk_display", "priority", "priority_display", "confidence", "alerts", "score", "model_name",
        "model_version", "model_family", "clinical_note", "contributors", *percents,
    )


@query("risk_probability_rows", f"""
    SELECT vec_id, label, {sql_round("value * 100e0", 2)} AS percent, label AS tone, {case('label', domain.RISK_DISPLAY)} AS display
    FROM (SELECT vec_id, {_LEVELS}[i] AS label, [{', '.join(sql_round(f'p{i}', 4) for i in range(1, 5))}][i] AS value
          FROM (SELECT *, unnest([1, 2, 3, 4]) AS i FROM v_probs) t) u""")
def risk_probability_rows(spark, d):
    rows = presentation.probability_rows(triage.model_assessment(scores(spark, d)), "vec_id", "probability_map", domain.RISK_LABELS)
    return rows.select("vec_id", "label", "percent", "tone", "display")
