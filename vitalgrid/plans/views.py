"""DuckDB text of the clinical inputs, for the cross-engine checks.

``select(sql)`` puts the views that a query names in front of it. Only the checks use
these texts; no operator does.
"""

from __future__ import annotations

import re

from vitalgrid import domain
from vitalgrid.functions.text import WHITE_SPACE

BLANKS = "'" + WHITE_SPACE + "'"
NUMBER = (
    r"[+-]?((\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?"
    r"|[iI][nN][fF]([iI][nN][iI][tT][yY])?|[nN][aA][nN])"
)


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def text_list(values) -> str:
    return "[" + ", ".join(quoted(v) for v in values) + "]"


def strip(x: str) -> str:
    return f"trim({x}, {BLANKS})"


def number(x: str) -> str:
    """Double of a numeric text, else NULL."""
    return f"(CASE WHEN regexp_full_match({strip(x)}, '{NUMBER}') THEN TRY_CAST(replace({strip(x)}, '_', '') AS DOUBLE) END)"


def round_exact(x: str, digits: int) -> str:
    """Nearest decimal of the binary value, halves to even (Dekker's product for the error)."""
    s = f"1e{digits}"
    y = f"(({x})*{s})"
    high = f"((({x})*134217729e0)-((({x})*134217729e0)-({x})))"
    error = f"((({high})*{s}-{y})+(({x})-({high}))*{s})"
    even = f"round_even({y}, 0)"
    tie = f"CASE WHEN {error} > 0 THEN ceil({y}) WHEN {error} < 0 THEN floor({y}) ELSE {even} END"
    return f"((CASE WHEN {y}-floor({y}) = 0.5 THEN {tie} ELSE {even} END)/{s})"


def iso(ts: str) -> str:
    return (
        f"(strftime({ts}, '%Y-%m-%dT%H:%M:%S') || CASE WHEN strftime({ts}, '%f') = '000000' THEN '' "
        f"ELSE '.' || strftime({ts}, '%f') END || '+00:00')"
    )


def case(code: str, table: dict, default: str = "NULL") -> str:
    arms = " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in table.items())
    return f"CASE {code} {arms} ELSE {default} END"


def joined(items: list[str], sep: str = " | ") -> str:
    """Non-NULL texts joined in order, '' for none."""
    return f"array_to_string(list_filter([{', '.join(items)}], lambda t: t IS NOT NULL), '{sep}')"


_SYMPTOM_ITEMS = ", ".join(
    f"CASE WHEN symptom_mask & {1 << bit} <> 0 THEN {quoted(name)} END" for bit, name in enumerate(domain.SYMPTOMS)
)
_HR, _OX, _BP = number("heart_rate"), number("oxygen_saturation"), number("systolic_bp")
_DEFAULTED = {name: f"coalesce({number(name)}, {default!r}e0)" for name, default in domain.MODEL_DEFAULTS.items()}
_COMPLETE = " AND ".join(f"coalesce({c}, '') <> ''" for c in domain.REQUIRED_COLUMNS)
_LABELS = ", ".join(quoted(label) for label in domain.VALID_LABELS)

VIEWS = {
    "v_studies_raw": """
        SELECT 'XR-' || CAST(doc_id AS VARCHAR) AS study_id, CAST(n_chars % 100 AS VARCHAR) AS patient_age,
               CASE WHEN doc_id % 53 = 0 THEN '  ' WHEN doc_id % 2 = 0 THEN 'F' ELSE 'M' END AS patient_sex,
               CASE WHEN doc_id % 41 <> 0 THEN 'uploads/' || md5(text) || '.png' END AS image_object_key,
               CASE lang WHEN 'en' THEN 'Sana' WHEN 'fr' THEN 'Neumonia' WHEN 'de' THEN ' COVID-19 ' ELSE 'Tuberculosis' END AS label,
               '2026-0' || CAST(1 + doc_id % 9 AS VARCHAR) || '-1' || CAST(doc_id % 10 AS VARCHAR) AS acquisition_date,
               source
        FROM documents""",
    "v_studies": "SELECT " + ", ".join(f"trim({c}, ' ') AS {c}" for c in domain.REQUIRED_COLUMNS) + " FROM v_studies_raw",
    "v_assessed": f"""
        SELECT *, coalesce(({_COMPLETE}) AND label IN ({_LABELS}) AND NOT is_duplicate, FALSE) AS is_accepted
        FROM (SELECT *, coalesce(image_object_key, '') <> '' AND
                     count(*) OVER (PARTITION BY image_object_key) > 1 AS is_duplicate FROM v_studies) t""",
    "v_predictions": """
        SELECT 'S-' || CAST(event_id AS VARCHAR) AS study_id, ts AS created_at,
               'scan_' || CAST(event_id AS VARCHAR) || CASE event_id % 5 WHEN 0 THEN '.jpg' WHEN 1 THEN '.JPEG'
                   WHEN 2 THEN '.png' WHEN 3 THEN '.gif' ELSE '' END AS original_filename,
               (event_id * 7919) % 6000000 AS file_size_bytes,
               CASE event_type WHEN 'purchase' THEN 'COVID-19' WHEN 'click' THEN 'Neumonia' WHEN 'error' THEN 'Neumonia'
                   ELSE 'Sana' END AS prediction_class,
               1e0 / (1e0 + value / 100e0) AS confidence, value AS mean_intensity,
               CAST(json_extract_string(props, '$.k') AS DOUBLE) AS contrast,
               'radiology-reports/S-' || CAST(event_id AS VARCHAR) || '.json' AS report_object_key
        FROM events""",
    "v_flagged": f"""
        SELECT *, CASE WHEN messages <> '' THEN 'warning' ELSE 'accepted' END AS quality_status
        FROM (SELECT *, {joined([
            f"CASE WHEN mean_intensity < {domain.DARK_BELOW} THEN {quoted(domain.FLAG_DARK)} END",
            f"CASE WHEN mean_intensity > {domain.BRIGHT_ABOVE} THEN {quoted(domain.FLAG_BRIGHT)} END",
            f"CASE WHEN contrast < {domain.FLAT_BELOW} THEN {quoted(domain.FLAG_FLAT)} END",
            f"CASE WHEN confidence < {domain.LOW_CONFIDENCE}e0 THEN {quoted(domain.FLAG_CONFIDENCE)} END",
        ])} AS messages FROM v_predictions) t""",
    "v_study_events": f"""
        SELECT study_id, created_at, 'high' AS severity, 'clinical_alert' AS event_type, {quoted(domain.EVENT_COVID)} AS message
        FROM v_flagged WHERE prediction_class = 'COVID-19'
        UNION ALL SELECT study_id, created_at, 'medium', 'low_model_confidence', {quoted(domain.EVENT_CONFIDENCE)}
        FROM v_flagged WHERE confidence < 0.55e0
        UNION ALL SELECT study_id, created_at, 'medium', 'image_quality', {quoted(domain.EVENT_IMAGE)}
        FROM v_flagged WHERE quality_status = 'warning'""",
    "v_triage": f"""
        SELECT *, list_filter([{_SYMPTOM_ITEMS}], lambda s: s IS NOT NULL) AS symptoms, 'Paciente ' || triage_id AS patient_name
        FROM (SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) || '-' ||
               CAST(l_partkey AS VARCHAR) || '-' || CAST(l_suppkey AS VARCHAR) AS triage_id,
               l_shipdate AS created_at, l_partkey AS ref_id, CAST(l_orderkey % 98 AS VARCHAR) AS age,
               CASE WHEN l_partkey % 97 = 0 THEN 'abc' WHEN l_partkey % 89 = 0 THEN ''
                    ELSE CAST(40 + 2 * CAST(l_quantity AS INT) AS VARCHAR) END AS heart_rate,
               CAST(CAST(round(100 - 200 * l_discount) AS INT) AS VARCHAR) AS oxygen_saturation,
               CAST(60 + l_partkey % 160 AS VARCHAR) AS systolic_bp,
               CAST(6 + l_suppkey % 30 AS VARCHAR) AS respiratory_rate,
               CAST(34 + CAST(round(l_tax * 100) AS INT) AS VARCHAR) || CASE WHEN l_linenumber % 2 = 0 THEN ',5' ELSE '.2' END AS temperature,
               ((l_orderkey * 31 + l_linenumber) % 1024) & (l_partkey % 1024) AS symptom_mask
        FROM lineitem) t""",
    "v_rules": f"""
        SELECT *, {case("risk_level", domain.PRIORITY_BY_RISK, "'standard'")} AS recommended_priority,
               {round_exact("least(0.99e0, 0.65e0 + score / 200e0)", 2)} AS confidence
        FROM (SELECT *, CASE WHEN score >= 75 THEN 'critical' WHEN score >= 50 THEN 'high' WHEN score >= 25 THEN 'medium' ELSE 'low' END AS risk_level
        FROM (SELECT *, CAST(least(100, least(40, 8 * len(symptoms))
                   + CASE WHEN list_has_any(symptoms, {text_list(domain.RULE_RED_FLAGS)}) THEN 35 ELSE 0 END
                   + CASE WHEN {_HR} >= 120 THEN 15 ELSE 0 END
                   + CASE WHEN {_OX} < 92 THEN 25 ELSE 0 END
                   + CASE WHEN {_BP} < 90 THEN 20 ELSE 0 END) AS INTEGER) AS score
        FROM v_triage) a) b""",
    "v_labels": f"""
        SELECT *, CASE WHEN severity >= 9 OR red_flags >= 2 OR n_ox <= 88 THEN 'critical' WHEN severity >= 6 THEN 'high'
                       WHEN severity >= 3 THEN 'medium' ELSE 'low' END AS severity_label
        FROM (SELECT *, news2 + 2 * red_flags + CASE WHEN n_age >= 75 THEN 1 ELSE 0 END AS severity
        FROM (SELECT *, CASE WHEN n_rr <= 8 THEN 3 WHEN n_rr <= 11 THEN 1 WHEN n_rr >= 25 THEN 3 WHEN n_rr >= 21 THEN 2 ELSE 0 END
                      + CASE WHEN n_ox <= 91 THEN 3 WHEN n_ox <= 93 THEN 2 WHEN n_ox <= 95 THEN 1 ELSE 0 END
                      + CASE WHEN n_bp <= 90 THEN 3 WHEN n_bp <= 100 THEN 2 WHEN n_bp <= 110 THEN 1 WHEN n_bp >= 220 THEN 3 ELSE 0 END
                      + CASE WHEN n_hr <= 40 THEN 3 WHEN n_hr <= 50 THEN 1 WHEN n_hr >= 131 THEN 3 WHEN n_hr >= 111 THEN 2 WHEN n_hr >= 91 THEN 1 ELSE 0 END
                      + CASE WHEN n_t <= 35 THEN 3 WHEN n_t <= 36 THEN 1 WHEN n_t >= 39.1e0 THEN 2 WHEN n_t >= 38.1e0 THEN 1 ELSE 0 END AS news2,
                      len(list_intersect(symptoms, {text_list(domain.LABEL_RED_FLAGS)})) AS red_flags
        FROM (SELECT *, {_DEFAULTED["age"]} AS n_age, {_DEFAULTED["heart_rate"]} AS n_hr, {_DEFAULTED["oxygen_saturation"]} AS n_ox,
                     {_DEFAULTED["systolic_bp"]} AS n_bp, {_DEFAULTED["respiratory_rate"]} AS n_rr, {_DEFAULTED["temperature"]} AS n_t
        FROM v_rules) a) b) c""",
    "v_logits": """
        SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS z0, CAST(embedding[2] AS DOUBLE) AS z1,
               CAST(embedding[3] AS DOUBLE) AS z2, CAST(embedding[4] AS DOUBLE) AS z3 FROM embeddings""",
    "v_probs": """
        SELECT vec_id, exp(z0 - m) / s AS p1, exp(z1 - m) / s AS p2, exp(z2 - m) / s AS p3, exp(z3 - m) / s AS p4
        FROM (SELECT *, exp(z0 - m) + exp(z1 - m) + exp(z2 - m) + exp(z3 - m) AS s
              FROM (SELECT *, greatest(z0, z1, z2, z3) AS m FROM v_logits) a) b""",
    "v_model": f"""
        SELECT *, {case("risk_level", domain.PRIORITY_BY_RISK, "'standard'")} AS recommended_priority,
               CAST(greatest(0e0, least(100e0, round_even(certainty * 100e0 * cls / 4e0, 0))) AS INTEGER) AS score,
               {round_exact("certainty", 4)} AS confidence
        FROM (SELECT *, {text_list(domain.RISK_LABELS)}[cls] AS risk_level
        FROM (SELECT *, greatest(p1, p2, p3, p4) AS certainty,
               CASE greatest(p1, p2, p3, p4) WHEN p1 THEN 1 WHEN p2 THEN 2 WHEN p3 THEN 3 ELSE 4 END AS cls FROM v_probs) a) b""",
    "v_assess": """
        SELECT r.triage_id, r.created_at, r.patient_name, r.symptoms, r.symptom_mask, r.age, r.heart_rate, r.oxygen_saturation, r.systolic_bp, r.respiratory_rate, r.temperature, m.certainty, m.p1, m.p2, m.p3, m.p4,
               coalesce(m.score, r.score) AS score, coalesce(m.risk_level, r.risk_level) AS risk_level,
               coalesce(m.confidence, r.confidence) AS confidence,
               coalesce(m.recommended_priority, r.recommended_priority) AS recommended_priority,
               CASE WHEN m.vec_id IS NULL THEN 'hospital-triage-rules-fallback' ELSE 'hospital-triage-rf-calibrated' END AS model_name
        FROM v_rules r LEFT JOIN v_model m ON m.vec_id = r.ref_id""",
    "v_event_log": """
        SELECT event_id, 0 AS version, ts AS created_at, 'radiology' AS source,
               CASE WHEN event_type IN ('error','purchase') THEN 'high' ELSE 'medium' END AS severity, event_type, FALSE AS resolved FROM events
        UNION ALL SELECT event_id, 1, ts, 'radiology', CASE WHEN event_type IN ('error','purchase') THEN 'high' ELSE 'medium' END,
               event_type, TRUE FROM events WHERE event_id % 3 = 0""",
    "v_events": """
        SELECT event_id, created_at, source, severity, event_type, event_id % 3 = 0 AS resolved FROM v_event_log WHERE version = 0""",
    "v_runs": """
        SELECT o_orderkey AS run_id, o_orderdate AS created_at,
               CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'completed_with_warnings' ELSE 'failed' END AS status,
               CAST(CASE o_orderstatus WHEN 'P' THEN 0 ELSE o_custkey % 1000 END AS BIGINT) AS processed_count,
               CAST(CASE o_orderstatus WHEN 'O' THEN 1 + o_custkey % 7 ELSE 0 END AS BIGINT) AS rejected_count FROM orders""",
    "v_split": """
        SELECT study_id, prediction_class AS label, CASE WHEN file_size_bytes % 5 = 0 THEN 'test' ELSE 'train' END AS folder_split
        FROM v_predictions""",
    "v_epoch": """
        SELECT CAST(extract(day FROM ts) AS INT) AS epoch, user_id AS batch_id, CAST(count(*) AS BIGINT) AS n,
               CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS loss_cents,
               CAST(sum(CASE WHEN event_type IN ('view','click','signup') THEN 1 ELSE 0 END) AS BIGINT) AS correct
        FROM events GROUP BY 1, 2""",
    "v_history": """
        SELECT epoch, CAST(sum(n) AS BIGINT) AS rows, CAST(sum(loss_cents) AS BIGINT) / CAST(greatest(sum(n), 1) AS DOUBLE) AS loss,
               CAST(sum(correct) AS BIGINT) / CAST(greatest(sum(n), 1) AS DOUBLE) AS accuracy FROM v_epoch GROUP BY epoch""",
    "v_eval": "SELECT triage_id, severity_label AS y_true, risk_level AS y_pred FROM v_labels",
    "v_matrix": f"""
        SELECT a.l AS actual, p.l AS predicted, count(e.triage_id) AS rows
        FROM (SELECT unnest({text_list(domain.RISK_LABELS)}) AS l) a
        CROSS JOIN (SELECT unnest({text_list(domain.RISK_LABELS)}) AS l) p
        LEFT JOIN v_eval e ON e.y_true = a.l AND e.y_pred = p.l GROUP BY 1, 2""",
    "v_objects": """
        SELECT CASE WHEN doc_id % 4 = 0 THEN 'test' ELSE 'train' END || '/' ||
               CASE lang WHEN 'en' THEN 'NORMAL' WHEN 'fr' THEN 'PNEUMONIA' WHEN 'de' THEN 'COVID19' ELSE 'OTHER' END || '/' ||
               CAST(doc_id AS VARCHAR) || CASE doc_id % 5 WHEN 0 THEN '.png' WHEN 1 THEN '.jpg' WHEN 2 THEN '.JPEG' WHEN 3 THEN '.gif' ELSE '' END AS path,
               CASE WHEN doc_id % 11 = 7 THEN unhex('474946383961') || encode(text) WHEN doc_id % 11 = 8 THEN unhex('49492A00') || encode(text)
                    WHEN doc_id % 11 = 9 THEN unhex('524946460A00000057454250') || encode(text) WHEN doc_id % 11 = 10 THEN unhex('424D0A00000000000000') || encode(text)
                    WHEN doc_id % 3 = 0 THEN unhex('89504E470D0A1A0A') || encode(text) WHEN doc_id % 3 = 1 THEN unhex('FFD8FF') || encode(text) ELSE encode(text) END AS content
        FROM documents""",
}


def select(sql: str) -> str:
    """``sql`` with the views it needs as common table expressions."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"\bv_\w+", text):
            if name in VIEWS and name not in needed:
                visit(VIEWS[name])
                if name not in needed:
                    needed.append(name)

    visit(sql)
    if not needed:
        return sql
    return "WITH " + ",\n".join(f"{name} AS ({VIEWS[name].strip()})" for name in needed) + "\n" + sql.strip()
