"""Queries that train and apply the triage forest on the whole table.

What they share, the split, the uncalibrated forest, the calibrated one and its answers, is made
once per application and stored in the shared folder; each query makes only what it needs. The
forest has the size of ``operators.forest``, fitted and calibrated on the whole training part; all
rows are scored.

What a forest answers has no SQL form. A query named in the survey returns the answers; the
query of the same name with ``_checks`` says in columns what must follow from them, and that
is compared with DuckDB.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from vitalgrid import domain
from vitalgrid.operators import forest, triage
from vitalgrid.plans.registry import query
from vitalgrid.plans.triage import requests
from vitalgrid.plans.views import quoted, text_list
from vitalgrid.session import materialize, scratch_path
from vitalgrid.sources import clinical, registered
from vitalgrid.streaming import flows

NOISE_RATE, SEED = 0.06, 42
_kept: dict[tuple, object] = {}


def _key(spark, d, name) -> tuple:
    return (spark.sparkContext.applicationId, d, name, forest.TREES, forest.DEPTH, forest.FOLDS, NOISE_RATE, SEED)


def once(spark, d, name, make):
    """``make()``, once per application, table folder and size of the model."""
    key = _key(spark, d, name)
    if key not in _kept:
        _kept[key] = make()
    return _kept[key]


def dealt_requests(spark, d):
    """Requests for work of a tenth of a millisecond on each: evenly over the cores, unless there are many tasks for each."""
    return clinical.triage_requests(spark, d, over_cores=4)


def labelled(spark, d):
    """Requests with their early-warning label, some labels moved by one step."""
    rows = triage.severity_label(triage.parsed(dealt_requests(spark, d)))
    return triage.label_noise(rows, "severity_label", NOISE_RATE, SEED, "triage_id")


def table(spark, d):
    return once(spark, d, "table", lambda: forest.feature_table(labelled(spark, d), "severity_label"))


def prepared(spark, d):
    """Training part, rows to fit on, test part."""
    return once(spark, d, "prepared", lambda: forest.prepare(table(spark, d), "severity_label", SEED))


def base(spark, d) -> forest.Forest:
    """The uncalibrated forest, stored."""
    return once(spark, d, "base", lambda: forest.train_forest(prepared(spark, d)[1], seed=SEED, path=scratch_path(spark, "base-forest")))


def trained(spark, d) -> tuple[str, str, forest.CalibratedForest]:
    """Path of the stored model, path of its stored metrics document, and the model.

    All its forests grow side by side, unless a query has grown the uncalibrated one before."""

    def make():
        model_path, metrics_path = scratch_path(spark, "model"), scratch_path(spark, "model-metrics")
        model, metrics = forest.train_and_report(table(spark, d), "severity_label", model_path, seed=SEED, prepared=prepared(spark, d), base=_kept.get(_key(spark, d, "base")))
        once(spark, d, "base", lambda: model.base)
        metrics.write.parquet(metrics_path)
        return model_path, metrics_path, model

    return once(spark, d, "trained", make)


def loaded(spark, d) -> forest.CalibratedForest:
    return trained(spark, d)[2]


def scored(spark, d):
    """The forest's answers to all requests, stored once for the queries that look at them."""
    answers = lambda: forest.assess(loaded(spark, d), dealt_requests(spark, d))
    return once(spark, d, "scored", lambda: materialize(answers(), "scored"))


_CUT = f"{int(NOISE_RATE * 16**8):08x}"
_LEVELS = text_list(domain.RISK_LABELS)
_NOISY = f"""
    SELECT triage_id, CASE WHEN substr(draw, 1, 8) < '{_CUT}' THEN {_LEVELS}[CASE WHEN substr(draw, 9, 1) < '8' THEN greatest(place - 1, 1) ELSE least(place + 1, 4) END]
        ELSE severity_label END AS label
    FROM (SELECT *, md5('{SEED}|' || triage_id) AS draw, list_position({_LEVELS}, severity_label) AS place FROM v_labels) n"""
_TEST_ROWS = f"SELECT label, count(*) AS n, CAST(round_even(count(*) * 0.2e0, 0) AS BIGINT) AS test FROM ({_NOISY}) m GROUP BY label"


def _judged_by_base(spark, d):
    """The held-out rows with the class index that the uncalibrated forest gives them."""
    test = prepared(spark, d)[2]
    shares = materialize(base(spark, d).shares(test, "features", "probabilities").select("severity_label", "probabilities"), "base-shares")
    return shares.withColumn("place", F.array_position("probabilities", F.array_max("probabilities")).cast("int"))


@query("train_triage_forest")
def train_triage_forest(spark, d):
    """Confusion of the uncalibrated forest on the held-out rows, with its size."""
    judged = forest.with_prediction(_judged_by_base(spark, d))
    matrix = judged.groupBy(F.col("severity_label").alias("actual"), "predicted").agg(F.count(F.lit(1)).alias("rows"))
    return matrix.select("*", F.lit(base(spark, d).trees).alias("trees"), F.lit(base(spark, d).depth).alias("deepest"))


@query("train_triage_forest_checks", f"SELECT label, test AS rows, test AS predicted, TRUE AS is_full_size FROM ({_TEST_ROWS}) t")
def train_triage_forest_checks(spark, d):
    """Held-out rows by label, how many of them the uncalibrated forest gives a label, and the forest's size."""
    full = base(spark, d).trees == 400 and base(spark, d).depth <= 12 and all(g.getOrDefault("maxDepth") == 12 for g in base(spark, d).groups)
    return _judged_by_base(spark, d).groupBy(F.col("severity_label").alias("label")).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("place").between(1, 4)).alias("predicted"), F.lit(full).alias("is_full_size")
    )


@query("calibrate_isotonic")
def calibrate_isotonic(spark, d):
    """The calibration curves: the fitted share at each corner, by fold and risk label."""
    model = loaded(spark, d)
    corners = [
        (fold, risk, float(x), float(y))
        for fold, (_, calibrators) in enumerate(model.folds)
        for risk, curve in zip(model.labels, calibrators)
        for x, y in zip(curve.boundaries, curve.predictions)
    ]  # at most 10 001 for each fold and label, whatever the table's size
    return spark.createDataFrame(corners, "fold int, risk_level string, score double, fitted double")


@query("calibrate_isotonic_checks", f"""
    SELECT * FROM (WITH p AS (SELECT r.score / 100e0 AS x, count(*) AS w, count(*) FILTER (WHERE m.label = 'critical') AS hits FROM v_rules r JOIN ({_NOISY}) m USING (triage_id) GROUP BY 1),
    f AS (SELECT a.x AS low, b.x AS high, (SELECT sum(hits) FROM p WHERE p.x BETWEEN a.x AND b.x) / (SELECT sum(w) FROM p WHERE p.x BETWEEN a.x AND b.x) AS mean
          FROM p a JOIN p b ON a.x <= b.x),
    least AS (SELECT p.x, f.low, min(f.mean) AS mean FROM p JOIN f ON f.low <= p.x AND p.x <= f.high GROUP BY 1, 2)
    SELECT x AS score, w AS rows, round(max(mean), 9) AS fitted, TRUE AS curves_rise FROM least JOIN p USING (x) GROUP BY x, w) c""")
def calibrate_isotonic_checks(spark, d):
    """Isotonic share of critical labels over the rules' score; and whether the stored curves of the forest rise."""
    truth = labelled(spark, d).select("triage_id", "severity_label")
    both = triage.rules_risk(requests(spark, d)).select("triage_id", "score").join(truth, "triage_id")
    points = both.groupBy((F.col("score") / 100.0).alias("features")).agg(
        F.count(F.lit(1)).cast("double").alias("weight"), F.avg((F.col("severity_label") == "critical").cast("double")).alias("label")
    )
    rises = forest.curves_rise(loaded(spark, d))
    curve = forest.isotonic_curve(points)
    return curve.select(F.col("features").alias("score"), F.col("weight").cast("long").alias("rows"), F.round("fitted", 9).alias("fitted"), F.lit(rises).alias("curves_rise"))


_ANSWER_CHECKS = ("sums_to_one", "fits_risk", "fits_priority", "fits_score", "fits_confidence", "fits_alerts", "is_complete")


def _answer_checks() -> dict:
    """What follows from a row's own probabilities, said again in SQL."""
    top = "array_max(probabilities)"
    place = f"array_position(probabilities, {top})"
    return {
        "sums_to_one": F.expr("abs(aggregate(probabilities, 0D, (a, x) -> a + x) - 1) < 1e-9"),
        "fits_risk": F.expr(f"risk_level = element_at(array('low', 'medium', 'high', 'critical'), cast({place} AS int))"),
        "fits_priority": F.expr("recommended_priority = CASE risk_level WHEN 'low' THEN 'standard' WHEN 'medium' THEN 'priority' WHEN 'high' THEN 'urgent' ELSE 'immediate' END"),
        "fits_score": F.expr(f"score = cast(least(100, greatest(0, rint({top} * 100 * {place} / 4))) AS int)"),
        "fits_confidence": F.expr(f"abs(confidence - {top}) <= 0.00005000001"),
        "fits_alerts": F.expr(
            f"array_contains(alerts, 'Confianza baja: validar con personal sanitario.') = ({top} < 0.55) "
            "AND array_contains(alerts, 'Activar codigo de atencion inmediata.') = (risk_level = 'critical')"
        ),
        "is_complete": F.expr("model_version = '1.0.0' AND model_family = 'random_forest_isotonic_calibration' AND clinical_note <> '' AND size(contributors) = 3"),
    }


@query("score_triage_model")
def score_triage_model(spark, d):
    """The trained forest's answer to every request."""
    return scored(spark, d).select(
        "triage_id", "risk_level", "recommended_priority", "score", "confidence", *[F.col("probability_map")[risk].alias(f"p_{risk}") for risk in domain.RISK_LABELS],
        F.array_join("alerts", " | ").alias("alerts"), F.array_join(F.transform("contributors", lambda c: F.concat_ws("=", c["feature"], c["value"].cast("string"))), ",").alias("contributors"),
        "model_name", "model_version", "model_family", "clinical_note",
    )


@query("score_triage_model_checks", "SELECT triage_id, " + ", ".join(f"TRUE AS {c}" for c in _ANSWER_CHECKS) + " FROM v_triage")
def score_triage_model_checks(spark, d):
    """Every request answered by the trained forest; each answer follows from its probabilities."""
    return scored(spark, d).select("triage_id", *[check.alias(name) for name, check in _answer_checks().items()])


@query("register_model_triage", "SELECT triage_id AS id, TRUE AS says_the_same, '1.0.0' AS model_version, CAST(3 AS INTEGER) AS contributors FROM v_triage")
def register_model_triage(spark, d):
    """The forest's answers registered; what the stored documents say."""
    store = scratch_path(spark, "model-triage")
    registered.register_triages(triage.triage_records(scored(spark, d), "clinical-reports"), store, "batch-1")
    said = lambda path: F.get_json_object("document", f"$.assessment.{path}")
    same = (said("risk_level") == F.col("risk_level")) & (said("score").cast("int") == F.col("score")) & (said("model_name") == F.lit("hospital-triage-rf-calibrated"))
    return registered.load_triages(spark, store).select(
        "id", same.alias("says_the_same"), said("model_version").alias("model_version"), F.json_array_length(said("top_contributors")).alias("contributors")
    )


@query("stream_triage_model", "SELECT DISTINCT triage_id, TRUE AS equals_batch FROM v_triage")
def stream_triage_model(spark, d):
    """A stream of requests answered by the forest, beside the answers to the table."""
    columns = ("triage_id", "risk_level", "recommended_priority", "score", "confidence", "model_name")
    answers = flows.stream_assess(clinical.triage_stream(spark, d), loaded(spark, d)).select(*columns)
    path, checkpoint = scratch_path(spark, "stream-model"), scratch_path(spark, "stream-model-progress")
    flows.append_to(answers, path, checkpoint).awaitTermination()
    streamed = spark.read.schema(answers.schema).parquet(path).withColumn("side", F.lit(1))
    both = streamed.unionByName(scored(spark, d).select(*columns, F.lit(-1).alias("side")))
    rows = both.groupBy(*columns).agg(F.sum("side").alias("left"))
    return rows.groupBy("triage_id").agg(F.bool_and(F.col("left") == 0).alias("equals_batch"))


@query("feature_importances")
def feature_importances(spark, d):
    """Importance and rank of every feature in the uncalibrated forest."""
    return forest.feature_importances(base(spark, d), spark)


@query("feature_importances_checks", f"""
    SELECT unnest({text_list(domain.FEATURES)}) AS feature, 16 AS ranks, 136 AS rank_sum, 1e0 AS total, count(*) > 0 AS has_requests FROM v_triage""")
def feature_importances_checks(spark, d):
    """Each feature, with what must hold of all ranks and importances together."""
    found = forest.feature_importances(base(spark, d), spark)
    all_of = found.agg(F.countDistinct("rank").cast("int").alias("ranks"), F.sum("rank").cast("int").alias("rank_sum"), F.round(F.sum("importance"), 6).alias("total"))
    return found.select("feature").join(F.broadcast(all_of), F.lit(True)).withColumn("has_requests", F.lit(not requests(spark, d).isEmpty()))


@query("training_metrics")
def training_metrics(spark, d):
    """The metrics document of the training, and the numbers in it."""
    stored = spark.read.parquet(trained(spark, d)[1])
    return stored.select(
        "training_samples", "fitted_samples", "test_samples", "accuracy", "synthetic_basis", "clinical_reading_hint", "document",
        *[F.col("classification_report")[risk][measure].alias(f"{risk}_{measure}") for risk in domain.RISK_LABELS for measure in ("precision", "recall", "f1_score", "support")],
    )


@query("training_metrics_checks", f"""
    SELECT 'hospital-triage-rf-calibrated' AS model, '1.0.0' AS version, CAST(sum(n) - sum(test) AS BIGINT) AS training_samples,
           CAST(sum(n) - sum(test) AS BIGINT) AS fitted_samples,
           CAST(sum(test) AS BIGINT) AS test_samples, TRUE AS beats_majority, TRUE AS matrix_fits FROM ({_TEST_ROWS}) t""")
def training_metrics_checks(spark, d):
    """Sizes, and whether the judgement on the held-out rows holds together."""
    stored = spark.read.parquet(trained(spark, d)[1])
    matrix = F.aggregate(F.map_values("confusion_matrix"), F.lit(0).cast("long"), lambda a, x: a + x)
    totals = [F.expr(f"aggregate(map_values(map_filter(confusion_matrix, (k, v) -> startswith(k, '{risk}>'))), 0L, (a, x) -> a + x)") for risk in domain.RISK_LABELS]
    return stored.select(
        "model", "version", "training_samples", "fitted_samples", "test_samples",
        (F.col("accuracy") > F.greatest(*totals) / F.col("test_samples")).alias("beats_majority"), (matrix == F.col("test_samples")).alias("matrix_fits"),
    )


@query("model_metadata", f"""
    SELECT TRUE AS loaded, 'hospital-triage-rf-calibrated' AS model_name, '1.0.0' AS model_version, 'random_forest_isotonic_calibration' AS model_family,
           {quoted(",".join(domain.FEATURES))} AS feature_order, 4 AS score_digits, 5 AS folds, count(*) > 0 AS has_requests FROM v_triage""")
def model_metadata(spark, d):
    about = forest.model_metadata(spark, trained(spark, d)[0])
    return about.select(
        "loaded", "model_name", "model_version", "model_family", F.array_join("feature_order", ",").alias("feature_order"), "score_digits", "folds",
        F.lit(not requests(spark, d).isEmpty()).alias("has_requests"),
    )
