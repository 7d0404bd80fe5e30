"""Queries over labelled splits, training epochs and predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitalgrid import domain
from vitalgrid.functions.numeric import round_exact
from vitalgrid.operators import evaluation, triage
from vitalgrid.plans.registry import query
from vitalgrid.plans.triage import requests
from vitalgrid.plans.views import round_exact as sql_round
from vitalgrid.sources import clinical

RATIO, SEED = 0.2, 42


def judged(spark, d):
    """Requests with y_true (early-warning label) and y_pred (rule risk)."""
    both = triage.rules_risk(triage.severity_label(requests(spark, d)))
    return both.select("triage_id", F.col("severity_label").alias("y_true"), F.col("risk_level").alias("y_pred"))


@query("class_weights", f"""
    SELECT label, rows, {sql_round('CAST(sum(rows) OVER () AS BIGINT) / (3e0 * rows)', 4)} AS weight
    FROM (SELECT label, count(*) AS rows FROM v_split WHERE folder_split = 'train' GROUP BY label) t""")
def class_weights(spark, d):
    train = clinical.labelled_split(spark, d).filter("folder_split = 'train'")
    weights = evaluation.class_weights(train, "label", domain.MODEL_CLASSES)
    return weights.withColumn("weight", round_exact(F.col("weight"), 4))


@query("stratified_split", f"""
    SELECT study_id, label, folder_split, CASE WHEN place <= round_even(total * {RATIO}e0, 0) THEN 'val' ELSE 'train' END AS subset
    FROM (SELECT *, rank() OVER (PARTITION BY label ORDER BY md5('{SEED}|' || study_id), study_id) AS place,
                 count(*) OVER (PARTITION BY label) AS total FROM v_split WHERE folder_split = 'train') t""")
def stratified_split(spark, d):
    train = clinical.labelled_split(spark, d).filter("folder_split = 'train'")
    return evaluation.stratified_split(train, "label", "study_id", RATIO, SEED)


def _history(spark, d):
    batches = clinical.epoch_batches(spark, d).withColumnRenamed("loss_cents", "loss_sum")
    return evaluation.weighted_epoch_metrics(batches)


@query("weighted_epoch_metrics", f"SELECT epoch, rows, {sql_round('loss', 4)} AS loss, {sql_round('accuracy', 4)} AS accuracy FROM v_history")
def weighted_epoch_metrics(spark, d):
    history = _history(spark, d)
    return history.withColumns({m: round_exact(F.col(m), 4) for m in ("loss", "accuracy")})


@query("best_epoch", f"""
    SELECT epoch, {sql_round('accuracy', 4)} AS accuracy, coalesce(accuracy > before, TRUE) AS improved, epoch = best AS is_best
    FROM (SELECT *, max(accuracy) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
                 first_value(epoch) OVER (ORDER BY accuracy DESC, epoch ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS best FROM v_history) t""")
def best_epoch(spark, d):
    marked = evaluation.best_epoch(_history(spark, d))
    return marked.select("epoch", round_exact(F.col("accuracy"), 4).alias("accuracy"), "improved", "is_best")


@query("confusion_matrix", "SELECT actual, predicted, rows FROM v_matrix")
def confusion_matrix(spark, d):
    return evaluation.confusion_matrix(judged(spark, d), "y_true", "y_pred", domain.RISK_LABELS)


@query("confusion_table", "SELECT actual, " + ", ".join(f"CAST(sum(rows) FILTER (WHERE predicted = '{r}') AS BIGINT) AS {r}" for r in domain.RISK_LABELS) + " FROM v_matrix GROUP BY actual")
def confusion_table(spark, d):
    return evaluation.confusion_table(judged(spark, d), "y_true", "y_pred", domain.RISK_LABELS)


_PER_LABEL = """
    SELECT label, support, CASE WHEN chosen = 0 THEN 0e0 ELSE hits / chosen::DOUBLE END AS precision, CASE WHEN support = 0 THEN 0e0 ELSE hits / support::DOUBLE END AS recall
    FROM (SELECT a.actual AS label, CAST(sum(a.rows) AS BIGINT) AS support, CAST(sum(CASE WHEN a.actual = a.predicted THEN a.rows ELSE 0 END) AS BIGINT) AS hits,
                 (SELECT CAST(sum(b.rows) AS BIGINT) FROM v_matrix b WHERE b.predicted = a.actual) AS chosen FROM v_matrix a GROUP BY a.actual) t"""
_WITH_F1 = f"SELECT *, CASE WHEN precision + recall = 0 THEN 0e0 ELSE 2e0 * precision * recall / (precision + recall) END AS f1_score FROM ({_PER_LABEL}) u"
_MEASURES = ("precision", "recall", "f1_score")
_ACCURACY = "(SELECT sum(CASE WHEN actual = predicted THEN rows ELSE 0 END) / sum(rows)::DOUBLE FROM v_matrix)"
_TOTAL = "(SELECT CAST(sum(rows) AS BIGINT) FROM v_matrix)"
_ROUNDED = ", ".join(f"{sql_round(m, 4)} AS {m}" for m in _MEASURES)


@query("classification_report", f"""
    SELECT label, {_ROUNDED}, support FROM (
        SELECT label, precision, recall, f1_score, support FROM ({_WITH_F1}) a
        UNION ALL SELECT 'accuracy', {_ACCURACY}, {_ACCURACY}, {_ACCURACY}, {_TOTAL}
        UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1_score), {_TOTAL} FROM ({_WITH_F1}) b
        UNION ALL SELECT 'weighted avg', {', '.join(f'sum({m} * support) / sum(support)' for m in _MEASURES)}, {_TOTAL} FROM ({_WITH_F1}) c) r""")
def classification_report(spark, d):
    report = evaluation.classification_report(judged(spark, d), "y_true", "y_pred", domain.RISK_LABELS)
    return report.withColumns({m: round_exact(F.col(m), 4) for m in _MEASURES})


@query("accuracy", f"SELECT {sql_round('avg(CASE WHEN y_true = y_pred THEN 1e0 ELSE 0e0 END)', 4)} AS accuracy FROM v_eval")
def accuracy(spark, d):
    return evaluation.accuracy(judged(spark, d), "y_true", "y_pred").withColumn("accuracy", round_exact(F.col("accuracy"), 4))
