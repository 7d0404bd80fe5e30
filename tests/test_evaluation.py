from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from vitalgrid import domain
from vitalgrid.operators import evaluation, forest
from vitalgrid.plans import model as model_queries
from vitalgrid.session import materialize

MATRIX = [[114, 2, 0], [2, 287, 28], [3, 43, 809]]
LABELS = domain.MODEL_CLASSES


def predictions(spark):
    cells = [(a, p, MATRIX[i][j]) for i, a in enumerate(LABELS) for j, p in enumerate(LABELS)]
    df = spark.createDataFrame([*cells, ("other", "Sana", 5)], "y string, p string, n int")
    return df.filter("n > 0").select("y", "p", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("i"))


def test_golden_report(spark):
    df = predictions(spark)
    matrix = {(r.actual, r.predicted): r.rows for r in evaluation.confusion_matrix(df, "y", "p", LABELS).collect()}
    assert matrix == {(a, p): MATRIX[i][j] for i, a in enumerate(LABELS) for j, p in enumerate(LABELS)}
    report = {r.label: r for r in evaluation.classification_report(df, "y", "p", LABELS).collect()}
    assert report["COVID-19"].recall == pytest.approx(0.9827586206896551)
    assert report["Sana"].precision == pytest.approx(0.8644578313253012)
    assert report["accuracy"].precision == pytest.approx(0.9394409937888198)
    assert report["macro avg"].f1_score == pytest.approx(0.9369717125577205)
    assert report["weighted avg"].precision == pytest.approx(0.9406498698856012)
    assert report["weighted avg"].support == 1288
    table = {r.actual: r["Neumonia"] for r in evaluation.confusion_table(df, "y", "p", LABELS).collect()}
    assert table == {"COVID-19": 0, "Sana": 28, "Neumonia": 809}


def test_report_without_predictions_of_a_label_is_zero(spark):
    df = spark.createDataFrame([("a", "b"), ("b", "b")], "y string, p string")
    report = {r.label: r for r in evaluation.classification_report(df, "y", "p", ("a", "b", "c")).collect()}
    assert (report["a"].precision, report["a"].recall, report["a"].f1_score) == (0.0, 0.0, 0.0)
    assert report["c"].support == 0


def labelled(spark, sizes):
    rows = spark.createDataFrame(list(sizes.items()), "label string, n int")
    return rows.select("label", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("i")).select(
        "label", F.concat("label", F.lit("-"), F.col("i").cast("string")).alias("id")
    )


def test_golden_class_weights_and_split_sizes(spark):
    weights = {r.label: r.weight for r in evaluation.class_weights(labelled(spark, {"COVID-19": 368, "Sana": 1013, "Neumonia": 2734}), "label").collect()}
    assert {k: round(v, 5) for k, v in weights.items()} == {"COVID-19": 3.72736, "Sana": 1.35406, "Neumonia": 0.50171}
    parts = evaluation.stratified_split(labelled(spark, {"COVID-19": 460, "Sana": 1266, "Neumonia": 3418}), "label", "id", 0.2, 42)
    sizes = {r.label: r["count"] for r in parts.filter("subset = 'val'").groupBy("label").count().collect()}
    assert sizes == {"COVID-19": 92, "Sana": 253, "Neumonia": 684}


@pytest.mark.parametrize("digits, ordered", [(1, 10_000), (2, 10_000), (4, 10_000), (1, 2)])
def test_split_equals_a_rank_per_label(spark, monkeypatch, digits, ordered):
    """Few buckets put many ids into the one the cut falls into, which is divided again if it may not hold them."""
    monkeypatch.setattr(evaluation, "BUCKET_DIGITS", digits)
    monkeypatch.setattr(evaluation, "ORDERED_IDS", ordered)
    df = labelled(spark, {"a": 700, "b": 33, "c": 2, "d": 1}).unionByName(labelled(spark, {"a": 50}))
    got = sorted((r.label, r.id, r.subset) for r in evaluation.stratified_split(df, "label", "id", 0.3, 5).collect())
    expected = []
    for label in "abcd":
        ids = [r.id for r in df.filter(F.col("label") == label).collect()]
        order = sorted(ids, key=lambda i: (hashlib.md5(f"5|{i}".encode()).hexdigest(), i))
        cut = round(len(ids) * 0.3)
        for i in ids:
            expected.append((label, i, "val" if order.index(i) < cut else "train"))
    assert got == sorted(expected)


def test_best_epoch(spark):
    values = [0.9154518950437318, 0.8649173955296404, 0.9300291545189504, 0.8940719144800777, 0.9504373177842566, 0.9504373177842566]
    history = spark.createDataFrame(list(enumerate(values, 1)), "epoch int, accuracy double")
    marked = {r.epoch: (r.improved, r.is_best) for r in evaluation.best_epoch(history).collect()}
    assert marked == {1: (True, False), 2: (False, False), 3: (True, False), 4: (False, False), 5: (True, True), 6: (False, False)}


def test_epoch_metrics(spark):
    batches = spark.createDataFrame([(1, 10, 5, 20.0), (1, 30, 25, 40.0), (2, 0, 0, 0.0)], "epoch int, n long, correct long, loss_sum double")
    got = {r.epoch: (r.loss, r.accuracy) for r in evaluation.weighted_epoch_metrics(batches).collect()}
    assert got == {1: (1.5, 0.75), 2: (0.0, 0.0)}


def test_forest_learns_and_survives_storage(spark, tmp_path):
    """The forest of the queries, of the published size, as it comes back from storage."""
    rows = forest.feature_table(model_queries.labelled(spark, "/root/testdata/sf0.001"), "severity_label")
    path, metrics, _ = model_queries.trained(spark, "/root/testdata/sf0.001")
    model, row = forest.load(spark, path), spark.read.parquet(metrics).first()
    assert (len(model.folds), model.base.trees, {g.getOrDefault("maxDepth") for g in model.base.groups}) == (5, 400, {12})
    assert {f.trees for f, _ in model.folds} == {400}
    majority = rows.groupBy("severity_label").count().orderBy(F.desc("count")).first()["count"] / rows.count()
    assert row.accuracy > majority + 0.1
    assert row.training_samples + row.test_samples == rows.count()
    assert sum(row.confusion_matrix.values()) == row.test_samples
    scored = materialize(forest.score(model, rows), "scored")
    total = scored.select(F.aggregate("probabilities", F.lit(0.0), lambda a, x: a + x).alias("s"))
    assert total.filter(F.abs(F.col("s") - 1) > 1e-9).count() == 0
    forest.save(model, spark, str(tmp_path / "model"))
    again = forest.score(forest.load(spark, str(tmp_path / "model")), rows)
    key = F.sum(F.xxhash64("triage_id", F.transform("probabilities", lambda p: F.round(p, 9))) % 1000003)
    assert scored.agg(key).first() == again.agg(key).first()
    importances = forest.feature_importances(model.base, spark)
    assert importances.agg(F.round(F.sum("importance"), 6)).first()[0] == 1.0
    about = forest.model_metadata(spark, path).first()
    assert about.loaded and tuple(about.feature_order) == domain.FEATURES
    missing = forest.model_metadata(spark, str(tmp_path / "nothing")).first()
    assert missing.loaded is False and "nothing" in missing.reason


def test_fitted_rows_are_drawn_per_class(spark):
    """A class of one row in two hundred is fitted whole; the others share what it leaves."""
    ids = spark.range(4000).select(F.concat(F.lit("t"), "id").alias("triage_id"), F.when(F.col("id") % 200 == 0, "critical").when(F.col("id") % 4 == 1, "medium").otherwise("low").alias("label"))
    drawn = forest.bounded_rows(materialize(ids, "skewed"), 600, "label")
    assert {r.label: r["count"] for r in drawn.groupBy("label").count().collect()} == {"critical": 20, "medium": 290, "low": 290}
    assert drawn.distinct().count() == 600
    assert forest.bounded_rows(ids, 4000, "label").count() == 4000


def test_calibration_covers_all_training_rows(spark):
    """The curves come from every held-out row, not only from those that are fitted."""
    table = forest.feature_table(model_queries.labelled(spark, "/root/testdata/sf0.001"), "severity_label")
    fitted = forest.bounded_rows(table, 200, "severity_label")
    rows, held = (materialize(forest.training_rows(t, "severity_label"), "rows") for t in (fitted, table))
    folds = forest.calibrate(forest.train_folds(rows, folds=2, trees=3, depth=4), held)
    for number, (model, calibrators) in enumerate(folds):
        own = model.shares(held.filter(forest._fold(2, forest.SEED) == number), "features", "_scores").select("label", "_scores").collect()
        for label, calibrator in enumerate(calibrators):
            assert {min(calibrator.boundaries), max(calibrator.boundaries)} == {f([round(r._scores[label], 4) for r in own]) for f in (min, max)}
            predicted = [calibrator.predict(round(r._scores[label], 4)) for r in own]
            assert sum(predicted) == pytest.approx(sum(r.label == label for r in own), rel=1e-6)
    assert model_queries.forest.FIT_ROWS == 8000 and not hasattr(model_queries, "FIT_ROWS")


def test_groups_of_trees_are_one_forest(spark):
    """Shares and importances of groups grown side by side are the means over all their trees."""
    table = forest.feature_table(model_queries.labelled(spark, "/root/testdata/sf0.001"), "severity_label")
    rows = materialize(forest.training_rows(forest.bounded_rows(table, 300, "severity_label"), "severity_label"), "rows")
    grown = forest.train_forest(rows, trees=5, depth=3, group_trees=2)
    assert [g.getNumTrees for g in grown.groups] == [2, 2, 1] and grown.trees == 5
    trees = [(tree, g) for g in grown.groups for tree in g.trees]
    for r in grown.shares(rows, "features", "shares").limit(20).collect():
        leaves = [tree.predictLeaf(r.features) for tree, _ in trees]
        assert len(leaves) == 5 and sum(r.shares) == pytest.approx(1.0)
        raw = sum(g.predictRaw(r.features).toArray() for g in grown.groups)
        assert list(r.shares) == pytest.approx(list(raw / 5))
    single = [sum(v) for v in zip(*[[float(x) for x in tree.featureImportances.toArray()] for tree, _ in trees])]
    assert grown.importances() == pytest.approx([v / sum(single) for v in single])
