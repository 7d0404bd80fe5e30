"""Trees as flat arrays against MLlib's own answers."""

from __future__ import annotations

import math
from dataclasses import replace

import numpy as np
from pyspark.ml.classification import DecisionTreeClassificationModel
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from vitalgrid.operators import flat_trees, forest
from vitalgrid.session import materialize


def _grown(spark, trees=20, depth=6, group_trees=8):
    numbers = spark.range(600).select(
        F.array(*[(F.pmod(F.xxhash64("id", F.lit(n)), F.lit(1000)) / F.lit(7.0)).cast("double") for n in range(5)]).alias("features"),
        F.pmod(F.xxhash64("id"), F.lit(3)).cast("double").alias("noise"), "id",
    )
    labelled = numbers.select("features", ((F.col("features")[0] > 70).cast("double") + (F.col("noise") == 0).cast("double")).alias("label"), F.lit(1.0).alias("weight"))
    rows = materialize(labelled, "flat-rows")
    return rows, forest.train_forest(rows.withColumn("features", array_to_vector("features")), trees=trees, depth=depth, group_trees=group_trees)


def test_answers_are_those_of_mllib_to_the_last_bit(spark, monkeypatch):
    """Thresholds met exactly, NaN, infinities and both zeros too; whatever the size of a batch."""
    rows, grown = _grown(spark)
    trees = grown.sent(spark).value
    features = [r.features for r in rows.collect()][:120]
    met = [v[0] for v in trees.thresholds]
    features += [met, [math.nan] * 5, [math.inf] * 5, [-math.inf] * 5, [0.0] * 5, [-0.0] * 5, [met[0], math.nan, *met[2:]]]
    expected = []
    for row in features:
        raw = [group.predictRaw(Vectors.dense(row)).toArray() for group in grown.groups]
        expected.append(list((raw[0] + raw[1] + raw[2]) / 20.0))
    for size, abreast in ((8192, 8), (7, 3)):
        monkeypatch.setattr(flat_trees, "WALK_ROWS", size)
        monkeypatch.setattr(flat_trees, "TREES_ABREAST", abreast)
        assert trees.shares(np.array(features)).tolist() == expected
    assert trees.shares(np.empty((0, 5))).shape == (0, 3)


def test_a_threshold_that_is_no_number_sends_all_rows_right(spark, monkeypatch):
    nodes = spark.createDataFrame(
        [(0, 0, 1, 2, 0, -1, math.nan, [2.0, 2.0]), (0, 1, -1, -1, -1, -1, None, [1.0, 0.0]), (0, 2, 3, 4, 0, -1, -math.inf, [1.0, 3.0]),
         (0, 3, -1, -1, -1, -1, None, [1.0, 3.0]), (0, 4, -1, -1, -1, -1, None, [0.0, 5.0])],
        "tree int, id int, leftChild int, rightChild int, featureIndex int, numCategories int, threshold double, stats array<double>",
    )
    monkeypatch.setattr(flat_trees, "stored_nodes", lambda spark, path: nodes)
    trees = flat_trees.flatten(spark, ["any"], 1, 2)
    assert trees.shares(np.array([[1.0], [-math.inf], [math.nan]])).tolist() == [[0.0, 1.0], [0.25, 0.75], [0.0, 1.0]]


def test_no_model_travels_with_the_tasks(spark, capsys):
    """All folds answer in one Arrow pass, and no function of MLlib sees the features."""
    rows, grown = _grown(spark, trees=4, depth=3, group_trees=2)
    points = spark.createDataFrame([(0.0, 0.0, 1.0), (1.0, 1.0, 1.0)], "features double, label double, weight double")
    curve = forest.IsotonicRegression(weightCol="weight").fit(points)
    model = forest.CalibratedForest(grown, ((grown, (curve,) * 3), (grown, (curve,) * 3)), ("a", "b", "c"))
    scored = forest.score(model, rows.select("features"))
    scored.explain("simple")
    plan = capsys.readouterr().out
    assert plan.count("ArrowEvalPython") == 1 and "UDF(features" not in plan
    assert scored.count() == 600


def test_a_stored_forest_is_not_written_again(spark, tmp_path):
    _, grown = _grown(spark, trees=2, depth=2, group_trees=2)
    stored = grown.save(str(tmp_path / "forest"))
    assert stored.stored == str(tmp_path / "forest") and grown.stored is None
    assert stored.save(stored.stored) is stored and forest.load_forest(stored.stored, 1).stored == stored.stored


def test_forests_grow_and_are_stored_side_by_side(spark, tmp_path, monkeypatch):
    """One round of work for the forests of the folds and the uncalibrated one; each group is stored by who grew it."""
    rounds, side_by_side = [], forest._side_by_side

    def watched(session, jobs):
        rounds.append(len(jobs))
        return side_by_side(session, jobs)

    monkeypatch.setattr(forest, "_side_by_side", watched)
    rows, _ = _grown(spark, trees=2, depth=2, group_trees=2)
    rows = rows.withColumn("triage_id", F.xxhash64("features").cast("string")).withColumn("features", array_to_vector("features"))
    rounds.clear()
    path = str(tmp_path / "model")
    model = forest.train_calibrated(rows, path=path, trees=4, depth=3, folds=2)
    assert rounds[0] == 3  # no round for the base forest alone, none for storing
    assert [model.base.stored, *[f.stored for f, _ in model.folds]] == [f"{path}/base", f"{path}/fold_0", f"{path}/fold_1"]
    for grown in (model.base, *[f for f, _ in model.folds]):
        assert forest.load_forest(grown.stored, 1).importances() == grown.importances()
    alone = forest.train_forest(rows, trees=4, depth=3)
    assert alone.stored is None and alone.importances() == model.base.importances()


def test_a_batch_walks_at_once():
    """A whole Arrow batch of the default size has no short rest."""
    assert flat_trees.WALK_ROWS >= 10_000


def test_deep_trees_answer_as_mllib_below_the_top_levels_too(spark):
    """Rows that leave the masks at a leaf, and rows that walk on; batches of whole words of 64 rows and others."""
    rows, grown = _grown(spark, trees=10, depth=12, group_trees=6)
    trees = grown.sent(spark).value
    assert max(depth for group in trees.groups for _, depth in group) > flat_trees.TOP_LEVELS
    features = [r.features for r in rows.collect()][:130] + [[math.nan] * 5, [math.inf] * 5, [-math.inf] * 5]
    expected = []
    for row in features:
        raw = [group.predictRaw(Vectors.dense(row)).toArray() for group in grown.groups]
        expected.append(list((raw[0] + raw[1]) / 10.0))
    for size in (1, 63, 64, 65, 128, 133):
        assert trees.shares(np.array(features[:size])).tolist() == expected[:size]


def test_no_row_walks_through_the_top_levels(spark):
    """Shallow trees answer from masks and leaves alone: nodes that all lead elsewhere change nothing."""
    rows, grown = _grown(spark, trees=6, depth=6, group_trees=6)
    trees = grown.sent(spark).value
    features = np.array([r.features for r in rows.collect()])
    assert replace(trees, nodes=np.zeros_like(trees.nodes)).shares(features).tolist() == trees.shares(features).tolist()


def test_trees_are_wrapped_for_python_only_when_asked_for(spark, tmp_path, monkeypatch):
    """Growing, storing, loading, depth, importances and scoring ask for none of them."""
    wrapped, init = [], DecisionTreeClassificationModel.__init__

    def counted(self, *given):
        wrapped.append(self)
        init(self, *given)

    monkeypatch.setattr(DecisionTreeClassificationModel, "__init__", counted)
    rows, grown = _grown(spark, trees=6, depth=4, group_trees=4)
    back = forest.load_forest(grown.save(str(tmp_path / "forest")).stored, 2)
    assert (back.trees, back.depth, back.importances()) == (6, grown.depth, grown.importances())
    assert back.shares(rows, "features", "p").count() == 600 and not wrapped
    assert {g.getOrDefault("maxDepth") for g in (*grown.groups, *back.groups)} == {4}
    assert max(tree.depth for g in back.groups for tree in g.trees) == back.depth and len(wrapped) == 6
