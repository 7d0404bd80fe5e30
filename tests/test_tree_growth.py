"""Trees that tasks grow on many rows: against plain loops, and beside MLlib's."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from vitalgrid.operators import forest, tree_growth
from vitalgrid.session import materialize


class Recorded:
    """Draws of a generator, kept for the loops that repeat them."""

    def __init__(self, seed):
        self.rng, self.features, self.times = np.random.default_rng(seed), [], []

    def random(self, shape):
        self.features.append(self.rng.random(shape))
        return self.features[-1]

    def poisson(self, mean, n):
        self.times.append(self.rng.poisson(mean, n))
        return self.times[-1]


def _gini(counts):
    total = sum(counts)
    return 1 - sum((c / total) ** 2 for c in counts)


@pytest.mark.parametrize("without", [None, 1])
def test_each_node_takes_the_best_cut_of_its_features(without):
    """Every node by a loop over its rows, features and cuts; the rows of a fold left out; blocks of unequal size."""
    rng, bins, classes = np.random.default_rng(3), [2, 5, 1, 4, 3], 3
    n = 400
    codes = np.stack([rng.integers(0, b, n) for b in bins], axis=1).astype(np.uint8)
    label = ((codes[:, 1] > 2) + (codes[:, 3] > 1) * (rng.random(n) < 0.8)).astype(np.uint8)
    weight, fold = rng.choice([0.5, 1.0, 2.0], n), rng.integers(0, 3, n).astype(np.uint8)
    parts = [slice(0, 150), slice(150, 160), slice(160, 400)]
    draws = Recorded(8)
    tree = tree_growth.grow([(codes[p].ravel(), label[p], weight[p], fold[p]) for p in parts], bins, classes, 5, draws, without)
    mass = np.concatenate(draws.times) * weight * (1 if without is None else fold != without)
    held, level, seen = {0: mass > 0}, [0], 0
    for drawn in [*draws.features, None]:
        below, line = [], 0
        for node in level:
            counts = [mass[held[node] & (label == c)].sum() for c in range(classes)]
            assert list(tree["stats"][node]) == pytest.approx(counts)
            seen += 1
            if _gini(counts) == 0 or drawn is None:
                assert tree["feature"][node] == -1
                continue
            gains = {}
            for feature in np.argsort(drawn[line])[:3]:
                for cut in range(bins[feature] - 1):
                    sides = [held[node] & (codes[:, feature] <= cut), held[node] & (codes[:, feature] > cut)]
                    if all(s.any() for s in sides):
                        by_side = [[mass[s & (label == c)].sum() for c in range(classes)] for s in sides]
                        gains[feature, cut] = _gini(counts) - sum(sum(c) * _gini(c) for c in by_side) / sum(counts)
            line += 1
            taken = tree["feature"][node], tree["cut"][node]
            if taken[0] < 0:
                assert max(gains.values(), default=0) <= 1e-12
                continue
            assert gains[taken] == pytest.approx(max(gains.values())) and tree["gain"][node] == pytest.approx(gains[taken])
            right = codes[:, taken[0]] > taken[1]
            held[tree["left"][node]], held[tree["right"][node]] = held[node] & ~right, held[node] & right
            below += [tree["left"][node], tree["right"][node]]
        level = below
    assert seen == len(tree["feature"]) > 20


def test_cuts_come_from_all_values():
    """Few values part at every midpoint, one row in a hundred thousand too; many at even shares; NaN is beyond all cuts."""
    values = np.r_[np.zeros(60_000), np.ones(40_000), 7.0, math.nan]
    assert tree_growth.cuts_of(*tree_growth.told(values, np.ones(len(values)))).tolist() == [0.5, 4.0]
    assert tree_growth.cuts_of(*tree_growth.told(np.array([math.inf, -math.inf, 1.0]), np.ones(3))).tolist() == [-math.inf, 1.0]
    assert not len(tree_growth.cuts_of(*tree_growth.told(np.full(5, 2.0), np.ones(5))))
    many = np.random.default_rng(1).permutation(100_000) / 7.0
    known, rows = np.empty(0), np.empty(0, np.int64)
    for part in np.split(many, 10):
        known, rows = tree_growth.told(np.r_[known, part], np.r_[rows, np.ones(len(part), np.int64)])
    cuts = tree_growth.cuts_of(known, rows)
    assert rows.sum() == 100_000 and len(known) <= 1000 and len(cuts) == 31
    shares = np.bincount(np.searchsorted(cuts, many, "left"))
    assert abs(shares - 100_000 / 32).max() < 300


def _rows(spark, n=3_000):
    numbers = [F.pmod(F.xxhash64("id", F.lit(k)), F.lit(50)) / F.lit(3.0) for k in range(4)]
    rows = spark.range(n).select(F.col("id").cast("string").alias("triage_id"), array_to_vector(F.array(*numbers, F.lit(1.0))).alias("features"), (numbers[0] > 8).cast("double").alias("a"), (numbers[1] > 4).cast("double").alias("b"), "id")
    return materialize(rows.select("triage_id", "features", (F.col("a") + F.when(F.col("id") % 10 == 0, 0).otherwise(F.col("b"))).alias("label"), F.lit(1.5).alias("weight")), "many-rows")


def test_many_rows_grow_the_forest_that_mllib_grows(spark, tmp_path, monkeypatch):
    """The same rules, other draws: shares and importances near MLlib's; read back, answered and stored like its own."""
    rows = _rows(spark)
    small = forest.train_forest(rows, trees=60, depth=6, group_trees=40)
    monkeypatch.setattr(forest, "MLLIB_ROWS", 100)
    monkeypatch.setattr(tree_growth, "BLOCK_ROWS", 500)
    path = str(tmp_path / "grown")
    grown = forest.train_forest(rows, trees=60, depth=6, group_trees=40, path=path)
    assert [g.getNumTrees for g in grown.groups] == [40, 20] and grown.stored == path and grown.depth == 6 == small.depth
    assert {g.getOrDefault("maxDepth") for g in grown.groups} == {6} and grown.classes == 3
    assert sum(grown.importances()) == pytest.approx(1) and grown.importances()[4] == 0
    assert grown.importances() == pytest.approx(small.importances(), abs=0.12)
    found, wanted = (np.array([r.p for r in f.shares(rows, "features", "p").orderBy("triage_id").select("p").collect()]) for f in (grown, small))
    assert abs(found - wanted).mean() < 0.02
    for row in ([0.0] * 5, [9.0, 2.0, 3.0, math.nan, 1.0]):
        raw = sum(g.predictRaw(Vectors.dense(row)).toArray() for g in grown.groups)
        assert grown.sent(spark).value.shares(np.array([row]))[0].tolist() == list(raw / 60.0)
    assert forest.train_forest(rows, trees=60, depth=6, group_trees=40).importances() == grown.importances()


def test_a_fold_is_left_out_of_its_forest(spark, monkeypatch):
    """The rows of a fold leave no trace; a forest on one value of each feature is its classes' shares."""
    monkeypatch.setattr(forest, "MLLIB_ROWS", 100)
    fold = forest._fold(2, forest.SEED)
    rows = _rows(spark, 600)
    label = dict(rows.dtypes)["label"]
    rows = materialize(rows.withColumn("features", array_to_vector(F.array(F.lit(1.0), F.lit(2.0)))).withColumn("label", F.when(fold == 0, 0).otherwise(1).cast(label)), "two-folds")
    zero, one = forest.train_folds(rows, folds=2, trees=3, depth=3)
    answer = lambda f: f.shares(rows.limit(1), "features", "p").first().p
    assert (answer(zero), answer(one)) == ([0.0, 1.0], [1.0, 0.0]) and zero.depth == 0
