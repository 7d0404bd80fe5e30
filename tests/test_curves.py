"""Calibration in batches against MLlib's curves and Spark's rounding; and rows dealt evenly over the cores."""

from __future__ import annotations

import math
import random

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import functions as F

from vitalgrid.operators import curves, forest
from vitalgrid.session import materialize
from vitalgrid.sources import clinical


def _curve(spark, points):
    rows = spark.createDataFrame(points, "features double, label double, weight double")
    return IsotonicRegression(weightCol="weight").fit(rows)


def test_rounding_is_that_of_spark_on_every_half_and_beside_it(spark):
    for digits in (1, 4, 6):
        steps = range(10**digits) if digits < 5 else random.Random(1).sample(range(10**digits), 5000)
        halves = [(2 * n + 1) / (2 * 10**digits) for n in steps]
        shares = [x for h in halves for x in (h, math.nextafter(h, 0.0), math.nextafter(h, 1.0))] + [0.0, 1.0, 1 / 3, 2 / 3, 5e-324]
        rows = spark.createDataFrame([(n, x) for n, x in enumerate(shares)], "n int, x double")
        expected = [r.y for r in rows.orderBy("n").select(F.round("x", digits).alias("y")).collect()]
        assert curves.on_grid(np.array(shares), digits).tolist() == expected


def test_a_curve_answers_as_mllib_does(spark):
    draw = random.Random(7)
    points = [(draw.randrange(1, 9999) / 10000, float(draw.random() < 0.4), 1.0 + draw.randrange(5)) for _ in range(300)]
    for some in (points, points[:1], [(0.2, 1.0, 1.0), (0.7, 0.0, 3.0)], [(0.1, 0.0, 1.0), (0.3, 1 / 3, 1.0), (0.9, 1.0, 2.0)]):
        model = _curve(spark, some)
        asked = [n / 500 for n in range(501)] + model.boundaries.toArray().tolist()
        rows = spark.createDataFrame([(n, x) for n, x in enumerate(asked)], "n int, features double")
        expected = [r.prediction for r in model.transform(rows).orderBy("n").collect()]
        assert curves.Curve(model.boundaries.toArray(), model.predictions.toArray()).at(np.array(asked)).tolist() == expected


def _by_steps(model, rows, k):
    """The definition, with MLlib's calibrators on columns."""
    scored = rows.withColumns({f"_p{n}": grown.votes(rows.sparkSession, F.col("features")) for n, (grown, _) in enumerate(model.folds)})
    totals = [F.lit(0.0)] * k
    for n, (_, calibrators) in enumerate(model.folds):
        scored = materialize(scored.withColumns({f"_s{n}_{i}": F.round(F.col(f"_p{n}")[i], model.score_digits) for i in range(k)}), "steps")
        for i, calibrator in enumerate(calibrators):
            scored = calibrator.copy()._set(featuresCol=f"_s{n}_{i}", predictionCol=f"_q{n}_{i}").transform(scored)
        mass = sum((F.col(f"_q{n}_{i}") for i in range(1, k)), F.col(f"_q{n}_0"))
        totals = [t + F.when(mass > 0, F.col(f"_q{n}_{i}") / mass).otherwise(1.0 / k) for i, t in enumerate(totals)]
    return scored.select("id", F.array(*[t / F.lit(float(len(model.folds))) for t in totals]).alias("probabilities"))


def test_calibration_goes_with_the_trees_and_gives_the_same_bits(spark, capsys):
    """One Python pass that returns one array, no function of MLlib on a row; a fold whose curves are all zero too."""
    numbers = spark.range(400).select(
        "id", F.array(*[(F.pmod(F.xxhash64("id", F.lit(n)), F.lit(1000)) / F.lit(7.0)).cast("double") for n in range(4)]).alias("features"),
        F.pmod(F.xxhash64("id"), F.lit(3)).cast("double").alias("label"), F.lit(1.0).alias("weight"),
    )
    rows = materialize(numbers, "curve-rows")
    fit = rows.withColumn("features", array_to_vector("features"))
    forests = [forest.train_forest(fit.filter(F.col("id") % 2 == n), trees=6, depth=5, group_trees=3, seed=n) for n in range(2)]
    rising, zero = _curve(spark, [(0.1, 0.0, 1.0), (0.4, 0.7, 2.0), (0.8, 0.3, 1.0), (0.9, 1.0, 1.0)]), _curve(spark, [(0.0, 0.0, 1.0), (1.0, 0.0, 1.0)])
    model = forest.CalibratedForest(forests[0], ((forests[0], (rising, zero, rising)), (forests[1], (zero,) * 3), (forests[1], (zero, rising, rising))), ("a", "b", "c"))
    scored = forest.score(model, rows.select("id", "features"))
    scored.explain("simple")
    plan = capsys.readouterr().out
    assert plan.count("ArrowEvalPython") == 1 and "UDF(_s" not in plan and "round(" not in plan
    found = {r.id: r.probabilities for r in scored.select("id", "probabilities").collect()}
    assert found == {r.id: r.probabilities for r in _by_steps(model, rows, 3).collect()} and len(found) == 400
    as_vectors = forest.score(model, fit.select("id", "features"))
    assert {r.id: r.probabilities for r in as_vectors.select("id", "probabilities").collect()} == found


def test_few_large_row_groups_are_dealt_evenly(spark, tmp_path):
    """A file of one row group is cut into a task for each core, and one of them would get all rows."""
    cores, n = spark.sparkContext.defaultParallelism, 40_000
    spark.range(n).selectExpr(
        "id AS l_orderkey", "id % 2000 AS l_partkey", "id % 100 AS l_suppkey", "CAST(id % 7 AS INT) AS l_linenumber", "CAST(id % 50 AS DOUBLE) AS l_quantity",
        "0.05D AS l_discount", "0.02D AS l_tax", "current_timestamp() AS l_shipdate",
    ).coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    size = sum(p.stat().st_size for p in (tmp_path / "lineitem.parquet").glob("*.parquet"))
    try:
        for key in before:
            spark.conf.set(key, str(size // cores - 1000))
        plain = clinical.triage_requests(spark, str(tmp_path))
        assert cores <= plain.rdd.getNumPartitions() < 2 * cores
        rows = lambda df: sorted(r["n"] for r in df.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect())
        assert rows(plain)[-1] == n and rows(clinical.triage_requests(spark, str(tmp_path), over_cores=1))[-1] == n
        dealt = rows(clinical.triage_requests(spark, str(tmp_path), over_cores=4))
        assert sum(dealt) == n and dealt[-1] < 2 * n / cores
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
