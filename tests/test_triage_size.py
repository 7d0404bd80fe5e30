"""How much the triage queries move and derive, whatever the size of the table."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

from vitalgrid.operators import evaluation, forest, triage
from vitalgrid.plans import model as model_queries, registry, triage as triage_queries
from vitalgrid.session import materialize

SF_DIR = "/root/testdata/sf0.001"
registry.load_all()


@pytest.mark.parametrize("columns", [("triage_id", "risk_level", "contributors"), ("triage_id", "alerts", "score")])
def test_scores_too_large_to_broadcast_move_narrow_rows(spark, capsys, columns):
    """Nothing is derived below the shuffle of the join: no texts, no symptoms."""
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        triage_queries.assessed(spark, SF_DIR).select(*columns).explain("simple")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    plan = capsys.readouterr().out
    above, joined, below = plan.partition("Join")
    assert joined and "Paciente" not in below and "chest pain" not in below and "chest pain" in above


def test_joined_requests_are_answered_as_by_assess(spark):
    """The join of narrow rows and that of requests give the same answers, also for ids without a score or that repeat."""
    scores = triage_queries.scores(spark, SF_DIR).filter("vec_id % 3 <> 0")
    scores = scores.unionByName(scores.filter("vec_id % 50 = 1"))
    columns = ("triage_id", "score", "risk_level", "confidence", "model_name", "alerts", "contributors")
    requests = triage_queries.requests(spark, SF_DIR)
    apart = triage.assess(requests, scores, importances=triage_queries.IMPORTANCES).select(*columns)
    beside = triage.assess(triage_queries.clinical.scored_triage_requests(spark, SF_DIR, scores), importances=triage_queries.IMPORTANCES).select(*columns)
    assert apart.count() == beside.count() > requests.count()
    assert apart.exceptAll(beside).isEmpty() and beside.exceptAll(apart).isEmpty()


def test_labels_and_features_share_what_is_parsed(spark, capsys):
    """The symptom set and the numbers are derived once; the result is that of each on its own."""
    requests = triage_queries.requests(spark, SF_DIR)
    once = triage.feature_vector(triage.severity_label(triage.parsed(requests))).select("triage_id", "severity_label", "features")
    once.explain("simple")
    assert capsys.readouterr().out.count("array_distinct") == 1
    twice = triage.feature_vector(triage.severity_label(requests)).select("triage_id", "severity_label", "features")
    assert once.exceptAll(twice).isEmpty() and twice.exceptAll(once).isEmpty()


def test_drawn_rows_come_from_a_bounded_part(spark):
    """The first of each class in hash order, NULL a class of its own; few other rows are read with them."""
    ids = spark.range(30_000).select(F.concat(F.lit("t"), "id").alias("triage_id"), F.when(F.col("id") % 5 == 0, "a").when(F.col("id") % 5 < 4, "b").alias("label"), F.lit(1.0).alias("x"))
    table = materialize(ids.unionByName(ids.filter("x = 1 AND triage_id < 't2'")), "drawing")
    drawn = forest.bounded_rows(table, 300, "label", 7)
    assert all("rows-to-draw-" in path for path in drawn.inputFiles())
    assert spark.read.parquet(*drawn.inputFiles()).count() < 600
    place = F.xxhash64(F.lit(7), F.col("triage_id"))
    for label in ("a", "b", None):
        of = lambda df: [r.triage_id for r in df.filter(F.col("label").eqNullSafe(F.lit(label))).orderBy(place, "triage_id").limit(100).collect()]
        assert of(drawn) == of(table) and drawn.filter(F.col("label").eqNullSafe(F.lit(label))).count() == 100


def test_split_brings_only_border_rows_together(spark, monkeypatch):
    """Copies of an id are grouped after the border has been found; each stored stage holds few rows."""
    stored = []

    def watched(df, name):
        result = materialize(df, name)
        stored.append((name, result.count()))
        return result

    monkeypatch.setattr(evaluation, "materialize", watched)
    table = materialize(spark.range(20_000).select(F.concat(F.lit("i"), F.col("id") % 15_000).alias("key"), (F.col("id") % 3).cast("string").alias("label")), "splitting")
    split = evaluation.stratified_split(table, "label", "key", 0.2, 5)
    assert split.count() == 20_000
    assert all(rows < 50 for name, rows in stored if name == "split-inside")
    assert split.groupBy("key", "label").agg(F.countDistinct("subset").alias("n")).filter("n > 1").isEmpty()
    for row in split.groupBy("label").agg(F.count_if(F.col("subset") == "val").alias("val"), F.count(F.lit(1)).alias("n")).collect():
        assert abs(row.val - 0.2 * row.n) <= 2


def test_parts_of_a_large_table_are_not_stored_again(spark, monkeypatch):
    """Split and drawn from the stored features in place; the same rows as from a stored split."""
    stored = []

    def watched(df, name):
        result = materialize(df, name)
        stored.append((name, result.count()))
        return result

    numbers = F.array(F.lit(0.5), (F.col("id") % 7).cast("double"))
    ids = spark.range(9_000).select(F.concat(F.lit("t"), "id").alias("triage_id"), numbers.alias("features"), F.when(F.col("id") % 3 == 0, "low").otherwise("high").alias("label"))
    table = materialize(ids, "to-part")
    monkeypatch.setattr(forest, "materialize", watched)
    part, rows, test = forest.prepare(table, "label", 3, 200)
    assert "parts" not in dict(stored) and dict(stored)["rows-to-draw"] < 1_000
    expected = materialize(forest.split_rows(table, "label", 3), "parts")
    for found, subset in ((part, "train"), (test, "val")):
        wanted = expected.filter(F.col("subset") == subset).select("triage_id", "features", "label")
        found = found.select("triage_id", "features", "label")
        assert found.exceptAll(wanted).isEmpty() and wanted.exceptAll(found).isEmpty()
    drawn = forest.bounded_rows(expected.filter("subset = 'train'"), 200, "label", 3).select("triage_id")
    assert rows.count() == 200 and rows.select("triage_id").exceptAll(drawn).isEmpty()


def test_first_look_of_the_split_shrinks_to_few_counts(spark, monkeypatch):
    """Counts by label and bucket stay far below the rows of a task."""
    assert 16 ** evaluation.BUCKET_DIGITS <= 4096
    monkeypatch.setattr(evaluation, "ORDERED_IDS", 0)  # every digit is looked at
    table = materialize(spark.range(300).select(F.col("id").cast("string").alias("key"), F.lit("a").alias("label")), "all-digits")
    split = evaluation.stratified_split(table, "label", "key", 0.2, 5)
    order = [r.key for r in table.orderBy(F.md5(F.concat(F.lit("5|"), "key"))).collect()]
    assert {r.key for r in split.filter("subset = 'val'").collect()} == set(order[:60])


def test_all_training_rows_are_fitted_on_unless_a_bound_is_asked_for(spark):
    """More rows than the published training set has, in one class above all: none is left out."""
    ids = spark.range(11_000).select(F.concat(F.lit("t"), "id").alias("triage_id"), F.array(F.lit(0.5), (F.col("id") % 7).cast("double")).alias("features"), F.when(F.col("id") % 50 == 0, "critical").otherwise("low").alias("label"))
    part, rows, test = forest.prepare(materialize(ids, "to-fit-on"), "label", 3)
    assert part.count() + test.count() == 11_000 and part.count() == 8_800
    assert rows.select("triage_id").exceptAll(part.select("triage_id")).isEmpty() and rows.count() == 8_800


def test_the_queries_fit_on_every_training_row(spark, tmp_path):
    """What the metrics document must say was fitted, by the query's own text, is what the queries fit on."""
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    keys = F.col("l_orderkey") + F.lit(1_000_000).cast(lines.schema["l_orderkey"].dataType)
    lines.unionByName(lines.withColumn("l_orderkey", keys)).coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    said = con.execute(f"SELECT training_samples, fitted_samples FROM ({registry.CHECKS['training_metrics_checks']}) q").fetchone()
    part, rows, _ = model_queries.prepared(spark, str(tmp_path))
    assert said == (part.count(), rows.count()) and said[1] > forest.FIT_ROWS
