"""The sample that classifiers are fitted on."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitalgrid.llm import sampling


def test_labels_without_a_fitting_document_are_replaced(spark):
    """Nine of ten labels have no document or too long a one; the sample is filled with the others."""
    labels = spark.range(1000).select(F.col("id").alias("doc_id"), (F.col("id") % 20 < 10).cast("int").alias("toxic"))
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 < 2, "short").otherwise("much too long").alias("text"))
    sample = sampling.labelled_sample(docs, labels, "toxic", F.lit(True), 40, 8).collect()
    assert len(sample) == 80 and sum(r["label"] for r in sample) == 40
    assert all(r["text"] == "short" and r["label"] == (r["doc_id"] % 20 < 10) for r in sample)
