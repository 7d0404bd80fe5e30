"""A bounded sample of labelled documents to fit a classifier on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalgrid.session import materialize


def class_totals(labels: DataFrame, label: str, training: Column) -> dict[int, int]:
    """Labelled ids of the training folds by class."""
    return {int(r["label"]): r["n"] for r in marks(labels, label, training).groupBy("label").agg(F.count("*").alias("n")).collect()}


def marks(labels: DataFrame, label: str, training: Column) -> DataFrame:
    """(doc_id, label 0 or 1) of the training folds. NULLs are left out; of several labels of an id the largest counts."""
    known = labels.select(labels["doc_id"].alias("doc_id"), (labels[label] > 0).cast("int").alias("label")).dropna().where(training)
    return known.groupBy("doc_id").agg(F.max("label").alias("label"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, training: Column, per_class: int, longest: int) -> DataFrame:
    """(doc_id, label, text) of at most ``per_class`` documents of each class, chosen by the hash of their ids.

    Texts of more than ``longest`` bytes are not sampled, others are taken whole; of rows with one
    id the smallest text is taken. Labels without such a document are left out first, so that
    the others fill the sample. Two top-k selections bound what is broadcast to ``2 * per_class``
    rows.
    """
    short = docs.where(F.octet_length("text") <= longest)
    known = materialize(marks(labels, label, training).join(short.select("doc_id"), "doc_id", "left_semi"), "fitting-labels")
    first = lambda c: known.where(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
    chosen = first(0).unionByName(first(1))
    return short.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
