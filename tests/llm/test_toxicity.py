"""Thresholds of the toxicity network: from all labelled documents that are not fitted, by language."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitalgrid.llm import toxicity

WORDS = {"en": "the of and to is", "de": "der die das und von"}


def documents():
    """English and German documents, a fifth of them toxic; the German ones are mostly too long to be fitted."""
    for n in range(1200):
        lang = "de" if n % 4 == 0 else "en"
        toxic = n % 5 == 0
        text = f"{WORDS[lang]} {'vile' if toxic and n % 3 else 'calm'} word{n % 37} {'vile' if n % 11 == 0 else ''}"
        yield n, text + " filler" * (200 if lang == "de" else 0), int(toxic)


@pytest.fixture(scope="module")
def tables(spark):
    rows = list(documents())
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    return docs, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")


@pytest.mark.parametrize("few", [True, False])
def test_all_labelled_documents_are_counted(spark, tables, few):
    docs, labels = tables
    classifier = toxicity.fit([r[1] for r in documents()][:200], np.array([r[2] for r in documents()][:200], np.float32), {0: 960, 1: 240})
    cells = toxicity.calibration_counts(docs.unionByName(docs.limit(7)), labels.withColumnRenamed("toxic", "label"), classifier, list(range(200)), 400, few).collect()
    assert sum(c["n"] for c in cells) == 1200 and sum(c["n"] for c in cells if c["is_fitted"]) == 200
    assert sum(c["n"] for c in cells if c["language"] == 1) == 300 == sum(c["n"] for c in cells if not c["can_be_fitted"])
    scorer = toxicity.Scorer(classifier)
    _, logits = scorer.judge([r[1] for r in documents()])
    steps = sorted(c["step"] for c in cells for _ in range(c["n"]))
    assert np.allclose(np.array(steps) / toxicity.GRID, np.sort(logits), atol=1.01 / toxicity.GRID)


def test_every_language_is_calibrated(spark, tables):
    """60 toxic German documents are known, all longer than what is fitted: they set a threshold of their own."""
    docs, labels = tables
    classifier = toxicity.fit_on(docs, labels, F.lit(True), per_class=40, longest=400)
    en, de, *others = classifier.thresholds
    assert len({*others}) == 1 and others[0] not in (0, de) and en != 0
    scorer, rows = toxicity.Scorer(classifier), [r for r in documents() if r[0] % 4 == 0]
    _, logits = scorer.judge([r[1] for r in rows])
    toxic = np.array([r[2] for r in rows]) > 0
    f1 = lambda t: 2 * (toxic & (logits >= t)).sum() / ((logits >= t).sum() + toxic.sum())
    assert f1(de) >= max(f1(t) for t in logits) - 0.02


def test_best_threshold():
    logits, toxic, clean = np.array([0.0, 2.0, 1.0]), np.array([0.0, 3.0, 1.0]), np.array([9.0, 0.0, 5.0])
    assert toxicity.best_threshold(logits, toxic, clean) == 1.5
