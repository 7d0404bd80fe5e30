"""Scores of the two classifiers against loops: every window of every filter, every labelled document."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import plain
import pytest
from pyspark.sql import functions as F

from vitalgrid.llm import quality_knn, toxicity


def some_texts(seed, many):
    """Texts of different lengths, some equal, some without a word."""
    draw = random.Random(seed)
    words = ["the", "and", "vile", "Calm", "WORD", "x9", "1984", "über", "(so)", "end.", "der", "die", "---", "漢字", "foot-note"]
    texts = ["", " \n\t", "vile", "the vile", "- -- -", "a" * 5000]
    for _ in range(many):
        n = draw.choice([1, 2, 3, 8, 40, 300])
        texts.append("".join(draw.choice(words) + draw.choice([" ", "  ", "\n"]) for _ in range(n)))
    return texts + texts[:10]


def plain_logit(net, text):
    """Word by word and filter by filter; beyond the end of a text there are zeros."""
    table = net.table.astype(float)
    words = plain.alnum(text)
    vectors = [sum((table[row] for row in toxicity.rows_of(w.encode())), np.zeros(toxicity.WIDTH)) for w in words]
    vectors = vectors or [np.zeros(toxicity.WIDTH)]
    total, place = net.offset, 0
    for filters in net.filters:
        for one in range(toxicity.FILTERS):
            best = -math.inf
            for start in range(len(vectors)):
                response = float(net.biases[place])
                for k in range(len(filters)):
                    if start + k < len(vectors):
                        response += float(vectors[start + k] @ filters[k][:, one])
                best = max(best, response)
            total += max(best, 0.0) * float(net.weights[place])
            place += 1
    return total


def plain_language(text):
    seen = Counter()
    for word in plain.alnum(text):
        for language, words in toxicity.FUNCTION_WORDS.items():
            seen[language] += word in words.split()
    best = max(seen.values(), default=0)
    return next((n for n, language in enumerate(toxicity.FUNCTION_WORDS) if best and seen[language] == best), len(toxicity.FUNCTION_WORDS))


def trained_network():
    texts = [f"{'vile' if n % 3 == 0 else 'calm'} word{n % 17} the and so on {n}" for n in range(150)]
    classifier = toxicity.fit(texts, np.array([n % 3 == 0 for n in range(150)], np.float32), {0: 100, 1: 50})
    classifier.thresholds = np.array([0.4, -1.0, 0.1, 0.0, 2.0])
    return classifier


def test_toxicity_score_is_the_forward_pass(spark):
    """Windows, pooling, the logistic layer and the threshold of the recognised language; NULL is empty."""
    classifier, texts = trained_network(), some_texts(1, 60)
    docs = spark.createDataFrame([*enumerate(texts), (-1, None)], "doc_id long, text string").repartition(3)
    scored = {r["doc_id"]: r["score"] for r in toxicity.score(docs, classifier, keep=("doc_id",)).select("doc.doc_id", "score").collect()}
    assert len(scored) == len(texts) + 1
    for number, text in [*enumerate(texts), (-1, "")]:
        margin = plain_logit(classifier.network, text) - classifier.thresholds[plain_language(text)]
        assert scored[number] == pytest.approx(1 / (1 + math.exp(-margin) * 3 / 7), abs=2e-4)


def test_toxicity_learns_what_toxic_documents_share():
    classifier = trained_network()
    toxic, clean = plain_logit(classifier.network, "a vile thing to say"), plain_logit(classifier.network, "a calm thing to say")
    assert toxic > 0 > clean


def test_ids_too_long_to_broadcast(spark, monkeypatch):
    known = spark.range(100).select(F.repeat(F.lit("x"), 100).alias("doc_id"))
    assert toxicity.can_be_broadcast(known) and toxicity.can_be_broadcast(known.limit(0))
    monkeypatch.setattr(toxicity, "FEW_BYTES", 9999)
    assert not toxicity.can_be_broadcast(known)
    monkeypatch.setattr(toxicity, "FEW_BYTES", 10_000)
    monkeypatch.setattr(toxicity, "FEW_LABELS", 99)
    assert not toxicity.can_be_broadcast(known)


def plain_counts(text):
    """Terms of a text, counted one by one."""
    counts, words = Counter(), text.encode().split()
    kinds = [quality_knn.shape(w) for w in words]
    for kind in kinds:
        counts[kind] += 1
    for a, b in zip(kinds, kinds[1:]):
        counts[quality_knn.SHAPES + (a * 31 + b * 7 + 3) % quality_knn.PAIRS] += 1
    first = quality_knn.SHAPES + quality_knn.PAIRS
    counts[first] = sum(a == b for a, b in zip(words, words[1:]))
    counts[first + 1] = len(words) - len(set(words))
    lines = [line for line in text.split("\n") if line.strip(quality_knn.SPACE)]
    counts[first + 2] = sum(len(line.split()) for line in lines) * (1 - len(set(lines)) / len(lines)) if lines else 0
    return counts


def plain_vector(space, text):
    counts = plain_counts(text)
    total = max(1, sum(counts[i] for i in range(quality_knn.SHAPES)))
    latent = [0.0] * space.axes.shape[1]
    for term, n in counts.items():
        for axis in range(len(latent)):
            latent[axis] += math.sqrt(n / total) * float(space.weights[term]) * float(space.axes[term, axis])
    norm = math.sqrt(sum(x * x for x in latent))
    return [x / norm if norm > 1e-12 else 0.0 for x in latent]


def plain_vote(space, text):
    """All cosines, the nearest by cosine and then by place, their weighted labels."""
    vector = plain_vector(space, text)
    cosines = [sum(a * float(b) for a, b in zip(vector, other)) for other in space.vectors]
    order = sorted(range(len(cosines)), key=lambda i: (-round(cosines[i] / quality_knn.STEP), i))[: quality_knn.NEIGHBOURS]
    weights = [max(cosines[i], 0.0) ** quality_knn.SHARPNESS * float(space.stands_for[i]) for i in order]
    if sum(weights) == 0:
        return space.share
    return sum(w * int(space.labels[i]) for w, i in zip(weights, order)) / sum(weights)


def space_of(texts, labels):
    shapes = quality_knn.Shapes()
    counts = np.stack([quality_knn.term_counts(t, shapes) for t in texts])
    return quality_knn.fit(counts, np.array(labels), {0: labels.count(0) * 4, 1: labels.count(1)})


def test_quality_score_is_the_vote_of_all_cosines(spark):
    labelled = [t for t in some_texts(2, 90) if t.strip()]
    space = space_of(labelled, [len(t) % 3 % 2 for t in labelled])
    texts = some_texts(3, 40)
    docs = spark.createDataFrame([*enumerate(texts), (-1, None)], "doc_id long, text string").repartition(3)
    scored = {r["doc_id"]: r["score"] for r in quality_knn.score(docs, space, keep=("doc_id",)).select("doc.doc_id", "score").collect()}
    assert len(scored) == len(texts) + 1 and scored[-1] == pytest.approx(space.share)
    for number, text in enumerate(texts):
        assert scored[number] == pytest.approx(plain_vote(space, text), abs=1e-6)


def test_equally_near_neighbours_vote_in_their_order():
    """Sixty copies of one labelled text, of which 25 vote: the first ones, in any block of any size."""
    texts, labels = ["one two (three) FOUR 5"] * 60 + ["Other Words, quite"] * 5, [0] * 10 + [1] * 50 + [0] * 5
    space = space_of(texts, labels)
    shapes = quality_knn.Shapes()
    asked = np.stack([quality_knn.term_counts(t, shapes) for t in [texts[0], texts[-1], "x y z"] * 80])
    voices = space.stands_for[:25]
    expected = float((voices * np.array(labels[:25])).sum() / voices.sum())
    alone = [float(space.scores(asked[n : n + 1])[0]) for n in range(3)]
    assert alone[0] == pytest.approx(expected)
    for size in (1, 2, 7, 64, 240):
        together = np.concatenate([space.scores(asked[n : n + size]) for n in range(0, len(asked), size)])
        assert together == pytest.approx(np.array(alone * 80), abs=1e-9)
