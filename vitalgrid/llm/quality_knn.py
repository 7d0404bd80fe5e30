"""Text quality by a vote of the nearest labelled documents.

A document is a bag of the shapes of its words (case, length, digits, marks before and behind)
and of pairs of them, with how often words repeat. A latent-semantic space is found on a
bounded sample of labelled documents, whose vectors are broadcast. For every document the
cosines with all of them are computed, block by block and exactly, and its nearest neighbours
vote with a weight that grows with similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitalgrid.llm import sampling
from vitalgrid.llm.common import id_and_text

#: Most documents of each class that vote, and the longest, in bytes, that does.
PER_CLASS, LONGEST = 1500, 1 << 16
SHAPES, PAIRS = 512, 512
#: Terms behind shapes and pairs: words equal to the one before, words seen before, lines seen before.
REPEATS = 3
TERMS = SHAPES + PAIRS + REPEATS
RANK, NEIGHBOURS, SHARPNESS = 48, 25, 8.0
#: Cosines that agree to this part of one are equal: sums differ in their last bits with the block they are taken in.
STEP = 2.0**-36
#: Documents compared together.
BLOCK = 256
#: Distinct words a task remembers.
REMEMBERED = 400_000
SPACE = " \t\n\x0b\x0c\r"


def shape(word: bytes) -> int:
    """A small number for how a word is written, whatever its letters."""
    text = word.decode()
    letters = [i for i, c in enumerate(text) if c.isalnum()]
    if not letters:
        return xxhash.xxh32_intdigest("marks " + text[:3]) % SHAPES
    body = text[letters[0] : letters[-1] + 1]
    if body.isdigit():
        case = "digits"
    elif any(c.isdigit() for c in body):
        case = "mixed"
    elif body.isupper() and len(body) > 1:
        case = "upper"
    elif body[:1].isupper():
        case = "title" if body[1:].islower() or len(body) == 1 else "odd"
    else:
        case = "lower" if body.islower() else "odd"
    inner = "" if body.isalnum() else "-"
    length = sum(len(body) > n for n in (3, 7, 12, 20))
    return xxhash.xxh32_intdigest(f"{text[: letters[0]][:3]} {case}{inner}{length} {text[letters[-1] + 1 :][:3]}") % SHAPES


class Shapes(dict):
    """Shape and number of a word in one number, found once as long as it is remembered."""

    def __missing__(self, word: bytes) -> int:
        self[word] = shape(word) | len(self) << 9
        return self[word]


def term_counts(text: str, shapes: Shapes) -> np.ndarray:
    """How often each of the TERMS occurs in a text."""
    counts = np.zeros(TERMS, np.float32)
    words = text.encode().split()
    if not words:
        return counts
    coded = np.fromiter(map(shapes.__getitem__, words), np.int64, len(words))
    kinds = coded & (SHAPES - 1)
    counts[:SHAPES] = np.bincount(kinds, minlength=SHAPES)
    counts[SHAPES : SHAPES + PAIRS] = np.bincount((kinds[:-1] * 31 + kinds[1:] * 7 + 3) % PAIRS, minlength=PAIRS)
    lines = [line for line in text.split("\n") if line.strip(SPACE)]
    again = sum(len(line.split()) for line in lines) * (1 - len(set(lines)) / len(lines))
    counts[-REPEATS:] = (coded[1:] == coded[:-1]).sum(), len(words) - len(np.unique(coded)), again
    return counts


@dataclass
class Space:
    """``weights`` of the terms, ``axes`` of the space, the unit ``vectors`` of labelled documents
    with their ``labels`` and the number of documents each stands for."""

    weights: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    stands_for: np.ndarray
    share: float

    @staticmethod
    def weighted(counts: np.ndarray, weights: np.ndarray) -> np.ndarray:
        return np.sqrt(counts / np.maximum(counts[:, :SHAPES].sum(1, keepdims=True), 1)) * weights

    def project(self, counts: np.ndarray) -> np.ndarray:
        """Unit vectors; a document without words has the zero vector."""
        latent = self.weighted(counts, self.weights) @ self.axes
        return latent / np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)

    def scores(self, counts: np.ndarray) -> np.ndarray:
        """The weighted vote of the nearest; the share of good labels where nothing is similar.

        Of vectors that are equally near the earlier votes, so that one text has one score in
        any block.
        """
        if not len(self.labels):
            return np.full(len(counts), self.share)
        similar = self.project(counts.astype(np.float64)) @ self.vectors.T
        near = min(NEIGHBOURS, similar.shape[1])
        steps = np.rint(similar / STEP)
        distance = np.arange(steps.shape[1]) - steps * steps.shape[1]
        places = np.sort(np.argpartition(distance, near - 1, axis=1)[:, :near], axis=1)
        weight = np.maximum(np.take_along_axis(steps, places, 1) * STEP, 0) ** SHARPNESS * self.stands_for[places]
        total = weight.sum(1)
        return np.where(total > 0, (weight * self.labels[places]).sum(1) / np.maximum(total, 1e-300), self.share).clip(0, 1)


def fit(counts: np.ndarray, labels: np.ndarray, totals: dict[int, int]) -> Space:
    """Axes are the strongest directions of the weighted counts (their singular vectors, found
    on the square of the term matrix, whose size does not depend on the sample)."""
    share = totals.get(1, 0) / max(1, sum(totals.values()))
    counts = counts.astype(np.float64)
    weights = np.log((len(counts) + 1) / ((counts > 0).sum(0) + 1)) + 1
    weights[-REPEATS:] = weights.mean()
    matrix = Space.weighted(counts, weights)
    values, directions = np.linalg.eigh(matrix.T @ matrix)
    axes = directions[:, np.argsort(-values)[:RANK]]
    sampled = {c: max(1, int((labels == c).sum())) for c in (0, 1)}
    # as many documents as its class has for each sampled one, softened: the rarer class keeps a voice
    stands_for = np.array([np.sqrt(totals.get(int(c), 1) / sampled[int(c)]) for c in labels])
    space = Space(weights, axes, np.zeros((0, RANK)), labels, stands_for, share)
    space.vectors = space.project(counts)
    return space


def fit_on(docs: DataFrame, labels: DataFrame, training: Column, per_class: int = PER_CLASS, longest: int = LONGEST, label: str = "quality") -> Space:
    """Fits on at most ``per_class`` labelled documents of each class, of at most ``longest`` bytes; only their counts come to the driver."""
    totals = sampling.class_totals(labels, label, training)

    @F.arrow_udf(T.BinaryType())
    def counted(texts: pa.Array) -> pa.Array:
        shapes = Shapes()
        return pa.array([term_counts(t, shapes).tobytes() for t in texts.to_pylist()], pa.binary())

    sample = sampling.labelled_sample(id_and_text(docs), labels, label, training, per_class, longest)
    rows = sorted(sample.select("label", counted("text").alias("counts")).collect())
    counts = np.stack([np.frombuffer(r["counts"], np.float32) for r in rows]) if rows else np.zeros((0, TERMS), np.float32)
    return fit(counts, np.array([r["label"] for r in rows], np.int64), totals)


def score(docs: DataFrame, space: Space, text_col: str = "text", keep: tuple[str, ...] = ("*",)) -> DataFrame:
    """(doc, score): the columns named in ``keep`` as a struct, and the score of the whole text.

    Only the text is scored. NULL, empty and blank texts, and all texts if there are no labels,
    score the share of good labels. Equal texts have equal scores; of labelled documents that are
    equally near, those of label 0 vote first, then those of smaller counts.
    """
    shared = docs.sparkSession.sparkContext.broadcast(space)

    @F.arrow_udf(T.DoubleType())
    def scores(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        shapes = Shapes()
        for batch in batches:
            out = []
            for first in range(0, len(batch), BLOCK):
                if len(shapes) > REMEMBERED:
                    shapes.clear()
                texts = batch[first : first + BLOCK].to_pylist()
                out.append(shared.value.scores(np.stack([term_counts(t or "", shapes) for t in texts])))
            yield pa.array(np.concatenate(out) if out else [], pa.float64())

    return docs.select(F.struct(*keep).alias("doc"), scores(docs[text_col]).alias("score"))
