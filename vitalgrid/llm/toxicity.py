"""Toxicity by a small convolutional network over hashed word embeddings.

A word's vector is the sum of a few rows of a table, found by hashing the word and its
beginnings, so that inflected forms share most of it and words that share a row by chance
are told apart by the others. Filters of one, two and three words slide over the text, each
keeps its largest response (max pooling), and a logistic layer weighs them. The network is
trained here, in numpy, on a bounded sample of labelled documents; the threshold is set for
each language, which is recognised by its function words, on all labelled documents that were
not fitted.
"""

from __future__ import annotations

from collections import Counter
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
from vitalgrid.llm.licenses import WORD_BYTES

#: Most documents of each class that are fitted, and the longest, in bytes, that is.
PER_CLASS, LONGEST = 1500, 1 << 16
#: Rows of the table; lengths of the beginnings that are hashed next to the whole word.
ROWS, BEGINNINGS = 1 << 17, (3, 4, 5, 6, 7)
WIDTH, FILTERS, SPANS = 8, 8, (1, 2, 3)
EPOCHS, BATCH, RATE, DECAY = 14, 32, 0.02, 1e-4
#: Gradient that the rows of the table are taken to have seen; the larger, the less a rare word moves.
TABLE_START = 3e-4
#: The score at a language's threshold.
AT_THRESHOLD = 0.7
#: Fewer calibration documents of either class, and a language has the common threshold.
LEAST_CALIBRATION = 15
#: Steps to a unit of the logits that thresholds are chosen from, and the largest logit told apart.
GRID, FARTHEST = 256, 64
#: Up to this many labels, with ids of this many bytes as text, their ids are broadcast.
FEW_LABELS, FEW_BYTES = 1 << 20, 1 << 26
#: Words scored together.
TOGETHER = 1 << 17
#: Distinct words a task remembers.
REMEMBERED = 400_000
# Function words of the languages.
FUNCTION_WORDS = {
    "en": "the of and to is that it for with was as are this be by from",
    "de": "der die das und von den nicht sich mit ist dem ein auf für eine",
    "fr": "le les des et du une dans que qui pour est au sur par avec",
    "es": "el los las que y del se con para una su por al lo como",
}
LANGUAGES = (*FUNCTION_WORDS, "other")


FUNCTION_WORD = {w.encode(): n for n, words in enumerate(FUNCTION_WORDS.values()) for w in words.split()}


def rows_of(word: bytes) -> list[int]:
    """Rows of the word and its beginnings; row ROWS, of zeros, stands for those it does not have."""
    text = word.decode()
    parts = [text, *(f"{text[:n]}-" for n in BEGINNINGS if n <= len(text))]
    hashed = [xxhash.xxh64_intdigest(p) % ROWS for p in parts]
    return hashed + [ROWS] * (len(BEGINNINGS) + 1 - len(hashed))


class Words(dict):
    """Numbers words as they come; keeps their rows and languages."""

    def __init__(self) -> None:
        super().__init__()
        self.rows = np.empty((1024, len(BEGINNINGS) + 1), np.int32)
        self.languages = np.empty(1024, np.int8)

    def __missing__(self, word: bytes) -> int:
        number = len(self)
        if number == len(self.rows):
            self.rows = np.concatenate([self.rows, np.empty_like(self.rows)])
            self.languages = np.concatenate([self.languages, np.empty_like(self.languages)])
        self.rows[number] = rows_of(word)
        self.languages[number] = FUNCTION_WORD.get(word, len(FUNCTION_WORDS))
        self[word] = number
        return number

    def encode(self, text: str) -> np.ndarray:
        words = text.encode().translate(WORD_BYTES).split()
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def language_of(languages: np.ndarray) -> int:
    """The language with most function words; of equal ones the first; ``other`` if there are none."""
    seen = np.bincount(languages, minlength=len(LANGUAGES))[:-1]
    return int(seen.argmax()) if seen.any() else len(LANGUAGES) - 1


def lay_out(documents: list[np.ndarray], empty: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents one after the other, with ``empty`` words between them for spans that reach
    beyond an end, and one for a document without words: (words, starts, ends)."""
    reach = max(SPANS) - 1
    lengths = np.array([max(1, len(d)) for d in documents])
    starts = np.concatenate([[0], np.cumsum(lengths + reach)[:-1]])
    words = np.full(int((lengths + reach).sum()), empty)
    for start, document in zip(starts, documents):
        words[start : start + len(document)] = document
    return words, starts, starts + lengths


@dataclass
class Network:
    """``table``: (ROWS + 1, WIDTH), the last row zero; ``filters``: per span (span, WIDTH, FILTERS)."""

    table: np.ndarray
    filters: list[np.ndarray]
    biases: np.ndarray  # of all filters, span by span
    weights: np.ndarray
    offset: float

    @staticmethod
    def start(seed: int = 7) -> Network:
        random = np.random.default_rng(seed)
        table = random.normal(0, 0.05, (ROWS + 1, WIDTH)).astype(np.float32)
        table[-1] = 0
        filters = [random.normal(0, 0.5 / np.sqrt(s), (s, WIDTH, FILTERS)).astype(np.float32) for s in SPANS]
        count = FILTERS * len(SPANS)
        return Network(table, filters, np.zeros(count, np.float32), random.normal(0, 0.3, count).astype(np.float32), 0.0)

    def vectors(self, rows: np.ndarray) -> np.ndarray:
        return self.table[rows].sum(1)

    def responses(self, vectors: np.ndarray) -> np.ndarray:
        """Of every filter (column) to the words from every place (row) on."""
        size = len(vectors) - max(SPANS) + 1
        return np.concatenate([sum(vectors[k : k + size] @ f[k] for k in range(len(f))) for f in self.filters], axis=1) + self.biases

    def logits(self, responses: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        cuts = np.stack([starts, ends], 1).ravel()
        top = np.maximum.reduceat(responses, cuts[:-1] if cuts[-1] >= len(responses) else cuts, axis=0)[::2]
        return np.maximum(top, 0) @ self.weights + self.offset


class Adagrad:
    """Steps that shrink where gradients were large; for tables, only in the rows touched."""

    def __init__(self, value: np.ndarray, rate: float, start: float = 1e-6) -> None:
        self.value, self.rate, self.seen = value, rate, np.full(value.shape, start, np.float32)

    def step(self, gradient: np.ndarray, at: tuple | slice = slice(None)) -> None:
        self.seen[at] += gradient**2
        self.value[at] -= self.rate * gradient / np.sqrt(self.seen[at])


def train(documents: list[np.ndarray], rows: np.ndarray, labels: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> Network:
    """Logistic loss, by mini-batches; only what was largest in a document gets a gradient.

    ``documents``: numbers of words, ``rows``: the table rows of every word.
    """
    net, random = Network.start(seed), np.random.default_rng(seed + 1)
    table, biases, weights = Adagrad(net.table, RATE, TABLE_START), Adagrad(net.biases, RATE), Adagrad(net.weights, RATE)
    filter_movers = [Adagrad(f, RATE) for f in net.filters]
    rows, empty = np.concatenate([rows, np.full((1, rows.shape[1]), ROWS)]), len(rows)
    for _ in range(epochs):
        order = random.permutation(len(documents))
        for first in range(0, len(order), BATCH):
            some = order[first : first + BATCH]
            words, starts, ends = lay_out([documents[i] for i in some], empty)
            vectors = net.vectors(rows[words])
            responses = net.responses(vectors)
            place = np.stack([responses[s:e].argmax(0) + s for s, e in zip(starts, ends)])
            top = np.take_along_axis(responses, place, 0)
            active = np.maximum(top, 0)
            error = (1 / (1 + np.exp(-(active @ net.weights + net.offset))) - labels[some]) / len(some)
            into = (error[:, None] * net.weights[None, :] * (top > 0)).astype(np.float32)
            weights.step((error @ active + DECAY * net.weights).astype(np.float32))
            biases.step(into.sum(0))
            net.offset -= 5 * RATE * float(error.sum())
            touched, gradients = [], []
            for span, (filters, mover) in enumerate(zip(net.filters, filter_movers)):
                own = slice(span * FILTERS, (span + 1) * FILTERS)
                change = DECAY * filters
                for k in range(len(filters)):
                    at = place[:, own] + k
                    change[k] += np.einsum("dfw,df->wf", vectors[at], into[:, own])
                    touched.append(words[at].ravel())
                    gradients.append((into[:, own, None] * filters[k].T[None]).reshape(-1, WIDTH))
                mover.step(change)
            at, gradient = rows[np.concatenate(touched)], np.concatenate(gradients)
            distinct, where = np.unique(at, return_inverse=True)
            total = np.zeros((len(distinct), WIDTH), np.float32)
            np.add.at(total, where.reshape(at.shape), gradient[:, None, :])
            real = distinct < ROWS
            table.step(total[real], distinct[real])
    return net


def best_threshold(logits: np.ndarray, toxic: np.ndarray, clean: np.ndarray) -> float:
    """The logit between two steps of the grid at which F1 is largest; weights of the documents at each of ``logits``, all distinct."""
    order = np.argsort(-logits)
    caught, wrong = np.cumsum(toxic[order]), np.cumsum(clean[order])
    best = int((2 * caught / (caught + wrong + toxic.sum())).argmax())
    below = logits[order[best + 1]] if best + 1 < len(order) else logits[order[best]] - 1 / GRID
    return float((logits[order[best]] + below) / 2)


@dataclass
class Classifier:
    network: Network | None
    thresholds: np.ndarray  # by language
    share: float  # of toxic labels, for want of a network


class Scorer:
    """Scores texts; computes a word's vector and responses once as long as it is remembered."""

    def __init__(self, classifier: Classifier) -> None:
        self.classifier, self.words, self.vectors = classifier, Words(), np.zeros((0, WIDTH), np.float32)

    def logits(self, documents: list[np.ndarray]) -> np.ndarray:
        net, known, out = self.classifier.network, len(self.vectors), []
        if known < len(self.words):
            self.vectors = np.concatenate([self.vectors, net.vectors(self.words.rows[known : len(self.words)])])
        first = 0
        while first < len(documents):
            last, size = first + 1, len(documents[first])
            while last < len(documents) and size + len(documents[last]) <= TOGETHER:
                size += len(documents[last])
                last += 1
            words, starts, ends = lay_out(documents[first:last], -1)
            vectors = self.vectors[words] if len(self.vectors) else np.zeros((len(words), WIDTH), np.float32)
            vectors[words < 0] = 0
            out.append(net.logits(net.responses(vectors), starts, ends))
            first = last
        return np.concatenate(out)

    def judge(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Recognised languages and logits."""
        if len(self.words) > REMEMBERED:
            self.__init__(self.classifier)
        documents = [self.words.encode(t) for t in texts]
        return np.array([language_of(self.words.languages[d]) for d in documents]), self.logits(documents)

    def codes(self, texts: list[str]) -> np.ndarray:
        """The step of the grid next to the logit, times the number of languages, plus the language."""
        languages, logits = self.judge(texts)
        return np.rint(np.clip(logits, -FARTHEST, FARTHEST) * GRID).astype(np.int64) * len(LANGUAGES) + languages

    def scores(self, texts: list[str]) -> np.ndarray:
        classifier = self.classifier
        if classifier.network is None or not texts:
            return np.full(len(texts), classifier.share)
        languages, logits = self.judge(texts)
        margin = logits - classifier.thresholds[languages]
        return 1 / (1 + np.exp(-np.clip(margin + np.log(AT_THRESHOLD / (1 - AT_THRESHOLD)), -500, 500)))


def fit(texts: list[str], labels: np.ndarray, totals: dict[int, int], seed: int = 7) -> Classifier:
    """Trains on all of ``texts``; thresholds are not set. ``totals``: labelled documents by class."""
    unset, share = np.zeros(len(LANGUAGES)), totals.get(1, 0) / max(1, sum(totals.values()))
    if min((labels > 0).sum(), (labels == 0).sum()) < 1:
        return Classifier(None, unset, share)
    words = Words()
    documents = [words.encode(t) for t in texts]
    return Classifier(train(documents, words.rows[: len(words)], labels, seed=seed), unset, share)


def calibration_counts(docs: DataFrame, known: DataFrame, classifier: Classifier, fitted: list, longest: int, few: bool) -> DataFrame:
    """(is_fitted, can_be_fitted, label, language, step, n): labelled documents by step of their logit.

    Every document of ``known`` (doc_id, label) is scored, and counts once: of rows with one id
    the least code does. If the labels are ``few`` their ids are broadcast and only labelled
    documents are scored; otherwise all are, so that no text is shuffled.
    """
    shared, languages = docs.sparkSession.sparkContext.broadcast(classifier), len(LANGUAGES)

    @F.arrow_udf(T.LongType())
    def codes(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(shared.value)
        for batch in batches:
            parts = [scorer.codes([t or "" for t in batch[n : n + 256].to_pylist()]) for n in range(0, len(batch), 256)]
            yield pa.array(np.concatenate(parts) if parts else [], pa.int64())

    rows = docs.join(F.broadcast(known.select("doc_id")), "doc_id", "left_semi") if few else docs
    short = F.coalesce(F.octet_length("text") <= longest, F.lit(False))
    coded = rows.select("doc_id", short.alias("short"), codes("text").alias("code"))
    one = coded.groupBy("doc_id").agg(F.max("short").alias("can_be_fitted"), F.min("code").alias("code"))
    cells = one.join(known, "doc_id").groupBy(F.col("doc_id").isin(fitted).alias("is_fitted"), "can_be_fitted", "label", "code").agg(F.count("*").alias("n"))
    return cells.select("is_fitted", "can_be_fitted", "label", F.pmod("code", F.lit(languages)).alias("language"), F.floor(F.col("code") / languages).alias("step"), "n")


def choose_thresholds(cells: list) -> np.ndarray:
    """The threshold of each language, from the documents that were not fitted.

    They stand for the fitted ones as well: a class is weighted by its documents to those of
    it left, apart for texts that could and that could not be fitted.
    """
    totals, left = Counter(), Counter()
    for c in cells:
        totals[c["can_be_fitted"], c["label"]] += c["n"]
        left[c["can_be_fitted"], c["label"]] += 0 if c["is_fitted"] else c["n"]
    by_language: list[dict] = [{} for _ in range(len(LANGUAGES) + 1)]  # the last: of all of them
    seen = np.zeros((len(LANGUAGES) + 1, 2), np.int64)
    for c in cells:
        if not c["is_fitted"]:
            group = c["can_be_fitted"], c["label"]
            for n in (c["language"], len(LANGUAGES)):
                by_language[n].setdefault(c["step"], [0.0, 0.0])[c["label"]] += c["n"] * totals[group] / left[group]
                seen[n, c["label"]] += c["n"]
    thresholds = np.zeros(len(LANGUAGES))
    for n in (len(LANGUAGES), *range(len(LANGUAGES))):
        if seen[n].min() >= (1 if n == len(LANGUAGES) else LEAST_CALIBRATION):
            weights = np.array(list(by_language[n].values()))
            best = best_threshold(np.array(list(by_language[n])) / GRID, weights[:, 1], weights[:, 0])
            thresholds[n if n < len(LANGUAGES) else slice(None)] = best
    return thresholds


def can_be_broadcast(known: DataFrame) -> bool:
    """Whether the ids of the labels are few and short enough to send to every task."""
    size = known.agg(F.count("*").alias("n"), F.sum(F.octet_length(F.col("doc_id").cast("string"))).alias("bytes")).first()
    return size["n"] <= FEW_LABELS and (size["bytes"] or 0) <= FEW_BYTES


def fit_on(docs: DataFrame, labels: DataFrame, training: Column, per_class: int = PER_CLASS, longest: int = LONGEST, label: str = "toxic") -> Classifier:
    """Fits on four fifths of at most ``per_class`` labelled documents of each class, of at most ``longest``
    bytes: that much the driver holds. All other labelled documents, of any length, set the thresholds."""
    totals = sampling.class_totals(labels, label, training)
    rows = sampling.labelled_sample(id_and_text(docs), labels, label, training, per_class, longest).collect()
    rows.sort(key=lambda r: (xxhash.xxh64_intdigest(str(r["doc_id"])), str(r["doc_id"])))
    fitted = [r for n, r in enumerate(rows) if n % 5 != 4]
    classifier = fit([r["text"] for r in fitted], np.array([r["label"] for r in fitted], np.float32), totals)
    if classifier.network is not None:
        known = sampling.marks(labels, label, training)
        cells = calibration_counts(id_and_text(docs), known, classifier, [r["doc_id"] for r in fitted], longest, can_be_broadcast(known))
        classifier.thresholds = choose_thresholds(cells.collect())
    return classifier


def score(docs: DataFrame, classifier: Classifier, text_col: str = "text", keep: tuple[str, ...] = ("*",)) -> DataFrame:
    """(doc, score): the columns named in ``keep`` as a struct, and the score of the whole text.

    Only the text is scored. NULL and empty texts score like a text of one unknown word; with
    labels of one class only, every score is the share of toxic labels. Equal texts have equal
    scores.
    """
    shared = docs.sparkSession.sparkContext.broadcast(classifier)

    @F.arrow_udf(T.DoubleType())
    def scores(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(shared.value)
        for batch in batches:
            parts = [scorer.scores([t or "" for t in batch[n : n + 256].to_pylist()]) for n in range(0, len(batch), 256)]
            yield pa.array(np.concatenate(parts) if parts else [], pa.float64())

    return docs.select(F.struct(*keep).alias("doc"), scores(docs[text_col]).alias("score"))
