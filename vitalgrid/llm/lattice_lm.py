"""Language-model scores from a subword lattice.

The pieces of a public vocabulary get the log probabilities of a unigram model, learned from
the training documents. A word can be cut into pieces in many ways; its probability is the sum
over all of them, found by a forward recursion in log space over the lattice of pieces. Words
are scored once per distinct word of the corpus and the scores joined to the documents.

Next to it stands the plain word unigram with add-one smoothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalgrid.llm import blocks
from vitalgrid.llm.common import fold, id_and_text
from vitalgrid.llm.token_counts import MARK, MODEL, load
from vitalgrid.session import materialize

LOWER_BYTES = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: The end of a text as a term; no word is empty.
END = ""
#: Words of one length are scored together, so many at a time.
TOGETHER = 4096


def words_and_end(text: str) -> list[bytes]:
    return text.encode().translate(LOWER_BYTES).split() + [END.encode()]


@lru_cache
def vocabulary(path: str) -> tuple[dict[str, int], int]:
    """Ids of the pieces that can stand in a lattice, and the longest one's length. No byte or control pieces."""
    model = load(path)
    plain = {model.id_to_piece(i): i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))}
    return plain, max(map(len, plain))


def piece_frequencies(words: DataFrame, path: str) -> DataFrame:
    """(piece, n): how often the training words, as the tokenizer cuts them, have each piece.

    Grows with the vocabulary of pieces only; each task sums up before it sends.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        totals = np.zeros(model.get_piece_size(), np.int64)
        for batch in batches:
            for ids, n in zip(model.encode(batch.column(0).to_pylist(), out_type=int, num_threads=1), batch.column(1).to_pylist()):
                for i in ids:
                    totals[i] += n
        seen = np.nonzero(totals)[0]
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(totals[seen])], ["piece", "n"])

    some = words.where((F.col("c") > 0) & (F.col("term") != END)).select("term", "c").mapInArrow(run, "piece long, n long")
    return some.groupBy("piece").agg(F.sum("n").alias("n"))


def piece_scores(frequencies: pd.DataFrame, ends: int, path: str) -> tuple[np.ndarray, float]:
    """Natural log probabilities of all pieces, and of the end of a text; add-one smoothed, together 1."""
    totals = np.ones(load(path).get_piece_size())
    totals[frequencies["piece"].to_numpy()] += frequencies["n"].to_numpy()
    everything = totals.sum() + ends + 1
    return np.log(totals / everything), math.log((ends + 1) / everything)


class Lattice:
    """Marginal log probabilities of words over all their segmentations."""

    def __init__(self, scores: np.ndarray, path: str) -> None:
        ids, self.longest = vocabulary(path)
        model = load(path)
        by_byte = [scores[model.piece_to_id(f"<0x{b:02X}>")] for b in range(256)]
        self.score = {piece: scores[i] for piece, i in ids.items()}
        self.character = _Characters(self.score, by_byte)

    def together(self, words: list[str]) -> np.ndarray:
        """Words of one length: ``forward[e]`` sums, in log space, over the pieces that can end at ``e``."""
        length, score = len(words[0]), self.score
        forward = np.zeros((length + 1, len(words)))
        for end in range(1, length + 1):
            first = max(0, end - self.longest)
            paths = np.empty((end - first, len(words)))
            for start in range(first, end - 1):
                paths[start - first] = [score.get(w[start:end], -np.inf) for w in words]
            paths[-1] = [self.character[w[end - 1]] for w in words]
            paths += forward[first:end]
            top = paths.max(0)
            forward[end] = top + np.log(np.exp(paths - top).sum(0))
        return forward[length]

    def log_probabilities(self, words: list[str]) -> np.ndarray:
        """Natural log probabilities of words, each behind a space."""
        marked = [MARK + w for w in words]
        lengths = np.fromiter(map(len, marked), np.int64, len(marked))
        order, out = np.argsort(lengths, kind="stable"), np.empty(len(marked))
        cuts = np.nonzero(np.diff(lengths[order]))[0] + 1
        for same in np.split(order, cuts) if len(order) else []:
            for start in range(0, len(same), TOGETHER):
                some = same[start : start + TOGETHER]
                out[some] = self.together([marked[i] for i in some])
        return out


class _Characters(dict):
    """Scores of single characters; one that is no piece is the product of its bytes."""

    def __init__(self, score: dict[str, float], by_byte: list[float]) -> None:
        super().__init__((c, s) for c, s in score.items() if len(c) == 1)
        self.by_byte = by_byte

    def __missing__(self, character: str) -> float:
        self[character] = sum(self.by_byte[b] for b in character.encode())
        return self[character]


def score_words(words: DataFrame, scores: np.ndarray, end: float, path: str) -> DataFrame:
    """(term, c, score): the log10 probability of every distinct word, and of the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(scores, path)
        for batch in batches:
            terms = batch.column(0).to_pylist()
            logs = lattice.log_probabilities(terms)
            logs = np.where([t == END for t in terms], end, logs) / math.log(10)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(logs)], ["term", "c", "score"])

    return words.select("term", "c").mapInArrow(run, "term string, c long, score double")


def score_documents(docs: DataFrame, training: Column, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, training, n_tokens, n_known, train_tokens, base_score, score), one row per row of ``docs``.

    ``training``: a condition on the id (as column ``doc_id``) for the documents to learn from.
    Scores are log10 probabilities. NULL and empty texts are their end alone; without training
    documents every word is equally unknown. Repeated rows and NULL ids are rows like others;
    other columns are not read.
    """
    path = model or public_tokenizers.path(MODEL)
    documents, dictionaries = blocks.blocks_of(id_and_text(docs, id_col, text_col), words_and_end, training)
    words = materialize(dictionaries.groupBy("term").agg(F.sum("flagged").alias("c")), "words")
    known = F.col("c") > 0
    tokens, distinct, ends = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(known, 1)), F.coalesce(F.sum(F.when(F.col("term") == END, F.col("c"))), F.lit(0))).first()
    scores, end = piece_scores(piece_frequencies(words, path).toPandas(), ends, path)
    of_words = score_words(words, scores, end, path).select(
        "term", "score", F.log10((F.col("c") + 1) / F.lit(float(tokens + distinct + 1))).alias("base"), known.cast("double").alias("known")
    )
    values = dictionaries.select("block", "place", "term").join(of_words, "term")
    summed = blocks.sum_over_terms(documents, values, ["base", "score", "known"])
    return summed.select(
        "doc_id", F.col("flag").alias("training"), F.col("n_terms").alias("n_tokens"), F.col("known").cast("long").alias("n_known"),
        F.lit(int(tokens)).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score",
    )


def not_held_out(parts: int = 7, held_out: int = 2) -> Column:
    return fold(F.col("doc_id"), parts) != held_out
