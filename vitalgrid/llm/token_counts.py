"""Token counts of a sentencepiece BPE model, from distinct pre-tokens.

Merges never cross a border between two characters that stand side by side in no piece. Cut
at such borders, a text is a bag of pre-tokens, and its number of pieces the sum over them.
Every distinct pre-token of the corpus is brought to one place, counted there once, and the
count joined to the frequencies of the documents. No ids are made.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalgrid.llm import blocks
from vitalgrid.llm.common import id_and_text

MODEL = "piece_bpe_32k.model"
TOKEN_LIMIT = 4096
MARK = "▁"  # how the model writes a space; in a text it is the same as one


@lru_cache
def load(path: str) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_file=path)


@lru_cache
def pre_token_pattern(path: str) -> re.Pattern:
    """Cuts a text, its spaces written as spaces, at borders that no piece of the model crosses.

    Characters that occur side by side in a piece belong to one class, also through others;
    what is in no class has no merges. A mark stands in front of a piece only, which is
    checked, so a run of spaces goes with what follows it.
    """
    model = load(path)
    leader: dict[str, str] = {}
    doubled: set[str] = set()  # characters that merge with their like

    def find(c: str) -> str:
        while leader.setdefault(c, c) != c:
            c = leader[c]
        return c

    for piece in range(model.get_piece_size()):
        if model.is_byte(piece) or model.is_control(piece) or model.is_unknown(piece):
            continue
        body = model.id_to_piece(piece).lstrip(MARK)
        if MARK in body:
            raise ValueError("a piece of this model has a space behind other characters")
        if body != model.id_to_piece(piece):
            find(body[:1] or " ")  # merges with the space in front of it, if with nothing else
        for a, b in zip(body, body[1:]):
            leader[find(a)] = find(b)
            doubled.update(a if a == b else "")
    classes = defaultdict(list)
    for c in list(leader):
        classes[find(c)].append(c)
    classes.pop(" ", None)
    groups = sorted(("".join(sorted(g)) for g in classes.values()), key=len, reverse=True)
    runs = [g for g in groups if len(g) > 1 or g in doubled]
    single = "".join(g for g in groups if len(g) == 1 and g not in doubled)
    runs = "|".join([f"[{re.escape(g)}]+" for g in runs] + [f"[{re.escape(single)}]"] * bool(single))
    classed = re.escape("".join(groups) + " ")
    return re.compile(f" *(?:{runs})| +|[^{classed}]+")


def pre_tokens(text: str, path: str) -> list[str]:
    """The pre-tokens of a text; the library puts a space in front of any text that is not empty."""
    return pre_token_pattern(path).findall(" " + text.replace(MARK, " ")) if text else []


def piece_counts(terms: list[str], path: str) -> np.ndarray:
    """Pieces of each pre-token inside a text.

    Behind a line end, which merges with nothing, a pre-token is encoded as in a text; the
    two pieces in front of it, of the added space and the line end, are taken off.
    """
    encoded = load(path).encode(["\n" + t for t in terms], out_type=int, num_threads=1)
    return np.fromiter((len(ids) - 2 for ids in encoded), np.int64, len(terms))


def count_pieces(dictionaries: DataFrame, path: str) -> DataFrame:
    """(block, place, pieces): every distinct term of the corpus is counted once, in the task it is dealt to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, last_pieces = None, 0
        for batch in batches:
            terms = batch.column(2)
            runs = terms.dictionary_encode() if not pa.types.is_dictionary(terms.type) else terms
            distinct = runs.dictionary.to_pylist()
            known = [last_pieces] if distinct[:1] == [last] and last is not None else []  # the run goes on from the last batch
            pieces = np.concatenate([np.array(known, np.int64), piece_counts(distinct[len(known) :], path)])
            codes = runs.indices.to_numpy()
            last, last_pieces = distinct[codes[-1]], pieces[codes[-1]]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(pieces[codes].astype(np.int32))], ["block", "place", "pieces"])

    sorted_terms = dictionaries.select("block", "place", "term").repartitionByRange("term").sortWithinPartitions("term")
    return sorted_terms.mapInArrow(run, "block long, place int, pieces int")


def token_counts(docs: DataFrame, model: str | None = None, limit: int = TOKEN_LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit), one row per row of ``docs``.

    As the library counts, without begin, end or added special tokens. NULL and empty texts
    have 0 tokens; repeated rows and NULL ids are rows like others; other columns are not read.
    ``model``: path of the model file, the same on every machine.
    """
    path = model or public_tokenizers.path(MODEL)
    documents, dictionaries = blocks.blocks_of(id_and_text(docs, id_col, text_col), lambda text: pre_tokens(text, path), F.lit(False))
    summed = blocks.sum_over_terms(documents, count_pieces(dictionaries, path), ["pieces"])
    n_tokens = F.col("pieces").cast("long")
    return summed.select("doc_id", "n_bytes", n_tokens.alias("n_tokens"), (n_tokens > limit).alias("over_limit"))
