"""Alignment of two tokenizers' tokens, and how often the corpus links each pair of ids.

Tokens of both sides are spans of the same bytes. Where ends of both fall together a text is
cut into groups. Most groups are one token against one: along such a stretch the two lists of
ends are equal at a constant shift of their places, so the stretch is jumped by comparing
slices whose length doubles, and halves where they differ. What lies between stretches is
walked token by token until two ends meet, which sets the next shift.

Counts of linked pairs need the whole corpus. A block of some megabytes of text is stored as
its distinct pairs and, for every document, the places of its pairs in that list with their
frequencies; only the lists travel to be added up, and one count per place travels back.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import count
from typing import NamedTuple

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from vitalgrid.llm.blocks import BLOCK_BYTES, pack, unpack
from vitalgrid.llm.common import id_and_text
from vitalgrid.session import materialize, scratch_path

BYTE_MODEL, BYTE_RANKS, PIECE_MODEL = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"
MARK = "▁"  # how the piece model writes a space
#: Texts encoded at a time, in characters.
CHUNK = 1 << 20
#: Texts of nothing but these are cut alike by the ranks, the faster form of the byte model (checked by a test).
COMMON = re.compile("[\\x00-\\x7F\\u00A1-\\u00FF\\u0100-\\u017F\\u2013\\u2014\\u2018-\\u201E\\u2026\\u20AC]*")


class Paths(NamedTuple):
    """The vocabulary files, the same on every machine."""

    json: str
    ranks: str
    pieces: str


def public_paths() -> Paths:
    return Paths(*map(public_tokenizers.path, (BYTE_MODEL, BYTE_RANKS, PIECE_MODEL)))


def byte_letters() -> dict[str, int]:
    """The letter by which a byte-level vocabulary writes each byte: itself if it prints, else one from 256 up."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in prints]
    return {chr(b): b for b in prints} | {chr(256 + n): b for n, b in enumerate(others)}


class Tokenizers:
    def __init__(self, paths: Paths) -> None:
        self.full = Tokenizer.from_file(paths.json)
        self.full.encode_special_tokens = True
        letters = byte_letters()
        self.bytes_a = [bytes(letters[c] for c in self.full.id_to_token(n)) for n in range(self.full.get_vocab_size())]
        with open(paths.ranks, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=paths.pieces)
        self.bytes_b = [self._piece(n) for n in range(self.pieces.get_piece_size())]
        self.length_a, self.length_b = (np.array([len(b) for b in side], np.int64) for side in (self.bytes_a, self.bytes_b))
        names = [str(n).encode() for n in range(max(len(self.bytes_a), len(self.bytes_b)))]
        self.n_digits = np.array([len(n) for n in names])
        width = self.n_digits.max() + 1  # one more for what stands behind
        self.digits = np.frombuffer(b"".join(n.ljust(width) for n in names), np.uint8).reshape(-1, width)

    def _piece(self, number: int) -> bytes:
        piece = self.pieces.id_to_piece(number)
        return bytes([int(piece[3:-1], 16)]) if self.pieces.is_byte(number) else piece.replace(MARK, " ").encode()

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Both sides' ids of each text: of space and text, and of the text. None where a side's
        bytes are not those of space and text, or the text is empty."""
        none = np.zeros(0, np.int64)
        for text, b in zip(texts, self.pieces.encode(texts, out_type=int, num_threads=1)):
            whole = b" " + text.encode()
            if not text or b"".join([self.bytes_b[i] for i in b]) != whole:
                yield none, none
            elif COMMON.fullmatch(text):  # the ranks give all bytes back
                yield self.fast.encode_to_numpy(" " + text, disallowed_special=()).astype(np.int64), np.array(b, np.int64)
            else:
                a = self.full.encode(" " + text, add_special_tokens=False).ids
                yield (np.array(a, np.int64), np.array(b, np.int64)) if b"".join([self.bytes_a[i] for i in a]) == whole else (none, none)


@lru_cache
def load(paths: Paths) -> Tokenizers:
    return Tokenizers(paths)


def align(ends_a: list[int], ends_b: list[int]) -> tuple[list[int], list[int], list[int]]:
    """The groups that are not one token against one, as (i, i_end, j, j_end) in one flat list, and their links by place.

    The last ends of both are equal. Along a one-to-one stretch slices at the current shift are
    compared, each twice as long as the last; where two differ, halves are until the first
    difference is found. There tokens are walked until two ends meet, linking those that
    overlap, and the walk leaves the next shift.
    """
    odd, links_a, links_b = [], [], []
    i, j, n = 0, 0, len(ends_a)
    while i < n:
        x, y = ends_a[i], ends_b[j]
        if x == y:
            i, j, step = i + 1, j + 1, 2
            while ends_a[i : i + step] == ends_b[j : j + step]:
                i, j = i + step, j + step
                if i >= n:
                    return odd, links_a, links_b
                step *= 2
            while step > 1:
                step //= 2
                if ends_a[i : i + step] == ends_b[j : j + step]:
                    i, j = i + step, j + step
            continue
        first_i, first_j = i, j
        while True:
            links_a.append(i)
            links_b.append(j)
            if x < y:
                i += 1
                x = ends_a[i]
            elif y < x:
                j += 1
                y = ends_b[j]
            else:
                break
        i, j = i + 1, j + 1
        odd += (first_i, i, first_j, j)
    return odd, links_a, links_b


class Aligned(NamedTuple):
    """``starts_a``, ``starts_b``: first token of each group; ``links_a``, ``links_b``: ids of all overlapping pairs."""

    starts_a: np.ndarray
    starts_b: np.ndarray
    links_a: np.ndarray
    links_b: np.ndarray


def _inside(size: int, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Marks the places of ``size`` that lie in one of the disjoint spans."""
    steps = np.zeros(size + 1, np.int64)
    steps[begin] += 1
    steps[end] -= 1
    return steps[:size].cumsum() > 0


def groups_of(a: np.ndarray, b: np.ndarray, both: Tokenizers) -> Aligned:
    """Groups and links of two lists of ids whose bytes are the same."""
    odd, links_a, links_b = align(both.length_a[a].cumsum().tolist(), both.length_b[b].cumsum().tolist())
    starts, singles, spans = [], [], np.array(odd, np.int64).reshape(-1, 4)
    for side, (begin, end) in ((a, (0, 1)), (b, (2, 3))):
        single = np.ones(len(side), bool)
        follows = np.zeros(len(side), bool)
        if odd:
            single = ~_inside(len(side), spans[:, begin], spans[:, end])
            follows = ~single
            follows[spans[:, begin]] = False
        starts.append(np.flatnonzero(~follows))
        singles.append(side[single])
    return Aligned(*starts, np.concatenate([singles[0], a[links_a]]), np.concatenate([singles[1], b[links_b]]))


def group_text(a: np.ndarray, b: np.ndarray, found: Aligned, both: Tokenizers) -> bytes:
    """``a1,a2|b1;a3|b2,b3``: ids of both sides, group by group."""
    place_a, place_b = (np.repeat(np.arange(len(starts)), np.diff(starts, append=size)) for starts, size in ((found.starts_a, len(a)), (found.starts_b, len(b))))
    at_a, at_b = np.arange(len(a)) + found.starts_b[place_a], np.arange(len(b)) + np.append(found.starts_a[1:], len(a))[place_b]
    ids, behind = np.empty(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
    ids[at_a], ids[at_b] = a, b
    behind[at_a[np.append(found.starts_a[1:], len(a)) - 1]] = ord("|")
    behind[at_b[np.append(found.starts_b[1:], len(b)) - 1]] = ord(";")
    digits, length = both.digits[ids], both.n_digits[ids]
    digits[np.arange(len(ids)), length] = behind
    return digits[np.arange(digits.shape[1]) <= length[:, None]].tobytes()[:-1]


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[list[pa.Scalar], list[str]]]:
    """Ids and texts of some of a batch's rows (doc_id, text) at a time."""
    ids, texts, size = [], [], 0
    for row, text in enumerate(batch.column(1)):
        ids.append(batch.column(0)[row])
        texts.append(text.as_py())
        size += len(texts[-1])
        if size >= CHUNK:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def alignments(docs: DataFrame, paths: Paths | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, groups), one row per row of ``docs``; a group has the ids ``a`` and ``b`` of both sides.

    NULL and empty texts, and texts whose bytes a tokenizer does not give back, have no groups.
    """
    rows, paths = id_and_text(docs, id_col, text_col), paths or public_paths()
    group = pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = load(paths)
        for batch in batches:
            for ids, texts in _chunks(batch):
                found = []
                for a, b in both.encode(texts):
                    cut = groups_of(a, b, both)
                    sides = zip(np.split(a, cut.starts_a[1:]), np.split(b, cut.starts_b[1:])) if len(a) else ()
                    found.append([{"a": x, "b": y} for x, y in sides])
                yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column(0).type), pa.array(found, pa.list_(group))], ["doc_id", "groups"])

    return rows.mapInArrow(run, T.StructType([rows.schema["doc_id"], *T._parse_datatype_string("groups array<struct<a:array<int>,b:array<int>>>")]))


_OF_DOCUMENT = (("n_a", T.LongType()), ("n_b", T.LongType()), ("n_groups", T.LongType()), ("n_links", T.LongType()), ("groups_sha256", T.StringType()), ("distinct", T.LongType()))


class _Block:
    def __init__(self) -> None:
        self.ids: list[pa.Scalar] = []
        self.columns: dict[str, list] = {name: [] for name, _ in _OF_DOCUMENT}
        self.pairs: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []

    def add(self, doc_id: pa.Scalar, a: np.ndarray, b: np.ndarray, both: Tokenizers, width: int) -> None:
        found = groups_of(a, b, both)
        digest = hashlib.sha256(group_text(a, b, found, both)).hexdigest() if len(a) else ""
        kind = np.int32 if len(both.bytes_a) * width < 2**31 else np.int64  # half the width sorts faster
        pairs, counts = np.unique((found.links_a * width + found.links_b).astype(kind), return_counts=True)
        self.ids.append(doc_id)
        for name, value in zip(self.columns, (len(a), len(b), len(found.starts_a), len(found.links_a), digest, len(pairs))):
            self.columns[name].append(value)
        self.pairs.append(pairs)
        self.counts.append(counts)

    def rows(self, block: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        pairs, places = np.unique(np.concatenate(self.pairs), return_inverse=True)
        counts, sizes = np.concatenate(self.counts), np.array(self.columns["distinct"])
        steps = np.diff(places, prepend=0)
        first = (np.cumsum(sizes) - sizes)[sizes > 0]  # places rise within a document and start anew with the next
        steps[first] = places[first]
        pairs, sums = pairs.astype(np.int64), np.bincount(places, counts, len(pairs)).astype(np.int64)
        of_block = {"doc_id": [self.ids], "vectors": [pack(steps, counts)]} | {name: [values] for name, values in self.columns.items()}
        yield self._batch(schema, 1, block=[block], **of_block)
        for start in range(0, len(pairs), 100_000):
            some = slice(start, start + 100_000)
            n = len(pairs[some])
            yield self._batch(schema, n, block=np.full(n, block), place=np.arange(start, start + n, dtype=np.int32), pair=pairs[some], links=sums[some])

    @staticmethod
    def _batch(schema: pa.Schema, rows: int, **given) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(given[f.name], f.type) if f.name in given else pa.nulls(rows, f.type) for f in schema], schema=schema)


def aligned_blocks(docs: DataFrame, paths: Paths, width: int, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, DataFrame]:
    """``docs`` (doc_id, text without NULLs) aligned and stored as blocks of ``block_bytes`` characters.

    Two tables: documents, a row per block with an array entry for every row of ``docs``; and
    lists (block, place, pair, links), ``pair`` = ``width`` times the first id plus the second.
    Both come from one stored write, so a repeated task cannot mix two numberings.
    """
    of_documents = [T.StructField(name, T.ArrayType(kind)) for name, kind in (("doc_id", docs.schema["doc_id"].dataType), *_OF_DOCUMENT)]
    of_lists = [T.StructField("place", T.IntegerType()), T.StructField("pair", T.LongType()), T.StructField("links", T.LongType())]
    schema = T.StructType([T.StructField("block", T.LongType()), *of_documents, T.StructField("vectors", T.BinaryType()), *of_lists])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, numbers, block, size, out = load(paths), count(TaskContext.get().partitionId() << 24), _Block(), 0, None
        for batch in batches:
            if out is None:
                lists = [pa.field(f.name, pa.list_(batch.column(0).type if f.name == "doc_id" else pa.string() if f.name == "groups_sha256" else pa.int64())) for f in of_documents]
                out = pa.schema([("block", pa.int64()), *lists, ("vectors", pa.binary()), ("place", pa.int32()), ("pair", pa.int64()), ("links", pa.int64())])
            for ids, texts in _chunks(batch):
                for doc_id, text, (a, b) in zip(ids, texts, both.encode(texts)):
                    block.add(doc_id, a, b, both, width)
                    size += len(text)
                    if size >= block_bytes:
                        yield from block.rows(next(numbers), out)
                        block, size = _Block(), 0
        if block.ids:
            yield from block.rows(next(numbers), out)

    path = scratch_path(docs.sparkSession, "aligned")
    docs.mapInArrow(run, schema).write.option("compression", "zstd").parquet(path)
    stored = lambda: docs.sparkSession.read.schema(schema).parquet(path)  # noqa: E731  two readings, whose columns can be told apart in joins
    return stored().where("vectors is not null").drop("place", "pair", "links"), stored().where("pair is not null").select("block", "place", "pair", "links")


def _sums(documents: DataFrame, values: DataFrame) -> DataFrame:
    """Per document: links whose count is their B id's highest, and the sum of the links' counts."""
    names = ("n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    kept = [T.StructField(n, documents.schema[n].dataType.elementType) for n in ("doc_id", *names)]
    schema = T.StructType([*kept, T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())])

    def run(docs: pa.Table, found: pa.Table) -> pa.Table:
        if not docs.num_rows:
            raise ValueError("counts of a block without documents")
        counts, best = np.zeros(found.num_rows, np.int64), np.zeros(found.num_rows, np.int64)
        places = found.column("place").to_numpy()
        counts[places], best[places] = found.column("links").to_numpy(), found.column("best").to_numpy(zero_copy_only=False)
        sizes = np.array(docs.column("distinct")[0].as_py(), np.int64)
        steps, frequency = unpack(docs.column("vectors")[0].as_py())
        ends = np.cumsum(sizes)
        walked = np.concatenate([[0], np.cumsum(steps)])  # each document's places start anew
        place = walked[1:] - np.repeat(walked[ends - sizes], sizes)
        total = lambda x: np.diff(np.concatenate([[0], np.cumsum(frequency * x[place])])[np.concatenate([[0], ends])])
        return pa.table([*(docs.column(f.name)[0].values for f in kept), pa.array(total(best)), pa.array(total(counts))], names=[f.name for f in schema])

    return documents.groupBy("block").cogroup(values.groupBy("block")).applyInArrow(run, schema)


def pair_counts(lists: DataFrame, width: int) -> DataFrame:
    """(pair, links, best): how many links of the corpus have each pair of ids, and whether that is the most of its B id."""
    counts = materialize(lists.groupBy("pair").agg(F.sum("links").alias("links")), "pair-counts")
    of_b = lambda pair: F.pmod(pair, F.lit(width))
    most = counts.groupBy(of_b(F.col("pair")).alias("b")).agg(F.max("links").alias("most"))
    # a row for each id of the vocabulary at most
    return counts.join(F.broadcast(most), of_b(counts["pair"]) == most["b"]).select("pair", counts["links"], (counts["links"] == F.col("most")).alias("best"))


def alignment_statistics(docs: DataFrame, paths: Paths | None = None, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), one row per row of ``docs``.

    NULL and empty texts, and texts whose bytes a tokenizer does not give back, have no tokens:
    zeros and an empty digest. Repeated rows and NULL ids are rows like others, and each counts
    in the corpus; other columns are not read. A block holds whole texts, so a text longer
    than a block is one of its own.
    """
    paths = paths or public_paths()
    width = load(paths).pieces.get_piece_size()
    documents, lists = aligned_blocks(id_and_text(docs, id_col, text_col), paths, width, block_bytes)
    counts = pair_counts(lists, width)
    # the list's rows of a frequent pair, one for each block, are divided by adaptive execution
    values = lists.select("block", "place", "pair").join(counts, "pair").select("block", "place", "links", "best")
    return _sums(documents, values)
