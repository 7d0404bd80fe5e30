"""Hard negatives in score windows, from candidate blocks that lie on a Hilbert curve.

Vectors become whole numbers, so that scores are exact. Candidates are sorted along a Hilbert
curve through the dimensions that vary most, and stored in Parquet as blocks of neighbours with
the lowest and highest value of each dimension (the zone map). From these, interval arithmetic bounds the scores
that an anchor can have with any row of a block; a block is read for an anchor only if the
bounds reach its best positives so far, or one of its windows.

Anchors are a stated query set. They are sent out in slices of bounded size; every task runs
over the blocks of its partition and hands on at most the asked number of rows per anchor and
window, which are merged per anchor.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalgrid.session import materialize

#: Rows of a block; dimensions and bits of each that the curve runs through.
BLOCK_ROWS, CURVE_DIMENSIONS, CURVE_BITS = 256, 10, 6
#: Largest slice of anchors that is sent out at a time, in rows and bytes of vectors.
SLICE_ROWS, SLICE_BYTES = 65_536, 32 << 20
POSITIVES, NEGATIVES = 5, 10
#: A negative's score, times 100, lies between these shares of its positive's.
LOWEST_SHARE, HIGHEST_SHARE = 30, 90
SCALE = 256
#: Stands for a NULL id, and behind all others.
NO_ID = 2**63 - 1


def hilbert_keys(places: np.ndarray, bits: int) -> np.ndarray:
    """Position along the Hilbert curve of points with ``bits`` bits in each column; at most 63 bits in all.

    The curve's cells are found bit by bit from the top: each level reflects and exchanges the
    axes of the levels below (the transposed form of the curve), then bits are interleaved.
    """
    x = places.astype(np.int64).T.copy()
    n = len(x)
    level = 1 << (bits - 1)
    while level > 1:
        below = level - 1
        for axis in range(n):
            is_set = (x[axis] & level) != 0
            change = (x[0] ^ x[axis]) & below
            x[0] = np.where(is_set, x[0] ^ below, x[0] ^ change)
            if axis:
                x[axis] = np.where(is_set, x[axis], x[axis] ^ change)
        level >>= 1
    for axis in range(1, n):  # Gray code
        x[axis] ^= x[axis - 1]
    turn, level = np.zeros_like(x[0]), 1 << (bits - 1)
    while level > 1:
        turn = np.where((x[n - 1] & level) != 0, turn ^ (level - 1), turn)
        level >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for axis in range(n):
            key = key << 1 | x[axis] >> bit & 1
    return key


def whole_vectors(rows: DataFrame, label: Callable[[Column, Column], Column] | None = None, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, label, v) of the rows that take part, with whole components ``floor(256 x)``.

    Rows with a NULL label, a NULL or empty vector, or a component that is NULL or not finite take
    no part. ``label`` makes a row's label from its id and label. A NULL id stands behind all others.
    """
    vector, of = rows[vector_col], rows[label_col]
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    changed = of if label is None else label(rows[id_col], of)
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(SCALE))).cast("long"))
    taking_part = of.isNotNull() & (F.size(vector) > 0) & F.coalesce(finite, F.lit(False))
    return rows.where(taking_part).select(F.coalesce(rows[id_col].cast("long"), F.lit(NO_ID)).alias("vec_id"), changed.cast("long").alias("label"), whole.alias("v"))


class Store(NamedTuple):
    """Blocks (ids, labels, vectors, low, high) along the curve; length and largest size of components."""

    blocks: DataFrame
    dimensions: int
    largest: int


def _matrix(table: pa.Table | pa.RecordBatch, column: int) -> np.ndarray:
    values = table.column(column)
    values = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
    return values.flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)


BLOCK_SCHEMA = "ids array<long>, labels array<long>, vectors binary, low array<long>, high array<long>"


def _packed(ids: np.ndarray, labels: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    lists = [pa.array([x], pa.list_(pa.int64())) for x in (ids, labels)]
    zones = [pa.array([x], pa.list_(pa.int64())) for x in (v.min(0), v.max(0))]
    return pa.RecordBatch.from_arrays([*lists, pa.array([v.astype("<i8").tobytes()], pa.binary()), *zones], ["ids", "labels", "vectors", "low", "high"])


def build(vectors: DataFrame, block_rows: int = BLOCK_ROWS, curve_dimensions: int = CURVE_DIMENSIONS, curve_bits: int = CURVE_BITS) -> Store | None:
    """Stores ``vectors`` (vec_id, label, v) as blocks along the curve; None if there are none.

    The curve runs through the dimensions of largest variance, each between its extremes. Rows
    equal in all columns lie side by side there and become one. Of vectors of several lengths
    those of the most frequent length (of equally frequent ones the greatest) take part.
    """
    stored = materialize(vectors, "whole-vectors")
    lengths = stored.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    if lengths is None:
        return None
    fitting = stored.where(F.size("v") == lengths["size"])
    at = fitting.select(F.posexplode("v").alias("at", "x")).groupBy("at").agg(F.min("x").alias("low"), F.max("x").alias("high"), F.var_pop("x").alias("spread"))
    zones = at.collect()  # a row for each dimension
    widest = sorted(zones, key=lambda r: (-r["spread"], r["at"]))[:curve_dimensions]
    axes = [r["at"] for r in widest]
    low, width = np.array([r["low"] for r in widest], np.float64), np.array([max(r["high"] - r["low"], 1) for r in widest], np.float64)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cells = np.minimum((_matrix(batch, 2)[:, axes] - low) / width * (1 << curve_bits), (1 << curve_bits) - 1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hilbert_keys(cells.astype(np.int64), curve_bits))], ["vec_id", "label", "v", "key"])

    placed = materialize(fitting.mapInArrow(place, "vec_id long, label long, v array<long>, key long"), "curve-keys")
    # divided by value, with the id: no label and no group of equal vectors holds a partition
    ranged = placed.repartitionByRange("key", "vec_id", "label").sortWithinPartitions("key", "vec_id", "label", "v")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, v = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, len(zones)), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, labels = (np.concatenate([x, batch.column(n).to_numpy()]) for n, x in ((0, ids), (1, labels)))
            v = np.concatenate([v, _matrix(batch, 2)])
            again = (ids[1:] == ids[:-1]) & (labels[1:] == labels[:-1]) & (v[1:] == v[:-1]).all(1)
            once = np.concatenate([[True], ~again])
            ids, labels, v = ids[once], labels[once], v[once]
            full = (len(ids) - 1) // block_rows * block_rows  # at least a row stays, to be compared with the next
            for start in range(0, full, block_rows):
                yield _packed(*(x[start : start + block_rows] for x in (ids, labels, v)))
            ids, labels, v = ids[full:], labels[full:], v[full:]
        if len(ids):
            yield _packed(ids, labels, v)

    largest = max(max(abs(r["low"]), abs(r["high"])) for r in zones)
    return Store(materialize(ranged.mapInArrow(cut, BLOCK_SCHEMA), "curve-blocks"), len(zones), largest)


class Block(NamedTuple):
    ids: np.ndarray
    labels: np.ndarray
    low: np.ndarray
    high: np.ndarray
    packed: pa.Scalar

    def vectors(self) -> np.ndarray:
        """Read only where the zone map does not rule the block out."""
        return np.frombuffer(self.packed.as_py(), "<i8").reshape(len(self.ids), -1)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    for batch in batches:
        for row in range(batch.num_rows):
            ids, labels, low, high = (batch.column(c)[row].values.to_numpy() for c in (0, 1, 3, 4))
            yield Block(ids, labels, low, high, batch.column(2)[row])


def score_bounds(anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product each anchor can have with a vector between ``low`` and ``high``."""
    up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
    return up @ low + down @ high, up @ high + down @ low


class Best:
    """The ``most`` first (score from the top, then smaller id) entries of every unit."""

    def __init__(self, units: int, most: int) -> None:
        self.most, self.least = most, np.full(units, np.iinfo(np.int64).min)
        self.unit, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, unit: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(unit):
            return
        unit, score, ids = (np.concatenate(x) for x in ((self.unit, unit), (self.score, score), (self.id, ids)))
        order = np.lexsort((ids, -score, unit))
        unit, score, ids = unit[order], score[order], ids[order]
        first = np.concatenate([[0], np.flatnonzero(np.diff(unit)) + 1])
        place = np.arange(len(unit)) - np.repeat(first, np.diff(np.append(first, len(unit))))
        kept = place < self.most
        self.unit, self.score, self.id = unit[kept], score[kept], ids[kept]
        last = place[kept] == self.most - 1
        self.least[self.unit[last]] = self.score[last]  # a lower score has no place any more


class Anchors(NamedTuple):
    """A slice of anchors; ``low``, ``high``: windows of each, empty ones with ``low > high``."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    low: np.ndarray
    high: np.ndarray


def exact_type(store: Store) -> type:
    """Doubles multiply fastest, and are exact below 2**53."""
    bound = store.largest * store.largest * store.dimensions
    if bound >= 2**63:
        raise ValueError("components are too large for scores in 64 bits")
    return np.float64 if bound < 2**53 else np.int64


def best_positives(anchors: Anchors, blocks: Iterator[Block], most: int) -> Best:
    """The first rows of the anchor's label that are not of its id."""
    best = Best(len(anchors.ids), most)
    for block in blocks:
        least, greatest = score_bounds(anchors.vectors, block.low.astype(anchors.vectors.dtype), block.high.astype(anchors.vectors.dtype))
        read = np.flatnonzero((greatest >= best.least) & np.isin(anchors.labels, block.labels))
        if len(read):
            scores = (anchors.vectors[read] @ block.vectors().astype(anchors.vectors.dtype).T).astype(np.int64)
            fits = (anchors.labels[read, None] == block.labels) & (anchors.ids[read, None] != block.ids) & (scores >= best.least[read, None])
            at, row = np.nonzero(fits)
            best.add(read[at], scores[at, row], block.ids[row])
    return best


def best_negatives(anchors: Anchors, blocks: Iterator[Block], most: int) -> Best:
    """For every window of every anchor the first rows of another label in it; unit = anchor * windows + window."""
    windows = anchors.low.shape[1]
    best = Best(anchors.low.size, most)
    for block in blocks:
        least, greatest = score_bounds(anchors.vectors, block.low.astype(anchors.vectors.dtype), block.high.astype(anchors.vectors.dtype))
        from_ = np.maximum(anchors.low, best.least.reshape(anchors.low.shape))
        open_ = (greatest[:, None] >= from_) & (least[:, None] <= anchors.high) & (from_ <= anchors.high)
        read = np.flatnonzero(open_.any(1))
        if len(read):
            scores = (anchors.vectors[read] @ block.vectors().astype(anchors.vectors.dtype).T).astype(np.int64)
            other = anchors.labels[read, None] != block.labels
            for window in np.flatnonzero(open_[read].any(0)):
                at, row = np.nonzero(other & (scores >= from_[read, window, None]) & (scores <= anchors.high[read, window, None]))
                best.add(read[at] * windows + window, scores[at, row], block.ids[row])
    return best


def _merged(blocks: DataFrame, spark: SparkSession, anchors: Anchors, search: Callable[[Anchors, Iterator[Block], int], Best], most: int) -> DataFrame:
    """(unit, best) over all blocks; ``best`` is an array of (neg_score, id) in order."""
    sent = spark.sparkContext.broadcast(anchors)  # a slice: bounded in rows and bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = search(sent.value, _blocks(batches), most)
        for start in range(0, len(best.unit), 100_000):
            some = slice(start, start + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(x[some]) for x in (best.unit, -best.score, best.id)], ["unit", "neg_score", "id"])

    found = blocks.mapInArrow(run, "unit long, neg_score long, id long")
    # of each task at most ``most`` rows for a unit
    ranked = found.groupBy("unit").agg(F.slice(F.array_sort(F.collect_list(F.struct("neg_score", "id"))), 1, most).alias("best"))
    return materialize(ranked, "best-of-slice")


def _anchor_rows(store: Store, divisor: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            is_anchor = (block.ids % divisor == 0) & (block.ids != NO_ID)
            if is_anchor.any():
                v = block.vectors()[is_anchor]
                yield pa.RecordBatch.from_arrays([pa.array(block.ids[is_anchor]), pa.array(block.labels[is_anchor]), pa.array([x.tobytes() for x in v], pa.binary())], ["id", "label", "v"])

    return materialize(store.blocks.mapInArrow(run, "id long, label long, v binary"), "anchors")


RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def mine(
    vectors: DataFrame, anchors_every: int = 100, positives: int = POSITIVES, negatives: int = NEGATIVES, lowest_share: int = LOWEST_SHARE,
    highest_share: int = HIGHEST_SHARE, block_rows: int = BLOCK_ROWS, slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for ``whole_vectors``.

    Anchors are the rows whose id is divisible by ``anchors_every``. Their positives are the first rows of their label
    with another id; the negatives of a positive the first rows of another label whose score is
    within the shares (percent) of the positive's. First means higher scores, then smaller ids
    (NULL last). Fewer rows than asked for are all returned. Repeated rows count once; rows of
    one id that differ are rows of their own. No rows give an empty result.
    """
    spark = vectors.sparkSession
    store = build(vectors, block_rows)
    if store is None:
        return spark.createDataFrame([], RESULT)
    kind = exact_type(store)
    chosen = _anchor_rows(store, anchors_every)
    slices = max(1, -(-chosen.count() // max(1, min(slice_rows, SLICE_BYTES // (8 * store.dimensions)))))
    parts = []
    for number in range(slices):
        mine_ = chosen.where(F.pmod(F.xxhash64("id", "label", "v"), F.lit(slices)) == number).toArrow()  # bounded, see above
        if not mine_.num_rows:
            continue
        ids, labels = (mine_.column(c).to_numpy() for c in ("id", "label"))
        flat = np.frombuffer(b"".join(mine_.column("v").to_pylist()), "<i8").reshape(len(ids), -1).astype(kind)
        none = np.zeros((len(ids), 0), np.int64)
        found = _merged(store.blocks, spark, Anchors(ids, labels, flat, none, none), best_positives, positives).toArrow()
        low, high = np.ones((len(ids), positives), np.int64), np.zeros((len(ids), positives), np.int64)
        positive_ids, positive_scores = np.zeros((len(ids), positives), np.int64), np.zeros((len(ids), positives), np.int64)
        for unit, best in zip(found.column("unit").to_pylist(), found.column("best").to_pylist()):
            for place, row in enumerate(best):
                score = -row["neg_score"]
                positive_ids[unit, place], positive_scores[unit, place] = row["id"], score
                low[unit, place], high[unit, place] = -(-lowest_share * score // 100), highest_share * score // 100
        ranked = _merged(store.blocks, spark, Anchors(ids, labels, flat, low, high), best_negatives, negatives)
        about = pa.table({"unit": np.arange(low.size), "anchor_id": np.repeat(ids, positives), "positive_id": positive_ids.ravel(), "positive_score": positive_scores.ravel()})
        parts.append(ranked.join(spark.createDataFrame(about), "unit"))
    if not parts:
        return spark.createDataFrame([], RESULT)
    rows = reduce(DataFrame.unionByName, parts).select("anchor_id", "positive_id", "positive_score", F.posexplode("best").alias("place", "found"))
    known = lambda c: F.nullif(F.col(c), F.lit(NO_ID))
    return rows.withColumns({"negative": F.col("found.id")}).select(
        "anchor_id", known("positive_id").alias("positive_id"), (F.col("place") + 1).cast("int").alias("rank"), known("negative").alias("negative_id"),
        "positive_score", (-F.col("found.neg_score")).alias("negative_score"),
    )
