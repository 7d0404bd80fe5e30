"""Near-duplicates by SimHash, compared bit-sliced.

Distinct fingerprints meet where they agree on two of five parts of their bits: with at most
three differing bits some two parts are untouched, so no link is missed. A bucket is cut into
blocks of bounded size. Blocks are compared vertically: a plane holds one bit of 64 lanes in
a word, every plane updates the distances of all lanes with a carry-save counter, and a block
is given up once all its lanes are beyond the radius. Only the edges of the groups found leave
a task, never all pairs; groups are joined by alternating star steps, whose tables are stored
in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitalgrid.session import materialize

SEED, SHINGLE = 42, 3
#: Two binary digits count to it, and a carry out of them is beyond it.
RADIUS = 3
#: First bit and width of the parts. RADIUS differing bits leave two of RADIUS + 2 parts equal.
PARTS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
#: Fingerprints in a block; a larger bucket becomes several blocks, compared pair by pair.
BLOCK = 1024
#: Buckets up to this size share lanes with others; queries of larger ones go in groups of this size.
SMALL, QUERIES = 48, 128
LOWER_BYTES = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
WORD = np.uint64
FULL = WORD(2**64 - 1)


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """The 64 bits of a text; one without words has 0."""
    words = text.encode().translate(LOWER_BYTES).split()
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = [b" ".join(g) for g in zip(*(words[i:] for i in range(shingle)))]
    total = np.zeros(64, np.int64)
    for start in range(0, len(grams), 65536):  # keeps the bits of long texts small
        part = grams[start : start + 65536]
        hashes = np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in part), "<u8", len(part))
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(grams), bitorder="little").view("<u8")[0])


@F.arrow_udf(T.LongType())
def fingerprints(texts: pa.Array) -> pa.Array:
    """Fingerprints as signed longs."""
    return pa.array(np.array([fingerprint(t or "") for t in texts.to_pylist()], WORD).view(np.int64))


def planes(values: np.ndarray) -> np.ndarray:
    """``values`` stored vertically: row b holds bit b of all of them, 64 lanes to a word."""
    bits = np.zeros((-(-len(values) // 64) * 64, 64), np.uint8)
    bits[: len(values)] = np.unpackbits(values.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")


def lanes_within(differing: Iterator[np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
    """Masks of the lanes in which at most RADIUS of the planes of ``differing`` have a bit.

    ``ones`` and ``twos`` are the two digits of every lane's counter; a carry out of ``twos``
    puts the lane beyond the radius for good. Ends early when all lanes are.
    """
    ones, twos, beyond = (np.zeros(shape, WORD) for _ in range(3))
    for number, plane in enumerate(differing, 1):
        carry = ones & plane
        ones ^= plane
        beyond |= twos & carry
        twos ^= carry
        if number % 8 == 0 and (beyond == FULL).all():
            break
    return ~beyond


def close_pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For two columns of fingerprints, which rows are within the radius."""
    stored = planes(a ^ b)
    masks = lanes_within(iter(stored), stored.shape[1:])
    return np.unpackbits(masks.view(np.uint8), bitorder="little")[: len(a)].astype(bool)


def close_blocks(queries: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (query, lane) of all pairs within the radius."""
    stored, found = planes(block), []
    for start in range(0, len(queries), QUERIES):
        some = queries[start : start + QUERIES]
        flips = [(WORD(0) - (some >> WORD(bit) & WORD(1)))[:, None] for bit in range(64)]
        masks = lanes_within((stored[bit] ^ flips[bit] for bit in range(64)), (len(some), stored.shape[1]))
        hits = np.unpackbits(masks.view(np.uint8), axis=1, bitorder="little")[:, : len(block)]
        at, lane = np.nonzero(hits)
        found.append((at + start, lane))
    return tuple(np.concatenate(x) for x in zip(*found))


def spanning_edges(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node of its group) that connect what the pairs (a, b) of places connect."""
    label = np.arange(len(values))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    own = np.nonzero(label != np.arange(len(values)))[0]
    return values[own], values[label[own]]


def _edges_of_groups(values: np.ndarray, sides: np.ndarray, starts: np.ndarray) -> pa.RecordBatch:
    """Edges of whole groups: group g is ``values[starts[g] : starts[g + 1]]``."""
    left, right, ends = [], [], starts[1:]
    for start, end in zip(starts, ends):
        n, cut = end - start, start + int(np.searchsorted(sides[start:end], 1))
        if cut == end and n <= SMALL:  # one small block: its pairs share lanes with those of other buckets
            i, j = np.triu_indices(n, 1)
            left.append(i + start)
            right.append(j + start)
        elif cut == end or cut > start:
            others = slice(start, end) if cut == end else slice(cut, end)
            i, j = close_blocks(values[start:cut], values[others])
            left.append(i + start)
            right.append(j + others.start)
    a, b = np.concatenate(left or [[]]).astype(int), np.concatenate(right or [[]]).astype(int)
    near = close_pairs(values[a], values[b]) if len(a) else np.zeros(0, bool)
    node, root = spanning_edges(values, a[near], b[near])
    return pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), pa.array(root.view(np.int64))], ["node", "root"])


def compare_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges from rows (bucket, i, j, side, fp) that are sorted; holds the unfinished group only."""
    rest: list[np.ndarray] = []
    for batch in batches:
        new = np.stack([np.asarray(batch.column(c), np.int64) for c in range(5)])
        rows = np.concatenate([*rest, new], axis=1)
        change = np.nonzero((rows[:3, 1:] != rows[:3, :-1]).any(0))[0] + 1
        if len(change):
            starts = np.concatenate([[0], change])
            yield _edges_of_groups(rows[4].view(WORD), rows[3], starts)
        rest = [rows[:, change[-1] if len(change) else 0 :]]
    if rest and rest[0].shape[1]:
        yield _edges_of_groups(rest[0][4].copy().view(WORD), rest[0][3], np.array([0, rest[0].shape[1]]))


def bucket_keys(fp: Column) -> Column:
    """One key for every two parts: the number of the choice above the bits of both."""
    part = lambda k: F.shiftrightunsigned(fp, PARTS[k][0]).bitwiseAND(F.lit(2 ** PARTS[k][1] - 1))
    width = max(w for _, w in PARTS)
    pairs = enumerate(combinations(range(len(PARTS)), 2))
    return F.array(*[F.lit(n << 2 * width) + F.shiftleft(part(a), width) + part(b) for n, (a, b) in pairs])


def link(fps: DataFrame, block: int = BLOCK) -> DataFrame:
    """Edges (node, root) that connect all fingerprints of ``fps`` (distinct, column ``fp``) linked directly or through others.

    Buckets of one are dropped before anything is compared. A bucket of several blocks becomes
    a group for each two of them, so no task holds more than two blocks at a time.
    """
    keyed = fps.select("fp", F.explode(bucket_keys(F.col("fp"))).alias("bucket"))
    sizes = keyed.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / block).cast("long")
    placed = keyed.join(sizes, "bucket").select("bucket", "fp", blocks.alias("blocks"), F.pmod(F.xxhash64("fp"), blocks).alias("own"))
    meets = placed.select("bucket", "fp", "own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    rows = meets.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("long").alias("side"), "fp")
    dealt = rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "side")
    return dealt.mapInArrow(compare_groups, "node long, root long").distinct()


def star_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` but the roots; the root is the smallest node of its component.

    Alternating large and small stars; each round is stored, and the rounds end when one
    changes nothing. Their number grows with the logarithm of the longest chain.
    """
    digest = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("node", "root").cast("decimal(38,0)"))).first()
    edges = materialize(edges.where("node <> root").select(F.greatest("node", "root").alias("node"), F.least("node", "root").alias("root")).distinct(), "star")
    seen = digest(edges)
    while seen[0]:
        both = edges.unionByName(edges.select(F.col("root").alias("node"), F.col("node").alias("root")))
        lowest = both.groupBy("node").agg(F.min("root").alias("low")).select("node", F.least("low", "node").alias("low"))
        large = both.join(lowest, "node").where("root > node").select(F.col("root").alias("node"), F.col("low").alias("root")).distinct()
        large = materialize(large, "star-large")
        lowest = large.groupBy("node").agg(F.min("root").alias("low"))
        small = large.join(lowest, "node").where("root <> low").select(F.col("root").alias("node"), F.col("low").alias("root"))
        edges = materialize(small.unionByName(lowest.select("node", F.col("low").alias("root"))).distinct(), "star")
        now = digest(edges)
        if now == seen:
            break
        seen = now
    return edges


def members(printed: DataFrame, block: int = BLOCK) -> DataFrame:
    """(fp, root, component_id) of every distinct fingerprint in ``printed`` (doc_id, fp).

    ``root``: a fingerprint that names the component; ``component_id``: its smallest doc_id
    (NULL only if all are). Equal fingerprints are one node, however many rows have them.
    """
    fps = materialize(printed.groupBy("fp").agg(F.min("doc_id").alias("low_id")), "fingerprints")
    stars = star_components(link(fps.select("fp"), block))
    linked = stars.select(F.col("node").alias("fp"), "root").unionByName(stars.select(F.col("root").alias("fp"), "root").distinct())
    of_root = linked.join(fps, "fp").groupBy("root").agg(F.min("low_id").alias("component_id"))
    known = materialize(linked.join(of_root, "root"), "components")
    return fps.join(known, "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), F.when(F.col("root").isNull(), F.col("low_id")).otherwise(F.col("component_id")).alias("component_id")
    )


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id), one row per row of ``docs``.

    NULL, empty and blank texts have fingerprint 0 and link like others. Repeated rows share a
    component; NULL ids take no part in the smallest id. Other columns are not read. An empty
    table gives an empty result.
    """
    printed = materialize(docs.select(docs[id_col].alias("doc_id"), fingerprints(docs[text_col]).alias("fp")), "printed")
    return printed.join(members(printed).select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component, the one with the smallest id (NULL last), with all its columns.

    Rows that share id and fingerprint are told apart by nothing; one of them stays.
    """
    packed = materialize(docs.select(F.struct("*").alias("doc"), docs[id_col].alias("doc_id"), fingerprints(docs[text_col]).alias("fp")), "printed-docs")
    ids = packed.groupBy("doc_id", "fp").agg(F.count("*").alias("n"))
    first = ids.join(members(packed.select("doc_id", "fp")), "fp").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "fp", "n")).alias("first"))
    chosen = materialize(first.select(F.col("first.doc_id").alias("id"), F.col("first.fp").alias("print"), F.col("first.n").alias("n")), "chosen")
    same = packed["fp"].eqNullSafe(chosen["print"]) & packed["doc_id"].eqNullSafe(chosen["id"])
    alone = packed.join(chosen.where("n = 1"), same, "left_semi")
    repeated = packed.join(chosen.where("n > 1"), same, "left_semi").dropDuplicates(["doc_id", "fp"])
    return alone.unionByName(repeated).select("doc.*")
