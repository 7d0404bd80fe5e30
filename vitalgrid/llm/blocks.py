"""Documents as blocks: a dictionary of a block's distinct terms, and a vector per document.

What is asked of every distinct term of a corpus need not be asked once per document. A block
of some megabytes of text is stored as its sorted distinct terms and, for each document, the
places of its terms in that dictionary with their frequencies. Only the dictionaries travel to
where terms are looked up, and only one value per place travels back. A frequent term costs
one row per block, not one per document, and a block is the most a task ever holds.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitalgrid.session import scratch_path

#: UTF-8 bytes of text after which a block is closed.
BLOCK_BYTES = 16 << 20
#: Of a block's documents: their ids, flags, bytes and numbers of distinct terms, and all vectors together.
#: Of a dictionary entry: its place, term, and frequency in flagged documents.
COLUMNS = ("block", "doc_id", "flag", "n_bytes", "distinct", "vectors", "place", "term", "flagged")

Terms = Callable[[str], list]


def pack(steps: np.ndarray, counts: np.ndarray) -> bytes:
    """Two columns of small numbers, byte by byte: the upper bytes are nearly all zero."""
    return zstandard.compress(np.stack([steps, counts]).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 3)


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1)
    steps, counts = np.ascontiguousarray(planes.T).view("<u4").astype(np.int64).reshape(2, -1)
    return steps, counts


class _Block:
    def __init__(self) -> None:
        self.places: defaultdict = defaultdict(count().__next__)
        self.ids: list[pa.Scalar] = []
        self.flags: list[bool] = []
        self.sizes: list[int] = []
        self.vectors: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, doc_id: pa.Scalar, flag: bool, text: str, terms: Terms) -> int:
        counts = Counter(terms(text))
        places = np.fromiter(map(self.places.__getitem__, counts), np.int64, len(counts))
        self.ids.append(doc_id)
        self.flags.append(flag)
        self.sizes.append(len(text.encode()))
        self.vectors.append((places, np.fromiter(counts.values(), np.int64, len(counts))))
        return self.sizes[-1]

    def rows(self, block: int, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
        names = sorted(self.places)
        rank = np.empty(len(names), np.int64)
        rank[np.fromiter(map(self.places.__getitem__, names), np.int64, len(names))] = np.arange(len(names))
        flagged, steps = np.zeros(len(names), np.int64), []
        for flag, (places, counts) in zip(self.flags, self.vectors):
            ranked = rank[places]
            if flag:
                flagged[ranked] += counts
            order = np.argsort(ranked)
            steps.append((np.diff(ranked[order], prepend=0), counts[order]))
        vectors = pack(*(np.concatenate(x) for x in zip(*steps)))
        distinct = pa.array([[len(places) for places, _ in self.vectors]], pa.list_(pa.int32()))
        of_documents = {"doc_id": pa.array([self.ids], pa.list_(id_type)), "flag": [self.flags], "n_bytes": [self.sizes]}
        yield self._batch(block, id_type, 1, **of_documents, distinct=distinct, vectors=[vectors])
        for start in range(0, len(names), 50_000):
            some = slice(start, start + 50_000)
            yield self._batch(block, id_type, len(names[some]), place=np.arange(len(names), dtype=np.int32)[some], term=names[some], flagged=flagged[some])

    @staticmethod
    def _batch(block: int, id_type: pa.DataType, rows: int, **columns) -> pa.RecordBatch:
        lists = (pa.list_(k) for k in (id_type, pa.bool_(), pa.int64(), pa.int32()))
        kinds = [pa.int64(), *lists, pa.binary(), pa.int32(), pa.string(), pa.int64()]
        given = {"block": np.full(rows, block), **columns}
        arrays = [pa.array(given[c], k) if c in given else pa.nulls(rows, k) for c, k in zip(COLUMNS, kinds)]
        return pa.RecordBatch.from_arrays(arrays, list(COLUMNS))


def blocks_of(docs: DataFrame, terms: Terms, flag: Column, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, DataFrame]:
    """``docs`` (doc_id, text without NULLs) as stored blocks.

    Two tables: documents (block, doc_id, flag, n_bytes, distinct, vectors), one row per block,
    with an entry of the arrays for every row of ``docs``; and dictionaries (block, place, term,
    flagged), ``flagged`` the frequency of the term in the block's documents with a true ``flag``. Blocks are numbered by the task that
    makes them; as both tables come from one stored write, a repeated task cannot mix two
    numberings.
    """
    spark = docs.sparkSession
    id_field = docs.schema["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = count(TaskContext.get().partitionId() << 24)
        block, size, kind = _Block(), 0, None
        for batch in batches:
            ids, flags, kind = batch.column(0), batch.column(1), batch.column(0).type
            for row, text in enumerate(batch.column(2)):
                size += block.add(ids[row], flags[row].as_py(), text.as_py(), terms)
                if size >= block_bytes:
                    yield from block.rows(next(numbers), kind)
                    block, size = _Block(), 0
        if block.ids:
            yield from block.rows(next(numbers), kind)

    lists = (T.ArrayType(k) for k in (id_field.dataType, T.BooleanType(), T.LongType(), T.IntegerType()))
    kinds = (T.LongType(), *lists, T.BinaryType(), T.IntegerType(), T.StringType(), T.LongType())
    schema = T.StructType([T.StructField(c, k) for c, k in zip(COLUMNS, kinds)])
    path = scratch_path(spark, "blocks")
    docs.select("doc_id", flag.alias("flag"), "text").mapInArrow(run, schema).write.option("compression", "zstd").parquet(path)
    stored = lambda: spark.read.schema(schema).parquet(path)  # noqa: E731  two readings, whose columns can be told apart in joins
    documents = stored().where("vectors is not null").select("block", "doc_id", "flag", "n_bytes", "distinct", "vectors")
    return documents, stored().where("term is not null").select("block", "place", "term", "flagged")


def sum_over_terms(documents: DataFrame, values: DataFrame, names: list[str]) -> DataFrame:
    """Weighted sums for every document: (doc_id, flag, n_bytes, n_terms, and a double for each of ``names``).

    ``values``: (block, place, *names), one row for every dictionary entry. ``n_terms`` is the
    number of terms with repeats, the others the sums of frequency times value.
    """
    of_documents = [T.StructField(n, documents.schema[n].dataType.elementType) for n in ("doc_id", "flag", "n_bytes")]
    out = T.StructType([*of_documents, T.StructField("n_terms", T.LongType()), *(T.StructField(n, T.DoubleType()) for n in names)])

    def run(docs: pa.Table, found: pa.Table) -> pa.Table:
        if not docs.num_rows:
            raise ValueError("values of a block without documents")
        places = found.column("place").to_numpy()
        grid = np.zeros((len(names), len(places)))
        for row, name in enumerate(names):
            grid[row, places] = found.column(name).to_numpy()
        distinct = np.array(docs.column("distinct")[0].as_py(), np.int64)
        steps, counts = unpack(docs.column("vectors")[0].as_py())
        sums, terms, start = np.zeros((len(names), len(distinct))), np.zeros(len(distinct), np.int64), 0
        for row, size in enumerate(distinct):
            how_often = counts[start : start + size]
            terms[row] = how_often.sum()
            sums[:, row] = grid[:, np.cumsum(steps[start : start + size])] @ how_often
            start += size
        return pa.table([*(docs.column(f.name)[0].values for f in of_documents), pa.array(terms), *map(pa.array, sums)], names=[f.name for f in out])

    return documents.groupBy("block").cogroup(values.select("block", "place", *names).groupBy("block")).applyInArrow(run, out)
