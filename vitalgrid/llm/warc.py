"""WARC archives of captures, and their index merged into globally ordered capture histories.

A capture whose payload another one has already is a revisit record that refers to it. Records are texts that Spark's
writer stores with the two line ends that separate them; an archive is one file of a task.
The archives are read back, every payload is held against its digest, and each archive gives a
run of its captures, sorted by address key and time. The runs are merged as an external index
is: cut into key ranges of bounded size, and in each range a tree of losers merges what the
runs have there. A range is sampled by key, time and id, so that captures of one address,
however many, lie in several.
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Callable, Iterator, Sequence
from urllib.parse import unquote_plus, urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitalgrid.session import materialize, scratch_path

#: A shorter payload is always stored.
LEAST_PAYLOAD = 100
#: Payload bytes of an archive, on average; captures of a range that is merged in one task.
ARCHIVE_BYTES, RANGE_ROWS = 32 << 20, 200_000
# Fixed values of the format.
VERSION, LINE, GAP = "WARC/1.1", "\r\n", "\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RESPONSE_TYPE = "application/http;msgtype=response"
STATUS = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "
NAME = "urn:page:"


def captures(pages: DataFrame, date: Column | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """(id, url, date, payload, digest, bytes); ``date``: a timestamp, the epoch if not given. NULL payloads are empty."""
    payload = F.coalesce(pages[payload_col], F.lit(""))
    when = F.timestamp_seconds(F.lit(0)) if date is None else date
    in_utc = F.date_format(F.to_utc_timestamp(when, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    # white space and control characters would end a header line
    return pages.select(
        pages[id_col].alias("id"), F.regexp_replace(pages[url_col], r"[\x00-\x20\x7F]", "%20").alias("url"), in_utc.alias("date"), payload.alias("payload"),
        F.sha2(payload.cast("binary"), 256).alias("digest"), F.octet_length(payload).cast("long").alias("bytes"),
    )


def _name(id_: Column) -> Column:
    return F.concat(F.lit(f"<{NAME}"), F.coalesce(F.url_encode(id_.cast("string")), F.lit("")), F.lit(">"))


def _header(name: str, value: Column) -> Column:
    """A header line, or nothing for NULL."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(LINE)), F.lit(""))


def _record(kind: str, more: Sequence[Column], block: Column) -> Column:
    return F.concat(
        F.lit(f"{VERSION}{LINE}WARC-Type: {kind}{LINE}"), _header("WARC-Record-ID", _name(F.col("id"))), _header("WARC-Date", F.col("date")), _header("WARC-Target-URI", F.col("url")),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))), *more, F.lit(f"Content-Type: {RESPONSE_TYPE}{LINE}"),
        _header("Content-Length", F.octet_length(block).cast("string")), F.lit(LINE), block,
    )


def write_archives(found: DataFrame, path: str, least_payload: int = LEAST_PAYLOAD, archive_bytes: int = ARCHIVE_BYTES) -> str:
    """Writes ``captures`` as compressed archives below ``path``, and returns that.

    Of equal payloads of ``least_payload`` bytes or more the capture of the smallest id (NULL
    last) is stored, all its rows if it is repeated; the others refer to it.
    """
    place = F.struct(F.col("id").isNull().alias("unnamed"), "id", "date", "url")
    payloads = materialize(found.groupBy("digest", "bytes").agg(F.count("*").alias("n"), F.min(place).alias("first")), "payloads")
    total = payloads.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("bytes")).alias("bytes")).first()
    mean = (total["bytes"] or 0) / (total["n"] or 1)
    stored = payloads.where((F.col("n") > 1) & (F.col("bytes") >= least_payload)).select(F.col("digest").alias("of"), "first")
    joined = found.join(stored, F.col("digest") == F.col("of"), "left")
    is_revisit = F.col("of").isNotNull() & ~F.col("id").eqNullSafe(F.col("first.id"))
    status = F.concat(F.lit(STATUS), F.col("bytes").cast("string"), F.lit(GAP))
    refers = [
        _header("WARC-Profile", F.lit(REVISIT_PROFILE)), _header("WARC-Refers-To", _name(F.col("first.id"))),
        _header("WARC-Refers-To-Target-URI", F.col("first.url")), _header("WARC-Refers-To-Date", F.col("first.date")),
    ]
    record = F.when(is_revisit, _record("revisit", refers, status)).otherwise(_record("response", [], F.concat(status, F.col("payload"))))
    writer = joined.select(record.alias("value")).write.option("lineSep", GAP).option("compression", "gzip")
    writer.option("maxRecordsPerFile", max(1, int(archive_bytes // max(mean, 1)))).text(path)
    return path


def records(archive: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(start, end, headers, block) of each record of an archive that is not compressed any more."""
    at, gap = 0, GAP.encode()
    while at < len(archive):
        head = archive.index(gap, at)
        version, *lines = archive[at:head].decode().split(LINE)
        headers = dict(line.split(": ", 1) for line in lines)
        end = head + 4 + int(headers["Content-Length"])
        if version != VERSION or archive[end : end + 4] != gap:
            raise ValueError(f"no record at {at}")
        yield at, end + 4, headers, archive[head + 4 : end]
        at = end + 4


def url_key(url: str) -> str:
    """Sortable form of an address: host turned round and lower-cased, then the rest; port and login stay out."""
    try:
        parts = urlsplit(url)
        host = (parts.hostname or "").strip(".")
    except ValueError:
        return url.lower()
    host = host.removeprefix("www.")
    query = f"?{parts.query}" if parts.query else ""
    return ",".join(reversed(host.split("."))) + ")" + (parts.path or "/").lower() + query.lower()


def _id_of(name: str) -> str | None:
    return unquote_plus(name[1:-1].removeprefix(NAME)) or None


CAPTURE = "url_key string, date string, id string, record_type string, payload_digest string, payload_bytes long, refers_to string, url string, archive string, start long, length long"
_NAMES = [f.split()[0] for f in CAPTURE.split(", ")]


def capture_of(archive: str, start: int, end: int, headers: dict[str, str], block: bytes) -> tuple:
    """An index row. The digest and length in the headers must be those of a payload that is there."""
    head, _, payload = block.partition(GAP.encode())
    digest, size = headers["WARC-Payload-Digest"].removeprefix("sha256:"), int(head.rsplit(b" ", 1)[1])
    kind, url = headers["WARC-Type"], headers.get("WARC-Target-URI")
    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"damaged payload in {archive} at {start}")
    refers = _id_of(headers["WARC-Refers-To"]) if kind == "revisit" else None
    return url_key(url or ""), headers["WARC-Date"], _id_of(headers["WARC-Record-ID"]), kind, digest, size, refers, url, archive, start, end - start


def order_of(row: tuple) -> tuple:
    """Address key, time, then id (NULL last) and place, so that reruns agree."""
    return row[0], row[1], row[2] is None, row[2] or "", row[8], row[9]


def capture_runs(spark: SparkSession, path: str) -> DataFrame:
    """A run for each archive below ``path``: its captures (run, nth, ...) in order; stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                archive = name.rsplit("/", 1)[-1]
                rows = sorted((capture_of(archive, *r) for r in records(gzip.decompress(content.as_py()))), key=order_of)
                for start in range(0, len(rows), 20_000):
                    some = rows[start : start + 20_000]
                    columns = [pa.array(c, pa.int64() if n in ("payload_bytes", "start", "length") else pa.string()) for n, c in zip(_NAMES, zip(*some))]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(range(start, start + len(some)), pa.int64())], [*_NAMES, "nth"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", "content")
    return materialize(files.mapInArrow(run, f"{CAPTURE}, nth long"), "capture-runs")


class LoserTree:
    """Merges sorted runs. A node keeps the loser of the match below it; the winner's next item
    plays the losers on its way up, one match for each level."""

    def __init__(self, runs: Sequence[Iterator], key: Callable = lambda item: item) -> None:
        self.runs, self.key, self.size = runs, key, len(runs)
        self.items: list = [None] * self.size
        self.keys: list[tuple] = [()] * self.size
        for leaf in range(self.size):
            self._advance(leaf)
        self.losers = [0] * self.size
        winners = [0] * self.size + list(range(self.size))
        for node in range(self.size - 1, 0, -1):
            winners[node], self.losers[node] = self._match(winners[2 * node], winners[2 * node + 1])
        self.winner = winners[1] if self.size > 1 else 0

    def _advance(self, leaf: int) -> None:
        """An ended run has the key (True,), which loses against all items."""
        self.items[leaf] = item = next(self.runs[leaf], None)
        self.keys[leaf] = (True,) if item is None else (False, self.key(item))

    def _match(self, a: int, b: int) -> tuple[int, int]:
        return (a, b) if (self.keys[a], a) <= (self.keys[b], b) else (b, a)

    def __iter__(self) -> Iterator:
        while self.size and not self.keys[self.winner][0]:
            yield self.items[self.winner]
            leaf = winner = self.winner
            self._advance(leaf)
            node = (leaf + self.size) // 2
            while node:
                winner, self.losers[node] = self._match(winner, self.losers[node])
                node //= 2
            self.winner = winner


def merge_runs(runs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The captures of all runs in one order: (part, place) rises with address key and time.

    A part is a key range, and holds what every run has in it; of one run's rows the order is kept.
    """
    parts = max(1, -(-runs.count() // range_rows))
    ranged = runs.repartitionByRange(parts, "url_key", "date", "id", "archive", "start").sortWithinPartitions("archive", "nth")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of: dict[str, list[tuple]] = {}
        for batch in batches:  # a bounded range
            for row in zip(*(batch.column(c).to_pylist() for c in _NAMES)):
                of.setdefault(row[8], []).append(row)
        part, merged = TaskContext.get().partitionId(), list(LoserTree([iter(rows) for rows in of.values()], order_of))
        for start in range(0, len(merged), 20_000):
            some = merged[start : start + 20_000]
            columns = [pa.array(c, pa.int64() if n in ("payload_bytes", "start", "length") else pa.string()) for n, c in zip(_NAMES, zip(*some))]
            places = pa.array(range(start, start + len(some)), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(some), pa.int32()), places, *columns], ["part", "place", *_NAMES])

    return ranged.mapInArrow(run, f"part int, place long, {CAPTURE}")


def capture_histories(spark: SparkSession, path: str, id_type: T.DataType | None = None, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The merged index of the archives below ``path``; ids of ``id_type`` (texts unless given).

    (part, place, url_key, date, id, record_type, payload_digest, payload_bytes, refers_to, url,
    archive, start, length), one row per record; ``start`` and ``length`` are places in the
    archive as decompressed. A folder without records gives no rows.
    """
    merged = merge_runs(capture_runs(spark, path), range_rows)
    return merged if id_type is None else merged.withColumns({c: F.col(c).cast(id_type) for c in ("id", "refers_to")})


def archive_pages(pages: DataFrame, date: Column | None = None, path: str | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Writes ``pages`` as archives (below ``path``, else in the shared folder) and reads them back: ``capture_histories``.

    One record for each row. NULL payloads are empty, NULL addresses have no header and the
    empty key, NULL ids an empty name; white space and control characters of an address become
    ``%20``. Repeated rows of the smallest id are all stored. Other columns are not read.
    """
    spark = pages.sparkSession
    path = write_archives(captures(pages, date, id_col, url_col, payload_col), path or scratch_path(spark, "archives"))
    return capture_histories(spark, path, pages.schema[id_col].dataType)
