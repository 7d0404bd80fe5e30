"""A small table folder with every awkward row, and plain Python forms of the operators."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from plain import SF_DIR

#: Columns no operator knows, named like those that operators make.
CLASHING = ("size", "hash", "bytes", "spans", "fp", "block", "term", "place", "flag", "words", "blob_id", "path", "m", "doc", "label", "score", "of", "taken", "copies", "at", "kind", "n", "root")
DOCUMENTS = [
    (9001, None, "en", "src1"),
    (9002, "", "en", "src1"),
    (9003, " \t\n\x0b\x0c\r ", "de", None),
    (9004, "word " * 30_000, "en", "src2"),
    (9005, "x" * 200_000, None, "src2"),
    (None, "no id, but a text", "en", "src3"),
    (None, "no id, but a text", "en", "src3"),
    (None, None, None, None),
    (9006, "the same row twice over", "fr", "src3"),
    (9006, "the same row twice over", "fr", "src3"),
    (9006, "one id, another text", "fr", "src3"),
    (9007, "Ein Text ÄÖÜ mit   Trennern, ▁ und 漢字 😀 \x00 Ende", "de", "Src"),
    (9008, "secret=token: abcdefgh PassWord='hunter22' AKIA" + "A" * 16 + " " + "deadbeef" * 4, "en", "src4"),
    (9009, "-----BEGIN RSA PRIVATE KEY----- 😀 ghp_" + "a" * 36 + " https://me:pw@host/ token=aaaaaaa", "en", "src4"),
    (9010, "Licensed under the Apache License. mit license, CC-BY; gnu general public license", "en", "src5"),
    (9011, "SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0 WITH Classpath-exception-2.0\nCC0", "en", "src5"),
    (9012, "alpha beta gamma delta epsilon zeta eta theta iota KAPPA, lambda", "en", "src5"),
    (9013, "say Short Item twice: short item", "en", "src5"),
    (9014, "a line\nanother\na line\n \n \na line", "en", "src6"),
]
ITEMS = [(1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"), (2, "short item"), (3, None), (4, ""), (5, "iota kappa"), (2, "short item"), (None, "another text")]


SAME = "the same page, über 100 bytes " * 6
PAGES = [
    (9001, "http://b.example.com/", None), (9002, None, ""), (None, "no id", SAME), (9004, "http://x.example/", SAME), (9003, "http://x.example/a b", SAME), (9003, "http://x.example/a b", SAME),
    (9005, "http://x.example/y", "short"), (9006, "http://x.example/z", "short"), (None, None, None), (9007, "http://x.example/long", "long page " * 50_000), (9008, "", "WARC/1.1\r\n\r\n\r\n\r\n" * 9),
]


def write(folder: Path, documents, labels, items, pages=(), vectors=()) -> str:
    ids, texts, langs, sources = (list(c) for c in zip(*documents)) if documents else ([], [], [], [])
    columns = {
        "doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.string()), "lang": pa.array(langs, pa.string()), "source": pa.array(sources, pa.string()),
        "n_chars": pa.array([None if t is None else len(t) for t in texts], pa.int64()),
    }
    pq.write_table(pa.table(columns | {c: pa.array([f"own {c}"] * len(ids), pa.string()) for c in CLASHING}), folder / "documents.parquet")
    ids, quality, toxic = (list(c) for c in zip(*labels)) if labels else ([], [], [])
    pq.write_table(pa.table({"doc_id": pa.array(ids, pa.int64()), "quality": pa.array(quality, pa.int32()), "toxic": pa.array(toxic, pa.int32()), "text": pa.array([""] * len(ids), pa.string())}), folder / "labels.parquet")
    ids, texts = (list(c) for c in zip(*items)) if items else ([], [])
    pq.write_table(pa.table({"item_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.string()), "window": pa.array([0] * len(ids), pa.int64())}), folder / "benchmark.parquet")
    ids, urls, htmls = (list(c) for c in zip(*pages)) if pages else ([], [], [])
    columns = {"page_id": pa.array(ids, pa.int64()), "url": pa.array(urls, pa.string()), "html": pa.array(htmls, pa.string())}
    pq.write_table(pa.table(columns | {c: pa.array(["own"] * len(ids), pa.string()) for c in ("id", "date", "digest", "bytes", "payload", "value", "first")}), folder / "pages.parquet")
    ids, vectors, classes = (list(c) for c in zip(*vectors)) if vectors else ([], [], [])
    columns = {"vec_id": pa.array(ids, pa.int64()), "embedding": pa.array(vectors, pa.list_(pa.float32())), "label": pa.array(classes, pa.int32())}
    pq.write_table(pa.table(columns | {c: pa.array(["own"] * len(ids), pa.string()) for c in ("v", "key", "unit", "best", "score")}), folder / "embeddings.parquet")
    return str(folder)


@pytest.fixture(scope="session")
def rows():
    """(doc_id, text, lang, source) of the awkward folder."""
    return DOCUMENTS + duckdb.sql(f"select doc_id, text, lang, source from '{SF_DIR}/documents.parquet'").fetchall()


@pytest.fixture(scope="session")
def awkward(tmp_path_factory, rows):
    labels = duckdb.sql(f"select doc_id, quality, toxic from '{SF_DIR}/labels.parquet'").fetchall()
    labels += labels[:5] + [(None, 1, 0), (9001, None, None), (9006, 0, 1), (77_777, 1, 0)]
    items = ITEMS + duckdb.sql(f"select item_id + 100, text from '{SF_DIR}/benchmark.parquet'").fetchall()
    pages = PAGES + duckdb.sql(f"select page_id, url, html from '{SF_DIR}/pages.parquet'").fetchall()
    vectors = duckdb.sql(f"select vec_id, embedding, label from '{SF_DIR}/embeddings.parquet'").fetchall()
    first = list(vectors[0][1])
    vectors += [(90_001, None, 1), (90_002, first, None), (90_003, first[:-1] + [None], 2), (90_004, [float("nan")] * len(first), 3), (90_005, [float("inf")] * len(first), 3)]
    vectors += [(n, first, n % 10) for n in range(90_100, 90_140)]  # ties
    return write(tmp_path_factory.mktemp("awkward"), rows, labels, items, pages, vectors)


@pytest.fixture(scope="session")
def empty(tmp_path_factory):
    return write(tmp_path_factory.mktemp("empty"), [], [], [])
