"""Order-insensitive comparison of a Spark result with the DuckDB result of its text."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def _family(type_name: str) -> str:
    name = type_name.lower()
    if name in ("tinyint", "smallint", "int", "integer", "bigint", "long"):
        return "integer"
    return {"varchar": "string"}.get(name, name)


def differences(frame, connection, sql: str) -> list[str]:
    result = connection.execute(sql)
    expected_types = {c[0]: _family(str(c[1])) for c in result.description}
    expected_rows = result.fetchall()
    actual_types = {name: _family(kind) for name, kind in frame.dtypes}
    if actual_types != expected_types:
        return [f"schema {actual_types} != {expected_types}"]
    names = sorted(actual_types)
    places = [list(expected_types).index(name) for name in names]
    actual = sorted((tuple(row[n] for n in names) for row in frame.collect()), key=repr)
    expected = sorted((tuple(row[i] for i in places) for row in expected_rows), key=repr)
    if len(actual) != len(expected):
        return [f"rows {len(actual)} != {len(expected)}"]
    for a, e in zip(actual, expected):
        for name, x, y in zip(names, a, e):
            same = x == y or (isinstance(x, float) and isinstance(y, float) and math.isnan(x) and math.isnan(y))
            if not same:
                return [f"{name}: {x!r} != {y!r} in {a} / {e}"]
    return []
