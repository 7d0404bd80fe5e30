from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from vitalgrid.functions import arrays, binary, numeric, records, text


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_round_exact_agrees_with_python(spark):
    rng = random.Random(7)
    values = [rng.random() for _ in range(3000)] + [i / 1000 + 0.0005 for i in range(1000)]
    values += [0.65 + s / 200 for s in range(69)] + [i / 32 for i in range(200)] + [-v for v in (0.5, 1.5, 0.125, 2.675)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (0, 1, 2, 4):
        got = [r.x for r in df.select(numeric.round_exact(F.col("v"), digits).alias("x")).collect()]
        assert got == [float(round(v, digits)) for v in values]


def test_parse_number_agrees_with_python(spark):
    samples = [
        "1", " 12 ", "1.5", ".5", "5.", "1e3", "1_000", "1__0", "_1", "1d", "2f", "0x10", "abc", "", "  ", "+3", "-4.2",
        "1.2.3", "inf", "-Infinity", "NAN", "1,5", " 7 ", "1 2", ".", "e5", "1e", "1E-2", "\t8\n", None,
    ]

    def expected(value):
        try:
            return float(value)
        except (TypeError, ValueError):
            return None

    df = spark.createDataFrame([(s,) for s in samples], "s string")
    got = [r.x for r in df.select(numeric.parse_number(F.col("s")).alias("x")).collect()]
    assert [repr(g) for g in got] == [repr(expected(s)) for s in samples]


def test_strip_removes_all_white_space(spark):
    samples = ["a", " a ", " a b　", "\t\x1ca\x85", "", "   ", "é "]
    df = spark.createDataFrame([(s,) for s in samples], "s string")
    assert [r.x for r in df.select(text.strip(F.col("s")).alias("x")).collect()] == [s.strip() for s in samples]


@pytest.mark.parametrize(
    "name, suffix",
    [("scan.JPG", ".jpg"), ("a.tar.gz", ".gz"), (".bashrc", ""), ("dir.d/file", ""), ("x", ""), ("a.", "."), ("p/q.png", ".png")],
)
def test_file_suffix(spark, name, suffix):
    assert one(spark, text.file_suffix(F.lit(name))) == suffix


def test_keys_and_codes(spark):
    assert one(spark, text.upload_key(F.lit("s-1"), F.lit("scan"))) == "uploads/s-1.jpg"
    assert one(spark, text.report_key("triage", F.lit("t"))) == "triage-reports/t.json"
    assert one(spark, text.patient_code(F.lit("abcdef12-3456"))) == "PAC-ABCDEF12"
    assert one(spark, text.capitalized(F.lit("uNKNOWN"))) == "Unknown"
    assert one(spark, text.symptom_feature(F.lit("symptom__chest pain"))) == "chest pain"
    assert one(spark, text.symptom_feature(F.lit("age"))) is None


def test_binary(spark):
    assert one(spark, binary.size_text(F.lit(1024 * 1024))) == "1.0 MB"
    assert one(spark, binary.size_text(F.lit(262144))) == f"{262144 / 1048576:.1f} MB"
    url = one(spark, binary.data_url(F.lit("a" * 200).cast("binary"), F.lit("image/jpeg")))
    assert url.startswith("data:image/jpeg;base64,") and "\n" not in url


def test_iso_time(spark):
    assert one(spark, records.iso_time(F.expr("timestamp'2026-05-14 10:00:00'"))) == "2026-05-14T10:00:00+00:00"
    assert one(spark, records.iso_time(F.expr("timestamp'2026-05-14 10:00:00.25'"))) == "2026-05-14T10:00:00.250000+00:00"


def test_softmax_and_argmax(spark):
    p = one(spark, arrays.softmax(F.array(F.lit(1000.0), F.lit(1000.0), F.lit(-1000.0))))
    assert p == [0.5, 0.5, 0.0]
    assert one(spark, arrays.first_greatest(F.array(F.lit(0.5), F.lit(0.5)))) == 1


def test_mean_and_spread(spark):
    stats = one(spark, arrays.mean_and_spread(F.array(*[F.lit(float(v)) for v in (2, 4, 4, 4, 5, 5, 7, 9)])))
    assert (stats.mean, stats.spread) == (5.0, 2.0)
    assert one(spark, arrays.mean_and_spread(F.array().cast("array<double>"))).mean is None


def test_nth_is_null_for_null_positions(spark):
    df = spark.createDataFrame([(1,), (None,), (9,)], "i int")
    assert [r.x for r in df.select(arrays.nth(arrays.literals(["a", "b"]), F.col("i")).alias("x")).collect()] == ["a", None, None]


def test_iso_time_is_in_utc_whatever_the_session(spark):
    """In another zone too, in the hour that its clocks repeat, and for times without zone."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    instants = {0: "1970-01-01T00:00:00+00:00", 1_793_511_000_500_000: "2026-11-01T05:30:00.500000+00:00", 1_793_514_600_000_001: "2026-11-01T06:30:00.000001+00:00"}
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        rows = spark.createDataFrame([(m,) for m in instants], "m long").select("m", records.iso_time(F.timestamp_micros("m")).alias("iso"))
        assert {r.m: r.iso for r in rows.collect()} == instants
        wall = spark.range(1).select(records.iso_time(F.lit("2026-03-08 02:30:00.25").cast("timestamp_ntz")).alias("iso"))  # a time those clocks skip
        assert wall.first().iso == "2026-03-08T02:30:00.250000+00:00"
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
