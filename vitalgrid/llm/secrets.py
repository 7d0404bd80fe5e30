"""Secret scans over a ledger of blobs.

Every version of every path is filed under the digest of its content. The ledger knows which
blobs have been scanned with which version of the rules; a run scans each unseen pair of blob
and rule version once, however many paths and versions share the content, and joins the
findings back to all of them. Built-in functions only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalgrid.functions.arrays import bind
from vitalgrid.session import scratch_path


class Rule(NamedTuple):
    """``hints``: a text without any of them, lower-cased, has no match. ``value``: fewest characters of group 1, or 0."""

    kind: str
    pattern: str
    hints: tuple[str, ...] = ()
    value: int = 0


# The patterns every scan has, then those of this scan. Runs that are too short
# are left out of a pattern where no other match can begin inside them.
BASE_RULES = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", ("passw", "secret", "token", "key"), 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}", ("akia",)),
    Rule("hex", r"[0-9a-f]{24,}"),
)
MORE_RULES = (
    Rule("private_key", r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----", ("private key",)),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", ("eyj",)),
    Rule("code_host", r"(?:gh[pousr]_|glpat-)[A-Za-z0-9_-]{20,}", ("gho_", "ghp_", "ghu_", "ghs_", "ghr_", "glpat-")),
    Rule("chat_bot", r"xox[abprs]-[A-Za-z0-9-]{10,}", ("xox",)),
    Rule("map_key", r"AIza[0-9A-Za-z_-]{35}", ("aiza",)),
    Rule("url_login", r"[a-z][a-z0-9+.-]*://[^\x00-\x20:/@]+:[^\x00-\x20:/@]+@", ("://",)),
)
RULES = BASE_RULES + MORE_RULES
SPANS = "array<struct<start:int,kind:int,end:int>>"
MASK = "[SECRET]"


def rule_version(rules: tuple[Rule, ...] = RULES) -> str:
    return hashlib.sha256(repr([tuple(r) for r in rules]).encode()).hexdigest()[:16]


def blob_id(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


#: Items of a scan that are gathered in one array, which is copied for each of them.
CHUNK = 512


def chunks(items: Column) -> Column:
    """``items`` as arrays of CHUNK items, and the rest."""
    starts = F.when(F.size(items) > 0, F.sequence(F.lit(1), F.size(items), F.lit(CHUNK))).otherwise(F.array().cast("array<int>"))
    return bind(items, lambda x: F.transform(starts, lambda start: F.slice(x, start, F.lit(CHUNK))))


def scan_items(items: Column, step: Callable[[Column, Column], tuple[Column, Column]], kind: str) -> Column:
    """Outputs, of type ``kind``, of ``step(at, item) -> (at, output)`` over the items; NULL outputs are left out.

    Appending copies an array. Outputs are gathered by chunk, so that the copies stay short.
    """
    none = F.array().cast(f"array<{kind}>")

    def one(done: Column, x: Column) -> Column:
        at, out = step(done["at"], x)
        return F.struct(at.alias("at"), bind(out, lambda o: F.when(o.isNull(), done["out"]).otherwise(F.concat(done["out"], F.array(o)))).alias("out"))

    def many(done: Column, chunk: Column) -> Column:
        inner = F.aggregate(chunk, F.struct(done["at"].alias("at"), none.alias("out")), one)
        return bind(inner, lambda i: F.struct(i["at"].alias("at"), F.concat(done["out"], F.array(i["out"])).alias("out")))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{kind}>>").alias("out"))
    return F.flatten(F.aggregate(chunks(items), start, many)["out"])


SPAN = "struct<start:int,kind:int,end:int>"


def _spans_of(text: Column, number: int, rule: Rule) -> Column:
    """Places of the leftmost non-overlapping matches, in code points: the lengths of what
    stands between the matches and of the matches themselves, summed up."""
    hits, between = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), F.split(text, rule.pattern, -1)
    values = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(1)) if rule.value else hits
    gaps = bind(hits, lambda h: F.slice(between, 1, F.size(h)))
    steps = F.arrays_zip(gaps.alias("gap"), hits.alias("hit"), values.alias("value"))

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        start = at + F.length(x["gap"])
        end = start + F.length(x["hit"])
        return end, F.when(F.length(x["value"]) >= rule.value, F.struct(start.alias("start"), F.lit(number).alias("kind"), end.alias("end")))

    return scan_items(steps, step, SPAN)


def spans(text: Column, lowered: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """All spans of a text by start, then by the order of the rules."""
    nothing, found = F.array().cast(SPANS), []
    for number, rule in enumerate(rules):
        hinted = F.lit(not rule.hints)
        for hint in rule.hints:
            hinted = hinted | F.contains(lowered, F.lit(hint))
        found.append(F.when(hinted & text.rlike(rule.pattern), _spans_of(text, number, rule)).otherwise(nothing))
    return F.array_sort(F.concat(*found))


def create_ledger(spark: SparkSession, path: str, path_type: str = "bigint", mode: str = "error") -> str:
    """An empty ledger: ``versions`` (path, blob_id) and ``findings`` (blob_id, rules, spans)."""
    spark.sql(f"select cast(null as {path_type}) as path, '' as blob_id where false").write.mode(mode).parquet(f"{path}/versions")
    spark.sql(f"select '' as blob_id, '' as rules, cast(array() as {SPANS}) as spans where false").write.mode(mode).parquet(f"{path}/findings")
    return path


def open_ledger(docs: DataFrame, path: str, id_col: str = "doc_id") -> str:
    """The ledger at ``path``, begun there if there is none; what it holds stays."""
    return create_ledger(docs.sparkSession, path, docs.schema[id_col].dataType.simpleString(), mode="append")


def record(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Files the documents as versions of their paths and scans what has not been scanned.

    Returns the findings (blob_id, spans) of the current rules. Earlier versions stay in the
    ledger. A run that is repeated scans nothing again; a version filed twice counts once
    where the ledger is read. One run at a time may write to a ledger, so that a blob has one
    row of findings per rule version. NULL text is an empty blob.
    """
    spark = docs.sparkSession
    text = F.coalesce(docs[text_col], F.lit(""))
    filed = docs.select(docs[id_col].alias("path"), blob_id(text).alias("blob_id"), text.alias("text"))
    filed.select("path", "blob_id").distinct().write.mode("append").parquet(f"{ledger}/versions")
    current = rule_version(rules)
    findings = lambda: spark.read.parquet(f"{ledger}/findings").where(F.col("rules") == current)
    unseen = filed.select("blob_id", "text").join(findings().select("blob_id"), "blob_id", "left_anti").dropDuplicates(["blob_id"])
    scanned = unseen.select("blob_id", F.lit(current).alias("rules"), spans(F.col("text"), F.lower("text"), rules).alias("spans"))
    scanned.write.mode("append").parquet(f"{ledger}/findings")
    return findings().select("blob_id", "spans")


def findings_by_path(spark: SparkSession, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(path, blob_id, spans) of every historical version that holds a secret under these rules."""
    found = spark.read.parquet(f"{ledger}/findings").where((F.col("rules") == rule_version(rules)) & (F.size("spans") > 0))
    return spark.read.parquet(f"{ledger}/versions").distinct().join(found.select("blob_id", "spans"), "blob_id").select("path", "blob_id", "spans")


def new_ledger(docs: DataFrame, id_col: str = "doc_id") -> str:
    spark = docs.sparkSession
    return create_ledger(spark, scratch_path(spark, "secret-ledger"), docs.schema[id_col].dataType.simpleString())


def scan(docs: DataFrame, ledger: str | None = None, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, blob_id, spans), one row per row of ``docs``, through a ledger (a new one if none is given).

    NULL and empty texts have no spans; repeated rows and NULL ids are rows like others; other
    columns are not read.
    """
    found = record(docs, ledger or new_ledger(docs, id_col), rules, id_col, text_col).withColumnRenamed("blob_id", "of")
    paths = docs.select(docs[id_col].alias("doc_id"), blob_id(docs[text_col]).alias("blob_id"))
    return paths.join(found, paths["blob_id"] == found["of"]).select("doc_id", "blob_id", "spans")


def describe(found: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """``kind:start:end`` of all spans, comma-joined."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"], s["end"])), ",")


def masked(text: Column, found: Column, mask: str = MASK) -> Column:
    """The text with every span, or run of overlapping spans, replaced.

    The text is cut once for every chunk of spans, and each cut at the spans of its chunk:
    looking for a place in a text begins at its first character.
    """

    def step(at: Column, s: Column) -> tuple[Column, Column]:
        is_new = (s["start"] > at) | ((s["start"] == at) & (at == 0))
        return F.greatest(at, s["end"]), F.when(is_new, F.struct(at.alias("a"), s["start"].alias("b")))

    def cut(gaps: Column, whole: Column) -> Column:
        """The texts of a chunk of gaps, with a mask behind each."""
        base, last = F.get(gaps, F.lit(0))["a"], F.element_at(gaps, -1)["b"]
        return bind(base, lambda low: bind(F.substring(whole, low + 1, last - low), lambda part: F.array_join(
            F.transform(gaps, lambda g: F.concat(F.substring(part, g["a"] - low + 1, g["b"] - g["a"]), F.lit(mask))), "")))

    gaps = scan_items(found, step, "struct<a:int,b:int>")
    end = F.array_max(F.transform(found, lambda s: s["end"]))
    rest = bind(end, lambda e: F.substring(text, e + 1, F.length(text)))
    return F.concat(bind(text, lambda whole: F.array_join(F.transform(chunks(gaps), lambda c: cut(c, whole)), "")), rest)


def mask_secrets(docs: DataFrame, ledger: str | None = None, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with its columns, every secret in the text replaced. All rows stay."""
    found = record(docs, ledger or new_ledger(docs, id_col), rules, id_col, text_col).where(F.size("spans") > 0)
    packed = docs.select(F.struct("*").alias("doc"), blob_id(docs[text_col]).alias("of"))
    joined = packed.join(found, packed["of"] == found["blob_id"], "left")
    text = F.when(F.col("spans").isNotNull(), masked(F.col("doc")[text_col], F.col("spans"))).otherwise(F.col("doc")[text_col])
    return joined.select(*[text.alias(c) if c == text_col else F.col("doc")[c].alias(c) for c in docs.columns])
