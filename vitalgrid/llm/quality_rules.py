"""Quality rules whose cutoffs carry a guarantee against rejecting good documents.

A rule rejects a document when one of its rates is above a cutoff. Labelled documents tell
how many good ones each cutoff of a fixed grid would reject, stratum by stratum. A cutoff
is certified when the exact binomial bound on its false rejections stays below the level
granted to the rule. Within a stratum and rule the grid is tested from loose to strict and
testing stops at the first failure, which needs no correction; over strata and rules the
error probability is divided (Bonferroni). A stratum with too few labels certifies nothing,
and nothing is rejected there by these rules.
"""

from __future__ import annotations

import math
from collections import Counter

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitalgrid.session import materialize

SYMBOLS = "#*$%&|<>"
SPACE = " \t\n\x0b\x0c\r"
CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Rates as (numerator, denominator) of the measures, in thousandths.
RULES = {
    "symbols": ("n_symbols", "word_chars"),
    "capitals": ("n_capitals", "word_chars"),
    "repeats": ("n_repeat_words", "n_words"),
    "lines": ("n_dup_lines", "n_lines"),
}
GRID = (20, 40, 60, 80, 100, 150, 200, 250, 300, 350, 400, 450, 500, 600, 700, 800, 900, 999)
MEASURES = ("n_words", "word_chars", "n_symbols", "n_capitals", "n_lines", "n_dup_lines", "n_repeat_words")


def measure_text(text: str) -> tuple[int, ...]:
    """The MEASURES of one text."""
    raw = text.encode()
    words = raw.split()  # of bytes: splits at ASCII white space, and only there
    lines = [line for line in text.split("\n") if line.strip(SPACE)]
    triples = list(zip(words, words[1:], words[2:]))
    counts = Counter(triples)
    repeated = 0
    if len(counts) < len(triples):
        end = 0  # words before this place are counted
        for start, triple in enumerate(triples):
            if counts[triple] > 1:
                repeated += start + 3 - max(end, start)
                end = start + 3
    return (
        len(words),
        len(text) - sum(text.count(c) for c in SPACE),
        sum(text.count(c) for c in SYMBOLS),
        len(raw) - len(raw.translate(None, CAPITALS)),
        len(lines),
        len(lines) - len(set(lines)),
        repeated,
    )


@F.arrow_udf(T.StructType([T.StructField(m, T.LongType()) for m in MEASURES]))
def measures(texts: pa.Array) -> pa.Array:
    rows = [measure_text(text or "") for text in texts.to_pylist()]
    columns = zip(*rows) if rows else [[] for _ in MEASURES]
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], list(MEASURES))


def measure(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("*",)) -> DataFrame:
    """(doc, m): the columns named in ``keep`` as a struct, and the measures of the text.

    NULL and empty texts measure 0 throughout. Packed in a struct, columns of any name pass.
    """
    return docs.select(F.struct(*keep).alias("doc"), measures(docs[text_col]).alias("m"))


def _exceeds(rule: str, cutoff: Column | int) -> Column:
    above, below = RULES[rule]
    return F.col(f"m.{above}") * 1000 > F.col(f"m.{below}") * cutoff


def base_failed() -> Column:
    return (F.col("m.n_words") < MIN_WORDS) | (F.col("m.n_repeat_words") * 100 > F.col("m.n_words") * MAX_REPEAT_PERCENT)


def certified(rejected: int, total: int, level: float, error: float) -> bool:
    """Whether the exact upper bound, at confidence ``1 - error``, on a rejection rate is at most ``level``.

    It is when so few rejections have probability ``error`` or less under a rate of ``level``
    (Clopper and Pearson): ``P(Binomial(total, level) <= rejected) <= error``.
    """
    if total == 0 or rejected >= total * level:
        return False
    log_term = math.lgamma(total + 1) - math.lgamma(rejected + 1) - math.lgamma(total - rejected + 1)
    log_term += rejected * math.log(level) + (total - rejected) * math.log1p(-level)
    ratio, share = 1.0, 1.0  # terms below the last one, as multiples of it; they shrink faster than a geometric series
    for i in range(rejected, 0, -1):
        share *= i / (total - i + 1) * (1 - level) / level
        ratio += share
        if share < 1e-17 * ratio:
            break
    return log_term + math.log(ratio) <= math.log(error)


def choose(counts: pd.DataFrame, level: float, error: float) -> int | None:
    """The cutoff of one stratum and rule, or None.

    ``counts``: (place, good, bad), the labelled documents whose rate exceeds exactly the first
    ``place`` cutoffs. Of the certified cutoffs the loosest is taken that rejects at least 99 in
    100 of the bad documents that any of them rejects.
    """
    good, bad = [0] * (len(GRID) + 1), [0] * (len(GRID) + 1)
    for place, g, b in zip(counts["place"], counts["good"], counts["bad"]):
        good[place] += int(g)
        bad[place] += int(b)
    found = []
    for k in reversed(range(len(GRID))):
        if not certified(sum(good[k + 1 :]), sum(good), level, error):
            break
        found.append((GRID[k], sum(bad[k + 1 :])))
    most = max((b for _, b in found), default=0)
    return next((cutoff for cutoff, b in found if most and b >= 0.99 * most), None)


def cutoffs(measured: DataFrame, labels: DataFrame, stratum: str, level: float = 0.02, error: float = 0.05, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """Certified cutoffs: (stratum, rule, cutoff).

    ``level``: the share of a stratum's good documents that all rules together may reject,
    ``error``: the probability that any of the guarantees fails. ``labels``: (id, label), 1 good;
    NULL ids or labels are left out, an id labelled more than once is good only if always so.
    All labelled documents count; only counts by stratum, rule and grid place leave the tasks.
    """
    marks = labels.select(labels[id_col].alias("id"), labels[label_col].alias("label")).dropna().groupBy("id").agg(F.min("label").alias("label"))
    place = lambda rule: sum((_exceeds(rule, c).cast("int") for c in GRID), F.lit(0))
    # documents that fail anyway say nothing about the rules
    known = measured.where(~base_failed()).select(F.col(f"doc.{id_col}").alias("id"), F.col(f"doc.{stratum}").alias("stratum"), F.array(*[F.struct(F.lit(r).alias("rule"), place(r).alias("place")) for r in RULES]).alias("places"))
    labelled = known.join(marks, "id")
    counts = materialize(
        labelled.select("stratum", "label", F.inline("places")).groupBy("stratum", "rule", "place").agg(F.sum((F.col("label") == 1).cast("long")).alias("good"), F.sum((F.col("label") != 1).cast("long")).alias("bad")),
        "rule-counts",
    )
    tests = max(1, counts.select("stratum", "rule").distinct().count())

    def pick(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"stratum": group["stratum"].iloc[:1], "rule": group["rule"].iloc[:1], "cutoff": [choose(group, level / len(RULES), error / tests)]}).astype({"cutoff": "Int64"})

    return counts.groupBy("stratum", "rule").applyInPandas(pick, f"stratum {dict(counts.dtypes)['stratum']}, rule string, cutoff bigint")


def judge(measured: DataFrame, chosen: DataFrame, stratum: str) -> DataFrame:
    """``measured`` with ``base_failed``, ``kept`` and ``failed_rules``, one row per row.

    A stratum without cutoffs, also a NULL one that has no labels, loses nothing to the rules.
    """
    limits = chosen.groupBy("stratum").pivot("rule", list(RULES)).agg(F.first("cutoff")).withColumnRenamed("stratum", "of")
    joined = measured.join(limits, F.col(f"doc.{stratum}").eqNullSafe(F.col("of")), "left")
    failed = F.array_compact(F.array(*[F.when(_exceeds(r, F.col(r)), F.lit(r)) for r in RULES]))
    return joined.select("doc", "m", base_failed().alias("base_failed"), failed.alias("failed_rules")).withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def keep_good(docs: DataFrame, labels: DataFrame, stratum: str = "lang", text_col: str = "text", **options) -> DataFrame:
    """The documents that pass, with the columns they came with."""
    measured = materialize(measure(docs, text_col), "rule-measures")
    return judge(measured, cutoffs(measured, labels, stratum, **options), stratum).where("kept").select("doc.*")
