"""Benchmark decontamination: windows of test words found in training texts.

The windows of the test items form a hash set, which is broadcast while it is small. A larger
one is broadcast as marks: each hash sets a bit in a table of bounded size, and windows of
texts whose bit is set are joined with the test windows by hash. Either way texts are read and
cut into words once; each window is hashed and looked up, a hit is verified word by word
against the test window, and what leaves the scan is one row per document and one per
verified hit. Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalgrid.functions.arrays import bind
from vitalgrid.llm.common import ascii_lower
from vitalgrid.session import materialize

WINDOW = 10
#: Largest set of test windows that is broadcast whole, in rows and in bytes of text.
WHOLE_ROWS, WHOLE_BYTES = 200_000, 24 << 20
#: Bits of a hash that choose a row of the marks, at most 2**21 rows of 64 marks each.
MARK_BITS = 21
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same before lower-casing, and words as they stand in the text.
BETWEEN_RAW_WORDS, RAW_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN_WORDS), "")


def item_windows(items: DataFrame, window: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, length, words): all windows of each item; an item of fewer words is one window."""
    cut = items.select(items[id_col].cast("string").alias("item_id"), words_of(items[text_col]).alias("all")).where(F.size("all") > 0)
    length = F.least(F.size("all"), F.lit(window))
    placed = cut.select("item_id", "all", length.alias("length"), F.explode(F.sequence(F.lit(1), F.size("all") - length + 1)).alias("at"))
    return placed.select("item_id", "length", F.slice("all", F.col("at"), F.col("length")).alias("words"))


def row_key(text: Column) -> list[Column]:
    """With the id, stands for a row: rows equal in id and text have equal results."""
    return [F.xxhash64(text).alias("hash"), F.octet_length(text).alias("bytes")]


KEY = ["doc_id", "hash", "bytes"]


def same_key(left: DataFrame, right: DataFrame) -> Column:
    return left["doc_id"].eqNullSafe(right["doc_id"]) & (left["hash"] == right["hash"]) & (left["bytes"] == right["bytes"])


def scan(docs: DataFrame, windows: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, hash, bytes, n_words, at, length, window): stored.

    One row with ``at = 0`` for every row of ``docs``, and one for every verified occurrence
    of a window, which starts at word ``at`` (from 1). ``windows``: (window, length, words).
    """
    size = windows.agg(F.count("*"), F.coalesce(F.sum(F.length(F.array_join("words", " "))), F.lit(0)), F.collect_set("length")).first()
    lengths = sorted(size[2]) or [WINDOW]  # at most WINDOW different ones
    text = F.coalesce(docs[text_col], F.lit(""))
    cut = docs.select(docs[id_col].alias("doc_id"), *row_key(text), words_of(text).alias("words"))
    # outer: an inner one would add a filter below, which cuts the words a second time
    placed = cut.select("*", F.explode_outer(F.sequence(F.lit(0), F.size("words"))).alias("at"))
    if len(lengths) > 1:
        placed = placed.select("*", F.explode_outer(F.when(F.col("at") > 0, F.array(*map(F.lit, lengths))).otherwise(F.array(F.lit(lengths[0])))).alias("length"))
    else:
        placed = placed.withColumn("length", F.lit(lengths[0]))
    whole = F.col("at") + F.col("length") - 1 <= F.size("words")
    here = F.slice("words", F.greatest("at", F.lit(1)), F.col("length"))
    looked_up = placed.withColumn("code", F.when(F.col("at") == 0, F.lit(0).cast("long")).when(whole, F.xxhash64(here)))
    # stored: a filter on a computed code would be carried over to every window of every text
    coded = materialize(windows.select("window", F.col("length").alias("window_length"), F.col("words").alias("window_words"), F.xxhash64("words").alias("window_code")), "window-codes")
    if size[0] <= WHOLE_ROWS and size[1] <= WHOLE_BYTES:
        return _hits_in_set(looked_up, here, coded)
    return _hits_by_marks(looked_up, here, coded)


def _hits_in_set(looked_up: DataFrame, here: Column, coded: DataFrame) -> DataFrame:
    """Hits among all windows, the test windows broadcast."""
    none = looked_up.sparkSession.sql("select cast(null as string) as window, 0 as window_length, cast(array() as array<string>) as window_words, 0L as window_code")
    is_row = (F.col("at") == 0) & (F.col("window_length") == 0)
    is_hit = (F.col("at") > 0) & (F.col("window_length") == F.col("length")) & (here == F.col("window_words"))
    hits = looked_up.join(F.broadcast(coded.unionByName(none)), (F.col("code") == F.col("window_code")) & (is_row | is_hit))
    return materialize(hits.select(*KEY, F.size("words").cast("long").alias("n_words"), "at", F.col("window_length").alias("length"), "window"), "window-hits")


def _hits_by_marks(looked_up: DataFrame, here: Column, coded: DataFrame) -> DataFrame:
    """The same for any number of test windows: marks of their hashes are broadcast, and what has
    its mark set meets the test windows in a shuffled join, whose frequent windows adaptive
    execution divides."""
    slot = lambda code: F.shiftrightunsigned(code, 64 - MARK_BITS)
    bit = lambda code: F.expr(f"shiftleft(1L, cast({code} & 63 as int))")
    marks = materialize(coded.groupBy(slot(F.col("window_code")).alias("slot")).agg(F.bit_or(bit("window_code")).alias("marks")), "window-marks")
    rows = looked_up.sparkSession.sql("select -1L as slot, -1L as marks")  # for the row of each document
    known = F.broadcast(marks.unionByName(rows))
    at_slot = F.when(F.col("at") == 0, F.lit(-1).cast("long")).otherwise(slot(F.col("code")))
    marked = looked_up.join(known, (at_slot == F.col("slot")) & (bit("code").bitwiseAND(F.col("marks")) != 0))
    words = F.when(F.col("at") > 0, here)
    found = materialize(marked.select(*KEY, F.size("words").cast("long").alias("n_words"), "at", "length", "code", words.alias("here")), "marked-windows")
    same = (F.col("code") == F.col("window_code")) & (F.col("length") == F.col("window_length")) & (F.col("here") == F.col("window_words"))
    columns = (*KEY, "n_words", "at", "length", "window")
    hits = found.where("at > 0").join(coded, same).select(*columns)
    of_rows = found.where("at = 0").withColumns({"length": F.lit(0), "window": F.lit(None).cast("string")}).select(*columns)
    return materialize(of_rows.unionByName(hits), "window-hits")


def named_windows(items: DataFrame, window: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Distinct windows (window, length, words) named by their digest, and (window, item_id); both stored."""
    all_of = item_windows(items, window, id_col, text_col).withColumn("window", F.md5(F.array_join("words", " ").cast("binary")))
    pairs = materialize(all_of.select("window", "length", "words", "item_id").distinct(), "windows")
    return pairs.select("window", "length", "words").distinct(), pairs.select("window", "item_id").distinct()


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, hash, bytes, n_words, spans, n_hit, items, n_items, contaminated), one row per row of ``docs``.

    ``spans``: (at, length) of the occurrences, ``n_hit`` the words inside any of them,
    ``items`` the sorted ids, as texts, of the items with an occurring window. NULL, empty and
    blank texts have no words, on either side; items of one id count once and NULL ids not at
    all, though their windows hit. Repeated rows and NULL document ids are rows like others;
    other columns are not read. Without items nothing is contaminated.
    """
    windows, of_items = named_windows(items, window)
    found = scan(docs, windows, id_col, text_col)
    hits = found.where("at > 0")
    spans = hits.groupBy(KEY).agg(F.collect_set(F.struct("at", "length")).alias("spans"))
    names = hits.select(*KEY, "window").distinct().join(of_items, "window").groupBy(KEY).agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    marked = materialize(spans.join(names, same_key(spans, names), "left").select(*[spans[k] for k in KEY], "spans", "items"), "contaminated")
    rows = found.where("at = 0").select(*KEY, "n_words")
    joined = rows.join(marked, same_key(rows, marked), "left").select(*[rows[k] for k in KEY], "n_words", "spans", F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    inside = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["at"], s["at"] + s["length"] - 1))))
    n_hit = F.coalesce(F.when(F.col("spans").isNotNull(), F.size(inside)), F.lit(0)).cast("long")
    return joined.withColumns({"n_hit": n_hit, "n_items": F.size("items").cast("long")}).withColumn("contaminated", F.col("n_hit") > 0)


def without_spans(text: Column, spans: Column) -> Column:
    """The text without the words of ``spans`` and what stands behind each of them."""
    words = F.array_remove(F.split(text, BETWEEN_RAW_WORDS), "")
    between = F.split(text, RAW_WORD, -1)
    inside = F.flatten(F.transform(spans, lambda s: F.sequence(s["at"], s["at"] + s["length"] - 1)))
    stay = F.array_except(F.sequence(F.lit(1), F.size(words)), inside)  # in order
    kept = bind(words, lambda w: bind(between, lambda b: F.concat(F.get(b, F.lit(0)), F.array_join(F.transform(stay, lambda i: F.concat(F.get(w, i - 1), F.get(b, i))), ""))))
    return kept


def decontaminate(docs: DataFrame, items: DataFrame, remove: str = "documents", window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with its columns, without contaminated documents or (``remove="spans"``) without the hit words."""
    found = contamination(docs, items, window, id_col, text_col).where("contaminated").select(*KEY, "spans").dropDuplicates(KEY)
    text = F.coalesce(docs[text_col], F.lit(""))
    keyed = docs.select(F.struct("*").alias("doc"), docs[id_col].alias("doc_id"), *row_key(text))
    if remove == "documents":
        return keyed.join(found, same_key(keyed, found), "left_anti").select("doc.*")
    joined = keyed.join(found, same_key(keyed, found), "left")
    cleaned = F.when(F.col("spans").isNotNull(), without_spans(F.col(f"doc.{text_col}"), F.col("spans"))).otherwise(F.col(f"doc.{text_col}"))
    return joined.select(*[cleaned.alias(c) if c == text_col else F.col("doc")[c].alias(c) for c in docs.columns])
