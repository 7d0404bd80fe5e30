"""Every query over the awkward folder against plain Python, over given tables against DuckDB, over empty ones."""

from __future__ import annotations

from collections import Counter, defaultdict

import duckdb
import plain
import public_tokenizers
import pytest
import sentencepiece
from compare import connect, differences
from plain import SF_DIR

import __spark_entry__ as entry
import corpus_pipeline
from vitalgrid.llm import queries

QUERIES, SQL = queries.QUERIES, queries.SQL


def got(spark, name, folder, *columns):
    return Counter(tuple(r) for r in QUERIES[name](spark, folder).select(*columns).collect())


def number(name):
    return int(name[2:].split("_")[0])


#: What names a row of the queries that are not about documents.
KEYS = {12: "page_id", 13: "anchor_id"}


def test_every_query_is_registered():
    assert {number(n) for n in QUERIES} == set(range(1, 14))
    assert set(entry.queries()) >= set(QUERIES) | {"pipeline"}
    assert set(entry.oracle_sql()) >= set(SQL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name):
    assert differences(QUERIES[name](spark, SF_DIR), connect(SF_DIR), SQL[name]) == []


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty, name):
    frame = QUERIES[name](spark, empty)
    assert frame.count() == 0 and KEYS.get(number(name), "doc_id") in frame.columns


@pytest.mark.parametrize("name", ["op12_warc", "op13_hard_negatives"])
def test_awkward_pages_and_vectors(spark, awkward, name):
    assert differences(QUERIES[name](spark, awkward), connect(awkward), SQL[name]) == []


def test_one_row_for_each_row(spark, awkward, rows):
    for name in QUERIES:
        if number(name) in KEYS:
            continue
        assert Counter(r["doc_id"] for r in QUERIES[name](spark, awkward).select("doc_id").collect()) == Counter(r[0] for r in rows), name


def test_mix(spark, awkward, rows):
    assert differences(QUERIES["op1_mix_sources"](spark, awkward), connect(awkward), SQL["op1_mix_sources"]) == []
    frame = QUERIES["op1_mix_sources"](spark, awkward).collect()
    sizes = Counter()
    for _, text, _, source in rows:
        sizes[source] += len(plain.spaced(text))
    assert sum(r["size"] for r in frame) == sum(sizes.values())
    assert all(r["taken"] <= 3 * r["size"] and r["target"] <= 3 * r["source_size"] for r in frame)
    # filled round by round: what is above its limit is cut, the excess goes to the others by weight
    order = sorted(s for s in sizes if s is not None) + [None]
    weight = {s: (5, 2, 1)[n % 3] for n, s in enumerate(order)}
    target, capped = {}, set()
    while True:
        left = sum(sizes.values()) - sum(3 * sizes[s] for s in capped)
        free = sum(weight[s] for s in order if s not in capped)
        target = {s: 3 * sizes[s] if s in capped else left * weight[s] / free for s in order}
        above = {s for s in order if target[s] > 3 * sizes[s]}
        if not above:
            break
        capped |= above
    assert {round(r["target"], 3) for r in frame} == {round(t, 3) for s, t in target.items()}


def test_quality_rules(spark, awkward, rows):
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    expected = Counter()
    for doc_id, text, _, _ in rows:
        m = plain.measures(text)
        expected[(doc_id, *m, m[0] < 50 or 100 * m[4] > 50 * m[0])] += 1
    assert got(spark, "op4_quality_rules", awkward, *columns) == expected
    assert not [r for r in QUERIES["op4_quality_rules"](spark, awkward).collect() if r["kept"] and r["base_failed"]]


def test_licenses(spark, awkward, rows):
    found = got(spark, "op5_license_scan", awkward, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    assert found == Counter((i, *plain.licenses(t)) for i, t, _, _ in rows)
    more = {r["doc_id"]: r for r in QUERIES["op5_license_scan"](spark, awkward).where("doc_id >= 9000").collect()}
    assert (more[9011]["labels"], more[9011]["permissive"]) == ("apache,cc0,gpl,mit", True)
    assert all(0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) for r in more.values())


def test_token_counts(spark, awkward, rows):
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    expected = Counter()
    for doc_id, text, _, _ in rows:
        n = len(model.encode(text or ""))
        expected[(doc_id, len((text or "").encode()), n, n > 4096)] += 1
    assert got(spark, "op6_token_counts", awkward, "doc_id", "n_bytes", "n_tokens", "over_limit") == expected


def test_language_model(spark, awkward, rows):
    names = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens")
    expected = list(plain.unigram([(i, t) for i, t, _, _ in rows]))
    assert got(spark, "op7_lattice_scores", awkward, *names) == Counter(e[:5] for e in expected)
    frame = QUERIES["op7_lattice_scores"](spark, awkward).collect()
    key = lambda r: (str(r[0]), r[2], r[5])
    base = [(r["doc_id"], r["held_out"], r["n_tokens"], 0, 0, r["base_score"]) for r in frame]
    for a, b in zip(sorted(base, key=key), sorted(expected, key=key)):
        assert a[5] == pytest.approx(b[5], rel=1e-9)
    assert all(r["score"] < 0 for r in frame)


def test_decontamination(spark, awkward, rows):
    items = duckdb.sql(f"select item_id, text from '{awkward}/benchmark.parquet'").fetchall()
    names = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert got(spark, "op8_decontaminate", awkward, *names) == Counter(plain.contamination([(i, t) for i, t, _, _ in rows], items))


def test_secrets(spark, awkward, rows):
    found = got(spark, "op9_secret_scan", awkward, "doc_id", "n_assign", "n_access", "n_hex", "base_sha256")
    assert found == Counter((i, *plain.secrets(t)) for i, t, _, _ in rows)
    assert differences(QUERIES["op9_secret_scan"](spark, awkward), connect(awkward), SQL["op9_secret_scan"]) == []


def near_duplicates(rows):
    prints = [plain.fingerprint(t) for _, t, _, _ in rows]
    root = plain.components(prints)
    low = defaultdict(lambda: None)
    for (doc_id, *_), p in zip(rows, prints):
        if doc_id is not None and (low[root[p]] is None or doc_id < low[root[p]]):
            low[root[p]] = doc_id
    return [(doc_id, f"{p:016x}", low[root[p]]) for (doc_id, *_), p in zip(rows, prints)]


def test_simhash(spark, awkward, rows):
    assert got(spark, "op10_simhash_near_duplicates", awkward, "doc_id", "fingerprint", "component_id") == Counter(near_duplicates(rows))


@pytest.mark.parametrize("name, label, parts, held_out", [("op2_toxicity", "toxic", 3, 1), ("op3_quality_votes", "quality", 4, 2)])
def test_classifiers(spark, awkward, rows, name, label, parts, held_out):
    frame = QUERIES[name](spark, awkward).collect()
    assert Counter((r["doc_id"], r["held_out"]) for r in frame) == Counter((i, plain.fold(i, parts) == held_out) for i, *_ in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in frame)
    by_id = defaultdict(set)
    for r in frame:
        if r["doc_id"] in (9001, 9002, 9003):
            by_id["blank"].add(r["score"])
    assert len(by_id["blank"]) == 1


@pytest.mark.parametrize("name, label, recall, clean", [("op2_toxicity", "toxic", 0.65, 0.96), ("op3_quality_votes", "quality", 0.97, 0.9)])
def test_held_out_accuracy(spark, name, label, recall, clean):
    folder = "/root/testdata/sf0.1"
    labels = dict(duckdb.sql(f"select doc_id, {label} from '{folder}/labels.parquet'").fetchall())
    seen = Counter((labels[r["doc_id"]], r["predicted"]) for r in QUERIES[name](spark, folder).where("held_out").collect() if r["doc_id"] in labels)
    assert seen[1, 1] >= recall * (seen[1, 1] + seen[1, 0]) and seen[0, 0] >= clean * (seen[0, 0] + seen[0, 1])


def test_native_queries_run_no_python(spark, capsys):
    for name in ("op1_mix_sources", "op8_decontaminate", "op9_secret_scan"):
        QUERIES[name](spark, SF_DIR).explain()
        assert not {"Python", "Pandas", "Arrow"} & set(capsys.readouterr().out.replace("Eval", " ").split())


def test_pipeline(spark, awkward, rows):
    """Stage by stage, each against plain Python on its own input."""
    read = lambda df: Counter((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect())
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "simhash_near_dedup", "decontamination", "secret_scan", "mixing"]
    stage = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{awkward}/documents.parquet")
    good = stage["quality_rules"](spark, docs, awkward)
    assert good.columns == docs.columns
    kept = Counter({k: v for k, v in read(good).items()})
    base = lambda t: (m := plain.measures(t))[0] >= 50 and 100 * m[4] <= 50 * m[0]
    assert kept == Counter((i, t) for i, t, _, _ in rows if base(t))  # so few labels certify no cutoff

    one = stage["simhash_near_dedup"](spark, docs, awkward)
    groups = near_duplicates(rows)
    root = plain.components([int(p, 16) for _, p, _ in groups])
    first = {}
    for (doc_id, p, _), (_, text, _, _) in zip(groups, rows):
        place = (doc_id is None, doc_id or 0)
        first[root[int(p, 16)]] = min(first.get(root[int(p, 16)], place), place)
    assert one.columns == docs.columns
    assert sorted((i is None, i or 0) for i, _ in read(one).elements()) == sorted(first.values())

    items = duckdb.sql(f"select item_id, text from '{awkward}/benchmark.parquet'").fetchall()
    clean = stage["decontamination"](spark, docs, awkward)
    hit = [c[-1] for c in plain.contamination([(i, t) for i, t, _, _ in rows], items)]
    assert clean.columns == docs.columns and read(clean) == Counter((i, t) for (i, t, _, _), h in zip(rows, hit) if not h)

    masked = stage["secret_scan"](spark, docs, awkward)
    assert masked.columns == docs.columns
    texts = read(masked)
    assert Counter(i for i, _ in texts.elements()) == Counter(i for i, *_ in rows)
    assert not [t for _, t in texts if plain.secrets(t)[:3] != (0, 0, 0)]
    assert all((i, t) in texts for i, t, _, _ in rows if "@" not in (t or "") and plain.secrets(t)[:3] == (0, 0, 0) and "BEGIN" not in (t or ""))

    mixed = stage["mixing"](spark, docs, awkward)
    whole = {(r["doc_id"], r["size"], r["taken"]) for r in QUERIES["op1_mix_sources"](spark, awkward).collect()}
    assert {(r["doc_id"], r["size"], r["taken"]) for r in mixed.collect()} <= whole
    assert corpus_pipeline.run(spark, awkward).columns == mixed.columns


def test_pipeline_of_nothing(spark, empty):
    assert corpus_pipeline.run(spark, empty).count() == 0
