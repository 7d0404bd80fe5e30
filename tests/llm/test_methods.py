"""Parts of the text operators against plain forms: many windows, many secrets, all pieces, ledgers, pairs of ids, archives, the curve."""

from __future__ import annotations

import gzip
import random
import time
from collections import Counter

import corpus_pipeline
import numpy as np
import plain
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from vitalgrid.llm import alignment, decontaminate, hard_negatives, secrets, token_counts, warc


def test_pre_tokens_of_all_pieces(spark):
    """Texts joined from all pieces of the model, each beside its like, are counted as the library counts them."""
    path = public_tokenizers.path(token_counts.MODEL)
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(n).replace(token_counts.MARK, " ") for n in range(model.get_piece_size()) if not (model.is_byte(n) or model.is_control(n) or model.is_unknown(n))]
    draw = random.Random(5)
    texts = ["".join(x * draw.choice((1, 1, 2, 3)) for x in draw.sample(pieces, 4)) for _ in range(30_000)]
    texts += [p + p for p in pieces] + ["─" * 40, "══ ══", "a" + "═" * 7 + "b"]
    cut = [token_counts.pre_tokens(t, path) for t in texts]
    terms = sorted({t for c in cut for t in c})
    counts = dict(zip(terms, token_counts.piece_counts(terms, path).tolist()))
    expected = [len(ids) for ids in model.encode(texts)]
    assert [t for t, c, n in zip(texts, cut, expected) if sum(counts[x] for x in c) != n] == []


def test_many_secrets_in_one_text(spark):
    """A hundred thousand spans of a text are found, and masked, in a time that grows with the text."""
    text = "".join(f"é {n:032x}\n" for n in range(100_000)) + "end"
    docs = spark.createDataFrame([(1, text), (2, "token=abcdefgh " * 700)], "doc_id long, text string").repartition(1)
    started = time.perf_counter()
    found = {r.doc_id: r for r in secrets.scan(docs).withColumn("n", F.size("spans")).withColumn("last", F.get("spans", F.col("n") - 1)).drop("spans").collect()}
    assert found[1].n == 100_000 and (found[1].last.start, found[1].last.end) == (99_999 * 35 + 2, 99_999 * 35 + 34)
    assert found[2].n == 700
    shorter = docs.withColumn("text", F.substring("text", 1, 20_000 * 35))
    masked = {r.doc_id: r.text for r in secrets.mask_secrets(shorter).collect()}
    assert masked[1] == "é [SECRET]\n" * 20_000 and masked[2] == "[SECRET] " * 700
    assert time.perf_counter() - started < 90


def test_masks_of_overlapping_spans(spark):
    text, spans = "abcdefghij", [(0, 2), (1, 3), (3, 4), (6, 8), (6, 7), (9, 10)]
    df = spark.createDataFrame([(text, [{"start": a, "kind": 0, "end": b} for a, b in spans])], f"t string, s {secrets.SPANS}")
    assert df.select(secrets.masked(F.col("t"), F.col("s"))).first()[0] == "[SECRET]ef[SECRET]i[SECRET]"


def test_ledger_scans_what_is_new(spark, tmp_path, monkeypatch):
    """A second run scans new blobs only, new rules all blobs again; findings reach every version of a path."""
    ledger = secrets.create_ledger(spark, str(tmp_path / "ledger"))
    docs = lambda *rows: spark.createDataFrame(list(rows), "doc_id long, text string")
    findings = lambda: Counter((r.rules, r.blob_id) for r in spark.read.parquet(f"{ledger}/findings").collect())
    secrets.record(docs((1, "token=abcdefgh"), (2, "token=abcdefgh"), (3, "clean")), ledger)
    first = findings()
    assert len(first) == 2 and set(first.values()) == {1}
    secrets.record(docs((1, "clean"), (4, "password: hunter22")), ledger)
    assert len(findings()) == 3 and set(findings().values()) == {1}
    paths = sorted((r.path, len(r.spans)) for r in secrets.findings_by_path(spark, ledger).collect())
    assert paths == [(1, 1), (2, 1), (4, 1)]  # path 1 by its earlier version
    rules = (secrets.Rule("hunt", "hunter[0-9]+"),)
    secrets.record(docs((4, "password: hunter22")), ledger, rules)
    assert Counter(r for r, _ in findings()) == {secrets.rule_version(): 3, secrets.rule_version(rules): 1}
    assert [(r.path, len(r.spans)) for r in secrets.findings_by_path(spark, ledger, rules).collect()] == [(4, 1)]


def test_ledger_is_opened_again(spark, tmp_path):
    """A ledger at a given place is begun once; opening it again keeps what it holds."""
    docs = spark.createDataFrame([(1, "token=abcdefgh"), (2, None)], "doc_id long, text string")
    path = str(tmp_path / "kept")
    first = secrets.mask_secrets(docs, secrets.open_ledger(docs, path)).collect()
    again = secrets.mask_secrets(docs, secrets.open_ledger(docs, path)).collect()
    assert sorted(first) == sorted(again) == [(1, "[SECRET]"), (2, None)]
    assert spark.read.parquet(f"{path}/findings").count() == 2


@pytest.mark.parametrize("ledger", [None, "kept"])
def test_secret_stage_keeps_its_ledger(spark, tmp_path, ledger):
    """With a ledger in the session's settings a second run of the stage scans new texts only."""
    stage = dict(corpus_pipeline.STAGES)["secret_scan"]
    docs = lambda *rows: spark.createDataFrame([(*r, len(r[1])) for r in rows], "doc_id long, text string, n_chars int")
    path = str(tmp_path / "kept")
    if ledger:
        spark.conf.set(corpus_pipeline.SECRET_LEDGER, path)
    try:
        one = stage(spark, docs((1, "token=abcdefgh"), (2, "clean")), "").collect()
        two = stage(spark, docs((1, "token=abcdefgh"), (3, "password: hunter22")), "").collect()
    finally:
        spark.conf.unset(corpus_pipeline.SECRET_LEDGER)
    assert {r.doc_id: (r.text, r.n_chars) for r in one + two} == {1: ("[SECRET]", 8), 2: ("clean", 5), 3: ("[SECRET]", 8)}
    if ledger:
        assert spark.read.parquet(f"{path}/findings").count() == 3 and spark.read.parquet(f"{path}/versions").count() == 4


WORDS = [f"w{n}" for n in range(40)]


def test_marks_find_what_the_set_finds(spark, monkeypatch):
    draw = random.Random(3)
    items = [(n, " ".join(draw.choices(WORDS, k=draw.choice((0, 3, 8, 14))))) for n in range(60)] + [(99, None)]
    rows = [(n, " ".join(draw.choices(WORDS, k=30)) + (" " + items[n % 60][1].upper() if n % 3 else "")) for n in range(80)] + [(None, None), (7, "")]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = lambda: Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.contaminated) for r in decontaminate.contamination(docs, bench).collect())
    in_set = found()
    assert in_set == Counter((i, w, h, n, c) for i, w, h, n, _, c in plain.contamination(rows, items))
    monkeypatch.setattr(decontaminate, "WHOLE_ROWS", 10)
    monkeypatch.setattr(decontaminate, "MARK_BITS", 5)  # most marks are set: the join decides
    assert found() == in_set


def test_spans_are_cut_out(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    text = f"Keep, this; {item.upper()} lambda -- and {item}. End"
    docs = spark.createDataFrame([(1, text, "x"), (2, "nothing here", "y")], "doc_id long, text string, size string")
    bench = spark.createDataFrame([(5, item + " lambda")], "item_id long, text string")
    out = {r.doc_id: r.text for r in decontaminate.decontaminate(docs, bench, remove="spans").collect()}
    assert out == {1: "Keep, this; and End", 2: "nothing here"}


def brute_alignment(text, both):
    """Groups and links by looking at every pair of tokens."""
    a, b = ([int(x) for x in side] for side in next(both.encode([text])))
    def spans(side, lengths):
        ends = np.cumsum([lengths[x] for x in side]).tolist()
        return list(zip([0, *ends], ends))
    sa, sb = spans(a, both.length_a), spans(b, both.length_b)
    links = [(x, y) for x, (s, e) in zip(a, sa) for y, (t, f) in zip(b, sb) if s < f and t < e]
    cuts = sorted({e for _, e in sa} & {e for _, e in sb})
    sides = lambda ids, at, low, high: ",".join(str(x) for x, (s, _) in zip(ids, at) if low <= s < high)
    groups = [f"{sides(a, sa, low, high)}|{sides(b, sb, low, high)}" for low, high in zip([0, *cuts], cuts)]
    return len(a), len(b), links, groups


ODD_TEXTS = [
    None, "", " ", "a", "  two  spaces\n\n\tand tabs ", "Ein Äpfelchen über naïve cafés — “quoted” … 20,000 €", "漢字かな交じり文 😀👩‍👩‍👧 café́", "<|endoftext|> and <s> </s> <0x0A> <unk>",
    "▁ a mark of the model", "x" * 3000, "\x00\x01 control \x7f \u0085   　 spaces", "word " * 500, "don't we'll I'm they've it's", "ﬁ ligature ① ½ ² ​‍",
]


def test_alignment(spark):
    paths = alignment.public_paths()
    both = alignment.load(paths)
    texts = ODD_TEXTS + [t for _, t in [(None, r[0]) for r in spark.read.parquet(f"{plain.SF_DIR}/documents.parquet").select("text").limit(40).collect()]]
    rows = [(n if n % 9 else None, t, "x") for n, t in enumerate(texts)] + [(4, texts[4], "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, pair string").repartition(3)
    brute = [brute_alignment(t, both) if t else (0, 0, [], []) for _, t, _ in rows]
    counts = Counter(link for *_, links, _ in brute for link in links)
    best = Counter()
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    import hashlib
    expected = Counter(
        (i, na, nb, len(groups), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(";".join(groups).encode()).hexdigest() if na else "")
        for (i, _, _), (na, nb, links, groups) in zip(rows, brute)
    )
    names = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    for block in (alignment.BLOCK_BYTES, 700):  # all in one block of a task, and several
        found = alignment.alignment_statistics(docs, block_bytes=block)
        assert Counter(tuple(r) for r in found.select(*names).collect()) == expected
    real = {r.doc_id: r.groups for r in alignment.alignments(docs).where("doc_id = 5").collect()}
    assert [",".join(map(str, g.a)) + "|" + ",".join(map(str, g.b)) for g in real[5]] == brute[5][3]


def test_ranks_cut_common_characters_like_the_byte_model():
    """Every character of the fast form, in front of, between and behind letters, digits, blanks and signs."""
    both = alignment.load(alignment.public_paths())
    common = [chr(c) for c in range(0x2100) if alignment.COMMON.fullmatch(chr(c))]
    assert len(common) > 350
    draw = random.Random(8)
    texts = [f"{x}{c}{y}" for c in common for x in ("", "a", " ", "7", "-", "\n") for y in ("", "b", " ", "8", ".", "\t x")]
    texts += ["".join(draw.choices(common + list("etaoin  '.,"), k=60)) for _ in range(3000)]
    full = [e.ids for e in both.full.encode_batch([" " + t for t in texts], add_special_tokens=False)]
    assert [t for t, ids in zip(texts, full) if both.fast.encode_ordinary(" " + t) != ids] == []


def test_archives(spark, tmp_path):
    """Every case of a page, written in several archives and merged in several ranges."""
    same, short = "same payload é " * 10, "short"
    rows = [(5, "http://B.example.com/x?q=1", same), (3, "https://www.a.example.org:8080/", same), (9, None, same), (None, "nonsense", same), (3, "https://www.a.example.org:8080/", same)]
    rows += [(11, "http://b.example.com/x?q=1", short), (12, "http://b.example.com/a b\r\nX: 1", short), (13, "http://[bad", None), (None, None, None), (14, "", "WARC/1.1\r\n\r\n\r\n\r\n" * 20)]
    rows += [(n, f"http://host{n % 7}.example.net/{n}", f"page {n} " * 40) for n in range(100, 160)]
    pages = spark.createDataFrame([(*r, "own") for r in rows], "page_id long, url string, html string, digest string").repartition(4)
    path = warc.write_archives(warc.captures(pages), str(tmp_path / "archives"), archive_bytes=2000)
    assert len(list((tmp_path / "archives").glob("*.gz"))) > 8
    found = warc.capture_histories(spark, path, pages.schema["page_id"].dataType, range_rows=20).collect()
    import hashlib
    expected = Counter()
    for i, _, html in rows:
        payload = (html or "").encode()
        refers = 3 if html == same and i != 3 else None
        expected[i, len(payload), hashlib.sha256(payload).hexdigest(), "revisit" if refers else "response", refers] += 1
    assert Counter((r.id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found) == expected
    order = [(r.url_key, r.date, r.id is None, str(r.id)) for r in sorted(found, key=lambda r: (r.part, r.place))]
    assert order == sorted(order) and len({r.part for r in found}) > 1
    keys = {r.id: r.url_key for r in found}
    assert (keys[5], keys[3], keys[9], keys[14]) == ("com,example,b)/x?q=1", "org,example,a)/", ")/", ")/")
    one = next(r for r in found if r.id == 14)
    data = gzip.decompress(next((tmp_path / "archives").glob(one.archive)).read_bytes())[one.start : one.start + one.length]
    assert data.startswith(b"WARC/1.1\r\n") and data.endswith(("WARC/1.1\r\n\r\n\r\n\r\n" * 20 + "\r\n\r\n").encode())


def test_damaged_payloads_are_noticed():
    headers = {"WARC-Payload-Digest": "sha256:" + "0" * 64, "WARC-Type": "response", "WARC-Record-ID": "<urn:page:1>", "WARC-Date": ""}
    with pytest.raises(ValueError, match="damaged"):
        warc.capture_of("a", 0, 9, headers, b"HTTP/1.1 200 OK\r\nContent-Length: 3\r\n\r\nabc")


@pytest.mark.parametrize("k", [0, 1, 2, 3, 7, 8, 13])
def test_loser_tree(k):
    draw = random.Random(k)
    runs = [sorted(draw.choices(range(50), k=draw.choice((0, 1, 5, 30)))) for _ in range(k)]
    assert list(warc.LoserTree([iter(r) for r in runs])) == sorted(x for r in runs for x in r)


def test_hilbert_curve_visits_neighbours():
    """Cells in the order of their keys differ by one step in one dimension, and every cell has its own key."""
    for dimensions, bits in ((1, 4), (2, 3), (3, 3), (4, 2)):
        side = 1 << bits
        cells = np.stack(np.meshgrid(*[np.arange(side)] * dimensions), -1).reshape(-1, dimensions)
        keys = hard_negatives.hilbert_keys(cells, bits)
        assert sorted(keys.tolist()) == list(range(side**dimensions))
        assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(1) == 1).all()


def brute_negatives(rows):
    whole = []
    for i, v, label in dict.fromkeys((i, None if v is None else tuple(v), label) for i, v, label in rows):
        if v and label is not None and all(x is not None and np.isfinite(x) for x in v) and len(v) == 6:
            whole.append((2**63 - 1 if i is None else i, label, [int(np.floor(256 * float(np.float32(x)))) for x in v]))
    out = Counter()
    for i, label, v in whole:
        if i % 100 or i == 2**63 - 1:
            continue
        score = lambda w: sum(x * y for x, y in zip(v, w))  # noqa: E731, B023
        ranked = sorted((-score(w), j, k) for j, k, w in whole)
        for negated, j, k in [r for r in ranked if r[2] == label and r[1] != i][:5]:
            fits = [(s, n) for s, n, m in ranked if m != label and 30 * -negated <= 100 * -s <= 90 * -negated][:10]
            for rank, (s, n) in enumerate(fits, 1):
                out[i, None if j == 2**63 - 1 else j, rank, None if n == 2**63 - 1 else n, -negated, -s] += 1
    return out


@pytest.mark.parametrize("block_rows, slice_rows", [(256, 65_536), (7, 3)])
def test_hard_negatives(spark, block_rows, slice_rows):
    """Ties, repeated rows, vectors of another length and every kind of row without part, in one block and slice, and in many."""
    draw = np.random.default_rng(2)
    rows = [(int(n), [round(float(x), 1) for x in draw.normal(size=6) * 0.2 + (n % 3 == np.arange(6) % 3) * 0.5], int(n % 3)) for n in range(0, 1500, 5)]
    rows += rows[:40] + [(200, [0.5] * 6, 1), (None, [0.5] * 6, 0), (None, [0.5] * 6, 1), (3, None, 1), (4, [0.5] * 6, None), (6, [], 1), (7, [0.5] * 5 + [None], 1)]
    rows += [(8, [float("nan")] * 6, 1), (9, [float("inf")] * 6, 1), (300, [0.1] * 5, 1), (2000, [-0.5] * 6, 9)]
    table = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, key string").repartition(3)
    found = hard_negatives.mine(hard_negatives.whole_vectors(table), block_rows=block_rows, slice_rows=slice_rows)
    assert Counter(tuple(r) for r in found.collect()) == brute_negatives(rows)


def test_zone_maps_bound_all_scores():
    draw = np.random.default_rng(1)
    anchors, block = draw.integers(-300, 300, (20, 8)), draw.integers(-300, 300, (50, 8))
    least, greatest = hard_negatives.score_bounds(anchors, block.min(0), block.max(0))
    scores = anchors @ block.T
    assert (least <= scores.min(1)).all() and (scores.max(1) <= greatest).all()
    narrow = block // 100  # a tight block far from the windows of all anchors is not read
    wanted = hard_negatives.Anchors(np.arange(20), np.zeros(20), anchors, np.full((20, 1), 10**9), np.full((20, 1), 10**9))
    class Unread(hard_negatives.Block):
        def vectors(self):
            raise AssertionError("read")
    of = Unread(np.arange(50), np.ones(50), narrow.min(0), narrow.max(0), None)
    assert len(hard_negatives.best_negatives(wanted, iter([of]), 10).unit) == 0
