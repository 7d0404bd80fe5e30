"""Verdicts and scores of the text operators against sums, loops and enumerations."""

from __future__ import annotations

import itertools
import math
import random
from fractions import Fraction

import numpy as np
import plain
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vitalgrid.llm import blocks, lattice_lm, licenses, quality_rules, simhash


def binomial_tail(k, n, p):
    """P(Binomial(n, p) <= k), exactly."""
    p = Fraction(p).limit_denominator(10**6)
    return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))


@pytest.mark.parametrize("level, error", [(0.005, 0.05 / 16), (0.02, 0.05), (0.1, 0.01)])
def test_certified_is_the_exact_binomial_bound(level, error):
    for total in (0, 1, 50, 150, 400, 1500):
        last = True
        for rejected in range(0, min(total, int(2 * total * level) + 2) + 1):
            expected = total > 0 and binomial_tail(rejected, total, level) <= Fraction(error)
            assert quality_rules.certified(rejected, total, level, error) == expected
            assert last or not expected  # more rejections are never easier to certify
            last = expected


def test_cutoffs_are_certified_and_reject(spark):
    """A stratum with enough labels gets the loosest cutoff that does the work; one with few gets none."""
    good = "plain words of several kinds stand here number {} and " + " ".join(f"w{n}" for n in range(60))
    bad = good + " ".join(f" #$%&|{n}" for n in range(40))  # symbols, but no repeated words
    rows = [(n, (bad if n % 5 == 0 else good).format(n), "en", int(n % 5 != 0)) for n in range(3000)]
    rows += [(10_000 + n, (bad if n % 2 else good).format(n), "de", int(n % 2 == 0)) for n in range(40)]
    rows += [(20_000, bad, "en", None), (20_001, bad, "de", None), (20_002, bad, None, None), (20_003, good, "en", None), (20_004, None, "en", 1)]
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, quality int")
    measured = quality_rules.measure(docs, keep=("doc_id", "lang"))
    chosen = {(r.stratum, r.rule): r.cutoff for r in quality_rules.cutoffs(measured, labels, "lang").collect()}
    assert [k for k, cutoff in chosen.items() if cutoff is not None] == [("en", "symbols")]
    # the same by looking at every document
    rate = lambda text: Fraction(1000 * plain.measures(text)[2], plain.measures(text)[1])
    of = {kind: [rate(r[1]) for r in rows if r[2] == "en" and r[3] == kind and r[1]] for kind in (0, 1)}
    tests, found = len(chosen), []
    for cutoff in reversed(quality_rules.GRID):
        if binomial_tail(sum(x > cutoff for x in of[1]), len(of[1]), 0.02 / 4) > Fraction(0.05 / tests):
            break
        found.append((cutoff, sum(x > cutoff for x in of[0])))
    most = max(n for _, n in found)
    assert most == len(of[0]) and chosen["en", "symbols"] == next(c for c, n in found if n >= 0.99 * most)
    kept = {r.doc_id for r in quality_rules.keep_good(docs, labels).select("doc_id").collect()}
    assert kept == {r[0] for r in rows if r[1] and (r[2] != "en" or rate(r[1]) <= chosen["en", "symbols"])}


def test_lattice_sums_all_segmentations():
    path = public_tokenizers.path(lattice_lm.MODEL)
    ids, _ = lattice_lm.vocabulary(path)
    model = lattice_lm.load(path)
    draw = np.random.default_rng(4)
    scores = np.log(draw.dirichlet(np.ones(model.get_piece_size())))
    lattice = lattice_lm.Lattice(scores, path)

    def enumerated(word):
        """The sum over every way to set borders; a character that is no piece is its bytes."""
        total = 0.0
        for cuts in itertools.product((False, True), repeat=len(word) - 1):
            places = [0, *[n + 1 for n, cut in enumerate(cuts) if cut], len(word)]
            log = 0.0
            for piece in (word[a:b] for a, b in zip(places, places[1:])):
                if piece in ids:
                    log += scores[ids[piece]]
                elif len(piece) == 1:
                    log += sum(scores[model.piece_to_id(f"<0x{b:02X}>")] for b in piece.encode())
                else:
                    log = -math.inf
            total += math.exp(log)
        return math.log(total)

    words = ["a", "the", "tokens", "statement", "über", "x̧y", "日本語", "😀ok", "aaaaaaaa", "--=="]
    assert lattice.log_probabilities(words) == pytest.approx([enumerated(lattice_lm.MARK + w) for w in words], rel=1e-9)


@pytest.mark.parametrize(
    "text, labels, permissive",
    [
        ("SPDX-License-Identifier: MIT", "mit", True),
        ("SPDX-License-Identifier: GPL-2.0 OR MIT", "gpl,mit", True),
        ("SPDX-License-Identifier: GPL-2.0 AND MIT", "gpl,mit", False),
        ("spdx: MIT OR GPL-2.0 AND AGPL-3.0", "agpl,gpl,mit", True),  # AND binds closer
        ("spdx: (MIT OR GPL-2.0) AND AGPL-3.0", "agpl,gpl,mit", False),
        ("spdx: GPL-2.0 WITH Classpath-exception-2.0 AND MIT", "gpl,mit", True),
        ("spdx: GPL-2.0 WITH Other-exception", "gpl", False),
        ("spdx: ((MIT", "mit", True),
        ("SPDX-License-Identifier: Foo-1.0", "other:foo-1.0", False),
        ("SPDX-License-Identifier: LicenseRef-house", "other:licenseref-house", False),
        ("see spdx: the list of names", "", None),
        ("see spdx: these mitigations", "", None),
        ("notspdx: MIT is a school", "", None),
        ("spdx: ", "", None),
    ],
)
def test_expressions(text, labels, permissive):
    found = dict(zip(licenses.FIELDS, licenses.scan_text(text)))
    assert (found["labels"], found["permissive"]) == (labels, permissive)


def brute_links(values, radius=3):
    near = [(i, j) for i, j in itertools.combinations(range(len(values)), 2) if (int(values[i]) ^ int(values[j])).bit_count() <= radius]
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in near:
        root[find(i)] = find(j)
    return {frozenset(int(values[k]) for k in range(len(values)) if find(k) == find(i)) for i in range(len(values))}


def near_values(draw, families, size):
    values = set()
    for _ in range(families):
        base = draw.getrandbits(64)
        for _ in range(size):
            values.add(base ^ sum(1 << b for b in draw.sample(range(64), draw.choice((0, 1, 2, 3, 4, 6)))))
    return np.array(sorted(values), np.uint64)


@pytest.mark.parametrize("block", [1024, 7])
def test_buckets_of_several_blocks(spark, block):
    """Buckets above the block size are compared block by block and lose no link."""
    values = near_values(random.Random(9), 12, 40)
    fps = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long")
    stars = simhash.star_components(simhash.link(fps, block)).collect()
    groups = {}
    for r in stars:
        groups.setdefault(r.root, {r.root}).add(r.node)
    found = {frozenset(int(np.int64(x).view(np.uint64)) for x in g) for g in groups.values()}
    assert found == {g for g in brute_links(values) if len(g) > 1}


def test_groups_across_batches():
    """A group that several Arrow batches hold a part of gives the edges it gives in one."""
    draw = random.Random(2)
    values = near_values(draw, 4, 60).view(np.int64)
    rows = sorted((n % 3, 0, 0, 0, int(v)) for n, v in enumerate(values))
    columns = [pa.array(c, pa.int64()) for c in zip(*rows)]
    whole = pa.RecordBatch.from_arrays(columns, ["bucket", "i", "j", "side", "fp"])
    edges = lambda batches: sorted((n, r) for b in simhash.compare_groups(iter(batches)) for n, r in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
    expected = edges([whole])
    assert expected
    for step in (1, 7, 64):
        assert edges([whole.slice(start, step) for start in range(0, whole.num_rows, step)]) == expected


def test_several_blocks_of_texts(spark):
    """Sums over terms do not depend on how many blocks the documents fill."""
    draw = random.Random(6)
    texts = [" ".join(draw.choices(["alpha", "beta", "gamma", "delta", "ß"], k=draw.choice((0, 3, 40)))) for _ in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    expected = sorted((i, len(t.split()) + 1, sum(len(w.encode()) for w in t.split())) for i, t in enumerate(texts))
    for size in (1 << 24, 300):
        documents, dictionaries = blocks.blocks_of(docs, lattice_lm.words_and_end, F.lit(True), block_bytes=size)
        values = dictionaries.select("block", "place", F.octet_length("term").cast("double").alias("x"))
        assert (documents.count() > 3) == (size == 300)
        summed = blocks.sum_over_terms(documents, values, ["x"])
        assert sorted((r.doc_id, r.n_terms, r.x) for r in summed.collect()) == expected
