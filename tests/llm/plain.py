"""The operators in plain Python, text by text and pair by pair."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import xxhash

SF_DIR = "/root/testdata/sf0.001"
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
SECRETS = (
    ("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
)


def fold(doc_id, parts):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % parts


def spaced(text):
    return SPACED.findall(text or "")


def alnum(text):
    return ALNUM.findall((text or "").translate(LOWER))


def measures(text):
    text = text or ""
    words = spaced(text)
    triples = Counter(zip(words, words[1:], words[2:]))
    repeated = {i + k for i in range(len(words) - 2) if triples[tuple(words[i : i + 3])] > 1 for k in range(3)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if SPACED.search(line):
            again += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(repeated)


def licenses(text):
    words, starts, labels = alnum(text), [], set()
    for phrase, label in PHRASES.items():
        of = phrase.split()
        for i in range(len(words) - len(of) + 1):
            if words[i : i + len(of)] == of:
                starts.append(i)
                labels.add(label)
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def unigram(rows, parts=7, held_out=2):
    counts = Counter()
    tokens = [(i, [w for w in spaced((t or "").translate(LOWER))] + [None]) for i, t in rows]
    for i, words in tokens:
        if fold(i, parts) != held_out:
            counts.update(words)
    total, distinct = sum(counts.values()), len(counts)
    for i, words in tokens:
        score = sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in words)
        yield i, fold(i, parts) == held_out, len(words), sum(counts[w] > 0 for w in words), total, score


def contamination(rows, items, window=10):
    of = defaultdict(set)
    for item, text in items:
        words = alnum(text)
        size = min(window, len(words))
        for i in range(len(words) - size + 1 if words else 0):
            of[tuple(words[i : i + size])].add(item)
    for i, text in rows:
        words, hit, found = alnum(text), set(), set()
        for size in range(1, window + 1):
            for at in range(len(words) - size + 1):
                if tuple(words[at : at + size]) in of:
                    hit |= set(range(at, at + size))
                    found |= of[tuple(words[at : at + size])]
        ids = sorted(str(x) for x in found if x is not None)
        yield i, len(words), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)


def secrets(text):
    spans = []
    for number, (kind, pattern, group, least) in enumerate(SECRETS):
        spans += [(m.start(), number, kind, m.end()) for m in pattern.finditer(text or "") if len(m[group]) >= least]
    spans.sort()
    digest = hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, _, k, e in spans).encode()).hexdigest()
    return (*(sum(k == n for _, k, _, _ in spans) for n in range(3)), digest)


def fingerprint(text):
    words = spaced((text or "").translate(LOWER))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints, radius=3):
    """For each fingerprint the set of those it is linked with, directly or not."""
    distinct = sorted(set(prints))
    leader = {p: p for p in distinct}

    def find(p):
        while leader[p] != p:
            p = leader[p]
        return p

    for n, a in enumerate(distinct):
        for b in distinct[n + 1 :]:
            if (a ^ b).bit_count() <= radius:
                x, y = sorted((find(a), find(b)))
                leader[y] = x
    return {p: find(p) for p in distinct}
