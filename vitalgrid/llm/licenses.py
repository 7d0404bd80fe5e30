"""License scan: Aho-Corasick for tags and notices, a shunting-yard for expressions.

One automaton walks over the words of a text and finds every notice phrase, another walks
over the raw text and finds identifier tags. Behind a tag stands an expression such as
``(MIT OR Apache-2.0) AND GPL-2.0 WITH Classpath-exception-2.0``; it is put into postfix
order by operator precedence and evaluated to the licences it names and to whether it can be
satisfied with permissive ones. Everything is per document; nothing is shuffled.
"""

from __future__ import annotations

import re
from functools import lru_cache
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The phrases every scan has, then those of this scan.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
MORE_PHRASES = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "isc license": "isc",
    "boost software license": "bsl",
    "permission is hereby granted free of charge": "mit",
    "creative commons attribution": "cc-by",
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc0": "cc0",
    "public domain": "public-domain",
    "the unlicense": "unlicense",
    "all rights reserved": "proprietary",
}
TAGS = ("spdx-license-identifier:", "license-expression:", "spdx:")
#: Beginnings of identifiers, longest first where one begins another, with their label.
IDENTIFIERS = {
    "apache": "apache", "agpl": "agpl", "lgpl": "lgpl", "gpl": "gpl", "mit": "mit", "bsd": "bsd", "0bsd": "bsd", "isc": "isc", "mpl": "mpl",
    "epl": "epl", "bsl": "bsl", "cc0": "cc0", "cc-by-nc": "cc-by-nc", "cc-by-sa": "cc-by-sa", "cc-by-nd": "cc-by-nd", "cc-by": "cc-by",
    "unlicense": "unlicense", "zlib": "zlib", "wtfpl": "wtfpl", "python": "psf", "psf": "psf", "artistic": "artistic",
}
PERMISSIVE = frozenset({"apache", "mit", "bsd", "isc", "bsl", "cc0", "cc-by", "public-domain", "unlicense", "zlib", "wtfpl", "psf"})
#: Exceptions that let a copyleft licence be combined with others.
EXCEPTIONS = ("classpath-exception", "llvm-exception", "gcc-exception", "openjdk-assembly-exception", "linux-syscall-note", "font-exception", "linking-exception")
WEIGHT_TAG, WEIGHT_BASE, WEIGHT_MORE = 0.95, 0.8, 0.6

_SEPARATORS = bytes(b for b in range(128) if not (chr(b).isalnum()))
#: Byte for byte: A-Z to lower case, other ASCII outside words to a space. Bytes above 127 are word characters.
WORD_BYTES = bytes.maketrans(_SEPARATORS + bytes(range(65, 91)), b" " * len(_SEPARATORS) + bytes(range(97, 123)))
LOWER_BYTES = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
TOKEN = re.compile(r"[ \t]*(\(|\)|[a-z0-9][a-z0-9.+:-]*)")
#: What must follow the short tag, which prose has too: a known identifier, perhaps with a version, or a reference.
IDENTIFIED = re.compile(rf"[ \t(]*(?:licenseref-|(?:{'|'.join(map(re.escape, IDENTIFIERS))})(?:v?[0-9]|[^a-z0-9_\x80-\xFF]|$))")
PRECEDENCE = {"or": 1, "and": 2, "with": 3}


class Finding(NamedTuple):
    """Licences an expression names, and whether it can be met with permissive ones."""

    labels: frozenset[str]
    permissive: bool


def license_of(identifier: str) -> Finding:
    best = max((p for p in IDENTIFIERS if identifier.startswith(p)), key=len, default=None)
    label = IDENTIFIERS[best] if best else "other:" + identifier
    return Finding(frozenset({label}), label in PERMISSIVE)


def combine(operator: str, left: Finding, right: Finding | str) -> Finding:
    if operator == "with":
        return Finding(left.labels, left.permissive or str(right).startswith(EXCEPTIONS))
    permissive = left.permissive and right.permissive if operator == "and" else left.permissive or right.permissive
    return Finding(left.labels | right.labels, permissive)


def tokens_at(text: str, start: int) -> list[str]:
    """Expression tokens from ``start``, as far as operands and operators take turns."""
    tokens: list[str] = []
    depth, operand_next = 0, True
    while match := TOKEN.match(text, start):
        token = match[1]
        if token in PRECEDENCE or token == ")":
            if operand_next or token == ")" and not depth:
                break
        elif not operand_next:
            break
        tokens.append(token)
        depth += (token == "(") - (token == ")")
        if token != ")":
            operand_next = token == "(" or token in PRECEDENCE
        start = match.end()
    while tokens and tokens[-1] in (*PRECEDENCE, "("):  # nothing follows these
        tokens.pop()
    return tokens


def postfix(tokens: list[str]) -> list[str]:
    """Shunting-yard: operators move behind their operands; brackets left open close at the end."""
    output: list[str] = []
    waiting: list[str] = []
    for token in tokens:
        if token == "(":
            waiting.append(token)
        elif token == ")":
            while waiting[-1] != "(":
                output.append(waiting.pop())
            waiting.pop()
        elif token in PRECEDENCE:
            while waiting and waiting[-1] != "(" and PRECEDENCE[waiting[-1]] >= PRECEDENCE[token]:
                output.append(waiting.pop())
            waiting.append(token)
        else:
            output.append(token)
    return output + [t for t in reversed(waiting) if t != "("]


def evaluate(tokens: list[str]) -> Finding | None:
    """The value of an expression; None if it is empty or puts an expression behind WITH."""
    stack: list[Finding | str] = []
    for token in postfix(tokens):
        if token not in PRECEDENCE:
            stack.append(token)
            continue
        right, left = stack.pop(), stack.pop()
        left = license_of(left) if isinstance(left, str) else left
        if token == "with" and not isinstance(right, str):
            return None
        stack.append(combine(token, left, license_of(right) if token != "with" and isinstance(right, str) else right))
    if not stack:
        return None
    return license_of(stack[0]) if isinstance(stack[0], str) else stack[0]


@lru_cache
def automata() -> tuple[ahocorasick.Automaton, ahocorasick.Automaton]:
    phrases, tags = ahocorasick.Automaton(), ahocorasick.Automaton()
    for phrase, label in {**MORE_PHRASES, **BASE_PHRASES}.items():
        phrases.add_word(f" {phrase} ", (len(phrase) + 2, label, phrase in BASE_PHRASES))
    for tag in TAGS:
        tags.add_word(tag, (len(tag), tag == TAGS[-1]))
    phrases.make_automaton()
    tags.make_automaton()
    return phrases, tags


FIELDS = {
    "n_words": T.LongType(), "n_base": T.LongType(), "first_word": T.LongType(), "last_word": T.LongType(),
    "base_labels": T.StringType(), "labels": T.StringType(), "score": T.DoubleType(), "permissive": T.BooleanType(),
}


def scan_text(text: str) -> tuple:
    """The FIELDS of one text. ``permissive`` is NULL without an expression; else all of them must be.

    A tag counts where a word begins; the short one only before something that names a licence.
    """
    phrases, tags = automata()
    raw = text.encode()
    words = raw.translate(WORD_BYTES).split()
    line = " " + b" ".join(words).decode("latin-1") + " "
    base, weights, starts = set(), {}, []
    for end, (length, label, is_base) in phrases.iter(line):
        if is_base:
            base.add(label)
            starts.append(end - length + 1)
        weights[label] = max(weights.get(label, 0.0), WEIGHT_BASE if is_base else WEIGHT_MORE)
    lowered, permissive = raw.translate(LOWER_BYTES).decode("latin-1"), None
    for end, (length, is_short) in tags.iter(lowered):
        before = lowered[end - length : end - length + 1] if end >= length else " "
        if before.isalnum() or before == "_" or before > "\x7F" or is_short and not IDENTIFIED.match(lowered, end + 1):
            continue  # the end of a longer word, or prose
        if finding := evaluate(tokens_at(lowered, end + 1)):
            weights |= dict.fromkeys(finding.labels, WEIGHT_TAG)
            permissive = finding.permissive if permissive is None else permissive and finding.permissive
    missed = 1.0
    for weight in weights.values():
        missed *= 1 - weight
    # a phrase begins with the space before its first word: as many spaces, as many words before
    place = lambda at: line.count(" ", 0, at)
    return (
        len(words), len(starts), place(min(starts)) if starts else None, place(max(starts)) if starts else None,
        ",".join(sorted(base)), ",".join(sorted(weights)), round(1 - missed, 9), permissive,
    )


@F.arrow_udf(T.StructType([T.StructField(n, t) for n, t in FIELDS.items()]))
def found_licenses(texts: pa.Array) -> pa.Array:
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.bool_()]
    rows = [scan_text(text or "") for text in texts.to_pylist()]
    columns = list(zip(*rows)) if rows else [[] for _ in FIELDS]
    return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], list(FIELDS))


def scan(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("*",)) -> DataFrame:
    """(doc, found): the columns named in ``keep`` as a struct, and the FIELDS of the text.

    NULL and empty texts have no words and no labels, and a score of 0. Equal rows get equal
    results; columns of any name pass inside ``doc``.
    """
    return docs.select(F.struct(*keep).alias("doc"), found_licenses(docs[text_col]).alias("found"))
