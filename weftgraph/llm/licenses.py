"""Licence scans: an Aho-Corasick automaton over identifier tags and notice phrases.

The automaton runs over the words of a text, so that a phrase is found across
line breaks and punctuation. Identifier tags carry expressions such as
`(MIT OR GPL-2.0-only WITH Classpath-exception-2.0) AND CC-BY-4.0`; a
shunting-yard parser turns them into postfix form, which is then evaluated.
"""

from __future__ import annotations

import re

import ahocorasick
from pyspark.sql import DataFrame

from .common import LOWER, map_texts

#: Phrases of the base scan and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Notice phrases that the method adds.
NOTICES = {
    "mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "apache license": "apache",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "isc license": "isc",
    "creative commons attribution": "cc-by",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc0": "cc0",
    "creative commons zero": "cc0",
    "public domain": "public-domain",
    "unlicense": "unlicense",
    "boost software license": "bsl",
}
TAG = "spdx license identifier"
#: How much a licence restricts reuse, from 0 (none) to 1 (no reuse).
BURDEN = {
    "public-domain": 0.0, "cc0": 0.0, "unlicense": 0.0, "mit": 0.1, "isc": 0.1, "bsd": 0.1, "bsl": 0.1, "apache": 0.15, "cc-by": 0.2,
    "mpl": 0.4, "epl": 0.4, "cc-by-sa": 0.5, "lgpl": 0.5, "cc-by-nc": 0.7, "cc-by-nd": 0.7, "gpl": 0.7, "agpl": 0.8, "reserved": 1.0,
}
UNKNOWN = 0.5
#: An exception lifts this share of the burden of the licence before it.
EXCEPTION = 0.3
PRECEDENCE = {"OR": 1, "AND": 2, "WITH": 3}
_FAMILIES = ("cc-by-nc", "cc-by-nd", "cc-by-sa", "cc-by", "cc0", "agpl", "lgpl", "gpl", "mit", "apache", "bsd", "bsl", "mpl", "epl", "isc", "unlicense", "public-domain")
_TAG = re.compile(r"spdx[^0-9a-z\x80-\U0010ffff]+license[^0-9a-z\x80-\U0010ffff]+identifier\s*:\s*([^\n\r]*)", re.IGNORECASE | re.ASCII)
_LEX = re.compile(r"\(|\)|[A-Za-z0-9.+:-]+")
#: All ASCII characters outside words become blanks; bytes of other characters stay.
_WORDS = bytes(32 if b < 48 or 57 < b < 97 or 122 < b < 128 else b for b in range(256))


def label_of(identifier: str) -> str:
    """The family of an identifier; its own lower-case form if none fits."""
    x = identifier.lower().rstrip("+")
    return next((f for f in _FAMILIES if x == f or x.startswith(f + "-")), x)


def to_postfix(expression: str) -> list[str]:
    """Shunting-yard: WITH binds before AND, AND before OR, all from the left.

    Reading stops where the text can't continue an expression (comment ends,
    prose), so that what stands before still counts. Unbalanced parentheses are
    closed at the end.
    """
    out: list[str] = []
    held: list[str] = []
    operand = False
    for m in _LEX.finditer(expression):
        t = m.group()
        op = t.upper()
        if op in PRECEDENCE:
            if not operand:
                break
            while held and held[-1] != "(" and PRECEDENCE[held[-1]] >= PRECEDENCE[op]:
                out.append(held.pop())
            held.append(op)
            operand = False
        elif t == "(":
            if operand:
                break
            held.append(t)
        elif t == ")":
            if not operand or "(" not in held:
                break
            while held[-1] != "(":
                out.append(held.pop())
            held.pop()
        else:
            if operand:
                break
            out.append(t)
            operand = True
    if not operand and held and held[-1] != "(":
        held.pop()
    out += [x for x in reversed(held) if x != "("]
    return out


def evaluate(postfix: list[str]) -> tuple[frozenset[str], float] | None:
    """The labels named, and the burden: the lighter side of OR, the heavier of AND."""
    stack: list[tuple[frozenset[str], float]] = []
    for t in postfix:
        if t in PRECEDENCE:
            if len(stack) < 2:
                continue
            b, a = stack.pop(), stack.pop()
            if t == "WITH":
                stack.append((a[0], a[1] * (1 - EXCEPTION)))
            else:
                stack.append((a[0] | b[0], (min if t == "OR" else max)(a[1], b[1])))
        else:
            x = label_of(t)
            stack.append((frozenset([x]), BURDEN.get(x, UNKNOWN)))
    return stack[-1] if stack else None


def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for phrase in {**BASE, **NOTICES, TAG: ""}:
        a.add_word(f" {phrase} ", phrase)
    a.make_automaton()
    return a


def scan(text: str | None, machine: ahocorasick.Automaton) -> tuple:
    text = text or ""
    # lone surrogates cannot come from a table; "replace" keeps hand-made texts from failing
    ws = text.encode("utf-8", "replace").translate(LOWER).translate(_WORDS).split()
    joined = f" {b' '.join(ws).decode('utf-8', 'replace')} "
    starts: list[int] = []
    base: set[str] = set()
    found: set[str] = set()
    burdens: list[float] = []
    tagged = False
    at = n = 0
    for end, phrase in machine.iter(joined):
        if phrase in BASE:
            begin = end - len(phrase) - 1
            n += joined.count(" ", at, begin + 1)
            at = begin + 1
            starts.append(n - 1)
            base.add(BASE[phrase])
        elif phrase == TAG:
            tagged = True
        else:
            found.add(NOTICES[phrase])
    if tagged:
        for m in _TAG.finditer(text):
            if got := evaluate(to_postfix(m.group(1))):
                found |= got[0]
                burdens.append(got[1])
    burdens += [BURDEN.get(x, UNKNOWN) for x in base | (found if not burdens else set())]
    labels = sorted(base | found)
    return len(ws), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(labels), max(burdens, default=0.0)


COLUMNS = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def licenses(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id and COLUMNS.

    score is the burden of the heaviest notice or expression, 0 where nothing is
    found. A null text counts as empty: no words, empty label strings, score 0,
    null positions. Repeated rows each get a row. No shuffle, one pass.
    """
    names = [x.split()[0] for x in COLUMNS.split(", ")]

    def make():
        machine = automaton()
        return lambda texts: dict(zip(names, zip(*(scan(t, machine) for t in texts), strict=True), strict=True)) if texts else dict.fromkeys(names, ())

    return map_texts(docs, make, COLUMNS)
