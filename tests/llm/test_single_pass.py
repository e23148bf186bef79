"""Quality rules, licence scans, byte-level BPE: each against a direct statement of its contract."""

import base64
import hashlib
import math
import random
import re
import struct
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st

from weftgraph.llm import bpe, licenses, quality

WORD = re.compile("[^\x20\x09-\x0d]+")


def quality_figures(text):
    text = text or ""
    ws = WORD.findall(text)
    windows = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
    times = {}
    for w in windows:
        times[w] = times.get(w, 0) + 1
    inside = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines)) if len(lines) < 3000 else len(lines) - len(set(lines))
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside)


def test_quality_figures(documents, odd_docs):
    for docs in (odd_docs, documents):
        texts = sorted((-1 if r[0] is None else r[0], r[1] or "") for r in docs.select("doc_id", "text").collect())
        got = sorted(quality.quality(docs).collect(), key=lambda r: -1 if r.doc_id is None else r.doc_id)
        assert len(got) == len(texts)
        for (_, text), r in zip(texts, got, strict=True):
            n = quality_figures(text)
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n
            assert r.base_failed == (n[0] < 50 or 100 * n[4] > 50 * n[0])
            assert not (r.base_failed and r.kept)


def test_quality_bands(documents):
    """Junk that the base rules keep falls by its ratio, on either side, and in a part of a document too."""
    judge = quality.Judge()
    rng = random.Random(5)
    noise = " ".join(base64.b64encode(hashlib.sha256(str(i).encode()).digest()).decode() for i in range(2000))
    assert judge(noise)[5:7] == (False, False)
    texts = [r.text for r in documents.where("length(text) > 2000 and doc_id < 300").collect()]
    prose = [t for t in texts if judge(t)[6]][:20]
    assert len(prose) == 20
    for t in prose:
        assert judge(" ".join(w + rng.choice(["###", "$$$", "&&&", "***"]) for w in t.split()))[5:7] == (False, False)
        assert judge(t + " " + noise[: len(t)])[5:7] == (False, False)
    bands = quality.Bands()
    assert all(lo < hi for lo, hi in map(bands.limits, (0, 1, 200, 5000, 10**6, 10**9)))
    assert bands.limits(4096) == (1.86, 2.28)
    assert bands.limits(1) == bands.limits(128)


def direct_verdict(text, figures):
    """The bands stated anew: a straight line over log2 of the bytes between knots."""
    data = (text or "").encode()
    ratio = lambda b: len(b) / len(zstandard.ZstdCompressor(level=3, write_content_size=False).compress(b)) if b else 0.0
    at = [math.log2(k[0]) for k in quality.BANDS]
    inside = lambda b: np.interp(math.log2(max(len(b), 1)), at, [k[1] for k in quality.BANDS]) <= ratio(b) <= np.interp(math.log2(max(len(b), 1)), at, [k[2] for k in quality.BANDS])
    chunks = [data[i : i + 4096] for i in range(0, len(data), 4096)]
    bad = sum(len(c) for c in chunks if not inside(c)) if len(chunks) > 1 else 0
    return figures[0] >= 50 and 100 * figures[4] <= 50 * figures[0] and bool(inside(data)) and bad <= 0.25 * len(data)


def test_quality_verdict(documents, odd_docs):
    for docs in (documents, odd_docs):
        texts = Counter((r[0], r[1], direct_verdict(r[1], quality_figures(r[1]))) for r in docs.select("doc_id", "text").collect())
        got = Counter((r[0], r[1], r[2]) for r in quality.quality(docs).select("doc_id", "kept").join(docs.select("doc_id", "text").distinct(), "doc_id").select("doc_id", "text", "kept").collect())
        assert {k: n for k, n in texts.items() if k[0] is not None} == got


def test_quality_follows_labels(spark, documents):
    """Of what the base rules keep, the bands reject most documents of low quality and hardly any other."""
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = quality.quality(documents).where("not base_failed").join(labels, "doc_id").select("kept", "quality").collect()
    good, bad = [r.kept for r in rows if r.quality == 1], [r.kept for r in rows if r.quality == 0]
    assert sum(good) > 0.98 * len(good)
    assert sum(bad) < 0.25 * len(bad)


def test_keep_good_keeps_columns_and_rows(odd_docs, no_docs):
    kept = quality.keep_good(odd_docs)
    assert kept.columns == odd_docs.columns
    assert kept.count() == quality.quality(odd_docs).where("kept").count()
    assert quality.quality(no_docs).count() == quality.keep_good(no_docs).count() == 0


def license_base(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    ws = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
    places = []
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        places += [(i, label) for i in range(len(ws) - len(p) + 1) if ws[i : i + len(p)] == p]
    at = [i for i, _ in places]
    return len(ws), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def test_license_base(documents, odd_docs, no_docs):
    for docs in (odd_docs, documents):
        texts = sorted((-1 if r[0] is None else r[0], r[1] or "") for r in docs.select("doc_id", "text").collect())
        got = sorted(licenses.licenses(docs).collect(), key=lambda r: -1 if r.doc_id is None else r.doc_id)
        for (_, text), r in zip(texts, got, strict=True):
            assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == license_base(text)
            assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
            assert r.labels == ",".join(sorted(set(filter(None, r.labels.split(",")))))
            assert 0 <= r.score <= 1
    assert licenses.licenses(no_docs).count() == 0


@pytest.mark.parametrize(
    ("text", "postfix"),
    [
        ("MIT", ["MIT"]),
        ("MIT OR Apache-2.0 AND BSD-3-Clause", ["MIT", "Apache-2.0", "BSD-3-Clause", "AND", "OR"]),
        ("(MIT or GPL-2.0-only with Classpath-exception-2.0) and CC-BY-4.0", ["MIT", "GPL-2.0-only", "Classpath-exception-2.0", "WITH", "OR", "CC-BY-4.0", "AND"]),
        ("MIT AND", ["MIT"]),
        ("(MIT", ["MIT"]),
        ("MIT */ int x", ["MIT"]),
        (") MIT", []),
        ("", []),
    ],
)
def test_shunting_yard(text, postfix):
    assert licenses.to_postfix(text) == postfix


def test_expression_burden():
    burden = lambda s: licenses.evaluate(licenses.to_postfix(s))[1]
    assert burden("MIT OR GPL-3.0-only") == burden("MIT") < burden("GPL-3.0-only") == burden("MIT AND GPL-3.0-only")
    assert burden("GPL-2.0-only WITH Classpath-exception-2.0") < burden("GPL-2.0-only")
    machine = licenses.automaton()
    assert licenses.scan("// SPDX-License-Identifier: MIT OR GPL-2.0-only\ncode", machine)[5] == "gpl,mit"
    assert licenses.scan("Under the MIT License.", machine)[4:6] == ("", "mit")
    assert licenses.scan("GNU Lesser General Public License", machine)[4:6] == ("gpl", "gpl,lgpl")


@pytest.fixture(scope="module")
def reference_encoding():
    ranks = bpe.load_ranks(P.path("byte_bpe_50k.tiktoken"))
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_library(documents, odd_docs, no_docs, reference_encoding):
    path = P.path("byte_bpe_50k.tiktoken")
    for docs in (odd_docs, documents):
        texts = sorted((-1 if r[0] is None else r[0], r[1] or "") for r in docs.select("doc_id", "text").collect())
        got = sorted(bpe.bpe_round_trip(docs, path, P.PATTERN).collect(), key=lambda r: -1 if r.doc_id is None else r.doc_id)
        for (_, text), r in zip(texts, got, strict=True):
            ids = reference_encoding.encode_ordinary(text)
            assert r.n_tokens == len(ids)
            assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
            assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.bpe_round_trip(no_docs, path, P.PATTERN).count() == 0


def test_bpe_tree_of_long_pieces(reference_encoding):
    coder = bpe.TreeEncoder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    for text in ("a" * 1000, "abcabcabd" * 200, "=-" * 700, "Donaudampfschifffahrtsgesellschaft" * 30, "\U0001f600" * 300, "1" * 999, "x" * 63 + "yz" * 65):
        ids = coder.encode(text)
        assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == reference_encoding.encode_ordinary(text)
        assert coder.decode(ids).decode() == text


@pytest.mark.parametrize("text", ["a  b", " a", "a ", "a \n b", "a　 b", "a  b", "it's  we'll\n\n x", "a b\x1c c", "x\x85 y", "  ", "\n \n", "1 2  3", "a\x0b b"])
def test_bpe_white_space(text, reference_encoding):
    coder = bpe.TreeEncoder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    ids = coder.encode(text)
    assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == reference_encoding.encode_ordinary(text)


def test_every_piece_is_joined_from_its_bytes(documents, reference_encoding, monkeypatch):
    """Without joining only single bytes are known, and what the tree gives is what the library gives."""
    path = P.path("byte_bpe_50k.tiktoken")
    pieces = {p.encode() for r in documents.where("doc_id < 60").collect() for p in bpe.TreeEncoder(path, P.PATTERN).pieces(r.text or "")}
    coder = bpe.TreeEncoder(path, P.PATTERN)
    assert all(len(p) == 1 for p in coder.parts)
    assert [coder.piece(p) for p in pieces] == [reference_encoding._core_bpe.encode_single_piece(p) for p in pieces]
    monkeypatch.setattr(bpe.TreeEncoder, "join", lambda self, left, right: [])
    lost = bpe.TreeEncoder(path, P.PATTERN)
    assert all(lost.piece(p) == [] for p in pieces if len(p) > 1)
    assert len(pieces) > 1000


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"aa", b"the", b" ", b"\xe3\x81", b"\x82", b"ing", b"=", b"0", b"th"]), max_size=60), st.data())
def test_joining_is_associative(parts, data):
    coder = CODER.setdefault("coder", bpe.TreeEncoder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN))
    whole = b"".join(parts)
    i = data.draw(st.integers(0, len(whole)))
    j = data.draw(st.integers(i, len(whole)))
    a, b, c = (coder.piece(x) for x in (whole[:i], whole[i:j], whole[j:]))
    assert coder.join(coder.join(a, b), c) == coder.join(a, coder.join(b, c)) == coder.piece(whole)


CODER: dict = {}
