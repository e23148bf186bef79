"""Operators that look at all rows together, each against brute force or a law that its result must hold."""

import math
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from tokenizers import Tokenizer
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from weftgraph.llm import components as components_module
from weftgraph.llm import lm, packing, sharding, simhash, topk, toxicity
from weftgraph.llm.components import connected_components

WORD = re.compile("[^\x20\x09-\x0d]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# Near-duplicates


def fingerprint(text):
    ws = WORD.findall(lower(text))
    shingles = [" ".join(ws[i : i + 3]) for i in range(len(ws) - 2)] or ([" ".join(ws)] if ws else [])
    h = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def components(fps):
    """doc_id -> least doc_id reachable, by all pairs."""
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    x = np.array([fps[i] for i in ids], np.uint64)
    for k, i in enumerate(ids):
        for j in np.flatnonzero(np.bitwise_count(x[k] ^ x[k + 1 :]) <= 2):
            a, b = sorted((find(i), find(ids[k + 1 + j])))
            root[b] = a
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("bucket", [512, 2])
def test_near_duplicates(documents, bucket):
    docs = documents.where("doc_id < 400")
    fps = {r.doc_id: fingerprint(r.text) for r in docs.collect()}
    want = components(fps)
    got = simhash.near_duplicates(docs, bucket=bucket).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{fps[i]:016x}", want[i]) for i in fps}
    assert len(got) == len(fps)


def test_links_in_crowded_buckets(spark):
    rng = np.random.default_rng(3)
    seeds = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    fps = {int(s) for s in seeds}
    for s in seeds:
        for _ in range(120):
            x = int(s)
            for b in rng.integers(0, 64, rng.integers(1, 6)):
                x ^= 1 << int(b)
            fps.add(x)
    rows = spark.createDataFrame([(simhash.signed(x),) for x in fps], "fp long")
    pairs = simhash.links(rows, bucket=20)
    assert all(((a ^ b) & ((1 << 64) - 1)).bit_count() <= 2 for a, b in pairs.collect())
    got = {r.node: r.root for r in connected_components(pairs).collect()}
    want = components({simhash.signed(x): x for x in fps})
    assert {i: got.get(i, i) for i in want} == want


def test_near_duplicates_odd(odd_docs, no_docs):
    got = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.near_duplicates(odd_docs).collect()}
    assert {k[1] for k, v in got.items() if k[0] in (2, 3, 4)} == {"0" * 16}
    assert {v for k, v in got.items() if k[0] in (2, 3, 4)} == {2}
    assert simhash.near_duplicates(odd_docs).count() == odd_docs.count()
    assert simhash.near_duplicates(no_docs).count() == 0
    kept = simhash.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 5, 6, 7, 8, 9]
    twice = odd_docs.unionByName(odd_docs)
    assert sorted(r.doc_id or 0 for r in simhash.keep_one(twice).collect()) == [0, 1, 2, 5, 6, 7, 8, 9]


def test_connected_components(spark, monkeypatch):
    path = [(i, i + 1) for i in range(100, 164)]
    star = [(500, i) for i in range(501, 600)]
    edges = spark.createDataFrame([*path, *star, (7, 7), (9, 8), (8, 9)], "x long, y long")
    got = {r.node: r.root for r in connected_components(edges).collect()}
    assert got == {**{i: 100 for i in range(100, 165)}, **{i: 500 for i in range(500, 600)}, 8: 8, 9: 8}
    assert connected_components(edges.limit(0)).count() == 0
    monkeypatch.setattr(components_module, "HUB", 20)
    assert {r.node: r.root for r in connected_components(edges).collect()} == got


# Shards


def test_shards(documents, odd_docs, no_docs):
    for docs in (documents, odd_docs):
        want = sorted((r.doc_id or -1, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in docs.collect())
        got = sharding.shard(docs).collect()
        assert sorted((r.doc_id or -1, r["size"], r.text_crc32) for r in got) == want
        slots = defaultdict(list)
        for r in got:
            assert (r.law, r.grown_shard) == ("bytes", None)
            slots[r.shard].append(r.slot)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        assert set(slots) <= set(range(40))
    assert sharding.shard(no_docs).count() == 0


def test_ring_bounds_loads_and_movement(spark):
    cells = spark.range(1 << 14).selectExpr("cast(id as int) cell", "1000 + id % 7 n_bytes", "1L n_rows")
    placed = sharding.place(cells).collect()
    load = Counter()
    for r in placed:
        load[r.shard] += 1000 + r.cell % 7
    mean = sum(load.values()) / 40
    assert len(placed) == 1 << 14
    assert max(load.values()) < mean * (1 + sharding.SLACK) + 1007
    assert min(load.values()) >= mean * (1 - 40 * sharding.SLACK)
    assert sum(r.home == r.shard for r in placed) > 0.8 * len(placed)


def test_one_more_shard_moves_little(spark):
    """40 to 41 shards: the new one fills up, old ones exchange next to nothing, and loads stay bounded."""
    cells = spark.range(1 << 13).selectExpr("cast(id as int) cell", "1000 + id % 7 n_bytes", "1L n_rows")
    before = {r.cell: r.shard for r in sharding.place(cells, 40, cells=1 << 13).collect()}
    after = {r.cell: r.shard for r in sharding.place(cells, 41, cells=1 << 13).collect()}
    weight = {c: 1000 + c % 7 for c in before}
    whole = sum(weight.values())
    into_new = sum(weight[c] for c in before if after[c] == 40)
    between_old = sum(weight[c] for c in before if after[c] not in (40, before[c]))
    assert 0.98 * whole / 41 < into_new <= 1.01 * whole / 41
    assert between_old < 0.04 * whole
    load = Counter()
    for c, s in after.items():
        load[s] += weight[c]
    assert max(load.values()) < whole / 41 * (1 + sharding.SLACK) + 1007


def test_ring_is_clockwise(spark):
    """Each point's shards are those of the virtual nodes at or after it, in their order round the ring."""
    got = {r.cell: r.pref for r in sharding.ring(spark, 5, 3, 64).collect()}
    hashed = spark.range(15).selectExpr("int(id / 3) s", "id % 3 r").selectExpr("s", "r", "cast(pmod(xxhash64('node', s, r), 64) as int) p").collect()
    nodes = sorted((r.p, r.s, r.r) for r in hashed)
    for cell in range(64):
        round_ = [n[1] for n in nodes if n[0] >= cell] + [n[1] for n in nodes if n[0] < cell]
        assert got[cell] == list(dict.fromkeys(round_))


# Packing


def check_pieces(docs, got):
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    t.encode_special_tokens = True
    want = {(-1 if r.doc_id is None else r.doc_id): [*t.encode(r.text or "", add_special_tokens=False).ids, 2] for r in docs.collect()}
    copies = Counter(-1 if r[0] is None else r[0] for r in docs.select("doc_id").collect())
    parts, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        key = -1 if r.doc_id is None else r.doc_id
        ids = want[key][r.start : r.start + r.length]
        assert r.doc_tokens == len(want[key])
        assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))
        parts[key].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    assert set(parts) == set(want)
    for key, pieces in parts.items():
        cover = Counter()
        for start, n in pieces:
            cover.update(range(start, start + n))
        assert cover == Counter({i: copies[key] for i in range(len(want[key]))})
    padding = 0
    for pieces in sequences.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert 0 < at <= 4096
        padding += 0 if at & (at - 1) == 0 else 4096 - at
    assert padding <= 0.01 * sum(map(len, want.values()))


def test_packing(documents, odd_docs, no_docs):
    path = P.path("word_bpe_49k.json")
    check_pieces(odd_docs, packing.pack(odd_docs, path).collect())
    check_pieces(documents, packing.pack(documents, path).collect())
    assert packing.pack(no_docs, path).count() == 0


def test_neighbours_are_lexical():
    rng = np.random.default_rng(1)
    topics = [rng.integers(1000 * k, 1000 * k + 300, (20, 200)) for k in range(4)]
    docs = [topics[i % 4][i // 4].astype("<u4") for i in range(80)]
    order = list(packing.order(docs, 4096))
    assert sorted(order) == list(range(80))
    same = sum(a % 4 == b % 4 for a, b in zip(order, order[1:], strict=False))
    assert same >= 70


def test_neighbours_count_all_terms():
    """The order is that of BM25 over every term of a long seed."""
    rng = np.random.default_rng(4)
    docs = [rng.zipf(1.3, 900).clip(0, 5000).astype("<u4") for _ in range(60)]
    n, mean = len(docs), np.mean([len(x) for x in docs])
    tf = [Counter(x.tolist()) for x in docs]
    df = Counter(k for c in tf for k in c)
    part = lambda k, c, x: math.log1p((n - df[k] + 0.5) / (df[k] + 0.5)) * c[k] * 2.2 / (c[k] + 1.2 * (0.25 + 0.75 * len(x) / mean))
    unused = np.ones(n, bool)
    unused[:3] = False
    index = packing.Index(docs)
    for seed in range(3):
        assert len(tf[seed]) > 100
        score = {i: sum(part(k, tf[i], docs[i]) for k in tf[seed] if k in tf[i]) for i in range(3, n)}
        assert index.neighbours(seed, unused).tolist() == sorted(score, key=lambda i: -score[i])


def test_weights_are_of_the_whole_corpus(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    t.encode_special_tokens = True
    ids = [np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 2]) for r in docs.collect()]
    df = Counter(k for x in ids for k in set(x.tolist()))
    corpus = packing.statistics(packing.tokenised(docs, P.path("word_bpe_49k.json")))
    assert (corpus.n, {i: int(corpus.df[i]) for i in np.flatnonzero(corpus.df)}) == (len(ids), df)
    assert math.isclose(corpus.mean, sum(map(len, ids)) / len(ids))
    index = packing.Index(ids[:5], corpus)
    assert np.allclose(index.idf, [math.log1p((len(ids) - df[k] + 0.5) / (df[k] + 0.5)) for k in index.terms.tolist()])


# Exact top-k


def test_top_k(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet/**' " if __import__("os").path.isdir(f"{sf_dir}/embeddings.parquet") else f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    want = sorted(con.execute(topk.ORACLE_SQL).fetchall())
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    got = sorted(map(tuple, topk.top_k(rows).collect()))
    assert got == want
    assert sorted(map(tuple, topk.top_k(rows, block=16, pivots=5, rings=3, sample=50).collect())) == want


def test_bounds_spare_comparisons(spark):
    """Of clustered vectors few pairs are compared, and the result is that of all pairs."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(40, 16))
    x = (centres[rng.integers(0, 40, 4000)] + 0.02 * rng.normal(size=(4000, 16))).astype(np.float32)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    figures = {}
    got = sorted(map(tuple, topk.top_k(rows, pivots=40, figures=figures).collect()))
    v = np.floor(1024 * x.astype(float)).astype(np.int64)
    want = []
    for q in range(0, 4000, 100):
        score = v @ v[q]
        score[q] = -(1 << 62)
        want += [(q, r + 1, int(i), int(score[i])) for r, i in enumerate(np.lexsort((np.arange(4000), -score))[:10])]
    assert got == sorted(want)
    assert figures["pairs"] == 40 * 4000
    assert figures["compared"] < 0.5 * figures["pairs"]


def test_repeated_vector_ids(spark):
    """A repeated vec_id is so many candidates and one query; a third of all rows may be one vector."""
    rows = [(i, [float(i % 7), 1.0]) for i in range(60)] + [(200, [0.5, 0.5])] * 2 + [(1000 + i, [3.0, 3.0]) for i in range(40)]
    got = sorted(map(tuple, topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), block=8).collect()))
    v = [(i, [int(1024 * c) for c in x]) for i, x in rows]
    want = []
    for q, x in {0: v[0][1], 200: v[60][1], 1000: v[62][1]}.items():
        scored = sorted((-(x[0] * y[0] + x[1] * y[1]), i) for i, y in v if i != q)[:10]
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    assert got == sorted(want)


def test_top_k_odd(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [float("inf"), 0.0]), (100, [-1.0, 0.5]), (200, None), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS rank", "2 AS score")
    got = sorted(map(tuple, topk.top_k(df).collect()))
    v = {0: (1024, 0), 1: (1024, 0), 2: (1024, 0), 100: (-1024, 512)}
    want = []
    for q in (0, 100):
        scored = sorted((-(v[q][0] * x[0] + v[q][1] * x[1]), i) for i, x in v.items() if i != q)
        want += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(scored)]
    assert got == sorted(want)
    assert topk.top_k(df.limit(0)).count() == 0


# Language model


def tokens_of(text):
    return [*WORD.findall(lower(text)), None]


def test_lm_base_and_gain(documents, odd_docs, no_docs):
    for docs in (documents, odd_docs):
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        held = {i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows}
        count = Counter(t for i, text in rows if not held[i] for t in tokens_of(text))
        n, v = sum(count.values()), len(count)
        want = defaultdict(list)
        for i, text in rows:
            ts = tokens_of(text)
            want[i].append((len(ts), sum(count[t] > 0 for t in ts), sum(math.log10((count[t] + 0.5) / (n + 0.5 * (v + 1))) for t in ts)))
        got = lm.scores(docs).collect()
        assert len(got) == len(rows)
        for r in got:
            assert r.held_out == held[r.doc_id]
            assert r.train_tokens == n
            assert any((r.n_tokens, r.n_known) == w[:2] and math.isclose(r.base_score, w[2], rel_tol=1e-9) for w in want[r.doc_id])
            assert -math.inf < r.score < 0
        if docs is documents:
            assert sum(r.score for r in got if r.held_out) > sum(r.base_score for r in got if r.held_out)
    assert lm.scores(no_docs).count() == 0


def test_lm_equals_a_direct_model(documents):
    """Each document's score is that of the mixture with the learned weights, token by token."""
    docs = documents.where("doc_id < 150")
    rows = {r.doc_id: r.text or "" for r in docs.collect()}
    figures = {}
    got = {r.doc_id: r for r in lm.scores(docs, figures).collect()}
    uni, bi, ctx = Counter(), Counter(), Counter()
    for i, text in rows.items():
        if zlib.crc32(str(i).encode()) % 5 != 1:
            h = "<s>"
            for t in tokens_of(text):
                uni[t] += 1
                bi[h, t] += 1
                ctx[h] += 1
                h = t
    n, v = sum(uni.values()), len(uni)
    assert (figures["tokens"], figures["distinct"]) == (n, v)
    weights = figures["weights"]
    assert np.allclose(weights.sum(1), 1)
    for i, text in rows.items():
        score, h = 0.0, "<s>"
        for t in tokens_of(text):
            w = weights[1 + int(math.log2(ctx[h])) if ctx[h] else 0]
            score += math.log10(w[0] * (bi[h, t] / ctx[h] if ctx[h] else 0) + w[1] * uni[t] / n + w[2] / (v + 1))
            h = t
        assert math.isclose(got[i].score, score, rel_tol=1e-9)


def test_lm_weights_are_those_of_exact_em(documents):
    """Rounding the ratios moves the mixture's likelihood of the held-out documents by next to nothing."""
    docs = documents.where("doc_id < 150")
    rows = {r.doc_id: r.text or "" for r in docs.collect()}
    figures = {}
    lm.scores(docs, figures)
    uni, bi, ctx, dev = Counter(), Counter(), Counter(), []
    for i, text in rows.items():
        held, is_dev = lm.fold(i)
        pairs = list(zip(["<s>", *tokens_of(text)], tokens_of(text), strict=False))
        if is_dev:
            dev += pairs
        elif not held:
            uni.update(t for _, t in pairs)
            bi.update(pairs)
            ctx.update(h for h, _ in pairs)
    n, v = sum(uni.values()), len(uni)
    p = np.array([(bi[h, t] / ctx[h] if ctx[h] else 0, uni[t] / n, 1 / (v + 1)) for h, t in dev])
    at = np.array([1 + int(math.log2(ctx[h])) if ctx[h] else 0 for h, _ in dev])
    weights = np.full((lm.BUCKETS, 3), 1 / 3)
    for _ in range(lm.ROUNDS):
        share = weights[at] * p
        new = np.ones((lm.BUCKETS, 3))
        np.add.at(new, at, share / share.sum(1, keepdims=True))
        weights = new / new.sum(1, keepdims=True)
    weights[0] = [0, *(weights[0, 1:] / weights[0, 1:].sum())]
    assert np.abs(weights - figures["weights"]).max() < 0.02


def test_lm_after_an_exchange(documents):
    """Rows that come out of a shuffle are written first, so that a task run anew finds the same blocks."""
    docs = documents.where("doc_id < 60")
    order = lambda rows: sorted(map(tuple, rows.collect()))
    assert [x[:5] for x in order(lm.scores(docs.repartition(5)))] == [x[:5] for x in order(lm.scores(docs))]
    block = lm.Block()
    block.add(1, "a b c", False)
    block.close()
    ((part, asked),) = block.counts(1)
    wrong = lm.pack(**{k: np.zeros(n, np.int64) for k, n in (("all1", 5), ("dev1", 5), ("all2", 4), ("dev2", 4))}, check=lm.unpack(asked)["check"] + np.uint64(1))
    group = pa.table({"block": [0, 0], "part": [-1, part], "data": [block.itself(), wrong]})
    with pytest.raises(RuntimeError):
        lm.restore(group)


def test_em_finds_the_mixture():
    rng = np.random.default_rng(0)
    # in bucket 5 the pair explains most tokens, in bucket 2 the word does
    code = lambda b, two, one: b << 24 | two << 12 | one
    codes = np.array([code(5, 2224, 2052), code(5, 0, 2184), code(2, 2052, 2224), code(2, 0, 2184)])
    w = lm.learn(codes, np.array([9000, 1000, 9000, 1000]) + rng.integers(0, 2, 4))
    assert w[5, 0] > 0.7 > 0.3 > w[2, 0]
    assert np.allclose(w.sum(1), 1)


# Toxicity


def auc(pairs):
    pairs = sorted(pairs)
    rank, pos = 0.0, [x for x in pairs if x[1]]
    neg = len(pairs) - len(pos)
    scores = defaultdict(list)
    for s, y in pairs:
        scores[s].append(y)
    below = 0
    for s in sorted(scores):
        ys = scores[s]
        rank += sum(ys) * (below + 0.5 * (len(ys) - sum(ys)))
        below += len(ys) - sum(ys)
    return rank / (len(pos) * neg)


def test_toxicity_held_out(spark, documents):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = toxicity.toxicity(documents, labels).join(labels, "doc_id").collect()
    held = [(r.score, r.toxic) for r in rows if r.held_out]
    assert auc(held) > 0.9
    wrong = [(r.predicted, r.toxic) for r in rows if r.held_out and r.predicted != r.toxic]
    assert len(wrong) < 0.1 * len(held)


def test_positives_without_a_document_take_no_place(spark, documents, monkeypatch):
    docs = documents.where("doc_id < 40")
    labels = spark.createDataFrame([(i, 0, 1) for i in [*range(40), *range(10**6, 10**6 + 400)]], "doc_id long, quality int, toxic int")
    fitted = []
    monkeypatch.setattr(toxicity, "train", lambda p, u, prior: fitted.append(len(p)))
    toxicity.fit(docs, labels, positives=20)
    assert fitted == [20]


def test_toxicity_odd(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 0, 1), (5, 1, 0), (8, 1, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(odd_docs, labels).collect()
    assert len(got) == odd_docs.count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert all(r.score == 0 or r.score < 1e-20 for r in toxicity.toxicity(odd_docs, labels.limit(0)).collect())
    assert toxicity.toxicity(no_docs, labels).count() == 0
    assert toxicity.keep_clean(odd_docs, labels.limit(0)).columns == odd_docs.columns


def test_risk_is_corrected_for_the_prior():
    """Half the unlabelled documents are hidden positives; the classifier still finds them."""
    rng = np.random.default_rng(2)
    ones = lambda *parts: (np.sort(np.concatenate(parts)).astype(np.uint32), np.ones(sum(map(len, parts)), np.float32))
    clean = lambda: ones(rng.choice(np.arange(1000, 1100), 30, False))
    toxic = lambda: ones(rng.choice(np.arange(1000, 1100), 20, False), rng.choice(np.arange(2000, 2020), 8, False))
    model = toxicity.train([toxic() for _ in range(200)], [toxic() for _ in range(150)] + [clean() for _ in range(150)], 0.5)
    score = lambda x: 1 / (1 + math.exp(-(model.bias + sum(model.weights.get(int(f), 0) for f in x[0]))))
    assert np.mean([score(toxic()) for _ in range(50)]) > 0.7 > 0.5 > np.mean([score(clean()) for _ in range(50)])


def test_similarity_decides_which_near_copies_go(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows = []
    for i in range(20):
        base = [rng.choice(vocabulary) for _ in range(200)]
        one, many = list(base), list(base)
        one[rng.randrange(200)] = "changed"
        for at in range(10, 190, 20):
            many[at] = f"changed{at}"
        rows += [(4 * i + k, " ".join(ws)) for k, ws in enumerate((base, [w.upper() for w in base], one, many))]
    rows += [(100, None), (101, " "), (3, rows[3][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit(7))
    kept = simhash.keep_one(docs, shingle=2, distance=5, segments=6, similarity=0.8, verify=5)
    assert kept.columns == docs.columns
    ids = sorted(r["doc_id"] for r in kept.collect())
    assert len(set(ids)) == len(ids) and 100 in ids and 101 not in ids
    assert all(4 * i in ids and 4 * i + 1 not in ids and 4 * i + 3 in ids for i in range(20))
    assert sum(4 * i + 2 in ids for i in range(20)) <= 2
    none = simhash.keep_one(docs.where("false"), similarity=0.8)
    assert none.count() == 0


def test_alike_equals_sets_compared_directly(spark):
    texts = ["a b c d e f g", "a b c d e f h", "A b  c d e f g", "a b", "a b", "", "x y z a b c d e f g"]
    node = [simhash.text_class(t) for t in texts]
    sets = [set(simhash.shingle_set(t, 2).tolist()) for t in texts]
    pairs = {(node[i], node[j]): len(sets[i] & sets[j]) >= 0.7 * len(sets[i] | sets[j]) for i in range(7) for j in range(i)}
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    found = simhash.alike(spark.createDataFrame(list(pairs), "x long, y long"), docs, 0.7, 2)
    assert {tuple(r) for r in found.collect()} == {p for p, good in pairs.items() if good}


def alike_components(texts, similarity, shingle):
    """The least index of each text's component, over all pairs compared directly."""
    sets = [set(simhash.shingle_set(t, shingle).tolist()) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for j in range(len(texts)):
        for i in range(j):
            common = len(sets[i] & sets[j])
            if simhash.normal(texts[i]) == simhash.normal(texts[j]) or (common and common >= similarity * (len(sets[i]) + len(sets[j]) - common)):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(texts))]


def test_every_alike_pair_links(spark):
    """Short and long near copies, about the threshold and whatever their fingerprints, with a passage that most share."""
    rng = random.Random(5)
    say = lambda n: [f"w{rng.randrange(4000)}" for _ in range(n)]
    passage = say(40)
    texts = [None, "", "one two", "One  two", "one two three four five", " ".join(passage)]
    for k in range(45):
        base = say(rng.choice([6, 12, 30, 60, 150, 400])) + (passage if k % 3 else [])
        for _ in range(6):
            ws = list(base)
            for _ in range(rng.randint(0, max(1, len(ws) // 40))):
                ws[rng.randrange(len(ws))] = "changed" + str(rng.randrange(99))
            texts.append(" ".join(ws[rng.choice([0, 0, 1, 2, 5]) :]))
    rng.shuffle(texts)
    want = alike_components(texts, 0.8, 5)
    assert 60 < len(set(want)) < 200
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    of_doc, about = simhash.similar_groups(docs, 0.8, 5, 5, 6, 512, 2)
    got = dict(of_doc.join(about, "fp").select("doc_id", "component_id").collect())
    assert [got[i] for i in range(len(texts))] == want
    kept = simhash.keep_one(docs, shingle=2, distance=5, segments=6, similarity=0.8, verify=5)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want))


def test_one_bucket_of_many(spark, monkeypatch):
    """Rows of a bucket over the size that is filtered at once, in blocks, and whatever the order of shingles."""
    rng = random.Random(8)
    texts = []
    for i in range(700):
        ws = [f"p{j}" for j in range(40)]
        for _ in range(rng.choice([1, 1, 2])):
            ws[rng.randrange(40)] = f"x{i % 350}"
        texts.append(" ".join(ws))
    want = alike_components(texts, 0.8, 5)
    monkeypatch.setattr(simhash, "frequent", lambda docs, shingle: (np.zeros(0, np.int64), np.zeros(0, np.int64)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    of_doc, about = simhash.similar_groups(docs, 0.8, 5, 5, 6, 512, 2)
    got = dict(of_doc.join(about, "fp").select("doc_id", "component_id").collect())
    assert [got[i] for i in range(len(texts))] == want


def test_fitting_pairs_are_all_pairs_of_different_roots():
    rng = np.random.default_rng(4)
    for size, roots in ((1, 1), (9, 1), (40, 3), (300, 300), (1500, 20)):
        n = rng.integers(1, 60, size)
        at = rng.integers(0, 12, size)
        root = rng.integers(0, roots, size)
        got = [tuple(sorted(p)) for i, j in simhash.fitting_pairs(n, at, root, 0.8) for p in zip(i.tolist(), j.tolist(), strict=True)]
        x, y = np.nonzero(np.triu(simhash.fitting(n, at, n, at, 0.8) & (root[:, None] != root[None, :]), 1))
        assert sorted(got) == list(zip(x.tolist(), y.tolist(), strict=True))


def test_prefixes_of_alike_sets_meet():
    rng = np.random.default_rng(6)
    for _ in range(400):
        pool = rng.integers(-50, 50, rng.integers(1, 80))
        a, b = (np.unique(rng.choice(pool, len(pool))) for _ in range(2))
        values = np.unique(rng.integers(-50, 50, 30))
        order = values, rng.integers(2, 9, len(values))
        common = len(np.intersect1d(a, b))
        for similarity in (0.3, 0.5, 0.8, 1.0):
            if common >= similarity * (len(a) + len(b) - common):
                assert set(simhash.prefix(a, order, similarity)) & set(simhash.prefix(b, order, similarity))


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(9)
    for size in (0, 1, 15, 17, 90, 700):
        a = np.unique(rng.integers(-(1 << 63), 1 << 63, size))
        for other in (0, 3, 60, 900):
            b = np.unique(np.concatenate([a[: size * 9 // 10], rng.integers(-(1 << 63), 1 << 63, other)]))
            assert simhash.differing(simhash.sketch(a), simhash.sketch(b)) == simhash.differing(simhash.sketch(b), simhash.sketch(a)) <= len(np.setxor1d(a, b))


def test_a_pair_is_made_once_and_held_to_sketches(spark):
    """Classes that share many prefix shingles are one row, in the bucket of the first; those that sketches rule out are none."""
    rng = np.random.default_rng(5)
    base = rng.integers(-(2**62), 2**62, 60)
    sets = [base, np.concatenate([base[:57], rng.integers(-(2**62), 2**62, 3)]), np.concatenate([base[:30], rng.integers(-(2**62), 2**62, 30)])]
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    rows = [(i, len(s), simhash.prefix(np.unique(s), none, 0.8).tolist(), simhash.sketch(s)) for i, s in enumerate(sets)]
    assert len(set(rows[0][2]) & set(rows[1][2])) > 1
    distinct = spark.createDataFrame(rows, "fp long, n long, prefix array<long>, sketch binary")
    rooted = simhash.shared(distinct, 0.8).withColumn("root", F.col("fp")).select("s", "at", "n", "fp", "root")
    assert [tuple(r) for r in simhash.across(rooted, distinct, 0.8).collect()] == [(0, 1)]


def test_few_edges_give_the_components_of_many(spark):
    rng = random.Random(8)
    pairs = [(rng.randint(-(2**40), 2**40) * 2 + 1, 7)] + [(i, i + 1) for i in range(100, 400)] + [(rng.randint(1000, 2000), rng.randint(1000, 2000)) for _ in range(450)]
    edges = spark.createDataFrame(pairs, "a long, b long")
    want = sorted(map(tuple, connected_components(edges).collect()))
    assert sorted(map(tuple, connected_components(edges, few=1000).collect())) == want
    assert connected_components(edges.limit(0), few=1000).count() == 0
