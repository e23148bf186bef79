"""Graph reads, Cypher, text, vectors and traces on small graphs made by hand."""

import math
from functools import reduce

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph import schema
from weftgraph.functions import text as T
from weftgraph.functions import vector as V
from weftgraph.operators import graph, maintenance, traces
from weftgraph.plans import cypher, demo_graph
from weftgraph.plans.catalogue import QUERIES, SQL

P = "test-proj"


@pytest.fixture(scope="module")
def nodes(spark):
    rows = [
        (1, P, "src/a.ts", 1, 10, "File", "a.ts", "test.src.a", None, None),
        (2, P, "src/b.ts", 1, 15, "File", "b.ts", "test.src.b", None, None),
        (3, P, "src/a.ts", 1, 5, "Function", "main", "test.src.a.main", "function main()", None),
        (4, P, "src/b.ts", 1, 3, "Function", "helper", "test.src.b.helper", "function helper()", None),
        (5, P, "src/b.ts", 5, 8, "Function", "util", "test.src.b.util", None, None),
        (6, P, "src/a.ts", 8, 20, "Class", "Foo", "test.src.a.Foo", None, None),
    ]
    return spark.createDataFrame(rows, "id long, project string, file string, start_line int, end_line int, label string, name string, qualified string, signature string, doc string").cache()


@pytest.fixture(scope="module")
def edges(spark):
    rows = [(3, 4, "CALLS", "exact", 3), (3, 5, "CALLS", "reference", 4), (4, 5, "CALLS", "exact", 2), (1, 3, "DEFINES", "exact", 1), (2, 4, "DEFINES", "exact", 1), (2, 5, "DEFINES", "exact", 5), (1, 6, "DEFINES", "exact", 8)]
    return spark.createDataFrame([(i + 1, P, *r, 0) for i, r in enumerate(rows)], schema.EDGES.replace("confidence string, ", "confidence string, ")).cache()


def names(df, c="name"):
    return sorted(r[c] for r in df.collect())


def test_search_and_degree(nodes, edges):
    assert graph.search_nodes(nodes, edges, name_pattern="main").first()["label"] == "Function"
    assert graph.search_nodes(nodes, edges, label="Function").count() == 3
    assert {r.id: r.degree for r in graph.degree(edges).collect()} == {1: 2, 2: 2, 3: 3, 4: 3, 5: 3, 6: 1}
    assert names(graph.search_nodes(nodes, edges, min_degree=3, limit=2)) == ["helper", "main"]
    assert graph.search_nodes(nodes, edges, min_degree=3, limit=2, page_first=True).count() == 0


def test_trace(nodes, edges):
    hops = {(r.depth, r["from"], r["to"]) for r in graph.trace_path(nodes, edges, "main", "outbound", 2).collect()}
    assert hops == {(1, "test.src.a.main", "test.src.b.helper"), (1, "test.src.a.main", "test.src.b.util"), (2, "test.src.b.helper", "test.src.b.util")}
    assert {r["from"] for r in graph.trace_path(nodes, edges, "util", "inbound", 2).collect()} == {"test.src.a.main", "test.src.b.helper"}
    assert graph.trace_path(nodes, edges, "nobody").count() == 0


def test_trace_with_cycles_and_open_ends(spark, nodes, edges):
    more = edges.unionByName(spark.createDataFrame([(90, P, 5, 3, "CALLS", "exact", 1, 0), (91, P, 5, None, "USAGE", "usage", 2, 0), (92, P, 4, 4, "CALLS", "exact", 3, 0)], edges.schema))
    hops = graph.trace_path(nodes, more, "main", "outbound", 5).collect()
    assert sorted(r.depth for r in hops) == [1, 1, 2, 2, 2, 2]
    assert [r["to"] for r in hops if r.type == "USAGE"] == ["?"]
    assert {(r.src, r.dst) for r in graph.reach(more, 2, 2, "CALLS").collect()} == {(3, 5), (3, 3), (3, 4), (4, 3), (4, 4), (4, 5), (5, 4), (5, 5)}
    both = graph.trace_path(nodes, edges, "helper", "both", 2).collect()
    assert len([r for r in both if (r["from"], r["to"]) == ("test.src.a.main", "test.src.b.util")]) == 2


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("MATCH (a:Function) RETURN a.name, a.label", [("helper", "Function"), ("main", "Function"), ("util", "Function")]),
        ("MATCH (a:Function) WHERE a.name = 'main' RETURN a.name", [("main",)]),
        ("MATCH (a:Function) RETURN COUNT(*) AS total", [(3,)]),
        ("MATCH (a:Class) RETURN COUNT(a.name) AS nclasses", [(1,)]),
        ("OPTIONAL MATCH (a:Function)-[:CALLS]->(b:Class) WHERE a.name='helper' RETURN a.name", [("helper",)]),
        ("MATCH (a:Function)-[:CALLS*1..2]->(b:Function) WHERE a.name='main' RETURN b.name", [("helper",), ("util",)]),
        ("MATCH (a)-[:CALLS]->(b) WHERE b.name = 'util' AND a.qualified STARTS WITH 'test.src.a' RETURN a.name", [("main",)]),
        ("MATCH (a:Function) WHERE a.name ENDS WITH 'ER' RETURN a.name", [("helper",)]),
        ("MATCH (a:Function) WHERE a.name CONTAINS '%' RETURN a.name", []),
        ("MATCH (a)<-[:DEFINES]-(f:File) RETURN f.name, COLLECT(a.name) AS defined", [("a.ts", "Foo,main"), ("b.ts", "helper,util")]),
        ("MATCH (a)-[*]->(b) WHERE a.name = 'b.ts' RETURN b.name ORDER BY b.name DESC LIMIT 1", [("util",)]),
        ("MATCH (a:Function)", [("helper", "Function"), ("main", "Function"), ("util", "Function")]),
        ("MATCH (a)-[:CALLS]->(b)-[:CALLS]->(c) RETURN a.name, c.name", [("main", "util")]),
    ],
)
def test_cypher(nodes, edges, text, want):
    assert sorted(map(tuple, cypher.query(nodes, edges, text).collect())) == want


@pytest.mark.parametrize("text", ["RETURN a.name", "MATCH (a) RETURN b.name", "MATCH (a) WHERE a.name > 'x' RETURN a.name", "MATCH (a) RETURN a.nothing", "MATCH (a), (b) RETURN a.name", "MATCH (a:Function"])
def test_cypher_errors(nodes, edges, text):
    with pytest.raises(cypher.CypherError):
        cypher.query(nodes, edges, text)


def test_impact_and_structure(spark, nodes, edges):
    assert names(graph.entry_points(nodes, edges)) == ["main"]
    assert names(graph.dead_code(nodes, edges)) == ["Foo"]
    assert names(graph.dead_code(nodes, edges, include_functions=True)) == ["Foo", "main"]
    changed = spark.createDataFrame([("src/a.ts",)], "file string")
    radius = graph.blast_radius(nodes, edges, changed)
    assert names(radius) == ["Foo", "a.ts", "helper", "main", "util"]
    assert graph.blast_risk(radius).first()["risk"] == "low"
    assert {r.label: r.n for r in graph.count_by(nodes, "label").collect()} == {"File": 2, "Function": 3, "Class": 1}
    assert names(graph.packages(nodes), "package") == ["test.src", "test.src.a", "test.src.b"]
    report = graph.architecture(nodes, edges)
    assert report["hotspots"].first()["qualified"] == "test.src.a.main"
    assert {r.cluster for r in report["clusters"].collect()} == {"test.src"}
    assert report["clusters"].count() == 6
    assert graph.both_ends(nodes, edges).count() == 7
    assert {r.direction for r in graph.neighbourhood(nodes, edges, 1).collect()} == {"out"}
    assert names(graph.search_code(nodes, "HELPER")) == ["helper"]
    source = spark.createDataFrame([("src/a.ts", "function main() {\n  helper();\n}\n\nclass Foo {\n}\n")], "path string, content string")
    assert "function main" in graph.snippet(nodes, source, "test.src.a.main").first()["code"]
    assert graph.snippet(nodes, source, "test.src.b.util").first()["code"] is None
    projects = spark.createDataFrame([(P, "/tmp/test-repo")], "name string, root string")
    files = spark.createDataFrame([(P, "src/a.ts")], "project string, path string")
    assert tuple(graph.index_status(projects, files, nodes, edges, P).first()) == (P, "/tmp/test-repo", 1, 6, 7)
    assert graph.index_status(projects, files, nodes, edges, "other").count() == 0


def test_trace_boost(spark):
    nodes = spark.createDataFrame([(1, "a", "demo.a"), (2, "b", "demo.b"), (3, "c", "demo.c")], "id long, name string, qualified string")
    edges = spark.createDataFrame([(1, "demo", 1, 2, "CALLS", "reference", 2, 0)], schema.EDGES)
    trace = traces.ingest(spark, "demo", ["demo.a", "demo.b", "demo.c"], 1, 0)
    assert trace.first()["root"] == "demo.a"
    after = {(r.src, r.dst): (r.confidence, r.trace_hits) for r in traces.apply_traces(nodes, edges, trace, "demo").collect()}
    assert after == {(1, 2): ("exact", 1), (2, 3): ("exact", 1)}
    assert tuple(traces.trace_summary(nodes, edges, trace).first()) == (1, 1, 1)
    broken = traces.ingest(spark, "demo", ["demo.a", "no.such.symbol", "demo.b"], 2, 0)
    assert tuple(traces.trace_summary(nodes, edges, broken).first()) == (1, 0, 0)


@pytest.fixture(scope="module")
def words(spark):
    rows = [
        (1, "p", "Function", "getUserById", "demo.a.getUserById", "getUserById(id: number)", "finds a user by identifier", "a.ts"),
        (2, "p", "Class", "CacheStore", "demo.b.CacheStore", "class CacheStore", "in-memory cache", "b.ts"),
        (3, "p", "Function", "loginUser", "demo.auth.loginUser", "loginUser(user, pass)", "authenticate a user", "auth.ts"),
        (4, "p", "Function", "chargeCard", "demo.billing.chargeCard", "chargeCard(card)", "process a payment", "billing.ts"),
    ]
    return spark.createDataFrame(rows, "id long, project string, label string, name string, qualified string, signature string, doc string, file string").cache()


def test_tokenisers(spark):
    cases = {"getUserById": "get user by id", "parse_config": "parse config", "fetch-data": "fetch data", "RedisCacheStore": "redis cache store", "util.parseJSON": "util parse json", "getUser.byId": "get user by id", "": ""}
    df = spark.createDataFrame([(k,) for k in cases], "s string").select("s", T.normalize_identifier("s").alias("w"))
    assert {r.s: r.w for r in df.collect()} == cases
    assert all(" ".join(T.split_identifier_text(k)) == v for k, v in cases.items())
    assert T.match_query('getUserBy "exact phrase"') == '"getUserBy"* AND "exact"* AND "phrase"*'


def test_text_search(words):
    assert [r.id for r in T.search_text(words, "getUserById").collect()][0] == 1
    assert [r.id for r in T.bm25(words, "user").collect()] != []
    assert T.bm25(words, "...").count() == 0
    assert T.search_text(words, "ache").first()["source"] == "like"
    sig = T.normalize(T.signals(words, "user login auth", "demo"), T.SIGNALS)
    assert all(0 <= r[c] <= 1 for r in sig.collect() for c in T.SIGNALS)
    df = {r.term: r.df for r in T.doc_frequency(T.corpus_tokens(words)).collect()}
    assert df["demo"] == 4 and df["cache"] == 1


def test_text_is_read_once_where_it_lies(spark, words):
    """Search, signals and counts explode no text and agree with the inverted index, also where a phrase overlaps itself."""
    more = words.unionByName(spark.createDataFrame([(5, "p", "Type", "a", "a.a.a", "A a", "aa, a; a a á ab", "x"), (6, "p", "Type", None, None, None, None, None)], words.schema))
    for text in ("a.a", "a", "user", "a.a.a user", "get.user", "missing"):
        assert "Generate" not in _plan(T.bm25(more, text))
        assert {r.id: r.score for r in T.bm25(more, text).collect()} == {r.id: r.score for r in T.bm25(more, text, index=T.postings(more)).collect()}
    assert "Generate" not in _plan(T.signals(more, "user login", "demo"))
    want = {(r.col, r.term): (r.places, r.nodes) for r in T.postings(more).groupBy("col", "term").agg(F.count("*").alias("places"), F.countDistinct("id").alias("nodes")).collect()}
    assert {(r.col, r.term): (r.places, r.nodes) for r in T.term_counts(more).collect()} == want
    assert {(r.col, r.term): (r.places, r.nodes) for r in T.term_counts(more.unionByName(more)).collect()} == {k: (2 * p, n) for k, (p, n) in want.items()}
    assert "Generate" not in _plan(T.term_counts(more))


def hash32(s):
    h = 2166136261
    for ch in s:
        h ^= ord(ch)
        signed = h - (1 << 32) if h >= 1 << 31 else h
        h = int(math.fmod(float(signed) * 16777619.0, 4294967296.0))
        h = h + (1 << 32) if h < 0 else h
    return h


def test_hash_and_embedding(spark, words):
    known = {"a": 3826002220, "get": 1210461272, "user": 1618501360, "parse": 530894916}
    got = spark.createDataFrame([(k,) for k in known], "s string").select("s", V.hash32(F.col("s")).alias("h"))
    assert {r.s: r.h for r in got.collect()} == known == {k: hash32(k) for k in known}
    docs = spark.createDataFrame([(1, "getUser by id"), (2, ""), (3, "getUser by id")], "id long, t string")
    vec = {r.id: r.vec for r in V.embed(docs, "id", F.col("t")).collect()}
    assert vec[1] == vec[3] and len(vec[1]) == 256
    assert abs(sum(x * x for x in vec[1]) - 1) < 1e-6 and set(vec[2]) == {0.0}
    want = [0.0] * 256
    for w in ("get", "user", "by", "id"):
        for g, size in [(w, 1 + min(len(w), 4)), *((w[i : i + 2], 0.5) for i in range(len(w) - 1))]:
            h = hash32(g)
            want[h % 256] += size if h % 2 == 0 else -size
    norm = math.sqrt(sum(x * x for x in want))
    assert all(abs(a - b / norm) < 1e-12 for a, b in zip(vec[1], want, strict=True))
    back = V.embed(docs, "id", F.col("t")).select(F.array_max(F.zip_with("vec", V.dequantize(V.quantize(F.col("vec"))), lambda a, b: F.abs(a - b))).alias("e"))
    assert all(r.e < 0.01 for r in back.collect())


def test_semantic_query(words):
    index = V.build_index(words)
    hits = [r.id for r in V.semantic_query(words, index, "find user by id").collect()]
    assert hits.index(1) < hits.index(2)
    with_signals = V.semantic_query(words, index, "user login auth", with_signals=True, project="demo").collect()
    assert with_signals[0]["id"] == 3
    with pytest.raises(ValueError, match="no vectors"):
        V.semantic_query(words, index.limit(0), "x")


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_embedding_has_no_hot_key(spark):
    """Words and pairs of letters that all texts share are no key of a join; texts of one id add up wherever batches end, and values are those of columns."""
    rows = [(i // 2, "p", f"order_{i // 2} sales é") for i in range(4 * V.ROWS)] + [(None, "p", None), (-1, "p", None)]
    df = spark.createDataFrame(rows, "id long, project string, t string")
    made = V.embed(df, "id", F.col("t"), "project")
    assert "Join" not in _plan(made) and "Generate" not in _plan(made)
    got = {r.id: r.vec for r in made.collect()}
    assert made.columns == ["id", "project", "vec"] and len(got) == made.count() == 2 * V.ROWS + 2 and set(got[-1]) == {0.0}
    want = [0.0] * 256
    for w in ("order", "77", "sales", "é"):
        for g, size in [(w, 1 + min(len(w), 4)), *((w[i : i + 2], 0.5) for i in range(len(w) - 1))]:
            want[hash32(g) % 256] += 2 * size if hash32(g) % 2 == 0 else -2 * size
    norm = math.sqrt(sum(x * x for x in want))
    assert got[77] == [x / norm for x in want]
    small = V.embed(df, "id", F.col("t"), quantized=True)
    steps = made.select("id", V.quantize(F.col("vec")).alias("a")).join(small.select("id", F.col("vec").alias("b")), "id")
    assert steps.where("a = b").count() == steps.count() == 2 * V.ROWS + 1


def test_index_and_cosines_move_no_vectors(spark, words):
    """A vector stays in the task that made it; cosines are those of columns to the last bit."""
    index = V.build_index(words)
    assert "Join" not in _plan(index) and index.columns == ["node_id", "project", "vec"]
    q = V.query_vector(spark, "find user by id")
    odd = spark.createDataFrame([(7, "p", [1, -3]), (8, "p", []), (9, "p", None)], "node_id long, project string, vec array<tinyint>")
    for vectors in (index, index.unionByName(odd), odd.where("node_id = 8")):
        want = vectors.select("node_id", V.cosine(V.dequantize(F.col("vec")), F.array(*[F.lit(x) for x in q])).alias("c"))
        assert {r.id: r.cos for r in V.cosines(vectors, q).collect()} == {r.node_id: r.c for r in want.collect()}


def test_upsert_and_prune(spark, nodes, edges):
    projects = spark.createDataFrame([("p", "/a", 1, 1, 10, 10)], schema.PROJECTS)
    new = spark.createDataFrame([("p", "/b", 0, 0, 20, 20), ("q", "/q", 0, 0, 20, 20)], schema.PROJECTS)
    after = {r.name: (r.root, r.node_count, r.created_at, r.updated_at) for r in maintenance.upsert(projects, new, ["name"], keep=["created_at", "node_count"]).collect()}
    assert after == {"p": ("/b", 1, 10, 20), "q": ("/q", 0, 20, 20)}
    files = nodes.select("project", F.col("file").alias("path")).distinct()
    gone = spark.createDataFrame([(P, "src/b.ts")], "project string, path string")
    n, e, f = maintenance.prune(nodes, edges, files, gone)
    assert names(n) == ["Foo", "a.ts", "main"]
    assert {(r.src, r.dst) for r in e.collect()} == {(3, None), (1, 3), (1, 6)}
    assert f.count() == 1
    adr = spark.createDataFrame([], schema.ADR)
    adr = maintenance.update_adr(adr, "p", "one", "text", 1)
    adr = maintenance.update_adr(adr, "p", "one", "more", 2)
    row = maintenance.get_adr(adr, "p", "one").first()
    assert (row.title, row.content, row.created_at, row.updated_at) == ("one", "more", 1, 2)


def test_every_query_has_a_name_and_sql():
    assert set(SQL) <= set(QUERIES)
    assert set(QUERIES) - set(SQL) == {"hybrid_search"}


def test_hybrid_search_ranks_all_code(spark, sf_dir, monkeypatch):
    """The nodes it searches and embeds are all those with a label of code."""
    given = []
    monkeypatch.setattr(V, "semantic_query", lambda nodes, index, *a, **k: given.append((nodes, index)) or nodes)
    QUERIES["hybrid_search"](spark, sf_dir)
    nodes, index = given[0]
    want = {r.id for r in demo_graph.nodes(spark, sf_dir).collect() if r.label in schema.CODE_LABELS}
    assert {r.id for r in nodes.collect()} == want == {r.node_id for r in index.select("node_id").collect()}


def test_cypher_is_not_read_past(nodes, edges):
    """Clauses that are not supported raise, unless asked to be passed over; DISTINCT counts once."""
    with pytest.raises(cypher.CypherError):
        cypher.query(nodes, edges, "MATCH (a:Function) WITH a LIMIT 1 RETURN a.name")
    assert cypher.query(nodes, edges, "MATCH (a:Function) WITH a LIMIT 1 RETURN a.name", lenient=True).count() == 3
    assert cypher.query(nodes, edges, "MATCH (a) RETURN COUNT(DISTINCT a.label) AS n").first()["n"] == 3


def test_walks_begin_at_their_sources(spark, edges):
    calls = edges.where("type = 'CALLS'")
    all_pairs = {(r.src, r.dst) for r in graph.reach(calls, 1, 3).collect()}
    some = graph.reach(calls, 1, 3, sources=spark.createDataFrame([(4,)], "id long"))
    assert {(r.src, r.dst) for r in some.collect()} == {p for p in all_pairs if p[0] == 4} != set()


def test_calls_are_made_distinct_where_they_are(spark, nodes, edges):
    """A called node meets the nodes once, however often it is called, and never by way of the driver; a walk makes distinct only what its frontier reaches."""
    many = reduce(DataFrame.unionByName, [edges] * 3)
    for f in (lambda e: graph.dead_code(nodes, e), lambda e: graph.dead_code(nodes, e, include_functions=True), lambda e: graph.entry_points(nodes, e)):
        assert sorted(f(many).collect()) == sorted(f(edges).collect())
        for line in (x for x in _plan(f(many)).splitlines() if "Join" in x):
            assert "LeftAnti" in line and "strategy=merge" in line
        assert "Aggregate" in _plan(f(many))
    hops = graph.trace_path(nodes, edges, "main", "both", 2)
    assert hops.count() == 6  # an edge with two ends reached is two hops
    assert graph.trace_path(nodes, many, "main", "both", 2).count() == 18
