"""Queries of extraction, resolution, stores and streams over source files made of the table part.

Twenty parts make a file, in turn of Python, TypeScript and Go. Each part is a
function that calls the next part's, so that a file's last call leads to the
next file. What must be found follows from the table by SQL.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vector as V
from ..operators import graph, maintenance, resolve, traces
from ..operators.lineage import checkpoint_folder, merged
from ..schema import ADR
from ..sources import extract, files, snapshot
from ..streaming import incremental
from . import demo_graph
from .catalogue import documents, event_traces, query, text_nodes

PROJECT = "shop"
#: Parts whose files one task makes.
PARTS = 20_000
_PARTS = "SELECT p_partkey AS p, p_partkey // 20 AS k, lead(p_partkey) OVER (ORDER BY p_partkey) AS q, row_number() OVER (PARTITION BY p_partkey // 20 ORDER BY p_partkey) - 1 AS i FROM part"
#: What the files hold, for SQL: parts, and files with their first and number of parts.
SQL_FILES = (
    f"WITH parts AS ({_PARTS}), mods AS (SELECT k, min(p) AS first, count(*) AS n, CASE k % 3 WHEN 0 THEN 'python' WHEN 1 THEN 'typescript' ELSE 'go' END AS lang, "
    "'pkg' || k % 7 || '/mod' || k || CASE k % 3 WHEN 0 THEN '.py' WHEN 1 THEN '.ts' ELSE '.go' END AS path, "
    "CASE k % 3 WHEN 0 THEN 'pkg' || k % 7 || '.mod' || k WHEN 1 THEN 'typescript.pkg' || k % 7 || '.mod' || k ELSE 'pkg' || k % 7 || '.mod' || k END AS module FROM parts GROUP BY k), "
    "funs AS (SELECT m.*, p, q, i, CAST(CASE WHEN k % 3 = 0 THEN 5 + 2 * i ELSE 5 + i END AS INTEGER) AS sl FROM parts JOIN mods m USING (k)), "
)


def source_files(spark: SparkSession, d: str) -> DataFrame:
    """(project, path, lang, content) of about twenty functions each."""
    part = demo_graph.read(spark, d, "part").select(F.col("p_partkey").alias("p"), F.floor(F.col("p_partkey") / 20).alias("k"))
    lang = F.expr("CASE k % 3 WHEN 0 THEN 'python' WHEN 1 THEN 'typescript' ELSE 'go' END")
    each = part.withColumn("lang", lang)
    name, following = F.concat(F.lit("f"), F.col("p").cast("string")), F.concat(F.lit("f"), (F.col("p") + 1).cast("string"))
    line = F.when(F.col("lang") == "python", F.concat(F.lit("def "), name, F.lit("(x):\n    return "), following, F.lit("(x)")))
    line = line.when(F.col("lang") == "typescript", F.concat(F.lit("function "), name, F.lit("(x) { return "), following, F.lit("(x); }")))
    line = line.otherwise(F.concat(F.lit("func "), name, F.lit("(x int) int { return "), following, F.lit("(x) }")))
    # in proportion to the table, as Spark would join small partitions whose files and facts are large
    each = each.repartition(max(1, -(-part.count() // PARTS)), "k")
    # at most twenty lines a file
    body = each.groupBy("k", "lang").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", line.alias("line")))), lambda x: x["line"]), "\n").alias("body"), F.min("p").cast("string").alias("first"))
    k = F.col("k").cast("string")
    head = F.when(F.col("lang") == "python", F.concat(F.lit("import os\nfrom base import Root as Top\nclass Kind"), k, F.lit("(Top):\n    def start(self):\n        return os.getcwd()\n")))
    head = head.when(F.col("lang") == "typescript", F.concat(F.lit('import { util } from "./util";\nclass Kind'), k, F.lit(' extends Top {\n  start() { return util.run(); }\n}\napp.get("/k'), k, F.lit('", f'), F.col("first"), F.lit(");\n")))
    head = head.otherwise(F.concat(F.lit("package mod"), k, F.lit('\nimport "fmt"\ntype Kind'), k, F.lit(" struct { n int }\nfunc (k *Kind"), k, F.lit(") start() { fmt.Println(1) }\n\n")))
    suffix = F.expr("CASE k % 3 WHEN 0 THEN '.py' WHEN 1 THEN '.ts' ELSE '.go' END")
    path = F.concat(F.lit("pkg"), (F.col("k") % 7).cast("string"), F.lit("/mod"), k, suffix)
    return body.select(F.lit(PROJECT).alias("project"), path.alias("path"), "lang", F.concat(head, F.col("body"), F.lit("\n")).alias("content"))


def _facts(spark: SparkSession, d: str) -> DataFrame:
    return extract.extract(source_files(spark, d))


def _graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    found = source_files(spark, d)
    return resolve.build(found, extract.extract(found))


def _named_edges(spark: SparkSession, d: str, *types: str) -> DataFrame:
    nodes, edges = _graph(spark, d)
    a, b = nodes.select(F.col("id").alias("src"), F.col("qualified").alias("from")), nodes.select(F.col("id").alias("dst"), F.col("qualified").alias("to"))
    return edges.where(F.col("type").isin(*types)).join(merged(a), "src").join(merged(b), "dst", "left").select("type", "from", "to", "confidence", "site_line")


# Extraction

_DEFINES = (
    "defs AS (SELECT path, lang, module, 'f' || p AS name, 'Function' AS label, 'f' || p AS target_name, sl, CASE WHEN lang = 'python' THEN sl + 1 ELSE sl END AS el FROM funs "
    "UNION ALL SELECT path, lang, module, 'Kind' || k, 'Class', 'Kind' || k, CASE lang WHEN 'typescript' THEN 1 ELSE 2 END, CASE lang WHEN 'python' THEN 4 WHEN 'typescript' THEN 3 ELSE 2 END FROM mods "
    "UNION ALL SELECT path, lang, module, 'start', 'Method', CASE lang WHEN 'go' THEN 'start' ELSE 'Kind' || k || '.start' END, CASE lang WHEN 'typescript' THEN 2 ELSE 3 END, CASE lang WHEN 'python' THEN 4 WHEN 'typescript' THEN 2 ELSE 3 END FROM mods)"
)


@query("extract_defines", f"{SQL_FILES}{_DEFINES} SELECT path, name, label, target_name, CAST(sl AS INTEGER) AS sl, CAST(el AS INTEGER) AS el FROM defs")
def _(spark, d):
    return _facts(spark, d).where("kind = 'define'").select("path", "name", "label", "target_name", "sl", "el")


@query("extract_imports", f"{SQL_FILES}x AS (SELECT path, unnest(CASE lang WHEN 'python' THEN ['os', 'base'] WHEN 'typescript' THEN ['./util'] ELSE ['fmt'] END) AS source FROM mods) SELECT path, source FROM x")
def _(spark, d):
    return _facts(spark, d).where("kind = 'import'").select("path", "source")


@query("extract_calls", f"{SQL_FILES}x AS (SELECT path, 'f' || (p + 1) AS target, CASE lang WHEN 'python' THEN sl + 1 ELSE sl END AS sl FROM funs UNION ALL SELECT path, CASE lang WHEN 'python' THEN 'os.getcwd' WHEN 'typescript' THEN 'util.run' ELSE 'fmt.Println' END, CASE lang WHEN 'python' THEN 4 WHEN 'typescript' THEN 2 ELSE 3 END FROM mods UNION ALL SELECT path, 'app.get', 4 FROM mods WHERE lang = 'typescript') SELECT path, target, CAST(sl AS INTEGER) AS sl FROM x")
def _(spark, d):
    return _facts(spark, d).where("kind = 'call'").select("path", F.col("target_name").alias("target"), "sl")


@query("extract_inherits", f"{SQL_FILES}x AS (SELECT path, 'Kind' || k AS name, 'Top' AS base FROM mods WHERE lang <> 'go') SELECT * FROM x")
def _(spark, d):
    return _facts(spark, d).where("kind = 'inherit'").select("path", "name", "base")


@query("extract_routes", f"{SQL_FILES}x AS (SELECT path, 'GET' AS method, '/k' || k AS route, 'f' || first AS handler FROM mods WHERE lang = 'typescript') SELECT * FROM x")
def _(spark, d):
    return _facts(spark, d).where("kind = 'route'").select("path", "method", F.col("path_route").alias("route"), "handler")


@query("module_specs", f"{SQL_FILES}x AS (SELECT path, lang, module FROM mods) SELECT * FROM x")
def _(spark, d):
    return _facts(spark, d).select("path", "lang", F.col("module_spec").alias("module")).distinct()


# Resolution


@query("index_nodes", f"{SQL_FILES}{_DEFINES}, x AS (SELECT label, name, module || '.' || target_name AS qualified, path AS file, sl + 1 AS start_line, el + 1 AS end_line FROM defs UNION ALL SELECT 'Route', 'GET /k' || k, module || '.GET /k' || k, path, 5, 5 FROM mods WHERE lang = 'typescript' UNION ALL SELECT 'File', split_part(path, '/', 2), '{PROJECT}.' || replace(path, '/', '.'), path, 1, CASE lang WHEN 'python' THEN 6 + 2 * n ELSE 6 + n END FROM mods) SELECT label, name, qualified, file, CAST(start_line AS INTEGER) AS start_line, CAST(end_line AS INTEGER) AS end_line FROM x")
def _(spark, d):
    return _graph(spark, d)[0].select("label", "name", "qualified", "file", "start_line", "end_line")


_FILE_OF = f"'{PROJECT}.' || replace(path, '/', '.')"


@query("index_defines", f"{SQL_FILES}{_DEFINES} SELECT 'DEFINES' AS type, {_FILE_OF} AS \"from\", module || '.' || target_name AS \"to\", 'exact' AS confidence, CAST(sl + 1 AS INTEGER) AS site_line FROM defs")
def _(spark, d):
    return _named_edges(spark, d, "DEFINES")


_START = "module || CASE lang WHEN 'go' THEN '' ELSE '.Kind' || k END || '.start'"


@query(
    "index_calls",
    f"{SQL_FILES}x AS (SELECT a.module || '.f' || a.p AS \"from\", b.module || '.f' || b.p AS \"to\", CASE WHEN a.k = b.k THEN 'exact' ELSE 'reference' END AS confidence, CASE a.lang WHEN 'python' THEN a.sl + 2 ELSE a.sl + 1 END AS site_line FROM funs a JOIN funs b ON b.p = a.p + 1 "
    f"UNION ALL SELECT {_START}, NULL, 'usage', CASE lang WHEN 'python' THEN 5 WHEN 'typescript' THEN 3 ELSE 4 END FROM mods UNION ALL SELECT {_FILE_OF}, NULL, 'usage', 5 FROM mods WHERE lang = 'typescript' "
    "UNION ALL SELECT module || '.GET /k' || k, module || '.f' || first, 'exact', 5 FROM mods WHERE lang = 'typescript') SELECT 'CALLS' AS type, \"from\", \"to\", confidence, CAST(site_line AS INTEGER) AS site_line FROM x",
)
def _(spark, d):
    return _named_edges(spark, d, "CALLS", "CALL_REFERENCE")


@query("index_imports", f"{SQL_FILES}x AS (SELECT path, unnest(CASE lang WHEN 'python' THEN [1, 2] WHEN 'typescript' THEN [1] ELSE [2] END) AS line FROM mods) SELECT 'IMPORTS' AS type, {_FILE_OF} AS \"from\", CAST(NULL AS VARCHAR) AS \"to\", 'usage' AS confidence, CAST(line AS INTEGER) AS site_line FROM x")
def _(spark, d):
    return _named_edges(spark, d, "IMPORTS")


@query("index_inherits", f"{SQL_FILES}x AS (SELECT * FROM mods WHERE lang <> 'go') SELECT 'INHERITS' AS type, module || '.Kind' || k AS \"from\", CAST(NULL AS VARCHAR) AS \"to\", 'usage' AS confidence, CAST(CASE lang WHEN 'python' THEN 3 ELSE 2 END AS INTEGER) AS site_line FROM x")
def _(spark, d):
    return _named_edges(spark, d, "INHERITS")


@query("index_routes", f"{SQL_FILES}x AS (SELECT * FROM mods WHERE lang = 'typescript') SELECT 'HANDLES' AS type, {_FILE_OF} AS \"from\", module || '.GET /k' || k AS \"to\", 'exact' AS confidence, CAST(5 AS INTEGER) AS site_line FROM x")
def _(spark, d):
    return _named_edges(spark, d, "HANDLES")


@query("route_nodes", f"{SQL_FILES}x AS (SELECT 'GET /k' || k AS name, path AS file, CAST(5 AS INTEGER) AS start_line FROM mods WHERE lang = 'typescript') SELECT * FROM x")
def _(spark, d):
    return graph.routes(_graph(spark, d)[0]).select("name", "file", "start_line")


@query("enclosing_definition", f"{SQL_FILES}x AS (SELECT path, CAST(CASE WHEN lang = 'python' THEN sl + 1 ELSE sl END AS INTEGER) AS sl, module || '.f' || p AS inside FROM funs UNION ALL SELECT path, CASE lang WHEN 'python' THEN 4 WHEN 'typescript' THEN 2 ELSE 3 END, {_START} FROM mods UNION ALL SELECT path, 4, NULL FROM mods WHERE lang = 'typescript') SELECT * FROM x")
def _(spark, d):
    facts = _facts(spark, d)
    spans = facts.where("kind = 'define'").select("project", "path", "sl", "sc", "el", "ec", F.concat_ws(".", "module_spec", "target_name").alias("id"))
    points = facts.where("kind = 'call'").select("project", "path", "ord", "sl", "sc")
    return resolve.enclosing(points, spans, ["project", "path"]).select("path", "sl", "inside")


_NAMES = [
    ("javascript", "helper", "reference", "helper"), ("javascript", "console", "reference", "console"), ("python", "os", "reference", "os"), ("python", "print", "reference", "builtins.print"), ("java", "List", "exact", "java.util.List"),
    ("java", "String", "exact", "java.lang.own.String"), ("java", "Other", "reference", "p.q.Other"), ("go", "len", "reference", "builtin.len"), ("rust", "fmt", "exact", "std::fmt"), ("rust", "Thing", "reference", "a::b::Thing"), ("csharp", "Service", "exact", "MyCorp.Lib.Service"),
    ("python", "missing", "none", None), ("any", "myFunc", "exact", "pkg.myFunc"),
]
_IMPORTS = [("javascript", "helper", "./helper", 0), ("python", "os", "os", 0), ("java", "List", "java.util.List", 0), ("java", "*", "p.q.*", 1), ("rust", "fmt", "std::fmt", 0), ("rust", "*", "a::b::*", 1), ("csharp", "Service", "MyCorp.Lib.Service", 0)]


@query("resolve_identifiers", "SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', '{c}', {'NULL' if e is None else repr(e)})" for a, b, c, e in _NAMES) + ") v(lang, name, kind, qualified)")
def _(spark, d):
    uses = spark.createDataFrame([("p", lang, lang, name) for lang, name, _, _ in _NAMES], "project string, path string, lang string, name string")
    symbols = spark.createDataFrame([("p", "any", "myFunc", "pkg.old", 0), ("p", "any", "myFunc", "pkg.myFunc", 1), ("p", "java", "String", "java.lang.own.String", 0)], "project string, path string, name string, qualified string, ord int")
    imports = spark.createDataFrame([("p", *x) for x in _IMPORTS], "project string, path string, name string, source string, ord int")
    return resolve.resolve_identifiers(uses, symbols, imports).select("lang", "name", "kind", "qualified")


@query("scope_lookup", f"{SQL_FILES}x AS (SELECT path, 'x' AS name, sl, module || '.f' || p || '.x' AS qualified FROM funs UNION ALL SELECT path, 'x', 2, 'import:x' FROM mods) SELECT path, name, CAST(sl AS INTEGER) AS sl, qualified FROM x")
def _(spark, d):
    """A parameter x hides an import x of its file within its function alone."""
    facts = _facts(spark, d)
    keys = ["project", "path"]
    own = facts.where("kind = 'define' AND label = 'Function'").select(*keys, F.lit("x").alias("name"), F.concat_ws(".", "module_spec", "name", F.lit("x")).alias("qualified"), "sl", "sc", "el", "ec", F.lit(1).alias("ord"))
    of_file = facts.select(*keys).distinct()
    imported = of_file.select(*keys, F.lit("x").alias("name"), F.lit("import:x").alias("qualified"), F.lit(0).alias("sl"), F.lit(0).alias("sc"), F.lit(1 << 30).alias("el"), F.lit(0).alias("ec"), F.lit(0).alias("ord"))
    uses = own.select(*keys, "name", "sl", (F.col("sc") + 1).alias("sc")).unionByName(of_file.select(*keys, F.lit("x").alias("name"), F.lit(2).alias("sl"), F.lit(0).alias("sc")))
    return resolve.lookup(uses, own.unionByName(imported)).select("path", "name", "sl", "qualified")


# Reading the graph


@query("snippet", f"{SQL_FILES}x AS (SELECT module || '.f' || p AS qualified, path AS file, CAST(sl + 1 AS INTEGER) AS start_line, CAST(sl + 2 AS INTEGER) AS end_line, 'def f' || p || '(x):' || chr(10) || '    return f' || (p + 1) || '(x)' AS code FROM funs WHERE p = 7) SELECT * FROM x")
def _(spark, d):
    return graph.snippet(_graph(spark, d)[0], source_files(spark, d), "pkg0.mod0.f7")


@query("start_node", "SELECT label, qualified FROM nodes WHERE name = 'red widget' OR qualified = 'red widget' ORDER BY id LIMIT 1", True)
def _(spark, d):
    return graph.start_node(demo_graph.nodes(spark, d), "red widget").select("label", "qualified")


@query("nodes_by_id", "SELECT id, qualified FROM nodes WHERE id IN (5000000010, 1000000001, 7)", True)
def _(spark, d):
    return graph.lookup(demo_graph.nodes(spark, d), [5_000_000_010, 1_000_000_001, 7]).select("id", "qualified")


@query("architecture", f"{SQL_FILES}x AS (SELECT 'languages' AS part, split_part(path, '.', 2) AS item FROM mods UNION ALL SELECT 'routes', 'GET /k' || k FROM mods WHERE lang = 'typescript' UNION ALL SELECT 'entry_points', module || '.f0' FROM mods WHERE k = 0) SELECT part, item, count(*) AS n FROM x WHERE part <> 'languages' GROUP BY part, item UNION ALL SELECT 'languages', l.ext, CAST(l.n AS BIGINT) FROM (SELECT split_part(path, '.', 2) AS ext, sum(n + 3 + CASE lang WHEN 'typescript' THEN 1 ELSE 0 END) AS n FROM mods GROUP BY 1) l")
def _(spark, d):
    nodes, edges = _graph(spark, d)
    a = graph.architecture(nodes, edges)
    one = lambda part, item: a[part].select(F.lit(part).alias("part"), F.col(item).alias("item"), F.lit(1).cast("long").alias("n"))
    entry = one("entry_points", "qualified")
    return a["languages"].select(F.lit("languages").alias("part"), F.col("language").alias("item"), F.col("n_nodes").alias("n")).unionByName(one("routes", "name")).unionByName(entry)


# Stores


def _tables(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """All tables of a store with two projects, `shop` of the source files and `docs` of the documents."""
    nodes, edges = _graph(spark, d)
    text = text_nodes(spark, d).select("id", F.lit("docs").alias("project"), F.concat(F.col("name"), F.lit(".md")).alias("file"), *[F.lit(1).alias(c) for c in ("start_line", "start_col", "end_line", "end_col")], F.lit("Document").alias("label"), "name", "qualified", "signature", "doc")
    out = snapshot.empty(spark)
    out["projects"] = spark.createDataFrame([(PROJECT, "/shop", 0, 0, 1, 1), ("docs", "/docs", 0, 0, 1, 1)], out["projects"].schema)
    out["nodes"], out["edges"] = nodes.unionByName(text), edges
    out["files"] = source_files(spark, d).select("project", "path", "lang", files.content_hash("content").alias("hash"), F.lit(0).cast("long").alias("mtime"), F.lit(1).cast("long").alias("indexed_at"))
    return out


def _sizes(tables: dict[str, DataFrame]) -> DataFrame:
    parts = [df.groupBy(F.lit(name).alias("part"), F.col("name" if name == "projects" else "project").alias("project")).agg(F.count("*").alias("n")) for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


_COUNTS = (
    f"{SQL_FILES}sizes AS (SELECT 'files' AS part, count(*) AS n FROM mods UNION ALL SELECT 'nodes', (SELECT count(*) FROM part) + (SELECT sum(3 + CASE lang WHEN 'typescript' THEN 1 ELSE 0 END) FROM mods) "
    "UNION ALL SELECT 'projects', 1 UNION ALL SELECT 'edges', 2 * (SELECT count(*) FROM part) - 1 + (SELECT sum(CASE lang WHEN 'python' THEN 2 + 1 + 2 + 1 WHEN 'typescript' THEN 2 + 2 + 1 + 1 + 2 ELSE 2 + 1 + 1 END) FROM mods))"
)


@query("delete_project", "SELECT 'projects' AS part, 'docs' AS project, CAST(1 AS BIGINT) AS n UNION ALL SELECT 'nodes', 'docs', count(*) FROM documents")
def _(spark, d):
    return _sizes(maintenance.delete_project(_tables(spark, d), PROJECT))


def _scratch(spark: SparkSession) -> str:
    return f"{checkpoint_folder(spark)}/{uuid.uuid4().hex}"


@query("snapshot_round_trip", f"{_COUNTS} SELECT part, 'copy' AS project, CAST(n AS BIGINT) AS n FROM sizes")
def _(spark, d):
    """One project is exported, and imported into an empty store under another name."""
    folder = _scratch(spark)
    snapshot.export(_tables(spark, d), folder, 5, project=PROJECT)
    if snapshot.header(spark, folder)["projects"] != [PROJECT]:
        raise ValueError("the header names other projects")
    return _sizes(snapshot.import_(snapshot.empty(spark), snapshot.load(spark, folder), project="copy", source=PROJECT))


@query("snapshot_merge", f"{_COUNTS} SELECT part, '{PROJECT}' AS project, CAST(n AS BIGINT) AS n FROM sizes UNION ALL SELECT 'projects', 'docs', 1 UNION ALL SELECT 'nodes', 'docs', count(*) FROM documents")
def _(spark, d):
    """What is there already is not added again; what was missing comes back."""
    folder = _scratch(spark)
    tables = _tables(spark, d)
    snapshot.export(tables, folder, 5)
    partly = tables | {"nodes": tables["nodes"].where("label <> 'Function'"), "edges": tables["edges"].where("type <> 'CALLS'")}
    return _sizes(snapshot.import_(partly, snapshot.load(spark, folder)))


@query("orphan_vectors", "SELECT vec_id AS node_id FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents WHERE doc_id % 3 <> 0)")
def _(spark, d):
    vectors = demo_graph.read(spark, d, "embeddings").select(F.col("vec_id").alias("node_id"), F.lit("docs").alias("project"), V.quantize(F.col("embedding")).alias("vec"))
    return maintenance.drop_orphans(vectors, documents(spark, d).where("doc_id % 3 <> 0").select(F.col("doc_id").alias("id"))).select("node_id")


@query("decision_records", "SELECT source AS project, 'doc_' || doc_id AS id, CASE WHEN doc_id = 3 THEN 'new text' ELSE lang END AS content, CAST(CASE WHEN doc_id = 3 THEN 9 ELSE 1 END AS BIGINT) AS updated_at, CAST(1 AS BIGINT) AS created_at FROM documents WHERE source = (SELECT source FROM documents WHERE doc_id = 3)")
def _(spark, d):
    """A record is changed, then those of its project are listed."""
    docs = documents(spark, d)
    id = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"))
    adr = docs.select(F.col("source").alias("project"), id.alias("id"), id.alias("title"), F.col("lang").alias("content"), F.lit(1).cast("long").alias("created_at"), F.lit(1).cast("long").alias("updated_at")).select([x.split()[0] for x in ADR.split(", ")])
    project = docs.where("doc_id = 3").first()["source"]
    return maintenance.list_adr(maintenance.update_adr(adr, project, "doc_3", "new text", 9), project).select("project", "id", "content", "updated_at", "created_at")


@query("trace_ingest", "SELECT 'a>b>c' AS calls, 'a' AS root, CAST(2 AS BIGINT) AS pairs")
def _(spark, d):
    row = traces.ingest(spark, "p", ["a", "b", "c"], 1, 5)
    again = traces.ingest_json(row.select("root", F.to_json("calls").alias("calls")).withColumnRenamed("calls", "text"), "text")
    return again.select(F.array_join("calls", ">").alias("calls"), "root").join(F.broadcast(traces.pairs(row).agg(F.sum("n").alias("pairs"))), F.lit(True))


# Streams


@query("watch_index", f"{SQL_FILES}x AS (SELECT 'File' AS label, k FROM mods UNION ALL SELECT 'Class', k FROM mods UNION ALL SELECT 'Method', k FROM mods UNION ALL SELECT 'Function', k FROM funs UNION ALL SELECT 'Route', k FROM mods WHERE lang = 'typescript') SELECT label, count(*) AS n FROM x WHERE k % 5 <> 4 GROUP BY label")
def _(spark, d):
    """Files come in two batches, the second with new contents of some of the first; some are gone from disk at the end."""
    folder = _scratch(spark)
    found = source_files(spark, d).withColumn("k", F.regexp_extract("path", r"mod(\d+)", 1).cast("long"))
    columns = "project string, path string, lang string, content string"
    names = [x.split()[0] for x in columns.split(", ")]
    state = incremental.GraphState(spark, f"{folder}/state")
    for old in (True, False):
        batch = found.withColumn("content", F.concat(F.col("content"), F.lit("\n# old\n"))) if old else found
        batch.where("k % 2 = 0" if old else "true").select(names).write.mode("append").parquet(f"{folder}/inbox")
        stream = spark.readStream.schema(columns).parquet(f"{folder}/inbox")
        incremental.watch(stream, state, f"{folder}/progress", on_disk=lambda: found.where("k % 5 <> 4").select("project", "path")).awaitTermination()
    return graph.count_by(state.read()["nodes"], "label")


@query("stream_trace_counts", "WITH p AS (SELECT event_type AS caller, lead(event_type) OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS callee FROM events) SELECT caller, callee, count(*) AS n FROM p WHERE callee IS NOT NULL GROUP BY caller, callee")
def _(spark, d):
    folder, name = _scratch(spark), f"counts_{uuid.uuid4().hex}"
    event_traces(spark, d).select("calls").write.parquet(f"{folder}/traces")
    stream = incremental.trace_counts(spark.readStream.schema("calls array<string>").parquet(f"{folder}/traces"))
    stream.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


# Ignore rules


@query("ignore_dirs", "SELECT v AS path FROM (VALUES ('src/b.py'), ('env/c.py'), ('bower_components/d.js'), ('distant/e.go')) t(v)")
def _(spark, d):
    paths = ["src/b.py", "env/c.py", "bower_components/d.js", "distant/e.go", "node_modules/x/a.py", ".gradle/x.java", "a/.terraform/b.go", "vendor/v.go", "x/target/y.rs"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    return df.where(files.kept_column(F.col("path")))


@query("ignore_nested", f"{SQL_FILES}x AS (SELECT path FROM mods WHERE NOT (path LIKE 'pkg1/%' AND lang = 'python') AND NOT path LIKE '%/mod9%.go') SELECT path FROM x")
def _(spark, d):
    """A rule of a folder hides files there and nowhere else."""
    rules = [*files.parse_rules("mod9*.go"), *files.parse_rules("*.py", "pkg1")]
    return source_files(spark, d).where(files.kept_column(F.col("path"), rules)).select("path")
