"""From facts to nodes and edges, by joins: no file waits for another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import EDGES, NODES
from .lineage import cut, merged

BUCKET_LINES = 64
# Names that a language knows without an import, and the prefix of their qualified names.
BUILTINS = {
    "javascript": ("", "console process Buffer require module exports Promise Object Array String Number Boolean Map Set JSON Math Date RegExp Error Symbol Proxy Reflect globalThis setTimeout setInterval clearTimeout clearInterval fetch URL URLSearchParams Request Response Headers"),
    "python": ("builtins.", "print len range map filter zip enumerate sorted sum min max abs round str int float bool list dict tuple set object type isinstance hasattr getattr setattr dir super property classmethod staticmethod open ValueError TypeError KeyError IndexError Exception RuntimeError"),
    "java": ("java.lang.", "String Integer Long Double Float Boolean Character Byte Short Object System Math Exception RuntimeException Error Throwable Class Thread ThreadLocal"),
    "go": ("builtin.", "append cap close complex copy delete imag len make max min new panic print println real recover string int int8 int16 int32 int64 uint float32 float64 byte rune bool error"),
    "rust": ("std.", "String Vec Option Some None Result Ok Err Box Rc Arc RefCell Clone Copy Debug Display Drop Default Iterator IteratorExt Into From AsRef AsMut ToOwned ToString vec format print println eprintln panic assert assert_eq"),
    "csharp": ("System.", "String Console Math Exception Object Int32 Int64 Double Single Decimal Boolean Char Byte DateTime TimeSpan Array List Dictionary Action Func Task System"),
}


def builtins(spark: SparkSession) -> DataFrame:
    """(lang, name, qualified), some two hundred rows."""
    rows = [(lang, n, prefix + n) for lang, (prefix, names) in BUILTINS.items() for n in names.split()]
    rows += [("typescript", n, q) for lang, n, q in rows if lang == "javascript"]
    return spark.createDataFrame(rows, "lang string, name string, qualified string")


def import_path(c: Column) -> Column:
    """A script's import path as a dotted name: without one leading ./ or ../ and without the extension."""
    c = F.regexp_replace(F.regexp_replace(c, r"^\./", ""), r"^\.\./", "")
    return F.regexp_replace(F.regexp_replace(c, r"\.(?:[mc]?[jt]sx?)$", ""), "/", ".")


def last_segment(c: Column) -> Column:
    return F.element_at(F.split(c, r"[./:]+"), -1)


def resolve_identifiers(uses: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """uses (project, path, lang, name) with kind and qualified: own symbols, then imports, then what the language knows.

    symbols: (project, path, name, qualified, ord); imports: (project, path,
    name, source, ord). A symbol is exact, an import a reference, or exact where
    a Java, Rust or C# import ends in the name; the last symbol and the first
    import of a name count. A Java or Rust import of all names of a package, if
    it stands before any import of the name itself, makes a reference into that
    package. Names found nowhere are of kind `none`.
    """
    keys = ["project", "path", "name"]
    own = symbols.groupBy(*keys).agg(F.max_by("qualified", "ord").alias("_own"))
    wild = F.col("source").rlike(r"(\.|::)\*$")
    bound = imports.where(~wild).groupBy(*keys).agg(F.min_by("source", "ord").alias("_source"), F.min("ord").alias("_at"))
    packages = imports.where(wild).groupBy("project", "path").agg(F.min_by("source", "ord").alias("_package"), F.min("ord").alias("_package_at"))
    uses_ = uses.join(packages, ["project", "path"], "left")
    out = uses_.join(own, keys, "left").join(bound, keys, "left").join(F.broadcast(builtins(uses.sparkSession)).withColumnRenamed("qualified", "_builtin"), ["lang", "name"], "left")
    script = F.col("lang").isin("javascript", "typescript")
    source = F.when(script & F.col("_source").startswith("."), import_path(F.col("_source"))).otherwise(F.col("_source"))
    exact = F.col("lang").isin("java", "rust", "csharp") & (last_segment(F.col("_source")) == F.col("name"))
    inside = F.col("lang").isin("java", "rust") & F.col("_package").isNotNull() & (F.col("_at").isNull() | (F.col("_package_at") < F.col("_at")))
    source = F.when(inside, F.concat(F.regexp_replace("_package", r"\*$", ""), F.col("name"))).otherwise(source)
    kind = F.when(F.col("_own").isNotNull() | exact & ~inside, "exact").when(inside | F.coalesce("_source", "_builtin").isNotNull(), "reference").otherwise("none")
    return out.select(*uses.columns, kind.alias("kind"), F.coalesce(F.col("_own"), source, F.col("_builtin")).alias("qualified"))


def lookup(uses: DataFrame, entries: DataFrame) -> DataFrame:
    """uses (project, path, name, sl, sc) with `qualified`: that of the entry whose scope is the innermost around the use; null for none.

    entries: (project, path, name, qualified, sl, sc, el, ec, ord); the span is
    that of the scope in which the name holds. Within a scope the last entry of
    a name counts, and definitions come after imports.
    """
    keys = ["project", "path", "name"]
    known = entries.select(*keys, "qualified", F.struct("sl", "sc").alias("_start"), F.struct(F.col("el").alias("sl"), F.col("ec").alias("sc")).alias("_end"), "ord")
    pairs = uses.withColumn("_at", F.struct("sl", "sc")).join(known, keys, "left")
    around = (F.col("_start") <= F.col("_at")) & (F.col("_at") < F.col("_end"))
    return pairs.groupBy(*uses.columns).agg(F.max_by(F.when(around, F.col("qualified")), F.when(around, F.struct("_start", "ord"))).alias("qualified"))


def enclosing(points: DataFrame, spans: DataFrame, keys: list[str], bucket: int = BUCKET_LINES) -> DataFrame:
    """points (keys, sl, sc, ...) with `inside`, the id of the innermost span (keys, sl, sc, el, ec, id) around each; null for none.

    A range join by buckets of lines: a point lies in one, a span in all that it
    touches, so that points meet the spans nearby and not all of a file.
    """
    buckets = F.explode(F.sequence(F.floor(F.col("sl") / bucket), F.floor(F.col("el") / bucket))).alias("_of")
    wide = spans.select(*[F.col(k).alias(f"_{k}") for k in keys], buckets, F.struct("sl", "sc").alias("_start"), F.struct(F.col("el").alias("sl"), F.col("ec").alias("sc")).alias("_end"), F.col("id").alias("_id"))
    at = points.withColumn("_bucket", F.floor(F.col("sl") / bucket)).withColumn("_at", F.struct("sl", "sc"))
    # only spans around a point leave the join, and not all of its bucket
    around = (F.col("_bucket") == F.col("_of")) & (F.col("_start") <= F.col("_at")) & (F.col("_at") < F.col("_end"))
    for k in keys:
        around = around & (F.col(k) == F.col(f"_{k}"))
    return at.join(merged(wide), around, "left").groupBy(*points.columns).agg(F.max_by("_id", "_start").alias("inside"))


def _node(df: DataFrame, label: Column, name: Column, qualified: Column, signature: Column, doc: Column) -> DataFrame:
    place = [(F.col("sl") + 1).alias("start_line"), F.col("sc").alias("start_col"), (F.col("el") + 1).alias("end_line"), F.col("ec").alias("end_col")]
    id = F.xxhash64("project", "path", label, qualified, "sl", "sc")
    return df.select(id.alias("id"), "project", F.col("path").alias("file"), *place, label.alias("label"), name.alias("name"), qualified.alias("qualified"), signature.alias("signature"), doc.alias("doc"))


def build(files: DataFrame, emits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(schema.NODES, schema.EDGES) of files (project, path, content) and their facts.

    Calls and base types resolve to a definition of that name in the file (of
    several the last), else to the only one in the project; a call without a dot
    that resolves to nothing is dropped, one with a dot keeps an open end.
    """
    # every part of the graph is made of these; extraction runs once
    emits = cut(emits)
    null = F.lit(None).cast("string")
    last = F.size(F.split(F.coalesce("content", F.lit("")), "\n")) - 1
    file_rows = files.select("project", "path", F.lit(0).alias("sl"), F.lit(0).alias("sc"), last.alias("el"), F.lit(0).alias("ec"))
    file_nodes = _node(file_rows, F.lit("File"), last_segment_of_path(F.col("path")), F.concat_ws(".", "project", F.translate("path", "/", ".")), null, null)
    defs = emits.where("kind = 'define'")
    def_nodes = _node(defs, F.col("label"), F.coalesce("name", F.lit("anon")), F.concat_ws(".", "module_spec", F.coalesce("target_name", "name", F.lit("anon"))), F.col("signature"), F.col("doc"))
    routes = emits.where("kind = 'route'")
    route_name = F.concat_ws(" ", "method", "path_route")
    route_nodes = _node(routes, F.lit("Route"), route_name, F.concat_ws(".", "module_spec", route_name), F.col("handler"), null)
    nodes = file_nodes.unionByName(def_nodes).unionByName(route_nodes)

    of_file = merged(file_nodes.select("project", F.col("file").alias("path"), F.col("id").alias("file_id")))
    spans = def_nodes.select("project", F.col("file").alias("path"), "name", (F.col("start_line") - 1).alias("sl"), F.col("start_col").alias("sc"), (F.col("end_line") - 1).alias("el"), F.col("end_col").alias("ec"), "id", "label")
    in_file = spans.groupBy("project", "path", "name").agg(F.max_by("id", F.struct("sl", "sc")).alias("near"))
    unique = spans.groupBy("project", "name").agg(F.min("id").alias("far"), F.count("*").alias("n")).where("n = 1").drop("n")

    def edge(df: DataFrame, src: Column, dst: Column, type: str, confidence: Column) -> DataFrame:
        id = F.xxhash64("project", src, dst, F.lit(type), "path", "ord")
        return df.select(id.alias("id"), "project", src.alias("src"), dst.alias("dst"), F.lit(type).alias("type"), confidence.alias("confidence"), (F.col("sl") + 1).alias("site_line"), F.lit(0).cast("long").alias("trace_hits"))

    none, exact, usage = F.lit(None).cast("long"), F.lit("exact"), F.lit("usage")

    def resolved(df: DataFrame, name: Column) -> DataFrame:
        df = df.withColumn("name", name)
        return df.join(merged(in_file), ["project", "path", "name"], "left").join(merged(unique), ["project", "name"], "left")

    sites = ["project", "path", "ord", "target_name", "sl", "sc"]
    calls = resolved(enclosing(emits.where("kind = 'call'").select(*sites), spans.drop("name", "label"), ["project", "path"]), last_segment(F.col("target_name"))).join(of_file, ["project", "path"])
    calls = calls.where("near IS NOT NULL OR far IS NOT NULL OR contains(target_name, '.')")
    sure = F.when(F.col("near").isNotNull(), "exact").when(F.col("far").isNotNull(), "reference").otherwise("usage")
    bases = resolved(emits.where("kind = 'inherit'").select("project", "path", "ord", F.col("name").alias("own"), "base", "sl", "sc"), last_segment(F.col("base")))
    own = in_file.select("project", "path", F.col("name").alias("own"), F.col("near").alias("own_id"))
    bases = bases.join(merged(own), ["project", "path", "own"], "left").join(of_file, ["project", "path"])
    id_of_route = F.xxhash64("project", "path", F.lit("Route"), F.concat_ws(".", "module_spec", route_name), "sl", "sc")
    handled = resolved(routes.withColumn("route_id", id_of_route), last_segment(F.col("handler"))).join(of_file, ["project", "path"])
    parts = [
        edge(defs.withColumn("dst", F.xxhash64("project", "path", "label", F.concat_ws(".", "module_spec", F.coalesce("target_name", "name", F.lit("anon"))), "sl", "sc")).join(of_file, ["project", "path"]), F.col("file_id"), F.col("dst"), "DEFINES", exact),
        edge(calls, F.coalesce("inside", "file_id"), F.coalesce("near", "far"), "CALLS", sure),
        edge(emits.where("kind = 'import'").join(of_file, ["project", "path"]), F.col("file_id"), none, "IMPORTS", usage),
        edge(bases, F.coalesce("own_id", "file_id"), F.coalesce("near", "far"), "INHERITS", sure),
        edge(handled, F.col("file_id"), F.col("route_id"), "HANDLES", exact),
        edge(handled.where("near IS NOT NULL"), F.col("route_id"), F.col("near"), "CALLS", exact),
        edge(handled.where("near IS NULL AND contains(handler, '.')"), F.col("route_id"), none, "CALL_REFERENCE", F.lit("reference")),
    ]
    edges = parts[0]
    for p in parts[1:]:
        edges = edges.unionByName(p)
    return nodes.select([c.split()[0] for c in NODES.split(", ")]), edges.select([c.split()[0] for c in EDGES.split(", ")])


def last_segment_of_path(c: Column) -> Column:
    return F.substring_index(c, "/", -1)


def first_edge(edges: DataFrame) -> DataFrame:
    """One edge per source and type, that of the least id."""
    return edges.withColumn("_n", F.row_number().over(Window.partitionBy("src", "type").orderBy("id"))).where("_n = 1").drop("_n")
