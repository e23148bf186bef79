"""Reads of the property graph: search, degree, traversal, reachability, impact, structure.

nodes has the columns of schema.NODES, edges those of schema.EDGES; of edges,
site_line may be missing. Limits always come with a total order.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import glob_to_like
from ..schema import CALL_TYPES, TRACE_TYPES
from .lineage import cut, merged, small


def degree(edges: DataFrame) -> DataFrame:
    """(id, degree): edge ends per node. A loop counts twice; an end that is not known, not at all."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).where("id IS NOT NULL")
    return ends.groupBy("id").agg(F.count("*").alias("degree"))


def matching(nodes: DataFrame, name_pattern: str | None = None, label: str | None = None, file_pattern: str | None = None) -> DataFrame:
    """Nodes by label and by globs over the whole name or file, letters of either case."""
    out = nodes
    if label is not None:
        out = out.where(F.col("label") == label)
    if name_pattern is not None:
        out = out.where(F.col("name").ilike(glob_to_like(name_pattern)))
    if file_pattern is not None:
        out = out.where(F.col("file").ilike(glob_to_like(file_pattern)))
    return out


def search_nodes(
    nodes: DataFrame,
    edges: DataFrame,
    name_pattern: str | None = None,
    label: str | None = None,
    file_pattern: str | None = None,
    min_degree: int | None = None,
    max_degree: int | None = None,
    limit: int = 100,
    offset: int = 0,
    page_first: bool = False,
) -> DataFrame:
    """id, label, name, qualified, file, start_line and degree, by qualified name.

    Degree bounds hold before paging, so that pages are full; page_first applies
    them to the page instead. Only ids of candidates meet the edges, and the page
    alone where no bound is given.
    """
    found = matching(nodes, name_pattern, label, file_pattern).select("id", "label", "name", "qualified", "file", "start_line")
    page = lambda df: df.orderBy("qualified", "id").offset(offset).limit(limit)
    bounded = min_degree is not None or max_degree is not None
    if page_first or not bounded:
        found = page(found)
    ids = found.select("id")
    touching = edges.select(F.explode(F.array("src", "dst")).alias("id")).join(ids, "id", "left_semi").groupBy("id").agg(F.count("*").alias("degree"))
    found = found.join(touching, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    if min_degree is not None:
        found = found.where(F.col("degree") >= min_degree)
    if max_degree is not None:
        found = found.where(F.col("degree") <= max_degree)
    if bounded and not page_first:
        found = page(found)
    return found.select("id", "label", "name", "qualified", "file", "start_line", "degree")


def hotspots(nodes: DataFrame, edges: DataFrame, n: int = 10) -> DataFrame:
    """The nodes of highest degree, ties by qualified name."""
    ranked = nodes.join(degree(edges), "id").select("id", "name", "qualified", "label", "degree")
    return ranked.orderBy(F.desc("degree"), "qualified", "id").limit(n)


def start_node(nodes: DataFrame, name: str) -> DataFrame:
    """The node with that qualified name, else that name; of several, the least id."""
    found = nodes.where((F.col("qualified") == name) | (F.col("name") == name))
    return found.orderBy((F.col("qualified") == name).desc(), "id").limit(1)


def _site(edges: DataFrame) -> Column:
    return F.col("site_line") if "site_line" in edges.columns else F.lit(None).cast("int")


def trace_path(nodes: DataFrame, edges: DataFrame, name: str, direction: str = "outbound", depth: int = 3, types: Sequence[str] = TRACE_TYPES) -> DataFrame:
    """Hops (depth, from, to, type, confidence, file, site_line) up to `depth` (1 to 5) steps from a node.

    Every edge of a node reached in fewer steps is a hop; with direction `both`
    an edge with two such ends is two. A missing end is shown as `?` and not
    followed. file is the caller's.
    """
    if direction not in ("outbound", "inbound", "both"):
        raise ValueError(f"direction {direction!r}")
    depth = max(1, min(5, depth))
    used = edges.where(F.col("type").isin(*types)).select("src", "dst", "type", "confidence", _site(edges).alias("site_line"))
    ways = [w for w, on in (("src", direction != "inbound"), ("dst", direction != "outbound")) if on]
    ends = {"src": "dst", "dst": "src"}
    steps = reduce(DataFrame.unionByName, [used.select(F.col(w).alias("id"), F.col(ends[w]).alias("next")) for w in ways])
    # made distinct only once they have met the frontier
    steps = steps.where("id IS NOT NULL AND next IS NOT NULL")
    reached = cut(start_node(nodes, name).select("id", F.lit(0).alias("d")))
    frontier = reached
    for d in range(1, depth):
        new = steps.join(small(frontier.select("id")), "id").select(F.col("next").alias("id")).distinct()
        frontier = cut(new.join(small(reached.select("id")), "id", "left_anti").select("id", F.lit(d).alias("d")))
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
    from_ = small(reached)
    hops = reduce(DataFrame.unionByName, [used.join(from_, from_["id"] == used[w]).select((F.col("d") + 1).alias("depth"), "src", "dst", "type", "confidence", "site_line") for w in ways])
    # names are looked up for the nodes of the hops alone
    hops = cut(hops)
    met = small(hops.select(F.explode(F.array("src", "dst")).alias("id")).where("id IS NOT NULL").distinct())
    nodes = nodes.join(met, "id", "left_semi")
    called = F.coalesce("qualified", "name")
    a = nodes.select(F.col("id").alias("src"), called.alias("from"), "file")
    b = nodes.select(F.col("id").alias("dst"), called.alias("to"))
    named = hops.join(a, "src", "left").join(b, "dst", "left")
    return named.select("depth", F.coalesce("from", F.lit("?")).alias("from"), F.coalesce("to", F.lit("?")).alias("to"), "type", "confidence", F.coalesce("file", F.lit("")).alias("file"), "site_line")


def reach(edges: DataFrame, low: int = 1, high: int = 5, type: str | None = None, sources: DataFrame | None = None) -> DataFrame:
    """(src, dst): pairs with a walk of low to high edges. Pairs are made distinct at each length; low 0 adds each end to itself.

    With sources (one column id) walks begin there only, so that nothing is made
    of the others.
    """
    steps = edges.where("src IS NOT NULL AND dst IS NOT NULL")
    if type is not None:
        steps = steps.where(F.col("type") == type)
    steps = cut(steps.select("src", "dst").distinct())
    level, kept = steps, []
    if sources is not None:
        starts = small(sources.select(F.col("id").alias("src")).distinct())
        level = cut(steps.join(starts, "src", "left_semi"))
    for n in range(1, high + 1):
        if n > 1:
            level = cut(level.select("src", F.col("dst").alias("mid")).join(steps.select(F.col("src").alias("mid"), "dst"), "mid").select("src", "dst").distinct())
        if n >= low:
            kept.append(level)
    if low == 0:
        ends = steps.select(F.explode(F.array("src", "dst")).alias("src")).distinct() if sources is None else starts
        kept.append(ends.select("src", F.col("src").alias("dst")))
    return reduce(DataFrame.unionByName, kept).distinct()


def blast_radius(nodes: DataFrame, edges: DataFrame, changed_files: DataFrame) -> DataFrame:
    """Nodes of the changed files (one column `file`) and their neighbours over all edges: id, name, label, file, changed."""
    changed = small(nodes.join(small(changed_files.select("file").distinct()), "file", "left_semi").select("id").distinct())
    known = edges.where("src IS NOT NULL AND dst IS NOT NULL")
    out = known.join(changed.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id"))
    back = known.join(changed.withColumnRenamed("id", "dst"), "dst", "left_semi").select(F.col("src").alias("id"))
    near = out.unionByName(back).distinct().join(changed, "id", "left_anti")
    ids = changed.withColumn("changed", F.lit(True)).unionByName(near.withColumn("changed", F.lit(False)))
    return nodes.join(ids, "id").select("id", "name", "label", "file", "changed")


def blast_risk(radius: DataFrame) -> DataFrame:
    """One row: affected, and risk high over 20, medium over 5, else low."""
    n = F.col("affected")
    return radius.agg(F.count("*").alias("affected")).withColumn("risk", F.when(n > 20, "high").when(n > 5, "medium").otherwise("low"))


def entry_points(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Functions that nothing CALLS."""
    called = edges.where("type = 'CALLS' AND dst IS NOT NULL").select(F.col("dst").alias("id")).distinct()
    return nodes.where("label = 'Function'").join(merged(called), "id", "left_anti").select("id", "name", "qualified", "file")


def dead_code(nodes: DataFrame, edges: DataFrame, include_functions: bool = False) -> DataFrame:
    """Functions, methods and classes that are neither entry points nor called or referred to.

    As a function that nothing calls is an entry point, functions show up only
    with include_functions.
    """
    # an id is sent on once for each task, and not for each call
    used = edges.where(F.col("type").isin(*CALL_TYPES) & F.col("dst").isNotNull()).select(F.col("dst").alias("id")).distinct()
    found = nodes.where(F.col("label").isin("Function", "Method", "Class")).join(merged(used), "id", "left_anti")
    if not include_functions:
        found = found.join(merged(entry_points(nodes, edges).select("id")), "id", "left_anti")
    return found.select("id", "name", "qualified", "label", "file", F.col("start_line").alias("line"))


def segments(c: Column | str) -> Column:
    return F.split(c, r"\.")


def packages(nodes: DataFrame) -> DataFrame:
    """Distinct qualified names without their last segment."""
    s = segments("qualified")
    return nodes.select(F.array_join(F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0))), ".").alias("package")).where("package <> ''").distinct()


def clusters(nodes: DataFrame) -> DataFrame:
    """(cluster, n_nodes): by the first two segments of names with more than two, else by the first."""
    s = segments("qualified")
    cluster = F.when(F.size(s) > 2, F.concat_ws(".", s[0], s[1])).otherwise(s[0])
    return nodes.groupBy(cluster.alias("cluster")).agg(F.count("*").alias("n_nodes"))


def cluster_members(nodes: DataFrame) -> DataFrame:
    """(cluster, name): one row for each node, so that no cluster is gathered."""
    s = segments("qualified")
    cluster = F.when(F.size(s) > 2, F.concat_ws(".", s[0], s[1])).otherwise(s[0])
    return nodes.select(cluster.alias("cluster"), "name")


def languages(nodes: DataFrame) -> DataFrame:
    """(language, n_nodes) by what follows the last dot of the file."""
    return nodes.groupBy(F.substring_index("file", ".", -1).alias("language")).agg(F.count("*").alias("n_nodes"))


def routes(nodes: DataFrame) -> DataFrame:
    return nodes.where("label = 'Route'").select("id", "name", "file", "start_line")


def count_by(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def architecture(nodes: DataFrame, edges: DataFrame) -> dict[str, DataFrame]:
    """The parts of the structure report, each a lazy table."""
    return {
        "languages": languages(nodes),
        "packages": packages(nodes).orderBy("package"),
        "entry_points": entry_points(nodes, edges),
        "hotspots": hotspots(nodes, edges),
        "routes": routes(nodes),
        "clusters": cluster_members(nodes),
    }


def index_status(projects: DataFrame, files: DataFrame, nodes: DataFrame, edges: DataFrame, project: str) -> DataFrame:
    """One row with name, root, files, nodes and edges; none for an unknown project."""
    mine = projects.where(F.col("name") == project).select("name", "root")
    for name, df in (("files", files), ("nodes", nodes), ("edges", edges)):
        n = df.where(F.col("project") == project).groupBy("project").agg(F.count("*").alias(name)).withColumnRenamed("project", "name")
        mine = mine.join(n, "name", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return mine


def both_ends(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose two ends are among the nodes."""
    ids = nodes.select("id")
    out = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return out.select("src", "dst", "type", "confidence")


def neighbourhood(nodes: DataFrame, edges: DataFrame, id: int) -> DataFrame:
    """direction, type, neighbour_id, neighbour_name, neighbour_label of a node's edges; a loop is one `out`."""
    out = edges.where(F.col("src") == id).select(F.lit("out").alias("direction"), "type", F.col("dst").alias("neighbour_id"))
    back = edges.where((F.col("dst") == id) & (F.col("src") != id)).select(F.lit("in").alias("direction"), "type", F.col("src").alias("neighbour_id"))
    about = nodes.select(F.col("id").alias("neighbour_id"), F.col("name").alias("neighbour_name"), F.col("label").alias("neighbour_label"))
    return out.unionByName(back).join(about, "neighbour_id", "left").select("direction", "type", "neighbour_id", "neighbour_name", "neighbour_label")


def search_code(nodes: DataFrame, pattern: str, limit: int = 50) -> DataFrame:
    """Nodes with the pattern in name, qualified name or signature, letters of either case; % and _ are wildcards."""
    like = "%" + pattern.replace("\\", "\\\\") + "%"
    hit = reduce(lambda a, b: a | b, [F.col(c).ilike(like) for c in ("name", "qualified", "signature")])
    return nodes.where(hit).select("id", "name", "qualified", "label", "file").orderBy("id").limit(limit)


def snippet(nodes: DataFrame, contents: DataFrame, qualified: str) -> DataFrame:
    """The source lines of a node: qualified, file, start_line, end_line, code (null without its file's content).

    contents: (path, content).
    """
    node = nodes.where(F.col("qualified") == qualified).orderBy("id").limit(1)
    lines = F.split("content", "\n")
    code = F.array_join(F.slice(lines, F.greatest(F.col("start_line"), F.lit(1)), F.greatest(F.col("end_line") - F.greatest(F.col("start_line"), F.lit(1)) + 1, F.lit(0))), "\n")
    return node.join(contents.withColumnRenamed("path", "file"), "file", "left").select("qualified", "file", "start_line", "end_line", code.alias("code"))


def lookup(nodes: DataFrame, ids: Iterable[int]) -> DataFrame:
    return nodes.where(F.col("id").isin(*ids))
