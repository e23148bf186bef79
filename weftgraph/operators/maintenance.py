"""Changes of tables, each as a new table: upsert, replace, prune, merge, diff."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import merged, small


def upsert(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], keep: Sequence[str] = (), order: str = "updated_at") -> DataFrame:
    """Incoming rows replace those of the same keys; columns in `keep` stay as they were.

    Of several incoming rows of a key the last by `order` counts.
    """
    w = Window.partitionBy(*keys).orderBy(F.desc("_new"), F.desc(order))
    both = existing.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    old = Window.partitionBy(*keys)
    for c in keep:
        both = both.withColumn(c, F.coalesce(F.max(F.when(F.col("_new") == 0, F.col(c))).over(old), F.col(c)))
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").select(existing.columns)


def insert_missing(existing: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Incoming rows whose keys aren't there yet are added, one for each key."""
    fresh = incoming.dropDuplicates(list(keys)).join(merged(existing.select(*keys)), list(keys), "left_anti")
    return existing.unionByName(fresh.select(existing.columns))


def delete_project(tables: dict[str, DataFrame], project: str) -> dict[str, DataFrame]:
    """All tables without the project's rows."""
    return {name: df.where(F.col("name" if name == "projects" else "project") != project) for name, df in tables.items()}


def recount(projects: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Projects with their node and edge counts made anew."""
    out = projects.drop("node_count", "edge_count")
    for name, df in (("node_count", nodes), ("edge_count", edges)):
        n = df.groupBy(F.col("project").alias("name")).agg(F.count("*").alias(name))
        out = out.join(n, "name", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out.select(projects.columns)


def prune(nodes: DataFrame, edges: DataFrame, files: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The tables without the files in gone (project, path): their nodes, ledger rows, and edges from them.

    Edges from elsewhere into them stay as unresolved calls, to be resolved anew.
    """
    at = small(gone.select("project", F.col("path").alias("file")).distinct())
    lost = small(nodes.join(at, ["project", "file"], "left_semi").select("id").distinct())
    left = nodes.join(at, ["project", "file"], "left_anti").select(nodes.columns)
    kept = edges.join(renamed(lost, "src"), "src", "left_anti")
    marked = kept.join(renamed(lost, "dst").withColumn("_lost", F.lit(True)), "dst", "left")
    out = marked.withColumn("dst", F.when(F.col("_lost").isNull(), F.col("dst"))).withColumn("confidence", F.when(F.col("_lost").isNull(), F.col("confidence")).otherwise("usage"))
    return left, out.select(edges.columns), files.join(merged(gone), ["project", "path"], "left_anti").select(files.columns)


def renamed(ids: DataFrame, name: str) -> DataFrame:
    return ids.select(F.col("id").alias(name))


def replace_files(nodes: DataFrame, edges: DataFrame, files: DataFrame, new_nodes: DataFrame, new_edges: DataFrame, new_files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The tables after the files in new_files have been extracted anew."""
    n, e, f = prune(nodes, edges, files, new_files.select("project", "path"))
    return n.unionByName(new_nodes), e.unionByName(new_edges), f.unionByName(new_files)


def missing_files(ledger: DataFrame, on_disk: DataFrame) -> DataFrame:
    """(project, path) of the ledger that are not on disk."""
    return ledger.select("project", "path").distinct().join(merged(on_disk.select("project", "path")), ["project", "path"], "left_anti")


def changed_files(on_disk: DataFrame, ledger: DataFrame) -> DataFrame:
    """Files that are new or have another hash than in the ledger."""
    return on_disk.join(merged(ledger.select("project", "path", "hash")), ["project", "path", "hash"], "left_anti")


def drop_orphans(embeddings: DataFrame, nodes: DataFrame) -> DataFrame:
    """Vectors whose node is there."""
    return embeddings.join(nodes.select(F.col("id").alias("node_id")), "node_id", "left_semi").select(embeddings.columns)


def diff_counts(live: DataFrame, other: DataFrame, column: str) -> DataFrame:
    """(column, live, other): counts on either side."""
    a = live.groupBy(column).agg(F.count("*").alias("live"))
    b = other.groupBy(column).agg(F.count("*").alias("other"))
    return a.join(b, column, "full_outer").select(column, F.coalesce("live", F.lit(0)).alias("live"), F.coalesce("other", F.lit(0)).alias("other"))


def diff(live: dict[str, DataFrame], other: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """What tells two sets of tables apart: label counts, edge types, files only in live, whether either has vectors."""
    types = lambda t: t["edges"].select("type").distinct()
    return {
        "labels": diff_counts(live["nodes"], other["nodes"], "label"),
        "live_types": types(live),
        "other_types": types(other),
        "missing_files": live["files"].select("path").distinct().join(other["files"].select("path"), "path", "left_anti"),
        "vectors": live["embeddings"].limit(1).select(F.lit("live").alias("side")).unionByName(other["embeddings"].limit(1).select(F.lit("other").alias("side"))),
    }


# Decision records


def list_adr(adr: DataFrame, project: str) -> DataFrame:
    return adr.where(F.col("project") == project).orderBy("id")


def get_adr(adr: DataFrame, project: str, id: str) -> DataFrame:
    return adr.where((F.col("project") == project) & (F.col("id") == id))


def update_adr(adr: DataFrame, project: str, id: str, content: str, now: int) -> DataFrame:
    """A new record's title is its id; an old one keeps title and creation time."""
    row = adr.sparkSession.createDataFrame([(project, id, id, content, now, now)], adr.schema)
    return upsert(adr, row, ["project", "id"], keep=["title", "created_at"])
