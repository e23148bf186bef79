"""Execution traces: ordered calls that confirm or add CALLS edges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import TRACES


def ingest(spark: SparkSession, project: str, calls: Sequence[str], id: int, created_at: int, name: str | None = None, root: str | None = None) -> DataFrame:
    """A trace as one row; root is the first call unless given."""
    calls = list(calls)
    return spark.createDataFrame([(id, project, name, root or (calls[0] if calls else None), calls, created_at)], TRACES)


def ingest_json(rows: DataFrame, json: str) -> DataFrame:
    """The column `json`, a text array, as `calls`."""
    return rows.withColumn("calls", F.from_json(json, "array<string>"))


def pairs(traces: DataFrame) -> DataFrame:
    """(caller, callee, n): neighbouring calls over all traces. No trace is gathered with others."""
    both = F.arrays_zip(F.slice("calls", 1, F.greatest(F.size("calls") - 1, F.lit(0))).alias("caller"), F.slice("calls", 2, F.greatest(F.size("calls") - 1, F.lit(0))).alias("callee"))
    each = traces.where(F.size("calls") > 1).select(F.explode(both).alias("p")).select(F.col("p.caller").alias("caller"), F.col("p.callee").alias("callee"))
    return each.groupBy("caller", "callee").agg(F.count("*").alias("n"))


def resolved(nodes: DataFrame, names: DataFrame) -> DataFrame:
    """(frame, id): the node with that qualified name, else that name; of several, the least id."""
    by_qualified = nodes.groupBy(F.col("qualified").alias("frame")).agg(F.min("id").alias("a"))
    by_name = nodes.groupBy(F.col("name").alias("frame")).agg(F.min("id").alias("b"))
    found = names.join(by_qualified, "frame", "left").join(by_name, "frame", "left")
    return found.select("frame", F.coalesce("a", "b").alias("id")).where("id IS NOT NULL")


def resolved_pairs(nodes: DataFrame, traces: DataFrame) -> DataFrame:
    """(src, dst, n) of the pairs whose two frames are known."""
    p = pairs(traces)
    frames = resolved(nodes, p.select(F.explode(F.array("caller", "callee")).alias("frame")).where("frame IS NOT NULL").distinct())
    out = p.join(frames.select(F.col("frame").alias("caller"), F.col("id").alias("src")), "caller").join(frames.select(F.col("frame").alias("callee"), F.col("id").alias("dst")), "callee")
    return out.groupBy("src", "dst").agg(F.sum("n").alias("n"))


def apply_traces(nodes: DataFrame, edges: DataFrame, traces: DataFrame, project: str) -> DataFrame:
    """The edges after new traces: CALLS edges of a traced pair become exact and gain hits; pairs without one get one.

    Give only traces that have not been applied, as hits add up.
    """
    found = resolved_pairs(nodes, traces)
    calls = F.col("type") == "CALLS"
    hit = edges.join(found, ["src", "dst"], "left")
    boosted = calls & F.col("n").isNotNull()
    out = hit.withColumn("confidence", F.when(boosted, "exact").otherwise(F.col("confidence"))).withColumn("trace_hits", F.coalesce("trace_hits", F.lit(0)) + F.when(boosted, F.col("n")).otherwise(0))
    missing = found.join(edges.where(calls & F.col("dst").isNotNull()).select("src", "dst"), ["src", "dst"], "left_anti")
    new = missing.select(
        F.xxhash64(F.lit(project), "src", "dst", F.lit("CALLS")).alias("id"), F.lit(project).alias("project"), "src", "dst",
        F.lit("CALLS").alias("type"), F.lit("exact").alias("confidence"), F.lit(None).cast("int").alias("site_line"), F.col("n").alias("trace_hits"),
    )
    return out.select(edges.columns).unionByName(new.select(edges.columns))


def trace_summary(nodes: DataFrame, edges: DataFrame, traces: DataFrame) -> DataFrame:
    """One row: traces, edges_boosted, edges_created."""
    found = resolved_pairs(nodes, traces)
    known = edges.where((F.col("type") == "CALLS") & F.col("dst").isNotNull()).select("src", "dst").distinct().withColumn("known", F.lit(True))
    marked = found.join(known, ["src", "dst"], "left")
    sums = marked.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("pairs"), F.count(F.when(F.col("known").isNull(), 1)).alias("edges_created"))
    return traces.agg(F.count("*").alias("traces")).join(sums, F.lit(True)).select("traces", (F.col("pairs") - F.col("edges_created")).alias("edges_boosted"), "edges_created")
