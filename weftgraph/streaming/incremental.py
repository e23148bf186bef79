"""Indexing as files change, and counting traces as they come.

A stream of files (project, path, lang, content) replaces, in each micro-batch,
the parts of the graph that come from changed files. State lies in numbered
folders beside a pointer, so that a batch that is run again writes the same
version and a reader never sees half of one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators import maintenance, resolve
from ..operators.lineage import cut
from ..schema import EDGES, FILES, NODES
from ..sources import extract
from ..sources.files import content_hash

_TABLES = {"nodes": NODES, "edges": EDGES, "files": FILES}


class GraphState:
    """nodes, edges and files in versions; a version counts once its marker is written."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), self.spark._jvm.org.apache.hadoop.fs.Path

    def latest(self, before: int | None = None) -> int | None:
        fs, path = self._fs()
        if not fs.exists(path(self.folder)):
            return None
        done = [int(s.getPath().getName()[1:]) for s in fs.listStatus(path(self.folder)) if s.getPath().getName().startswith("v") and fs.exists(path(f"{s.getPath()}/_DONE"))]
        return max((v for v in done if before is None or v < before), default=None)

    def read(self, version: int | None = None) -> dict[str, DataFrame]:
        version = self.latest() if version is None else version
        if version is None:
            return {n: self.spark.createDataFrame([], s) for n, s in _TABLES.items()}
        return {n: self.spark.read.schema(s).parquet(f"{self.folder}/v{version}/{n}") for n, s in _TABLES.items()}

    def write(self, tables: dict[str, DataFrame], version: int) -> None:
        for n, df in tables.items():
            df.write.mode("overwrite").parquet(f"{self.folder}/v{version}/{n}")
        fs, path = self._fs()
        fs.create(path(f"{self.folder}/v{version}/_DONE"), True).close()

    def drop_before(self, version: int) -> None:
        """Delete versions older than that; the one before stays, as a batch may be run again from it."""
        fs, path = self._fs()
        keep = self.latest(before=version)
        for s in fs.listStatus(path(self.folder)):
            name = s.getPath().getName()
            if name[:1] == "v" and name[1:].isdigit() and keep is not None and int(name[1:]) < keep:
                fs.delete(s.getPath(), True)


def index_files(state: dict[str, DataFrame], batch: DataFrame, now: int) -> dict[str, DataFrame]:
    """The state after the files of a batch that are new or changed have been extracted anew; others cost nothing."""
    # of several versions of a path the one of the latest time, where a time is given
    order = F.struct(*[F.col(c) for c in ("mtime",) if c in batch.columns], F.xxhash64("content"))
    newest = batch.groupBy("project", "path").agg(F.max_by(F.struct("lang", "content"), order).alias("f")).select("project", "path", "f.lang", "f.content")
    hashed = newest.withColumn("hash", content_hash("content"))
    changed = maintenance.changed_files(hashed, state["files"]).select("project", "path", "lang", "content", "hash")
    changed = cut(changed)
    new_nodes, new_edges = resolve.build(changed, extract.extract(changed))
    rows = changed.select("project", "path", "lang", "hash", F.lit(0).cast("long").alias("mtime"), F.lit(now).cast("long").alias("indexed_at"))
    n, e, f = maintenance.replace_files(state["nodes"], state["edges"], state["files"], new_nodes, new_edges, rows)
    return {"nodes": n, "edges": e, "files": f}


def watch(files: DataFrame, state: GraphState, checkpoint: str, trigger: dict | None = None, on_index: Callable[[int, DataFrame], None] | None = None, on_disk: Callable[[], DataFrame] | None = None) -> StreamingQuery:
    """Index a stream of files into a state; trigger is by default whatever is there now.

    on_disk gives (project, path) of the files that are there; others leave the
    graph after each batch.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        before = state.latest(before=batch_id)
        now = index_files(state.read(before) if before is not None else {n: state.spark.createDataFrame([], s) for n, s in _TABLES.items()}, batch, batch_id)
        state.write(remove_missing(now, on_disk()) if on_disk else now, batch_id)
        state.drop_before(batch_id)
        if on_index:
            on_index(batch_id, batch)

    return files.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def remove_missing(state: dict[str, DataFrame], on_disk: DataFrame) -> dict[str, DataFrame]:
    """The state without files that are no longer on disk."""
    gone = maintenance.missing_files(state["files"], on_disk)
    n, e, f = maintenance.prune(state["nodes"], state["edges"], state["files"], gone)
    return {"nodes": n, "edges": e, "files": f}


def trace_counts(traces: DataFrame) -> DataFrame:
    """(caller, callee, n) of a stream of traces with `calls`, for output mode complete or update."""
    ends = F.greatest(F.size("calls") - 1, F.lit(0))
    both = F.arrays_zip(F.slice("calls", 1, ends).alias("caller"), F.slice("calls", 2, ends).alias("callee"))
    each = traces.where(F.size("calls") > 1).select(F.explode(both).alias("p"))
    return each.groupBy(F.col("p.caller").alias("caller"), F.col("p.callee").alias("callee")).agg(F.count("*").alias("n"))
