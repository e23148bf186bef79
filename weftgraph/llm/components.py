"""Connected components of a graph that may be larger than any machine."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


#: A node of more neighbours than this is a hub.
HUB = 100_000


def _meet(edges: DataFrame, about: DataFrame) -> DataFrame:
    """edges with the m of their u; about: (u, m, n) with the number n of neighbours."""
    hubs = materialize(about.where(F.col("n") > HUB).select("u", "m"))
    if hubs.isEmpty():
        return edges.join(about.select("u", "m"), "u")
    few = F.broadcast(hubs)
    rest = edges.join(few.select("u"), "u", "left_anti").join(about.where(F.col("n") <= HUB).select("u", "m"), "u")
    return rest.unionByName(edges.join(few, "u"))


def _roots(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of edges, ascending, and the least node of each one's component."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        if (root[a] == root[b]).all():
            return nodes, nodes[root]
        # roots hang on the least root that an edge leads to, then all nodes on their trees' roots
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while (root[root] != root).any():
            root = root[root]


def _at_once(edges: DataFrame) -> DataFrame:
    schema = pa.schema([("node", pa.int64()), ("root", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches]
        if parts:
            found = _roots(*(np.concatenate(c) for c in zip(*parts, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], schema=schema)

    return edges.coalesce(1).mapInArrow(run, "node long, root long")


def connected_components(edges: DataFrame, max_rounds: int = 60, few: int = 0) -> DataFrame:
    """(node, root) for every node that has an edge; root is the component's least node.

    edges: two columns of one orderable type, any direction, repeats and loops
    allowed. Alternates large-star and small-star steps, which need O(log^2 n)
    rounds; each round is written, so that a lost executor costs one round. A
    node of more than HUB neighbours meets them by a broadcast: there are fewer
    such nodes than edges / HUB, so one key never holds a task's whole join. Of
    64-bit numbers, up to few distinct edges are gone through in one task.
    """
    a, b = edges.columns
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    now = materialize(now)
    if few and now.count() <= few:
        return _at_once(now)
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        # large star: neighbours above u hang on the least of u's neighbourhood
        large = _meet(now.select(F.col("v").alias("u"), F.col("u").alias("w")), least).select(F.col("w").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        # small star: neighbours below u, and u, hang on the least of those
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = _meet(large, low)
        after = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        after = materialize(after.where("u <> v").distinct())
        still = after.select("u").intersect(after.select("v")).limit(1)
        # a forest of stars in which every node hangs on one root
        if still.isEmpty() and after.groupBy("u").count().where("count > 1").limit(1).isEmpty():
            now = after
            break
        now = after
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
