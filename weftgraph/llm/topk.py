"""Exact top-k inner products by a pivot-distance index.

Vectors become integers and get one more coordinate that gives all the same
length, so that the largest inner product is the least Euclidean distance. Each
vector is keyed by its nearest pivot and by the annulus round it that holds its
distance; within its block vectors are sorted by that distance. By the triangle
inequality, |d(q, pivot) - d(x, pivot)| <= d(q, x), so an annulus has a highest
score that any of its vectors can reach. A query takes up the annuli in falling
order of that bound, a few at first and four times as many in each further
round, and stops at the first that cannot reach its k-th best score so far; of
an annulus it looks at the run of distances that can.

The number of pivots grows with the root of the number of vectors. Pivots and
the annuli's borders come from a bounded sample of vectors; every vector is
indexed, and the bounds are those of the vectors themselves. An annulus of many
vectors is dealt into blocks by a hash of the id, so a vector that is repeated
millions of times is no hot key. Queries travel in blocks too.

How much this saves depends on the vectors. Where they are spread evenly over a
sphere of many dimensions, all distances are nearly alike and next to every pair
has to be compared; where they lie in clusters, few have to.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

SCALE = 1024
K = 10
#: Pivots: the root of the number of vectors over ROOT_SHARE, within these limits; the sample has so many vectors for each.
LEAST_PIVOTS, MOST_PIVOTS, ROOT_SHARE, SAMPLE_EACH, LEAST_SAMPLE = 16, 1024, 2, 16, 4096
RINGS = 8
BLOCK = 2048
QUERIES = 256
#: Annuli that a query takes up in the first round, and by how many times more in each further one.
FIRST, MORE = 4, 4
#: Queries of like distance that share a run of vectors.
TOGETHER = 16
#: Distances are kept apart by more than rounding can move them, as a share of the common length.
EPS = 1e-6


def integers(rows: DataFrame) -> DataFrame:
    """(vec_id, v, sq): floor(1024 * x) of each component, and the sum of squares.

    Vectors that are null, empty or hold a null, an infinity or no number go,
    as do rows without a vec_id.
    """
    x = F.col("embedding")
    whole = rows.where(F.col("vec_id").isNotNull() & x.isNotNull() & (F.size(x) > 0))
    whole = whole.where(F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf")))))
    v = F.transform(x, lambda e: F.floor(e.cast("double") * SCALE).cast("long"))
    out = whole.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    return out.withColumn("sq", F.aggregate("v", F.lit(0).cast("long"), lambda a, e: a + e * e))


def matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products: in floating point while every sum fits 53 bits, else in 64-bit integers."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if top < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


class Pivots:
    """Pivots in the lengthened space, and the borders of their annuli."""

    def __init__(self, sample: np.ndarray, sq: np.ndarray, most: int, pivots: int, rings: int):
        self.most = most
        spots = self.lengthen(sample, sq)
        chosen = [0]
        far = np.linalg.norm(spots - spots[0], axis=1)
        while len(chosen) < min(pivots, len(spots)) and far.max() > 0:
            chosen.append(int(far.argmax()))
            far = np.minimum(far, np.linalg.norm(spots - spots[chosen[-1]], axis=1))
        self.spots = spots[chosen]
        at, d = self.nearest(sample, sq)
        self.borders = np.stack([np.quantile(d[at == i], np.linspace(0, 1, rings + 1)[1:-1]) if (at == i).any() else np.zeros(rings - 1) for i in range(len(self.spots))])
        self.rings = rings

    def lengthen(self, v: np.ndarray, sq: np.ndarray) -> np.ndarray:
        return np.hstack([v.astype(np.float64), np.sqrt(np.maximum(self.most - sq, 0).astype(np.float64))[:, None]])

    def distances(self, v: np.ndarray, sq: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(2 * self.most - 2 * (self.lengthen(v, sq) @ self.spots.T), 0))

    def nearest(self, v: np.ndarray, sq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = np.concatenate([self.distances(v[i : i + 512], sq[i : i + 512]) for i in range(0, len(v), 512)]) if len(v) else np.zeros((0, len(self.spots)))
        at = d.argmin(1)
        return at, d[np.arange(len(d)), at]

    def annulus(self, at: np.ndarray, d: np.ndarray) -> np.ndarray:
        return at * self.rings + (d[:, None] > self.borders[at]).sum(1)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The places of the k highest scores, ties to smaller ids."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = np.flatnonzero(scores >= least)
    else:
        keep = np.arange(len(scores))
    return keep[np.lexsort((ids[keep], -scores[keep]))[:k]]


def reach(most: int, gap: np.ndarray) -> np.ndarray:
    """The highest inner product at a distance of `gap` or more: |q|^2 + |x|^2 - 2 q.x >= gap^2."""
    return most - np.maximum(gap - EPS * most**0.5, 0) ** 2 / 2 + 1


def _search(dim: int, k: int, most: int):
    """Searches blocks of vectors for blocks of queries; rows are pairs of blocks. A row without a vec_id has the number of pairs compared."""
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                q_ids, q, least, dq, ids, v, dx = (np.frombuffer(batch.column(c)[i].as_py(), np.float64 if c in (3, 6) else np.int64) for c in range(7))
                q, v = q.reshape(-1, dim), v.reshape(-1, dim)
                wide = np.sqrt(np.maximum(2 * (most + 1 - least.astype(np.float64)), 0)) + 2 * EPS * most**0.5
                out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
                compared = 0
                for lo in range(0, len(q_ids), TOGETHER):
                    here = slice(lo, lo + TOGETHER)
                    first, last = np.searchsorted(dx, [(dq[here] - wide[here]).min(), (dq[here] + wide[here]).max()])
                    if first == last:
                        continue
                    compared += (last - first) * len(q_ids[here])
                    some = ids[first:last]
                    for row, own, floor in zip(products(q[here], v[first:last]), q_ids[here], least[here], strict=True):
                        keep = np.flatnonzero((row >= floor) & (some != own))
                        keep = keep[best(row[keep], some[keep], k)]
                        out.append((np.full(len(keep), own), some[keep], row[keep]))
                columns = [np.concatenate([x[c] for x in out]) if out else np.zeros(0, np.int64) for c in range(3)]
                yield pa.RecordBatch.from_arrays([pa.array(np.append(columns[0], -1)), pa.array(np.append(columns[1], 0), mask=np.append(np.zeros(len(columns[1]), bool), True)), pa.array(np.append(columns[2], compared))], schema=schema)

    return run


def _gather(names: list[str], more: str, by: str):
    """Rows of a group as one row of bytes, in the order of a column."""

    def run(group: pa.Table) -> pa.Table:
        data = {more: group.column(more).slice(0, 1)}
        order = np.argsort(group.column(by).to_numpy(), kind="stable")
        for n in names:
            c = group.column(n).combine_chunks()
            x = (c.flatten() if pa.types.is_list(c.type) else c).to_numpy(zero_copy_only=False)
            x = x.reshape(len(order), -1)[order]
            data[n] = pa.array([(x if x.dtype == np.float64 else x.astype(np.int64)).tobytes()], pa.binary())
        return pa.table(data)

    return run


def top(rows: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_k(rows: DataFrame, every: int = 100, k: int = K, pivots: int | None = None, rings: int = RINGS, sample: int | None = None, block: int = BLOCK, figures: dict | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score) for each query, a row whose vec_id is divisible by `every`.

    Candidates are all rows with another vec_id; ties go to the smaller vec_id.
    Fewer than k candidates give as many ranks; an empty table gives no rows.
    Vectors that are null or hold null or non-finite components take no part.
    Vectors of another dimension than the most common one raise an error. A
    vec_id that is repeated counts as so many candidates; its first row in
    order of its components is the query. Other columns are ignored. figures
    gets the number of pairs compared, of pairs of queries and vectors, pivots
    and rounds.
    """
    spark = rows.sparkSession
    vectors = materialize(integers(rows.select("vec_id", "embedding")))
    count, most, shortest, dim = vectors.agg(F.count("*"), F.max("sq"), F.min(F.size("v")), F.max(F.size("v"))).first()
    schema = "query_id long, rank int, vec_id long, score long"
    if not count:
        return spark.createDataFrame([], schema)
    if shortest != dim:
        raise ValueError(f"vectors of {shortest} and of {dim} components")
    pivots = pivots or min(MOST_PIVOTS, max(LEAST_PIVOTS, int(count**0.5 / ROOT_SHARE)))
    chosen = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample or max(LEAST_SAMPLE, SAMPLE_EACH * pivots)).toArrow()
    index = Pivots(matrix(chosen.column("v"), dim), chosen.column("sq").to_numpy(), most, pivots, rings)
    n_annuli = len(index.spots) * rings

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                at, d = index.nearest(matrix(b.column(1), dim), b.column(2).to_numpy())
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(index.annulus(at, d), pa.int64()), pa.array(d)], names=["vec_id", "v", "sq", "annulus", "d"])

    keyed = materialize(vectors.mapInArrow(key, "vec_id long, v array<long>, sq long, annulus long, d double"))
    # n_annuli rows, whatever the input
    about = keyed.groupBy("annulus").agg(F.count("*").alias("n"), F.min("d").alias("near"), F.max("d").alias("far")).toPandas()
    n, near, far = np.zeros(n_annuli, np.int64), np.full(n_annuli, np.inf), np.full(n_annuli, -np.inf)
    n[about["annulus"]], near[about["annulus"]], far[about["annulus"]] = about["n"], about["near"], about["far"]

    blocks_of = F.array(*[F.lit(int(-(-x // block)) or 1) for x in n])
    dealt = keyed.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(3)), F.get(blocks_of, F.col("annulus"))) * n_annuli + F.col("annulus"))
    index_blocks = dealt.select("block", F.col("vec_id").alias("ids"), "v", "annulus", F.col("d").alias("dx")).groupBy("block").applyInArrow(_gather(["ids", "v", "dx"], "annulus", "dx"), "annulus long, ids binary, v binary, dx binary")
    index_blocks = materialize(index_blocks)

    queries = keyed.where(F.col("vec_id") % every == 0)
    queries = materialize(queries.groupBy("vec_id").agg(F.min(F.struct("v", "sq")).alias("q")).select("vec_id", "q.*"))
    n_queries = queries.count()
    lowest = -(1 << 62)

    def annuli(begin: int, end: int):
        """Of each query's annuli in falling order of what they can reach, those at places begin to end that reach its floor."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, 1024):
                    b = whole.slice(at, 1024)
                    to_pivots = index.distances(matrix(b.column(1), dim), b.column(2).to_numpy())
                    d = np.repeat(to_pivots, rings, axis=1)
                    can = reach(most, np.maximum(np.maximum(near[None] - d, d - far[None]), 0))
                    can[:, n == 0] = -np.inf
                    order = np.argsort(-can, axis=1, kind="stable")[:, begin:end]
                    i, j = np.nonzero(np.take_along_axis(can, order, 1) >= np.maximum(b.column(3).to_numpy(), lowest)[:, None])
                    a, take = order[i, j], pa.array(i)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), b.column(3).take(take), pa.array(a, pa.int64()), pa.array(d[i, a])], names=["vec_id", "v", "floor", "annulus", "dq"])

        return run

    def search(asked: DataFrame) -> DataFrame:
        """asked: (vec_id, v, floor, annulus, dq). Queries meet the vectors of the annuli that they ask for."""
        many = F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(max(1, n_queries // QUERIES))) * n_annuli + F.col("annulus")
        packed = asked.select(F.col("vec_id").alias("q_ids"), F.col("v").alias("q"), "floor", "annulus", "dq", many.alias("many"))
        packed = packed.groupBy("many").applyInArrow(_gather(["q_ids", "q", "floor", "dq"], "annulus", "dq"), "annulus long, q_ids binary, q binary, floor binary, dq binary")
        pairs = packed.join(index_blocks, "annulus").select("q_ids", "q", "floor", "dq", "ids", "v", "dx")
        return pairs.mapInArrow(_search(dim, k, most), "query_id long, vec_id long, score long")

    found = spark.createDataFrame([], "query_id long, vec_id long, score long, rank int")
    compared = begin = rounds = 0
    step = FIRST
    while n_queries and begin < n_annuli:
        floors = found.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("floor"))
        open_ = queries.join(floors, "vec_id", "left").select("vec_id", "v", "sq", F.coalesce("floor", F.lit(lowest)).alias("floor"))
        asked = open_.mapInArrow(annuli(begin, begin + step), "vec_id long, v array<long>, floor long, annulus long, dq double")
        new = materialize(search(asked))
        pairs = new.where("vec_id IS NULL").agg(F.sum("score")).first()[0]
        if pairs is None:
            # the bounds fall from here on, and k-th scores no more
            break
        compared, begin, step, rounds = compared + pairs, begin + step, step * MORE, rounds + 1
        found = materialize(top(found.select("query_id", "vec_id", "score").unionByName(new.where("vec_id IS NOT NULL")), k))
    if figures is not None:
        figures.update(compared=compared, pairs=n_queries * count, pivots=len(index.spots), rounds=rounds)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


#: The same over all pairs, for DuckDB.
ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 100 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
