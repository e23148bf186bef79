"""Hashed vectors: embedding, quantisation, cosine and hybrid ranking."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, ByteType, DoubleType, StructField, StructType

from ..operators.lineage import cut
from ..schema import CODE_LABELS
from . import text as T

DIM = 256
#: Vectors that a task makes at once.
ROWS = 1024
VECTOR_WEIGHT, TEXT_WEIGHT = 0.55, 0.30
#: A strategy turns a table, the name of its id and a text column into (id, vec).
Strategy = Callable[[DataFrame, str, Column], DataFrame]


def hash32(c: Column) -> Column:
    """A 32-bit hash of the characters, in the arithmetic of doubles: xor gives a signed number, its product is rounded to 53 bits."""
    chars = F.transform(F.split(c, ""), lambda x: F.ascii(x))
    seed = F.lit(2166136261).cast("long")

    def step(h: Column, code: Column) -> Column:
        x = h.bitwiseXOR(code.cast("long"))
        signed = F.when(x >= 2147483648, x - F.lit(4294967296).cast("long")).otherwise(x)
        product = signed.cast("double") * F.lit(16777619.0)
        return F.pmod(product, F.lit(4294967296.0)).cast("long")

    return F.aggregate(F.filter(chars, lambda x: x > 0), seed, step)


def l2_normalize(v: Column) -> Column:
    """A vector of length one; zero stays zero."""
    # v and its length are bound by one-element arrays, else each element would compute both anew
    length = lambda a: F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    scale = lambda a: F.transform(F.array(length(a)), lambda n: F.transform(a, lambda x: x.cast("double") / F.when(n > 0, n).otherwise(1.0)))
    return F.get(F.get(F.transform(F.array(v), scale), F.lit(0)), F.lit(0))


def dot(a: Column, b: Column) -> Column:
    n = F.least(F.size(a), F.size(b))
    products = F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Over the shorter length; 0 if either vector is zero."""
    n = F.least(F.size(a), F.size(b))
    x, y = F.slice(a, 1, n), F.slice(b, 1, n)
    norm = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
    return F.when(norm > 0, dot(x, y) / norm).otherwise(0.0)


def quantize(v: Column) -> Column:
    """8-bit steps of 1/127, halves rounded up."""
    return F.transform(v, lambda x: F.greatest(F.lit(-128), F.least(F.lit(127), F.floor(x.cast("double") * 127 + 0.5))).cast("tinyint"))


def dequantize(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double") / 127)


def round4(c: Column) -> Column:
    return F.floor(c * 10000 + 0.5) / 10000


def hash32_text(s: str) -> int:
    """hash32() of a Python string."""
    h = 2166136261
    for c in map(ord, s):
        if c:
            x = h ^ c
            h = int(float(x - 4294967296 if x >= 2147483648 else x) * 16777619.0 % 4294967296.0)
    return h


@lru_cache(maxsize=1 << 16)
def _signed(gram: str, size: float) -> tuple[int, float]:
    h = hash32_text(gram)
    return h % DIM, size if h % 2 == 0 else -size


@lru_cache(maxsize=1 << 14)
def _grams(word: str) -> tuple[tuple[int, float], ...]:
    """(index, contribution): the word by its length, each pair of neighbouring letters by a half."""
    pairs = (_signed(word[i : i + 2], 0.5) for i in range(len(word) - 1))
    return (_signed(word, min(len(word), 4) + 1.0), *pairs)


def _vectors(batches: Iterator[pa.RecordBatch], made: Callable[[pa.RecordBatch, np.ndarray], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """made(rows, sums) of rows (id, ..., words) in order of id: of rows of one id the first, with the sum of all.

    Contributions are multiples of a half, so that sums are exact in any order.
    """
    held, sums = None, np.zeros((0, DIM))
    for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
        ids, at, sizes, firsts = batch.column(0).to_pylist(), [], [], []
        for j, words in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
            if not j or ids[j] != ids[j - 1]:
                firsts.append(j)
            base = (len(firsts) - 1) * DIM
            for w in words.split(" ") if words else ():
                for i, size in _grams(w):
                    at.append(base + i)
                    sizes.append(size)
        rows, more = batch.take(pa.array(firsts)), np.bincount(np.array(at, dtype=np.int64), np.array(sizes), len(firsts) * DIM).reshape(-1, DIM)
        if held is not None and held.column(0)[0].as_py() == ids[0]:
            more[0] += sums[0]
        elif held is not None:
            rows, more = pa.concat_batches([held, rows]), np.concatenate([sums, more])
        # the next batch may go on with the last id
        held, sums = rows.slice(rows.num_rows - 1), more[-1:]
        if rows.num_rows > 1:
            yield made(rows.slice(0, rows.num_rows - 1), more[:-1])
    if held is not None:
        yield made(held, sums)


def embed(df: DataFrame, id: str, text: Column, *more: str, quantized: bool = False) -> DataFrame:
    """(id, more, vec): the hashed vector of each text, of length one; a text without words gives zero. Texts of one id add up.

    Texts are dealt out by id, each task sums its own: no word or pair of
    letters is a key, so a frequent one is no load on one task, and a task holds
    a sorted run that can spill and ROWS vectors. quantized gives quantize() of
    the vector.
    """

    def made(rows: pa.RecordBatch, sums: np.ndarray) -> pa.RecordBatch:
        length = np.sqrt((sums * sums).sum(axis=1))
        values = sums / np.where(length > 0, length, 1.0)[:, None]
        if quantized:
            values = np.clip(np.floor(values * 127 + 0.5), -128, 127).astype(np.int8)
        vec = pa.ListArray.from_arrays(pa.array(np.arange(len(sums) + 1, dtype=np.int32) * DIM), pa.array(values.ravel()))
        return pa.RecordBatch.from_arrays([*rows.columns[:-1], vec], names=[*rows.schema.names[:-1], "vec"])

    rows = df.select(F.col(id).alias("id"), *more, T.normalize_identifier(text).alias("_words"))
    out = StructType([*rows.schema.fields[:-1], StructField("vec", ArrayType(ByteType() if quantized else DoubleType()))])
    return rows.repartition("id").sortWithinPartitions("id").mapInArrow(lambda batches: _vectors(batches, made), out)


def node_text() -> Column:
    """What is embedded of a node; name and qualified name count twice."""
    parts = [T.normalize_identifier(F.coalesce(c, F.lit(""))) for c in ("name", "qualified", "signature", "doc", "name", "qualified")]
    return F.concat_ws(" ", *parts)


def build_index(nodes: DataFrame, project: str | None = None, strategy: Strategy | None = None) -> DataFrame:
    """schema.EMBEDDINGS of the nodes with a name and a label of code; strategy makes the vectors of (df, id, text), by default embed()."""
    mine = nodes if project is None else nodes.where(F.col("project") == project)
    used = mine.where(F.col("label").isin(*CODE_LABELS) & (F.trim("name") != ""))
    if strategy is None:
        return embed(used, "id", node_text(), "project", quantized=True).withColumnRenamed("id", "node_id")
    return strategy(used, "id", node_text()).join(used.select("id", "project"), "id").select(F.col("id").alias("node_id"), "project", quantize(F.col("vec")).alias("vec"))


def query_vector(spark, text: str) -> list[float]:
    """The vector of one text, on the driver."""
    row = embed(spark.createDataFrame([(0, text)], "id long, text string"), "id", F.col("text")).first()
    return row["vec"]


def cosine_top(vectors: DataFrame, id: str, vec: str, query: list[float], k: int) -> DataFrame:
    """(id, score): the k nearest by cosine, exact."""
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = vectors.select(F.col(id).alias("id"), F.round(cosine(F.col(vec), q), 6).alias("score"))
    return scored.orderBy(F.desc("score"), "id").limit(k)


def cosines(embeddings: DataFrame, query: list[float]) -> DataFrame:
    """(id, cos): cosine(dequantize(vec), query), to the last bit, as sums run from the first element on."""
    q = np.array(query, dtype=np.float64)

    def total(x: np.ndarray) -> np.ndarray:
        return np.cumsum(x, axis=1)[:, -1] if x.shape[1] else np.zeros(len(x))

    def of(x: np.ndarray) -> np.ndarray:
        n = min(x.shape[1], len(q))
        x, y = x[:, :n] / 127.0, q[None, :n]
        norm = np.sqrt(total(x * x)) * np.sqrt(total(y * y))
        return np.where(norm > 0, total(x * y) / np.where(norm > 0, norm, 1.0), 0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            vec = batch.column(1)
            sizes = set(vec.value_lengths().to_pylist())
            if len(sizes) == 1 and None not in sizes and vec.flatten().null_count == 0:
                cos = of(vec.flatten().to_numpy().reshape(batch.num_rows, -1) if sizes != {0} else np.zeros((batch.num_rows, 0)))
            else:
                cos = [of(np.array([v or []], dtype=np.float64).reshape(1, -1))[0] for v in vec.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cos, pa.float64())], names=["id", "cos"])

    rows = embeddings.select(F.col("node_id").alias("id"), "vec")
    return rows.mapInArrow(run, StructType([rows.schema["id"], StructField("cos", DoubleType())]))


def semantic_query(
    nodes: DataFrame,
    embeddings: DataFrame,
    text: str,
    limit: int = 10,
    vector_weight: float = VECTOR_WEIGHT,
    text_weight: float = TEXT_WEIGHT,
    with_signals: bool = False,
    project: str | None = None,
    weights: dict[str, float] | None = None,
) -> DataFrame:
    """(id, name, qualified, label, file, score): embedded nodes by cosine, full text and optional signals.

    Text ranks are scaled within BM25 hits, and within substring hits below
    them; nodes that the text doesn't find get 0 for it.
    """
    # an index that is not stored yet is made once, and only its cosines are kept
    out = cut(cosines(embeddings, query_vector(nodes.sparkSession, text)))
    if out.isEmpty():
        raise ValueError("no vectors; build the index first")
    hits = T.search_text(nodes, text, max(limit * 10, 20))
    lo, hi = (f("rank").over(Window.partitionBy()) for f in (F.min, F.max))  # over `limit` * 10 rows
    fts = hits.select("id", F.when(hi == lo, 1.0).otherwise(1 - (F.col("rank") - lo) / (hi - lo)).alias("fts"))
    out = out.join(F.broadcast(fts), "id", "left")  # `limit` * 10 rows
    score = F.lit(vector_weight) * F.col("cos") + F.lit(text_weight) * F.coalesce("fts", F.lit(0.0))
    if with_signals:
        sig = T.combine(T.normalize(T.signals(nodes, text, project or ""), T.SIGNALS), weights)
        out = out.join(sig, "id", "left")
        score = score + F.lit(1 - vector_weight - text_weight) * F.coalesce("signal", F.lit(0.0))
    top = out.select("id", round4(score).alias("score")).orderBy(F.desc("score"), "id").limit(limit)
    return nodes.join(F.broadcast(top), "id").select("id", "name", "qualified", "label", "file", "score").orderBy(F.desc("score"), "id")
