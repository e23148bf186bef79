"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import tempfile
import zlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch that are held as Python strings at once.
SLICE = 256
#: Maps A-Z to a-z and leaves every other byte alone.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint.

    It lies in the folder of spark.checkpoint.dir, which all executors share, so
    a lost executor loses nothing. Only where that is unset and the master is
    local a folder of this machine is used.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if folder is None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint()


def words(data: bytes) -> list[bytes]:
    """The words `[^\\x20\\x09-\\x0D]+` of UTF-8 bytes."""
    return data.split()


def crc_of_id(doc_id: int | None) -> int:
    """crc32 of doc_id written as text; 0, as of an empty text, for null."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode())


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches' rows in pieces of at most SLICE, without a copy."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


def release() -> None:
    """Give back to the system what Arrow's pool and the C library keep of freed memory; a Python worker lives on from stage to stage."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def map_texts(
    df: DataFrame,
    make: Callable[[], Callable[[list], dict[str, list]]],
    schema: str,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """key and what make()(texts) returns for texts of SLICE rows at a time.

    make runs once in each task, so that it can load tables. Memory is bounded
    by an Arrow batch and the strings of one slice.
    """
    arrow = pa.schema([(key, pa.int64()), *_fields(schema)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in slices(batches):
            found = work(batch.column(1).to_pylist())
            arrays = [batch.column(0).cast(pa.int64())]
            arrays += [pa.array(found[f.name], f.type) for f in list(arrow)[1:]]
            yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return df.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias(text)).mapInArrow(run, f"{key} long, {schema}")


def filter_rows(df: DataFrame, make: Callable[[], Callable[[list], Iterable[bool]]], text: str = "text") -> DataFrame:
    """The rows, with all their columns, whose text make()(texts) holds for."""
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in slices(batches):
            yield batch.filter(pa.array(work(batch.column(at).to_pylist()), pa.bool_()))

    return df.mapInArrow(run, df.schema)


_TYPES = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}


def _fields(schema: str) -> list[tuple[str, pa.DataType]]:
    return [(name, _TYPES[kind]) for name, kind in (part.split() for part in schema.split(","))]
