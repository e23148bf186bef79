"""Cutting lineage between the rounds of an iterative plan, and broadcasts of a measured size."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a few small columns up to which a table is sent to every task.
SMALL = 200_000


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset, a local one, which only a local master may have."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoint-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the folder of spark.checkpoint.dir."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def small(df: DataFrame, most: int = SMALL) -> DataFrame:
    """df, marked for broadcast if it has no more than so many rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def merged(df: DataFrame) -> DataFrame:
    """df, as a side of a join whose sides both grow: sorted and merged, never sent through the driver, whatever its size is taken for."""
    return df.hint("merge")
