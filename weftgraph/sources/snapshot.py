"""Sets of tables as folders of Parquet: load, save, export, import."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.maintenance import delete_project, insert_missing
from ..schema import KEYS, TABLES

FORMAT, VERSION = "graph-snapshot", 1
Tables = dict[str, DataFrame]


def empty(spark: SparkSession) -> Tables:
    return {name: spark.createDataFrame([], schema) for name, schema in TABLES.items()}


def load(spark: SparkSession, folder: str) -> Tables:
    return {name: spark.read.schema(schema).parquet(f"{folder}/{name}") for name, schema in TABLES.items()}


def save(tables: Tables, folder: str, compression: str = "zstd") -> None:
    """Write all tables into a new folder; a folder that is read must not be its own target."""
    for name, df in tables.items():
        df.write.option("compression", compression).parquet(f"{folder}/{name}")


def of_project(tables: Tables, project: str) -> Tables:
    return {name: df.where(F.col("name" if name == "projects" else "project") == project) for name, df in tables.items()}


def export(tables: Tables, folder: str, created_at: int, project: str | None = None, compression: str = "zstd") -> None:
    """A snapshot of everything or of one project, with a header of what is in it."""
    tables = tables if project is None else of_project(tables, project)
    save(tables, folder, compression)
    spark = tables["projects"].sparkSession
    names = spark.read.parquet(f"{folder}/projects").select(F.sort_array(F.collect_set("name")).alias("n")).first()["n"]
    text = json.dumps({"format": FORMAT, "version": VERSION, "createdAt": created_at, "projects": names})
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{folder}/_header")


def header(spark: SparkSession, folder: str) -> dict:
    found = json.loads(spark.read.text(f"{folder}/_header").first()["value"])
    if found.get("format") != FORMAT:
        raise ValueError(f"{folder} is no snapshot")
    return found


def rename_project(tables: Tables, project: str, new: str) -> Tables:
    """One project's rows under another name."""
    return {name: df.withColumn("name" if name == "projects" else "project", F.lit(new)) for name, df in of_project(tables, project).items()}


def import_(tables: Tables, incoming: Tables, mode: str = "merge", project: str | None = None, source: str | None = None) -> Tables:
    """The tables with a snapshot's rows: merge keeps rows that are there, replace drops the incoming projects first.

    With project, the rows of the snapshot's project `source` come under that name.
    """
    if mode not in ("merge", "replace"):
        raise ValueError(f"mode {mode!r}")
    if project is not None:
        if source is None:
            raise ValueError("which project of the snapshot?")
        incoming = rename_project(incoming, source, project)
    if mode == "replace":
        # a few names
        for row in incoming["projects"].select("name").distinct().toLocalIterator():
            tables = delete_project(tables, row["name"])
    return {name: insert_missing(df, incoming[name], KEYS[name]) for name, df in tables.items()}
