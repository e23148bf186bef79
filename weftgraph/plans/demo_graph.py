"""A property graph as a view of the relational tables region ... lineitem.

The statements are the same for Spark and for any other SQL engine, so that
results can be held against each other. {name} stands for a table.

Every row of the tables takes part. A part CALLS the next of its brand and the
next of its type; parts that follow each other in an order are CALL_REFERENCEs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages")


def _node(key: str, base: int, label: str, file: str, name: str, qualified: str, doc: str, source: str) -> str:
    return (
        f"SELECT CAST({base} + {key} AS BIGINT) AS id, 'tpch' AS project, {file} AS file, CAST(1 AS INT) AS start_line, '{label}' AS label, "
        f"{name} AS name, {qualified} AS qualified, CAST(NULL AS VARCHAR(100)) AS signature, {doc} AS doc FROM {source}"
    )


NODES = " UNION ALL ".join(
    [
        _node("r_regionkey", 1_000_000_000, "Package", "'geo/region.tbl'", "r_name", "'geo.' || r_name", "CAST(NULL AS VARCHAR(100))", "{region}"),
        _node("n_nationkey", 2_000_000_000, "Module", "'geo/nation.tbl'", "n_name", "'geo.' || r_name || '.' || n_name", "CAST(NULL AS VARCHAR(100))", "{nation} JOIN {region} ON n_regionkey = r_regionkey"),
        _node("c_custkey", 3_000_000_000, "Class", "'crm/' || c_mktsegment || '.cs'", "c_name", "'crm.' || c_mktsegment || '.' || c_name", "CAST(NULL AS VARCHAR(100))", "{customer}"),
        _node("s_suppkey", 4_000_000_000, "Interface", "'scm/supplier.ts'", "s_name", "'scm.supplier.' || s_name", "CAST(NULL AS VARCHAR(100))", "{supplier}"),
        _node("p_partkey", 5_000_000_000, "Function", "'parts/' || p_brand || '.py'", "p_name", "'parts.' || p_brand || '.p' || CAST(p_partkey AS VARCHAR(20))", "p_type", "{part}"),
        _node("o_orderkey", 6_000_000_000, "Method", "'sales/' || o_orderstatus || '.java'", "'order_' || CAST(o_orderkey AS VARCHAR(20))", "'sales.' || o_orderstatus || '.order_' || CAST(o_orderkey AS VARCHAR(20))", "CAST(NULL AS VARCHAR(100))", "{orders}"),
    ]
)


def _edge(src: str, dst: str, kind: str, confidence: str, rest: str) -> str:
    return f"SELECT CAST({src} AS BIGINT) AS src, CAST({dst} AS BIGINT) AS dst, '{kind}' AS type, {confidence} AS confidence FROM {rest}"


_NEXT = (
    "(SELECT l_partkey AS a, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS b FROM {lineitem}) pairs "
    "WHERE b IS NOT NULL GROUP BY a, b"
)
_CHAIN = (
    "(SELECT p_partkey AS a, lead(p_partkey) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS b FROM {part} "
    "UNION SELECT p_partkey, lead(p_partkey) OVER (PARTITION BY p_type ORDER BY p_partkey) FROM {part}) pairs WHERE b IS NOT NULL"
)
EDGES = " UNION ALL ".join(
    [
        _edge("3000000000 + c_custkey", "2000000000 + c_nationkey", "MEMBER_OF", "'exact'", "{customer}"),
        _edge("4000000000 + s_suppkey", "2000000000 + s_nationkey", "MEMBER_OF", "'exact'", "{supplier}"),
        _edge("2000000000 + n_nationkey", "1000000000 + n_regionkey", "MEMBER_OF", "'exact'", "{nation}"),
        _edge("3000000000 + o_custkey", "6000000000 + o_orderkey", "DEFINES_METHOD", "'exact'", "{orders}"),
        _edge("6000000000 + l_orderkey", "5000000000 + l_partkey", "USES_TYPE", "CASE min(CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END) WHEN 1 THEN 'exact' WHEN 2 THEN 'reference' ELSE 'usage' END", "{lineitem} GROUP BY l_orderkey, l_partkey"),
        _edge("5000000000 + l_partkey", "4000000000 + l_suppkey", "USES_TYPE", "'exact'", "{lineitem} GROUP BY l_partkey, l_suppkey"),
        _edge("5000000000 + a", "5000000000 + b", "CALLS", "'exact'", _CHAIN),
        _edge("5000000000 + a", "5000000000 + b", "CALL_REFERENCE", "'reference'", _NEXT),
        _edge("6000000000 + o_orderkey", "NULL", "USAGE", "'usage'", "{orders} WHERE o_orderpriority = '5-LOW'"),
    ]
)
#: CREATE-free prefix for SQL that uses nodes and edges.
WITH_GRAPH = "WITH RECURSIVE nodes AS ({nodes}), edges AS ({edges})"


def plain(sql: str) -> str:
    """A statement over tables by their own names."""
    return reduce(lambda s, t: s.replace("{" + t + "}", t), BASE, sql)


def prefix() -> str:
    return f"WITH RECURSIVE nodes AS ({plain(NODES)}), edges AS ({plain(EDGES)})"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sql(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    used = {t: read(spark, sf_dir, t) for t in BASE if "{" + t + "}" in sql}
    return spark.sql(sql, **used)


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, NODES)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, EDGES)
