"""A corpus pipeline: quality rules, toxicity, near-duplicates, packing.

Each stage takes the documents that the stage before kept, with all their
columns, and its decisions take effect; the last returns the packed pieces.
Rows with a null or blank text fall at the quality rules; repeated rows are one
group of copies; an empty table goes through and gives no pieces; columns beside
doc_id and text, whatever their names, are carried and not looked at; texts of
any length are taken whole.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from weftgraph.llm import packing, quality, simhash, toxicity
from weftgraph.llm.common import materialize, table


#: Compared first: fingerprints of word pairs at 5 bits or fewer, in six segments. Links: all five-word shingle sets alike by 0.8.
SHINGLE, DISTANCE, SEGMENTS = 2, 5, 6
VERIFY, SIMILARITY = 5, 0.8


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents within the compression bands that don't fail the base rules."""
    return quality.keep_good(docs)


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score below the threshold; the classifier is trained on these documents and the labels."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked texts the document with the least doc_id; links are all pairs with a five-word similarity of 0.8 or more."""
    return simhash.keep_one(docs, shingle=SHINGLE, distance=DISTANCE, segments=SEGMENTS, similarity=SIMILARITY, verify=VERIFY)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_rules),
    ("toxicity", toxicity_filter),
    ("near_dedup", near_dedup),
    ("packing", pack),
]
#: Compression, classifier training and connected components have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict:
    return {}
