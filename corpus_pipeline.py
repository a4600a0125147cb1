"""The training-corpus pipeline: quality rules, near-duplicates, benchmark leaks, source mix, shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next
stage's docs. run() applies them to the documents of sf_dir. An empty table gives an empty result; columns beside those
of documents pass through all stages, unless they are named like a result of the last one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskloom.llm.common import documents, table, written
from riskloom.llm.near_copies import near_clusters
from riskloom.llm.op2_rules import keep
from riskloom.llm.op3_slots import sharded
from riskloom.llm.op6_templates import clean
from riskloom.llm.op8_simhash import keep_one
from riskloom.llm.op10_mixing import mixed


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that policy 1 of the quality ledger keeps; null and empty texts are too short and go."""
    return keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8): that of the least doc_id, nulls last.

    SimHash links of op8's grid come first, buckets of shingles find the copies that these miss; all are verified.
    """
    return keep_one(docs, near_clusters)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents into which no item of benchmark leaks, neither verbatim nor with other names, numbers or units."""
    return clean(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source's documents as often as its target asks, by weights 1, 2, 3 in order of source, null last."""
    return mixed(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with the shard and the place in it that the slot map gives each; rows that the mix repeats take places of their own."""
    return sharded(docs, carry=True)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("mix", mix), ("shard", shard)]

#: SQL is too slow on whole tables for the near-duplicate stage's similarities; tests/llm hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
