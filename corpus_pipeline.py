"""A corpus pipeline: toxic documents out, near-duplicates folded, benchmark leaks out, sources
mixed to their weights, the mix put into shards.

Each stage is a function of (spark, docs, sf_dir). Its result is written as Parquet and read
again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from platwork.llm import dartminhash, decontamination, mixing, sharding, toxicity
from platwork.llm.frames import table, written


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return dartminhash.without_near_duplicates(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixture(docs)


def in_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shard_by_ranges(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("near-duplicates", without_near_duplicates),
    ("benchmark", without_benchmark),
    ("mixing", mixed_sources),
    ("sharding", in_shards),
]

#: Trained models decide what stays, which SQL can't express; the tests hold the stages against
#: brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
