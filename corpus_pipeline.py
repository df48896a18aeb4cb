"""A corpus pipeline of the training-data operators: each stage is written and reread as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm import toxicity
from gridloom.llm.common import durable
from gridloom.llm.decontam import decontaminate
from gridloom.llm.mixing import mix
from gridloom.llm.sharding import shard_documents
from gridloom.llm.simhash import drop_near_duplicates


def no_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose whole text scores 0.3 or more. The classifier learns from labelled documents in docs."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.drop_toxic(docs, model)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of SimHash near-duplicates."""
    return drop_near_duplicates(docs)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which a span of any benchmark item occurs."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixes the sources to their target weights; documents taken twice stand twice."""
    return mix(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deals the documents to eight shards of near equal bytes."""
    return shard_documents(docs, 8)


STAGES = [
    ("toxicity", no_toxic),
    ("simhash near-dedup", one_of_each),
    ("benchmark decontamination", no_benchmark),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: SQL cannot express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
