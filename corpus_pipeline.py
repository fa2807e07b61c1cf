"""From raw documents to shards of training data.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents. Stages handle what their operators handle; see there for nulls, ties and empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from diarist.scratch import materialize, scratch_path
from llm import near_dedup, poisson_mix, quality_mil, slots, winnow


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the attention model, learned from labels, doesn't reject."""
    model = quality_mil.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_mil.score(docs, model).where("predicted = 1").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose SimHash fingerprints link at four bits, that of smallest doc_id."""
    return near_dedup.keep_one(docs, radius=4, width=4)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    matched = winnow.matches(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return matched.where("size(items) = 0").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or thin out each source to its target weight, and shuffle."""
    mixed = poisson_mix.mix_documents(docs, scratch_path(spark, "rates"))
    return mixed.select(*docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Eight shards of near equal bytes: the columns of documents, and the place in the shards."""
    placed = slots.shard(docs, 8, scratch_path(spark, "slot-map"))
    return placed.select(*docs.columns, *(c for c in ("size", "shard", "slot", "virtual_slot") if c not in docs.columns))


STAGES = [
    ("quality", keep_quality),
    ("near_dedup", drop_near_copies),
    ("decontaminate", decontaminate),
    ("mix", mix_sources),
    ("shard", shard),
]
# Learning, fingerprints and their components can't be said in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
