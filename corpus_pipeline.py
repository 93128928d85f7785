"""From raw documents to a sharded training mix, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
it as Parquet in the shared folder and reads it back for the next one.

In every stage columns may have any names and stay as they are, an empty frame
stays empty, and null texts count as empty ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.llm import decontam, mixing, quality, sharding, simhash
from trailmark.llm.common import scratch_path, written


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts.  Equal texts share one
    fate; empty ones get the score for no features; ids play no part.
    """
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the smallest doc_id, once
    if it repeats.  Empty texts are one group; rows without a doc_id stay.
    """
    return simhash.drop_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage; empty ones stay, repeated rows
    go or stay together.
    """
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix reads them, in order of reading; ties go
    by doc_id.  Repeated rows each count; those without words are not read.
    """
    return mixing.mix(docs)


def write_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard that holds each row of the mix, and its position in the order
    of reading; merged shards are sorted by it.  Every row is kept, repeated
    ones and those with nulls too.
    """
    rows = sharding.shard(mixing.with_position(docs), scratch_path(spark, "shards"), order_col="position")
    return rows.select("doc_id", "lang", "source", "n_chars", F.col("_shard").alias("shard"), F.col("_tier").alias("tier"), "position")


STAGES = [
    ("quality", keep_quality),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", write_shards),
]

#: Fitted models and fingerprints are beyond SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
