"""The training-data pipeline: stages over the documents, each written and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagtrack.llm import decontaminate, mixing, neardup, quality, sharding
from tagtrack.llm.common import free_name, saved

SHARDS = 24


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.filtered(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (five-word shingles, 80 % alike)."""
    return neardup.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, written in the order in which their sources interleave."""
    return mixing.in_order(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its shard and its slot there: shards are runs of the mixed order, shuffled inside stretches."""
    size = F.octet_length(F.coalesce("text", F.lit(""))) + 8
    place = free_name(docs, "_place")
    return sharding.sharded(mixing.numbered(docs, place), SHARDS, row_bytes=size, order=place)


STAGES = [
    ("quality classifier", quality_filter),
    ("near dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing", mix),
    ("sharding", shard),
]

#: the classifier's fit, the sketches and the schedule are no SQL; tests/llm hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, from the documents table on."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
