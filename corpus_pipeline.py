"""The corpus pipeline: stages over ``documents``, each written as Parquet and reread by the next.

As a stage's result is written before the next stage begins, the next one removes the tables that the stage stored on
its way. Repeated rows, nulls and empty tables are treated as the operators say.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from recordqc.llm import decontam, mixing, probminhash, quality, sharding
from recordqc.llm.common import STORED, release, stored, table

_LEFT: dict[str, list[str]] = {}


def _stage(made):
    @wraps(made)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        app = spark.sparkContext.applicationId
        release(spark, _LEFT.pop(app, []))
        before = len(STORED)
        out = made(spark, docs, sf_dir)
        _LEFT[app] = STORED[before:]
        return out
    return run_stage


@_stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the outlier rule keep."""
    measured = stored(quality.measure(docs), "pipeline-quality")
    return quality.judge(measured).where("kept").select(*docs.columns)


@_stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return probminhash.keep_one(docs)


@_stage
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of benchmark items; those that consist of them go."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


@_stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.repeated(mixing.mix(docs)).select(*docs.columns)


@_stage
def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard and slot."""
    return sharding.shard(docs)


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("decontaminate", decontaminate),
          ("mix_sources", mix_sources), ("shard", shard)]
#: Random order sampling, scatter estimates and label propagation have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
