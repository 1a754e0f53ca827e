"""The corpus pipeline: quality rules, near-dedup, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``documents``.  A stage's rows are written as Parquet in the
shared folder and reread as the next stage's input, so a lost executor never
reaches back past one stage; it is deleted when the next stage's table is written,
as are the tables that a stage writes for itself.  Empty inputs, null columns and extra columns pass
through as the operators define it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lurescope.llm import common as C
from lurescope.llm import minhash, mixing, oracle, quality_rules, sharding, winnowing
from lurescope.session import delete_path, scratch_path, scratch_scope

#: Near-duplicates of the pipeline: at least this share of the word shingles in common (percent).
NEAR_PERCENT = 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the adaptive quality rules keep."""
    return quality_rules.keep_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str, threshold: int = NEAR_PERCENT) -> DataFrame:
    """One document of each group of near-duplicates (the smallest doc_id), linked from ``threshold`` percent on."""
    return minhash.keep_documents(docs, threshold)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    return winnowing.clean_documents(docs, C.read(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources at their target weights: a row each time that a document is taken."""
    return mixing.mix_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard and slot along the Hilbert curve."""
    return sharding.shard_documents(docs)


STAGES: list[tuple[str, Callable[..., DataFrame]]] = [
    ("quality_rules", quality),
    ("minhash_near_dedup", near_dedup),
    ("winnowing_decontamination", decontaminate),
    ("source_mixing", mix),
    ("hilbert_sharding", shard),
]

#: DuckDB SQL for the rows of ``run`` at ``NEAR_PERCENT``.
ORACLE_SQL: str | None = oracle.PIPELINE


def run(spark: SparkSession, sf_dir: str, near_percent: int = NEAR_PERCENT) -> DataFrame:
    """All stages over ``documents``; near-duplicates are linked from ``near_percent`` percent on."""
    docs, before = C.read(spark, sf_dir, "documents"), None
    options = {"minhash_near_dedup": {"threshold": near_percent}}
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"pipeline_{name}")
        with scratch_scope(spark):
            docs = C.write_table(stage(spark, docs, sf_dir, **options.get(name, {})), path)
        if before:
            delete_path(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
