"""The corpus pipeline: language ID, near-duplicates, decontamination, mixing, sharding."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm import decontam, langid, minhash, mixing, sharding
from tidewright.llm._spark import materialize

SHARDS = 8


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; those whose text is null or has no letters go."""
    profiles = langid.train(docs.filter(langid.learns()))
    return langid.predict(docs, profiles).filter(F.col("lang_pred") != langid.UNKNOWN).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates.

    It is the one with the smallest doc_id, then the smallest hash of its text; of rows that share both, one stays. A row is
    judged by its own text, so rows that share a doc_id but not their text are not taken for each other. Rows without doc_id
    or without words stay; an empty table stays empty.
    """
    return minhash.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark. Texts that are null or empty have none and stay; without items every row stays."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontam.contamination(docs, items).filter("kept").select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources: each document as often as the mix takes it, in the shards and the order that the mix draws.

    Null sources are one source, equal doc_ids of a source are taken together, and documents without words once in each
    whole pass; an empty table stays empty.
    """
    return mixing.draw(mixing.mix(docs, SHARDS), docs.columns)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard and its slot there: by doc_id, a null one as -1. Repeated rows have slots of their own."""
    return sharding.shard(docs, SHARDS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixed),
    ("sharding", sharded),
]

#: No SQL: the near-duplicate stage's sketches and the mix's permutation are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to `documents`; each stage's rows are written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs, _ = materialize(docs)
    return docs
