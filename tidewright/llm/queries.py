"""The registered queries of this package and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, langid, line_dedup, minhash, mixing, quality_cnn, repetition, sharding, suffix_dedup, toxicity
from ._spark import held_out
from .oracles import ORACLE  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    size, crc = (F.octet_length(text) + 1).cast("long"), F.crc32(text.cast("binary"))
    docs = table(spark, sf_dir, "documents").select("doc_id", size.alias("size"), crc.alias("text_crc32"))
    return sharding.shard(docs, 8, ties=("text_crc32", "size")).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    shards, ranks = F.col("places")["shard"].alias("shards"), F.col("places")["rank"].alias("ranks")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("places")).alias("taken"), shards, ranks)


def op3_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return repetition.repetition(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _in_fold_0() -> Column:
    return F.coalesce(held_out("doc_id", 5) == 0, F.lit(False)).alias("held_out")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(toxicity.labelled(docs, table(spark, sf_dir, "labels"), "toxic"))
    return toxicity.compare(docs, model).select("doc_id", _in_fold_0(), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    net = quality_cnn.train(docs, table(spark, sf_dir, "labels").filter(held_out("doc_id", 5) != 0))
    return quality_cnn.score(docs, net).select("doc_id", _in_fold_0(), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    profiles = langid.train(docs.filter(langid.learns()))
    out = langid.predict(docs.select("doc_id", "text"), profiles)
    return out.select("doc_id", F.coalesce(held_out("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.concat_ws(",", F.col("hits.item_id").cast("array<string>")).alias("item_ids"), F.size("hits").cast("long").alias("n_items"), "kept")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.fuzzy_line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_substrings(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("spans")


QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_mixing": op2_mixing,
    "op3_repetition": op3_repetition,
    "op4_toxicity": op4_toxicity,
    "op5_quality_cnn": op5_quality_cnn,
    "op6_langid": op6_langid,
    "op7_decontamination": op7_decontamination,
    "op8_line_dedup": op8_line_dedup,
    "op9_minhash": op9_minhash,
    "op10_suffix_dedup": op10_suffix_dedup,
}
