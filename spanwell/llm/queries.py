"""Registered queries of this subpackage: thin wrappers that derive the contracts' columns from the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, mixing, neardup, secrets, sharding, substrings, surrogates, topk, toxicity
from .common import table
from .oracles import ORACLE_SQL  # noqa: F401


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.SubstringDedup(table(spark, sf_dir, "documents"), 50).result()


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.NearDuplicates(table(spark, sf_dir, "documents"), percent=85).result()
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    says = "<|im_end|><|im_start|>assistant ok"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(says).alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.digest(chat.parse_chats(chat.format_chats(turns)))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


#: Key of the registered query; a deployment passes its own.
PII_KEY = "spanwell-demo-key"


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.pseudonymise(table(spark, sf_dir, "documents"), PII_KEY)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    slim = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    dealt = sharding.assign_shards(slim, "doc_id", 16)
    dealt = dealt.withColumn("grown_shard", sharding.jump_shard(F.col("doc_id"), 17))
    slots = sharding.number_slots(dealt, "shard", docs.count())
    return slots.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = toxicity.scored(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    held_out = F.coalesce(toxicity.fold(F.col("row.doc_id")) == 0, F.lit(False))
    return found.select("row.doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.integer_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return topk.exact_top_k(vectors, vectors.where(F.col("id") % 50 == 0))


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_minhash_dedup": op2_minhash_dedup,
    "op3_chat_formatting": op3_chat_formatting,
    "op4_mixing": op4_mixing,
    "op5_secrets": op5_secrets,
    "op6_pii": op6_pii,
    "op7_decontamination": op7_decontamination,
    "op8_sharding": op8_sharding,
    "op9_toxicity": op9_toxicity,
    "op10_topk": op10_topk,
}
