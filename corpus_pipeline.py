"""Corpus pipeline: toxicity, near duplicates, benchmark passages, source mix, shards.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame.  All but the last return the columns of ``documents``.
Each stage works on all rows that its predecessor kept:

* toxicity drops documents with a score of 0.5 or more;
* near_dedup keeps one document of each group of similarity 0.8 or more, the one
  with the smallest doc_id; documents without words are kept;
* decontamination drops documents that hold a benchmark item;
* mixing repeats or drops documents so that the sources meet their targets;
* sharding adds the shard of each row in a column ``shard``; a column of documents
  called so is kept as ``input_shard``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanwell.llm import decontam, mixing, neardup, sharding, toxicity
from spanwell.llm.common import scratch, stored, table

SHARDS = 16


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.accepted(docs, model)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.one_of_each(docs, percent=80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(docs, "doc_id", SHARDS)


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: SQL cannot express the stages; tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch() as kept:  # what a stage stored on its way goes when its rows are written
            docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
            kept.append(docs)
    return STAGES[-1][1](spark, docs, sf_dir)
