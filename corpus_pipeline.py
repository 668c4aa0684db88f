"""The training-corpus pipeline: each stage works on all that the one before kept.

A stage but the last returns the rows that it keeps as they are, with all columns of its input, extra ones and clashing names
too. What becomes of odd rows:

* quality rules: null and empty texts have no words and go, like all of fewer than 20 words; a null doc_id is no reason to go;
  rows that repeat are judged alike; very long texts are measured whole.
* SimHash near-dedup: of the rows of a group one stays, also of rows that repeat in all columns; that with the smallest
  doc_id, null last.
* benchmark decontamination: null and empty texts hold no item and stay; an empty benchmark removes nothing.
* mixing: a row stays if its fixed number is below its rate, so rows that repeat stay or go together; without labels all stay.
* token-ID output: null and empty texts are the end token; null doc_ids come first.

An empty table of documents gives an empty result at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siltstone.llm import common, decontam, mixing, queries, rules, simhash, tokenstore

#: Weights of the mixing stage: what is kept of each domain's expected words.
MIX = {"high": 1.0, "low": 1.0, "toxic": 0.0}
#: What staying near a rate of one weighs: good documents are not given up for the last traces of other domains.
MIX_SLACK = 0.005


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return rules.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(docs, queries.table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.draw(docs, queries.table(spark, sf_dir, "labels"), keep=MIX, slack=MIX_SLACK)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return tokenstore.digest(docs, queries.tokenizer_path())


STAGES = [
    ("quality rules", quality),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing to target weights", mixture),
    ("token-ID output", tokens),
]

#: SQL can express neither fingerprint components nor the fitted rates; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
