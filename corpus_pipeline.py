"""Corpus pipeline: toxicity, SimHash near-dedup, PII surrogates, mixing, BPE.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps, with the columns of
``documents``; the last returns the encoding. ``run`` writes every stage under the shared checkpoint
folder and reads it back as the next stage's documents. The labels that fit the toxicity and mixing
models come from ``sf_dir``; every decision is made on the stage's own input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from basin.llm import mixing, pii, queries, simhash, toxicity
from basin.llm._common import drop_stored, stored, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine scores below 0.5."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"), threshold=0.5)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked at 3 or fewer differing bits."""
    return simhash.drop_near_duplicates(docs, shingle=3, distance=3)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their personal data and secrets replaced by surrogates."""
    return pii.replace_pii(docs, queries.PII_KEY).select([f"`{c}`" for c in docs.columns])


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn with the rates that bring clean and low-quality text to their target shares: clean
    documents keep a rate near one, low-quality ones are thinned, or repeated where they are below their share."""
    labelled = queries.labelled_quality(table(spark, sf_dir, "labels"))
    return mixing.mix(docs, labelled, queries.PIPELINE_TARGETS)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every kept document's ids and decoded text."""
    return queries.bpe_digests(docs)


STAGES = [("toxicity", toxicity_stage), ("simhash_near_dedup", near_dedup_stage), ("pii", pii_stage),
          ("mixing", mixing_stage), ("bpe", bpe_stage)]

#: The stages hash with XXH64 of a seed, fit models and follow a tokenizer: not expressible in SQL.
#: tests/llm compares the pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        drop_stored(before)
    return STAGES[-1][1](spark, docs, sf_dir)
