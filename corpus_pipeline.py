"""Corpus pipeline: toxicity, language, near-duplicates, source mix, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``.  ``run`` applies them to ``documents``, each result written to the shared folder and read
again, so that a lost executor costs a stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm import langid, mixing, packing, simhash, toxicity
from ledgerloom.llm.common import Scratch, table


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that score 0.7 or more."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"), threshold=0.7)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without letters, or whose language can't be told."""
    return langid.keep_identified(docs, threshold=0.5)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group at a similarity of 0.8 or more in five-word shingles."""
    return simhash.simhash_keep_one(docs, shingle_words=5, threshold=0.8)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One epoch's documents for a budget of 0.9 of all words."""
    return mixing.mix_documents(docs, mixing.LEVELS, mixing.WEIGHTS, share=0.9, seed=17, level_cols={"domain": mixing.domain_of_source()})


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boundary records of sequences of 2048 tokens."""
    return packing.pack(docs)


STAGES = [("toxicity", toxic), ("language", language), ("near_duplicates", near_duplicates), ("mix", mix), ("packing", packed)]

#: A learned score decides which rows go on, which SQL can't express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark), table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.save(docs)
            scratch.drop(before)
    return docs
