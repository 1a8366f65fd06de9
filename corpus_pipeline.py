"""A training corpus from raw documents: stages that each apply one operator to what its predecessor kept.

Defined cases: rows without text, or whose text has no letter, go in the first stage; rows
without an id go through all stages, each by its text; of rows with one id all or none stay,
and equal ones are mixed equally often; very long texts are whole in every stage; empty
tables give empty results, and an empty benchmark takes nothing away; all columns of the
documents are kept, whatever their names, and the shards' columns get underscores before
names that are taken. Each stage but the last is written and read again, so a lost executor
costs no more than the stage it was lost in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from linkledger.llm import _spark as S
from linkledger.llm import decontaminate, language, mixing, near_duplicates, sharding


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a known language, learned from all labelled ones but the held-out fifth."""
    return language.known_documents(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest id; texts without words are nobody's copies."""
    return near_duplicates.one_of_each(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no twentieth of benchmark text."""
    return decontaminate.clean_documents(docs, S.table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.mixed_documents(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed documents with their shards."""
    return sharding.shards(docs)


STAGES = [
    ("language", languages),
    ("near_duplicates", near_copies),
    ("decontamination", benchmark),
    ("mixing", mix),
    ("sharding", shards),
]
#: Several stages are not SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage in turn; each but the last is written and read again."""
    docs = S.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = S.written(docs)
    return docs
