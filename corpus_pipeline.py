"""A training corpus from ``documents``: quality, toxicity, near-duplicates, secrets, packing.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. All but
the last return the columns of ``documents``; ``run`` writes each stage's rows and reads them again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from telemetrica.llm import near_duplicates, packing, quality_rules, secrets, toxicity
from telemetrica.llm.common import cut, table

VOCABULARY = "byte_bpe_50k.json"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the limits and the outlier rule keep."""
    return quality_rules.keep(docs)


def clean_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under the toxicity threshold; learned from this stage's labelled rows."""
    return toxicity.keep(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: five words, a similarity of 0.8 or more."""
    return near_duplicates.keep(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets redacted."""
    return secrets.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their place in sequences of 1024 tokens."""
    return packing.pack(cut(packing.pieces(docs, public_tokenizers.path(VOCABULARY))))


STAGES = [
    ("quality rules", quality),
    ("toxicity", clean_language),
    ("minhash near-dedup", one_of_each),
    ("secret scans", without_secrets),
    ("best-fit packing", packed),
]

#: Network, forest and outlier estimates have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
