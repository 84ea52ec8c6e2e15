"""A corpus pipeline of five operators: quality, near duplicates, repeated passages, benchmark leaks, packing.

Each stage takes all that its predecessor kept, written as a table. The first four return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from concord.llm.common import stored, table
from concord.llm.decontamination import decontaminated
from concord.llm.near_dedup import one_of_each
from concord.llm.packing import pack
from concord.llm.quality import accepted, fit_quality
from concord.llm.suffix_dedup import without_repeats

TOKENIZER = "word_bpe_49k.json"

# Passages of over 50 words: 51 words have some 300 bytes, and seldom under 240, in languages of four to five letters a word.
PASSAGE = 240


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the labelled rows of this stage's input."""
    return accepted(docs, fit_quality(docs, table(spark, sf_dir, "labels")))


def different_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five words, similarity 0.8."""
    return one_of_each(docs, size=5, percent=80)


def new_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of PASSAGE bytes that also stand elsewhere."""
    return without_repeats(docs, span=PASSAGE)


def clean_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of the benchmark."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def packed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences of 2048 tokens."""
    return pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality", good_documents),
    ("near_duplicates", different_documents),
    ("repeated_passages", new_passages),
    ("decontamination", clean_documents),
    ("packing", packed_documents),
]

# Learned scores, MinHash, byte-wise passages and tokens are beyond SQL; tests compare every stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
