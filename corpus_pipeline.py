"""The corpus pipeline: documents to packed training bins, in five stages over whole tables.

Every stage but the last returns the columns of documents; each docstring states what goes.  For all of them:
null, empty and word-less texts stay as they are (packing gives them bins of 0 tokens), an empty table gives an
empty table, extra columns are carried along whatever their names, and rows that repeat in full are copies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm import decontaminate, minhash, packing, suffixes, toxicity
from loomgraph.llm.common import materialise


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; without both classes among the labels none does."""
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the row with the least id stays, null ids last, then by hash of the text."""
    return minhash.dedup(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats of 50 words or more are cut at all places but the first; a document of which no word is left goes."""
    return suffixes.remove_repeats(docs)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of test items are cut; a document of which no word is left goes."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, in pieces of at most 4,096 tokens, has a place in a bin."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("suffix_array", cut_repeats),
    ("decontamination", cut_benchmark),
    ("packing", pack),
]

# The classifier, MinHash, the suffix array and packing have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; what the others return is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
