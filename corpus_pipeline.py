"""A corpus, ready for training: language, copies, near copies, mixture, sequences.

Each stage takes (spark, docs, sf_dir) and returns a table; ``run`` writes each to the shared folder and reads it
again.  All but the last keep the columns of documents.

Defined results: a null or empty text has no language, and goes in the first stage; null languages and sources are one
each; a null doc_id is a document like any other, smaller than all; of repeated rows one stays; ties go to the smallest doc_id; a
very long text is taken whole, and cut to pieces only by the last stage; an empty table gives empty tables at every stage; columns
beyond those of documents are carried along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veracet.llm import exact_dedup, language, mixing, near_dup, packing
from veracet.llm.store import written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the evidence tells; the others go."""
    return language.kept_documents(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the smallest doc_id."""
    return exact_dedup.deduplicated(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links connect, the one with the smallest doc_id."""
    return near_dup.one_of_each(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes of each document, a row for each time."""
    return mixing.mixed(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents, with their places in sequences."""
    return packing.packed(docs)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_copies),
    ("near_dup", near_copies),
    ("mixing", mixture),
    ("packing", sequences),
]

#: No SQL: tokenization and packing cannot be expressed in it; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
