"""One query for each operator of this subpackage, with production parameters, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from veracet.llm import exact_dedup, language, link_trust, mixing, near_dup, packing, perplexity, substring_dedup, templates
from veracet.llm.store import new_path
from veracet.llm.token_archive import read_archive, write_archive

Query = Callable[[SparkSession, str], DataFrame]


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def op1_token_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "archive")
    write_archive(_documents(spark, sf_dir), path, "byte_bpe_50k.json", end_id=2)
    return read_archive(spark, path)


def op2_link_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_trust.judged(_pages(spark, sf_dir))


def op3_evidence_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify_documents(_documents(spark, sf_dir)).drop("text_hash")


def op3_evidence_fusion_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify_pages(_pages(spark, sf_dir), _documents(spark, sf_dir)).drop("text_hash").withColumnRenamed("doc_id", "page_id")


def op4_site_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.main_text(_pages(spark, sf_dir))


def op5_super_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.without_repeats(_documents(spark, sf_dir), with_text=False)


def op6_linear_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_documents(spark, sf_dir), "word_bpe_49k.json", end_id=1)


def op7_parity_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.linked(_documents(spark, sf_dir))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(_documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "source")


def op9_ngram_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity.judged(_documents(spark, sf_dir))


def op10_fingerprint_exchange(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_documents(spark, sf_dir))


_ALL = (
    op1_token_archive, op2_link_trust, op3_evidence_fusion, op3_evidence_fusion_pages, op4_site_templates, op5_super_kmers, op6_linear_grouping, op7_parity_sketches, op8_source_mixing,
    op9_ngram_perplexity, op10_fingerprint_exchange,
)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in _ALL}


def oracle_sql() -> dict[str, str]:
    return {}
