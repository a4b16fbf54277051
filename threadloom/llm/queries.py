"""The queries of this folder, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, hmm, packing, simhash, spm, suffix_dedup, token_counts, topk, toxicity, url_filter
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), unknown=True)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op3_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spm.encode(table(spark, sf_dir, "documents"), check=True)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicates(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = suffix_dedup.repeated_spans(table(spark, sf_dir, "documents"))
    return spans.withColumn("first_ids", F.array_join(F.col("first_ids").cast("array<string>"), ","))


def op9_hmm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score_corpus(table(spark, sf_dir, "documents"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Query] = {
    f.__name__: f for f in (op1_packing, op2_token_counts, op3_topk_search, op4_sentencepiece, op5_exact_dedup, op6_toxicity, op7_simhash, op8_suffix_dedup, op9_hmm_scoring, op10_url_filter)
}

ORACLE_SQL: dict[str, str] = {
    "op3_topk_search": topk.ORACLE_SQL,
    "op5_exact_dedup": exact_dedup.ORACLE_SQL,
    "op8_suffix_dedup": suffix_dedup.ORACLE_SQL,
    "op10_url_filter": url_filter.oracle(),
}
