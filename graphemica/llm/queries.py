"""The queries of this subpackage, each over its whole table with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embedding_dedup, html_extract, line_dedup, mixing, quality_classifier, quality_rules, sentencepiece, simhash, suffix_dedup, url_filter
from .common import table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(table(spark, sf_dir, "documents"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_classifier.classify(docs, quality_classifier.fit(docs, table(spark, sf_dir, "labels")))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_quality_rules(table(spark, sf_dir, "documents"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.repeated_passages(table(spark, sf_dir, "documents"))
    return found.select(F.col("d").alias("doc_id"), "start", "end", "later")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.match(table(spark, sf_dir, "pages").select("page_id", "url"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.class_table(table(spark, sf_dir, "documents"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece.encode(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_mixing, op2_quality_classifier, op3_quality_rules, op4_html_extraction, op5_suffix_dedup, op6_line_dedup, op7_url_filter, op8_simhash, op9_embedding_dedup, op10_sentencepiece)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op1_mixing": mixing.SQL, "op3_quality_rules": quality_rules.SQL, "op4_html_extraction": html_extract.SQL, "op5_suffix_dedup": suffix_dedup.SQL, "op6_line_dedup": line_dedup.SQL, "op7_url_filter": url_filter.SQL, "op9_embedding_dedup": embedding_dedup.SQL}
