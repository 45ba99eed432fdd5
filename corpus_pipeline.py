"""A corpus pipeline of five stages over ``documents``; each stage's result is written and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphemica.llm import line_dedup, mixing, quality_rules, sentencepiece, simhash
from graphemica.llm.common import materialize, table
from graphemica.plans.session import ship


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that too many documents of their source share; depleted documents go.

    NULL, empty and blank texts stay. NULL sources are one source; NULL ids one document. Repeated rows count once and all
    stay. Very long texts are looked through whole. An empty table gives an empty one; columns are those of ``docs``.
    """
    return quality_rules.apply_quality_rules(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that are much like an earlier one; those that lose all their words go.

    NULL and empty texts, and lines without a word, stay. Equal lines: the first by id, text hash and place stays; NULL ids
    come first. Repeated rows are treated alike. Very long texts: every line. An empty table gives an empty one; columns are
    those of ``docs``.
    """
    ship(spark)
    return line_dedup.dedup_lines(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, the first by id and text hash.

    NULL and empty texts, and texts without a word, are no copies and stay. Of repeated rows (same id and text) one stays.
    NULL ids come first. Very long texts: all their words. An empty table gives an empty one; columns are those of ``docs``.
    """
    ship(spark)
    return simhash.dedup_documents(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's budget takes them: whole epochs, then by weighted keys.

    NULL and empty texts have no tokens. NULL and empty sources are one source. Rows with the same key, id and tokens are
    taken together or not at all. Very long texts count whole. An empty table gives an empty one; columns are those of ``docs``.
    """
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two sampled segmentations of each document, as ids of pieces.

    NULL texts have none, the empty text one without ids. Repeated rows get the same samples; a NULL id stays NULL. Very long
    texts are one lattice. An empty table gives an empty one; other columns are not read.
    """
    ship(spark)
    return sentencepiece.encode(docs)


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("near_dedup", near_copies), ("mixing", mixture), ("sentencepiece", tokens)]

#: SimHash groups and sampled segmentations have no SQL; tests hold the run against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written to the shared folder and read again, so that a lost executor
    costs a part of one stage only."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
