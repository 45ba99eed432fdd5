"""The functions of this package for SQL text."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..sources.text import walk
from .align import DEL, INS, backtrace
from .mapper import Mapper
from .similarity import char_similarity
from .unicode import to_ascii


@F.udtf(returnType="step int, i int, j int, op string, a string, b string")
class Align:
    """align(pred, truth): a row for each step from the one to the other; none where either is NULL."""

    def eval(self, pred: str, truth: str) -> Iterator[tuple]:
        if pred is None or truth is None:
            return
        for step, (i, j, op) in enumerate(backtrace(pred, truth, "diagonal")):
            yield step, i, j, op, pred[i] if op != INS else "", truth[j] if op != DEL else ""


@F.udtf(returnType="idx int, text string")
class TextNodes:
    """text_nodes(xml): the non-blank texts of a document."""

    def eval(self, xml: str) -> Iterator[tuple]:
        import xml.etree.ElementTree as ET

        if xml is not None:
            for idx, (text, _, _) in enumerate(walk(ET.fromstring(xml), set(), set())):
                yield idx, text


def _each(f):
    return lambda *columns: pd.Series([None if any(x is None for x in row) else f(*row) for row in zip(*columns, strict=True)], dtype=object)


def _mapped(mapper: Mapper):
    @F.pandas_udf("string")
    def mapped(t: pd.Series) -> pd.Series:
        return _each(mapper)(t)

    return mapped


def register(spark: SparkSession, mappers: dict[str, Mapper] | None = None) -> None:
    """Make available to SQL: nfc(t), nfd(t), plain_letters(t), char_similarity(a, b), cer(a, b), the table functions
    align(pred, truth) and text_nodes(xml), and under its name each map of ``mappers``."""

    @F.pandas_udf("string")
    def nfc(t: pd.Series) -> pd.Series:
        return _each(lambda x: unicodedata.normalize("NFC", x))(t)

    @F.pandas_udf("string")
    def nfd(t: pd.Series) -> pd.Series:
        return _each(lambda x: unicodedata.normalize("NFD", x))(t)

    @F.pandas_udf("string")
    def plain_letters(t: pd.Series) -> pd.Series:
        return _each(lambda x: "".join(map(to_ascii, x)))(t)

    @F.pandas_udf("double")
    def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
        return _each(char_similarity)(a, b)

    for name, f in (("nfc", nfc), ("nfd", nfd), ("plain_letters", plain_letters), ("char_similarity", similarity)):
        spark.udf.register(name, f)
    # an SQL body, so the optimiser sees through it
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION cer(a STRING, b STRING) RETURNS DOUBLE RETURN CASE WHEN greatest(length(a), length(b)) = 0 THEN 1.0 ELSE levenshtein(a, b) / greatest(length(a), length(b)) END")
    for name, mapper in (mappers or {}).items():
        spark.udf.register(name, _mapped(mapper))
    spark.udtf.register("align", Align)
    spark.udtf.register("text_nodes", TextNodes)
