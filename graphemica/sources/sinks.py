"""Writers: tables of alphabets and mappings, post-correction pairs, transcriptions, rewritten XML, confusions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.mapper import Mapper
from ..functions.unicode import character_table
from .text import walk


def alphabet_table(spark, mapper: Mapper) -> DataFrame:
    """(idx, name, ord, hex, chr) of a map's targets."""
    letters = mapper.dst_alphabet
    order = spark.createDataFrame([(i, c) for i, c in enumerate(letters)], "idx int, chr string")
    return order.join(character_table(spark, letters), "chr").select("idx", "name", F.col("cp").alias("ord"), "hex", "chr").orderBy("idx")


def mapping_table(spark, mapper: Mapper) -> DataFrame:
    return mapper.table(spark).orderBy("src")


def same_mapping(a: DataFrame, b: DataFrame) -> bool:
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def write_tsv(df: DataFrame, path: str, overwrite: bool = False, append: bool = False) -> None:
    """Tab-separated lines; an existing folder is an error unless it may be overwritten or appended to."""
    mode = "overwrite" if overwrite else "append" if append else "errorifexists"
    df.write.mode(mode).option("sep", "\t").option("quote", "").option("emptyValue", "").csv(path)


def write_transcriptions(df: DataFrame, path: str, by_file: bool = False, overwrite: bool = False) -> None:
    """Texts (path, text) as text files, in one folder for each input file if ``by_file``."""
    writer = (df.select("path", "text") if by_file else df.select("text")).write.mode("overwrite" if overwrite else "errorifexists")
    (writer.partitionBy("path") if by_file else writer).text(path)


def write_confusions(df: DataFrame, path: str, overwrite: bool = False) -> None:
    df.select("src_chr", "tgt_chr", "n").write.mode("overwrite" if overwrite else "errorifexists").parquet(path)


def read_confusions(spark, path: str) -> DataFrame:
    return spark.read.parquet(path).select("src_chr", "tgt_chr", "n")


def same_confusions(a: DataFrame, b: DataFrame) -> bool:
    return same_mapping(a.select("src_chr", "tgt_chr", "n"), b.select("src_chr", "tgt_chr", "n"))


def rewrite_xml(xml: Column, replacements: Column, kind: str = "mixed") -> Column:
    """Canonical XML with the n-th text node (kind "mixed"), or the n-th non-blank CONTENT ("alto"), replaced by the n-th
    of ``replacements``; NULL or missing ones stay."""

    @F.pandas_udf("string")
    def each(docs: pd.Series, texts: pd.Series) -> pd.Series:
        import io
        import xml.etree.ElementTree as ET

        def one(x, new):
            if x is None:
                return None
            root = ET.fromstring(x)
            for _, (prefix, uri) in ET.iterparse(io.StringIO(x), events=["start-ns"]):
                ET.register_namespace(prefix, uri)  # the document's own prefixes are written again
            if kind == "alto":
                nodes = [e for e in root.iter() if e.tag.rpartition("}")[2] == "String" and (e.get("CONTENT") or "").strip()]
            else:
                nodes = [(e, tail) for _, e, tail in walk(root, set(), set())]
            for node, t in zip(nodes, [] if new is None else new, strict=False):
                if t is None:
                    continue
                if kind == "alto":
                    node.set("CONTENT", t)
                elif node[1]:
                    node[0].tail = t
                else:
                    node[0].text = t
            return ET.canonicalize(ET.tostring(root, encoding="unicode"))

        return pd.Series([one(x, n) for x, n in zip(docs, texts, strict=True)], dtype=object)

    return each(xml, replacements)
