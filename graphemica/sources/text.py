"""Readers: plain text, line pairs, tables, PAGE and ALTO transcriptions, aligned OCR files."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.unicode import normalize

_TEXT_NODE = r">\s*([^<>]+?)\s*<"
FORBIDDEN = "=¥õ✓"


def strip_xml(xml: Column, joined: bool = True) -> Column:
    """The text between tags by regular expression, joined by blanks or as an array; entities stay as they are."""
    found = F.regexp_extract_all(xml, F.lit(_TEXT_NODE), 1)
    return F.array_join(found, " ") if joined else found


def read_corpus(spark: SparkSession, paths: str | Sequence[str], strip: bool = True, all_xml: bool = False) -> DataFrame:
    """corpus(path, text): a row for each file of globs and paths, each file once; XML files without their markup."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    raw = spark.read.text(paths, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text")).dropDuplicates(["path"])
    is_xml = F.lit(True) if all_xml else F.lower("path").endswith(".xml")
    return raw.withColumn("text", F.when(is_xml, strip_xml(F.col("text"))).otherwise(F.col("text"))) if strip else raw


def without_forbidden(text: Column) -> Column:
    return F.translate(text, FORBIDDEN, "")


def text_lines(spark: SparkSession, paths: str | Sequence[str], assume_txt: bool = False, first: int = 0, last: int = 0, drop_empty: bool = True) -> DataFrame:
    """lines(path, line_no, text) by the files' endings: of .xml and .pagexml the lines of ALTO or PAGE, of .txt (of all with
    ``assume_txt``) the lines, normalised, words chopped; any other file is an error when it is read."""
    files = read_corpus(spark, paths, strip=False)
    name = F.lower("path")
    xml = F.lit(False) if assume_txt else name.rlike(r"\.(page)?xml$")
    plain = F.lit(True) if assume_txt else name.endswith(".txt")
    other = F.raise_error(F.concat(F.lit("neither text nor XML: "), "path")).cast("string")
    chopped = chop_words(F.col("l"), first, last) if first or last else F.col("l")
    rows = files.select("path", plain.alias("plain"), F.when(xml, htr_text(F.when(xml, F.col("text")), first, last)).when(plain, F.col("text")).otherwise(other).alias("text"))
    rows = rows.select("path", "plain", F.posexplode(F.split("text", "\n")).alias("line_no", "l"))
    out = rows.select("path", "line_no", normalize(F.when(F.col("plain"), chopped).otherwise(F.col("l"))).alias("text"))
    return out.filter(F.length("text") > 0) if drop_empty else out


def xml_source(source) -> str:
    """The XML text of a path, an open file, bytes, or the text itself."""
    from pathlib import Path

    if hasattr(source, "read"):
        source = source.read()
    elif isinstance(source, Path) or isinstance(source, str) and "<" not in source:
        source = Path(source).read_bytes()
    return source.decode("utf-8-sig") if isinstance(source, bytes) else source


def lines(corpus: DataFrame, *keep: str, text_col: str = "text", form: str | None = "nfc", drop_empty: bool = True) -> DataFrame:
    """lines(keep..., line_no, text), normalised, without empty lines."""
    out = corpus.select(*keep, F.posexplode(F.split(text_col, "\n")).alias("line_no", "text"))
    out = out.withColumn("text", normalize(F.col("text"), form))
    return out.filter(F.length("text") > 0) if drop_empty else out


def chop_words(text: Column, first: int = 0, last: int = 0) -> Column:
    """The text without its first and last words between single blanks; "" if none is left."""
    words = F.split(text, " ")
    left = F.size(words) - first - last
    return F.when(left > 0, F.array_join(F.slice(words, first + 1, F.greatest(left, F.lit(0))), " ")).otherwise(F.when(text.isNotNull(), ""))


_LOCAL = "*[local-name()='{}']"


def alto_lines(xml: Column, first: int = 0, last: int = 0) -> Column:
    """The text lines of an ALTO document as an array: each line's strings joined by blanks, words chopped."""

    @F.pandas_udf("array<string>")
    def each(docs: pd.Series) -> pd.Series:
        import xml.etree.ElementTree as ET

        def one(x):
            if x is None:
                return None
            root = ET.fromstring(x)
            tag = lambda e: e.tag.rpartition("}")[2]
            return [" ".join(s.get("CONTENT") for s in line.iter() if tag(s) == "String" and s.get("CONTENT") is not None) for line in root.iter() if tag(line) == "TextLine"]

        return docs.map(one)

    return F.transform(each(xml), lambda t: chop_words(t, first, last)) if first or last else each(xml)


def alto_strings(xml: Column) -> Column:
    """The non-blank CONTENT of every String, in document order; native."""
    found = F.xpath(xml, F.lit(f"//{_LOCAL.format('String')}/@CONTENT"))
    return F.filter(found, lambda s: F.trim(s) != "")


def page_lines(xml: Column, first: int = 0, last: int = 0, segment: str = "\t", ignore_deleted: bool = False) -> Column:
    """The text lines of a PAGE document as an array: the texts of a line's own TextEquiv elements, stripped, chopped and
    joined by ``segment``. With ``ignore_deleted`` what stands between <del> tags goes, and other inner tags vanish."""

    @F.pandas_udf("array<array<string>>")
    def each(docs: pd.Series) -> pd.Series:
        import xml.etree.ElementTree as ET

        def one(x):
            if x is None:
                return None
            tag = lambda e: e.tag.rpartition("}")[2]
            out = []
            for line in ET.fromstring(x).iter():
                if tag(line) == "TextLine":
                    texts = [u.text for t in line if tag(t) == "TextEquiv" for u in t if tag(u) == "Unicode" and u.text]
                    out.append([t.strip() for t in texts])
            return out

        return docs.map(one)

    def clean(t: Column) -> Column:
        if ignore_deleted:
            t = F.trim(F.regexp_replace(F.regexp_replace(t, r"(?s)<del>.*?</del>", ""), r"</?[A-Za-z][^<>]*>", ""))
        return chop_words(t, first, last) if first or last else t

    return F.transform(each(xml), lambda parts: F.array_join(F.filter(F.transform(parts, clean), lambda t: t != "") if ignore_deleted else F.transform(parts, clean), segment))


def page_transcription(xml: Column, line_separator: str = "\n", segment: str = "\t", ignore_deleted: bool = True) -> Column:
    """The whole transcription; lines without text are left out."""
    return F.array_join(F.filter(page_lines(xml, segment=segment, ignore_deleted=ignore_deleted), lambda t: t != ""), line_separator)


def htr_text(xml: Column, first: int = 0, last: int = 0) -> Column:
    """The lines of an ALTO or PAGE document, whichever it is, joined by line feeds; any other document is an error."""
    alto, page = xml.rlike("(?i)<([a-z0-9]+:)?alto"), xml.rlike("<([A-Za-z0-9]+:)?PcGts")
    a = F.array_join(alto_lines(F.when(alto, xml), first, last), "\n")
    p = F.array_join(page_lines(F.when(~alto & page, xml), first, last), "\n")
    return F.when(alto, a).when(page, p).when(xml.isNotNull(), F.raise_error(F.lit("neither ALTO nor PAGE")).cast("string"))


def text_nodes(xml: Column, mandatory: Sequence[str] = (), ignored: Sequence[str] = ()) -> Column:
    """The non-blank texts of mixed content, in the order in which a walk through the tree meets them: a node's own text,
    then for each child the text after it and, unless its tag is ``ignored``, what the child holds."""
    wanted, skipped = set(mandatory), set(ignored)

    @F.pandas_udf("array<string>")
    def each(docs: pd.Series) -> pd.Series:
        import xml.etree.ElementTree as ET

        return docs.map(lambda x: None if x is None else [t for t, _, _ in walk(ET.fromstring(x), wanted, skipped)])

    return each(xml)


#: (mandatory, ignored) of ``text_nodes`` by format.
_MIXED = {
    "page": (("PcGts", "Page"), ("{http://schema.primaresearch.org/PAGE/gts/pagecontent/2019-07-15}Metadata",)),
    "tei": ((), ("{http://www.tei-c.org/ns/1.0}teiHeader", "{http://www.tei-c.org/ns/1.0}sourceDoc")),
}


def mixed_lines(xml: Column, kind: str) -> Column:
    """The non-blank texts of a document of kind "page", "tei" (without header and facsimile) or "alto"."""
    if kind == "alto":
        return alto_strings(xml)
    if kind not in _MIXED:
        raise ValueError(f"no such kind of document: {kind}")
    return text_nodes(xml, *_MIXED[kind])


def walk(node, mandatory: set[str], ignored: set[str], missing: bool = False):
    """(text, element, whether it is the element's tail) of the non-blank texts under ``node``."""
    missing = missing and bool(mandatory) and node.tag not in mandatory
    if not missing and node.text and node.text.strip():
        yield node.text, node, False
    for child in node:
        if not missing and child.tail and child.tail.strip():
            yield child.tail, child, True
        if child.tag not in ignored:
            yield from walk(child, mandatory, ignored, missing)


def read_pairs(spark: SparkSession, path: str | Sequence[str], other: str | None = None) -> DataFrame:
    """pairs(pred, gt): the first two fields of tab-separated lines (lines with fewer are left out), or the lines of two
    files side by side. The path "-" is this process's input."""
    if path == "-":
        import sys

        rows = spark.createDataFrame([(x.rstrip("\r\n"),) for x in sys.stdin], "value string")
    else:
        rows = spark.read.text(path) if other is None else None
    if rows is not None:
        fields = F.split("value", "\t")
        return rows.filter(F.size(fields) >= 2).select(fields[0].alias("pred"), fields[1].alias("gt"))
    left, right = (lines(read_corpus(spark, p, strip=False), form=None, drop_empty=False) for p in (path, other))
    return left.withColumnRenamed("text", "pred").join(right.withColumnRenamed("text", "gt"), "line_no").select("pred", "gt")


def zip_lines(left: DataFrame, right: DataFrame, min_length: int = 10, form: str | None = "nfc") -> DataFrame:
    """pairs(file_no, line_no, src, tgt): the files (path, text) of both sides in the order of their paths, side by side,
    and their lines as well; a pair of files of unequal line counts is left out, as is a pair with a line that is short."""

    def numbered(df: DataFrame, name: str) -> DataFrame:
        # sorted in ranges and numbered from their sizes: no task sees all paths
        files = df.select("path").orderBy("path").rdd.map(lambda r: r[0]).zipWithIndex().toDF("path string, at long")
        kept = df.join(files, "path").withColumn("ls", F.filter(F.split("text", "\n"), lambda x: x != ""))
        return kept.select((F.col("at") + 1).alias("file_no"), F.col("ls").alias(name))

    both = numbered(left, "a").join(numbered(right, "b"), "file_no").filter(F.size("a") == F.size("b"))
    rows = both.select("file_no", F.posexplode(F.arrays_zip("a", "b")).alias("line_no", "p")).select("file_no", "line_no", normalize(F.col("p.a"), form).alias("src"), normalize(F.col("p.b"), form).alias("tgt"))
    return rows.filter((F.length("src") >= min_length) & (F.length("tgt") >= min_length))


def key_pairs(inputs: DataFrame, outputs: DataFrame, integrity: str = "cleanup") -> DataFrame:
    """(key, src, tgt): files (path, text) of both sides paired by their base name up to the first dot, as arrays of
    stripped non-blank lines. A key is sound if it has one file of each side, as many lines in both, and some.

    integrity: "cleanup" leaves unsound keys out, "raise" makes one an error, "ignore" keeps whatever has both sides.
    """

    def keyed(df: DataFrame, name: str) -> DataFrame:
        key = F.regexp_extract("path", r"([^/.]*)(\.[^/]*)?$", 1)
        ls = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != "")
        return df.groupBy(key.alias("key")).agg(F.collect_list(ls).alias(name))

    both = keyed(inputs, "i").join(keyed(outputs, "o"), "key", "full")
    sound = F.coalesce((F.size("i") == 1) & (F.size("o") == 1) & (F.size(F.get("i", F.lit(0))) == F.size(F.get("o", F.lit(0)))) & (F.size(F.get("i", F.lit(0))) > 0), F.lit(False))
    if integrity == "cleanup":
        both = both.filter(sound)
    elif integrity == "raise":
        both = both.withColumn("key", F.when(sound, F.col("key")).otherwise(F.raise_error(F.concat(F.lit("unsound pair: "), "key"))))
    elif integrity != "ignore":
        raise ValueError(integrity)
    return both.select("key", F.get("i", F.lit(0)).alias("src"), F.get("o", F.lit(0)).alias("tgt")).filter("src is not null and tgt is not null")


def read_icdar(files: DataFrame) -> DataFrame:
    """(path, ocr, gt): aligned texts of files of three lines, OCR input, OCR and truth with "@" for gaps, forbidden
    characters removed; files of other shapes are left out. Gaps of the truth at either end are cut from both."""
    clean = without_forbidden(F.col("text"))
    ls = F.split(F.regexp_replace(clean, r"\n+$", ""), "\n")
    three = files.filter(F.size(ls) == 3).select("path", ls.alias("ls"))
    part = lambda i, mark: F.get(F.split(F.get("ls", F.lit(i)), re.escape(mark)), F.lit(1))
    texts = three.select("path", part(0, "[OCR_toInput] ").alias("raw"), part(1, "[OCR_aligned] ").alias("ocr"), part(2, "[ GS_aligned] ").alias("gt"))
    good = texts.filter((F.translate("ocr", "@", "") == F.col("raw")) & (F.length("ocr") == F.length("gt")))
    lead = F.length("gt") - F.length(F.regexp_replace("gt", "^@+", ""))
    kept = F.length(F.regexp_replace(F.regexp_replace("gt", "^@+", ""), "@+$", ""))
    return good.select("path", F.substring("ocr", lead + 1, kept).alias("ocr"), F.substring("gt", lead + 1, kept).alias("gt"))


def split_at_gaps(aligned: DataFrame, max_insertions: int = 4, min_length: int = 10) -> DataFrame:
    """(path, piece, ocr, gt): aligned texts cut where the truth has ``max_insertions`` gaps or more in a row; short
    pieces go."""

    @F.pandas_udf("array<struct<ocr:string,gt:string>>")
    def each(ocr: pd.Series, gt: pd.Series) -> pd.Series:
        def one(o, g):
            at, out = 0, []
            for m in [*re.finditer("@{%d,}" % max_insertions, g), None]:
                a, z = m.span() if m else (len(g), len(g))
                out.append({"ocr": o[at:a], "gt": g[at:a]})
                at = z
            return [p for p in out if len(p["ocr"].replace("@", "")) >= min_length and len(p["gt"].replace("@", "")) >= min_length]

        return pd.Series([one(o, g) for o, g in zip(ocr, gt, strict=True)], dtype=object)

    return aligned.select("path", F.posexplode(each("ocr", "gt")).alias("piece", "p")).select("path", "piece", "p.ocr", "p.gt")


def aligned_parts(ocr: Column, gt: Column) -> Column:
    """For each OCR character its piece of the truth; a gap of the OCR belongs to the character before it, gaps before the
    first one are dropped. Pieces follow from where OCR characters stand, so a line is gone through once."""

    @F.arrow_udf("array<struct<src:string,tgt:string>>")
    def each(os: pa.Array, gs: pa.Array) -> pa.Array:
        out = []
        for o, g in zip(os.to_pylist(), gs.to_pylist(), strict=True):
            if o is None or g is None:
                out.append(None)
                continue
            at = [i for i, c in enumerate(o) if c != "@"]
            ends = [*at[1:], max(len(o), len(g))]
            out.append([{"src": o[i], "tgt": g[i:z].replace("@", "")} for i, z in zip(at, ends, strict=True)])
        return pa.array(out, pa.list_(pa.struct([("src", pa.string()), ("tgt", pa.string())])))

    return each(ocr, gt)
