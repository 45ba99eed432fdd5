"""Alphabets, counts, information measures, coverage by character sets, and the cost of merging characters.

Everything about a corpus follows from one table, how often each character occurs: one scan, one aggregate that combines
before it moves. A corpus that is mapped character by character is never rewritten to be measured.
"""

from __future__ import annotations

import ast

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.batches import counted
from ..functions.mapper import Mapper
from ..sources.charsets import UNKNOWN, charset_table


def characters(text: Column) -> Column:
    """The characters (code points) of a text, none for the empty one."""
    return F.filter(F.split(text, ""), lambda c: c != "")


def chars(corpus: DataFrame, *keep: str, text_col: str = "text") -> DataFrame:
    """A row for each character occurrence: the columns ``keep`` and chr."""
    return corpus.select(*keep, F.explode(F.split(text_col, "")).alias("chr")).filter("chr <> ''")


def unigram(corpus: DataFrame, *by: str, text_col: str = "text") -> DataFrame:
    """(by..., chr, n), counted within each batch before anything moves."""
    return counted(corpus, [text_col], ["chr"], *by)


def code_point(c: Column) -> Column:
    """Spark's ascii() gives the first character's code point."""
    return F.ascii(c)


def alphabet(corpus: DataFrame, text_col: str = "text") -> DataFrame:
    """(chr, cp): the distinct characters."""
    return unigram(corpus, text_col=text_col).select("chr", code_point(F.col("chr")).alias("cp"))


def alphabet_string(corpus: DataFrame, text_col: str = "text") -> DataFrame:
    """One row: the alphabet as a string by code point, and its size."""
    return alphabet(corpus, text_col).agg(F.array_join(F.array_sort(F.collect_list("chr")), "").alias("alphabet"), F.count("*").alias("n_chars"))


def histogram(corpus: DataFrame, text_col: str = "text") -> DataFrame:
    """The alphabet with counts, rarest first."""
    return unigram(corpus, text_col=text_col).select("chr", code_point(F.col("chr")).alias("cp"), "n").orderBy("n", "chr")


def information_loss(corpus: DataFrame, mapper: Mapper, text_col: str = "text") -> DataFrame:
    """One row (n_chars, n_changed, changed, bits_before, bits_after, bits_lost): how many characters a map changes, and the
    Shannon information of a character before and after it, all from the counts of the corpus as it is."""
    counts = unigram(corpus, text_col=text_col).withColumn("img", mapper.column(F.col("chr")))
    bits = lambda n, whole: F.log2(whole) - F.sum(F.col(n) * F.log2(n)) / whole
    images = counts.groupBy("img").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("img") != F.col("chr"), F.col("n"))).alias("moved"), F.sum(F.col("n") * F.log2("n")).alias("nlogn"))
    total = F.sum("n")
    out = images.agg(total.alias("n_chars"), F.coalesce(F.sum("moved"), F.lit(0)).alias("n_changed"), (F.log2(total) - F.sum("nlogn") / total).alias("bits_before"), bits("n", total).alias("bits_after"))
    return out.select("n_chars", "n_changed", F.try_divide("n_changed", "n_chars").alias("changed"), "bits_before", "bits_after", (F.col("bits_before") - F.col("bits_after")).alias("bits_lost"))


def unigram_over(corpus: DataFrame, letters: DataFrame, text_col: str = "text") -> DataFrame:
    """(label, chr, n) over a given alphabet (idx, chr), zero counts included; label 0 is every other character."""
    counts = unigram(corpus, text_col=text_col)
    inside = letters.select((F.col("idx") + 1).alias("label"), "chr").join(counts, "chr", "left").select("label", "chr", F.coalesce("n", F.lit(0)).alias("n"))
    outside = counts.join(letters, "chr", "left_anti").agg(F.lit(0).alias("label"), F.lit(UNKNOWN).alias("chr"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    return outside.unionByName(inside)


def information(corpus: DataFrame, *by: str, text_col: str = "text", unit: str = "codepoint") -> DataFrame:
    """(by..., n, alphabet_size, alphabet_bits, hartley, shannon) of each group: H0 = log2 N - sum(n log2 n) / N.

    With unit="utf16" a character outside the basic plane counts as its two surrogates, as in 16-bit arrays.
    """
    if unit == "utf16":
        units = corpus.select(*by, F.hex(F.encode(text_col, "UTF-16BE")).alias("x"))
        c = units.select(*by, F.explode(F.regexp_extract_all("x", F.lit("(....)"))).alias("chr")).groupBy(*by, "chr").agg(F.count("*").alias("n"))
    else:
        c = unigram(corpus, *by, text_col=text_col)
    sums = c.groupBy(*by).agg(F.sum("n").alias("n"), F.count("*").alias("alphabet_size"), F.sum(F.col("n") * F.log2("n")).alias("nlogn"))
    bits = F.log2("alphabet_size")
    return sums.select(*by, "n", "alphabet_size", bits.alias("alphabet_bits"), (bits * F.col("n")).alias("hartley"), (F.log2("n") * F.col("n") - F.col("nlogn")).alias("shannon"))


def coverage(corpus: DataFrame, sets: DataFrame, text_col: str = "text") -> DataFrame:
    """(name, n_chars, n_missing_chars, n_missing, n_unfound, cer, missing_pct): by character set the share of the corpus
    that it lacks, how many distinct characters it lacks, and how many of its own the corpus lacks."""
    counts = unigram(corpus, text_col=text_col)
    total = counts.agg(F.sum("n").alias("total"), F.count("*").alias("size"))
    hit = sets.join(counts, "chr", "left").groupBy("name").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("covered"), F.count("n").alias("found"), F.count("*").alias("letters"))
    missing = F.col("total") - F.col("covered")
    return hit.crossJoin(F.broadcast(total)).select(  # total is one row
        "name", F.col("total").alias("n_chars"), missing.alias("n_missing_chars"), (F.col("size") - F.col("found")).alias("n_missing"), (F.col("letters") - F.col("found")).alias("n_unfound"),
        F.try_divide(missing, F.col("total")).alias("cer"), F.try_divide(100.0 * (F.col("size") - F.col("found")), F.col("size")).alias("missing_pct"))


def missing_characters(corpus: DataFrame, sets: DataFrame, text_col: str = "text") -> DataFrame:
    """(name, missing): the corpus's characters that each set lacks, as one string."""
    pairs = sets.select("name").distinct().crossJoin(alphabet(corpus, text_col).select("chr"))
    gone = pairs.join(sets.select("name", "chr"), ["name", "chr"], "left_anti")
    return gone.groupBy("name").agg(F.array_join(F.array_sort(F.collect_list("chr")), "").alias("missing"))


def unfound_characters(corpus: DataFrame, sets: DataFrame, text_col: str = "text") -> DataFrame:
    """(name, unfound): each set's characters that the corpus lacks, as one string."""
    gone = sets.join(alphabet(corpus, text_col).select("chr"), "chr", "left_anti")
    return gone.groupBy("name").agg(F.array_join(F.array_sort(F.collect_list("chr")), "").alias("unfound"))


def charset_distance(sets: DataFrame) -> DataFrame:
    """(a, b, common, distance): M - (common // 2) / (max(size) // 2), M the greatest such quotient of all pairs."""
    sizes = sets.groupBy("name").agg(F.count("*").alias("size"))
    a, b = sets.select(F.col("name").alias("a"), "chr"), sets.select(F.col("name").alias("b"), "chr")
    common = a.join(b, "chr").groupBy("a", "b").agg(F.count("*").alias("common"))
    every = sizes.select(F.col("name").alias("a"), F.col("size").alias("sa")).crossJoin(sizes.select(F.col("name").alias("b"), F.col("size").alias("sb")))
    ratio = every.join(common, ["a", "b"], "left").select("a", "b", F.coalesce("common", F.lit(0)).alias("common"), F.try_divide(F.expr("coalesce(common, 0) div 2"), F.expr("greatest(sa, sb) div 2")).alias("ratio"))
    most = ratio.agg(F.max("ratio").alias("m"))
    return ratio.crossJoin(F.broadcast(most)).select("a", "b", "common", (F.col("m") - F.col("ratio")).alias("distance"))  # most is one row


def unique_characters(sets: DataFrame) -> DataFrame:
    """(chr, name): characters that stand in one set only."""
    return sets.groupBy("chr").agg(F.count("*").alias("k"), F.min("name").alias("name")).filter("k = 1").select("chr", "name")


def parse_merges(text: str) -> dict[str, str]:
    """Merges written as Python pairs, ``[("u", "v"), ("U", "V")]``; nothing is evaluated."""
    return {str(a): str(b) for a, b in ast.literal_eval(text)}


def merge_cer(corpus: DataFrame, merges: dict[str, str], *by: str, text_col: str = "text") -> DataFrame:
    """(by..., n_chars, n_changed, cer): what share of the characters ``merges`` changes, from the counts alone."""
    changed = [a for a, b in merges.items() if a != b]
    counts = unigram(corpus, *by, text_col=text_col)
    n = F.coalesce(F.sum(F.when(F.col("chr").isin(changed), F.col("n"))), F.lit(0))
    return counts.groupBy(*by).agg(F.sum("n").alias("n_chars"), n.alias("n_changed"), F.try_divide(n, F.sum("n")).alias("cer"))


def mapper_distances(corpus: DataFrame, mappers: dict[str, Mapper], *by: str, text_col: str = "text") -> DataFrame:
    """(by..., a, b, n_chars, n_differ, rate) for each pair of maps: at what share of the characters they differ. The corpus
    is counted once; the maps meet over its alphabet."""
    counts = unigram(corpus, *by, text_col=text_col)
    images = F.array(*[F.struct(F.lit(name).alias("name"), m.column(F.col("chr")).alias("to")) for name, m in sorted(mappers.items())])
    each = counts.withColumn("images", images)
    a = each.select(*by, "chr", "n", "images", F.explode("images").alias("x"))
    both = a.select(*by, "n", F.col("x.name").alias("a"), F.col("x.to").alias("to"), F.explode("images").alias("y")).filter("a < y.name")
    differ = F.sum(F.when(F.col("to") != F.col("y.to"), F.col("n")).otherwise(0))
    return both.groupBy(*by, "a", F.col("y.name").alias("b")).agg(F.sum("n").alias("n_chars"), differ.alias("n_differ"), F.try_divide(differ, F.sum("n")).alias("rate"))


def duplicate_code_points(table: DataFrame, col: str) -> DataFrame:
    """(col, n): values that occur more than once."""
    return table.groupBy(col).agg(F.count("*").alias("n")).filter("n > 1")


def sets_named(spark: SparkSession, names: str) -> DataFrame:
    """The table of sets named in a comma-separated list, or of all for ``all``."""
    return charset_table(spark, None if names == "all" else [n.strip() for n in names.split(",")])


def cumulative(counts: DataFrame, group: str, value: str, n: str = "n") -> DataFrame:
    """``counts`` with p, each value's share within its group, and cdf, the shares up to it."""
    within = Window.partitionBy(group)
    p = F.col(n) / F.sum(n).over(within)
    return counts.withColumn("p", p).withColumn("cdf", F.sum("p").over(within.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)))
