"""Training sets of pairs: filters, splits, crops, self-supervision, distortion, alignment."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.align import align_substrings, edit_distance, edit_ops, matches, substituted, within
from ..functions.batches import counted, in_pieces, points, texts_of
from ..functions.mapper import Mapper, char_class
from .stats import cumulative


def within_lengths(pairs: DataFrame, low: int = 1, high: int = 1 << 30, src: str = "src", tgt: str = "tgt") -> DataFrame:
    return pairs.filter(F.length(src).between(low, high) & F.length(tgt).between(low, high))


def within_alphabet(pairs: DataFrame, letters: str, *cols: str) -> DataFrame:
    """Pairs whose texts hold no other characters."""
    for c in cols or ("src", "tgt"):
        pairs = pairs.filter(~F.col(c).rlike(f"[^{char_class(letters)}]"))
    return pairs


def within_distance(pairs: DataFrame, most: float = 0.2, src: str = "src", tgt: str = "tgt") -> DataFrame:
    """Pairs whose edit distance is at most ``most`` of the target's length."""
    return pairs.filter(within(F.col(src), F.col(tgt), F.floor(most * F.length(tgt))) >= 0)


def hash_unit(*keys: Column | str, seed: int = 0) -> Column:
    """From 0 to 1 (excluded), by the keys alone."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 30)) / float(1 << 30)


def split(df: DataFrame, ratio: float, *keys: str, seed: int = 0, uniform: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Two parts by the hash of ``keys``, or by a number from 0 to 1 that is given: no shuffle, and the same rows whatever the
    partitions are."""
    u = hash_unit(*keys, seed=seed) if uniform is None else uniform
    return df.filter(u < ratio), df.filter(u >= ratio)


def shuffled(df: DataFrame, *keys: str, seed: int = 0) -> DataFrame:
    return df.orderBy(F.xxhash64(F.lit(seed), *keys), *keys)


def first_rows(df: DataFrame, n: int, *keys: str) -> DataFrame:
    return df.orderBy(*keys).limit(n)


def crop(text: Column, size: int, *keys: Column | str, seed: int = 0, uniform: Column | None = None) -> Column:
    """A stretch of ``size`` characters at a place that follows from the keys, or from a number from 0 to 1; shorter texts
    whole."""
    room = F.greatest(F.length(text) - size, F.lit(0))
    u = hash_unit(*keys, seed=seed) if uniform is None else uniform
    return F.substring(text, F.floor(u * (room + 1)).cast("int") + 1, F.lit(size))


def self_supervised(corpus: DataFrame, mapper: Mapper, mapped_to_original: bool = True, text_col: str = "text") -> DataFrame:
    """pairs(..., src, tgt) of each text and what the map makes of it."""
    mapped, original = mapper.column(F.col(text_col)), F.col(text_col)
    a, b = (mapped, original) if mapped_to_original else (original, mapped)
    return corpus.select(*[c for c in corpus.columns if c != text_col], a.alias("src"), b.alias("tgt"))


def alphabets(pairs: DataFrame) -> DataFrame:
    """One row (src, tgt): the characters of either side, by code point."""
    side = lambda c: counted(pairs, [c], ["chr"]).agg(F.array_join(F.array_sort(F.collect_list("chr")), "").alias(c))
    return side("src").crossJoin(side("tgt"))  # a row each


def items(pairs: DataFrame, src: Mapper, tgt: Mapper, size: int | None = None, *keys: str, seed: int = 0) -> DataFrame:
    """``pairs`` with src_labels and tgt_labels, of stretches of ``size`` characters where it is given: of pairs of equal length
    the same stretch of both sides, of others a stretch of the source only."""
    out = pairs
    if size is not None:
        u = hash_unit(*keys, seed=seed)
        same = F.length("src") == F.length("tgt")
        out = pairs.withColumn("tgt", F.when(same, crop(F.col("tgt"), size, uniform=u)).otherwise(F.col("tgt"))).withColumn("src", crop(F.col("src"), size, uniform=u))
    return out.withColumns({"src_labels": src.labels(F.col("src")), "tgt_labels": tgt.labels(F.col("tgt"))})


def save_dataset(pairs: DataFrame, path: str, overwrite: bool = False, **facts: str) -> None:
    """A data set and what is to be known of it, such as its alphabets."""
    mode = "overwrite" if overwrite else "errorifexists"
    pairs.write.mode(mode).parquet(f"{path}/pairs")
    pairs.sparkSession.createDataFrame(sorted(facts.items()), "name string, value string").write.mode(mode).parquet(f"{path}/facts")


def load_dataset(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, str]] | None:
    """What ``save_dataset`` wrote; None where there is nothing."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/facts/_SUCCESS")
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return None
    return spark.read.parquet(f"{path}/pairs"), {r["name"]: r["value"] for r in spark.read.parquet(f"{path}/facts").collect()}


def one_to_one(pairs: DataFrame) -> DataFrame:
    """One row: whether all pairs are of equal length."""
    return pairs.agg(F.coalesce(F.bool_and(F.length("src") == F.length("tgt")), F.lit(True)).alias("one_to_one"))


def dataset_cer(pairs: DataFrame, by_edits: bool = False) -> DataFrame:
    """One row, cer: 1 - right places / summed longer lengths. Pairs of unequal length have no right place, unless
    ``by_edits`` counts theirs by edit distance; without pairs it is 1."""
    return dataset_cers(pairs, edits=by_edits, places=not by_edits).select(F.col("edit_cer" if by_edits else "cer").alias("cer"))


def dataset_cers(pairs: DataFrame, places: bool = True, edits: bool = True) -> DataFrame:
    """One row (cer, edit_cer): both kinds of ``dataset_cer``, in one pass."""
    longest = F.greatest(F.length("src"), F.length("tgt"))
    kinds = ({"cer": F.coalesce(matches(F.col("src"), F.col("tgt")), F.lit(0))} if places else {}) | ({"edit_cer": longest - edit_distance(F.col("src"), F.col("tgt"))} if edits else {})
    right = pairs.select(longest.alias("longest"), *[c.alias(name) for name, c in kinds.items()])
    return right.agg(*[(F.lit(1.0) - F.coalesce(F.try_divide(F.sum(name), F.sum("longest")), F.lit(0.0))).alias(name) for name in kinds])


def edit_totals(pairs: DataFrame, *by: str) -> DataFrame:
    """(by..., errors, total): summed edit distance and target length."""
    rated = pairs.select(*by, edit_distance(F.col("src"), F.col("tgt")).cast("long").alias("d"), F.length("tgt").cast("long").alias("size"))
    return rated.groupBy(*by).agg(F.sum("d").alias("errors"), F.sum("size").alias("total"))


def many_to_more(pairs: DataFrame, low: int = 1, high: int = 1 << 30, letters: str | None = None, band: int | None = None, start_insertions: bool = True) -> DataFrame:
    """``pairs`` with parts, each source character's piece of the target; cheap filters come before the alignment, and
    pairs whose lengths differ by more than a given ``band`` go. Without ``start_insertions`` so do pairs whose target begins before the source does."""
    kept = within_lengths(pairs, low, high)
    if band is not None:
        kept = kept.filter(F.abs(F.length("src") - F.length("tgt")) <= band)
    if letters is not None:
        kept = within_alphabet(kept, letters)
    out = kept.withColumn("parts", align_substrings(F.col("src"), F.col("tgt"), band)).filter("parts is not null")
    return out if start_insertions else out.filter((F.length(out["parts"][0]["tgt"]) == 0) | (F.substring(out["parts"][0]["tgt"], 1, 1) == out["parts"][0]["src"]))


def postcorrection_pairs(pairs: DataFrame, min_length: int = 50, most: float = 0.2) -> DataFrame:
    """pairs(..., sub, tgt): predictions made to differ from the truth by substitutions only; short truths and pairs too far
    apart go before the alignment is worked out."""
    kept = pairs.filter(F.length("tgt") >= min_length)
    kept = within_distance(kept, most)
    return kept.withColumn("sub", substituted(F.col("src"), F.col("tgt")))


def full_cer(pairs: DataFrame, *by: str, ignore_above: float = 1.0) -> DataFrame:
    """(by..., n_lines, n_dropped, distance, cer, deletions, insertions, substitutions) over lines whose own error rate is
    at most ``ignore_above``; deletions are characters of the prediction that the truth lacks."""
    # of lines beyond that rate no steps are worked out
    ops = edit_ops(F.col("src"), F.col("tgt"), most=F.floor(ignore_above * F.length(F.trim("tgt"))))
    rated = pairs.select(*by, F.length("tgt").alias("size"), ops.alias("ops"))
    rated = rated.withColumns({"ok": F.col("ops").isNotNull(), "d": F.col("ops.del") + F.col("ops.ins") + F.col("ops.sub")})
    count = lambda op: F.coalesce(F.sum(F.col("ops")[op].cast("long")), F.lit(0))
    total = F.sum(F.when(F.col("ok"), F.col("size")).cast("long"))
    return rated.groupBy(*by).agg(
        F.count("*").alias("n_lines"), F.count_if(~F.col("ok")).alias("n_dropped"), F.coalesce(F.sum(F.when(F.col("ok"), F.col("d")).cast("long")), F.lit(0)).alias("distance"),
        F.try_divide(F.sum(F.when(F.col("ok"), F.col("d"))), total).alias("cer"), count("del").alias("deletions"), count("ins").alias("insertions"), count("sub").alias("substitutions"))


def substitution_cdf(confusions: DataFrame) -> DataFrame:
    """(src_chr, tgt_chr, n, p, cdf) of a confusion table without its insertions and deletions."""
    return cumulative(confusions.filter("src_chr <> '' and tgt_chr <> ''").select("src_chr", "tgt_chr", "n"), "src_chr", "tgt_chr")


def distort(corpus: DataFrame, cdf: DataFrame, key: str, seed: int = 0, text_col: str = "text", unknown: str = "�", uniform: Column | None = None) -> DataFrame:
    """(key, text): each character replaced by one drawn from its row of ``cdf``; characters without a row become
    ``unknown``. The draw follows from seed, key and place."""
    letters = corpus.select(key, F.posexplode(F.split(text_col, "")).alias("pos", "src_chr")).filter("src_chr <> ''")
    u = hash_unit(key, "pos", seed=seed) if uniform is None else uniform
    rows = cdf.groupBy("src_chr").agg(F.sort_array(F.collect_list(F.struct("cdf", "tgt_chr"))).alias("row"))
    drawn = letters.join(rows, "src_chr", "left").withColumn("u", u)
    hit = F.get(F.filter("row", lambda x: x["cdf"] > F.col("u")), F.lit(0))["tgt_chr"]
    out = F.coalesce(hit, F.element_at("row", -1)["tgt_chr"], F.lit(unknown))
    pieces = drawn.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", out.alias("c")))), lambda x: x["c"]), "").alias(text_col))
    return pieces


def windows(text: Column, size: int) -> Column:
    """All stretches of ``size`` characters, one place apart. A long text is cut in overlapping pieces first: to find a place
    in a string, it is read from its beginning."""
    n, step = F.length(text), 4 * size
    pieces = F.transform(F.sequence(F.lit(1), n - size + 1, F.lit(step)), lambda i: F.substring(text, i, F.lit(step + size - 1)))
    each = F.transform(pieces, lambda p: F.transform(F.sequence(F.lit(1), F.length(p) - size + 1), lambda j: F.substring(p, j, F.lit(size))))
    return F.when(n >= size, F.flatten(each)).otherwise(F.array().cast("array<string>"))


def window_ends(text: Column, size: int) -> Column:
    """Of all ``windows`` of a text a struct (n, firsts, lasts): how many there are, and their first and last characters, one text
    each. The windows are views of the text's code points, so they take no room of their own."""

    @F.arrow_udf("struct<n:int,firsts:string,lasts:string>")
    def each(texts: pa.Array) -> pa.Array:
        return in_pieces(ends, texts)

    def ends(texts: pa.Array) -> pa.Array:
        code, bounds = points(texts)
        n = np.maximum(np.diff(bounds) - size + 1, 0)
        views = [sliding_window_view(code[a:z], size) for a, z, k in zip(bounds[:-1].tolist(), bounds[1:].tolist(), n.tolist(), strict=True) if k]
        upto = np.concatenate(([0], np.cumsum(n)))
        side = lambda place: texts_of(np.concatenate([v[:, place] for v in views]) if views else code[:0], upto)
        return pa.StructArray.from_arrays([pa.array(n.astype(np.int32)), side(0), side(size - 1)], ["n", "firsts", "lasts"], mask=texts.is_null())

    return each(text)


def pack_lines(lines: DataFrame, key: str, more_than: int = 50, order: str = "line_no") -> DataFrame:
    """(key, block, text): lines of a document joined until they are longer than ``more_than``; what is left at the end is a
    block of its own."""
    ordered = lines.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct(order, "text"))), lambda x: x["text"]).alias("ls"))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def add(acc, line):
        grown = F.when(acc["open"] == "", line).otherwise(F.concat(acc["open"], F.lit("\n"), line))
        full = F.length(grown) > more_than
        return F.struct(F.when(full, F.concat(acc["done"], F.array(grown))).otherwise(acc["done"]).alias("done"), F.when(full, "").otherwise(grown).alias("open"))

    packed = F.aggregate("ls", start, add, lambda acc: F.when(acc["open"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))))
    return ordered.select(key, F.posexplode(packed).alias("block", "text"))


def correct_column(line: Column, index: int, f) -> Column:
    """A tab-separated line with ``f`` applied to one of its fields."""
    return F.array_join(F.transform(F.split(line, "\t"), lambda x, i: F.when(i == index, f(x)).otherwise(x)), "\t")


def running_best(history: DataFrame, metric: str, order: str = "epoch") -> DataFrame:
    """``history`` with best, the greatest value so far."""
    return history.withColumn("best", F.max(metric).over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))  # some rows an epoch


def assert_equal_lengths(pairs: DataFrame, src: str = "src", tgt: str = "tgt") -> DataFrame:
    """``pairs``, of which one with texts of unequal length is an error when it is read."""
    wrong = F.raise_error(F.lit("texts of unequal length")).cast("string")
    return pairs.withColumn(src, F.when(F.length(src) != F.length(tgt), wrong).otherwise(F.col(src)))
