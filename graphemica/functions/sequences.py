"""Label sequences: collapsing, expanding and padding; pyramids of character histograms; vector distances."""

from __future__ import annotations

import string

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .batches import points

ALPHANUMERIC = string.digits + string.ascii_uppercase + string.ascii_lowercase


def ctc_collapse(labels: Column, blank: Column | int | str = 0) -> Column:
    """Of runs of the same label the last one, without blanks."""
    end = F.lit(blank) if not isinstance(blank, Column) else blank
    after = F.concat(F.slice(labels, 2, F.greatest(F.size(labels), F.lit(1))), F.array(end))
    pairs = F.zip_with(labels, after, lambda x, y: F.when((x != y) & (x != end), x))
    return F.filter(pairs, lambda x: x.isNotNull())


def ctc_confidence(labels: Column, confidence: Column, blank: int = 0) -> Column:
    """The confidences of the labels that ``ctc_collapse`` keeps."""
    after = F.concat(F.slice(labels, 2, F.greatest(F.size(labels), F.lit(1))), F.array(F.lit(blank)))
    kept = F.zip_with(F.arrays_zip(labels.alias("x"), confidence.alias("c")), after, lambda p, y: F.when((p["x"] != y) & (p["x"] != blank), p["c"]))
    return F.filter(kept, lambda c: c.isNotNull())


def ctc_expand(labels: Column, slots: int, replicate: bool = False, blank: int = 0) -> Column:
    """Each label in ``slots + 1`` places: once and then blanks, or replicated and then one blank."""
    one = lambda x: F.concat(F.array_repeat(x, slots), F.array(F.lit(blank))) if replicate else F.concat(F.array(x), F.array_repeat(F.lit(blank), slots))
    return F.flatten(F.transform(labels, one))


def pad_targets(targets: Column, most: int, fill: int = 0) -> Column:
    """Arrays of labels padded to ``most + 1``; a longer one is an error."""
    size = most + 1
    padded = lambda t: F.when(F.size(t) > size, F.raise_error(F.lit(f"a target is longer than {most}")).cast("array<int>")).otherwise(F.slice(F.concat(t, F.array_repeat(F.lit(fill), size)), 1, size))
    return F.transform(targets, padded)


def longest_target(targets: Column) -> Column:
    """Summed length of a sample's target pieces."""
    return F.aggregate(targets, F.lit(0), lambda n, t: n + F.length(t))


def _pyramid(words: pa.Array, levels: tuple[int, ...], letters: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, place in the vector, share, length of the word) of all entries that are not zero, in order, a batch at a time."""
    code, bounds = points(words)
    known = np.array([ord(c) for c in letters], np.uint32)
    at = np.minimum(np.searchsorted(known, code), len(known) - 1)
    label = np.where(known[at] == code, at + 1, 0)
    n, width, bins = np.diff(bounds), len(letters) + 1, sum(levels)
    keys, sizes = [], []
    for level in levels:
        for i in range(level):
            a, z = i * n // level, -(-(i + 1) * n // level)
            size = z - a
            row = np.repeat(np.arange(len(n)), size)
            place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + (bounds[:-1] + a)[row]
            keys.append((row * bins + len(sizes)) * width + label[place])
            sizes.append(size)
    key, count = np.unique(np.concatenate(keys), return_counts=True)
    row, place = np.divmod(key, bins * width)
    return row, place, count / np.array(sizes)[place // width, row], n[row]


def _phoc_letters(alphabet: str, case_insensitive: bool, add_space: bool) -> str:
    return "".join(sorted(set((" " if add_space else "") + (alphabet.lower() if case_insensitive else alphabet))))


def phoc(word: Column, levels: tuple[int, ...] = (1, 2, 3, 5), alphabet: str = ALPHANUMERIC, mode: str = "avg", case_insensitive: bool = False, add_space: bool = True) -> Column:
    """A pyramid of character histograms: for each level L, L overlapping bins over the word, in each the share of every
    label (0 for characters outside the alphabet), level by level and bin by bin.

    mode "avg": shares; "sum": shares times the word's length; "bin": that, at most 1. The empty word gives zeros, NULL gives NULL.
    """
    letters = _phoc_letters(alphabet, case_insensitive, add_space)
    whole = sum(levels) * (len(letters) + 1)

    @F.arrow_udf("array<double>")
    def each(words: pa.Array) -> pa.Array:
        row, place, share, n = _pyramid(words, levels, letters)
        if mode != "avg":
            share = np.round(share * n, 9)
        out = np.zeros((len(words), whole))
        out[row, place] = share if mode != "bin" else np.minimum(share, 1.0)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(words) + 1, dtype=np.int32) * whole), pa.array(out.ravel()), mask=words.is_null())

    return each(F.lower(word) if case_insensitive else word)


def phoc_entries(word: Column, levels: tuple[int, ...] = (1, 2, 3, 5), alphabet: str = ALPHANUMERIC, case_insensitive: bool = False, add_space: bool = True) -> Column:
    """The entries of ``phoc`` (shares) that are not zero: an array of (place, share), by place."""
    letters = _phoc_letters(alphabet, case_insensitive, add_space)

    @F.arrow_udf("array<struct<place:int,share:double>>")
    def each(words: pa.Array) -> pa.Array:
        row, place, share, _ = _pyramid(words, levels, letters)
        offsets = np.searchsorted(row, np.arange(len(words) + 1)).astype(np.int32)
        entries = pa.StructArray.from_arrays([pa.array(place.astype(np.int32)), pa.array(share)], ["place", "share"])
        return pa.ListArray.from_arrays(pa.array(offsets), entries, mask=words.is_null())

    return each(F.lower(word) if case_insensitive else word)


def phoc_size(levels: tuple[int, ...] = (1, 2, 3, 5), letters: int = 63) -> int:
    return sum(levels) * letters


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)) + 1e-8)


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def topk_similar(base: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query, id, rank, cosine): the ``k`` vectors most similar to each query, ties by id.

    Each task keeps the best of its own rows before anything moves, so what is shuffled is k rows a query and task.
    """
    def norm(v: str) -> Column:
        return F.sqrt(dot(F.col(v), F.col(v)))

    q = queries.select(F.col(id_col).alias("query"), F.col(vec_col).alias("qv"), norm(vec_col).alias("qn"))
    b = base.select(F.col(id_col).alias("id"), F.col(vec_col).alias("bv"), norm(vec_col).alias("bn"))
    scored = b.crossJoin(q).select("query", "id", (dot(F.col("bv"), F.col("qv")) / (F.col("bn") * F.col("qn") + 1e-8)).alias("cosine"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("cosine"), "id"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k).select("query", "id", "rank", "cosine")


def nearest(base: DataFrame, queries: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query, id, l2): the vector nearest to each query, ties by id."""
    pairs = base.select(F.col(id_col).alias("id"), F.col(vec_col).alias("bv")).crossJoin(queries.select(F.col(id_col).alias("query"), F.col(vec_col).alias("qv")))
    scored = pairs.select("query", "id", l2(F.col("bv"), F.col("qv")).alias("l2"))
    return scored.groupBy("query").agg(F.min(F.struct("l2", "id")).alias("m")).select("query", "m.id", "m.l2")


def vocabulary(corpus: DataFrame, pattern: str = "[^a-z]+", text_col: str = "text", capacity: int | None = None) -> DataFrame:
    """(word, freq, idx): words by frequency, then alphabet; with ``capacity`` the most frequent ones only."""
    words = corpus.select(F.explode(F.split(F.lower(text_col), pattern)).alias("word")).filter("word <> ''")
    counts = words.groupBy("word").agg(F.count("*").alias("freq"))
    if capacity is not None:
        counts = counts.orderBy(F.desc("freq"), "word").limit(capacity)
    return counts.withColumn("idx", F.row_number().over(Window.orderBy(F.desc("freq"), "word")) - 1) if capacity is not None else counts
