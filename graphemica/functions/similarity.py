"""Similarity of characters, and mappings and distances derived from it."""

from __future__ import annotations

import functools
import math
import string
import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.charsets import UNKNOWN
from .unicode import to_ascii


@functools.lru_cache(maxsize=1 << 17)
def _facts(c: str):
    name = unicodedata.name(c, "")
    plain = to_ascii(c)
    return name, frozenset(name.split()), unicodedata.category(c), plain, plain.lower()


@functools.lru_cache(maxsize=1 << 16)
def _ratio(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b).ratio()


def _overlap(a: str, b: str, single: float) -> float:
    """How far two plain-letter forms agree: all or nothing for single letters, else place by place, earlier ones more."""
    if not a or not b:
        return 0.0
    if len(a) == len(b) == 1:
        return single if a == b else 0.0
    weight = lambda i, n: 1.5 if n == 1 else 1.5 - i / (n - 1)
    return sum((x == y) * weight(i, len(a)) * weight(j, len(b)) for i, x in enumerate(a) for j, y in enumerate(b)) / (len(a) * len(b))


def _one_way(a: str, b: str) -> float:
    (na, wa, ca, pa, la), (nb, wb, cb, pb, lb) = _facts(a), _facts(b)
    score = 0.1 * (ca[0] == cb[0]) + 0.2 * (ca == cb)
    if na and nb:
        score += 0.3 * len(wa & wb) / max(len(wa), len(wb)) + 0.2 * _ratio(na, nb) + 0.1 * _ratio(na[: len(na) // 2], nb[: len(nb) // 2])
    score += 0.2 * (a.lower() == b.lower() and a.isalpha() and b.isalpha())
    score += 0.2 * (a.isspace() and b.isspace()) + 0.2 * (a in string.punctuation and b in string.punctuation)
    score += _overlap(pa, pb, 0.7) + _overlap(la, lb, 0.5)
    if la and la == lb:
        score += 0.25
    elif la and lb and (la in "aeiouy") == (lb in "aeiou"):
        score += 0.2 if la in "aeiouy" else 0.1
    score += 0.05 / (1 + math.exp(-abs(ord(a) - ord(b))))
    return 2 * (1 / (1 + math.exp(-score)) - 0.5)


@functools.lru_cache(maxsize=1 << 18)
def char_similarity(a: str, b: str, symmetric: bool = True) -> float:
    """From 0 to 1: category, name, case, kind, plain letters and distance of two characters; 1 for the same one."""
    if a == b:
        return 1.0
    return (_one_way(a, b) + _one_way(b, a)) / 2 if symmetric else _one_way(a, b)


def similarity(a: Column, b: Column) -> Column:
    @F.pandas_udf("double")
    def each(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or r is None else char_similarity(p, r) for p, r in zip(x, y, strict=True)], dtype="float64")

    return each(a, b)


def _letters(spark: SparkSession, letters: str, name: str) -> DataFrame:
    return spark.createDataFrame([(i, c) for i, c in enumerate(dict.fromkeys(letters))], f"{name}_idx int, {name} string")


def similarity_mapping(spark: SparkSession, src: str, dst: str, override: dict[str, str] | None = None, min_similarity: float = 0.25, unknown: str = UNKNOWN) -> DataFrame:
    """(src, dst, similarity): for each source character the target most similar to it, the first of equal ones.

    Similarities below ``min_similarity`` count as 0; the unknown character, first of the targets unless it is among
    them, gets 1e-5 more. ``override`` decides for its characters. The pairs are scored in parallel, all on executors.
    """
    override = override or {}
    targets = dst if unknown in dst else unknown + dst
    left = _letters(spark, "".join(c for c in src if c not in override), "src").repartition(spark.sparkContext.defaultParallelism, "src")
    pairs = left.crossJoin(F.broadcast(_letters(spark, targets, "dst")))  # as long as the given alphabet
    s = F.col("s") + F.when(F.col("dst") == unknown, 1e-5).otherwise(0.0)
    scored = pairs.withColumn("s", similarity(F.col("src"), F.col("dst"))).withColumn("s", F.when(s < min_similarity, F.lit(0.0)).otherwise(s))
    best = scored.groupBy("src").agg(F.max_by(F.struct("dst", "s"), F.struct("s", -F.col("dst_idx"))).alias("b")).select("src", "b.dst", F.col("b.s").alias("similarity"))
    fixed = spark.createDataFrame([(a, b, 1.0) for a, b in override.items()], "src string, dst string, similarity double")
    return best.unionByName(fixed)


def distance_matrix(spark: SparkSession, letters: str) -> DataFrame:
    """(a, b, d): 1 - similarity of all ordered pairs; each unordered pair is scored once."""
    one, two = _letters(spark, letters, "a"), _letters(spark, letters, "b")
    half = one.crossJoin(F.broadcast(two)).filter("a_idx < b_idx").repartition(spark.sparkContext.defaultParallelism, "a").select("a", "b", (1 - similarity(F.col("a"), F.col("b"))).alias("d"))  # two: the given alphabet
    same = one.select("a", F.col("a").alias("b"), F.lit(0.0).alias("d"))
    return half.unionByName(half.select(F.col("b").alias("a"), F.col("a").alias("b"), "d")).unionByName(same)


def linkage(distances: DataFrame) -> list[tuple[str, str, float, int]]:
    """Average-linkage clustering of a distance matrix (a, b, d) of some hundred points: (left, right, distance, size) for
    each joining, clusters named by their members in order."""
    d = {(r["a"], r["b"]): r["d"] for r in distances.collect()}
    size = {a: 1 for a, _ in d}
    out = []
    while len(size) > 1:
        (x, y), least = min(((p, v) for p, v in d.items() if p[0] < p[1]), key=lambda e: (e[1], e[0]))
        n, new = size[x] + size[y], x + y
        out.append((x, y, least, n))
        for z in size:
            if z not in (x, y):
                d[new, z] = d[z, new] = (d[x, z] * size[x] + d[y, z] * size[y]) / n
        d = {p: v for p, v in d.items() if x not in p and y not in p}
        size = {z: k for z, k in size.items() if z not in (x, y)} | {new: n}
    return out


def adjust_linkage(steps: list[tuple[str, str, float, int]], gap: float = 0.05) -> list[tuple[str, str, float, int]]:
    """Joinings raised so that each lies at least ``gap`` above those of its parts."""
    height: dict[str, float] = {}
    out = []
    for left, right, d, n in steps:
        d = max(d, *(height[p] + gap for p in (left, right) if p in height), 0.0) if left in height or right in height else d
        height[left + right] = d
        out.append((left, right, d, n))
    return out
