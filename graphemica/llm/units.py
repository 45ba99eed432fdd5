"""Groups of a join within groups, cut in units of bounded size, however large a group is.

A group's rows are at home in it or guests; every row at home is to be compared with every other row. A group of more
than twice ``limit`` rows is cut in chunks by the hash of its rows, and each pair of chunks, of which one at least is at
home, is a unit ``(u, v)``: the rows of chunk u, all at home, against those of chunk v. Smaller groups are the unit (0, 0).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_side


def in_units(spread: DataFrame, counts: DataFrame, keys: list[str], row: list[str], limit: int) -> DataFrame:
    """``spread`` with u, v and part (the chunk of the row), a row for each unit that a row takes part in.

    counts: (keys..., h, g), rows at home and guests by group; row: columns that tell rows apart.
    """
    cut = lambda n: F.greatest(F.lit(1), F.ceil(F.col(n) / limit)).cast("int")
    large = counts.filter(F.col("h") + F.col("g") > 2 * limit).select(*keys, cut("h").alias("nh"), F.when(F.col("g") > 0, cut("g")).otherwise(0).alias("ng"))
    large = join_side(large)
    if large.isEmpty():
        return spread.select("*", *[F.lit(0).alias(c) for c in ("u", "v", "part")])
    mine = lambda n: F.pmod(F.xxhash64(*row), F.col(n)).cast("int")
    unit = lambda u, v, p: F.struct(u.alias("u"), v.alias("v"), p.alias("part"))
    all_of = lambda n: F.filter(F.sequence(F.lit(0), F.col(n)), lambda j: j < F.col(n))
    i, j = mine("nh"), F.col("nh") + mine("ng")
    home = F.concat(F.transform(all_of("nh"), lambda k: unit(F.least(i, k), F.greatest(i, k), i)), F.transform(all_of("ng"), lambda k: unit(i, F.col("nh") + k, i)))
    guest = F.transform(all_of("nh"), lambda k: unit(k, j, j))
    zero = F.lit(0)
    units = F.when(F.col("nh").isNull(), F.array(unit(zero, zero, zero))).when(F.col("home"), home).otherwise(guest)
    return spread.join(large, keys, "left").withColumn("unit", F.explode(units)).select(*spread.columns, "unit.*")


def sides(u: int, v: int, part: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the two sides of a unit; with u = v a pair of rows at home is meant once, in ascending order."""
    return np.flatnonzero((part == u) & home), np.flatnonzero(part == v)


def roots(label: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The root of each of ``x``, which then points to it."""
    y = label[x]
    while ((up := label[y]) != y).any():
        y = up
    label[x] = y
    return y


def forest(count: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Each node's smallest index within its component.

    Only roots are hooked, each to a smaller one, until the ends of every pair of the batch have the same root: a link
    that an earlier batch made is never overwritten.
    """
    label = np.arange(count)
    for a, b in pairs:
        while True:
            a, b = roots(label, a), roots(label, b)
            apart = a != b
            if not apart.any():
                break
            a, b = a[apart], b[apart]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
    while (label != label[label]).any():
        label = label[label]
    return label


def linked(count: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]], weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(label, links) of ``count`` nodes: the smallest index of each one's component, and the number of its pairs, each
    counted as often as the other end's ``weight`` says. Pairs are not kept."""
    links = np.zeros(count, np.int64)

    def each() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        nonlocal links
        for a, b in pairs:
            if weight is None:
                links += np.bincount(a, minlength=count) + np.bincount(b, minlength=count)
            else:
                np.add.at(links, a, weight[b])
                np.add.at(links, b, weight[a])
            yield a, b

    return forest(count, each()), links
