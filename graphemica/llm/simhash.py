"""SimHash near-dedup: exact pairs by vantage-point trees (operator 8)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Words, chunks, fresh, join_side, lean, materialize, mix64, q, signed, trim
from .components import components
from .units import in_units, linked, sides

#: Of 128 bits, so many may differ; sizes (distinct words) may differ by this ratio.
BITS, MAX_BITS, MIN_RATIO = 128, 22, 0.8
#: Rows of the sample that the tree over shards is built on, at least and at most; fingerprints a shard should hold, rows of
#: a unit of a larger one, and points of a leaf of the tree within a shard. They change no row.
SAMPLE, MAX_SAMPLE, SHARD, UNIT, LEAF = 1 << 16, 1 << 20, 1 << 14, 1 << 16, 256
_MIN_ID = -(1 << 63)


def fingerprints(w: Words, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(bits, n): 128-bit SimHash over each text's distinct words, as two 64-bit halves, and the number of these."""
    order = np.lexsort((w.hash, w.doc))
    words, doc = w.hash[order], w.doc[order]
    keep = np.ones(len(words), bool)
    keep[1:] = (words[1:] != words[:-1]) | (doc[1:] != doc[:-1])
    words, doc = words[keep], doc[keep]
    n = np.bincount(doc, minlength=rows)
    out = np.zeros((rows, 2), np.uint64)
    has = np.flatnonzero(n)
    if len(has):
        first = (np.cumsum(n) - n)[has]
        for half, salt in enumerate((0, 0x94D049BB133111EB)):
            bits = np.unpackbits(mix64(words ^ np.uint64(salt)).view(np.uint8).reshape(-1, 8), axis=1)
            ones = np.add.reduceat(bits, first, axis=0, dtype=np.int32)
            out[has, half] = np.packbits(2 * ones > n[has, None], axis=1).view(np.uint64).ravel()
    return out, n


def fingerprint_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(d, rh, n, f1, f2): by row its id, the hash of its text, its number of distinct words and its fingerprint."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lean(batches):
            for part in chunks(batch, "t"):
                f, n = fingerprints(Words(part.column("t")), part.num_rows)
                yield pa.record_batch([part.column("d"), part.column("rh"), pa.array(n.astype(np.int32)), signed(f[:, 0]), signed(f[:, 1])], names=["d", "rh", "n", "f1", "f2"])

    slim = docs.select(F.coalesce(q(id_col).cast("long"), F.lit(_MIN_ID)).alias("d"), F.xxhash64(q(text_col)).alias("rh"), q(text_col).alias("t"))
    return slim.mapInArrow(each, "d bigint, rh bigint, n int, f1 bigint, f2 bigint")


class Metric:
    """max(Hamming distance, scaled difference of the sizes' logarithms): a metric, and within ``radius`` exactly where
    at most ``radius`` bits differ and the smaller size is at least ``ratio`` of the larger."""

    def __init__(self, radius: int, ratio: float):
        self.radius = radius
        self.scale = radius / -math.log(ratio)

    def distance(self, f: np.ndarray, n: np.ndarray, f0: np.ndarray, n0) -> np.ndarray:
        return np.maximum(np.bitwise_count(f[..., 0] ^ f0[..., 0]).astype(np.int16) + np.bitwise_count(f[..., 1] ^ f0[..., 1]), self.scale * np.abs(np.log(n) - np.log(n0)))

    def near(self, f: np.ndarray, n: np.ndarray, f0: np.ndarray, n0) -> np.ndarray:
        return self.distance(f, n, f0, n0) <= self.radius + 1e-6


class Node:
    """A vantage point; nearer points than ``mu`` (or as near) go inside. A leaf has ``shard`` only."""

    __slots__ = ("f", "n", "mu", "inner", "outer", "shard")


def build(f: np.ndarray, n: np.ndarray, metric: Metric, leaves: int, seed: int = 5) -> Node:
    """A tree of about ``leaves`` shards over a sample. Of some candidates, among them a point of size 1, that vantage
    point is taken from which the fewest points lie within the radius of the median distance."""
    rng, count = np.random.default_rng(seed), 0

    def grow(at: np.ndarray, leaves: float) -> Node:
        nonlocal count
        node = Node()
        node.shard = None
        best = None
        if leaves > 1.5 and len(at) > 16:
            for k in (None, *rng.choice(at, min(6, len(at)), replace=False)):
                f0, n0 = (np.zeros(2, np.uint64), 1) if k is None else (f[k], n[k])
                d = metric.distance(f[at], n[at], f0, n0)
                mu = float(np.median(d))
                band = np.mean(np.abs(d - mu) <= metric.radius)
                side = np.mean(d <= mu)
                if 0.1 < side < 0.9 and (best is None or band < best[0]):
                    best = band, f0, n0, mu, d
        if best is None:
            node.shard, count = count, count + 1
            return node
        _, node.f, node.n, node.mu, d = best
        node.inner, node.outer = grow(at[d <= node.mu], leaves / 2), grow(at[d > node.mu], leaves / 2)
        return node

    return grow(np.arange(len(n)), leaves)


def assign(root: Node, f: np.ndarray, n: np.ndarray, metric: Metric) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shard, home): where each point lives and where it visits.

    Two points that a vantage point parts are brought together on its inner side: the outer one visits it if its
    distance allows (triangle inequality); a visitor goes on into every side that its ball may reach. So each pair
    within the radius meets in exactly one shard in which one of the two at least is at home.
    """
    out: list[tuple[np.ndarray, int, bool]] = []
    slack = metric.radius + 1e-6
    stack = [(root, np.arange(len(n)), np.zeros(0, np.int64))]
    while stack:
        node, home, guest = stack.pop()
        if not len(home) and not len(guest):
            continue
        if node.shard is not None:
            out += [(home, node.shard, True), (guest, node.shard, False)]
            continue
        dh = metric.distance(f[home], n[home], node.f, node.n)
        dg = metric.distance(f[guest], n[guest], node.f, node.n)
        inner = dh <= node.mu
        stack.append((node.inner, home[inner], np.concatenate((guest[dg <= node.mu + slack], home[~inner & (dh <= node.mu + slack)]))))
        stack.append((node.outer, home[~inner], guest[dg > node.mu - slack]))
    return np.concatenate([x for x, _, _ in out]), np.concatenate([np.full(len(x), s) for x, s, _ in out]), np.concatenate([np.full(len(x), h) for x, _, h in out])


def _brute(f: np.ndarray, n: np.ndarray, left: np.ndarray, right: np.ndarray, metric: Metric) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for i in range(0, len(left), 256):
        rows = left[i : i + 256]
        for j in range(0, len(right), 8192):
            others = right[j : j + 8192]
            h = np.bitwise_count(f[rows, 0, None] ^ f[None, others, 0])
            h += np.bitwise_count(f[rows, 1, None] ^ f[None, others, 1])
            x, y = np.nonzero(h <= metric.radius)
            x, y = rows[x], others[y]
            ok = metric.near(f[x], n[x], f[y], n[y])
            if ok.any():
                yield x[ok], y[ok]


def near_of(f: np.ndarray, n: np.ndarray, left: np.ndarray, right: np.ndarray, metric: Metric, leaf: int = LEAF, seed: int = 7) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a row of ``left`` and one of ``right`` within the radius, by a vantage-point tree over ``left``: the rows of
    ``right`` follow it down into each side that their balls reach. Of some vantage points the one that leaves the fewest
    pairs to look at is taken; where none leaves out a tenth of them, all are looked at."""
    rng = np.random.default_rng(seed)
    slack = metric.radius + 1e-6
    stack = [(left, right)]
    while stack:
        left, right = stack.pop()
        if not len(left) or not len(right):
            continue
        best = None
        if len(left) > leaf:
            some, others = (x if len(x) <= 512 else rng.choice(x, 512, replace=False) for x in (left, right))
            for k in (None, *rng.choice(left, 4)):
                f0, n0 = (np.zeros(2, np.uint64), 1) if k is None else (f[k], n[k])
                dl, dr = metric.distance(f[some], n[some], f0, n0), metric.distance(f[others], n[others], f0, n0)
                mu = float(np.median(dl))
                inner = float(np.mean(dl <= mu))
                cost = inner * np.mean(dr <= mu + slack) + (1 - inner) * np.mean(dr > mu - slack)
                if inner < 1 and cost < 0.9 and (best is None or cost < best[0]):
                    best = float(cost), f0, n0, mu
        if best is None:
            yield from _brute(f, n, left, right, metric)
            continue
        _, f0, n0, mu = best
        dl, dr = metric.distance(f[left], n[left], f0, n0), metric.distance(f[right], n[right], f0, n0)
        stack.append((left[dl <= mu], right[dr <= mu + slack]))
        stack.append((left[dl > mu], right[dr > mu - slack]))


def unit_pairs(f: np.ndarray, n: np.ndarray, home: np.ndarray, metric: Metric, u: int = 0, v: int = 0, part: np.ndarray | None = None, leaf: int = LEAF) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of a unit (see ``units``) within the radius, each once."""
    left, right = sides(u, v, np.zeros(len(n), np.int32) if part is None else part, home)
    for a, b in near_of(f, n, left, right, metric, leaf):
        if u == v:
            ok = ~home[b] | (a < b)
            a, b = a[ok], b[ok]
        if len(a):
            yield a, b


_ROW = "d bigint, rh bigint, n int, f1 bigint, f2 bigint, m bigint"


def _points(t) -> tuple[np.ndarray, np.ndarray]:
    return np.stack([t.column(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in ("f1", "f2")], 1), t.column("n").to_numpy(zero_copy_only=False).astype(np.int64)


def shards(prints: DataFrame, metric: Metric, rows: int, shard: int = SHARD) -> tuple[DataFrame, DataFrame]:
    """``prints`` with shard and home, a row for each shard that a point lives in or visits; and (shard, h, g), the points at
    home and the guests of each. The tree is built on 64 points a shard, at most MAX_SAMPLE; where more shards would be
    needed they grow instead, and ``in_units`` cuts them."""
    want = min(MAX_SAMPLE, max(SAMPLE, 64 * math.ceil(rows / shard)))
    sample = prints.filter(F.pmod(F.xxhash64("f2", "d"), F.lit(max(1, rows))) < want).select("f1", "f2", "n").toArrow().combine_chunks().sort_by([("f1", "ascending"), ("f2", "ascending"), ("n", "ascending")])
    f, n = _points(sample)
    tree = prints.sparkSession.sparkContext.broadcast(build(f, n, metric, min(max(1, math.ceil(rows / shard)), want // 64)))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lean(batches):
            row, at, home = assign(tree.value, *_points(batch), metric)
            part = batch.take(pa.array(row))
            yield pa.record_batch([*part.columns, pa.array(at.astype(np.int32)), pa.array(home)], names=[*part.schema.names, "shard", "home"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lean(batches):
            _, at, home = assign(tree.value, *_points(batch), metric)
            h, g = np.bincount(at[home], minlength=1), np.bincount(at[~home], minlength=1)
            size = max(len(h), len(g))
            h, g = (np.pad(x, (0, size - len(x))) for x in (h, g))
            yield pa.record_batch([pa.array(np.arange(size, dtype=np.int32)), pa.array(h), pa.array(g)], names=["shard", "h", "g"])

    counts = prints.select("n", "f1", "f2").mapInArrow(counted, "shard int, h bigint, g bigint").groupBy("shard").agg(F.sum("h").alias("h"), F.sum("g").alias("g"))
    return prints.select("d", "rh", "n", "f1", "f2", "m").mapInArrow(each, _ROW + ", shard int, home boolean"), counts


def near_links(prints: DataFrame, max_bits: int = MAX_BITS, min_ratio: float = MIN_RATIO, shard: int = SHARD, unit: int = UNIT) -> DataFrame:
    """(d, rh, d0, rh0, links) for fingerprints (d, rh, n, f1, f2, m), of each shard: those that are near another one, the
    first one that they are joined to there, and how many rows (m of each fingerprint) are near. Every pair within the
    radius is looked at in one shard, and none is written."""
    metric = Metric(max_bits, min_ratio)

    def each(t: pa.Table) -> pa.Table:
        t = t.combine_chunks().sort_by([("d", "ascending"), ("rh", "ascending")])
        f, n = _points(t)
        pairs = unit_pairs(f, n, t.column("home").to_numpy().astype(bool), metric, int(t["u"][0].as_py()), int(t["v"][0].as_py()), t["part"].to_numpy())
        label, links = linked(len(n), pairs, t["m"].to_numpy())
        a = np.flatnonzero(links)
        left, right = t.take(pa.array(a)), t.take(pa.array(label[a]))
        out = pa.table({"d": left["d"], "rh": left["rh"], "d0": right["d"], "rh0": right["rh"], "links": pa.array(links[a])})
        trim()
        return out

    spread, counts = shards(prints, metric, prints.count(), shard)
    return in_units(spread, counts, ["shard"], ["d", "rh"], unit).groupBy("shard", "u", "v").applyInArrow(each, "d bigint, rh bigint, d0 bigint, rh0 bigint, links bigint")


def near_classes(docs: DataFrame, max_bits: int = MAX_BITS, min_ratio: float = MIN_RATIO, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(d, rh, d0, rh0, links): for each document (id, hash of its text) the first document of its class by (id, hash),
    and the number of documents that are within the radius of it. Classes are the connected components of the pairs within
    the radius. Rows that share id and text are one document here; a document without a word is a class of its own."""
    rows = materialize(fingerprint_table(docs, id_col, text_col).dropDuplicates(["d", "rh"]))
    me = F.struct("d", "rh")
    # equal fingerprints are one point of the search, however many there are
    prints = materialize(rows.filter("n > 0").groupBy("f1", "f2", "n").agg(F.min(me).alias("k"), F.count("*").alias("m")).select("k.d", "k.rh", "n", "f1", "f2", "m"))
    near = materialize(near_links(prints, max_bits, min_ratio))
    heads = components(near.select(me.alias("a"), F.struct(F.col("d0").alias("d"), F.col("rh0").alias("rh")).alias("b"))).select("a.d", "a.rh", "b")
    degree = near.groupBy("d", "rh").agg(F.sum("links").alias("near"))
    told = prints.join(degree, ["d", "rh"], "left").join(heads, ["d", "rh"], "left").filter("m > 1 or near is not null")
    told = join_side(told.select("f1", "f2", "n", F.coalesce("b", me).alias("one"), (F.col("m") - 1 + F.coalesce("near", F.lit(0))).alias("links")))
    one = F.coalesce("one", me)
    return rows.join(told, ["f1", "f2", "n"], "left").select("d", "rh", one["d"].alias("d0"), one["rh"].alias("rh0"), F.coalesce("links", F.lit(0)).alias("links"))


def near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS, min_ratio: float = MIN_RATIO, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(d, rh, d0, rh0): each document (id, hash of its text) that goes, with the one of its class that stays."""
    return near_classes(docs, max_bits, min_ratio, id_col, text_col).filter("d <> d0 or rh <> rh0").drop("links")


def class_table(docs: DataFrame, max_bits: int = MAX_BITS, min_ratio: float = MIN_RATIO, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, class_id, links) of every document (distinct rows of id and text): the least id of its class, and the number of
    documents within the radius. Cases are those of ``dedup_documents``; a NULL id stays NULL."""
    some = lambda c: F.when(F.col(c) != _MIN_ID, F.col(c))
    return near_classes(docs, max_bits, min_ratio, id_col, text_col).select(some("d").alias(id_col), some("d0").alias("class_id"), "links")


def dedup_documents(docs: DataFrame, max_bits: int = MAX_BITS, min_ratio: float = MIN_RATIO, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group of near duplicates: the first by (id, hash of the text).

    Two documents are joined if their 128-bit SimHashes over distinct words differ in ``max_bits`` bits at most and
    their numbers of distinct words by a ratio of ``min_ratio`` at least.

    - NULL or empty text, or one without a word: no fingerprint; never a copy, stays.
    - Ties and exact copies: equal fingerprints are one point of the search, so thousands of copies cost as one.
    - Repeated rows (same id and text): one of them stays. NULL id: before all others.
    - Very long texts: all their words. Ids are integers, or strings of digits; others are an error.
    - Empty table: empty result. Columns and extra columns are those of ``docs``.
    """
    d, rh, again, nth = fresh(docs, "d", "rh", "again", "nth")
    keyed = docs.withColumn(d, F.coalesce(q(id_col).cast("long"), F.lit(_MIN_ID))).withColumn(rh, F.xxhash64(q(text_col)))
    gone = near_duplicates(docs, max_bits, min_ratio, id_col, text_col).select(F.col("d").alias(d), F.col("rh").alias(rh))
    word = q(text_col).rlike(r"[A-Za-z0-9\x{80}-\x{10FFFF}]")
    twice = keyed.filter(word).groupBy(d, rh).agg(F.count("*").alias(again)).filter(q(again) > 1)
    kept = keyed.join(join_side(gone), [d, rh], "left_anti").join(join_side(twice), [d, rh], "left")
    cols = [q(c) for c in docs.columns]
    repeated = kept.filter(q(again).isNotNull()).withColumn(nth, F.row_number().over(Window.partitionBy(d, rh).orderBy(F.lit(1)))).filter(q(nth) == 1)
    return kept.filter(q(again).isNull()).select(*cols).union(repeated.select(*cols))
