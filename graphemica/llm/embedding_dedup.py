"""Embedding near-dedup: subspace pigeonhole join (operator 9).

Vectors are scaled to length 1 and rotated onto the eigenvectors of their second moments. The rotated space is split in
blocks of few dimensions, each with the same share of the variance as nearly as may be. If two vectors are nearer than r,
some block holds no more of their squared distance than its share of r^2; so every pair within r is found by range-joining
each block under its own budget, and the union of what the joins find is verified in all dimensions. Nothing is missed.

A block's range join cuts its space at medians of its coordinates; a vector lives in one cell and visits those cells that
lie within reach, and a pair meets in one cell only. Whole vectors travel with it (as they are, in single precision), so a
pair is verified where it is found, and counted in the first block that finds it: no pair is ever written.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_side, lean, materialize, q, trim
from .components import components
from .units import in_units, linked, sides

#: Cosine of two near duplicates at least; dimensions of a block.
COSINE, BLOCK_DIMS = 0.97, 16
#: Vectors of a cell, about, and rows that the cuts are found on. They change no result.
CELL, SAMPLE = 1 << 15, 1 << 15
_CHUNK, _PAIRS, _EPS = 4096, 1 << 14, 1e-9


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """The vectors, scaled to length 1."""
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims).astype(np.float64)
    return x / np.sqrt((x * x).sum(1))[:, None]


def _rotated(x: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """``x @ axes``, summed in one order whatever other rows there are, so that every task sees the same coordinates."""
    y = np.zeros_like(x)
    for k in range(x.shape[1]):
        y += x[:, k, None] * axes[k]
    return y


def _apart(y: np.ndarray, a: np.ndarray, b: np.ndarray, dims: np.ndarray) -> np.ndarray:
    """Squared distances in some dimensions, summed in one order."""
    out = np.zeros(len(a))
    for k in dims:
        out += (y[a, k] - y[b, k]) ** 2
    return out


def valid_vectors(vectors: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, int, int]:
    """(id, x) as given, the number of dimensions (that of most vectors, the larger of two as frequent) and of rows."""
    kind = vectors.select(q(vec_col)).dtypes[0][1]
    x = q(vec_col) if kind == "array<float>" else q(vec_col).cast("array<double>")
    ok = vectors.select(q(id_col).cast("long").alias("id"), x.alias("x")).filter(F.col("id").isNotNull() & F.col("x").isNotNull())
    ok = ok.filter(~F.exists("x", lambda y: y.isNull() | F.isnan(y) | (F.abs(y) == float("inf"))) & F.exists("x", lambda y: y != 0))
    sizes = ok.groupBy(F.size("x").alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), F.desc("n")).limit(1).collect()
    dims, rows = (sizes[0]["n"], sizes[0]["rows"]) if sizes else (1, 0)
    ok = ok.filter(F.size("x") == dims)
    # vectors with an id of their own stay where they are
    again = join_side(ok.groupBy("id").agg(F.count("*").alias("rows")).filter("rows > 1").select("id"))
    one = ok.join(again, "id", "left_semi").groupBy("id").agg(F.min("x").alias("x"))
    return ok.join(again, "id", "left_anti").unionByName(one), dims, rows


def rotation(units: DataFrame, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvectors as columns, eigenvalues), greatest first, of the second moments over all vectors; each task sends
    one matrix of dims x dims."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, dims))
        for batch in lean(batches):
            x = _matrix(batch.column("x"), dims)
            total += x.T @ x
        yield pa.record_batch([pa.array(np.arange(dims)), pa.array(list(total))], names=["i", "row"])

    parts = units.select("x").mapInArrow(moments, "i bigint, row array<double>").groupBy("i").agg(F.array(*[F.sum(F.col("row")[k]) for k in range(dims)]).alias("row")).orderBy("i").collect()
    total = np.array([r["row"] for r in parts]) if parts else np.eye(dims)
    values, axes = np.linalg.eigh(total)
    return np.ascontiguousarray(axes[:, ::-1]), np.maximum(values[::-1], 1e-12)


def blocks(values: np.ndarray, size: int) -> list[np.ndarray]:
    """Dimensions dealt to blocks, the greatest first, each to the block with least variance that has room."""
    count = -(-len(values) // size)
    out, load = [[] for _ in range(count)], np.zeros(count)
    for k, x in enumerate(values):
        b = min((b for b in range(count) if len(out[b]) < size), key=lambda b: load[b])
        out[b].append(k)
        load[b] += x
    return [np.array(b) for b in out]


def cuts(y: np.ndarray, dims: np.ndarray, reach: float, cells: float) -> list[tuple]:
    """The nodes of a block's tree, (coordinate, cut, inner, outer), or (-1, cell, 0, 0) for a cell. Each cuts at the median
    of that coordinate which leaves the fewest points within reach beyond it, as long as a cut leaves some out of reach."""
    nodes: list[tuple] = []
    count = 0

    def grow(at: np.ndarray, cells: float) -> int:
        nonlocal count
        me, best = len(nodes), None
        nodes.append(())
        if cells > 1.5 and len(at) > 16:
            for c in dims:
                mu = float(np.median(y[at, c]))
                beyond = y[at, c] > mu
                visit = float(np.mean(beyond & (y[at, c] <= mu + reach)))
                if 0.1 < beyond.mean() < 0.9 and visit < 0.45 and (best is None or visit < best[0]):
                    best = visit, c, mu
        if best is None:
            nodes[me], count = (-1, count, 0, 0), count + 1
            return me
        _, c, mu = best
        inner = y[at, c] <= mu
        nodes[me] = (int(c), mu, grow(at[inner], cells / 2), grow(at[~inner], cells / 2))
        return me

    grow(np.arange(len(y)), cells)
    return nodes


def cells_of(nodes: list[tuple], y: np.ndarray, reach: float) -> Iterator[tuple[np.ndarray, int, bool]]:
    """(rows, cell, whether they live there): a row beyond a cut visits the inner side if it is within reach; a guest goes on
    into every side that is. So two rows within reach of each other meet in one cell, and one of them lives there."""
    slack = reach + _EPS
    stack = [(0, np.arange(len(y)), np.zeros(0, np.int64))]
    while stack:
        at, home, guest = stack.pop()
        c, mu, inner, outer = nodes[at]
        if c < 0:
            yield home, int(mu), True
            yield guest, int(mu), False
            continue
        h, g = y[home, c], y[guest, c]
        stack.append((inner, home[h <= mu], np.concatenate((guest[g <= mu + slack], home[(h > mu) & (h <= mu + slack)]))))
        stack.append((outer, home[h > mu], guest[g > mu - slack]))


def near_vectors(vectors: DataFrame, cosine: float = COSINE, block_dims: int = BLOCK_DIMS, id_col: str = "vec_id", vec_col: str = "embedding", cell: int = CELL) -> DataFrame:
    """(id, class_id, links) of every id: the least id of its class, which are the connected components of the pairs whose
    cosine is ``cosine`` at least, and the number of vectors that it is in such a pair with.

    - NULL vectors, vectors with a NULL, NaN or infinite part, of length 0, or of another number of dimensions than most:
      in no pair; their class is their own. NULL ids: left out.
    - Ties: a pair at the threshold itself counts, within 1e-9. Equal vectors are a pair, however many there are.
    - Repeated rows (same id): one vector, the least; no pair with itself, one row of the result.
    - Empty table: empty result. Extra columns: not read. Vectors may have any number of dimensions. Ids are integers, or
      strings of digits.
    - ``vectors`` is read several times; hand over a stored table.
    """
    units, dims, rows = valid_vectors(vectors, id_col, vec_col)
    axes, values = rotation(units, dims)
    parts = blocks(values, block_dims)
    share = np.array([values[p].sum() for p in parts])
    budget = (2.0 - 2.0 * cosine + 4 * _EPS) * share / share.sum() + 1e-12
    reach = np.sqrt(budget)
    some = units.filter(F.pmod(F.xxhash64("id"), F.lit(max(1, rows))) < SAMPLE).select("x").limit(2 * SAMPLE).toArrow()["x"].combine_chunks()
    y = _rotated(_matrix(some, dims), axes)
    trees = [cuts(y, p, float(reach[b]), min(rows / cell, SAMPLE / 64)) for b, p in enumerate(parts)]
    shared = units.sparkSession.sparkContext.broadcast((axes, parts, budget, reach, trees))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray, int, bool]]:
        axes, parts, _, reach, trees = shared.value
        for big in lean(batches):
            for at in range(0, big.num_rows, _CHUNK):
                batch = big.slice(at, _CHUNK)
                y = _rotated(_matrix(batch.column("x"), dims), axes)
                for b in range(len(parts)):
                    for who, c, home in cells_of(trees[b], y, float(reach[b])):
                        if len(who):
                            yield batch, b, who, c, home

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, b, who, c, home in placed(batches):
            n, rows = len(who), batch.take(pa.array(who))
            yield pa.record_batch([pa.array(np.full(n, b, np.int32)), pa.array(np.full(n, c, np.int32)), pa.array(np.full(n, home)), rows.column("id"), rows.column("x")], names=["block", "cell", "home", "id", "x"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], list[int]] = {}
        for _, b, who, c, home in placed(batches):
            total.setdefault((b, c), [0, 0])[not home] += len(who)
        yield pa.record_batch([pa.array([k[0] for k in total], pa.int32()), pa.array([k[1] for k in total], pa.int32()), *(pa.array([v[i] for v in total.values()], pa.int64()) for i in (0, 1))], names=["block", "cell", "h", "g"])

    def meet(t: pa.Table) -> pa.Table:
        axes, parts, budget, _, _ = shared.value
        t = t.combine_chunks().sort_by("id")
        b, u, v = (int(t[c][0].as_py()) for c in ("block", "u", "v"))
        x, ids = _matrix(t["x"].combine_chunks(), dims), t["id"].to_numpy()
        home = t["home"].to_numpy().astype(bool)
        left, right = sides(u, v, t["part"].to_numpy(), home)
        y = _rotated(x, axes)
        z = y[:, parts[b]].astype(np.float32)
        size, ones = (z * z).sum(1, keepdims=True), np.ones((len(z), 1), np.float32)
        one_side, other_side = np.hstack([-2 * z, size, ones]), np.hstack([z, ones, size])  # whose product is the squared distance
        most = np.float32(budget[b] + 1e-5)  # more than single precision errs by; what it lets through is verified

        def tiles() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            for group in (right[home[right]], right[~home[right]]):
                for j in range(0, len(group), 4096):
                    yours = np.ascontiguousarray(other_side[group[j : j + 4096]].T)
                    for i in range(0, len(left), 256):
                        mine = left[i : i + 256]
                        if u == v and home[group[j]] and group[min(j + 4095, len(group) - 1)] < mine[0]:
                            break
                        yield mine, group[j : j + 4096], one_side[mine] @ yours

        def pairs() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for mine, yours, d2 in tiles():
                hit = np.flatnonzero(d2 <= most)
                a, k = hit // len(yours), hit % len(yours)
                for at in range(0, len(a), _PAIRS):
                    one, two = mine[a[at : at + _PAIRS]], yours[k[at : at + _PAIRS]]
                    ok = ids[one] != ids[two]
                    if u == v:
                        ok &= ~home[two] | (one < two)
                    one, two = one[ok], two[ok]
                    ok = (x[one] * x[two]).sum(1) >= cosine - _EPS
                    one, two = one[ok], two[ok]
                    ok = _apart(y, one, two, parts[b]) <= budget[b]
                    for earlier in range(b):  # a block before this one has counted it
                        ok &= _apart(y, one, two, parts[earlier]) > budget[earlier]
                    if ok.any():
                        yield one[ok], two[ok]

        label, links = linked(len(ids), pairs())
        has = np.flatnonzero(links)
        out = pa.table({"id": pa.array(ids[has]), "root": pa.array(ids[label[has]]), "links": pa.array(links[has])})
        trim()
        return out

    counts = units.mapInArrow(counted, "block int, cell int, h bigint, g bigint").groupBy("block", "cell").agg(F.sum("h").alias("h"), F.sum("g").alias("g"))
    kind = units.select("x").dtypes[0][1]
    placed_rows = in_units(units.mapInArrow(spread, f"block int, cell int, home boolean, id bigint, x {kind}"), counts, ["block", "cell"], ["id"], cell)
    found = materialize(placed_rows.groupBy("block", "cell", "u", "v").applyInArrow(meet, "id bigint, root bigint, links bigint"))
    classes = components(found.filter("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b"))).select(F.col("a").alias("id"), F.col("b").alias("class_id"))
    degrees = found.groupBy("id").agg(F.sum("links").alias("links"))
    every = vectors.select(q(id_col).cast("long").alias("id")).filter("id is not null").distinct()
    return every.join(degrees, "id", "left").join(classes, "id", "left").select(F.col("id").alias(id_col), F.coalesce("class_id", "id").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))


def dedup_vectors(vectors: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``vectors`` without those that are not the first of their class; rows without an id stay. Cases as above."""
    gone = near_vectors(vectors, cosine, id_col=id_col, vec_col=vec_col).filter(q("class_id") != q(id_col)).select(q(id_col).alias("__gone"))
    return vectors.join(join_side(gone), q(id_col).cast("long") == F.col("__gone"), "left_anti")


SQL = f"""
WITH RECURSIVE p AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= {COSINE}
),
reach AS (SELECT vec_id, vec_id AS other FROM embeddings UNION SELECT r.vec_id, p.b FROM reach r JOIN p ON r.other = p.a)
SELECT r.vec_id, min(other) AS class_id, (SELECT count(*) FROM p WHERE p.a = r.vec_id) AS links FROM reach r GROUP BY r.vec_id
"""
