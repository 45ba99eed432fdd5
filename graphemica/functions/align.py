"""Error rates and alignments of two texts.

They are worked out in Arrow batches, many pairs at a time. The table of distances is not filled: for each score and diagonal it
is kept how far one gets at that score, runs of equal characters are passed eight bytes at a time, and diagonals from which the
end cannot be reached are left out. So work and memory follow the length and the square of the distance, not the product of the
lengths; where texts differ by insertions only, or by deletions only, they follow their sum. Every cell's distance follows from
these places, so the way back knows its ties as it would in the full table. Of very many places only some scores are kept, and
the rest is worked out again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import _first_of, _group_ids, counted, points

MATCH, SUB, DEL, INS = "match", "sub", "del", "ins"
STEPS = "array<struct<i:int,j:int,op:string,a:string,b:string>>"
PARTS = "array<struct<src:string,tgt:string>>"
_COUNTS = "struct<match:int,sub:int,del:int,ins:int>"


def positional_errors(pred: Column, truth: Column) -> Column:
    """The number of places at which two texts of equal length differ; NULL if their lengths differ."""
    differ = F.zip_with(F.split(pred, ""), F.split(truth, ""), lambda a, b: F.when(a == b, 0).otherwise(1))
    return F.when(F.length(pred) == F.length(truth), F.aggregate(differ, F.lit(0), lambda n, x: n + x))


def positional_cer(pred: Column, truth: Column, strict: bool = False) -> Column:
    """The share of places that differ; NULL for empty texts; unequal lengths give NULL, or an error if ``strict``."""
    rate = F.try_divide(positional_errors(pred, truth), F.length(truth))
    return F.when(F.length(pred) != F.length(truth), F.raise_error(F.lit("texts of unequal length")).cast("double")).otherwise(rate) if strict else rate


def within(a: Column, b: Column, most: Column) -> Column:
    """Edit distance if it is ``most`` (an integer) at most, else -1; NULL if any of them is NULL."""

    @F.arrow_udf("int")
    def each(xs: pa.Array, ys: pa.Array, limits: pa.Array) -> pa.Array:
        return _distances(xs, ys, limits)

    return each(a, b, F.greatest(most.cast("long"), F.when(most.isNotNull(), F.lit(0).cast("long"))))


def edit_distance(a: Column, b: Column) -> Column:
    """NULL if either is NULL."""

    @F.arrow_udf("int")
    def each(xs: pa.Array, ys: pa.Array) -> pa.Array:
        return _distances(xs, ys, None)

    return each(a, b)


def cer(a: Column, b: Column, normalize: bool = False) -> Column:
    """Edit distance; normalised by the longer length, and then 1 where both are empty."""
    d = edit_distance(a, b)
    if not normalize:
        return d
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(d / longest)


#: Places kept at a time, in bytes; pairs and characters of a group; pairs are looked at in pieces of so many characters.
_CELLS, _PAIRS, _GROUP, _PIECE = 1 << 25, 4096, 1 << 20, 1 << 22
_OPS = (MATCH, SUB, DEL, INS)
_SUB, _DEL, _INS = 1, 2, 3
_NOWHERE = -(1 << 28)


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.int32)


def _packed(texts: list[np.ndarray], kind: type, end: int) -> tuple[np.ndarray, np.ndarray]:
    """(the 8 bytes from each place on, where each text begins); after a text there are 8 bytes of marks."""
    gap = 8 // np.dtype(kind).itemsize
    size = np.array([len(t) for t in texts])
    begin = np.concatenate(([0], np.cumsum(size + gap)))[:-1]
    flat = np.full(int(size.sum()) + gap * (len(texts) + 1), end, kind)
    flat[np.arange(int(size.sum())) + np.repeat(begin - (np.cumsum(size) - size), size)] = np.concatenate(texts)
    return np.ndarray(len(flat) - gap + 1, np.uint64, flat, strides=flat.strides).copy(), begin


class _Waves:
    """Of some pairs, score by score, how far along each diagonal one gets at that score: a distance at most s is what the
    cells up to that place have. A diagonal k (column less row) is at column k - s + 2 * slack of the table of score s.

    No text of ``xs`` is longer than its one of ``ys``. Paths of cost up to the difference of the lengths plus 2 * ``slack``
    are all within the table."""

    def __init__(self, xs: list[np.ndarray], ys: list[np.ndarray], slack: int, band: int | None):
        self.m, self.n = (np.array([len(t) for t in ts], np.int32) for ts in (xs, ys))
        self.slack, self.band, self.apart = slack, band, self.n - self.m
        self.most = int(self.apart.max()) + 2 * slack
        top = max(int(t.max(initial=0)) for t in (*xs, *ys))
        kind = np.uint8 if top < 0xFE else np.uint16 if top < 0xFFFE else np.uint32
        self.x, self.begin_x = _packed(xs, kind, np.iinfo(kind).max)
        self.y, self.begin_y = _packed(ys, kind, np.iinfo(kind).max - 1)
        self.step = 8 // np.dtype(kind).itemsize
        self.shift = 3 + int(np.log2(np.dtype(kind).itemsize))

    def _extended(self, far: np.ndarray, k: np.ndarray) -> np.ndarray:
        """As far as both texts are equal, 8 bytes at a time."""
        flat = far.ravel()
        at = np.flatnonzero(flat >= 0)
        row, column = np.divmod(at, far.shape[1])
        p = self.begin_x[row] + flat[at]
        q = self.begin_y[row] + flat[at] + k[column]
        while len(at):
            differ = self.x[p] ^ self.y[q]
            flat[at] += (np.bitwise_count(~differ & (differ - np.uint64(1))) >> self.shift).astype(np.int32)
            more = np.flatnonzero(differ == 0)
            at, p, q = at[more], p[more] + self.step, q[more] + self.step
        return flat.reshape(far.shape)

    def first(self) -> np.ndarray:
        far = np.full((len(self.m), 2 * self.slack + 3), _NOWHERE, np.int32)
        far[:, 2 * self.slack : 2 * self.slack + 1] = self._extended(np.zeros((len(self.m), 1), np.int32), np.zeros(1, np.int32))
        return far

    def following(self, s: int, before: np.ndarray) -> np.ndarray:
        """The table of score s from that of s - 1; only diagonals from which the last cell can still be reached."""
        w = 2 * self.slack
        low, high = max(0, w - 2 * s), min(w, 2 * (self.most - s)) + 1
        k = np.arange(low, high, dtype=np.int32) + np.int32(s - w)
        far = np.maximum(np.maximum(before[:, low + 1 : high + 1], before[:, low + 2 : high + 2]) + 1, before[:, low:high])
        far = np.minimum(np.minimum(far, self.m[:, None]), self.n[:, None] - k)
        out = (far < 0) | (far + k < 0)
        if self.band is not None:
            out |= np.abs(k) > self.band
        far[out] = _NOWHERE
        table = np.full_like(before, _NOWHERE)
        table[:, low:high] = self._extended(far, k)
        return table

    def distances(self, block: int | None = None) -> tuple[np.ndarray, dict[int, np.ndarray]]:
        """(distance, -1 where it is beyond the table; every table of a score that ``block`` divides)."""
        distance, kept = np.full(len(self.m), -1, np.int64), {}
        for s in range(self.most + 1):
            table = self.following(s, table) if s else self.first()
            if block and s % block == 0:
                kept[s] = table
            last = self.apart - s + 2 * self.slack
            open_ = np.flatnonzero((distance < 0) & (last >= 0) & (last <= 2 * self.slack))
            distance[open_[table[open_, last[open_]] == self.m[open_]]] = s
            if s >= self.most or (distance >= 0).all():
                break
        return distance, kept

    def back(self, distance: np.ndarray, kept: dict[int, np.ndarray], block: int, gap_first: bool, turned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(operation that costs, matches after it) by pair and score; the matches at score 0 come before all of them."""
        top = int(distance.max(initial=0))
        ops, runs = np.zeros((len(self.m), top + 1), np.uint8), np.zeros((len(self.m), top + 1), np.int32)
        i, k, tables = self.m.copy(), self.apart.copy(), {}
        for s in range(top, 0, -1):
            if s - 1 not in tables:
                begin = (s - 1) // block * block
                tables = {begin: kept[begin]}
                for z in range(begin + 1, s):
                    tables[z] = self.following(z, tables[z - 1])
            table, who = tables[s - 1], np.flatnonzero(distance >= s)
            at = k[who] - (s - 1) + 2 * self.slack
            diagonal, up, left = table[who, at] + 1, table[who, at + 1] + 1, table[who, at - 1]
            # a cell further on has no cheaper neighbour, so it is a match
            stop = np.minimum(i[who], np.maximum(np.maximum(diagonal, up), left))
            runs[who, s], i[who] = i[who] - stop, stop
            gap = np.where((up >= stop) & ~(turned[who] & (left >= stop)), _DEL, _INS)
            has_gap = (up >= stop) | (left >= stop)
            op = np.where(has_gap, gap, _SUB) if gap_first else np.where(diagonal >= stop, _SUB, gap)
            ops[who, s] = op
            i[who] -= op != _INS
            k[who] += (op == _DEL).astype(np.int32) - (op == _INS)
        runs[:, 0] = i
        flip = turned[:, None] & (ops >= _DEL)
        return np.where(flip, _DEL + _INS - ops, ops), runs


def _at_least(xs: list[np.ndarray], ys: list[np.ndarray]) -> np.ndarray:
    """No distance is less than the characters that only one of the texts has, counted in 128 classes."""
    def classes(ts: list[np.ndarray]) -> np.ndarray:
        row = np.repeat(np.arange(len(ts)) * 128, [len(t) for t in ts])
        return np.bincount(row + (np.concatenate(ts) & 127), minlength=128 * len(ts)).reshape(-1, 128)

    more = classes(xs) - classes(ys)
    return np.maximum(np.maximum(more, 0).sum(1), np.maximum(-more, 0).sum(1))


def _solved(xs: list[np.ndarray], ys: list[np.ndarray], first: str | None, band: int | None = None, most: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None, np.ndarray | None]]:
    """(pairs, distances, operations, matches) in groups of pairs of like distance; ``first=None``: distances only. A pair whose
    distance is beyond ``most`` is in none of them."""
    size = np.array([len(x) + len(y) for x, y in zip(xs, ys, strict=True)], np.int64)
    piece = np.cumsum(size) // _PIECE
    cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), len(xs)]
    for a, z in zip(cuts[:-1], cuts[1:], strict=True):
        if a < z:
            yield from _solved_piece(a, xs[a:z], ys[a:z], size[a:z], first, band, None if most is None else most[a:z])


def _solved_piece(start, xs, ys, size, first, band, most):
    turned = np.array([len(x) > len(y) for x, y in zip(xs, ys, strict=True)])
    low = [y if t else x for x, y, t in zip(xs, ys, turned.tolist(), strict=True)]
    high = [x if t else y for x, y, t in zip(xs, ys, turned.tolist(), strict=True)]
    shorter = np.array([len(x) for x in low])
    apart = np.array([len(y) for y in high]) - shorter
    least = np.maximum(apart, _at_least(low, high))
    enough = (shorter + 1) // 2  # so much slack holds any path
    slack = np.minimum((least - apart + 1) // 2, enough)
    left = np.arange(len(xs))
    if most is not None:
        left = left[least <= most]
        enough = np.minimum(enough, np.maximum(most - apart + 1, 0) // 2)
    while len(left):
        step = 1 << np.maximum(np.log2(np.maximum(slack[left], 1)).astype(np.int64) - 2, 0)
        round_up = -(-slack[left] // step) * step  # few different tables
        order = np.lexsort((apart[left], round_up))
        left, round_up = left[order], round_up[order]
        again, at = [], 0
        while at < len(left):
            e, to, chars, width = int(round_up[at]), at, 0, 2 * int(round_up[at]) + 3
            while to < len(left) and to - at < _PAIRS and round_up[to] == e:
                k, count = left[to], to - at + 1
                chars += int(size[k])
                rows = (int(apart[k]) + 2 * e + 1) * 4 if first else 8
                if to > at and (chars > _GROUP or count * width * rows > _CELLS or count * width > 1 << 17):
                    break
                to += 1
            mine = left[at:to]
            at = to
            waves = _Waves([low[k] for k in mine], [high[k] for k in mine], e, band)
            whole = len(mine) * width * (waves.most + 1) * 4 <= _CELLS
            block = 1 if whole else max(1, int(np.sqrt(waves.most)))
            distance, kept = waves.distances(block if first else None)
            found = distance >= 0
            over = mine[~found]
            if most is not None:
                over = over[e < enough[over]]
                distance = np.where(found & (distance <= most[mine]), distance, -1)
            elif (enough[over] <= e).any():
                raise ValueError("no path within the band")
            slack[over] = np.minimum(np.maximum(2 * e, e + 4), enough[over])
            again.append(over)
            ok = np.flatnonzero(distance >= 0)
            if len(ok):
                ops, runs = waves.back(distance, kept, block, first == "gap", turned[mine]) if first else (None, None)
                yield mine[ok] + start, distance[ok], *((ops[ok], runs[ok]) if first else (None, None))
        left = np.concatenate(again)


def paths(xs: list[np.ndarray], ys: list[np.ndarray], first: str, band: int | None = None) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, operation) arrays for each pair, from the beginning on: i and j the characters before the step, operations as
    places in _OPS."""
    out: list = [None] * len(xs)
    for mine, distance, ops, runs in _solved(xs, ys, first, None if band is None else max(1, band)):
        # of each score its operation, and then the matches
        count = np.zeros((len(mine), 2 * ops.shape[1]), np.int32)
        count[:, ::2] = np.arange(ops.shape[1]) <= distance[:, None]
        count[:, 0] = 0
        count[:, 1::2] = runs
        kind = np.zeros(count.shape, np.uint8)
        kind[:, ::2] = ops
        op = np.repeat(kind.ravel(), count.ravel())
        ends = np.cumsum(count.sum(1))
        for k, z, size in zip(mine.tolist(), ends.tolist(), count.sum(1).tolist(), strict=True):
            o = op[z - size : z]
            x, y = o != _INS, o != _DEL
            out[k] = (np.cumsum(x) - x, np.cumsum(y) - y, o)
    return out


def edit_distances(xs: list[np.ndarray], ys: list[np.ndarray], most: np.ndarray | None = None) -> np.ndarray:
    """Of each pair, exactly; -1 where it is beyond ``most``. Memory follows the distance."""
    out = np.full(len(xs), -1, np.int64)
    for mine, distance, _, _ in _solved(xs, ys, None, most=most):
        out[mine] = distance
    return out


def backtrace(a: str, b: str, first: str, band: int | None = None) -> list[tuple[int, int, str]]:
    """(i, j, operation) from the beginning on, i and j the characters of ``a`` and ``b`` before the step.

    ``first="diagonal"``: on the way back the least neighbouring distance decides, the diagonal one if it is no greater,
    then a deletion. ``first="gap"``: of the cheapest steps a deletion, then an insertion, then the diagonal.
    """
    (i, j, op), = paths([codes(a)], [codes(b)], first, band)
    return [(x, y, _OPS[o]) for x, y, o in zip(i.tolist(), j.tolist(), op.tolist(), strict=True)]


def _usable(xs: pa.Array, ys: pa.Array, band: int | None, limits: pa.Array | None = None) -> tuple[list[int], list[np.ndarray], list[np.ndarray]]:
    """The rows that have an alignment, and their code points."""
    (x, begin_x), (y, begin_y) = points(xs), points(ys)
    there = np.ones(len(xs), bool)
    for column in (xs, ys, *([] if limits is None else [limits])):
        there &= column.is_valid().to_numpy(zero_copy_only=False)
    if band is not None:
        there &= np.abs(np.diff(begin_x) - np.diff(begin_y)) <= band
    rows = np.flatnonzero(there)
    cut = lambda code, begin: [code[a:z] for a, z in zip(begin[rows].tolist(), begin[rows + 1].tolist(), strict=True)]
    return rows.tolist(), cut(x.view(np.int32), begin_x), cut(y.view(np.int32), begin_y)


def _distances(xs: pa.Array, ys: pa.Array, limits: pa.Array | None) -> pa.Array:
    rows, a, b = _usable(xs, ys, None, limits)
    out, missing = np.zeros(len(xs), np.int32), np.ones(len(xs), bool)
    out[rows] = edit_distances(a, b, None if limits is None else _numbers(limits)[rows])
    missing[rows] = False
    return pa.array(out, mask=missing)


def _numbers(limits: pa.Array) -> np.ndarray:
    return limits.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def _letters(points: np.ndarray, there: np.ndarray) -> pa.Array:
    """Characters by code point, the empty text where there is none."""
    known, at = np.unique(np.where(there, points, -1), return_inverse=True)
    return pa.array(["" if p < 0 else chr(p) for p in known.tolist()], pa.string()).take(pa.array(at.reshape(-1)))


def _listed(count: int, rows: list[int], sizes: list[int], values: pa.Array) -> pa.Array:
    """A list for each of ``count`` rows: pieces of ``values`` for ``rows``, NULL for the others."""
    size = np.zeros(count, np.int64)
    size[rows] = sizes
    missing = np.ones(count, bool)
    missing[rows] = False
    offsets = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), values, mask=pa.array(missing))


def align(pred: Column, truth: Column, first: str = "diagonal", band: int | None = None) -> Column:
    """The steps from ``pred`` to ``truth`` as an array of (i, j, op, a, b); NULL if either is NULL, or if the lengths
    differ by more than ``band``."""

    @F.arrow_udf(STEPS)
    def each(xs: pa.Array, ys: pa.Array) -> pa.Array:
        rows, a, b = _usable(xs, ys, band)
        found = paths(a, b, first, band)
        i, j, op = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(3))
        pick = lambda texts, k, gap: np.concatenate([t[np.minimum(f[k], len(t) - 1)] if len(t) else np.zeros(len(f[k]), np.int32) for t, f in zip(texts, found, strict=True)]) if found else np.zeros(0, np.int32)
        left, right = _letters(pick(a, 0, _INS), op != _INS), _letters(pick(b, 1, _DEL), op != _DEL)
        steps = pa.StructArray.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(_OPS).take(pa.array(op.astype(np.int8))), left, right], ["i", "j", "op", "a", "b"])
        return _listed(len(xs), rows, [len(f[2]) for f in found], steps)

    return each(pred, truth)


def edit_ops(pred: Column, truth: Column, first: str = "diagonal", most: Column | None = None) -> Column:
    """How many steps of each kind ``align`` has: a struct of match, sub, del and ins; NULL if either is NULL, or if they are
    further apart than ``most`` (an integer) where it is given."""

    def counts(xs: pa.Array, ys: pa.Array, limits: pa.Array | None) -> pa.Array:
        rows, a, b = _usable(xs, ys, None, limits)
        at, out, missing = np.array(rows, np.int64), np.zeros((len(xs), 4), np.int32), np.ones(len(xs), bool)
        for mine, _, ops, runs in _solved(a, b, first, None, None if limits is None else _numbers(limits)[rows]):
            for k in (_SUB, _DEL, _INS):
                out[at[mine], k] = (ops == k).sum(1)
            out[at[mine], 0] = runs.sum(1)
            missing[at[mine]] = False
        return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(out[:, k])) for k in range(4)], list(_OPS), mask=pa.array(missing))

    if most is None:

        @F.arrow_udf(_COUNTS)
        def each(xs: pa.Array, ys: pa.Array) -> pa.Array:
            return counts(xs, ys, None)

        return each(pred, truth)

    @F.arrow_udf(_COUNTS)
    def near(xs: pa.Array, ys: pa.Array, limits: pa.Array) -> pa.Array:
        return counts(xs, ys, limits)

    return near(pred, truth, most.cast("long"))


def op_counts(steps: Column) -> dict[str, Column]:
    def count(op: str) -> Column:
        return F.size(F.filter(steps, lambda s: s["op"] == op))

    return {op: count(op) for op in (MATCH, SUB, DEL, INS)}


def substitution_only(steps: Column) -> Column:
    """``pred`` without its deletions and with what ``truth`` inserts: as long as ``truth``, wrong only by substitutions."""
    kept = F.filter(steps, lambda s: s["op"] != DEL)
    return F.array_join(F.transform(kept, lambda s: F.when(s["op"] == INS, s["b"]).otherwise(s["a"])), "")


def substituted(pred: Column, truth: Column) -> Column:
    """What ``substitution_only`` makes of the steps from ``pred`` to ``truth``, without a row or a struct a step: the truth with
    the characters that stand in ``pred`` where it is wrong. NULL if either is NULL."""

    @F.arrow_udf("string")
    def each(xs: pa.Array, ys: pa.Array) -> pa.Array:
        rows, a, b = _usable(xs, ys, None)
        out: list = [None] * len(xs)
        for k, x, y, (i, j, op) in zip(rows, a, b, paths(a, b, "diagonal"), strict=True):
            wrong, made = op == _SUB, y.copy()
            made[j[wrong]] = x[i[wrong]]
            out[k] = made.tobytes().decode("utf-32-le", "surrogatepass")
        return pa.array(out, pa.string())

    return each(pred, truth)


def align_substrings(a: Column, b: Column, band: int | None = None) -> Column:
    """For each character of ``a`` its piece of ``b``: matched or substituted, with the insertions after it; insertions
    before the first go to the first. NULL where ``a`` is empty, or where the lengths differ by more than a given ``band``,
    which no path leaves then."""

    @F.arrow_udf(PARTS)
    def each(xs: pa.Array, ys: pa.Array) -> pa.Array:
        rows, a, b = _usable(xs, ys, band)
        some = [k for k, x in enumerate(a) if len(x)]
        rows, a, b = ([v[k] for k in some] for v in (rows, a, b))
        src, tgt = [], []
        for x, y, (i, _, op) in zip(a, b, paths(a, b, "gap", band), strict=True):
            # a deletion takes nothing of y, every other step one character, in order
            owner = np.maximum(np.where(op == _INS, i - 1, i), 0)[op != _DEL]
            cuts = np.searchsorted(owner, np.arange(len(x) + 1))
            text = y.tobytes().decode("utf-32-le", "surrogatepass")
            src += list(x.tobytes().decode("utf-32-le", "surrogatepass"))
            tgt += [text[s:z] for s, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        parts = pa.StructArray.from_arrays([pa.array(src, pa.string()), pa.array(tgt, pa.string())], ["src", "tgt"])
        return _listed(len(xs), rows, [len(x) for x in a], parts)

    return each(a, b)


def confusions(aligned: DataFrame, steps_col: str = "steps", *by: str) -> DataFrame:
    """confusion(by..., src_chr, tgt_chr, n): insertions have src "", deletions tgt ""."""
    rows = aligned.select(*by, F.explode(steps_col).alias("s"))
    return rows.groupBy(*by, F.col("s.a").alias("src_chr"), F.col("s.b").alias("tgt_chr")).agg(F.count("*").alias("n"))


def edit_confusions(pairs: DataFrame, *by: str, src: str = "src", tgt: str = "tgt") -> DataFrame:
    """``confusions`` of the steps from ``src`` to ``tgt``, counted batch by batch: what moves are small tables."""
    schema = pairs.select(*by).schema.add("src_chr", "string").add("tgt_chr", "string").add("n", "long")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, a, b = _usable(batch.column(len(by)), batch.column(len(by) + 1), None)
            group = _group_ids(batch, len(by))
            first = np.flatnonzero(np.diff(np.concatenate(([-1], np.cumsum([len(x) + len(y) for x, y in zip(a, b, strict=True)]) // _GROUP))))
            totals: dict[int, int] = {}
            for s, z in zip(first.tolist(), [*first[1:].tolist(), len(rows)], strict=True):
                left, right, who = [], [], []
                for k, x, y, (i, j, op) in zip(rows[s:z], a[s:z], b[s:z], paths(a[s:z], b[s:z], "diagonal"), strict=True):
                    left.append(np.where(op == _INS, 0, np.append(x, 0)[i].astype(np.int64) + 1))
                    right.append(np.where(op == _DEL, 0, np.append(y, 0)[j].astype(np.int64) + 1))
                    who.append(np.full(len(op), group[k]))
                key = (np.concatenate(who) << 42) | (np.concatenate(left) << 21) | np.concatenate(right)
                for k, n in zip(*(v.tolist() for v in np.unique(key, return_counts=True)), strict=True):
                    totals[k] = totals.get(k, 0) + n
            key, n = np.array(list(totals), np.int64), np.array(list(totals.values()), np.int64)
            letter = lambda c: pa.array(["" if x == 0 else chr(x - 1) for x in (c & 0x1FFFFF).tolist()], pa.string())
            where = pa.array(_first_of(group, key >> 42))
            yield pa.record_batch([*(batch.column(k).take(where) for k in range(len(by))), letter(key >> 21), letter(key), pa.array(n)], names=schema.names)

    return pairs.select(*by, src, tgt).mapInArrow(each, schema).groupBy(*by, "src_chr", "tgt_chr").agg(F.sum("n").alias("n"))


def positional_confusions(pairs: DataFrame, src: str = "src", tgt: str = "tgt") -> DataFrame:
    """confusion(src_chr, tgt_chr, n) of pairs of equal length, counted batch by batch; other pairs are left out."""
    return counted(pairs, [src, tgt], ["src_chr", "tgt_chr"])


def token_distance(a: Column, b: Column) -> Column:
    """Edit distance of two arrays of tokens, of any length; NULL if either is NULL."""

    @F.arrow_udf("int")
    def each(xs: pa.Array, ys: pa.Array) -> pa.Array:
        there = xs.is_valid().to_numpy(zero_copy_only=False) & ys.is_valid().to_numpy(zero_copy_only=False)
        rows = np.flatnonzero(there)
        xs, ys = xs.take(pa.array(rows)), ys.take(pa.array(rows))
        tokens = pa.concat_arrays([xs.flatten(), ys.flatten()]).dictionary_encode("encode").indices.to_numpy().astype(np.int32)
        cut = lambda lists, from_: np.split(tokens[from_ : from_ + len(lists.flatten())], np.cumsum(lists.value_lengths().to_numpy())[:-1]) if len(lists) else []
        out = np.zeros(len(there), np.int32)
        out[rows] = edit_distances(cut(xs, 0), cut(ys, len(xs.flatten())))
        return pa.array(out, mask=~there)

    return each(a, b)


def matches(a: Column, b: Column) -> Column:
    """The number of places at which two texts of equal length are the same; 0 if their lengths differ, NULL if either is NULL."""

    @F.arrow_udf("int")
    def each(xs: pa.Array, ys: pa.Array) -> pa.Array:
        rows, left, right = _usable(xs, ys, 0)
        out = np.zeros(len(xs), np.int32)
        out[rows] = [int((x == y).sum()) for x, y in zip(left, right, strict=True)]
        return pa.array(out, mask=~(xs.is_valid().to_numpy(zero_copy_only=False) & ys.is_valid().to_numpy(zero_copy_only=False)))

    return each(a, b)


# --- presentation ---------------------------------------------------------------------------------------------------


def render(steps: Column) -> Column:
    """The alignment as ANSI text: matches plain, substitutions yellow, deletions red, insertions green."""
    colour = lambda code, x: F.concat(F.lit(f"\x1b[{code}m"), x, F.lit("\x1b[0m"))
    return F.array_join(F.transform(steps, lambda s: F.when(s["op"] == MATCH, s["a"]).when(s["op"] == SUB, colour(33, s["b"])).when(s["op"] == DEL, colour(31, s["a"])).otherwise(colour(32, s["b"]))), "")


def render_errors(pred: Column, truth: Column) -> Column:
    """``pred`` as ANSI text, right characters green and wrong ones red; for texts of equal length."""
    pair = F.zip_with(F.split(pred, ""), F.split(truth, ""), lambda a, b: F.concat(F.when(a == b, F.lit("\x1b[32m")).otherwise(F.lit("\x1b[31m")), a, F.lit("\x1b[0m")))
    return F.array_join(pair, "")
