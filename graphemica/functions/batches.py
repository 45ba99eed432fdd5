"""Texts of an Arrow batch as one array of code points, and back."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of texts; NULL is empty."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32, len(texts) + 1, texts.offset * (8 if wide else 4)).astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    size = int(offsets[-1] - offsets[0])
    return np.frombuffer(texts.buffers()[2], np.uint8, size, int(offsets[0])) if size else np.zeros(0, np.uint8), offsets - offsets[0]


def points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all texts one after the other, where each text begins and the last one ends)."""
    data, offsets = raw(texts)
    code = np.frombuffer(data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(code) == len(data):
        return code, offsets
    upto = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    return code, upto[offsets]


def texts_of(code: np.ndarray, bounds: np.ndarray, null: pa.Array | None = None) -> pa.Array:
    """The texts of code points; NULL where ``null`` says so."""
    data = code.astype(np.uint32, copy=False).tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
    if len(data) == len(code):
        offsets = bounds
    else:
        size = 1 + (code > 0x7F).astype(np.int8) + (code > 0x7FF) + (code > 0xFFFF)
        offsets = np.concatenate(([0], np.cumsum(size, dtype=np.int64)))[bounds]
    out = pa.StringArray.from_buffers(len(bounds) - 1, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data))
    return out if null is None or not null.null_count else pc.if_else(pc.is_valid(null), out, pa.scalar(None, pa.string()))


#: Bytes of text that are worked on at once; the arrays made of them are many times as large.
_PIECE = 1 << 18


def pieces(batches: Iterator[pa.RecordBatch], *texts: int, size: int | None = None) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``size`` bytes of the columns ``texts``, or of a single row: what a worker holds does
    not grow with Arrow's batches. A batch without rows stays one."""
    for batch in batches:
        upto = np.zeros(batch.num_rows + 1, np.int64)
        for k in texts:
            upto += raw(batch.column(k))[1]
        at = 0
        while True:
            to = max(at + 1, int(np.searchsorted(upto, upto[at] + (size or _PIECE), "right")) - 1)
            yield batch.slice(at, to - at)
            at = to
            if at >= batch.num_rows:
                break


def stretches(texts: list[pa.Array], size: int | None = None) -> Iterator[list[pa.Array]]:
    """Of single texts that have as many characters each, the same stretches one after the other, of at most ``size`` bytes in all."""
    size = max(8, (size or _PIECE) // len(texts))  # so that any character fits
    data = [raw(text)[0] for text in texts]
    at = [0] * len(data)
    while at[0] < len(data[0]):
        begins = [np.flatnonzero((d[a : a + size] & 0xC0) != 0x80) for d, a in zip(data, at, strict=True)]
        n = min(len(b) - (a + size < len(d)) for d, a, b in zip(data, at, begins, strict=True))  # the last one may go on
        if n < 1:
            raise ValueError("a text is not UTF-8")
        to = [a + int(b[n]) if n < len(b) else len(d) for d, a, b in zip(data, at, begins, strict=True)]
        yield [pa.StringArray.from_buffers(1, pa.py_buffer(np.array([0, z - a], np.int32)), pa.py_buffer(d[a:z])) for d, a, z in zip(data, at, to, strict=True)]
        at = to


def _in_stretches(batch: pa.RecordBatch, *texts: int) -> Iterator[pa.RecordBatch]:
    """One of ``pieces``; of a single row that is longer, the stretches of its texts, none if they are of unequal length."""
    long = [pc.fill_null(batch.column(k), "") for k in texts] if batch.num_rows == 1 else []
    if sum(len(raw(text)[0]) for text in long) <= _PIECE:
        yield batch
    elif len({pc.utf8_length(text)[0].as_py() for text in long}) == 1:
        for part in stretches(long):
            columns = batch.columns
            for k, text in zip(texts, part, strict=True):
                columns[k] = text
            yield pa.record_batch(columns, names=batch.schema.names)


def in_pieces(f: Callable[..., pa.Array], *texts: pa.Array) -> pa.Array:
    """What ``f`` makes of columns of texts row by row, worked out piece by piece."""
    whole = pa.record_batch(list(texts), names=[str(k) for k in range(len(texts))])
    return pa.concat_arrays([f(*piece.columns) for piece in pieces(iter([whole]), *range(len(texts)))])


def counted(rows: DataFrame, text_cols: list[str], names: list[str], *by: str) -> DataFrame:
    """(by..., names..., n): how often characters stand together at the same place of the columns ``text_cols``, of those rows
    whose texts are of equal length. They are counted within each batch, so what moves are small tables, and in pieces of it,
    also of a single long text."""
    schema = rows.select(*by).schema
    for name in names:
        schema = schema.add(name, "string")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = range(len(by), len(by) + len(names))
        for batch in (part for piece in pieces(batches, *texts) for part in _in_stretches(piece, *texts)):
            found = [points(batch.column(len(by) + k)) for k in range(len(names))]
            sizes = [np.diff(bounds) for _, bounds in found]
            same = np.all([s == sizes[0] for s in sizes], 0) & (sizes[0] > 0)
            row = np.repeat(np.arange(batch.num_rows), np.where(same, sizes[0], 0))
            codes = [code if same.all() or not len(code) else code[np.repeat(same, size)] for (code, _), size in zip(found, sizes, strict=True)]
            at = _group_ids(batch, len(by))
            key = at[row]
            letters = []
            for code in codes:  # characters by their rank, so that a key of all of them fits into 64 bits
                seen = np.flatnonzero(np.bincount(code, minlength=1)) if len(code) else np.zeros(0, np.int64)
                rank = np.zeros(int(seen[-1]) + 1 if len(seen) else 1, np.int64)
                rank[seen] = np.arange(len(seen))
                letters.append(seen)
                key = key * max(1, len(seen)) + rank[code]
            span = int(key.max(initial=-1)) + 1
            if span <= max(1 << 20, 4 * len(key)):
                n = np.bincount(key, minlength=1)
                key = np.flatnonzero(n)
                n = n[key]
            else:
                key, n = np.unique(key, return_counts=True)
            columns = []
            for seen in reversed(letters):
                columns.append(pa.array([chr(c) for c in seen.tolist()], pa.string()).take(pa.array(key % max(1, len(seen)))))
                key = key // max(1, len(seen))
            first = [batch.column(k).take(pa.array(_first_of(at, key))) for k in range(len(by))] if by else []
            yield pa.record_batch([*first, *reversed(columns), pa.array(n.astype(np.int64))], names=[*by, *names, "n"])

    return rows.select(*by, *text_cols).mapInArrow(each, schema.add("n", "long")).groupBy(*by, *names).agg(F.sum("n").alias("n"))


def _group_ids(batch: pa.RecordBatch, by: int) -> np.ndarray:
    """Of each row the number of its group, by the first ``by`` columns."""
    at = np.zeros(batch.num_rows, np.int64)
    for k in range(by):
        one = batch.column(k).dictionary_encode("encode")
        at = np.unique(at * max(1, len(one.dictionary)) + one.indices.to_numpy(zero_copy_only=False), return_inverse=True)[1].reshape(-1)
    return at


def _first_of(at: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """A row of each group."""
    where = np.zeros(int(at.max(initial=0)) + 1, np.int64)
    where[at[::-1]] = np.arange(len(at))[::-1]
    return where[groups]
