"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import functools
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only when its stored Parquet files are at most this large.
BROADCAST_BYTES = 8 << 20
#: Bytes of text that one vectorised pass over a batch holds.
CHUNK_BYTES = 1 << 20

_P = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *bases: str) -> list[str]:
    """Column names built on ``bases`` that do not clash with a column of ``df`` in any letter case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for base in bases:
        name = f"__{base}"
        while name in taken:
            name += "_"
        taken.add(name)
        out.append(name)
    return out


def q(name: str) -> Column:
    """The column of exactly this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


@functools.cache
def _own_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="graphemica-")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``. Where it is unset, a session on one machine gets a folder
    of its own; on a cluster it is an error, as no folder of the driver's is there for the executors."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    if re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        return _own_dir()
    raise ValueError("set spark.checkpoint.dir to a folder that all executors share")


def materialize(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read again: its lineage is cut and executors may be lost. Tables lie in a
    folder of the application, see ``clear``."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/graphemica/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._graphemica_path = path
    return out


def clear(spark: SparkSession) -> None:
    """Delete this application's intermediate tables, once its results are written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/graphemica/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def discard(df: DataFrame) -> None:
    """Delete the files behind a ``materialize``d table that nothing reads any more."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._graphemica_path)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def stored_bytes(df: DataFrame) -> int:
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._graphemica_path)
    return path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).getContentSummary(path).getLength()


def join_side(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` materialised, and marked for broadcast only if it turned out small; else joined by shuffle."""
    out = materialize(df)
    return F.broadcast(out) if stored_bytes(out) <= limit else out


def hash_pair(c: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes with different seeds, together a 128-bit key."""
    return F.xxhash64(F.lit(1), c), F.xxhash64(F.lit(2), c)


# --- vectorised words -------------------------------------------------------------------------------------------

_WORD = np.zeros(256, bool)
_WORD[[*range(ord("0"), ord("9") + 1), *range(ord("a"), ord("z") + 1)]] = True
_WORD[128:] = True


_kept_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers, at least, of an odd number and of its inverse modulo 2**64; a worker keeps one pair."""
    if not _kept_powers or len(_kept_powers[0]) < n:
        size = 1 << max(20, (n - 1).bit_length())
        with np.errstate(over="ignore"):
            up, down = (np.full(size, x, np.uint64) for x in (_P, pow(_P, -1, 1 << 64)))
            up[0] = down[0] = 1
            _kept_powers[:] = np.cumprod(up), np.cumprod(down)
    return _kept_powers[0], _kept_powers[1]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        return x


class Words:
    """The words of some texts: maximal runs of ASCII letters and digits and of non-ASCII characters, in lower case.

    hash: 64 bits a word; doc: index of its text; start, end: its bytes within ``data``; first: for text i its words
    are first[i]:first[i+1]; data: all texts' bytes in lower case; begin: where each text begins in ``data``.
    """

    def __init__(self, texts: pa.Array):
        low = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
        offsets = np.frombuffer(low.buffers()[1], np.int64, len(low) + 1, low.offset * 8)
        base, size = int(offsets[0]), int(offsets[-1] - offsets[0])
        raw = low.buffers()[2]
        self.data = np.frombuffer(raw, np.uint8, size, base) if size else np.zeros(0, np.uint8)
        self.begin = offsets - base
        inside = _WORD[self.data]
        cut = np.zeros(size + 1, bool)
        cut[self.begin] = True
        before = np.concatenate(([False], inside[:-1])) if size else inside
        after = np.concatenate((inside[1:], [False])) if size else inside
        self.start = np.flatnonzero(inside & (~before | cut[:-1]))
        self.end = np.flatnonzero(inside & (~after | cut[1:])) + 1
        up, down = powers(size + 1)
        with np.errstate(over="ignore"):
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * up[:size], dtype=np.uint64)))
            self.hash = mix64((total[self.end] - total[self.start]) * down[self.start])
        self.first = np.searchsorted(self.start, self.begin)
        self.doc = np.repeat(np.arange(len(low)), np.diff(self.first))


@functools.cache
def _libc():
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):  # another C library
        return None


def trim() -> None:
    """Give freed memory back: a worker lives on through later stages, beside the JVM."""
    pa.default_memory_pool().release_unused()
    if _libc() is not None:
        _libc()(0)


def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; memory is given back after each."""
    for batch in batches:
        yield batch
        del batch
        trim()


def chunks(batch: pa.RecordBatch, text: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices of about ``limit`` bytes of text, one row at least each."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + limit, "right")))
        yield batch.slice(at, to - at)
        at = to


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Consecutive pieces of ``values``, ``counts[i]`` in the i-th list."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), pa.array(values))
