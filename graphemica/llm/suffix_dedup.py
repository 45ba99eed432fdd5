"""Suffix-array dedup: depth-limited radix sort (operator 5).

Of the corpus's suffixes only those are sorted that can matter, and only through their first ``window`` words, by
most-significant-digit passes; a digit is a run of words under a 64-bit hash, and what is alone in its group after a pass
takes no part in the next one.

- Digit 0 is the whole text: of texts with the same words one goes on, the others are repeats from end to end.
- Digit 1 is the suffix's landmark: the run of GRAM words with the least hash among those of its window. Equal windows have
  equal landmarks at equal places, and landmarks are few (two in window - GRAM + 2 words), so this pass moves little.
- Digits 2 and 3 are the window's first and second half; what is equal then is a repeated window.

Groups are counted before they move, but for the last pass: it sorts, unless the landmark is a hot one, of which the
windows are counted first as well.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Words, chunks, fresh, join_side, lean, materialize, mix64, q, signed

WINDOW, GRAM = 50, 16
#: Runs of a landmark from which on its windows are counted before they move. It changes no row.
HOT = 1 << 14
_MIN_ID = -(1 << 63)
_A, _C = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA5A3564E27F88691)


def run_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of ``k`` consecutive hashes (k at least 1), by doubling."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    out, size = mix64(h), 1
    acc, done = None, 0
    with np.errstate(over="ignore"):
        while True:
            if k & size:
                n = len(h) - done - size + 1
                acc = out[:n].copy() if acc is None else mix64(acc[:n] * _A + out[done : done + n])
                done += size
            if done == k:
                return acc
            out = mix64(out[: len(out) - size] * _C + out[size:])
            size *= 2


def window_min(x: np.ndarray, k: int) -> np.ndarray:
    """Least value of each ``k`` consecutive ones."""
    out, size = x, 1
    while size * 2 <= k:
        out = np.minimum(out[: len(out) - size], out[size:])
        size *= 2
    return np.minimum(out[: len(x) - k + 1], out[k - size : k - size + len(x) - k + 1])


def landmarks(h: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(gram hash, first window, last window, twice) of each run of windows of one text with the same landmark; twice:
    the text has the landmark more than once, so that the run may hold equal windows itself."""
    grams = run_hashes(h, gram)
    least = window_min(grams, window - gram + 1)
    first = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
    ordered = np.sort(grams)
    again = ordered[1:][ordered[1:] == ordered[:-1]]
    g = least[first]
    return g, first, np.append(first[1:], len(least)) - 1, np.isin(g, again) if len(again) else np.zeros(len(g), bool)


def _slim(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.coalesce(q(id_col).cast("long"), F.lit(_MIN_ID)).alias("d"), F.xxhash64(q(text_col)).alias("rh"), q(text_col).alias("t"))


def landmark_runs(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(d, rh, g, a, z, twice, s): for each document of ``window`` words or more its landmarks and the windows a..z that have
    them, and one row with a = -1, its number of words z and two hashes of all its words, g and s."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lean(batches):
            for part in chunks(batch, "t"):
                w, out, who = Words(part.column("t")), [], []
                long = np.flatnonzero(np.diff(w.first) >= window)
                if not len(long):
                    continue
                nth = np.arange(len(w.hash), dtype=np.uint64) - w.first[w.doc].astype(np.uint64)
                with np.errstate(over="ignore"):
                    mixed = mix64(w.hash + mix64(nth * _A + _C))
                    sums = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64))) for x in (mixed, mix64(mixed ^ _A))]
                for i in long.tolist():
                    a, z = w.first[i], w.first[i + 1]
                    out.append(landmarks(w.hash[a:z], window, gram))
                    who.append(np.full(len(out[-1][0]), i))
                n = len(long)
                rows = pa.array(np.concatenate((*who, long)))
                g, first, last, twice = (np.concatenate(x) for x in zip(*out, strict=True))
                with np.errstate(over="ignore"):
                    whole = [x[w.first[long + 1]] - x[w.first[long]] for x in sums]
                none = np.zeros(len(g), np.uint64)
                yield pa.record_batch(
                    [part.column("d").take(rows), part.column("rh").take(rows), signed(np.concatenate((g, whole[0]))), pa.array(np.concatenate((first, np.full(n, -1))).astype(np.int32)), pa.array(np.concatenate((last, np.diff(w.first)[long])).astype(np.int32)), pa.array(np.concatenate((twice, np.zeros(n, bool)))), signed(np.concatenate((none, whole[1])))],
                    names=["d", "rh", "g", "a", "z", "twice", "s"])

    return _slim(docs, id_col, text_col).mapInArrow(each, "d bigint, rh bigint, g bigint, a int, z int, twice boolean, s bigint")


def _windows(docs: DataFrame, alive: DataFrame, hot: bool, window: int, id_col: str, text_col: str) -> DataFrame:
    """(d, rh, p, k1, k2, copied): the windows of the runs in ``alive`` (d, rh, runs, copied) whose landmarks are hot, or of the
    others, with the hashes of their halves."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        half = window // 2
        for batch in lean(batches):
            for part in chunks(batch, "t"):
                w, places, one, two, count = Words(part.column("t")), [], [], [], []
                runs = part.column("runs")
                edges, flat = runs.offsets.to_numpy(), runs.values
                starts, ends = flat.field("a").to_numpy(), flat.field("z").to_numpy()
                mine = flat.field("hot").to_numpy(zero_copy_only=False) == hot
                for i, (a, z) in enumerate(zip(w.first[:-1], w.first[1:], strict=True)):
                    of = slice(edges[i], edges[i + 1])
                    s, e = starts[of][mine[of]], ends[of][mine[of]]
                    n = e - s + 1
                    p = np.unique(np.repeat(s - (np.cumsum(n) - n), n) + np.arange(int(n.sum())))
                    count.append(len(p))
                    if len(p):
                        h = w.hash[a:z]
                        places.append(p)
                        one.append(run_hashes(h, half)[p])
                        two.append(run_hashes(h, window - half)[p + half])
                if places:
                    rows = pa.array(np.repeat(np.arange(len(count)), count))
                    yield pa.record_batch([part.column("d").take(rows), part.column("rh").take(rows), pa.array(np.concatenate(places).astype(np.int32)), signed(np.concatenate(one)), signed(np.concatenate(two)), part.column("copied").take(rows)], names=["d", "rh", "p", "k1", "k2", "copied"])

    texts = _slim(docs, id_col, text_col).join(alive, ["d", "rh"]).select("d", "rh", "t", "runs", "copied")
    return texts.mapInArrow(each, "d bigint, rh bigint, p int, k1 bigint, k2 bigint, copied boolean")


def _repeats(docs: DataFrame, window: int, gram: int, id_col: str, text_col: str, hot: int) -> tuple[DataFrame, DataFrame]:
    """(d, rh, z): the documents of z words that have the words of an earlier one; and (d, rh, p, later), the repeated windows
    of the others."""
    runs = materialize(landmark_runs(docs, window, gram, id_col, text_col))
    me, key = F.struct("d", "rh"), ["d", "rh"]
    # digit 0: equal texts
    texts = runs.filter("a < 0").select("d", "rh", "g", "s", "z").dropDuplicates(key)
    same = texts.groupBy("g", "s", "z").agg(F.count("*").alias("n"), F.min(me).alias("one")).filter("n > 1")
    same = join_side(texts.join(join_side(same), ["g", "s", "z"]).select("d", "rh", "z", (F.col("one") == me).alias("copied")))
    whole = same.filter("not copied").select("d", "rh", "z")
    # digit 1: landmarks; of a text with copies every window goes on, as it is repeated already
    live = runs.filter("a >= 0").join(same.select("d", "rh", "copied"), key, "left").filter(F.coalesce("copied", F.lit(True)))
    shared = live.groupBy("g").agg(F.count("*").alias("n"), F.max("twice").alias("twice")).filter("n > 1 or twice").select("g", (F.col("n") >= hot).alias("hot"))
    shared = join_side(shared)
    alive = live.join(shared, "g", "left").filter("hot is not null or copied")
    alive = alive.groupBy("d", "rh").agg(F.collect_list(F.struct("a", "z", F.coalesce("hot", F.lit(False)).alias("hot"))).alias("runs"), F.coalesce(F.max("copied"), F.lit(False)).alias("copied"))
    alive = join_side(alive)
    # digits 2 and 3; lag and lead stream through a sorted partition, however large a group of equal windows is
    digits = Window.partitionBy("k1", "k2").orderBy("d", "rh", "p")
    at = F.struct("d", "rh", "p")
    ranked = _windows(docs, alive, False, window, id_col, text_col).withColumn("af", F.lead(at).over(digits)).withColumn("head", F.first(at).over(digits))
    found = ranked.filter(F.col("copied") | (F.col("head") != at) | (F.col("af").isNotNull() & (F.col("af") != at))).select("d", "rh", "p", (F.col("head") != at).alias("later"))
    if not shared.filter("hot").isEmpty():
        crowd = _windows(docs, alive.filter(F.exists("runs", lambda r: r["hot"])), True, window, id_col, text_col)
        heads = crowd.groupBy("k1", "k2").agg(F.min(at).alias("head"), F.max(at).alias("last"))
        met = crowd.join(join_side(heads), ["k1", "k2"]).filter(F.col("copied") | (F.col("head") != F.col("last")))
        found = found.unionByName(met.select("d", "rh", "p", (F.col("head") != at).alias("later")))
    return whole, found


def repeated_windows(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """(d, rh, p, later): the places p (in words) of all windows that stand somewhere else too, in this document or another;
    later: not the first of its group by (id, text hash, place)."""
    whole, found = _repeats(docs, window, gram, id_col, text_col, hot)
    return found.unionByName(whole.select("d", "rh", F.explode(F.sequence(F.lit(0), F.col("z") - window)).alias("p"), F.lit(True).alias("later")))


def repeated_passages(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """(d, rh, start, end, later): the maximal passages, in words from start up to end, that consist of repeated windows;
    those of windows that repeat an earlier one (later) and those of first windows are listed apart.

    Words are runs of ASCII letters and digits and of non-ASCII characters, in lower case.

    - NULL, empty and short texts (fewer than ``window`` words): no window, no row.
    - Very long texts: whole, every window; overlapping repeats within one text count as well.
    - Ties: of equal windows the first by (id, text hash, place) is not later. NULL ids come first.
    - Repeated rows (same id and text) are one document and no repeat of each other.
    - Empty table: empty result. Extra columns: not read. Ids are integers, or strings of digits; others are an error.
    """
    whole, found = _repeats(docs, window, gram, id_col, text_col, hot)
    order = Window.partitionBy("d", "rh", "later").orderBy("p")
    apart = F.coalesce(F.col("p") > F.lag("p").over(order) + window, F.lit(True)).cast("long")
    spans = found.withColumn("new", apart).withColumn("span", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    spans = spans.groupBy("d", "rh", "later", "span").agg(F.min("p").alias("start"), (F.max("p") + window).alias("end")).select("d", "rh", "start", "end", "later")
    return spans.unionByName(whole.select("d", "rh", F.lit(0).alias("start"), F.col("z").alias("end"), F.lit(True).alias("later")))


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the passages that repeat an earlier one, from the first letter of their first word to the last of
    their last; all documents stay. Cases are those of ``repeated_passages``; columns are those of ``docs``."""
    d, rh, cuts, key = fresh(docs, "d", "rh", "cuts", "t")
    names = docs.columns
    gone = repeated_passages(docs, window, gram, id_col, text_col).filter("later").groupBy(F.col("d").alias(d), F.col("rh").alias(rh)).agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias(cuts))
    out = docs.withColumn(d, F.coalesce(q(id_col).cast("long"), F.lit(_MIN_ID))).withColumn(rh, F.xxhash64(q(text_col))).join(join_side(gone), [d, rh], "left")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lean(batches):
            for part in chunks(batch, key):
                w, texts = Words(part.column(key)), part.column(key).to_pylist()
                # lower-casing keeps the number of characters, not that of bytes
                chars = np.concatenate(([0], np.cumsum((w.data & 0xC0) != 0x80)))
                for i, spans in enumerate(part.column(cuts).to_pylist()):
                    base = int(chars[w.begin[i]])
                    for span in reversed(spans or []):
                        a, z = int(chars[w.start[w.first[i] + span["start"]]]) - base, int(chars[w.end[w.first[i] + span["end"] - 1]]) - base
                        texts[i] = texts[i][:a] + texts[i][z:]
                yield pa.record_batch([pa.array(texts, pa.string()) if c == text_col else part.column(c) for c in names], names=names)

    return out.select(*[q(c) for c in docs.columns], q(cuts), q(text_col).alias(key)).mapInArrow(each, docs.schema)


SQL = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9\\x{{80}}-\\x{{10FFFF}}]+') AS ws FROM documents),
x AS (SELECT doc_id, ws, CAST(unnest(range(0, len(ws) - {WINDOW - 1})) AS INTEGER) AS p FROM w WHERE len(ws) >= {WINDOW}),
h AS (SELECT doc_id, p, md5(array_to_string(ws[p + 1 : p + {WINDOW}], ' ')) AS k FROM x),
g AS (SELECT doc_id, p, count(*) OVER (PARTITION BY k) AS n, row_number() OVER (PARTITION BY k ORDER BY doc_id, p) > 1 AS later FROM h),
r AS (SELECT doc_id, p, later, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id, later ORDER BY p) + {WINDOW} THEN 0 ELSE 1 END AS new FROM g WHERE n > 1),
s AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, later ORDER BY p) AS span FROM r)
SELECT doc_id, min(p) AS start, CAST(max(p) + {WINDOW} AS INTEGER) AS "end", later FROM s GROUP BY doc_id, later, span
"""
