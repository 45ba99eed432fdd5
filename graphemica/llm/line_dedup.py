"""Line dedup: exact set-similarity join over lines (operator 6)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Words, chunks, fresh, join_side, lean, lists, materialize, mix64, q, signed

THRESHOLD = 0.9
#: Words are counted in so many hash buckets; a word's rarity is its bucket's count.
BUCKETS = 1 << 18
_MIN_ID = -(1 << 63)


def _line_of(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """For each word its line within the batch, and for each text the first of its lines."""
    feeds = np.flatnonzero(w.data == 10)
    before = np.searchsorted(feeds, w.begin[:-1])
    return w.doc + np.searchsorted(feeds, w.start), np.arange(len(before)) + before


def _sets(w: Words, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, first, line): each line's distinct words, rarest first, and where each non-empty line's words begin."""
    line, _ = _line_of(w)
    if not len(line):
        return w.hash, np.zeros(0, np.int64), line
    left = 64 - max(1, int(line[-1]).bit_length()) - 18
    key = (line.astype(np.uint64) << np.uint64(64 - max(1, int(line[-1]).bit_length()))) | (rank[w.hash % np.uint64(BUCKETS)].astype(np.uint64) << np.uint64(left)) | (mix64(w.hash) >> np.uint64(64 - left))
    order = np.argsort(key, kind="stable")
    words, line = w.hash[order], line[order]
    keep = np.ones(len(words), bool)
    keep[1:] = (words[1:] != words[:-1]) | (line[1:] != line[:-1])
    words, line = words[keep], line[keep]
    first = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1])))
    return words, first, line[first]


def word_ranks(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Each bucket's place in the order of the corpus's word counts, the rarest 0.  Counts cover every word; what
    comes to the driver is at most BUCKETS rows, whatever the size of the corpus."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in lean(batches):
            for part in chunks(batch, "t"):
                total += np.bincount(Words(part.column("t")).hash % np.uint64(BUCKETS), minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["b", "n"])

    rows = docs.select(q(text_col).alias("t")).mapInArrow(count, "b int, n bigint").groupBy("b").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(BUCKETS, np.int64)
    counts[rows["b"].to_numpy()] = rows["n"].to_numpy()
    rank = np.empty(BUCKETS, np.int64)
    rank[np.argsort(counts, kind="stable")] = np.arange(BUCKETS)
    return rank


def fuzzy_size(t: float) -> int:
    """The least size at which two different sets can be as similar as ``t``: n and n + 1 words, n shared."""
    return math.ceil(t / (1 - t) - 1e-9) if t < 1 else 1 << 62


def prefix_length(n: np.ndarray, t: float) -> np.ndarray:
    """Two sets as similar as ``t`` share one of the first so many words of either."""
    return n - np.ceil(t * n - 1e-9).astype(np.int64) + 1


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.coalesce(q(id_col).cast("long"), F.lit(_MIN_ID)).alias("d"), F.xxhash64(q(text_col)).alias("rh"), q(text_col).alias("t"))


def line_sets(docs: DataFrame, rank, threshold: float, id_col: str, text_col: str) -> DataFrame:
    """(d, rh, l, n, s1, s2, bits, prefix, again): a row for each line with a word; s1, s2: a 128-bit hash of its set of words;
    bits: the parity of the number of its words that fall on each of 64 places.

    Of equal sets within a chunk of texts the first stands for all; the others have ``again`` set, no prefix, and hashes of
    their own, so that a line which every document has does not meet all its copies in one task.
    """
    least = fuzzy_size(threshold)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lean(batches):
            for part in chunks(batch, "t"):
                w = Words(part.column("t"))
                words, first, line = _sets(w, rank.value)
                if not len(first):
                    continue
                n = np.diff(np.append(first, len(words)))
                s1, s2 = np.add.reduceat(words, first), np.add.reduceat(mix64(words ^ np.uint64(0x5851F42D4C957F2D)), first)
                bits = np.bitwise_xor.reduceat(np.uint64(1) << (words >> np.uint64(58)), first)
                start = _line_of(w)[1]
                doc = np.searchsorted(start, line, "right") - 1
                ids, hashes = (part.column(c).to_numpy(zero_copy_only=False)[doc] for c in ("d", "rh"))
                again = _repeated(s1, s2, ids, hashes, line - start[doc])
                p = np.where((n >= least) & ~again, prefix_length(n, threshold), 0)
                own = mix64(ids.view(np.uint64) + mix64(hashes.view(np.uint64) + (line - start[doc]).astype(np.uint64)))
                s1, s2 = np.where(again, own, s1), np.where(again, mix64(own), s2)
                offset = np.arange(len(words)) - np.repeat(first, n)
                taken = words[offset < np.repeat(p, n)]
                yield pa.record_batch([pa.array(ids), pa.array(hashes), pa.array((line - start[doc]).astype(np.int32)), pa.array(n.astype(np.int32)), signed(s1), signed(s2), signed(bits), lists(taken.view(np.int64), p), pa.array(again)], names=["d", "rh", "l", "n", "s1", "s2", "bits", "prefix", "again"])

    return _keyed(docs, id_col, text_col).mapInArrow(each, "d bigint, rh bigint, l int, n int, s1 bigint, s2 bigint, bits bigint, prefix array<bigint>, again boolean")


def _repeated(s1: np.ndarray, s2: np.ndarray, ids: np.ndarray, hashes: np.ndarray, line: np.ndarray) -> np.ndarray:
    """Of rows with equal (s1, s2), those that are not the first by (id, hash, line), nor a repeated row of the first."""
    order = np.lexsort((line, hashes, ids, s2, s1))
    head = np.ones(len(order), bool)
    same = lambda x: x[order][1:] == x[order][:-1]
    head[1:] = ~(same(s1) & same(s2))
    first = order[np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]
    out = np.empty(len(order), bool)
    out[order] = (ids[order] != ids[first]) | (hashes[order] != hashes[first]) | (line[order] != line[first])
    return out


def words_of_lines(docs: DataFrame, need: DataFrame, rank, id_col: str, text_col: str) -> DataFrame:
    """(d, rh, l, words): the sets of the lines in ``need`` (d, rh, ls); repeated rows give them repeatedly."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lean(batches):
            for part in chunks(batch, "t"):
                w = Words(part.column("t"))
                words, first, line = _sets(w, rank.value)
                n = np.diff(np.append(first, len(words)))
                start = _line_of(w)[1]
                want = part.column("ls")
                wanted = np.repeat(start, np.diff(want.offsets.to_numpy())) + want.flatten().to_numpy()
                at = np.flatnonzero(np.isin(line, wanted))
                doc = np.searchsorted(start, line[at], "right") - 1
                rows = pa.array(doc)
                mine = np.repeat(np.isin(line, wanted), n)
                yield pa.record_batch([part.column("d").take(rows), part.column("rh").take(rows), pa.array((line[at] - start[doc]).astype(np.int32)), lists(words[mine].view(np.int64), n[at])], names=["d", "rh", "l", "words"])

    docs = _keyed(docs, id_col, text_col).join(join_side(need), ["d", "rh"])
    return docs.select("d", "rh", "t", "ls").mapInArrow(each, "d bigint, rh bigint, l int, words array<bigint>")


def later_lines(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(d, rh, ls): by document (id and hash of its text) the numbers of its lines that match an earlier line.

    Lines are ordered by id, text hash and number; a line goes if any earlier line, itself removed or not, has a
    Jaccard similarity of ``threshold`` at least to it.  Equal sets are grouped by hash; of each group the first goes
    on to the join of sets that differ: the prefixes' words meet in one shuffle, pairs pass the length, positional
    and parity filters (none of which loses a pair), and what is left is verified on the whole sets.
    """
    spark, t = docs.sparkSession, threshold
    rank = spark.sparkContext.broadcast(word_ranks(docs, text_col))
    sets = line_sets(docs, rank, t, id_col, text_col)
    nth = F.row_number().over(Window.partitionBy("s1", "s2").orderBy("d", "rh", "l"))
    # a repeated row's lines have the same key and are one line
    lines = materialize(sets.withColumn("nth", nth).withColumn("at", F.struct("d", "rh", "l")).withColumn("one", F.first("at").over(Window.partitionBy("s1", "s2").orderBy("d", "rh", "l"))).select("d", "rh", "l", "n", "bits", (F.col("again") | (F.col("at") != F.col("one"))).alias("equal"), F.when(F.col("nth") == 1, F.col("prefix")).alias("prefix")))
    post = lines.filter(F.size("prefix") > 0).select("d", "rh", "l", "n", "bits", F.posexplode("prefix").alias("i", "w"))
    a, b = post.alias("a"), post.alias("b")
    alpha = F.ceil(F.lit(t / (1 + t)) * (F.col("a.n") + F.col("b.n")) - 1e-9)
    near = (
        (F.col("a.w") == F.col("b.w"))
        & (F.struct("a.d", "a.rh", "a.l") < F.struct("b.d", "b.rh", "b.l"))
        & (F.least("a.n", "b.n") >= F.lit(t) * F.greatest("a.n", "b.n") - 1e-9)
        # the pair's first shared word stands at places i and j: they share it and the shorter rest at most
        & (F.least(F.col("a.n") - F.col("a.i"), F.col("b.n") - F.col("b.i")) >= alpha)
        # each bit in which the parities differ is a word, at least, that only one of the sets has
        & (F.bit_count(F.col("a.bits").bitwiseXOR(F.col("b.bits"))) <= F.col("a.n") + F.col("b.n") - 2 * alpha)
    )
    pairs = materialize(a.join(b, near).select(*[F.col(f"a.{c}").alias(f"{c}1") for c in ("d", "rh", "l", "n")], *[F.col(f"b.{c}").alias(f"{c}2") for c in ("d", "rh", "l", "n")]).distinct())
    ends = pairs.select(F.explode(F.array(*[F.struct(*[F.col(f"{c}{k}").alias(c) for c in ("d", "rh", "l")]) for k in (1, 2)])).alias("x")).select("x.*")
    need = ends.groupBy("d", "rh").agg(F.collect_set("l").alias("ls"))
    words = materialize(words_of_lines(docs, need, rank, id_col, text_col))
    side = lambda k: words.select(*[F.col(c).alias(f"{c}{k}") for c in ("d", "rh", "l")], F.col("words").alias(f"words{k}"))
    shared = F.size(F.array_intersect("words1", "words2"))
    both = pairs.join(side(1), ["d1", "rh1", "l1"]).join(side(2), ["d2", "rh2", "l2"])
    similar = both.filter(shared >= F.lit(t) * (F.col("n1") + F.col("n2") - shared) - 1e-9).select(F.col("d2").alias("d"), F.col("rh2").alias("rh"), F.col("l2").alias("l"))
    return lines.filter("equal").select("d", "rh", "l").union(similar).groupBy("d", "rh").agg(F.collect_set("l").alias("ls"))


def dedup_lines(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the lines that match an earlier line of the corpus; a document that lost lines and has no word
    left goes.

    A line's words are its runs of ASCII letters and digits and of non-ASCII characters, in lower case; a line's
    likeness is the Jaccard similarity of their sets (see ``later_lines``). The lines that stay are byte for byte.

    - NULL or empty text and lines without a word: no set, never removed; a text that had no word from the start stays.
    - Ties: equal sets are similar 1; the first by (id, text hash, line number) stays. NULL ids come first.
    - Repeated rows (same id and text) are the same lines, not copies of each other: all are treated alike.
    - Very long texts: every line, of any length. Ids are integers, or strings of digits; others are an error.
    - Empty table: empty result. Columns and extra columns are those of ``docs``.
    """
    ls, rh, d, kept = fresh(docs, "lines", "rh", "d", "kept")
    gone = later_lines(docs, threshold, id_col, text_col).select(F.col("d").alias(d), F.col("rh").alias(rh), F.col("ls").alias(ls))
    out = docs.withColumn(d, F.coalesce(q(id_col).cast("long"), F.lit(_MIN_ID))).withColumn(rh, F.xxhash64(q(text_col))).join(join_side(gone), [d, rh], "left")
    # the n-th line, by position; array_contains on the document's own short list
    stay = F.filter(F.split(q(text_col), "\n"), lambda x, i: ~F.array_contains(q(ls), i))
    out = out.withColumn(kept, F.when(q(ls).isNotNull(), F.array_join(stay, "\n")))
    text = F.when(q(ls).isNull(), q(text_col)).otherwise(q(kept))
    return out.filter(q(ls).isNull() | q(kept).rlike(r"[A-Za-z0-9\x{80}-\x{10FFFF}]")).select(*[text.alias(c) if c == text_col else q(c) for c in docs.columns])


SQL = f"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
w AS (SELECT doc_id, i, list_sort(list_distinct(regexp_extract_all(lower(line), '[a-z0-9\\x{{80}}-\\x{{10FFFF}}]+'))) AS ws FROM l),
e AS (SELECT doc_id, i, ws, len(ws) AS n, row_number() OVER (PARTITION BY ws ORDER BY doc_id, i) AS nth FROM w WHERE len(ws) > 0),
t AS (SELECT doc_id, i, n, unnest(ws) AS word FROM e WHERE nth = 1),
f AS (SELECT word, count(*) AS c FROM t GROUP BY word),
o AS (SELECT doc_id, i, n, t.word, row_number() OVER (PARTITION BY doc_id, i ORDER BY c, t.word) AS pos FROM t JOIN f ON t.word = f.word),
x AS (SELECT * FROM o WHERE pos <= n - ceil({THRESHOLD} * n - 1e-9) + 1),
c AS (SELECT DISTINCT a.doc_id AS d1, a.i AS i1, b.doc_id AS d2, b.i AS i2 FROM x a JOIN x b ON a.word = b.word AND (a.doc_id < b.doc_id OR a.doc_id = b.doc_id AND a.i < b.i) AND least(a.n, b.n) >= {THRESHOLD} * greatest(a.n, b.n) - 1e-9),
v AS (SELECT c.d2, c.i2, a.n + b.n AS size, len(list_intersect(a.ws, b.ws)) AS shared FROM c JOIN e a ON a.doc_id = c.d1 AND a.i = c.i1 JOIN e b ON b.doc_id = c.d2 AND b.i = c.i2),
gone AS (SELECT doc_id, i FROM e WHERE nth > 1 UNION SELECT d2, i2 FROM v WHERE shared >= {THRESHOLD} * (size - shared) - 1e-9),
k AS (
  SELECT l.doc_id, bool_or(gone.i IS NOT NULL) AS lost, coalesce(string_agg(line, chr(10) ORDER BY l.i) FILTER (gone.i IS NULL), '') AS rest
  FROM l LEFT JOIN gone ON l.doc_id = gone.doc_id AND l.i = gone.i GROUP BY l.doc_id
)
SELECT d.doc_id, CASE WHEN lost THEN rest ELSE text END AS text, lang, source, n_chars FROM documents d JOIN k ON d.doc_id = k.doc_id
WHERE NOT lost OR regexp_matches(rest, '[A-Za-z0-9\\x{{80}}-\\x{{10FFFF}}]')
"""
