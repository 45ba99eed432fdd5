"""Demappers: models that reverse a map of characters, as tables of counts with backoff.

A model tells what most often stood for a source character between its neighbours; where a context was never seen, a
shorter one decides, and at last the character stays itself. Fitting counts the widest contexts of many Arrow batches and
sums what is left; shorter ones are parts of these. Accuracy joins the counts of the test set with the model, which no worker
holds. To transform texts, a model of at most ``SMALL`` contexts goes to every worker, which looks up whole batches in it; a
larger one is joined. It is a table like any other: saved as Parquet, compared by alphabet.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.batches import in_pieces, pieces, points, texts_of

#: Contexts of a model that is sent to the workers; beyond, it is joined.
SMALL = 2_000_000
#: Distinct contexts that a task keeps before it sends them on.
_KEPT = 1 << 19
_EDGE = "\x02"


def _contexts(text: Column, width: int) -> Column:
    """For each character (pos, chr, c0..c<width>): its contexts of k characters on either side, the edge as a mark. They
    are made of shifted arrays, each a pass over the text."""
    letters = F.filter(F.split(text, ""), lambda c: c != "")
    n = F.size(letters)
    contexts = [letters]
    for k in range(1, width + 1):
        edge = F.array_repeat(F.lit(_EDGE), k)
        before = F.slice(F.concat(edge, letters), 1, n)
        after = F.slice(F.concat(letters, edge), k + 1, n)
        contexts.append(F.zip_with(F.zip_with(before, contexts[-1], lambda a, b: F.concat(a, b)), after, lambda a, b: F.concat(a, b)))
    rows = F.arrays_zip(*[c.alias(f"c{k}") for k, c in enumerate(contexts)])
    return F.transform(rows, lambda r, i: F.struct(i.alias("pos"), r["c0"].alias("chr"), *[r[f"c{k}"].alias(f"c{k}") for k in range(width + 1)]))


@dataclass
class Demapper:
    """model(k, ctx, tgt, n, confidence): by context of k characters on either side the target seen most."""

    model: DataFrame
    width: int
    history: DataFrame | None = None

    @classmethod
    def fit(cls, pairs: DataFrame, width: int = 1, pieces: str | None = None) -> Demapper:
        """From pairs (src, tgt) of equal length (others are left out), or, with ``pieces``, from that column of aligned
        parts, whose targets may be of any length. Ties go to the first target in order."""
        if pieces is None:
            rows = pairs.select("src", "tgt")
        else:
            src = F.array_join(F.transform(pieces, lambda p: p["src"]), "")
            rows = pairs.filter(F.size(pieces) > 0).select(src.alias("src"), F.transform(pieces, lambda p: p["tgt"]).alias("tgt"))
        counts = _contexts_counted(rows, width, equal=pieces is None).select(F.explode(_levels("ctx", width)).alias("x"), "tgt", "n").groupBy("x.k", "x.ctx", "tgt").agg(F.sum("n").alias("n"))
        best = counts.groupBy("k", "ctx").agg(F.min(F.struct((-F.col("n")).alias("m"), "tgt")).alias("b"), F.sum("n").alias("n"))
        return cls(best.select("k", "ctx", "b.tgt", "n", (-F.col("b.m") / F.col("n")).alias("confidence")), width)

    def _sent(self):
        """The model as a broadcast table for ``_Lookup``, once; None if it is too large."""
        if not hasattr(self, "_table"):
            rows = self.model.select("k", "ctx", "tgt", "confidence").limit(SMALL + 1).toArrow()
            self._table = self.model.sparkSession.sparkContext.broadcast(rows.combine_chunks()) if rows.num_rows <= SMALL else None
        return self._table

    def _whole(self, text: Column, truth: Column | None = None) -> Column:
        """For each text a struct (text, confidence, n, correct); the last two against ``truth``, place by place."""
        sent, width, against = self._sent(), self.width, truth is not None

        @F.arrow_udf("struct<text:string,confidence:double,n:int,correct:int>")
        def each(texts: pa.Array, gold: pa.Array) -> pa.Array:
            look = _Lookup.of(sent, width)
            return in_pieces(lambda a, b: one(look, a, b), texts, gold)

        def one(look: _Lookup, texts: pa.Array, gold: pa.Array) -> pa.Array:
            code, bounds = points(texts)
            target, confidence = look(code, bounds)
            made = look.spell(target, code, bounds)
            size = np.diff(bounds)
            total = np.concatenate(([0.0], np.cumsum(confidence)))[bounds]
            with np.errstate(invalid="ignore", divide="ignore"):
                mean = np.diff(total) / size
            n, right = np.zeros(len(texts), np.int32), np.zeros(len(texts), np.int32)
            if against:
                want, edges = points(gold)
                n = np.minimum(size, np.diff(edges)).astype(np.int32)
                at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                mine, yours = np.repeat(bounds[:-1], n) + at, np.repeat(edges[:-1], n) + at
                hit = look.single(target[mine], code[mine]) == want[yours].astype(np.int64)
                right = np.diff(np.concatenate(([0], np.cumsum(hit)))[np.concatenate(([0], np.cumsum(n)))]).astype(np.int32)
            return pa.StructArray.from_arrays([made, pa.array(mean, from_pandas=True), pa.array(n), pa.array(right)], ["text", "confidence", "n", "correct"])

        return each(text, text if truth is None else truth)

    def characters(self, corpus: DataFrame, key: str, text_col: str = "src") -> DataFrame:
        """(key, pos, chr, tgt, confidence): what the model makes of each character; unseen ones stay, at confidence 0."""
        rows = corpus.select(key, F.explode(_contexts(F.col(text_col), self.width)).alias("x")).select(key, "x.*")
        for k in range(self.width + 1):
            side = self.model.filter(F.col("k") == k).select(F.col("ctx").alias(f"c{k}"), F.col("tgt").alias(f"t{k}"), F.col("confidence").alias(f"p{k}"))
            rows = rows.join(side, f"c{k}", "left")
        down = range(self.width, -1, -1)
        return rows.select(key, "pos", "chr", F.coalesce(*[F.col(f"t{k}") for k in down], F.col("chr")).alias("tgt"), F.coalesce(*[F.col(f"p{k}") for k in down], F.lit(0.0)).alias("confidence"))

    def transform(self, corpus: DataFrame, key: str, text_col: str = "src") -> DataFrame:
        """(key, text, confidence): whole texts and their mean confidence; rows with an empty text are left out."""
        if self._sent() is not None:
            made = corpus.filter(F.length(text_col) > 0).select(key, self._whole(F.col(text_col)).alias("x"))
            return made.select(key, "x.text", "x.confidence")
        rows = self.characters(corpus.filter(F.length(text_col) > 0), key, text_col)
        text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "tgt"))), lambda x: x["tgt"]), "")
        return rows.groupBy(key).agg(text.alias("text"), F.avg("confidence").alias("confidence"))

    def accuracy(self, pairs: DataFrame, key: str, *by: str) -> DataFrame:
        """(by..., n, correct, accuracy) by character over pairs (key, src, tgt). What a character becomes depends on its widest
        context alone, so without ``by`` these are counted with their targets and only the counts meet the model."""
        if not by:
            counts = _contexts_counted(pairs.select("src", "tgt"), self.width)
            each = counts.select(F.col("ctx").alias("whole"), F.col("tgt").alias("gold"), F.col("n").alias("times"), F.explode(_levels("ctx", self.width)).alias("x")).select("whole", "gold", "times", "x.*")
            met = each.join(self.model.select("k", "ctx", "tgt"), ["k", "ctx"], "left")
            # the widest known context is the greatest number, its lowest bit tells a hit
            best = met.groupBy("whole", "gold", "times").agg(F.max(2 * F.col("k") + (F.col("tgt") == F.col("gold")).cast("int")).alias("b"))
            hit = F.coalesce(F.col("b") % 2 == 1, F.substring("whole", self.width + 1, 1) == F.col("gold"))
            n, correct = F.sum("times"), F.sum(F.when(hit, F.col("times")))
            sums = best.agg(F.coalesce(n, F.lit(0)).alias("n"), F.coalesce(correct, F.lit(0)).alias("correct"))
            return sums.withColumn("accuracy", F.when(F.col("n") > 0, F.col("correct") / F.col("n")))
        if self._sent() is None:
            return accuracy(self.characters(pairs, key), pairs, key, *by)
        rows = pairs.filter((F.length("src") > 0) & (F.length("tgt") > 0)).select(*by, self._whole(F.col("src"), F.col("tgt")).alias("x"))
        n, correct = F.sum(F.col("x.n").cast("long")), F.sum(F.col("x.correct").cast("long"))
        return rows.groupBy(*by).agg(F.coalesce(n, F.lit(0)).alias("n"), F.coalesce(correct, F.lit(0)).alias("correct"), F.try_divide(correct, n).alias("accuracy"))

    def alphabet(self) -> DataFrame:
        return self.model.filter("k = 0").select(F.col("ctx").alias("chr"))

    def is_compatible(self, letters: DataFrame) -> bool:
        """Whether the model knows exactly these characters (chr)."""
        return self.alphabet().exceptAll(letters.select("chr")).isEmpty() and letters.select("chr").exceptAll(self.alphabet()).isEmpty()

    def save(self, path: str, overwrite: bool = False) -> None:
        mode = "overwrite" if overwrite else "errorifexists"
        self.model.withColumn("width", F.lit(self.width)).write.mode(mode).parquet(f"{path}/model")
        if self.history is not None:
            self.history.write.mode(mode).parquet(f"{path}/history")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Demapper:
        model = spark.read.parquet(f"{path}/model")
        width = model.agg(F.max("width")).first()[0]
        try:
            history = spark.read.parquet(f"{path}/history")
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
            history = None
        return cls(model.drop("width"), width, history)


def _padded(code: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(code points with ``width`` marks before each text and after the last, the place of each character)."""
    size = np.diff(bounds)
    at = np.arange(len(code)) + width * (np.repeat(np.arange(len(size)), size) + 1)
    out = np.full(len(code) + width * (len(size) + 1), ord(_EDGE), np.int64)
    out[at] = code
    return out, at


def _ranked(x: np.ndarray) -> tuple[np.ndarray, int]:
    """Small code points or ids as ranks, and how many there are."""
    seen = np.flatnonzero(np.bincount(x, minlength=1)) if len(x) else np.zeros(0, np.int64)
    rank = np.zeros(int(seen[-1]) + 1 if len(seen) else 1, np.int64)
    rank[seen] = np.arange(len(seen))
    return rank[x], max(1, len(seen))


def _levels(ctx: str, width: int) -> Column:
    """The contexts (k, ctx) of each width within the widest one."""
    return F.array(*[F.struct(F.lit(k).alias("k"), F.substring(ctx, width - k + 1, 2 * k + 1).alias("ctx")) for k in range(width + 1)])


def _contexts_counted(pairs: DataFrame, width: int, equal: bool = False) -> DataFrame:
    """(ctx, tgt, n) of (src, tgt): how often each target stood in each context of ``width`` characters on either side; with
    ``equal`` of texts of equal length only."""
    return pairs.mapInArrow(_counts(width, equal), "ctx string, tgt string, n bigint").groupBy("ctx", "tgt").agg(F.sum("n").alias("n"))


def _counts(width: int, equal: bool = False):
    """(ctx, tgt, n) of batches of (src, tgt), as far as both texts go; a target may be a list of what stands for each character."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = _Tally(width)
        for whole in batches:
            listed = pa.types.is_list(whole.column(1).type)
            for batch in pieces(iter([whole]), *((0,) if listed else (0, 1))):
                code, bounds = points(batch.column(0))
                padded, at = _padded(code, bounds, width)
                if listed:
                    targets = batch.column(1).flatten().dictionary_encode()
                    words, target = targets.dictionary.to_pylist(), targets.indices.to_numpy().astype(np.int64)
                else:
                    letters, edges = points(batch.column(1))
                    if not np.array_equal(bounds, edges):
                        n = np.minimum(np.diff(bounds), np.diff(edges))
                        if equal:
                            n[np.diff(bounds) != np.diff(edges)] = 0
                        pos = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                        at, letters = at[np.repeat(bounds[:-1], n) + pos], letters[np.repeat(edges[:-1], n) + pos]
                    seen = np.flatnonzero(np.bincount(letters)) if len(letters) else np.zeros(0, np.int64)
                    words, target = [chr(c) for c in seen.tolist()], _ranked(letters)[0]
                if len(at):
                    yield from tally.add(padded, at, words, target)
        yield from tally.rest()

    return each


class _Tally:
    """Counts of contexts with their targets, of one piece after another. A context and its target are one number of 63 bits
    while the characters and the targets of all pieces are few enough; a piece of too many is counted alone."""

    def __init__(self, width: int):
        self.width, self.bits = width, 63 // (2 * width + 2)
        self._clear()

    def _clear(self) -> None:
        self.letters: dict[int, int] = {}
        self.words: dict[str, int] = {}
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, padded: np.ndarray, at: np.ndarray, words: list[str], target: np.ndarray) -> Iterator[pa.RecordBatch]:
        seen = np.flatnonzero(np.bincount(padded))
        if max(len(self.letters.keys() | seen.tolist()), len(self.words.keys() | words)) > 1 << self.bits:
            yield from self.rest()
            if max(len(seen), len(words)) > 1 << self.bits:
                yield from self._alone(padded, at, words, target)
                return
        rank = np.zeros(int(seen[-1]) + 1, np.int64)
        rank[seen] = [self.letters.setdefault(c, len(self.letters)) for c in seen.tolist()]
        known = np.array([self.words.setdefault(w, len(self.words)) for w in words], np.int64)
        ranks, key = rank[padded], np.zeros(len(at), np.int64)
        for c in range(-self.width, self.width + 1):
            key <<= self.bits
            key |= ranks[at + c]
        key <<= self.bits
        key |= known[target]
        self.parts.append(np.unique(key, return_counts=True))
        if sum(len(k) for k, _ in self.parts) > 2 * _KEPT:
            self._merge()
            if len(self.parts[0][0]) > _KEPT:
                yield from self.rest()

    def _merge(self) -> None:
        key, n = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        self.parts = [(key[first], np.add.reduceat(n[order], first))]

    def rest(self) -> Iterator[pa.RecordBatch]:
        """What was counted, which begins anew."""
        if self.parts:
            self._merge()
            (keys, counts), mask = self.parts[0], (1 << self.bits) - 1
            letters, words = np.array(list(self.letters), np.uint32), pa.array(list(self.words), pa.string())
            for i in range(0, len(keys), 1 << 16):
                key = keys[i : i + (1 << 16)]
                spans = np.stack([letters[key >> (self.bits * c) & mask] for c in range(2 * self.width + 1, 0, -1)], 1)
                yield _counted_rows(spans, words.take(pa.array(key & mask)), counts[i : i + (1 << 16)])
        self._clear()

    def _alone(self, padded: np.ndarray, at: np.ndarray, words: list[str], target: np.ndarray) -> Iterator[pa.RecordBatch]:
        rank, letters = _ranked(padded)
        ids, many = rank[at], letters
        for k in range(1, self.width + 1):  # a context is its inner one between two more characters
            _, ids = np.unique((rank[at - k] * letters + rank[at + k]) * many + ids, return_inverse=True)
            ids = ids.reshape(-1)
            many = int(ids.max()) + 1
        key, where, n = np.unique(ids * len(words) + target, return_index=True, return_counts=True)
        spans = padded[at[where][:, None] + np.arange(-self.width, self.width + 1)]
        yield _counted_rows(spans, pa.array(words, pa.string()).take(pa.array(key % len(words))), n)


def _counted_rows(contexts: np.ndarray, targets: pa.Array, n: np.ndarray) -> pa.RecordBatch:
    spelt = texts_of(contexts.astype(np.uint32, copy=False).ravel(), np.arange(len(n) + 1) * contexts.shape[1])
    return pa.record_batch([spelt, targets, pa.array(n.astype(np.int64))], names=["ctx", "tgt", "n"])


class _Lookup:
    """A model by hashes of its contexts, whose code points are compared as well."""

    _kept: list[tuple] = []

    def __init__(self, table: pa.Table, width: int):
        self.width, self.by_size = width, []
        words = table["tgt"].combine_chunks().dictionary_encode()
        self.words = words.dictionary.to_pylist()
        #: a target's only code point; -1 where it has none or several
        self.points = np.array([ord(w) if len(w) == 1 else -1 for w in self.words] + [-1], np.int64)
        ks, tgt, sure = table["k"].to_numpy(), words.indices.to_numpy().astype(np.int64), table["confidence"].to_numpy()
        contexts = table["ctx"].combine_chunks()
        for k in range(width + 1):
            mine = np.flatnonzero(ks == k)
            code = points(contexts.take(pa.array(mine)))[0].astype(np.int64).reshape(-1, 2 * k + 1)
            h = self._hash([code[:, c] for c in range(2 * k + 1)], len(code))
            order = np.argsort(h, kind="stable")
            self.by_size.append((h[order], code[order], tgt[mine][order], sure[mine][order]))

    @classmethod
    def of(cls, sent, width: int) -> _Lookup:
        """The one of a model that this worker used before, or a new one; of those used last as many are kept as have ``SMALL``
        contexts in all."""
        for table, look in cls._kept:
            if table is sent.value:
                return look
        cls._kept = [*cls._kept, (sent.value, cls(sent.value, width))]
        while len(cls._kept) > 1 and sum(len(table) for table, _ in cls._kept) > SMALL:
            cls._kept = cls._kept[1:]
        return cls._kept[-1][1]

    @staticmethod
    def _hash(columns: list[np.ndarray], n: int) -> np.ndarray:
        h = np.zeros(n, np.uint64)
        with np.errstate(over="ignore"):
            for c in columns:
                h = (h ^ c.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
        return h

    def __call__(self, code: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(target, confidence) of each character; target -1 where it stays itself."""
        padded, at = _padded(code, bounds, self.width)
        target, sure = np.full(len(code), -1, np.int64), np.zeros(len(code))
        left = np.arange(len(code))
        for k in range(self.width, -1, -1):
            h, known, tgt, p = self.by_size[k]
            if not len(h) or not len(left):
                continue
            columns = [padded[at[left] + c] for c in range(-k, k + 1)]
            mine = self._hash(columns, len(left))
            start = np.searchsorted(h, mine)
            place = np.minimum(start, len(h) - 1)
            same = h[place] == mine
            for c, column in enumerate(columns):
                same &= known[place, c] == column
            found = left[same]
            target[found], sure[found] = tgt[place[same]], p[place[same]]
            left = left[~same]
        return target, sure

    def single(self, target: np.ndarray, code: np.ndarray) -> np.ndarray:
        return np.where(target < 0, code.astype(np.int64), self.points[target])

    def spell(self, target: np.ndarray, code: np.ndarray, bounds: np.ndarray) -> pa.Array:
        one = self.single(target, code)
        if (one >= 0).all():
            return texts_of(one.astype(np.uint32), bounds)
        pieces = [self.words[t] if t >= 0 else chr(c) for t, c in zip(target.tolist(), code.tolist(), strict=True)]
        return pa.array(["".join(pieces[a:z]) for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)], pa.string())


def accuracy(predicted: DataFrame, truth: DataFrame, key: str, *by: str) -> DataFrame:
    """(by..., n, correct, accuracy) by character, of predictions (key, pos, tgt) against whole texts (key, tgt)."""
    right = truth.select(key, *by, F.posexplode(F.split("tgt", "")).alias("pos", "gold"))
    joined = right.join(predicted.select(key, "pos", "tgt"), [key, "pos"])
    return joined.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(F.col("tgt") == F.col("gold")).alias("correct"), F.avg((F.col("tgt") == F.col("gold")).cast("double")).alias("accuracy"))


def learning_curve(pairs: DataFrame, test: DataFrame, key: str, sizes: list[int], width: int = 1) -> DataFrame:
    """(size, n, correct, accuracy): models fitted on the first ``size`` pairs by key, all held against ``test``."""
    models = {size: Demapper.fit(pairs.orderBy(key).limit(size), width) for size in sizes}
    if all(m._sent() is not None for m in models.values()):
        # all models in one pass over the test set, by the same workers
        rows = test.filter((F.length("src") > 0) & (F.length("tgt") > 0)).select(*[m._whole(F.col("src"), F.col("tgt")).alias(f"x{k}") for k, m in enumerate(models.values())])
        sums = rows.agg(*[F.coalesce(F.sum(F.col(f"x{k}.{c}").cast("long")), F.lit(0)).alias(f"{c}{k}") for k in range(len(models)) for c in ("n", "correct")])
        each = F.array(*[F.struct(F.lit(size).alias("size"), F.col(f"n{k}").alias("n"), F.col(f"correct{k}").alias("correct")) for k, size in enumerate(models)])
        return sums.select(F.explode(each).alias("x")).select("x.*", F.try_divide("x.correct", "x.n").alias("accuracy"))
    out = None
    for size, model in models.items():
        row = model.accuracy(test, key).select(F.lit(size).alias("size"), "n", "correct", "accuracy")
        out = row if out is None else out.unionByName(row)
    return out


def validation_summary(history: DataFrame, metric: str = "accuracy", order: str = "epoch") -> DataFrame:
    """One row: the last value of a metric, its greatest, and its sample deviation over the second half of the epochs."""
    last = history.agg(F.max(order).alias("last")).first()["last"] or 0
    return history.agg(F.max_by(metric, order).alias("last"), F.max(metric).alias("best"), F.stddev_samp(F.when(F.col(order) * 2 > last, F.col(metric))).alias("deviation"))
