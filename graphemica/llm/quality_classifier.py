"""Quality classifier: sparse rule ensemble (operator 2).

Boosted trees are grown on statistics of a bounded sample of labelled documents; every path from a root is a rule, a
conjunction of comparisons; a logistic regression under an L1 penalty keeps few of them. The result is one column
expression over built-in functions, so all documents are scored in the JVM in a single pass without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, q

#: Labelled documents that training reads at most (the first by the hash of their id); everything is scored.
MAX_TRAIN = 6000
TREES, DEPTH, RATE, BINS, MIN_LEAF, PENALTY = 24, 3, 0.3, 24, 8, 0.004
STATISTICS = ("log_chars", "chars_per_word", "letters", "capitals", "digits", "symbols", "pipes", "line_chars", "new_lines", "new_words")


def statistics(text: Column) -> dict[str, Column]:
    """The statistics of a text, NULL taken as empty; shares are of its characters."""
    t = F.coalesce(text, F.lit(""))
    n = F.length(t).cast("double")
    some = F.greatest(n, F.lit(1.0))
    share = lambda pattern: (n - F.length(F.regexp_replace(t, pattern, ""))) / some
    lines, words = F.split(t, "\n"), F.split(F.translate(t, "\n\t", "  "), " ")
    return {
        "log_chars": F.log(n + 1.0),
        "chars_per_word": n / F.greatest(F.regexp_count(t, F.lit("[^ \t\n\r]+")), F.lit(1)),
        "letters": share("[A-Za-z\\x{80}-\\x{10FFFF}]+"),
        "capitals": share("[A-Z]+"),
        "digits": share("[0-9]+"),
        "symbols": share("[^A-Za-z0-9\\x{80}-\\x{10FFFF} \t\n\r.,]+"),
        "pipes": share("[|]+"),
        "line_chars": n / F.size(lines),
        "new_lines": F.size(F.array_distinct(lines)) / F.size(lines),
        "new_words": F.size(F.array_distinct(words)) / F.size(words),
    }


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, whether it must exceed, threshold)."""

    terms: tuple[tuple[int, bool, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for k, above, at in self.terms:
            out &= (x[:, k] > at) == above
        return out

    def column(self, of: list[Column]) -> Column:
        out = F.lit(True)
        for k, above, at in self.terms:
            out = out & ((of[k] > at) if above else (of[k] <= at))
        return out


@dataclass(frozen=True)
class RuleModel:
    rules: tuple[Rule, ...]
    weights: tuple[float, ...]
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        for rule, w in zip(self.rules, self.weights, strict=True):
            z += w * rule.holds(x)
        return 1 / (1 + np.exp(-z))

    def column(self, of: list[Column]) -> Column:
        z = F.lit(float(self.bias))
        for rule, w in zip(self.rules, self.weights, strict=True):
            z = z + F.when(rule.column(of), F.lit(float(w))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, at: np.ndarray, cuts: list[np.ndarray], terms: tuple, depth: int, out: list, found: set) -> None:
    if terms:
        found.add(terms)
    best = None
    if depth and len(at) >= 2 * MIN_LEAF:
        total_g, total_h = g[at].sum(), h[at].sum()
        for k, edges in enumerate(cuts):
            if not len(edges):
                continue
            b = np.searchsorted(edges, x[at, k], "left")  # bin b: x <= edges[b]
            sg, sh, n = (np.bincount(b, w, len(edges) + 1).cumsum()[:-1] for w in (g[at], h[at], None))
            gain = sg**2 / (sh + 1) + (total_g - sg) ** 2 / (total_h - sh + 1) - total_g**2 / (total_h + 1)
            gain[(n < MIN_LEAF) | (len(at) - n < MIN_LEAF)] = -1
            i = int(gain.argmax())
            if gain[i] > 1e-6 and (best is None or gain[i] > best[0]):
                best = float(gain[i]), k, float(edges[i])
    if best is None:
        out.append((at, g[at].sum() / (h[at].sum() + 1)))
        return
    _, k, edge = best
    above = x[at, k] > edge
    for side in (False, True):
        _grow(x, g, h, at[above == side], cuts, (*terms, (k, side, edge)), depth - 1, out, found)


def _simple(terms: tuple) -> tuple:
    """Of comparisons of one statistic in one direction the strictest."""
    tight: dict[tuple[int, bool], float] = {}
    for k, above, at in terms:
        old = tight.get((k, above), at)
        tight[k, above] = max(old, at) if above else min(old, at)
    return tuple(sorted((k, above, at) for (k, above), at in tight.items()))


def train(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, penalty: float = PENALTY) -> RuleModel:
    """A rule ensemble for rows of statistics and labels 0 and 1; without both labels, the constant share of ones."""
    if len(y) == 0 or y.min() == y.max():
        p = float(np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99))
        return RuleModel((), (), float(np.log(p / (1 - p))))
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(x.shape[1])]
    z, paths = np.zeros(len(y)), set()
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        leaves: list = []
        _grow(x, y - p, p * (1 - p), np.arange(len(y)), cuts, (), depth, leaves, paths)
        for at, value in leaves:
            z[at] += RATE * value
    rules, columns, seen = [], [], set()
    for terms in sorted({_simple(p) for p in paths}, key=lambda t: (len(t), t)):
        rule = Rule(terms)
        c = rule.holds(x)
        if c.tobytes() not in seen and 0 < c.sum() < len(c):
            seen.add(c.tobytes())
            rules.append(rule)
            columns.append(c)
    a = np.array(columns, float).T if columns else np.zeros((len(y), 0))
    mean, spread = a.mean(0), a.std(0)
    s = (a - mean) / spread
    w, b = _lasso(s, y, penalty)
    kept = np.flatnonzero(np.abs(w) > 1e-6)
    raw = w[kept] / spread[kept]
    return RuleModel(tuple(rules[i] for i in kept), tuple(float(v) for v in raw), float(b - (raw * mean[kept]).sum()))


def _lasso(s: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[np.ndarray, float]:
    """Logistic regression under ``penalty`` times the L1 norm, by accelerated proximal gradient steps."""
    n, m = s.shape
    rate = 4 * n / (np.linalg.norm(s, 2) ** 2 + n)
    w, b = np.zeros(m), float(np.log(y.mean() / (1 - y.mean())))
    v, vb, t = w, b, 1.0
    for _ in range(steps):
        r = 1 / (1 + np.exp(-(s @ v + vb))) - y
        new = v - rate * (s.T @ r) / n
        new = np.sign(new) * np.maximum(np.abs(new) - rate * penalty, 0)
        nb = vb - rate * r.mean()
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb = new + (t - 1) / nt * (new - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = new, nb, nt
    return w, b


def labelled(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> tuple[np.ndarray, np.ndarray]:
    """Statistics and labels of the first ``max_train`` labelled documents by the hash of their id; a document's label is
    the more frequent one, 1 if tied; of rows that share an id the least text is used. Only these numbers come to the driver."""
    known = labels.select(q(id_col).alias("i"), q(label_col).alias("y")).filter("i is not null and y is not null").groupBy("i").agg((F.avg("y") >= 0.5).cast("double").alias("y"))
    some = known.orderBy(F.xxhash64("i"), "i").limit(max_train)  # so few rows may be broadcast at any size of the tables
    texts = docs.select(q(id_col).alias("i"), q(text_col).alias("t")).join(F.broadcast(some), "i").groupBy("i").agg(F.min("t").alias("t"), F.first("y").alias("y"))
    rows = texts.select("i", "y", *[c.alias(k) for k, c in statistics(F.col("t")).items()]).orderBy("i").toPandas()
    return rows[list(STATISTICS)].to_numpy(float), rows["y"].to_numpy(float)


def classify(docs: DataFrame, model: RuleModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """(id, score, keep) of every row: the probability of good quality, to six places, and whether it reaches ``threshold``.

    - NULL text: scored as the empty text. Very long texts: whole. Empty table: empty result.
    - Ties: a score of ``threshold`` is kept. Repeated rows: scored alike, each. NULL id: scored, NULL in the result.
    - Extra columns: not read. In training, documents without a label, and labels without a document, take no part;
      a label of NULL is none; of rows that share an id the least text is used.
    """
    names = fresh(docs, *STATISTICS)
    stats = statistics(q(text_col))
    # each statistic is named in many rules: it must stay a column, and be worked out once
    wide = docs.select(q(id_col), *[stats[k].alias(n) for k, n in zip(STATISTICS, names, strict=True)])
    score, = fresh(wide, "score")
    scored = wide.withColumn(score, F.round(model.column([q(n) for n in names]), 6))
    return scored.select(q(id_col), q(score).alias("score"), (q(score) >= threshold).alias("keep"))


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, **columns) -> RuleModel:
    return train(*labelled(docs, labels, max_train, **columns))
