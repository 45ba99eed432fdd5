"""Mixing sources to target weights: Efraimidis-Spirakis sampling (operator 1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, join_side, materialize, q

#: Slices of the key range, for each power of e; only the slice in which a budget ends is sorted row by row. Their width is a
#: share of the key itself, so that none holds more than 1 / (e * SLICES) of the rows of one weight, whatever it is.
SLICES = 512
SEED = 17
#: Without explicit targets, a source's target is its tokens to this power.
TEMPERATURE = 0.5
_NOISE = "[A-Za-z\\x{80}-\\x{10FFFF} \\t\\n\\r.,]+"


def token_count(text: Column) -> Column:
    """Words between blanks; 0 for NULL."""
    return F.coalesce(F.regexp_count(text, F.lit("[^ \t\n\r]+")), F.lit(0)).cast("long")


def quality_weight(text: Column) -> Column:
    """From 1 for prose to 0.05 for text of which a quarter or more is neither letter, blank, full stop nor comma."""
    noise = F.length(F.regexp_replace(text, _NOISE, "")) / F.greatest(F.length(text), F.lit(1))
    return F.coalesce(F.greatest(F.lit(0.05), F.lit(1.0) - F.lit(4.0) * noise), F.lit(0.05))


def sampling_key(row_id: Column, weight: Column, seed: int = SEED) -> Column:
    """-ln(u) / weight: an exponential variable of rate ``weight``, u in (0, 1) from the row's id and the seed."""
    u = (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(row_id.cast("string"), F.lit("")))), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    return -F.log(u) / weight


def _keyed(docs: DataFrame, weight: Column | None, seed: int, id_col: str, group_col: str, text_col: str) -> list[Column]:
    group = F.coalesce(q(group_col).cast("string"), F.lit(""))
    return [group, token_count(q(text_col)), sampling_key(q(id_col), quality_weight(q(text_col)) if weight is None else weight, seed)]


def budgets(slim: DataFrame, targets: dict[str, float] | None, ratio: float, slices: int = SLICES) -> DataFrame:
    """(g, epochs, k, i, n): by source its whole epochs and the last (key, id, tokens) within the rest of its budget.

    The keys' range is cut in slices whose token sums combine before they move (some thousands a source). From
    their running sums follows the slice where each source's budget ends, and only that slice's rows are sorted.
    """
    cut = slim.withColumn("slice", _slice(F.col("k"), slices))
    sums = materialize(cut.groupBy("g", "slice").agg(F.sum("n").alias("n"), F.count("*").alias("rows")))
    if targets is None:
        want = sums.groupBy("g").agg(F.sum("n").alias("total")).withColumn("share", F.pow(F.col("total"), F.lit(TEMPERATURE)))
    else:
        listed = slim.sparkSession.createDataFrame([(str(g), float(w)) for g, w in targets.items()], "g string, share double")
        want = sums.groupBy("g").agg(F.sum("n").alias("total")).join(listed, "g", "left").fillna(0.0, ["share"])
    every = want.agg(F.sum("total").alias("all_total"), F.sum("share").alias("all_share"))
    want = want.crossJoin(F.broadcast(every)).select(  # one row
        "g", "total", F.coalesce(F.floor(F.lit(float(ratio)) * F.col("all_total") * F.try_divide("share", "all_share")), F.lit(0)).alias("budget"), "share")
    want = want.withColumn("epochs", F.when(F.col("total") > 0, F.floor(F.col("budget") / F.col("total"))).otherwise(0)).withColumn("rest", F.col("budget") - F.col("epochs") * F.col("total"))
    running = sums.withColumn("upto", F.sum("n").over(Window.partitionBy("g").orderBy("slice")))
    ends = running.join(want, "g").filter(F.col("upto") > F.col("rest")).groupBy("g").agg(F.min_by(F.struct("slice", (F.col("upto") - F.col("n")).alias("before")), "slice").alias("e"))
    want = join_side(want.join(ends, "g", "left").select("g", "share", "epochs", "rest", F.col("e.slice").alias("last"), F.col("e.before").alias("before")))
    edge = cut.join(want, "g").filter((F.col("slice") == F.col("last")) & (F.col("share") > 0))
    order = Window.partitionBy("g").orderBy("k", "i", "n").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    within = edge.withColumn("upto", F.col("before") + F.sum("n").over(order)).filter(F.col("upto") <= F.col("rest")).groupBy("g").agg(F.max(F.struct("k", "i", "n")).alias("m"))
    # where no row of the last slice fits, all slices before it do
    return want.join(within, "g", "left").select("g", "share", "epochs", "last", F.col("m.k").alias("k"), F.col("m.i").alias("i"), F.col("m.n").alias("n"))


def _copies(cut: Column, slice_of: Column, key: Column, row_id: Column, tokens: Column) -> Column:
    """Copies of a row, given its source's row of ``budgets``: epochs, and one more if it comes within the rest."""
    edge = F.struct(cut["k"].alias("k"), cut["i"].alias("i"), cut["n"].alias("n"))
    within = cut["k"].isNotNull() & (F.struct(key.alias("k"), row_id.alias("i"), tokens.alias("n")) <= edge)
    fits = cut["last"].isNull() | (slice_of < cut["last"]) | ((slice_of == cut["last"]) & F.coalesce(within, F.lit(False)))
    return F.when(cut["share"] > 0, cut["epochs"] + fits.cast("long")).otherwise(F.lit(0).cast("long"))


def _slice(key: Column, slices: int) -> Column:
    return F.floor(F.lit(float(slices)) * F.log(F.greatest(key, F.lit(1e-300))))


def _slim(docs: DataFrame, weight: Column | None, seed: int, id_col: str, group_col: str, text_col: str) -> DataFrame:
    group, tokens, key = _keyed(docs, weight, seed, id_col, group_col, text_col)
    return materialize(docs.select(group.alias("g"), F.coalesce(q(id_col).cast("string"), F.lit("")).alias("i"), q(id_col).alias("id"), q(group_col).alias("source"), tokens.alias("n"), key.alias("k")))


def mix_plan(docs: DataFrame, targets: dict[str, float] | None = None, ratio: float = 1.0, weight: Column | None = None, seed: int = SEED, id_col: str = "doc_id", group_col: str = "source", text_col: str = "text", slices: int = SLICES) -> DataFrame:
    """(id, source, n_tokens, copies): how often each row of ``docs`` is taken; rows taken 0 times are listed too.

    ``ratio`` times the tokens of the table are shared out by ``targets`` (source -> weight; a source that is not
    listed gets none), by default by the square root of each source's tokens. A source's budget first buys complete
    epochs of all its rows. The rest is filled by Efraimidis-Spirakis: rows in the order of exponential keys whose
    rate is the document's quality weight (``weight``, by default ``quality_weight``), as long as the prefix sum of
    tokens stays within the rest.

    - NULL text: no tokens, weight 0.05. NULL or empty source: one source. NULL id: as the empty id. Ids of any type.
    - Empty and very long texts: counted whole; a text that is longer than the rest of a budget ends it.
    - Ties (same key, id and tokens, as in repeated rows): all are taken or none, and only if all of them fit.
    - A source without tokens is taken once (its prefix sums are 0) if its target is positive.
    - Empty table: empty result. Extra columns: not read.
    """
    slim = _slim(docs, weight, seed, id_col, group_col, text_col)
    cut = join_side(budgets(slim, targets, ratio, slices).select("g", F.struct("*").alias("cut")))
    copies = _copies(F.col("cut"), _slice(F.col("k"), slices), F.col("k"), F.col("i"), F.col("n"))
    return slim.join(cut, "g").select(F.col("id").alias(id_col), F.col("source").alias(group_col), F.col("n").alias("n_tokens"), copies.alias("copies"))


def mix(docs: DataFrame, targets: dict[str, float] | None = None, ratio: float = 1.0, weight: Column | None = None, seed: int = SEED, id_col: str = "doc_id", group_col: str = "source", text_col: str = "text", slices: int = SLICES) -> DataFrame:
    """``docs`` with each row repeated as often as ``mix_plan`` says, columns as they were; texts are never shuffled
    where the sources' table is small. Cases are those of ``mix_plan``."""
    slim = _slim(docs, weight, seed, id_col, group_col, text_col)
    g, n, k, c, x = fresh(docs, "g", "n", "k", "copy", "cut")
    cut = join_side(budgets(slim, targets, ratio, slices).select(F.col("g").alias(g), F.struct("*").alias(x)))
    group, tokens, key = _keyed(docs, weight, seed, id_col, group_col, text_col)
    d = docs.withColumn(g, group).withColumn(n, tokens).withColumn(k, key)
    taken = d.join(cut, g).withColumn(c, _copies(q(x), _slice(q(k), slices), q(k), F.coalesce(q(id_col).cast("string"), F.lit("")), q(n)))
    return taken.filter(q(c) > 0).withColumn(c, F.explode(F.sequence(F.lit(1).cast("long"), q(c)))).select(*[q(x) for x in docs.columns])


SQL = f"""
WITH s AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(text, '[^ \\t\\n\\r]+')) AS BIGINT) AS n,
    -ln((CAST(CAST('0x' || substr(md5('{SEED}:' || doc_id), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0)
      / greatest(0.05, 1.0 - 4.0 * length(regexp_replace(text, '[A-Za-z\\x{{80}}-\\x{{10FFFF}} \\t\\n\\r.,]+', '', 'g')) / greatest(length(text), 1)) AS k
  FROM documents
),
t AS (SELECT source, sum(n) AS total FROM s GROUP BY source),
b AS (SELECT source, total, floor((SELECT sum(total) FROM t) * (sqrt(total) / (SELECT sum(sqrt(total)) FROM t))) AS budget FROM t),
r AS (SELECT source, CAST(floor(budget / total) AS BIGINT) AS epochs, budget - floor(budget / total) * total AS rest FROM b)
SELECT s.doc_id, s.source, s.n AS n_tokens,
  CAST(epochs + CASE WHEN sum(n) OVER (PARTITION BY s.source ORDER BY k, CAST(doc_id AS VARCHAR), n) <= rest THEN 1 ELSE 0 END AS BIGINT) AS copies
FROM s JOIN r ON s.source = r.source
"""
