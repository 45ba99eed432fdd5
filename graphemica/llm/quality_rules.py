"""Quality rules: cross-document line frequency (operator 3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, hash_pair, join_side, q

#: A line may stand in so many documents of its host at least, and in this share of them, before it is removed.
MIN_DOCS, MAX_SHARE = 5, 0.02
#: A document that keeps less than this share of its characters after losing lines is rejected.
MIN_KEPT = 0.5


def normal_line(line: Column) -> Column:
    """Lower case, every run of other characters than letters and digits one space, no space at the ends."""
    return F.trim(F.regexp_replace(F.lower(line), r"[^\p{L}\p{N}]+", " "))


def frequent_lines(docs: DataFrame, min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text") -> DataFrame:
    """(host, h1, h2, n_docs): hashes of the normalised lines that stand in more documents of a host than its limit.

    Distinct documents are counted in two steps (by line and document, then by line), so that a line which half of a
    host's documents share is combined before it moves and is no one task's burden.
    """
    slim = docs.select(q(id_col).alias("d"), F.coalesce(q(host_col).cast("string"), F.lit("")).alias("host"), q(text_col).alias("t"))
    limits = slim.groupBy("host").agg(F.greatest(F.lit(float(min_docs)), F.lit(max_share) * F.count_distinct(F.coalesce(F.col("d").cast("string"), F.lit("")))).alias("most"))
    lines = slim.select("d", "host", F.explode(F.array_distinct(F.filter(F.transform(F.split("t", "\n"), normal_line), lambda x: x != ""))).alias("line"))
    h1, h2 = hash_pair(F.col("line"))
    counts = lines.select(F.coalesce(F.col("d").cast("string"), F.lit("")).alias("d"), "host", h1.alias("h1"), h2.alias("h2")).groupBy("host", "h1", "h2").agg(F.count_distinct("d").alias("n_docs"))
    # only counts above the smallest limit there can be take part in the join
    return counts.filter(F.col("n_docs") > min_docs).join(limits, "host").filter(F.col("n_docs") > F.col("most")).select("host", "h1", "h2", "n_docs")


def apply_quality_rules(docs: DataFrame, min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE, min_kept: float = MIN_KEPT, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text") -> DataFrame:
    """``docs`` without the lines that too many documents of the same host share, and without depleted documents.

    A normalised line that stands in more than ``max(min_docs, max_share * documents of the host)`` distinct documents
    of its host is removed wherever it stands there; the rest of the text stays byte for byte. A document that lost a
    line is rejected if its remaining non-blank lines hold less than ``min_kept`` of the characters it had.

    - NULL or empty text, and lines without a letter or digit: never counted, never removed; such documents stay.
    - Very long texts: every line counts and is looked up like any other. Ids may be of any type.
    - NULL host: all such documents form one host of their own, as does the empty string. NULL id: one document.
    - A repeated row counts once (documents are distinct ids); all its copies are treated alike and stay.
    - Empty table: empty result. Columns, order of columns and extra columns are those of ``docs``.
    """
    heavy = frequent_lines(docs, min_docs, max_share, id_col, host_col, text_col)
    host, hs, marks, kept, lines = fresh(docs, "host", "heavy", "marks", "kept", "lines")
    # at most mean lines a document / max_share hashes a host; 4096 bits tell most other lines at once that they are none
    rules = heavy.groupBy(F.col("host").alias(host)).agg(F.collect_set(F.struct("h1", "h2")).alias(hs))
    one = lambda h: F.call_function("shiftleft", F.lit(1).cast("long"), h["h1"].bitwiseAND(63).cast("int"))
    word = lambda h1: F.shiftrightunsigned(h1, 6).bitwiseAND(63).cast("int")
    rules = rules.withColumn(marks, F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.aggregate(F.filter(q(hs), lambda h: word(h["h1"]) == i), F.lit(0).cast("long"), lambda a, h: a.bitwiseOR(one(h)))))
    out = docs.withColumn(host, F.coalesce(q(host_col).cast("string"), F.lit(""))).join(join_side(rules), host, "left")

    def stays(line: Column) -> Column:
        h1, h2 = hash_pair(normal_line(line))
        marked = F.call_function("shiftrightunsigned", F.get(q(marks), word(h1)), h1.bitwiseAND(63).cast("int")).bitwiseAND(1) == 1
        return ~(marked & F.array_contains(q(hs), F.struct(h1.alias("h1"), h2.alias("h2"))))

    size = lambda x: F.aggregate(x, F.lit(0), lambda n, s: n + F.length(F.trim(s)))
    out = out.withColumn(lines, F.when(q(hs).isNotNull(), F.split(q(text_col), "\n"))).withColumn(kept, F.filter(q(lines), stays))
    ok = q(kept).isNull() | (F.size(q(kept)) == F.size(q(lines))) | (size(q(kept)) >= F.lit(min_kept) * size(q(lines)))
    text = F.when(q(kept).isNull(), q(text_col)).otherwise(F.array_join(q(kept), "\n"))
    return out.filter(ok).select(*[text.alias(c) if c == text_col else q(c) for c in docs.columns])


SQL = f"""
WITH l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
n AS (SELECT *, trim(regexp_replace(lower(line), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS norm FROM l),
heavy AS (
  SELECT source, norm FROM n WHERE norm <> '' GROUP BY source, norm
  HAVING count(DISTINCT doc_id) > greatest({MIN_DOCS}, {MAX_SHARE} * (SELECT count(*) FROM documents d WHERE d.source = n.source))
),
k AS (SELECT n.*, h.norm IS NULL AS stays FROM n LEFT JOIN heavy h ON n.source = h.source AND n.norm = h.norm),
d AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY i) FILTER (stays) AS text, bool_and(stays) AS whole,
    coalesce(sum(length(trim(line))) FILTER (stays), 0) AS left_over, sum(length(trim(line))) AS had
  FROM k GROUP BY doc_id
)
SELECT o.doc_id, coalesce(d.text, '') AS text, o.lang, o.source, o.n_chars
FROM d JOIN documents o ON d.doc_id = o.doc_id WHERE whole OR left_over >= {MIN_KEPT} * had
"""
