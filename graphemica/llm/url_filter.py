"""URL filters: sort-merge range join (operator 7).

A URL's canonical key is its host with the labels reversed and a comma after each, then its path and query:
``https://www.Shop.example.com:443/a?b#c`` has ``com,example,shop,/a?b``. A rule's pattern is a host, with or without the
beginning of a path, and its key is made in the same way; all URLs under it have keys that begin with it, the interval
from the key up to the key followed by the greatest character. Intervals of prefixes are nested or apart, so a sweep over
the sorted keys keeps the rules that hold at a key on a stack, the most specific on top.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, join_side, lean, materialize, q

#: Rules as (pattern, action); the most specific one that a URL is under decides.
RULES = (
    ("example.com", "allow"), ("example.net", "allow"), ("example.org", "allow"),
    ("spam-farm.example.org", "block"), ("spam-farm.example.org/en", "block"), ("spam-farm.example.org/en/1", "allow"),
    ("cheap-pills.example.com", "block"), ("cheap-pills.example.net", "block"), ("cheap-pills.example.net/de", "allow"), ("cheap-pills.example.net/de/4", "block"),
    ("casino-win.example.net", "block"), ("casino-win.example.com", "block"), ("casino-win.example.org", "block"),
    ("blog.casino-win.example.net/en/3", "allow"), ("example.net/es", "block"), ("m.example.com", "block"), ("tionsh.example.net/en", "allow"), ("tionsh.example.net/en/1", "block"),
)
#: Keys read for the partitions' bounds, per partition, at most.
PER_BOUND = 64
_LAST = "\U0010ffff"


def canonical_key(url: Column) -> Column:
    """The key of a URL or pattern; a scheme, user, port, fragment, a leading ``www.`` and dots at the host's end drop out,
    the host is lower-case, and a host without a path has none."""
    rest = F.regexp_replace(F.regexp_replace(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.\-]*:", ""), r"^//|#.*$", "")
    rest = F.regexp_replace(rest, r"#.*$", "")
    host = F.lower(F.regexp_extract(rest, r"^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$", ""), r"\.+$", "")
    host = F.regexp_replace(host, r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*(.*)$", 1), r"^\?", "/?")
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(","), path)


def _rule_table(given: DataFrame) -> DataFrame:
    """(key, action, pattern); of a rule given twice the first action in the alphabet holds."""
    keyed = given.select(canonical_key(F.col("pattern")).alias("key"), "pattern", "action").filter("key is not null")
    return keyed.groupBy("key").agg(F.min(F.struct("action", "pattern")).alias("x")).select("key", "x.action", "x.pattern")


def match(pages: DataFrame, rules=RULES, url_col: str = "url") -> DataFrame:
    """``pages`` with url_key, action and rule (its pattern; both NULL without one) and depth, the number of rules that hold.

    ``rules``: (pattern, action) pairs, or a table of pattern and action for lists of any length. Keys are cut into ranges
    of about equal size by bounds from a bounded sample (where they lie changes no row), so a host with a great share of
    the pages is spread over many tasks; a rule goes to each range that its interval meets.

    - NULL url: no key, no rule, depth 0. The empty url has the key "," and only rules of an empty host hold for it.
    - Very long urls: whole. Characters compare by code point.
    - Ties: patterns of one key are one rule; of their actions the first in the alphabet holds.
    - Repeated rows: each is matched. No rules, or no pages: no match, or an empty result.
    - Extra columns stay; those named url_key, action, rule or depth are replaced.
    """
    spark = pages.sparkSession
    table = _rule_table(rules if isinstance(rules, DataFrame) else spark.createDataFrame([(str(p), str(a)) for p, a in rules], "pattern string, action string"))
    names = [c for c in pages.columns if c.lower() not in ("url_key", "action", "rule", "depth")]
    kind, part, key, act, own = fresh(pages, "kind", "part", "key", "action", "rule")
    keyed = materialize(pages.select(*[q(c) for c in names], canonical_key(q(url_col)).alias(key)))
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    count = keyed.count()
    some = keyed.filter(q(key).isNotNull()).sample(min(1.0, parts * PER_BOUND / max(1, count)), seed=3).select(key)
    sample = sorted(r[0].encode() for r in some.collect())
    bounds = [sample[int(i)] for i in np.linspace(0, len(sample), parts + 1)[1:-1]] if sample else []
    bounds = sorted(set(bounds))
    shared = spark.sparkContext.broadcast(np.array(bounds, object))

    @F.pandas_udf("int")
    def place(keys):
        import pandas as pd

        return pd.Series(np.searchsorted(shared.value, np.array([k.encode() for k in keys], object), "right").astype(np.int32))

    points = keyed.withColumn(part, F.when(q(key).isNull(), F.lit(-1)).otherwise(place(F.coalesce(q(key), F.lit("")))))
    spans = table.select(F.explode(F.sequence(place("key"), place(F.concat("key", F.lit(_LAST))))).alias(part), F.col("key").alias(key), F.col("action").alias(act), F.col("pattern").alias(own))
    both = points.withColumn(kind, F.lit(1)).unionByName(spans.withColumn(kind, F.lit(0)), allowMissingColumns=True)
    sorted_rows = both.repartition(parts, part).sortWithinPartitions(part, key, kind)
    schema = keyed.select(*[q(c) for c in names], q(key).alias("url_key")).schema.add("action", "string").add("rule", "string").add("depth", "integer")

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[tuple[str, str, str]] = []
        last = None
        for batch in lean(batches):
            keys, kinds, parts, actions, rules = (batch.column(c).to_pylist() for c in (key, kind, part, act, own))
            taken, found = [], []
            for i, k in enumerate(keys):
                if parts[i] != last:
                    stack, last = [], parts[i]
                if k is None:
                    taken.append(i)
                    found.append((None, None, 0))
                    continue
                while stack and not k.startswith(stack[-1][0]):
                    stack.pop()
                if kinds[i]:
                    taken.append(i)
                    found.append((*stack[-1][1:], len(stack)) if stack else (None, None, 0))
                else:
                    stack.append((k, actions[i], rules[i]))
            rows = batch.take(pa.array(taken, pa.int64()))
            yield pa.record_batch([*(rows.column(c) for c in names), rows.column(key), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.string()), pa.array([f[2] for f in found], pa.int32())], names=[*names, "url_key", "action", "rule", "depth"])

    return sorted_rows.mapInArrow(sweep, schema)


def filter_urls(pages: DataFrame, rules=RULES, url_col: str = "url") -> DataFrame:
    """``pages`` without those that a "block" rule decides; cases are those of ``match``. Only keys are swept; the pages
    themselves move only if the blocked keys are too many to be sent to all of them."""
    blocked = match(pages.select(q(url_col).alias("u")), rules, "u").filter("action = 'block'").select("url_key").distinct()
    key, = fresh(pages, "key")
    kept = pages.withColumn(key, canonical_key(q(url_col))).join(join_side(blocked.select(F.col("url_key").alias(key))), key, "left_anti")
    return kept.select(*[q(c) for c in pages.columns])


def _sql_key(x: str) -> str:
    rest = f"regexp_replace(regexp_replace(regexp_replace(trim({x}), '^[A-Za-z][A-Za-z0-9+.\\-]*:', ''), '^//', ''), '#.*$', '')"
    host = f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract({rest}, '^([^/?]*)', 1)), '^.*@', ''), ':[0-9]*$', ''), '\\.+$', ''), '^www\\.', '')"
    path = f"regexp_replace(regexp_extract({rest}, '^[^/?]*(.*)$', 1), '^\\?', '/?')"
    return f"array_to_string(list_reverse(string_split({host}, '.')), ',') || ',' || {path}"


SQL = f"""
WITH r AS (SELECT pattern, action, {_sql_key('pattern')} AS k FROM (VALUES {', '.join(f"('{p}', '{a}')" for p, a in RULES)}) v(pattern, action)),
p AS (SELECT page_id, url, {_sql_key('url')} AS url_key FROM pages)
SELECT page_id, url, url_key, arg_max(action, length(k)) AS action, arg_max(pattern, length(k)) AS rule, CAST(count(k) AS INTEGER) AS depth
FROM p LEFT JOIN r ON starts_with(p.url_key, r.k) GROUP BY page_id, url, url_key
"""
