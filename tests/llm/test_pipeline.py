import collections
import math
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_operators import DOCS, lines_by_hand, mix_by_hand, sentences

import __spark_entry__
import corpus_pipeline
from graphemica.llm import common, mixing, quality_rules, simhash


def rules_by_hand(rows):
    norm = lambda x: re.sub(r"[\W_]+", " ", x.lower()).strip()
    hosts, seen = collections.defaultdict(set), collections.defaultdict(set)
    for i, t, h in rows:
        hosts[h].add(i)
        for x in (t or "").split("\n"):
            seen[h, norm(x)].add(i)
    out = []
    for i, t, h in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (norm(x) and len(seen[h, norm(x)]) > max(quality_rules.MIN_DOCS, quality_rules.MAX_SHARE * len(hosts[h])))]
        size = lambda ls: sum(len(x.strip(" ")) for x in ls)
        if len(kept) == len(lines):
            out.append((i, t, h))
        elif size(kept) >= quality_rules.MIN_KEPT * size(lines):
            out.append((i, "\n".join(kept), h))
    return out


def copies_by_hand(rows):
    f, n = simhash.fingerprints(common.Words(pa.array([t for _, t, _ in rows])), len(rows))
    label = list(range(len(rows)))
    for _ in range(len(rows)):
        new = list(label)
        for i in range(len(rows)):
            for j in range(len(rows)):
                if n[i] and n[j] and int(np.bitwise_count(f[i] ^ f[j]).sum()) <= simhash.MAX_BITS and min(n[i], n[j]) >= simhash.MIN_RATIO * max(n[i], n[j]) - 1e-6:
                    new[i] = min(new[i], label[j])
        if new == label:
            break
        label = new
    best = {}
    for i, r in enumerate(rows):
        best[label[i]] = min(best.get(label[i], r[0]), r[0])
    return [r for i, r in enumerate(rows) if best[label[i]] == r[0]]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = np.random.default_rng(21)
    base = sentences(22, 60, size=10)
    rows = []
    for i, t in enumerate(base):
        x = t.split()
        body = "\n".join(" ".join(x[k : k + 15]) for k in range(0, len(x), 15))
        rows.append((i, ("Subscribe to our letter now\n" if i % 4 == 0 else "") + body, "ab"[i % 5 == 0]))
    for i in range(12):
        x = base[i].replace("w1 ", "other ").split()
        rng.shuffle(x)
        rows.append((100 + i, " ".join(x), "b"))  # a near copy whose lines are others
    rows += [(200, rows[3][1], "a"), (201, "", "a"), (202, None, "b"), (203, "Subscribe to our letter now", "a")]
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(i, t, "en", h, len(t or "")) for i, t, h in rows], DOCS).write.parquet(f"{path}/documents.parquet")
    return str(path), rows


def test_stages(spark, folder):
    path, rows = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    by_hand = {"quality_rules": rules_by_hand}
    by_hand["line_dedup"] = lambda rs: [(i, t, h) for i, t, h in ((i, lines_by_hand([(a, b) for a, b, _ in rs], 0.9).get(i, 0), h) for i, _, h in rs) if t != 0]
    by_hand["near_dedup"] = copies_by_hand
    for name, stage in corpus_pipeline.STAGES[:3]:
        columns, before = docs.columns, rows
        docs, rows = stage(spark, docs, path), by_hand[name](rows)
        assert docs.columns == columns
        assert sorted(((r.doc_id, r.text, r.source) for r in docs.collect()), key=str) == sorted(rows, key=str)
        assert len(rows) < len(before)
    weights = {r.doc_id: r.w for r in docs.select("doc_id", mixing.quality_weight(F.col("text")).alias("w")).collect()}
    assert set(weights.values()) <= {1.0, 0.05} or all(0.05 <= w <= 1 for w in weights.values())
    name, stage = corpus_pipeline.STAGES[3]
    mixed = stage(spark, docs, path)
    plan = mixing.mix_plan(docs)
    assert collections.Counter(r.doc_id for r in mixed.collect()) == {r.doc_id: r.copies for r in plan.collect() if r.copies}


def test_run(spark, folder):
    path, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, path)
    want = collections.Counter({(r.doc_id, s): r.n for r in docs.filter("text is not null").groupBy("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("size")).agg(F.count("*").alias("n")).collect() for s in ((1, 2) if r.size else (1,))})
    out = __spark_entry__.queries()["pipeline"](spark, path).collect()
    assert collections.Counter((r.doc_id, r.sample) for r in out) == want
    assert all(r.lossless and r.n_tokens == len(r.ids) and math.isfinite(r.log_prob) for r in out)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "mixing", "sentencepiece"]


def test_edges_of_every_stage(spark, tmp_path):
    long = " ".join(f"word{i % 977}x{i}" for i in range(40_000))
    rows = [(1, None), (2, ""), (3, "\n\n"), (4, "one short text"), (4, "one short text"), (None, "a text without an id"), (5, long), (6, "x" * 100_000), (7, "... !!! ..."), (8, "another text, of some words"), (9, "another text, of some words")]
    made = spark.createDataFrame([(i, t, None, None if i == 8 else "s", None) for i, t in rows], DOCS)
    clash = made.withColumns({c: F.lit("clash") for c in ("d", "rh", "t", "g", "n", "k", "__d", "__rh", "__cut", "__copy", "__lines", "__host", "shard", "slice", "cut")})
    left = {"quality_rules": 11, "line_dedup": 10, "near_dedup": 9}
    for docs in (made, clash):
        for name, stage in corpus_pipeline.STAGES:
            empty = stage(spark, docs.limit(0), str(tmp_path))
            assert empty.count() == 0
            out = stage(spark, docs, str(tmp_path))
            if name == "sentencepiece":
                assert {r.doc_id for r in out.collect()} <= {None, *range(1, 9)} and out.columns == empty.columns
                break
            assert out.columns == docs.columns == empty.columns
            docs = common.materialize(out)
            kept = [(r.doc_id, r.text) for r in docs.collect()]
            if name in left:
                assert len(kept) == left[name]
                assert {(1, None), (2, ""), (3, "\n\n"), (5, long), (7, "... !!! ...")} <= set(kept)
            assert set(kept) <= set(rows) and kept


def test_queries_are_registered():
    names = list(__spark_entry__.queries())
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10 and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)


def test_mixing_by_weight(spark, folder):
    path, rows = folder
    rows = [r for r in rows if r[1]]
    plan = mixing.mix_plan(spark.read.parquet(f"{path}/documents.parquet").filter("text <> ''"), weight=F.lit(1.0))
    assert {(r.source, r.doc_id): r.copies for r in plan.collect() if r.copies} == mix_by_hand(rows, None, 1.0, 1.0)
