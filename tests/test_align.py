import collections

import pytest
from hypothesis import given, settings
from hypothesis import strategies as some
from pyspark.sql import functions as F

from graphemica.functions import align as al
from graphemica.operators import datasets as ds

SUBONLY = [
    ("ACGTACGT", "AACGTACGT", "AACGTACGT", 1), ("AACGTACGT", "ACGTACGT", "ACGTACGT", 1), ("ACACACAC", "ACACAGAG", "ACACACAC", 2),
    ("ACACACAC", "TTTACACAGAG", "TTTACACACAC", 5), ("ACACACACATTT", "ACACAGAGA", "ACACACACA", 5), ("TTTACACACAC", "ACACAGAG", "ACACACAC", 5),
    ("TTTTAAAAAGAAAAA", "AAAAACAAAAATTTT", "AAAAAGAAAAATTTT", 9), ("AAAAAGAAAAATTTT", "TTTTAAAAACAAAAA", "TTTTAAAAAGAAAAA", 9),
]
DISTANCES = [
    ("ACGT", "ACGT", 0), ("ACGTACGT", "AACGTACGT", 1), ("AGGTACGT", "AACGTACGT", 2), ("AGGTACGTT", "AACGTACGT", 3), ("A" + "ACCT" * 7, "ACGT" * 7, 8),
    ("ACCT" * 7, "ACGT" * 7 + "G", 8), ("G" + "ACCT" * 7, "ACGT" * 7 + "G", 9), ("GG" + "AC" * 5, "AC" * 5 + "TT", 4), ("ACGG", "TTAC", 4),
]


def pairs(spark, rows):
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(rows)], "i int, src string, tgt string")


def test_positional(spark):
    df = pairs(spark, [("ACGT", "ACGT"), ("ACGTT", "ACGTA"), ("ACGT", "AAAA"), ("", ""), ("A", "AC"), (None, "A")])
    assert [r[0] for r in df.orderBy("i").select(al.positional_cer(F.col("src"), F.col("tgt"))).collect()] == [0, 0.2, 0.75, None, None, None]
    with pytest.raises(Exception, match="unequal"):
        df.filter("i = 4").select(al.positional_cer(F.col("src"), F.col("tgt"), strict=True)).collect()


def test_edit_distances(spark):
    df = pairs(spark, [x[:2] for x in DISTANCES])
    assert [r[0] for r in df.orderBy("i").select(al.cer(F.col("src"), F.col("tgt"))).collect()] == [x[2] for x in DISTANCES]
    edge = pairs(spark, [("", ""), ("", "ab"), ("ab", "ac")])
    assert [r[0] for r in edge.orderBy("i").select(al.cer(F.col("src"), F.col("tgt"), normalize=True)).collect()] == [1.0, 1.0, 0.5]


@pytest.mark.parametrize("pred,gt,sub,ed", SUBONLY)
def test_substitution_only(pred, gt, sub, ed):
    steps = al.backtrace(pred, gt, "diagonal")
    assert "".join(gt[j] if op == "ins" else pred[i] for i, j, op in steps if op != "del") == sub


def test_substitution_only_column(spark):
    df = pairs(spark, [x[:2] for x in SUBONLY] + [("", "AC"), ("AC", ""), (None, "A")])
    out = [r[0] for r in df.orderBy("i").select(al.substitution_only(al.align(F.col("src"), F.col("tgt")))).collect()]
    assert out == [x[2] for x in SUBONLY] + ["AC", "", None]


def counts(spark, pred, gt):
    df = pairs(spark, [(pred, gt)]).withColumn("steps", al.align(F.col("src"), F.col("tgt")))
    return {(r.src_chr, r.tgt_chr): r.n for r in al.confusions(df).collect()}


def test_confusions(spark):
    assert counts(spark, "ACGTACGACA", "ACGTACGACA") == {("A", "A"): 4, ("C", "C"): 3, ("G", "G"): 2, ("T", "T"): 1}
    for pred in ("AACAGATA", "ACGTAAAA", "AAAAACGT"):
        there, back = counts(spark, pred, "ACGT"), counts(spark, "ACGT", pred)
        assert there["A", ""] == 4 and back == {(b, a): n for (a, b), n in there.items()}
    assert counts(spark, "TTTACACACAC", "ACACAGAG") == {("A", "A"): 4, ("C", "C"): 2, ("C", "G"): 2, ("T", ""): 3}


@pytest.mark.parametrize("a,b,ins,dele,sub", [("12345", "1234", 0, 1, 0), ("12345", "0012345", 2, 0, 0), ("xxx12345", "12345xxx", 3, 3, 0)])
def test_banded(a, b, ins, dele, sub):
    n = collections.Counter(op for _, _, op in al.backtrace(a, b, "gap", band=5))
    assert (n["ins"], n["del"], n["sub"]) == (ins, dele, sub)


@settings(max_examples=150, deadline=None)
@given(some.text("ACG", max_size=12), some.text("ACG", max_size=12), some.sampled_from(["diagonal", "gap"]))
def test_paths(a, b, first):
    steps = al.backtrace(a, b, first)
    assert "".join(a[i] for i, _, op in steps if op != "ins") == a and "".join(b[j] for _, j, op in steps if op != "del") == b
    import numpy as np

    d = al.edit_distances([al.codes(a)], [al.codes(b)])[0]
    slow = {}
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            slow[i, j] = i or j if not (i and j) else min(slow[i - 1, j] + 1, slow[i, j - 1] + 1, slow[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
    cost = sum(op != "match" for _, _, op in steps)
    assert d == slow[len(a), len(b)] and (cost == d)


def test_substrings(spark):
    cases = [("ACGT", "ZACGT", ["ZA", "C", "G", "T"]), ("ACGT", "ACZGT", ["A", "CZ", "G", "T"]), ("ACGT", "AGT", ["A", "", "G", "T"]), ("", "A", None), ("A" * 99, "A", None)]
    df = pairs(spark, [(a, b) for a, b, _ in cases])
    out = [r[0] for r in df.orderBy("i").select(al.align_substrings(F.col("src"), F.col("tgt"), 80)).collect()]
    assert [None if o is None else [p.tgt for p in o] for o in out] == [want if a != "ACGT" or b != "ZACGT" else ["ZA", "C", "G", "T"] for a, b, want in cases]


def test_many_to_more(spark):
    df = pairs(spark, [("ACGT", "ACGAGAGT"), ("ACGT", "ZACGT"), ("ACXT", "ACGT"), ("A", "A" * 200)])
    assert ds.many_to_more(df, letters="ACGTZ", band=80).count() == 2 and ds.many_to_more(df, letters="ACGTZ").count() == 3
    assert ds.many_to_more(df, letters="ACGTZ", start_insertions=False).count() == 2


def test_distort(spark):
    df = spark.createDataFrame([(i, "ACGT" * 250) for i in range(20)], "k int, text string")
    cdf = spark.createDataFrame([("A", "A", 0.5), ("A", "C", 1.0), ("C", "C", 1.0), ("G", "T", 1.0)], "src_chr string, tgt_chr string, cdf double")
    text = "".join(r.text for r in ds.distort(df, cdf, "k").collect())
    n = collections.Counter(text)
    assert abs(n["A"] / len(text) - 0.125) < 0.01 and abs(n["C"] / len(text) - 0.375) < 0.01 and n["T"] == len(text) // 4 and n["�"] == len(text) // 4
    assert ds.distort(df, cdf, "k").exceptAll(ds.distort(df.repartition(3), cdf, "k")).isEmpty()


def test_full_cer(spark):
    df = pairs(spark, [("ACGT", "ACGT"), ("ACT", "ACGT"), ("ACCGT", "ACGT"), ("AXGT", "ACGT"), ("zzzzzzzzz", "A"), ("x", "")])
    r = ds.full_cer(df).first()
    assert (r.n_lines, r.n_dropped, r.distance, r.deletions, r.insertions, r.substitutions) == (6, 2, 3, 1, 1, 1) and r.cer == 3 / 16


def test_dataset_cer(spark):
    df = pairs(spark, [("ACGT", "ACGA"), ("AC", "ACG"), ("", "")])
    assert ds.dataset_cer(df).first()[0] == pytest.approx(1 - 3 / 7)
    assert ds.dataset_cer(df, by_edits=True).first()[0] == pytest.approx(2 / 7)
    assert ds.dataset_cer(df.limit(0)).first()[0] == 1.0


def test_tokens_and_rendering(spark):
    df = pairs(spark, [("a b c", "a c"), ("x", "x")])
    words = lambda c: F.split(c, " ")
    assert [r[0] for r in df.orderBy("i").select(al.token_distance(words(F.col("src")), words(F.col("tgt")))).collect()] == [1, 0]
    shown = df.orderBy("i").select(al.render(al.align(F.col("src"), F.col("tgt"))).alias("r"), al.render_errors(F.col("src"), F.col("src"))).first()
    assert "\x1b[31m" in shown.r and "\x1b[31m" not in shown[1]


def slow_steps(a, b, first, band):
    far = 1 << 28
    d = {(-1, -1): far}
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            if band is None or abs(i - j) <= band:
                d[i, j] = i or j if not (i and j) else min(d.get((i - 1, j), far) + 1, d.get((i, j - 1), far) + 1, d.get((i - 1, j - 1), far) + (a[i - 1] != b[j - 1]))
    i, j, out = len(a), len(b), []
    while i or j:
        up, left, diagonal, here = (d.get(x, far) for x in ((i - 1, j), (i, j - 1), (i - 1, j - 1), (i, j)))
        if not i or not j:
            op = "del" if i else "ins"
        elif first == "diagonal":
            op = "sub" if diagonal <= min(up, left) else "del" if up <= left else "ins"
        else:
            op = "del" if here == up + 1 else "ins" if here == left + 1 else "sub"
        i, j = i - (op != "ins"), j - (op != "del")
        out.append((i, j, "match" if op == "sub" and a[i] == b[j] else op))
    return out[::-1]


@pytest.mark.parametrize("cells", [1 << 25, 300])  # whole tables, and tables of which some rows are kept
@pytest.mark.parametrize("first", ["diagonal", "gap"])
def test_paths_of_many_pairs(monkeypatch, cells, first):
    import random

    monkeypatch.setattr(al, "_CELLS", cells)
    draw = random.Random(7)
    near = lambda t: "".join(draw.choice([c, c, c, c, "", "x", c + "y"]) for c in t)
    texts = ["".join(draw.choices("abc", k=draw.randint(0, 30))) for _ in range(120)]
    both = [(t, near(t) if k % 2 else draw.choice(texts)) for k, t in enumerate(texts)]
    for band in (None, 6):
        some_pairs = [(a, b) for a, b in both if band is None or abs(len(a) - len(b)) <= band]
        got = al.paths([al.codes(a) for a, _ in some_pairs], [al.codes(b) for _, b in some_pairs], first, band)
        assert [[(x, y, al._OPS[o]) for x, y, o in zip(*(v.tolist() for v in f))] for f in got] == [slow_steps(a, b, first, band) for a, b in some_pairs]


def test_long_texts_take_little_memory():
    import tracemalloc

    a = "The quick brown fox jumps over the lazy dog. " * 300
    b = a[:4000] + "XY" + a[4100:9000] + "z" + a[9000:]
    tracemalloc.start()
    (_, _, op), = al.paths([al.codes(a)], [al.codes(b)], "diagonal")
    assert 90 <= int((op != 0).sum()) <= 103 and tracemalloc.get_traced_memory()[1] < 64 << 20
    tracemalloc.stop()


def test_tokens_of_any_length(spark):
    long = [str(i) for i in range(3000)]
    df = spark.createDataFrame([(long, [*long[:100], "x", *long[101:]]), (None, ["a"]), ([], ["a", "b"])], "a array<string>, b array<string>")
    assert [r[0] for r in df.select(al.token_distance(F.col("a"), F.col("b"))).collect()] == [1, None, 2]


def test_work_follows_the_distance():
    import random
    import time

    draw = random.Random(1)
    texts = ["".join(draw.choices("abcdefghijklmnopqrst", k=1500)) for _ in range(200)]
    both = [(t, t.replace("e", "") if k % 3 == 0 else t.replace("n", "\x01") if k % 3 == 1 else t.replace("n", "n\x01")) for k, t in enumerate(texts)]
    xs, ys = [al.codes(a) for a, _ in both], [al.codes(b) for _, b in both]
    begin = time.process_time()
    assert [int((op != 0).sum()) for _, _, op in al.paths(xs, ys, "diagonal")] == [t.count("e" if k % 3 == 0 else "n") for k, t in enumerate(texts)]
    assert time.process_time() - begin < 3  # the filled table took 35 ms a pair of a third of that length


def test_confusions_counted_in_batches(spark):
    rows = [(i % 2, a, b) for i, (a, b, *_) in enumerate(SUBONLY)] + [(0, None, "A"), (1, "", "AC"), (1, "AC", ""), (None, "é中😀", "é😀")]
    df = spark.createDataFrame(rows, "by int, src string, tgt string")
    slow = al.confusions(df.withColumn("steps", al.align(F.col("src"), F.col("tgt"))), "steps", "by")
    assert sorted(map(tuple, al.edit_confusions(df, "by").collect()), key=str) == sorted(map(tuple, slow.collect()), key=str)
    assert al.edit_confusions(df.limit(0), "by").count() == 0


def test_substituted_is_substitution_only(spark):
    rows = [x[:2] for x in SUBONLY] + [("", "AC"), ("AC", ""), ("", ""), (None, "A"), ("A", None), ("x😀y", "é😀")]
    df = pairs(spark, rows).orderBy("i")
    assert [r[0] for r in df.select(al.substituted(F.col("src"), F.col("tgt"))).collect()] == [r[0] for r in df.select(al.substitution_only(al.align(F.col("src"), F.col("tgt")))).collect()]


def test_edit_ops_within(spark):
    df = pairs(spark, [("ACGT", "ACGT"), ("ACT", "ACGT"), ("zzzz", "A"), (None, "A"), ("A", None), ("", "")]).orderBy("i")
    ops = [r[0] for r in df.select(al.edit_ops(F.col("src"), F.col("tgt"), most=F.length("tgt") - 2)).collect()]
    assert [o and tuple(o) for o in ops] == [(4, 0, 0, 0), (3, 0, 0, 1), None, None, None, None]
    assert [r[0] for r in df.select(al.within(F.col("src"), F.col("tgt"), F.length("tgt") - 2)).collect()] == [0, 1, -1, None, None, 0]


def test_dataset_cers_in_one_pass(spark):
    rows = [("ACGT", "ACGA"), ("AC", "ACG"), ("", ""), (None, "AC"), ("é😀", "é😀")]
    both = ds.dataset_cers(pairs(spark, rows)).first()
    assert (both.cer, both.edit_cer) == (pytest.approx(1 - 5 / 11), pytest.approx(1 - 7 / 11))
    assert ds.dataset_cer(pairs(spark, rows)).first()[0] == both.cer and ds.dataset_cer(pairs(spark, rows), by_edits=True).first()[0] == both.edit_cer


def test_postcorrection_pairs(spark):
    df = pairs(spark, [("ACGT" * 20, "ACGA" + "ACGT" * 19), ("ACGT" * 20 + "T", "ACGT" * 20), ("A", "A" * 60), ("A", "A"), (None, "A" * 60)])
    assert {r.i: r.sub for r in ds.postcorrection_pairs(df).collect()} == {0: "ACGT" * 20, 1: "ACGT" * 20}


def test_edit_totals(spark):
    df = pairs(spark, [("AC", "ACG"), (None, "AC"), ("A", None)]).withColumn("by", F.lit("x"))
    assert [tuple(r) for r in ds.edit_totals(df, "by").collect()] == [("x", 1, 5)]


def test_tokens_may_be_missing(spark):
    df = spark.createDataFrame([(["a", None], ["a", "b"]), ([None], [None]), ([], []), (["x"] * 300, ["y"] * 200), (["a"], None)], "a array<string>, b array<string>")
    assert [r[0] for r in df.select(al.token_distance(F.col("a"), F.col("b"))).collect()] == [1, 0, 0, 300, None]
