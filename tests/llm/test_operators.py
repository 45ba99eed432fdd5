import collections
import math
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as some
from pyspark.sql import functions as F

from graphemica.llm import common, components, embedding_dedup, html_extract, line_dedup, mixing, quality_classifier, quality_rules, sentencepiece, simhash, suffix_dedup, units, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile("[a-z0-9\x80-\U0010ffff]+")


def words(text):
    return WORD.findall((text or "").lower())


def table(spark, rows, source="s"):
    """documents from (id, text) or (id, text, source), with extra columns whose names clash with those used inside."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else source, len(r[1] or "")) for r in rows]
    df = spark.createDataFrame(full, DOCS)
    return df.withColumns({c: F.lit(7) for c in ("d", "rh", "h", "g", "n", "k", "t", "__d", "__kept", "__lines", "score", "ls", "slice", "copies")})


def sentences(seed, n, size=12, vocabulary=4000):
    rng = np.random.default_rng(seed)
    return [" ".join(f"w{x}" for x in rng.zipf(1.3, size * 9) % vocabulary) for _ in range(n)]


EDGE = [(1, None), (2, ""), (3, "\n\n"), (4, "word"), (4, "word"), (None, "null id"), (5, "the same text twice over"), (6, "the same text twice over"), (7, "... !!! ...")]


@pytest.fixture(scope="module")
def edge(spark):
    return table(spark, [*EDGE, (8, "long " * 60_000), (9, "x" * 200_000)])


# --- words ----------------------------------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(some.lists(some.text(max_size=40), max_size=6))
def test_words(texts):
    w = common.Words(pa.array(texts, pa.string()))
    low = [t.as_py() for t in __import__("pyarrow.compute", fromlist=["x"]).utf8_lower(pa.array(texts, pa.string()))]
    assert [bytes(w.data[a:z]).decode() for a, z in zip(w.start, w.end)] == [x for t in low for x in WORD.findall(t)]
    by = collections.defaultdict(set)
    for h, x in zip(w.hash.tolist(), (x for t in low for x in WORD.findall(t))):
        by[h].add(x)
    assert all(len(v) == 1 for v in by.values()) and len(by) == len({x for t in low for x in WORD.findall(t)})


# --- 1 mixing -------------------------------------------------------------------------------------------------------


def mix_by_hand(rows, targets, ratio, weight):
    import hashlib

    n = lambda t: len(re.findall("[^ \t\n\r]+", t or ""))
    by = collections.defaultdict(list)
    for i, t, g in rows:
        u = (int(hashlib.md5(f"{mixing.SEED}:{'' if i is None else i}".encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)
        by[g or ""].append((-math.log(u) / weight, "" if i is None else str(i), n(t), i))
    total = {g: sum(r[2] for r in v) for g, v in by.items()}
    share = {g: targets.get(g, 0.0) if targets else total[g] ** 0.5 for g in by}
    out = collections.Counter()
    for g, v in by.items():
        if share[g] <= 0:
            continue
        budget = math.floor(ratio * sum(total.values()) * (share[g] / sum(share.values())))
        epochs = budget // total[g] if total[g] else 0
        rest = budget - epochs * total[g]
        for r in v:
            upto = sum(x[2] for x in v if x[:3] <= r[:3])
            out[g, r[3]] += int(epochs + (upto <= rest))
    return {k: v for k, v in out.items() if v}


@pytest.mark.parametrize("targets,ratio,slices", [(None, 1.0, 4096), ({"a": 3, "b": 1}, 0.7, 4), ({"b": 1}, 2.5, 64), ({"none": 1}, 1.0, 8)])
def test_mixing(spark, targets, ratio, slices):
    rows = [(i, t, "ab"[i % 3 == 0]) for i, t in enumerate(sentences(1, 60, size=2))] + [(99, None, "a"), (98, "", "b"), (97, "x y z", "a"), (97, "x y z", "a"), (None, "q", None)]
    docs = table(spark, rows)
    weight = F.lit(0.5)
    plan = mixing.mix_plan(docs, targets, ratio, weight=weight, slices=slices)
    got = collections.Counter()
    for r in plan.collect():
        got[r.source or "", r.doc_id] += r.copies
    assert {k: v for k, v in got.items() if v} == mix_by_hand(rows, targets, ratio, 0.5)
    mixed = mixing.mix(docs, targets, ratio, weight=weight, slices=slices)
    assert mixed.columns == docs.columns
    assert collections.Counter((r.source or "", r.doc_id) for r in mixed.collect()) == {k: v for k, v in got.items() if v}


def test_mixing_edge(spark, edge):
    assert mixing.mix_plan(edge).count() == edge.count() and mixing.mix(edge.limit(0)).count() == 0 and mixing.mix_plan(edge.limit(0)).count() == 0
    assert mixing.mix(edge).columns == edge.columns


def test_quality_weighs_the_draw(spark):
    rows = [(i, ("a b c d " if i % 2 else "$$ %% && ## ") * 3) for i in range(2000)]
    plan = mixing.mix_plan(table(spark, rows), ratio=0.2).filter("copies > 0")
    assert plan.filter("doc_id % 2 = 1").count() > 0.9 * plan.count() > 100


# --- 2 quality classifier -------------------------------------------------------------------------------------------


def test_classifier(spark):
    rng = np.random.default_rng(3)
    good = [(i, s.replace("w", "o").translate(str.maketrans("0123456789", "abcdefghij"))) for i, s in enumerate(sentences(4, 300))]
    bad = [(1000 + i, " ".join(f"${x}%!" for x in rng.integers(0, 99, 60))) for i in range(100)]
    docs = table(spark, good + bad)
    labels = spark.createDataFrame([(i, int(i < 1000)) for i, _ in good + bad if i % 2], "doc_id long, quality int")
    model = quality_classifier.fit(docs, labels)
    rows = quality_classifier.classify(docs, model).collect()
    held = [r for r in rows if r.doc_id % 2 == 0]
    assert np.mean([r.keep == (r.doc_id < 1000) for r in held]) > 0.97
    x, y = quality_classifier.labelled(docs, labels)
    by = {r.doc_id: r.score for r in rows}
    ids = sorted(i for i, _ in good + bad if i % 2)
    assert np.allclose([by[i] for i in ids], model.score(x), atol=2e-6)
    assert 0 < len(model.rules) < 60 and quality_classifier.fit(docs, labels) == model


def test_rules_and_lasso_by_hand(spark):
    rng = np.random.default_rng(31)
    x = np.round(rng.normal(size=(400, 4)), 2)
    y = ((x[:, 0] > 0.3) & (x[:, 2] <= 0.5) | (rng.random(400) < 0.1)).astype(float)
    model = quality_classifier.train(x, y)
    assert model.rules
    columns = np.array([[all((v[k] > at) == above for k, above, at in r.terms) for v in x.tolist()] for r in model.rules], float).T
    z = model.bias + columns @ np.array(model.weights)
    assert np.allclose(model.score(x), 1 / (1 + np.exp(-z)))
    # the optimum of the mean logistic loss under the L1 norm of standardised rules: slopes of the size of the penalty
    s = (columns - columns.mean(0)) / columns.std(0)
    slope = s.T @ (1 / (1 + np.exp(-z)) - y) / len(y)
    w = np.array(model.weights) * columns.std(0)
    big = np.abs(w) > 1e-3
    assert big.any() and np.allclose(slope[big], -quality_classifier.PENALTY * np.sign(w[big]), atol=5e-4) and (np.abs(slope) < quality_classifier.PENALTY + 5e-4).all()
    df = spark.createDataFrame([tuple(map(float, v)) for v in x], "a double, b double, c double, d double")
    got = [r[0] for r in df.select(model.column([F.col(c) for c in "abcd"])).collect()]
    assert np.allclose(got, model.score(x))


def test_classifier_clashing_columns(spark):
    docs = table(spark, [(i, f"{'good words here' if i % 2 else '$$$ %%% |||'} {i}") for i in range(60)]).withColumns({c: F.lit("clash") for c in ("i", "y", "log_chars", "__score")})
    labels = spark.createDataFrame([(i, i % 2, "z") for i in range(60)], "doc_id long, quality int, i string")
    out = quality_classifier.classify(docs, quality_classifier.fit(docs, labels)).collect()
    assert len(out) == 60 and all(r.keep == bool(r.doc_id % 2) for r in out)


def test_classifier_edge(spark, edge):
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = quality_classifier.fit(edge, none)
    out = quality_classifier.classify(edge, model)
    assert out.columns == ["doc_id", "score", "keep"] and out.count() == edge.count() and {r.score for r in out.collect()} == {0.5}
    assert quality_classifier.classify(edge.limit(0), model).count() == 0
    one = spark.createDataFrame([(4, 1), (4, 1), (5, None), (None, 0), (777, 0)], "doc_id long, quality int")
    assert quality_classifier.classify(edge, quality_classifier.fit(edge, one)).filter("not keep").count() == 0


# --- 3 quality rules ------------------------------------------------------------------------------------------------


def test_quality_rules(spark):
    rows = [(i, f"Menu | Home!\nunique body of text number {i} goes on\nmenu  home", "a") for i in range(8)]
    rows += [(20 + i, f"Menu home\nother {i}", "b") for i in range(3)] + [(50, "menu home\nx", "a")]
    got = {r.doc_id: r.text for r in quality_rules.apply_quality_rules(table(spark, rows)).collect()}
    assert got[0] == "unique body of text number 0 goes on" and got[20] == "Menu home\nother 0" and 50 not in got and len(got) == 11


def test_quality_rules_edge(spark, edge):
    out = quality_rules.apply_quality_rules(edge)
    assert out.columns == edge.columns and out.exceptAll(edge).isEmpty() and out.count() == edge.count()
    assert quality_rules.apply_quality_rules(edge.limit(0)).count() == 0
    same = table(spark, [(1, "one line of text\nanother")] * 30)
    assert quality_rules.apply_quality_rules(same).count() == 30  # one document, however often it is repeated
    nulls = table(spark, [(i, f"shared line\nbody {i} of this very document", None) for i in range(9)])
    assert {r.text[:4] for r in quality_rules.apply_quality_rules(nulls).collect()} == {"body"}


# --- 4 HTML extraction ----------------------------------------------------------------------------------------------


def extract_by_hand(lines, block, surge):
    sums = [sum(len(x) for x in lines[i : i + block]) for i in range(len(lines))]
    out, inside = [], False
    for line, s in zip(lines, sums, strict=True):
        inside = s > 0 and (inside or s > surge)
        if inside and line:
            out.append(line)
    return "\n".join(out)


def test_html(spark):
    rng = np.random.default_rng(5)
    pages = []
    for i in range(60):
        parts = ["<p>" + "t" * int(n) + "</p>" if k else "<div></div>" * int(n % 5) for k, n in zip(rng.integers(0, 3, 30), rng.integers(0, 150, 30), strict=True)]
        pages.append((i, "<html><head><title>x</title></head><body>" + "".join(parts) + "</body></html>"))
    df = spark.createDataFrame(pages, "page_id long, html string").withColumn("Text", F.lit("old")).withColumn("lines", F.lit(1))
    assert html_extract.extract(df).columns == ["page_id", "lines", "text"]
    for block, surge in ((2, 120), (3, 90), (1, 10)):
        lines = {r.page_id: r.ls for r in df.select("page_id", html_extract.html_lines(F.col("html")).alias("ls")).collect()}
        got = {r.page_id: r.text for r in html_extract.extract(df, block, surge, span=None).collect()}
        assert got == {i: extract_by_hand(x, block, surge) for i, x in lines.items()} and any(got.values())


def span_by_hand(lines, block, surge, span):
    out, part, gap = [], [], 0
    for line in [*lines, *[""] * block]:
        gap = 0 if line else gap + 1
        if line:
            part.append(line)
        elif gap == block:
            first = next((i for i in range(len(part)) if sum(len(x) for x in part[i : i + span]) > surge), len(part))
            out, part = out + part[first:], []
    return "\n".join(out)


def test_html_short_paragraphs(spark):
    short = [f"Paragraph {i} of about fifty characters, a short one." for i in range(6)]
    items = [f"Item {i}, one of some forty-five characters." for i in range(8)]
    tag = lambda name, texts: "".join(f"<{name}>{x}</{name}>" for x in texts)
    around = lambda body: f"<nav><ul>{tag('li', ['Home', 'News', 'Help'])}</ul></nav><div></div><article>{body}</article><footer>foot</footer>"
    bodies = [tag("p", short), f"<ul>{tag('li', items)}</ul>", tag("h1", ["A title"]) + tag("p", ["Small one.", "long " * 40])]
    pages = list(enumerate([*map(around, bodies), None, ""]))
    rng = np.random.default_rng(6)
    for i in range(40):
        pages.append((10 + i, "".join("<p>" + "t" * int(n) + "</p>" if k else "<br>" * int(n % 5) for k, n in zip(rng.integers(0, 4, 30), rng.integers(0, 90, 30), strict=True))))
    df = spark.createDataFrame(pages, "page_id long, html string")
    got = {r.page_id: r.text for r in html_extract.extract(df, span=3).collect()}
    assert [got[i] for i in range(5)] == ["\n".join(short), "\n".join(items), "A title\nSmall one.\n" + ("long " * 40).strip(), None, ""]
    lines = {r.page_id: r.ls for r in df.select("page_id", html_extract.html_lines(F.col("html")).alias("ls")).collect()}
    for block, surge, span in ((2, 120, 3), (3, 90, 2), (1, 60, 4)):
        got = {r.page_id: r.text for r in html_extract.extract(df, block, surge, span=span).collect()}
        assert got == {i: None if x is None else span_by_hand(x, block, surge, span) for i, x in lines.items()} and any(got.values())


def test_html_markup(spark):
    body = "word " * 40
    html = f"""<nav><a href="x>y">Home</a></nav><div></div><article><p>{body}&amp; <b>bold</b>&nbsp;end</p><!-- no > --><script>if (a < b) "</p>";</script><p title='a>b' {"q='1' " * 3000}>after</p></article><div></div><footer>foot</footer>"""
    df = spark.createDataFrame([(1, html), (2, None), (3, ""), (4, "plain"), (5, "<p>" + "y" * 300_000), (5, "<b"), (6, "<!-- open " + body)], "page_id long, html string")
    got = [r.text for r in html_extract.extract(df).orderBy("page_id", F.length("html")).collect()]
    assert got[0].splitlines() == [f"{body}& bold end", "after"]
    assert got[1] is None and got[2:5] == ["", "", ""] and len(got[5]) == 300_000 and got[6].endswith(body.strip())
    assert html_extract.extract(df.limit(0)).count() == 0


def test_html_entities_and_head(spark):
    import html

    names = [f"&{k}" for k in html.entities.html5 if k[-1] == ";"]
    numbers = [f"&#{n};" for n in (0, 34, 65, 128, 150, 159, 233, 252, 8364, 55296, 65536, 128512, 1114111, 1114112)] + ["&#xe9;", "&#XFC;", "&#x1F600;", "&nosuchname;", "&amp;lt;", "&#38;amp;", "a&b;c", "&", "&;", "é & ü"]
    texts = ["".join(names[i : i + 40]) for i in range(0, len(names), 40)] + numbers + ["x".join(numbers)]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    odd = {"\x81", "\x8d", "\x8f", "\x90", "\x9d"}
    for r in df.select("t", html_extract.decode_entities(F.col("t")).alias("got")).collect():
        if "1114111" not in r.t:  # not a character for html.unescape, but one for others
            assert r.got == html.unescape(r.t) or set(r.got) & odd, r
    title, body = "T" * 200, "w" * 130
    page = f"<html><head><script>a</script><style>b</style><title>{title}</title></head><body><header>h</header><p>caf&eacute; {body} &#252;</p></body></html>"
    assert html_extract.extract(spark.createDataFrame([(1, page)], "page_id long, html string")).first().text.endswith(f"café {body} ü") and title not in html_extract.extract(spark.createDataFrame([(1, page)], "page_id long, html string")).first().text


# --- 5 suffix dedup -------------------------------------------------------------------------------------------------


def windows_by_hand(rows, w):
    where = collections.defaultdict(set)
    for i, t in rows:
        x = words(t)
        for p in range(len(x) - w + 1):
            where[tuple(x[p : p + w])].add((i, p))
    return {(i, p, (i, p) != min(v)) for v in where.values() if len(v) > 1 for i, p in v}


@pytest.mark.parametrize("window,gram", [(50, 16), (9, 4), (8, 8), (5, 1)])
def test_repeated_windows(spark, window, gram):
    base = sentences(6, 12)
    shared = " ".join(sentences(7, 1, size=7)[0].split()[: window + 3])
    rows = [(i, f"{t} {shared if i % 3 == 0 else ''} {t[:40]}") for i, t in enumerate(base)] + [(50, base[0]), (51, "a b " * 60), (52, "tick " * (2 * window)), (53, "short"), (54, None), (55, "")]
    df = table(spark, rows + rows[:2])
    for hot in (suffix_dedup.HOT, 3):  # counted before they move, or sorted
        got = [(r.d, r.p, r.later) for r in suffix_dedup.repeated_windows(df, window, gram, hot=hot).collect()]
        assert set(got) == windows_by_hand(rows, window) and got


def test_passage_of_half_the_documents(spark):
    shared = sentences(8, 1, size=20)[0]
    rows = [(i, f"{t} {shared} {t[:30]}" if i % 2 else t) for i, t in enumerate(sentences(9, 60))] + [(100 + i, shared) for i in range(20)]
    want = windows_by_hand(rows, suffix_dedup.WINDOW)
    for hot in (suffix_dedup.HOT, 10):
        got = suffix_dedup.repeated_passages(table(spark, rows), hot=hot).collect()
        assert {(r.d, p, r.later) for r in got for p in range(r.start, r.end - suffix_dedup.WINDOW + 1)} == want


def test_passages_are_cut(spark):
    shared = " ".join(f"Überall{i}" for i in range(60))
    rows = [(1, f"first. {shared}! end of one"), (2, f"Second: {shared}; rest"), (3, "nothing here")]
    df = table(spark, rows)
    spans = {(r.d, r.start, r.end, r.later) for r in suffix_dedup.repeated_passages(df).collect()}
    assert spans == {(1, 1, 61, False), (2, 1, 61, True)}
    out = suffix_dedup.remove_repeats(df)
    assert out.columns == df.columns and {r.doc_id: r.text for r in out.collect()} == {1: rows[0][1], 2: "Second: ; rest", 3: "nothing here"}


def test_suffix_edge(spark, edge):
    spans = suffix_dedup.repeated_passages(edge).collect()
    assert {r.d for r in spans} == {8}
    assert suffix_dedup.repeated_passages(edge.limit(0)).count() == 0 and suffix_dedup.remove_repeats(edge).count() == edge.count()


# --- 6 line dedup ---------------------------------------------------------------------------------------------------


def lines_by_hand(rows, t):
    key = lambda r: (-(1 << 63) if r[0] is None else r[0])
    seen, gone = [], set()
    for i, text in sorted(rows, key=key):
        for j, line in enumerate((text or "").split("\n")):
            s = frozenset(words(line))
            if s:
                if any(len(s & o) >= t * len(s | o) - 1e-9 for o in seen):
                    gone.add((i, j))
                seen.append(s)
    out = {}
    for i, text in rows:
        kept = [x for j, x in enumerate((text or "").split("\n")) if (i, j) not in gone]
        if (text or "").count("\n") + 1 == len(kept):
            out[i] = text
        elif words("\n".join(kept)):
            out[i] = "\n".join(kept)
    return out


@pytest.mark.parametrize("threshold", [0.9, 0.7, 0.5])
def test_line_dedup(spark, threshold):
    rng = np.random.default_rng(8)
    lines = [s[: int(rng.integers(5, 300))] for s in sentences(9, 40, size=6, vocabulary=300)]
    rows = []
    for i in range(50):
        picked = []
        for _ in range(int(rng.integers(1, 5))):
            x = lines[int(rng.integers(0, 40))].split()
            for _ in range(int(rng.integers(0, 3))):
                x[int(rng.integers(0, len(x)))] = f"new{rng.integers(0, 5)}"
            picked.append(" ".join(x).capitalize() + ".")
        rows.append((i, "\n".join([*picked, "", "---"])))
    rows += [(60, None), (61, ""), (62, "!!\n??"), (None, "null id first"), (63, "Null ID first")]
    got = line_dedup.dedup_lines(table(spark, rows), threshold)
    assert {r.doc_id: r.text for r in got.collect()} == lines_by_hand(rows, threshold)


def test_line_dedup_edge(spark, edge):
    got = line_dedup.dedup_lines(edge)
    assert got.columns == edge.columns
    kept = collections.Counter(r.doc_id for r in got.collect())
    assert kept == {1: 1, 2: 1, 3: 1, 4: 2, None: 1, 5: 1, 7: 1, 8: 1, 9: 1}  # 6 repeats 5; the repeated row 4 is one document
    assert line_dedup.dedup_lines(edge.limit(0)).count() == 0


def test_prefix_filter_loses_nothing():
    for t in (0.5, 0.75, 0.9, 0.95):
        for n in range(1, 200):
            assert line_dedup.prefix_length(np.array([n]), t)[0] == n - math.ceil(t * n - 1e-9) + 1
        least = line_dedup.fuzzy_size(t)
        assert least / (least + 1) >= t - 1e-9 > (least - 1) / least - 1e-9 or least == 1


def test_first_of_equal_sets_in_a_chunk():
    s1 = np.array([5, 5, 5, 7, 5, 9], np.uint64)
    s2 = np.array([1, 1, 1, 1, 2, 1], np.uint64)
    ids, hashes, line = np.array([3, 2, 2, 1, 0, 4]), np.zeros(6, np.int64), np.array([0, 1, 1, 0, 0, 0])
    # of the three (5, 1) the first by id is row 1, and row 2 is the same line of a repeated row
    assert line_dedup._repeated(s1, s2, ids, hashes, line).tolist() == [True, False, False, False, False, False]


def test_a_line_of_every_document(spark):
    rows = [(i, f"the one line that each document of this corpus has in common\nown text {i} a{i} b{i} c{i}") for i in range(400)]
    out = line_dedup.dedup_lines(table(spark, rows).repartition(7)).collect()
    assert {r.doc_id: r.text.count("\n") for r in out} == {i: int(i == 0) for i in range(400)}


# --- 7 URL filters --------------------------------------------------------------------------------------------------

URLS = ["https://www.spam-farm.example.org/en/1?x#f", "HTTP://Blog.Spam-Farm.Example.org:8080/", "http://u:p@cheap-pills.example.net/de/44", "cheap-pills.example.net", "//m.example.com", "https://other.org/?q", "https://other.org?q", "http://xspam-farm.example.org/", None, "", "https://example.net./es/x", "mailto:a@b"]


def match_by_hand(keys, rules):
    out = []
    for k in keys:
        hit = sorted((r for r in rules if k is not None and k.startswith(r[0])), key=lambda r: len(r[0]))
        out.append((hit[-1][1], hit[-1][2], len(hit)) if hit else (None, None, 0))
    return out


@pytest.mark.parametrize("parts", [2, 7])
def test_urls(spark, parts):
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        urls = URLS + [f"http://h{i % 5}.example.{('com', 'org')[i % 2]}/p{i}/q" for i in range(200)]
        rules = [*url_filter.RULES, ("example.com", "allow"), ("h2.example.com/p1", "block"), ("h2.example.com/p1", "allow"), ("h3.example.org/p", "block"), ("h3.example.org/p13", "allow")]
        df = spark.createDataFrame([(i, u) for i, u in enumerate([*urls, *urls])], "page_id long, url string").withColumn("depth", F.lit(9)).withColumn("key", F.lit("k"))
        given = spark.createDataFrame(rules, "pattern string, action string")
        keyed = {}
        for r in given.select(url_filter.canonical_key(F.col("pattern")).alias("k"), "action", "pattern").collect():
            keyed[r.k] = min(keyed.get(r.k, (r.action, r.pattern)), (r.action, r.pattern))
        for given_rules in (rules, given):
            got = url_filter.match(df, given_rules).orderBy("page_id").collect()
            assert [(r.action, r.rule, r.depth) for r in got] == match_by_hand([r.url_key for r in got], [(k, a, p) for k, (a, p) in keyed.items()])
            assert len(got) == 2 * len(urls)
        wide = df.withColumns({c: F.lit(1) for c in ("__rule", "__action", "__key", "url_key")})
        assert url_filter.match(wide, rules).filter("action = 'block'").count() == sum(r.action == "block" for r in got)
        kept = url_filter.filter_urls(wide, rules)
        assert kept.columns == wide.columns and kept.count() == sum(r.action != "block" for r in got)
        assert url_filter.match(df.limit(0), rules).count() == 0 and url_filter.match(df, given.limit(0)).filter("depth > 0").count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_url_keys(spark):
    df = spark.createDataFrame([(u,) for u in ("https://www.Shop.example.com:443/a?b#c", "example.com", "http://example.com?x", "", None)], "u string")
    assert [r[0] for r in df.select(url_filter.canonical_key(F.col("u"))).collect()] == ["com,example,shop,/a?b", "com,example,", "com,example,/?x", ",", None]


# --- 8 SimHash ------------------------------------------------------------------------------------------------------


def planted(seed, groups=25, alone=120):
    rng, texts = np.random.default_rng(seed), sentences(seed, groups + alone, size=14)
    rows = [(i, t) for i, t in enumerate(texts)]
    truth = {}
    for g in range(groups):
        for c in range(int(rng.integers(1, 5))):
            x = texts[g].split()
            for _ in range(c):
                x[int(rng.integers(0, len(x)))] = f"edit{rng.integers(0, 9)}"
            truth[1000 + 10 * g + c] = g
            rows.append((1000 + 10 * g + c, " ".join(x)))
    return rows, truth


def test_simhash_groups(spark):
    rows, truth = planted(11)
    f, n = simhash.fingerprints(common.Words(pa.array([t for _, t in rows])), len(rows))
    near = [[(int(np.bitwise_count(f[i] ^ f[j]).sum()) <= simhash.MAX_BITS) and min(n[i], n[j]) >= simhash.MIN_RATIO * max(n[i], n[j]) - 1e-6 for j in range(len(rows))] for i in range(len(rows))]
    label = list(range(len(rows)))
    for _ in range(len(rows)):
        new = [min([label[j] for j in range(len(rows)) if near[i][j]] + [label[i]]) for i in range(len(rows))]
        if new == label:
            break
        label = new
    first = {}
    for i, (d, _) in enumerate(rows):
        first[label[i]] = min(first.get(label[i], d), d)
    want = {d: first[label[i]] for i, (d, _) in enumerate(rows) if first[label[i]] != d}
    got = {r.d: r.d0 for r in simhash.near_duplicates(table(spark, rows)).collect()}
    assert got == want == truth
    told = simhash.class_table(table(spark, rows)).collect()
    assert {r.doc_id: (r.class_id, r.links) for r in told} == {d: (first[label[i]], sum(near[i]) - 1) for i, (d, _) in enumerate(rows)} and len(told) == len(rows)


def test_simhash_shards_and_units(spark):
    rng = np.random.default_rng(21)
    f = rng.integers(0, 2**63, (900, 2), dtype=np.int64).astype(np.uint64)
    for i in range(0, 900, 3):  # near ones
        f[i + 1] = f[i] ^ (np.uint64(1) << rng.integers(0, 63, 2).astype(np.uint64))
    f[600:] = f[600]  # a crowd that no cut parts
    f[600:, 1] ^= np.uint64(1) << rng.integers(0, 63, 300).astype(np.uint64)
    n, m = rng.integers(5, 400, 900), rng.integers(1, 4, 900)
    n[1::3] = n[0::3]
    n[600:] = 100
    rows = [(i, 7 * i, int(n[i]), *(int(x) for x in f[i].view(np.int64)), int(m[i])) for i in range(900)]
    df = spark.createDataFrame(rows, "d long, rh long, n int, f1 long, f2 long, m long")
    metric = simhash.Metric(simhash.MAX_BITS, simhash.MIN_RATIO)
    near = np.array([metric.near(f, n, f[i], n[i]) for i in range(900)])
    np.fill_diagonal(near, False)
    found = simhash.near_links(df, shard=60, unit=50).collect()
    links, label = collections.Counter(), list(range(900))
    for r in found:
        links[r.d] += r.links
    assert dict(links) == {i: int(m[near[i]].sum()) for i in range(900) if near[i].any()}
    label = {i: i for i in range(900)}
    want = dict(label)
    for _ in range(60):
        for r in found:
            label[r.d] = label[r.d0] = min(label[r.d], label[r.d0])
        for i, j in zip(*np.nonzero(near)):
            want[i] = want[j] = min(want[i], want[j])
    assert label == want


def test_every_pair_meets_once():
    rng = np.random.default_rng(12)
    f = rng.integers(0, 2**63, (600, 2), dtype=np.int64).astype(np.uint64)
    for i in range(0, 600, 3):  # some near ones
        f[i + 1] = f[i] ^ (np.uint64(1) << rng.integers(0, 63, 2).astype(np.uint64))
    n = rng.integers(5, 400, 600)
    n[1::3] = n[0::3]
    for radius, ratio in ((22, 0.8), (50, 0.5), (3, 0.9)):
        metric = simhash.Metric(radius, ratio)
        root = simhash.build(f, n, metric, 12)
        row, shard, home = simhash.assign(root, f, n, metric)
        assert sorted(row[home]) == list(range(600)) and len(set(shard)) > 3
        met = collections.Counter()
        for s in set(shard.tolist()):
            at = row[shard == s]
            for a, b in simhash.unit_pairs(f[at], n[at], home[shard == s], metric, leaf=10):
                met.update((min(x, y), max(x, y)) for x, y in zip(at[a].tolist(), at[b].tolist()))
        want = {(i, j) for i in range(600) for j in range(i + 1, 600) if metric.near(f[i : i + 1], n[i : i + 1], f[j], n[j])[0]}
        assert set(met) == want and set(met.values()) == {1}


def test_forest_keeps_links_of_earlier_batches():
    batches = lambda e, size: ((e[i : i + size, 0], e[i : i + size, 1]) for i in range(0, len(e), size))
    trace = np.array([(7, 6), (7, 5), (3, 6), (2, 5)])
    assert units.forest(8, batches(trace, 2)).tolist() == [0, 1, 2, 2, 4, 2, 2, 2]
    rng = np.random.default_rng(13)
    for size in (1, 2, 3, 7, 100):
        for _ in range(60):
            e = rng.integers(0, 40, (30, 2))
            want = list(range(40))
            for a, b in e.tolist():
                low, high = sorted((want[a], want[b]))
                want = [low if x == high else x for x in want]
            assert units.forest(40, batches(e, size)).tolist() == want


def test_simhash_edge(spark, edge):
    out = simhash.dedup_documents(edge)
    assert out.columns == edge.columns
    assert collections.Counter(r.doc_id for r in out.collect()) == {1: 1, 2: 1, 3: 1, 4: 1, None: 1, 5: 1, 7: 1, 8: 1, 9: 1}
    assert simhash.dedup_documents(edge.limit(0)).count() == 0


def test_many_copies(spark):
    out = simhash.dedup_documents(table(spark, [(i, "one text that thousands of pages hold") for i in range(3000)]))
    assert [r.doc_id for r in out.collect()] == [0]


@settings(max_examples=5, deadline=None)
@given(some.lists(some.tuples(some.integers(0, 25), some.integers(0, 25)), max_size=25))
def test_components(spark, edges):
    df = spark.createDataFrame(edges, "a long, b long")
    label = {x: x for e in edges for x in e}
    for _ in range(30):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    assert {r.a: r.b for r in components.components(df).collect()} == {x: y for x, y in label.items() if x != y}


# --- 9 embedding dedup ----------------------------------------------------------------------------------------------


@pytest.mark.parametrize("dims,cosine,block,cell,kind", [(64, 0.97, 16, 40, "float"), (64, 0.97, 8, 1 << 15, "double"), (10, 0.9, 3, 20, "double"), (3, 0.8, 8, 16, "float"), (1, 0.5, 8, 16, "double")])
def test_embeddings(spark, dims, cosine, block, cell, kind):
    rng = np.random.default_rng(13)
    x = rng.normal(size=(300, dims)).astype(np.float32).astype(float)
    x[150:] = x[:150] + rng.normal(size=(150, dims)) * rng.uniform(0, 0.5, (150, 1))
    x[200:280] = x[5] + rng.normal(size=(80, dims)) * 0.01  # a crowd, larger than a cell may be
    x[0:5] = x[5]
    x = x.astype(np.float32).astype(float)
    rows = [(i, [float(v) for v in r], 1) for i, r in enumerate(x)]
    extra = [(900, None, 1), (901, [float("nan")] * dims, 1), (902, [0.0] * dims, 1), (903, [1.0] * (dims + 1), 1), (None, rows[0][1], 1), (904, [None] * dims, 1), rows[7]]
    df = spark.createDataFrame(rows + extra, f"vec_id long, embedding array<{kind}>, label int").withColumns({c: F.lit(0) for c in ("x", "id", "links", "class_id", "u", "home")})
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = u @ u.T >= cosine - 1e-9
    np.fill_diagonal(near, False)
    label = np.arange(len(x))
    for _ in range(len(x)):
        label = np.minimum(label, np.where(near, label[None], len(x)).min(1))
    want = {i: (int(label[i]), int(near[i].sum())) for i in range(len(x))} | {i: (i, 0) for i in range(900, 905)}
    got = embedding_dedup.near_vectors(df, cosine, block, cell=cell).collect()
    assert len(got) == len(want) and {r.vec_id: (r.class_id, r.links) for r in got} == want
    if dims != 10:
        return
    assert embedding_dedup.near_vectors(df.limit(0), cosine, block).count() == 0
    kept = embedding_dedup.dedup_vectors(df, cosine)
    assert {r.vec_id for r in kept.collect()} == {i for i, (c, _) in want.items() if c == i} | {None}


# --- 10 SentencePiece -----------------------------------------------------------------------------------------------


def test_scores_of_a_unigram_model(monkeypatch):
    import sys
    import types

    pieces = {"<unk>": 0.0, "\u2581a": -1.5, "a": -2.25, "b": -3.125, "<0x00>": 0.0}

    class Model:
        def __init__(self, model_file):
            self.names = list(pieces)

        get_piece_size = lambda self: len(self.names)
        id_to_piece = lambda self, i: self.names[i]
        piece_to_id = lambda self, p: self.names.index(p)
        get_score = lambda self, i: pieces[self.names[i]]
        is_byte = lambda self, i: i == 4
        is_unknown = lambda self, i: i == 0
        is_control = is_unused = lambda self, i: False

    monkeypatch.setitem(sys.modules, "sentencepiece", types.SimpleNamespace(SentencePieceProcessor=Model))
    v = sentencepiece.load.__wrapped__("unigram")
    assert [float(v.log_prob[v.pieces[p]]) for p in (" a", "a", "b")] == [-1.5, -2.25, -3.125]


@pytest.fixture(scope="module")
def vocabulary():
    return sentencepiece.load(sentencepiece.MODEL)


def segment_by_hand(v, text):
    text, out = " " + text, []

    def go(i, ids, lp):
        if i == len(text):
            out.append((tuple(ids), lp))
            return
        if text[i] not in v.pieces:
            b = text[i].encode()
            go(i + 1, ids + [v.byte_id + x for x in b], lp + v.byte_log_prob * len(b))
        for k in range(1, 17):
            p = text[i : i + k]
            if len(p) == k and p in v.pieces:
                go(i + k, ids + [v.pieces[p]], lp + float(v.log_prob[v.pieces[p]]))

    go(0, [], 0.0)
    z = np.logaddexp.reduce([lp for _, lp in out])
    return {ids: lp - z for ids, lp in out}


@pytest.mark.parametrize("text", ["a b", "ab🧬c", "the x", "in\nit", "  a"])
def test_samples_follow_the_distribution(vocabulary, text):
    want, n = segment_by_hand(vocabulary, text), 8000
    rows = common.mix64(np.arange(n).astype(np.uint64) + np.uint64(77))
    by = collections.defaultdict(dict)
    for i, rank, ids, lp, g, inclusion, _ in sentencepiece.segmentations(vocabulary, [text] * n, rows, 3):
        by[i][rank] = tuple(ids.tolist()), g, inclusion
        assert want[tuple(ids.tolist())] == pytest.approx(lp, abs=1e-9)
    for x in by.values():
        assert len({s for s, _, _ in x.values()}) == len(x) == min(3, len(want))
        assert [g for _, g, _ in (x[r] for r in sorted(x))] == sorted((g for _, g, _ in x.values()), reverse=True)
    firsts = collections.Counter(x[1][0] for x in by.values())
    assert all(abs(firsts[s] / n - math.exp(lp)) < 0.02 for s, lp in want.items())
    if len(want) > 1:
        pairs = collections.Counter((x[1][0], x[2][0]) for x in by.values())
        assert all(abs(c / n - math.exp(want[a] + want[b]) / -math.expm1(want[a])) < 0.02 for (a, b), c in pairs.items())
    # inclusion scores make the sample an unbiased one (Horvitz-Thompson)
    assert np.mean([sum(math.exp(want[s] - q) for s, _, q in x.values()) for x in by.values()]) == pytest.approx(1, abs=0.02)


@settings(max_examples=40, deadline=None)
@given(some.lists(some.text(max_size=60), max_size=5))
def test_round_trip(vocabulary, texts):
    import sentencepiece as library

    rows = common.mix64(np.arange(len(texts)).astype(np.uint64))
    out = sentencepiece.segmentations(vocabulary, texts, rows, 2)
    assert {i for i, *_ in out} == set(range(len(texts)))
    known = library.SentencePieceProcessor(model_file=sentencepiece.MODEL)
    for i, _, ids, *_ in out:
        assert vocabulary.decode(ids.tolist()) == texts[i]
        if "▁" not in texts[i] and len(texts[i]):
            assert known.decode(ids.tolist()) == texts[i]


def test_encode(spark, edge):
    df = edge.unionByName(table(spark, [(20, "a▁b \t\r\n\x00 Ελλάδα 🧬🧬 中文"), (21, " "), (22, "no" * 3000)]))
    out = sentencepiece.encode(df)
    rows = collections.defaultdict(list)
    for r in out.collect():
        rows[r.doc_id].append(r)
        assert r.lossless and r.n_tokens == len(r.ids) and -1e9 < r.log_inclusion <= 0
    assert 1 not in rows and [list(r.ids) for r in rows[2]] == [[]] and len(rows[4]) == 4 and len(rows[8]) == 2 and len(rows[20]) == 2
    assert {tuple(r.ids) for r in rows[4]} == {tuple(r.ids) for r in rows[4][:2]} or len({tuple(r.ids) for r in rows[4]}) == 2
    again = sentencepiece.encode(df.repartition(5))
    assert again.exceptAll(out).isEmpty() and out.exceptAll(again).isEmpty()
    back = sentencepiece.decode(out.filter("sample = 1").select("doc_id", "ids")).distinct()
    assert {(r.doc_id, r.text) for r in back.collect()} == {(r.doc_id, r.text) for r in df.filter("text is not null").collect()}
    assert sentencepiece.encode(df.limit(0)).count() == 0


def test_kept_lattices_change_nothing(vocabulary, monkeypatch):
    texts = [s.replace("w", "th") for s in sentences(14, 30)]
    rows = common.mix64(np.arange(30).astype(np.uint64))
    plain = lambda out: [(i, r, tuple(ids.tolist()), lp) for i, r, ids, lp, *_ in out]
    first = plain(sentencepiece.segmentations(vocabulary, texts, rows, 2))
    monkeypatch.setattr(sentencepiece, "KEPT_UNITS", 10)
    sentencepiece.segmentations(vocabulary, texts[:15], rows[:15], 2)
    assert vocabulary.kept_net is not None and plain(sentencepiece.segmentations(vocabulary, texts, rows, 2)) == first
