import collections
import math

import pytest
from pyspark.sql import functions as F

from graphemica.functions import sequences as sq
from graphemica.functions.mapper import Mapper
from graphemica.operators import datasets as ds
from graphemica.operators import stats as st
from graphemica.operators.demap import Demapper, accuracy, learning_curve
from graphemica.sources import sinks
from graphemica.sources import text as tx
from graphemica.sources.charsets import UNKNOWN, charset_table
from graphemica.streaming import streams

ALTO = """<?xml version="1.0"?><alto xmlns="http://www.loc.gov/standards/alto/ns-v4#"><Layout><Page><PrintSpace><TextBlock>
<TextLine><String CONTENT="Ein &amp; zwei"/><SP/><String CONTENT="drei"/></TextLine><TextLine><String CONTENT=" "/></TextLine><TextLine><String CONTENT="vier"/></TextLine>
</TextBlock></PrintSpace></Page></Layout></alto>""".split("?>", 1)[1]
PAGE = """<PcGts xmlns="http://schema.primaresearch.org/PAGE/gts/pagecontent/2019-07-15"><Metadata><Creator>nobody</Creator></Metadata><Page><TextRegion/>
<TextRegion><TextLine><TextEquiv><Unicode> one two </Unicode></TextEquiv><TextEquiv><Unicode>three</Unicode></TextEquiv></TextLine>
<TextLine><TextEquiv><Unicode>four &lt;del&gt;five&lt;/del&gt; six</Unicode></TextEquiv></TextLine><TextLine/></TextRegion></Page></PcGts>"""


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame([(1, "Abba\nc"), (2, ""), (3, None), (4, "🧬é")], "doc_id int, text string")


def test_alphabet_and_counts(spark, corpus):
    n = collections.Counter("Abba\nc🧬é")
    assert {r.chr: r.n for r in st.histogram(corpus).collect()} == n
    assert st.alphabet_string(corpus).first() == ("".join(sorted(n)), len(n))
    over = st.unigram_over(corpus, charset_table(spark, ["ascii_lowercase"]).select("idx", "chr"))
    rows = {r.label: (r.chr, r.n) for r in over.collect()}
    assert len(rows) == 27 and rows[0] == (UNKNOWN, 4) and rows[1] == ("a", 1) and rows[26] == ("z", 0)


def test_information(spark, corpus):
    r = {x.doc_id: x for x in st.information(corpus, "doc_id").collect()}
    assert set(r) == {1, 4} and r[1].n == 6 and r[1].hartley == pytest.approx(6 * math.log2(5))
    h = -sum(k / 6 * math.log2(k / 6) for k in collections.Counter("Abba\nc").values())
    assert r[1].shannon == pytest.approx(6 * h)
    assert {x.doc_id: x.n for x in st.information(corpus, "doc_id", unit="utf16").collect()} == {1: 6, 4: 3}


def test_coverage_and_merges(spark, corpus):
    sets = st.sets_named(spark, "ascii,iso_8859_15")
    r = {x.name: x for x in st.coverage(corpus, sets).collect()}
    assert (r["ascii"].n_missing_chars, r["ascii"].n_missing, r["ascii"].cer) == (2, 2, 2 / 8) and r["iso_8859_15"].n_missing == 2
    assert {x.name: x.missing for x in st.missing_characters(corpus, sets).collect()}["ascii"] == "é🧬"
    assert "A" not in {x.name: x.unfound for x in st.unfound_characters(corpus, sets).collect()}["ascii"]
    m = st.merge_cer(corpus, st.parse_merges("[('b', 'p'), ('z', 's')]")).first()
    assert (m.n_chars, m.n_changed, m.cer) == (8, 2, 0.25)
    with pytest.raises(ValueError):
        st.parse_merges("__import__('os')")
    empty = st.merge_cer(corpus.limit(0), {"a": "b"}).first()
    assert empty.n_chars is None and empty.cer is None


def test_charset_tables(spark):
    sets = charset_table(spark, ["ascii", "digits", "hexdigits"])
    d = {(r.a, r.b): r for r in st.charset_distance(sets).collect()}
    assert d["digits", "hexdigits"].common == 10 and d["digits", "digits"].distance == 0 and d["digits", "ascii"].distance == pytest.approx(0.9)
    assert st.unique_characters(sets).filter("chr = 'z'").first().name == "ascii"


def test_readers(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one line\n\ntwo lines")
    (tmp_path / "b.xml").write_text("<a>x <b> y </b>z</a>")
    read = tx.read_corpus(spark, [str(tmp_path / "*"), str(tmp_path / "a.txt")])
    assert {r.path[-5:]: r.text for r in read.collect()} == {"a.txt": "one line\n\ntwo lines", "b.xml": "x y z"}
    assert [r.text for r in tx.lines(read.filter("path like '%a.txt'"), "path").orderBy("line_no").collect()] == ["one line", "two lines"]
    (tmp_path / "p.tsv").write_text("ab\tac\tmore\nonly\nx\ty\n")
    assert {(r.pred, r.gt) for r in tx.read_pairs(spark, str(tmp_path / "p.tsv")).collect()} == {("ab", "ac"), ("x", "y")}
    (tmp_path / "l.txt").write_text("ab\nx")
    (tmp_path / "r.txt").write_text("ac\ny")
    assert tx.read_pairs(spark, str(tmp_path / "l.txt"), str(tmp_path / "r.txt")).count() == 2


def xml(spark, text, f):
    return spark.createDataFrame([(text,), (None,)], "x string").select(f(F.col("x")).alias("o")).collect()[0].o


def test_xml(spark):
    assert xml(spark, ALTO, tx.htr_text) == "Ein & zwei drei\n \nvier"
    assert xml(spark, ALTO, tx.alto_strings) == ["Ein & zwei", "drei", "vier"]
    assert xml(spark, PAGE, tx.htr_text) == "one two\tthree\nfour <del>five</del> six\n"
    assert xml(spark, PAGE, tx.page_transcription) == "one two\tthree\nfour  six"
    assert xml(spark, PAGE, lambda x: tx.page_lines(x, first=1))[0] == "two\t"
    with pytest.raises(Exception, match="neither"):
        xml(spark, "<tei/>", tx.htr_text)
    mixed = "<p>a<del>b<i>c</i></del>d<i>e</i> </p>"
    assert xml(spark, mixed, tx.text_nodes) == ["a", "d", "b", "c", "e"]
    assert xml(spark, mixed, lambda x: tx.text_nodes(x, ignored=["del"])) == ["a", "d", "e"]


def test_xml_edits(spark):
    import xml.etree.ElementTree as ET

    for text, kind, n in ((PAGE, "mixed", 4), (ALTO, "alto", 3)):
        same = xml(spark, text, lambda x: sinks.rewrite_xml(x, F.array().cast("array<string>"), kind))
        assert same == ET.canonicalize(text)
        new = xml(spark, text, lambda x: sinks.rewrite_xml(x, F.array(*[F.lit(f"T{i}") for i in range(n)]), kind))
        assert all(f"T{i}" in new for i in range(n)) and "three" not in new and "drei" not in new


def test_chop_words(spark):
    df = spark.createDataFrame([("a b c d",), ("a",), (None,)], "t string")
    assert [r[0] for r in df.select(tx.chop_words(F.col("t"), 1, 1)).collect()] == ["b c", "", None]


def test_file_pairs(spark):
    a = spark.createDataFrame([("/i/k1.x.txt", "aaaaaaaaaaaa\nb\n"), ("/i/k2.txt", "c"), ("/i/k3.txt", "d\ne"), ("/i/k4.txt", "\n")], "path string, text string")
    b = spark.createDataFrame([("/o/k1.txt", "AAAAAAAAAAAA\nB"), ("/o/k2.txt", "C\nD"), ("/o/k4.txt", ""), ("/o/k5.txt", "z")], "path string, text string")
    assert [(r.key, r.src, r.tgt) for r in tx.key_pairs(a, b).collect()] == [("k1", ["aaaaaaaaaaaa", "b"], ["AAAAAAAAAAAA", "B"])]
    with pytest.raises(Exception, match="unsound"):
        tx.key_pairs(a, b, "raise").collect()
    assert tx.key_pairs(a, b, "ignore").count() == 3
    assert [(r.src, r.tgt) for r in tx.zip_lines(a.limit(1), b.limit(1)).collect()] == [("aaaaaaaaaaaa", "AAAAAAAAAAAA")]


def test_icdar(spark):
    good = "[OCR_toInput] abc=def\n[OCR_aligned] abcd@ef@\n[ GS_aligned] @bcdxefg\n"
    rows = [("g", "[OCR_toInput] abcdef\n[OCR_aligned] abcd@ef@\n[ GS_aligned] @bcdxefg\n"), ("bad", "[OCR_toInput] x\n[OCR_aligned] abc\n[ GS_aligned] abc"), ("short", "x"), ("odd", good)]
    r = tx.read_icdar(spark.createDataFrame(rows, "path string, text string")).collect()
    assert {(x.path, x.ocr, x.gt) for x in r} == {("g", "bcd@ef@", "bcdxefg"), ("odd", "bcd@ef@", "bcdxefg")}
    parts = spark.createDataFrame([("b@c", "bxy")], "o string, g string").select(tx.aligned_parts(F.col("o"), F.col("g"))).first()[0]
    assert [(p.src, p.tgt) for p in parts] == [("b", "bx"), ("c", "y")]
    long = spark.createDataFrame([("p", "a" * 12 + "xxxx" + "b" * 12, "a" * 12 + "@@@@" + "b" * 12)], "path string, ocr string, gt string")
    assert [r.gt for r in tx.split_at_gaps(long).orderBy("piece").collect()] == ["a" * 12, "b" * 12]


def test_sinks(spark, tmp_path):
    pairs = spark.createDataFrame([("a b", 'c"d')], "a string, b string")
    out = str(tmp_path / "t")
    sinks.write_tsv(pairs, out)
    assert [r.value for r in spark.read.text(out).collect()] == ['a b\tc"d']
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.write_tsv(pairs, out)
    sinks.write_tsv(pairs, out, append=True)
    assert spark.read.text(out).count() == 2
    sinks.write_transcriptions(spark.createDataFrame([("x", "text")], "path string, text string"), str(tmp_path / "u"), by_file=True)
    assert spark.read.text(str(tmp_path / "u")).first().path == "x"
    sinks.write_confusions(spark.createDataFrame([("a", "b", 1)], "src_chr string, tgt_chr string, n int"), str(tmp_path / "c"))


def vec(spark, word, **kw):
    return spark.createDataFrame([(word,)], "w string").select(sq.phoc(F.col("w"), **kw)).first()[0]


def test_phoc(spark):
    acgt = {"levels": (1,), "alphabet": "ACGT"}
    assert vec(spark, "AAAT", **acgt) == [0, 0, 0.75, 0, 0, 0.25] and vec(spark, "AaAT", **acgt) == [0.25, 0, 0.5, 0, 0, 0.25]
    assert vec(spark, "AAAT", mode="sum", **acgt) == [0, 0, 3, 0, 0, 1] and vec(spark, "AAAT", mode="bin", **acgt) == [0, 0, 1, 0, 0, 1]
    assert sum(vec(spark, "AAAAA", levels=(1, 2, 3, 5), alphabet="ACGT")) == pytest.approx(11)
    assert len(vec(spark, "word")) == 11 * 64 and sum(vec(spark, "")) == 0 and sq.phoc_size() == 693


def test_ctc(spark):
    one = lambda f, *v: spark.createDataFrame([v], ", ".join(f"c{i} array<int>" for i in range(len(v)))).select(f).first()[0]
    assert one(sq.ctc_collapse(F.col("c0")), [1, 1, 0, 1, 2, 2, 0]) == [1, 1, 2] and one(sq.ctc_collapse(F.col("c0")), []) == []
    assert one(sq.ctc_confidence(F.col("c0"), F.col("c1")), [1, 1, 0, 2], [5, 6, 7, 8]) == [6, 8]
    assert one(sq.ctc_expand(F.col("c0"), 1), [1, 2, 3, 4]) == [1, 0, 2, 0, 3, 0, 4, 0]
    assert one(sq.ctc_expand(F.col("c0"), 2, replicate=True), [1]) == [1, 1, 0]
    assert one(sq.pad_targets(F.array(F.col("c0")), 5), [3, 1, 3, 1, 3]) == [[3, 1, 3, 1, 3, 0]]
    with pytest.raises(Exception, match="longer"):
        one(sq.pad_targets(F.array(F.col("c0")), 1), [1, 2, 3])


def test_vectors(spark):
    v = spark.createDataFrame([(i, [math.cos(i), math.sin(i)]) for i in range(6)], "vec_id int, embedding array<float>")
    top = sq.topk_similar(v, v.filter("vec_id = 1"), 2).orderBy("rank").collect()
    assert top[0].id == 1 and top[0].cosine == pytest.approx(1) and len(top) == 2
    assert {r.query: r.id for r in sq.nearest(v, v).collect()} == {i: i for i in range(6)}


def test_vocabulary(spark, corpus):
    df = spark.createDataFrame([("the cat the dog",), ("The end",), (None,)], "text string")
    assert {r.word: r.freq for r in sq.vocabulary(df).collect()} == {"the": 3, "cat": 1, "dog": 1, "end": 1}
    assert [(r.word, r.idx) for r in sq.vocabulary(df, capacity=2).orderBy("idx").collect()] == [("the", 0), ("cat", 1)]


def test_windows_and_packing(spark):
    text = "".join(chr(97 + i % 26) for i in range(101))
    for t, size in ((text, 7), ("short", 7), ("sevench", 7)):
        got = spark.createDataFrame([(t,)], "t string").select(ds.windows(F.col("t"), size)).first()[0]
        assert got == [t[i : i + size] for i in range(len(t) - size + 1)]
    lines = spark.createDataFrame([(1, i, t) for i, t in enumerate(["a" * 30, "b" * 30, "c"])], "k int, line_no int, text string")
    assert [r.text for r in ds.pack_lines(lines, "k").orderBy("block").collect()] == ["a" * 30 + "\n" + "b" * 30, "c"]


def test_splits(spark):
    df = spark.range(1000).select(F.col("id"), F.lit("0123456789").alias("text"))
    a, b = ds.split(df, 0.8, "id")
    assert a.count() + b.count() == 1000 and 760 < a.count() < 840
    assert {r[0] for r in ds.split(df.repartition(7), 0.8, "id")[0].select("id").collect()} == {r[0] for r in a.select("id").collect()}
    assert {len(r[0]) for r in df.select(ds.crop(F.col("text"), 4, "id")).collect()} == {4}
    assert len({r[0] for r in df.select(ds.crop(F.col("text"), 4, "id")).collect()}) == 7
    assert [r.id for r in ds.first_rows(df, 3, "id").collect()] == [0, 1, 2] and ds.shuffled(df, "id").first().id != 0


def test_demapper(spark, tmp_path):
    m = Mapper({"a": "a", "b": "b", "c": "a", "x": "x"})
    texts = spark.createDataFrame([(i, "xcxbab" * 3) for i in range(9)], "k int, text string")
    pairs = ds.self_supervised(texts, m)
    assert ds.one_to_one(pairs).first()[0]
    model = Demapper.fit(pairs, width=1)
    got = accuracy(model.characters(pairs, "k"), pairs, "k").first()
    assert got.accuracy == 1.0 and got.n == 9 * 18
    assert Demapper.fit(pairs, width=0).transform(pairs, "k").count() == 9
    unseen = spark.createDataFrame([(1, "q")], "k int, src string")
    assert model.transform(unseen, "k").first()[1:] == ("q", 0.0)
    model.save(str(tmp_path / "m"))
    again = Demapper.load(spark, str(tmp_path / "m"))
    assert again.width == 1 and again.is_compatible(model.alphabet()) and not again.is_compatible(unseen.select(F.col("src").alias("chr")))
    curve = learning_curve(pairs, pairs, "k", [1, 5])
    assert [r.accuracy for r in curve.collect()] == [1.0, 1.0]
    history = spark.createDataFrame([(1, 0.5), (2, 0.4), (3, 0.9)], "epoch int, acc double")
    assert [r.best for r in ds.running_best(history, "acc").orderBy("epoch").collect()] == [0.5, 0.5, 0.9]


def test_correct_column(spark):
    df = spark.createDataFrame([("a\tb\tc",)], "line string")
    assert df.select(ds.correct_column(F.col("line"), 1, F.upper)).first()[0] == "a\tB\tc"


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.txt").write_text("ab\nba\n")
    source = streams.text_stream(spark, str(tmp_path / "in"))
    t = streams.run_available(streams.running_unigram(source), "t_uni", str(tmp_path / "c1"))
    assert {r.chr: r.n for r in t.collect()} == {"a": 2, "b": 2}
    t = streams.run_available(streams.mapped(source, Mapper({"a": "x"}, unknown="?")), "t_map", str(tmp_path / "c2"), "append")
    assert sorted(r.text for r in t.collect()) == ["?x", "x?"]
    both = source.select(F.col("text").alias("src"), F.upper("text").alias("tgt"))
    t = streams.run_available(streams.running_confusions(both), "t_conf", str(tmp_path / "c3"))
    assert {(r.src_chr, r.tgt_chr): r.n for r in t.collect()} == {("a", "A"): 2, ("b", "B"): 2}


def test_sql_functions(spark):
    from graphemica.functions.register import register

    register(spark, {"upper_dna": Mapper({"a": "A", "c": "C"}, unknown="?")})
    r = spark.sql("SELECT nfc('e\u0301') AS c, nfd('é') AS d, plain_letters('Žλ') AS p, char_similarity('a', 'a') AS s, cer('ab', 'ac') AS e, cer('', '') AS z, upper_dna('acg') AS u, nfc(NULL) AS n").first()
    assert tuple(r) == ("é", "e\u0301", "Zl", 1.0, 0.5, 1.0, "AC?", None)
    steps = spark.sql("SELECT t.id, s.* FROM VALUES (1, 'ACGT', 'AGT'), (2, NULL, 'x') t(id, a, b), LATERAL align(t.a, t.b) s")
    assert [(x.id, x.op) for x in steps.orderBy("id", "step").collect()] == [(1, "match"), (1, "del"), (1, "match"), (1, "match")]
    assert [x.text for x in spark.sql("SELECT * FROM text_nodes('<a>x<b>y</b>z</a>')").orderBy("idx").collect()] == ["x", "z", "y"]


def test_histories_and_variants(spark, corpus):
    from graphemica.operators.demap import validation_summary

    h = spark.createDataFrame([(i, x) for i, x in enumerate([0.1, 0.9, 0.5, 0.7], 1)], "epoch int, accuracy double")
    r = validation_summary(h).first()
    assert (r.last, r.best) == (0.7, 0.9) and r.deviation == pytest.approx(0.1414, abs=1e-3)
    d = st.mapper_distances(corpus, {"a": Mapper("Abc\n🧬é"), "b": Mapper("abc\n🧬é")}).first()
    assert (d.n_chars, d.n_differ) == (8, 2)
    ok = spark.createDataFrame([("ab", "cd")], "src string, tgt string")
    assert ds.assert_equal_lengths(ok).count() == 1
    with pytest.raises(Exception, match="unequal"):
        ds.assert_equal_lengths(spark.createDataFrame([("a", "cd")], "src string, tgt string")).collect()


def test_counts_by_group(spark):
    import collections

    from graphemica.functions.batches import counted

    rows = [("a", 1, "xyx", "xzx"), ("a", 1, "x", "y"), (None, 2, "é🧬", "e?"), ("b", 2, None, "q"), ("b", 3, "", ""), ("b", 3, "long", "er")]
    df = spark.createDataFrame(rows, "g string, h int, s string, t string")
    want = collections.Counter((g, h, a, b) for g, h, s, t in rows if s and t and len(s) == len(t) for a, b in zip(s, t))
    assert {(r.g, r.h, r.a, r.b): r.n for r in counted(df, ["s", "t"], ["a", "b"], "g", "h").collect()} == want
    assert counted(df.limit(0), ["s"], ["a"]).count() == 0
    assert {(r.g, r.chr): r.n for r in st.unigram(df, "g", text_col="s").collect()} == collections.Counter((g, c) for g, _, s, _ in rows for c in s or "")


def test_information_loss(spark):
    df = spark.createDataFrame([("uvuv",)], "text string")
    r = st.information_loss(df, Mapper({"u": "v", "v": "v"})).first()
    assert (r.n_chars, r.n_changed, r.changed, r.bits_before, r.bits_after, r.bits_lost) == (4, 2, 0.5, 1.0, 0.0, 1.0)


def test_demapper_joined_or_sent(spark, monkeypatch):
    from graphemica.operators import demap

    rows = [(i, t, t.translate(str.maketrans("aou", "äöü")) if i % 3 else t) for i, t in enumerate(["a tour of about four hours", "out and about", "you too", "aa\x02a", "z"] * 4)]
    pairs = spark.createDataFrame(rows, "k int, src string, tgt string")
    test = spark.createDataFrame([(100 + i, t, t) for i, t in enumerate(["about a tour", "q", "hour out!", ""])], "k int, src string, tgt string")
    for width in (0, 1, 2, 3):
        sent = Demapper.fit(pairs, width)
        one = {(r.k, r.text, round(r.confidence, 9)) for r in sent.transform(test, "k").collect()}
        score = sent.accuracy(test, "k").first()
        with monkeypatch.context() as m:
            m.setattr(demap, "SMALL", 0)
            joined = Demapper.fit(pairs, width)
            assert one == {(r.k, r.text, round(r.confidence, 9)) for r in joined.transform(test, "k").collect()} and len(one) == 3
            assert joined.accuracy(test, "k").first() == score


def test_dataset_kept_and_items(spark, tmp_path):
    df = spark.createDataFrame([("abc", "xyz"), ("ab", "x")], "src string, tgt string")
    assert ds.alphabets(df).first() == ("abc", "xyz")
    assert ds.load_dataset(spark, str(tmp_path / "none")) is None
    ds.save_dataset(df, str(tmp_path / "d"), src="abc", tgt="xyz")
    pairs, facts = ds.load_dataset(spark, str(tmp_path / "d"))
    assert pairs.exceptAll(df).isEmpty() and facts == {"src": "abc", "tgt": "xyz"}
    rows = {r.src: (r.tgt, r.src_labels, r.tgt_labels) for r in ds.items(df, Mapper("abc"), Mapper("xyz")).collect()}
    assert rows["abc"] == ("xyz", [1, 2, 3], [1, 2, 3]) and rows["ab"] == ("x", [1, 2], [1])
    assert all(len(r.src) == 2 for r in ds.items(df, Mapper("abc"), Mapper("xyz"), 2, "src").collect())


def test_text_lines_by_ending(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one two\n\nthree")
    (tmp_path / "b.pagexml").write_text('<PcGts xmlns="n"><Page><TextLine><TextEquiv><Unicode>x y z</Unicode></TextEquiv></TextLine></Page></PcGts>')
    (tmp_path / "c.dat").write_text("raw")
    got = tx.text_lines(spark, [str(tmp_path / "a.txt"), str(tmp_path / "b.pagexml")], first=1)
    assert sorted(r.text for r in got.collect()) == ["two", "y z"]
    assert [r.text for r in tx.text_lines(spark, str(tmp_path / "c.dat"), assume_txt=True).collect()] == ["raw"]
    with pytest.raises(Exception, match="neither text nor XML"):
        tx.text_lines(spark, str(tmp_path / "c.dat")).collect()
    import io

    for source in (tmp_path / "c.dat", str(tmp_path / "c.dat"), io.BytesIO(b"raw"), io.StringIO("raw"), b"raw"):
        assert tx.xml_source(source) == "raw"
    assert tx.xml_source("<a/>") == "<a/>"
    tei = '<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader>no</teiHeader><text><p>yes</p></text></TEI>'
    df = spark.createDataFrame([(tei,)], "x string")
    assert df.select(tx.mixed_lines(F.col("x"), "tei")).first()[0] == ["yes"]


def test_network_learns_and_goes_on(spark, tmp_path):
    from graphemica.operators import network
    from graphemica.operators.demap import validation_summary

    m = Mapper({"a": "a", "b": "b", "c": "a", "x": "x", "y": "y"})
    texts = spark.createDataFrame([("xcyba" * 8,), ("yabxc" * 8,), ("bxcyabxc" * 5,)] * 6, "text string")  # c stands after x only
    pairs = ds.self_supervised(texts, m)
    net = network.fit(pairs, pairs, epochs=3, width=1, rate=0.01, batch=32, workers=2)
    assert [h[0] for h in net.history] == [1, 2, 3] and net.history[-1][3] < net.history[0][1]
    assert network.fit(pairs.repartition(3), pairs, epochs=3, width=1, rate=0.01, batch=32, workers=2).history == net.history
    net.save(spark, str(tmp_path / "n"))
    again = network.Network.load(spark, str(tmp_path / "n"))
    assert again.history == net.history and again.is_compatible("abxy", "abcxy") and not again.is_compatible("ab", "ab")
    more = network.fit(pairs, pairs, epochs=3, rate=0.01, batch=32, workers=2, start=again)
    assert more.epoch == 6 and max(h[4] for h in more.history) > 0.95
    assert validation_summary(more.history_table(spark), "val_accuracy").first().best == max(h[4] for h in more.history)
    rows = {r.k: (r.text, r.confidence) for r in more.transform(spark.createDataFrame([(1, "xayba"), (2, ""), (3, None)], "k int, src string"), "k").collect()}
    assert set(rows) == {1} and rows[1][0] == "xcyba" and 0 < rows[1][1] <= 1


def test_network_slopes():
    import numpy as np

    from graphemica.operators.network import Network

    rng = np.random.default_rng(4)
    net = Network.new("abc", "xy", width=1, embed=3, hidden=5)
    x, y = rng.integers(0, 5, (7, 3)), rng.integers(0, 2, 7)
    slope, loss, _ = net.gradient(x, y, net.weights)
    for name, w in net.weights.items():
        for at in list(np.ndindex(w.shape))[:12]:
            moved = {k: v.copy() for k, v in net.weights.items()}
            moved[name][at] += 1e-6
            assert abs((net.gradient(x, y, moved)[1] - loss) / 7e-6 - slope[name][at]) < 1e-4


def test_late_rows_are_dropped(spark, tmp_path):
    schema = "ts timestamp, kind string"
    write = lambda n, rows: spark.createDataFrame(rows, "ts string, kind string").select(F.col("ts").cast("timestamp"), "kind").coalesce(1).write.parquet(str(tmp_path / "in" / f"part={n}"))
    counts = lambda: streams.windowed_counts(spark.readStream.schema(schema).parquet(str(tmp_path / "in" / "*")), "ts", "kind", every="1 hour", late="1 hour")
    run = lambda: {(str(r.start), r.kind): r.n for r in streams.run_updates(counts(), str(tmp_path / "c"), "start", "kind").collect()}
    write(1, [("2024-01-01 00:10:00", "a"), ("2024-01-01 09:10:00", "a")])
    assert run() == {("2024-01-01 00:00:00", "a"): 1, ("2024-01-01 09:00:00", "a"): 1}
    write(2, [("2024-01-01 00:20:00", "a"), ("2024-01-01 09:20:00", "a"), ("2024-01-01 09:30:00", "b")])  # the first is late
    assert run() == {("2024-01-01 00:00:00", "a"): 1, ("2024-01-01 09:00:00", "a"): 2, ("2024-01-01 09:00:00", "b"): 1}


def test_phoc_of_many_words(spark):
    words = ["Brand#13", "a", "é😀", "", None, "ring", "Zz 0" * 40]
    df = spark.createDataFrame(list(enumerate(words)), "i int, w string").orderBy("i")
    rows = df.select(sq.phoc(F.col("w")).alias("v"), sq.phoc_entries(F.col("w")).alias("e")).collect()
    letters = "".join(sorted(" " + sq.ALPHANUMERIC))
    for word, r in zip(words, rows, strict=True):
        if word is None:
            assert r.v is None and r.e is None
            continue
        want, n = [], len(word)
        for level in (1, 2, 3, 5):
            for i in range(level):
                part = word[i * n // level : -(-(i + 1) * n // level)]
                want += [sum(letters.find(c) + 1 == k for c in part) / max(1, len(part)) for k in range(64)]
        assert r.v == want and [tuple(x) for x in r.e] == [(k, x) for k, x in enumerate(want) if x]
    from graphemica.plans import catalogue as cat

    assert "(5, 6)" in cat.SQL["phoc_words"] and "p_name" in cat.SQL["phoc_words"] and "vector" in cat.SQL["phoc_words"]


def test_pieces_bound_what_is_worked_on(spark):
    import tracemalloc

    import pyarrow as pa

    from graphemica.functions import batches as ba

    texts = pa.array(["abc", None, "", "é" * 200, "x" * 700, "y"])
    cut = list(ba.pieces(iter([pa.record_batch([texts], names=["t"])]), 0, size=500))
    assert [x for c in cut for x in c.column(0).to_pylist()] == texts.to_pylist() and all(c.num_rows == 1 or len("".join(filter(None, c.column(0).to_pylist())).encode()) <= 500 for c in cut)
    assert ba.in_pieces(lambda t: t, texts).equals(texts) and [c.num_rows for c in ba.pieces(iter([pa.record_batch([texts.slice(0, 0)], names=["t"])]), 0)] == [0]
    many = pa.array(["characters " * 100] * 8000)  # 8.8 MB, as a batch of Arrow may be
    tracemalloc.start()
    for piece in ba.pieces(iter([pa.record_batch([many], names=["t"])]), 0):
        ba.points(piece.column(0))[0].astype("int64")
    assert tracemalloc.get_traced_memory()[1] < 16 << 20
    tracemalloc.stop()


def test_curve_in_one_pass_is_that_of_each_model(spark, monkeypatch):
    from graphemica.operators import demap

    rows = [(i, t.lower(), t) for i, t in enumerate(["Ab aB", "xYz", "AB é", "", "Zzz aB xY"] * 3)]
    df = spark.createDataFrame(rows, "k int, src string, tgt string")
    passes = []
    monkeypatch.setattr(demap.Demapper, "accuracy", (lambda f: lambda self, *a: passes.append(1) or f(self, *a))(demap.Demapper.accuracy))
    once = sorted(map(tuple, demap.learning_curve(df, df, "k", [1, 2, 9]).collect()))
    assert not passes and once == sorted((size, *demap.Demapper.fit(df.orderBy("k").limit(size)).accuracy(df, "k").first()) for size in (1, 2, 9))


def test_window_ends(spark):
    texts = ["abcdé😀g", "abc", "ab", "", None, "é" * 3000 + "z"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i")
    for r, t in zip(df.select(ds.window_ends(F.col("t"), 3).alias("e"), ds.windows(F.col("t"), 3).alias("w")).collect(), texts, strict=True):
        assert r.e is None if t is None else tuple(r.e) == (len(r.w), "".join(w[0] for w in r.w), "".join(w[2] for w in r.w))


def test_network_validates_each_window_once(spark):
    import numpy as np

    from graphemica.operators import network

    net = network.Network.new("ab", "AB", width=1, hidden=4)
    x, y = net.windows(np.array([97, 98] * 500, np.uint32), np.array([0, 1000])), np.array([0, 1] * 500)
    first, often = network._distinct(x, y, 4)
    assert len(first) == 4 and sorted(often.tolist()) == [1, 1, 499, 499]
    n, loss, right = network.Network("ab", "AB", 1, net.weights).validate(spark.createDataFrame([("ab" * 500, "AB" * 500)], "src string, tgt string"))
    p = net.shares(x)[0]
    assert (n, right) == (1000, (p.argmax(1) == y).mean()) and loss == pytest.approx(-np.log(p[np.arange(1000), y]).mean())


def test_contexts_are_counted_across_batches(monkeypatch):
    from collections import Counter

    import pyarrow as pa

    from graphemica.operators import demap

    texts = ["abcab" * 40, "", "é😀é", "a", "abcab" * 40, "".join(chr(c) for c in range(200, 1500)), "x\x02y"]
    for width in (0, 1, 2, 3):
        want = Counter()
        for t in texts * 3:
            edged = "\x02" * width + t + "\x02" * width
            want.update((edged[i : i + 2 * width + 1], c.upper()[:1]) for i, c in enumerate(t))
        upper = ["".join(c.upper()[:1] for c in t) for t in texts]
        aligned = [[c.upper()[:1] for c in t] for t in texts]
        for targets in (pa.array(upper), pa.array(aligned, pa.list_(pa.string()))):
            batch = pa.record_batch([pa.array(texts), targets], names=["src", "tgt"])
            for kept in (1 << 19, 1):  # all at the end, or whenever two are known
                monkeypatch.setattr(demap, "_KEPT", kept)
                out = list(demap._counts(width)(iter([batch] * 3)))
                got = Counter()
                for b in out:
                    for c, t, n in zip(*(x.to_pylist() for x in b.columns), strict=True):
                        got[c, t] += n
                assert got == want
                # what moves does not grow with the number of batches, as far as the characters are few enough for one number
                if kept > 1 and width < 2:
                    assert sum(b.num_rows for b in out) == len(want)
    # as far as both texts go, or of equal ones only
    uneven = pa.record_batch([pa.array(["abc", None, "x"]), pa.array(["AB", "q", "XYZ"])], names=["src", "tgt"])
    assert sorted(tuple(r.values()) for b in demap._counts(1)(iter([uneven])) for r in b.to_pylist()) == [("\x02ab", "A", 1), ("\x02x\x02", "X", 1), ("abc", "B", 1)]
    assert not list(demap._counts(1, True)(iter([uneven])))


def test_accuracy_sends_no_model(spark, monkeypatch):
    from collections import Counter, defaultdict

    rows = [(i, t and t.lower(), t) for i, t in enumerate(["Ab aB", "xYz", "AB é", "", "Zzz aB xY", "aB Ab ab", None] * 3)]
    test = [(1, "ab xyz", "Ab xYz"), (2, "q", "Q"), (3, "zab", "ZA"), (4, "é", "éé"), (5, "", "x"), (6, None, None)]
    pairs, held = (spark.createDataFrame(x, "k int, src string, tgt string") for x in ([*rows, (99, "ab", "QQQ"), (98, "ab", None)], test))
    for width in (0, 1, 2):
        contexts = lambda t, i, k: ("\x02" * k + t)[i : i + k] + t[i : i + k + 1] + "\x02" * max(0, i + k + 1 - len(t))
        seen = defaultdict(Counter)
        for _, s, t in rows:
            for i in range(len(s or "")):
                for k in range(width + 1):
                    seen[contexts(s, i, k)][t[i]] += 1
        best = {c: min(n, key=lambda t, n=n: (-n[t], t)) for c, n in seen.items()}
        made = [(next((best[c] for k in range(width, -1, -1) if (c := contexts(s, i, k)) in best), s[i]), t[i]) for _, s, t in test if s and t for i in range(min(len(s), len(t)))]
        with monkeypatch.context() as m:  # a model of any size is joined with the counts of the test set
            m.setattr(Demapper, "_sent", lambda self: 1 / 0)
            got = Demapper.fit(pairs, width).accuracy(held, "k").first()
        right = sum(a == b for a, b in made)
        assert tuple(got) == (len(made), right, right / len(made))
    assert tuple(Demapper.fit(pairs, 1).accuracy(held.filter("k > 5"), "k").first()) == (0, 0, None)


def _peak_of_counting(monkeypatch, make, batch):
    """(what the step of ``make`` that counts in Arrow batches sends on for a batch, the most bytes that it held at once)."""
    import tracemalloc

    from pyspark.sql.classic.dataframe import DataFrame as Classic

    steps = []
    with monkeypatch.context() as m:
        m.setattr(Classic, "mapInArrow", (lambda f: lambda self, func, *a, **k: steps.append(func) or f(self, func, *a, **k))(Classic.mapInArrow))
        make()
    tracemalloc.start()
    out = [row for b in steps[0](iter([batch])) for row in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return out, peak


def test_information_by_group_holds_pieces(spark, monkeypatch):
    import pyarrow as pa

    corpus = spark.createDataFrame([("a", "x")], "lang string, text string")
    batch = pa.record_batch([pa.array(["la", "de"] * 4000), pa.array(["characters é" * 90, "abc"] * 4000)], names=["lang", "text"])
    out, peak = _peak_of_counting(monkeypatch, lambda: st.information(corpus, "lang"), batch)
    assert peak < 24 << 20 and sum(r[-1] for r in out) == 4000 * (12 * 90 + 3) and sum(r[-1] for r in out if r[:2] == ("la", "é")) == 4000 * 90


def test_confusions_hold_pieces(spark, monkeypatch):
    import pyarrow as pa

    from graphemica.functions import align as al
    from graphemica.functions import mapper as mp

    pairs = spark.createDataFrame([("a", "b")], "src string, tgt string")
    batch = pa.record_batch([pa.array(["characters e" * 90, "abc"] * 4000), pa.array(["characters é" * 90, "ab"] * 4000)], names=["src", "tgt"])
    out, peak = _peak_of_counting(monkeypatch, lambda: al.positional_confusions(pairs), batch)
    assert peak < 24 << 20 and sum(r[-1] for r in out) == 4000 * 12 * 90 and sum(r[-1] for r in out if r[:2] == ("e", "é")) == 4000 * 90
    fold = Mapper({"é": "e", "a": "a"})
    pieces = []
    monkeypatch.setattr(mp, "_apply", (lambda f: lambda m, t: pieces.append(t.nbytes) or f(m, t))(mp._apply))
    made = mp.in_pieces(lambda piece: mp._apply(fold, piece), batch.column(1))
    assert len(pieces) > 10 and made[0].as_py() == fold("characters é" * 90) and len(made) == 8000


def test_missing_characters_hold_pieces(spark, monkeypatch):
    import pyarrow as pa

    corpus = spark.createDataFrame([("a",)], "text string")
    batch = pa.record_batch([pa.array(["characters é" * 90, None, "abc"] * 4000)], names=["text"])
    out, peak = _peak_of_counting(monkeypatch, lambda: st.missing_characters(corpus, charset_table(spark, ["ascii"])), batch)
    assert peak < 24 << 20 and sum(r[-1] for r in out) == 4000 * (12 * 90 + 3) and {r[0] for r in out} == set("characters éb")


def test_long_text_is_counted_in_stretches(spark, monkeypatch):
    import pyarrow as pa

    from graphemica.functions import batches as ba

    corpus = spark.createDataFrame([("a", "x")], "lang string, text string")
    batch = pa.record_batch([pa.array(["la"]), pa.array(["characters é😀" * 200_000])], names=["lang", "text"])  # one text of 3.2 MB
    out, peak = _peak_of_counting(monkeypatch, lambda: st.information(corpus, "lang"), batch)
    counts = collections.Counter()
    for lang, c, n in out:
        counts[lang, c] += n
    assert peak < 16 << 20 and counts == {("la", c): n * 200_000 for c, n in collections.Counter("characters é😀").items()}
    for size in (8, 9, 100, 1000):
        texts = [pa.array(["aé€😀" * 50 + "z"]), pa.array(["😀a€é" * 50 + "é"])]
        cut = list(ba.stretches(texts, size))
        assert ["".join(part[k][0].as_py() for part in cut) for k in range(2)] == [t[0].as_py() for t in texts]
        assert all(len(a[0].as_py()) == len(b[0].as_py()) for a, b in cut) and all(sum(len(t[0].as_py().encode()) for t in part) <= max(size, 16) for part in cut)
    monkeypatch.setattr(ba, "_PIECE", 16)
    rows = [("é" * 40 + "b", "e" * 40 + "b"), ("x" * 50, "y" * 49), (None, "z" * 60), ("a" * 30, None), ("ab", "cd")]
    found = list(ba.pieces(iter([pa.record_batch([pa.array([a for a, _ in rows]), pa.array([b for _, b in rows])], names=["a", "b"])]), 0, 1))
    kept = [(a, b) for p in found for part in ba._in_stretches(p, 0, 1) for a, b in zip(*(c.to_pylist() for c in part.columns), strict=True)]
    assert "".join(a for a, _ in kept) == "é" * 40 + "bab" and "".join(b for _, b in kept) == "e" * 40 + "bcd" and len(kept) > 4


def test_long_text_is_mapped_and_compared_in_stretches(spark, monkeypatch):
    import tracemalloc
    import unicodedata

    import pyarrow as pa

    from graphemica.functions import align as al
    from graphemica.functions import batches as ba
    from graphemica.functions import mapper as mp

    text, plain = "characters é" * 250_000, "characters e" * 250_000  # 3 MB each
    fold = Mapper({"é": "e"} | {c: c for c in "characters "}, unknown="?")
    mp._apply(fold, pa.array(["é"]))  # the table of the map is kept
    tracemalloc.start()
    made = ba.in_pieces(lambda piece: mp._apply(fold, piece), pa.array([text]))
    assert tracemalloc.get_traced_memory()[1] < 8 * len(text) and made.to_pylist() == [plain]
    tracemalloc.stop()
    pairs = spark.createDataFrame([("a", "b")], "src string, tgt string")
    for tgt, n in ((text, 250_000), (text[:-1], 0)):
        batch = pa.record_batch([pa.array([plain]), pa.array([tgt])], names=["src", "tgt"])
        out, peak = _peak_of_counting(monkeypatch, lambda: al.positional_confusions(pairs), batch)
        assert peak < 16 << 20 and sum(r[-1] for r in out) == 12 * n and sum(r[-1] for r in out if r[:2] == ("e", "é")) == n
    monkeypatch.setattr(ba, "_PIECE", 16)
    texts = ["e\u0301😀a" * 30, "é€a" * 30, "", None, "a" * 90, "é"]  # of more bytes than a piece, and of the other normal form
    for m in (Mapper({"é": "e", "a": "ß"}), Mapper({"é": "e"}, unit="utf16"), Mapper({"a": "b", "😀": "é"}, form=None), Mapper({"e": "x"}, form="nfd")):
        assert ba.in_pieces(lambda piece, m=m: mp._apply(m, piece), pa.array(texts)).to_pylist() == [t if t is None else m(t) for t in texts]
    assert unicodedata.is_normalized("NFC", texts[1]) and not unicodedata.is_normalized("NFC", texts[0])


def test_missing_characters_of_a_long_text(spark, monkeypatch):
    import pyarrow as pa

    corpus = spark.createDataFrame([("a" * 70_000 + "é" * 200_000 + "€",), ("b",), (None,)], "text string")  # the last character of all lies beyond a piece
    sets = charset_table(spark, ["ascii"])
    assert [tuple(r) for r in st.missing_characters(corpus, sets).collect()] == [("ascii", "é€")]
    batch = pa.record_batch([pa.array(["b", "aé" * 1_500_000 + "€", None])], names=["text"])  # 4.5 MB in one text
    out, peak = _peak_of_counting(monkeypatch, lambda: st.missing_characters(corpus, sets), batch)
    assert peak < 16 << 20 and {c: sum(n for d, n in out if d == c) for c, _ in out} == {"a": 1_500_000, "é": 1_500_000, "€": 1, "b": 1}
