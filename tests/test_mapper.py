import unicodedata

import pytest
from pyspark.sql import functions as F

from graphemica.functions import unicode as uc
from graphemica.functions.mapper import Mapper, llemmatize, parse_map
from graphemica.functions.similarity import adjust_linkage, char_similarity, distance_matrix, linkage, similarity_mapping
from graphemica.sources.charsets import UNKNOWN, charset_table, charsets
from graphemica.sources.sinks import alphabet_table, mapping_table, same_mapping

DNA = {"A": "a", "C": "c", "G": "g", "T": "t", "🧬": "🧬"}
EDGE = ["", None, "é", "A🧬b", "🧬🧬", "\t\n\r", "�", "ﬁ", "plain"]


def column(spark, f, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[0] for r in rows.orderBy("i").select(f(F.col("t"))).collect()]


def test_astral_characters(spark):
    assert column(spark, Mapper(DNA).column, ["ACGT🧬"]) == ["acgt🧬"]
    with pytest.raises(ValueError):
        Mapper(DNA, unit="utf16")


@pytest.mark.parametrize("unit", ["codepoint", "utf16"])
def test_unknown(spark, unit):
    m = Mapper({"A": "a", "C": "c", "G": "g", "T": "t", "a": "a", "c": "c", "g": "g", "t": "t"}, unknown="0", unit=unit)
    assert column(spark, m.column, ["ACGTacgtZ", None, ""]) == ["acgtacgt0", None, ""]


def test_units_differ_on_edge_strings(spark):
    m = {c: c for c in "Abeé"}
    points, units = Mapper(m), Mapper(m, unit="utf16")
    for mapper in (points, units):
        assert column(spark, mapper.column, EDGE) == [None if t is None else mapper(t) for t in EDGE]
    assert units("A🧬b") == f"A{UNKNOWN * 2}b" and points("A🧬b") == f"A{UNKNOWN}b"
    assert points("é") == "é" and units("é") == "e" + UNKNOWN


def test_replacement_characters_are_literal(spark):
    assert column(spark, Mapper("abc", unknown="$").column, ["abx\\"]) == ["ab$$"]
    assert column(spark, Mapper("abc]^-\\", unknown="?").column, ["a]^-\\z"]) == ["a]^-\\?"]


def test_labels_and_onehot(spark):
    m = Mapper("acgt")
    assert column(spark, m.labels, ["gattacaX"]) == [[3, 1, 4, 4, 1, 2, 1, 0]]
    assert column(spark, lambda t: m.from_labels(m.labels(t)), ["gatX"]) == ["gat" + UNKNOWN]
    assert column(spark, lambda t: m.from_onehot(m.onehot(t)), ["gatX"]) == ["gat" + UNKNOWN]
    assert column(spark, lambda t: m.onehot(t, time_first=False), ["a"]) == [[[0.0], [1.0], [0.0], [0.0], [0.0]]]
    assert len(m) == 5 and m.src_alphabet == UNKNOWN + "acgt"


def test_units_round_trip(spark):
    for dtype in ("uint8", "uint16", "uint32"):
        assert column(spark, lambda t, d=dtype: uc.decode_units(uc.encode_units(t, d), d), ["ACGTacgt é🧬", None]) == ["ACGTacgt é🧬", None]
    assert column(spark, uc.code_points, ["A🧬"]) == [[65, ord("🧬")]]
    assert column(spark, uc.utf16_length, ["A🧬"]) == [3]
    with pytest.raises(ValueError):
        uc.encode_units(F.lit("x"), "uint64")


@pytest.mark.parametrize("form,name", [("nfc", "NFC"), ("Dense", "NFC"), ("composite", "NFD"), ("nfd", "NFD")])
def test_normal_forms(spark, form, name):
    texts = [*EDGE, "à̖é", "Å", "각", "क़", "ạ̇"]
    assert column(spark, lambda t: uc.normalize(t, form), texts) == [None if t is None else unicodedata.normalize(name, t) for t in texts]
    assert column(spark, lambda t: uc.normalize(t, None), ["é"]) == ["é"]


def test_greek_worked_example():
    text = "Καὶ ὅτε ἤνοιξεν τὴν σφραγῖδα τὴν ἑβδόμην, ἐγένετο σιγὴ ἐν τῷ οὐρανῷ ὡς ἡμιώριον."
    assert Mapper.from_alphabets(text, charsets["iso_8859_7"])(text) == "Καί ότε ήνοιξεν τήν σφραγίδα τήν έβδόμην, έγένετο σιγή έν τώ ούρανώ ώς ήμιώριον."
    assert Mapper.from_alphabets(text, charsets["ascii"])(text) == "Kai ote enoixen ten spragida ten ebdomen, egeneto sige en to ourano os emiorion."


def test_similarity():
    assert char_similarity("a", "a") == 1.0
    assert char_similarity("a", "b") == char_similarity("b", "a")
    assert max("abcdefé", key=lambda c: char_similarity("è", c)) in "eé"
    assert all(0 <= char_similarity(a, b) <= 1 for a in "aZ9. \n" for b in "éß\t-")


def test_similarity_mapping_is_the_local_one(spark):
    src, dst = "àéîõüß1", charsets["ascii"]
    local = Mapper.from_alphabets(src, dst, add_space=False).mapping
    far = {r["src"]: r["dst"] for r in similarity_mapping(spark, src, dst, min_similarity=0.3).collect()}
    assert far == local and local["à"] == "a" and local["1"] == "1"
    fixed = {r["src"]: r["dst"] for r in similarity_mapping(spark, src, dst, override={"é": "E"}).collect()}
    assert fixed["é"] == "E"


def test_llemmatize_corpus(spark):
    df = spark.createDataFrame([(1, "déjà vu"), (2, None), (3, "")], "id int, text string")
    assert [r.text for r in llemmatize(df, charsets["ascii"]).orderBy("id").collect()] == ["deja vu", None, ""]


def test_map_option_and_pruning(spark):
    assert column(spark, parse_map, ["a:b,c:d"]) == [{"a": "b", "c": "d"}]
    assert Mapper("abc").pruned("bcd").mapping == {"b": "b", "c": "c"}
    assert same_mapping(mapping_table(spark, Mapper("ab")), mapping_table(spark, Mapper("ba")))
    assert not same_mapping(mapping_table(spark, Mapper("ab")), mapping_table(spark, Mapper("abc")))
    names = {r["chr"]: r["name"] for r in alphabet_table(spark, Mapper("a\n")).collect()}
    assert names["a"] == "LATIN SMALL LETTER A" and names["\n"] == ""


def test_charsets(spark):
    assert len(charsets) == 29 or len(charsets) == 30
    assert len(charsets["mes3a"]) == 3549 == len(charsets.mes3b) and len(charsets["ascii"]) == 100
    assert "iso_8859_12" not in charsets and "Ω" in charsets["iso_8859_7"] and UNKNOWN in charsets["iso_8859_2"]
    with pytest.raises(KeyError):
        charsets["iso_8859_12"]
    assert len(charsets["mufinonbmp"]) == 11 and set(charsets["mufibmp"]) < set(charsets["mufibmp_pua"])
    assert all(not 0xD800 <= ord(c) < 0xE000 for c in charsets["full_bmp"])
    t = charset_table(spark, ["digits"]).collect()
    assert [(r.idx, r.chr, r.cp) for r in t][:2] == [(0, "0", 48), (1, "1", 49)]


def test_distance_matrix_and_linkage(spark):
    d = distance_matrix(spark, "aàbz")
    rows = {(r.a, r.b): r.d for r in d.collect()}
    assert len(rows) == 16 and rows["a", "a"] == 0 and rows["a", "à"] == rows["à", "a"] == 1 - char_similarity("a", "à")
    steps = linkage(d)
    assert set(steps[0][:2]) == {"a", "à"} and steps[-1][3] == 4
    raised = adjust_linkage(steps, gap=0.3)
    assert all(b[2] >= a[2] for a, b in zip(steps, raised)) or raised


def test_texts_of_a_batch(spark):
    import pyarrow as pa

    from graphemica.functions.batches import points, texts_of

    texts = ["", "abc", None, "é€🧬", "x"]
    for part in (pa.array(texts, pa.string()), pa.array(["drop", *texts], pa.string()).slice(1), pa.array(texts, pa.large_string())):
        code, bounds = points(part)
        assert [code[a:z].tolist() for a, z in zip(bounds[:-1], bounds[1:])] == [[ord(c) for c in t or ""] for t in texts]
        assert texts_of(code, bounds, part).to_pylist() == texts
    m = Mapper({"a": "b", "é": "e", "🧬": "d"}, unknown="?")
    wide = [*texts, "e\u0301a", "🧬a"]
    assert column(spark, m.column, wide) == [None if t is None else m(t) for t in wide]
    u = Mapper({"a": "b", "é": "e"}, unknown="?", unit="utf16")
    assert column(spark, u.column, wide) == [None if t is None else u(t) for t in wide]


def test_map_before_demapping():
    m = Mapper({"Ü": "U", "u": "u"}, unknown="?").for_demapping()
    assert m("ÜUux") == "UUu?"


def test_cyrillic(spark):
    from graphemica.functions.unicode import to_ascii

    assert "".join(map(to_ascii, "Щука, ёж")) == "Shchuka, iozh"
