"""Code units, normal forms, character names and plain-letter forms."""

from __future__ import annotations

import functools
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_FORMS = {"dense": "NFC", "nfc": "NFC", "composite": "NFD", "nfd": "NFD", "none": None, None: None}


def encode_units(text: Column, dtype: str = "uint16") -> Column:
    """The text's code units as little-endian bytes: uint8 (UTF-8), uint16 (UTF-16) or uint32 (UTF-32)."""
    names = {"uint8": "UTF-8", "uint16": "UTF-16LE"}
    if dtype in names:
        return F.encode(text, names[dtype])
    if dtype == "uint32":
        return F.unhex(F.array_join(F.transform(code_points(text), lambda c: F.concat(*[F.lpad(F.hex(F.shiftright(c, s).bitwiseAND(255)), 2, "0") for s in (0, 8, 16, 24)])), ""))
    raise ValueError(f"no encoding for {dtype}")


def decode_units(units: Column, dtype: str = "uint16") -> Column:
    """The inverse of ``encode_units``."""
    names = {"uint8": "UTF-8", "uint16": "UTF-16LE"}
    if dtype in names:
        return F.decode(units, names[dtype])
    if dtype == "uint32":
        quads = F.regexp_extract_all(F.hex(units), F.lit("(........)"))
        return F.array_join(F.transform(quads, lambda h: F.decode(F.unhex(F.concat(F.substring(h, 7, 2), F.substring(h, 5, 2), F.substring(h, 3, 2), F.substring(h, 1, 2))), "UTF-32")), "")
    raise ValueError(f"no encoding for {dtype}")


def code_points(text: Column) -> Column:
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c))


def from_code_point(cp: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(cp), 8, "0")), "UTF-32")


def utf16_length(text: Column) -> Column:
    """The number of UTF-16 code units: characters outside the basic plane count twice."""
    return (F.length(F.encode(text, "UTF-16LE")) / 2).cast("int")


def in_bmp(text: Column) -> Column:
    return ~text.rlike(r"[\x{10000}-\x{10FFFF}]")


def _normaliser(form: str):
    @F.pandas_udf("string")
    def normal(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: unicodedata.normalize(form, t), na_action="ignore")

    return normal


def normalize(text: Column, form: str | None = "nfc") -> Column:
    """The text in normal form "nfc" ("dense"), "nfd" ("composite") or as it is ("none" or None). Text that no normal form
    changes, plain ASCII and for NFC anything below the combining marks, stays in the JVM."""
    name = _FORMS[form.lower() if form else None]
    if name is None:
        return text
    settled = r"[^\x00-\x7F]" if name == "NFD" else r"[^\x{0}-\x{2FF}]"
    # the function sees NULL in place of settled texts: a UDF is worked out for every row, whatever CASE says
    return F.coalesce(_normaliser(name)(F.when(text.rlike(settled), text)), text)


def strip_accents(text: Column) -> Column:
    """The text without combining marks."""
    return F.regexp_replace(normalize(text, "nfd"), r"\p{Mn}+", "")


@functools.cache
def _extra() -> dict[int, str]:
    plain = {"ß": "ss", "Æ": "AE", "æ": "ae", "Œ": "OE", "œ": "oe", "Ø": "O", "ø": "o", "Đ": "D", "đ": "d", "Ł": "L", "ł": "l", "Þ": "Th", "þ": "th", "Ð": "D", "ð": "d", "ı": "i", "ſ": "s", "ẞ": "SS", "Ħ": "H", "ħ": "h", "Ŋ": "NG", "ŋ": "ng", "‘": "'", "’": "'", "“": '"', "”": '"', "–": "-", "—": "--", "…": "...", "€": "EUR", "«": "<<", "»": ">>"}
    greek = dict(zip("αβγδεζηθικλμνξοπρσςτυφχψω", ["a", "b", "g", "d", "e", "z", "e", "th", "i", "k", "l", "m", "n", "x", "o", "p", "r", "s", "s", "t", "u", "ph", "kh", "ps", "o"], strict=True))
    cyrillic = dict(zip("абвгдежзийклмнопрстуфхцчшщъыьэюяёђєѕіїјљњћќўџ", "a b v g d e zh z i i k l m n o p r s t u f kh ts ch sh shch \" y ' e iu ia io dj ie dz i yi j lj nj c k u dzh".split(), strict=True))
    greek |= cyrillic
    return {ord(k): v for k, v in plain.items()} | {ord(k): v for k, v in greek.items()} | {ord(k.upper()): v.capitalize() for k, v in greek.items() if k != "ς"}


@functools.lru_cache(maxsize=1 << 17)
def to_ascii(char: str) -> str:
    """Plain letters for a character: compatibility decomposition without marks, Greek, Cyrillic and some Latin letters by table, ""
    for what has none."""
    out = []
    if ord(char) in _extra():  # such as a letter of its own that only looks like a letter with a mark
        return _extra()[ord(char)]
    for c in unicodedata.normalize("NFKD", char).translate(_extra()):
        if not unicodedata.combining(c):
            out.append(c if c < "\x80" else _extra().get(ord(c), ""))
    return "".join(out)


def transliterate(text: Column) -> Column:
    @F.pandas_udf("string")
    def plain(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: "".join(c if c < "\x80" else to_ascii(c) for c in t), na_action="ignore")

    return F.coalesce(plain(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)


def character_table(spark: SparkSession, letters: str) -> DataFrame:
    """(chr, cp, hex, name, category): name "" where there is none."""
    rows = [(c, ord(c), f"{ord(c):x}", unicodedata.name(c, ""), unicodedata.category(c)) for c in dict.fromkeys(letters)]
    return spark.createDataFrame(rows, "chr string, cp int, hex string, name string, category string")
