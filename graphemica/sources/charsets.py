"""Named character sets, as Python strings and as a table."""

from __future__ import annotations

import functools
import string
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

UNKNOWN = "�"

# CEN CWA 13873: Unicode blocks of the Multilingual European Subsets, hexadecimal
_MES = {
    "mes1": "20-7e a0-17f 2b0-2ff 2000-206f 20a0-20cf 2100-21ff 2600-26ff",
    "mes2": "20-7e a0-2ff 370-4ff 1e00-209f 20a0-20cf 2100-23ff 2500-26ff fb00-fb4f fff0-fffd",
    "mes3a": "20-7e a0-4ff 530-58f 10d0-10ff 1e00-20ff 2100-23ff 2440-245f 2500-26ff fb00-fb4f fe20-fe2f fff0-fffd",
}
_ISO = tuple(f"iso_8859_{n}" for n in (*range(2, 12), *range(13, 17)))
_ASCII = {
    "ascii": string.printable, "ascii_lowercase": string.ascii_lowercase, "ascii_uppercase": string.ascii_uppercase,
    "ascii_letters": string.ascii_letters, "digits": string.digits, "hexdigits": string.hexdigits,
    "octdigits": string.octdigits, "punctuation": string.punctuation,
}


def from_ranges(ranges: str) -> str:
    """Characters of ranges such as ``20-7e a0``, each once, by code point."""
    points: set[int] = set()
    for part in ranges.split():
        low, _, high = part.partition("-")
        points.update(range(int(low, 16), int(high or low, 16) + 1))
    return "".join(map(chr, sorted(points)))


def _iso(name: str) -> str:
    """The printable characters of a code page's bytes from 32 on; a byte without one counts as the unknown character."""
    found = set()
    for b in range(32, 256):
        char = bytes([b]).decode(name, "replace")
        found.add(char if len(repr(char)) <= 3 else UNKNOWN)
    return "".join(sorted(found))


@functools.cache
def _mufi() -> dict[str, str]:
    lines = (Path(__file__).parent / "data" / "mufi.txt").read_text().splitlines()
    part = {k: from_ranges(v) for k, _, v in (x.partition(":") for x in lines if not x.startswith("#"))}
    bmp, pua = part["public_bmp"], part["public_bmp"] + part["private_bmp"]
    return {"mufibmp": bmp, "mufibmp_pua": pua, "mufinonbmp": part["public_nonbmp"], "mufinonbmp_pua": part["public_nonbmp"] + part["private_nonbmp"]}


def _full_bmp() -> str:
    """The basic plane without surrogates, private use and non-characters."""
    return "".join(chr(c) for c in range(0x10000) if not (0xD800 <= c <= 0xF8FF or 0xFDD0 <= c <= 0xFDEF or c >= 0xFFFE))


class Charsets:
    """The catalogue: ``charsets["mes1"]``, ``charsets.mes1``, iteration over names, ``items()``; sets are built when asked for."""

    bmp = ("mes1", "mes2", "mes3a", "mes3b", *_ISO, *_ASCII, "mufibmp", "mufibmp_pua")
    non_bmp = ("mufinonbmp", "mufinonbmp_pua")
    extra = ("full_bmp", "greek_polytonic")

    @functools.cache
    def __getitem__(self, name: str) -> str:
        if name == "mes3b":
            name = "mes3a"  # the same blocks
        if name in _MES:
            return from_ranges(_MES[name])
        if name in _ISO:
            return _iso(name)
        if name in _ASCII:
            return _ASCII[name]
        if name in (*self.bmp, *self.non_bmp):
            return _mufi()[name]
        if name == "full_bmp":
            return _full_bmp()
        if name == "greek_polytonic":
            return from_ranges("370-3ff 1f00-1fff")
        raise KeyError(name)

    def __getattr__(self, name: str) -> str:
        try:
            return self[name]
        except KeyError:
            raise AttributeError(name) from None

    def keys(self) -> list[str]:
        return [*self.bmp, *self.non_bmp]

    def __iter__(self) -> Iterator[str]:
        return iter(self.keys())

    def __len__(self) -> int:
        return len(self.keys())

    def __contains__(self, name: str) -> bool:
        return name in self.keys() or name in self.extra

    def values(self) -> list[str]:
        return [self[k] for k in self.keys()]

    def items(self) -> list[tuple[str, str]]:
        return [(k, self[k]) for k in self.keys()]


charsets = Charsets()


def charset_table(spark: SparkSession, names: list[str] | None = None) -> DataFrame:
    """charset(name, idx, chr, cp): the distinct characters of the named sets in the order of their first places."""
    rows = [(name, i, c, ord(c)) for name in (names or charsets.keys()) for i, c in enumerate(dict.fromkeys(charsets[name]))]
    return spark.createDataFrame(rows, "name string, idx int, chr string, cp int")
