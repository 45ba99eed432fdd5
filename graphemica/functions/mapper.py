"""Mapping characters to characters."""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.charsets import UNKNOWN
from .batches import in_pieces, points, raw, stretches, texts_of
from .similarity import char_similarity, similarity_mapping


def char_class(letters: str) -> str:
    """A regular expression's class of these characters, as ranges."""
    points = sorted({ord(c) for c in letters})
    parts: list[list[int]] = []
    for p in points:
        if parts and p == parts[-1][1] + 1:
            parts[-1][1] = p
        else:
            parts.append([p, p])
    return "".join(f"\\x{{{a:X}}}" if a == b else f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in parts)


class Mapper:
    """A total map of characters: those of ``mapping``, and ``unknown`` for all others.

    ``unit="codepoint"`` maps characters after normalisation to ``form`` (NFC by default); ``unit="utf16"`` maps code units
    as they are, so a character outside the basic plane becomes two unknown ones, and accepts only maps of the basic plane.
    Columns look every character up once, in a table of all code points, a whole batch at a time.
    """

    def __init__(self, mapping: dict[str, str] | str, unknown: str = UNKNOWN, unit: str = "codepoint", form: str | None = "nfc"):
        pairs = dict(mapping) if isinstance(mapping, dict) else {c: c for c in mapping}
        if pairs.get(unknown, unknown) != unknown:
            raise ValueError("the unknown character must map to itself")
        if any(len(a) != 1 or len(b) != 1 for a, b in pairs.items()) or len(unknown) != 1:
            raise ValueError("a map is of single characters")
        if unit == "utf16" and any(ord(c) > 0xFFFF for p in (*pairs.items(), (unknown,)) for c in p):
            raise ValueError("a 16-bit map holds characters of the basic plane only")
        self.mapping = {a: pairs[a] for a in sorted(pairs) if a != unknown}
        self.unknown, self.unit, self.form = unknown, unit, None if unit == "utf16" else form

    @classmethod
    def from_alphabets(cls, src: str, dst: str | None = None, override: dict[str, str] | None = None, min_similarity: float = 0.3, unknown: str = UNKNOWN, add_space: bool = True, kind: str = "guess", spark: SparkSession | None = None) -> Mapper:
        """The identity on ``src``, or the most similar character of ``dst`` for each of ``src``; ``kind``: "fast" for
        16-bit units, "generic" for code points, "guess" the first wherever it will do. With ``spark`` pairs are scored
        on the executors."""
        if add_space:
            src, dst = " " + src, dst if dst is None else " " + dst
        src = "".join(dict.fromkeys(src))
        if dst is None:
            pairs = {c: c for c in src} | (override or {})
        elif spark is not None:
            pairs = {r["src"]: r["dst"] for r in similarity_mapping(spark, src, dst, override, min_similarity, unknown).collect()}
        else:
            targets = list(dict.fromkeys(dst if unknown in dst else unknown + dst))
            pairs = dict(override or {})
            for c in src:
                if c not in pairs:
                    scores = [char_similarity(c, t) + (1e-5 if t == unknown else 0.0) for t in targets]
                    scores = [0.0 if s < min_similarity else s for s in scores]
                    pairs[c] = targets[scores.index(max(scores))]
        pairs.pop(unknown, None)
        small = all(ord(c) <= 0xFFFF for p in (*pairs.items(), (unknown,)) for c in p)
        unit = {"fast": "utf16", "generic": "codepoint", "guess": "utf16" if small else "codepoint"}[kind]
        return cls(pairs, unknown, unit)

    @property
    def src_alphabet(self) -> str:
        """The unknown character and the sources in order: a character's label is its index."""
        return self.unknown + "".join(self.mapping)

    @property
    def dst_alphabet(self) -> str:
        return "".join(dict.fromkeys(self.unknown + "".join(sorted(set(self.mapping.values())))))

    def __len__(self) -> int:
        return len(self.src_alphabet)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Mapper) and (self.mapping, self.unknown) == (other.mapping, other.unknown)

    def __hash__(self) -> int:
        return hash((tuple(self.mapping.items()), self.unknown))

    def __repr__(self) -> str:
        return f"Mapper({len(self.mapping)} to {len(set(self.mapping.values()))} characters, unit={self.unit!r})"

    def __call__(self, text: str) -> str:
        """One string, without Spark."""
        if self.form:
            text = unicodedata.normalize(self.form.upper(), text)
        wide = self.unknown * (2 if self.unit == "utf16" else 1)
        return "".join(self.mapping.get(c, wide if ord(c) > 0xFFFF else self.unknown) for c in text)

    def _table(self) -> np.ndarray:
        """The image of every code point."""
        out = np.full(0x110000, ord(self.unknown), np.uint32)
        out[[ord(c) for c in self.mapping]] = [ord(c) for c in self.mapping.values()]
        return out

    def column(self, text: Column) -> Column:
        """``text`` mapped; NULL stays NULL. One look-up a character, known or not, in Arrow batches; only texts that are not
        in the normal form are normalised."""

        @F.arrow_udf("string")
        def mapped(texts: pa.Array) -> pa.Array:
            return in_pieces(lambda piece: _apply(self, piece), texts)

        return mapped(text)

    def closed_column(self, text: Column, alphabet: str) -> Column:
        """``column`` for texts whose characters are all in ``alphabet`` and in the normal form, as a native expression."""
        out = {c: self.mapping.get(c, self.unknown) for c in alphabet}
        moved = {a: b for a, b in out.items() if a != b}
        return F.translate(text, "".join(moved), "".join(moved.values())) if moved else text

    def labels(self, text: Column) -> Column:
        """Indices into ``src_alphabet``, 0 for characters that are not there."""

        @F.arrow_udf("array<int>")
        def labelled(texts: pa.Array) -> pa.Array:
            code, bounds = points(texts)
            table = np.zeros(0x110000, np.int32)
            table[[ord(c) for c in self.mapping]] = np.arange(1, len(self.mapping) + 1)
            null = pc.is_null(texts) if texts.null_count else None
            return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(table[code]), mask=null)

        return labelled(text)

    def from_labels(self, labels: Column) -> Column:
        """The targets of labels; 0 and labels out of range give the unknown character."""
        letters = F.array(*[F.lit(c) for c in self.mapping.values()])
        return F.array_join(F.transform(labels, lambda i: F.coalesce(F.when(i > 0, F.get(letters, i - 1)), F.lit(self.unknown))), "")

    def onehot(self, text: Column, time_first: bool = True) -> Column:
        """For each character a vector with 1 at its label, or the transposed matrix."""
        labels, width = self.labels(text), len(self)
        one = lambda x, y: F.when(x == y, 1.0).otherwise(0.0)
        if time_first:
            return F.transform(labels, lambda x: F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda c: one(x, c)))
        row = lambda c: F.transform(labels, lambda x: one(x, F.lit(c)))  # noqa: E731  (labels must stand outside of a lambda)
        return F.array(*[row(c) for c in range(width)])

    def from_onehot(self, matrix: Column) -> Column:
        """The text of time-first vectors, by the place of each one's greatest value."""
        return self.from_labels(F.transform(matrix, lambda v: (F.array_position(v, F.array_max(v)) - 1).cast("int")))

    def pruned(self, letters: str) -> Mapper:
        """The map without sources that are not among ``letters``."""
        kept = set(letters)
        return Mapper({a: b for a, b in self.mapping.items() if a in kept}, self.unknown, self.unit, self.form)

    def for_demapping(self) -> Mapper:
        """What brings any text into the alphabet that a model reversing this map reads: the map itself, and its targets as
        they are."""
        return Mapper({c: c for c in self.dst_alphabet if c != self.unknown} | self.mapping, self.unknown, self.unit, self.form)

    def table(self, spark: SparkSession) -> DataFrame:
        """mapping(src, dst)."""
        return spark.createDataFrame(list(self.mapping.items()), "src string, dst string")


_tables: dict[Mapper, tuple[np.ndarray, bytes | None]] = {}


def _apply(mapper: Mapper, texts: pa.Array) -> pa.Array:
    """``texts`` mapped; a worker keeps the table of the last map."""
    if mapper not in _tables:
        _tables.clear()
        table = mapper._table()
        _tables[mapper] = table, table[:128].astype(np.uint8).tobytes() + bytes(128) if (table[:128] < 128).all() else None
    table, small = _tables[mapper]
    data, offsets = raw(texts)
    if small is not None and not (data > 127).any():  # a byte a character, before and after
        out = pa.StringArray.from_buffers(len(texts), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data.tobytes().translate(small)))
        return out if not texts.null_count else pc.if_else(pc.is_valid(texts), out, pa.scalar(None, pa.string()))
    if mapper.form and not unicodedata.is_normalized(mapper.form.upper(), data.tobytes().decode("utf-8", "surrogatepass")):
        texts = pa.array([t and unicodedata.normalize(mapper.form.upper(), t) for t in texts.to_pylist()], pa.string())
    if len(texts) != 1 or texts.null_count:
        return _looked_up(table, mapper.unit, texts)
    made = b"".join(raw(_looked_up(table, mapper.unit, part))[0].tobytes() for (part,) in stretches([texts]))  # it may be a long one
    return pa.StringArray.from_buffers(1, pa.py_buffer(np.array([0, len(made)], np.int32)), pa.py_buffer(made))


def _looked_up(table: np.ndarray, unit: str, texts: pa.Array) -> pa.Array:
    """The image of every character of ``texts``."""
    code, bounds = points(texts)
    out = table[code]
    if unit == "utf16" and (code > 0xFFFF).any():
        twice = 1 + (code > 0xFFFF).astype(np.int64)
        out, bounds = np.repeat(out, twice), np.concatenate(([0], np.cumsum(twice)))[bounds]
    return texts_of(out, bounds, texts)


def llemmatize(corpus: DataFrame, dst: str, text_col: str = "text", **options) -> DataFrame:
    """``corpus`` with its text mapped onto the alphabet ``dst``: the source alphabet is the corpus's own, found in one
    aggregate, so the map is derived for the characters that occur and applied in a single pass."""
    from ..operators.stats import alphabet_string

    letters = alphabet_string(corpus, text_col).first()["alphabet"] or ""
    mapper = Mapper.from_alphabets(letters, dst, spark=corpus.sparkSession, **options)
    mapped = mapper.column(F.col(text_col)) if mapper.form or mapper.unit == "utf16" and any(ord(c) > 0xFFFF for c in letters) else mapper.closed_column(F.col(text_col), letters)
    return corpus.withColumn(text_col, mapped)


def parse_map(text: Column) -> Column:
    """``a:b,c:d`` as a map."""
    return F.str_to_map(text, F.lit(","), F.lit(":"))
