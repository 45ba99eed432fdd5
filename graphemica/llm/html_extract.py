"""HTML extraction: line-block distribution (operator 4)."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, q

#: Empty lines of a dive; characters that a block must exceed where the main text begins; lines of text of a block.
BLOCK, SURGE, SPAN = 2, 120, 3
_DROPPED = "(?is)<!--.*?-->|" + "|".join(rf"<{t}\b[^>]*>.*?</{t}\s*>" for t in ("script", "style", "noscript", "template", "svg", "head"))
_BREAKS = r"""(?is)</?(address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|header|hr|html|li|main|nav|ol|option|p|pre|section|select|table|tbody|td|tfoot|th|thead|title|tr|ul)\b[^<>"']*("[^"]*"[^<>"']*|'[^']*'[^<>"']*)*>"""
_TAGS = r"""(?s)</?[A-Za-z!?][^<>"']*("[^"]*"[^<>"']*|'[^']*'[^<>"']*)*>"""
#: Replaced before any other, as nearly all are of these; none of them begins a new one.
_COMMON = {"nbsp": "\xa0", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "copy": "©", "middot": "·", "mdash": "—", "ndash": "–", "hellip": "…"}
_NAMED = {"amp": "&"} | {k[:-1]: v for k, v in html5.items() if k[-1] == ";" and k[:-1] not in _COMMON and k != "amp;"}
_ENTITY = "&(#[0-9]{1,9}|#[xX][0-9A-Fa-f]{1,8}|[A-Za-z][A-Za-z0-9]{1,31});"
#: What browsers read numbers from 128 to 159 as.
_WINDOWS = {0x80 + i: c for i, c in enumerate(bytes(range(0x80, 0xA0)).decode("cp1252", "replace")) if c != "\ufffd"}


def decode_entities(text: Column) -> Column:
    """``text`` with its character references replaced: numbers, and all names of HTML 5, closed by a semicolon. Numbers of no
    character become U+FFFD; unknown names stay."""
    table = lambda d: F.from_json(F.lit(json.dumps(d)), "map<string,string>")

    def char(ref: Column) -> Column:
        name = F.substring(ref, 2, F.length(ref) - 2)
        number = F.when(F.substring(name, 2, 1).isin("x", "X"), F.conv(F.substring(name, 3, 8), 16, 10)).otherwise(F.substring(name, 2, 9)).cast("long")
        none = (number == 0) | (number > 0x10FFFF) | number.between(0xD800, 0xDFFF)
        one = F.when(none, F.lit("\ufffd")).when(number.between(0x80, 0x9F), F.coalesce(F.element_at(table({str(k): v for k, v in _WINDOWS.items()}), number.cast("string")), F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")))
        one = one.otherwise(F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32"))
        return F.when(F.substring(name, 1, 1) == "#", one).otherwise(F.coalesce(F.element_at(table(_COMMON | _NAMED), name), ref))

    refs, pieces = F.regexp_extract_all(text, F.lit(_ENTITY), 0), F.split(text, _ENTITY)
    whole = F.array_join(F.zip_with(pieces, F.transform(refs, char), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    return F.when(text.rlike(_ENTITY), whole).otherwise(text)


def without_markup(html: Column) -> Column:
    """A page without its markup: block-level tags become line feeds, other tags vanish, blanks are squeezed; character
    references stay."""
    # possessive, which Java matches in a loop and not by recursion: a tag may have any number of attributes
    breaks, tags = _BREAKS.replace(")*>", ")*+>"), _TAGS.replace(")*>", ")*+>")
    text = F.regexp_replace(html, _DROPPED, "\n")
    text = F.regexp_replace(F.regexp_replace(text, "[ \\t\\r\\n]+", " "), breaks, "\n")
    text = F.regexp_replace(text, tags, "")
    for name, char in _COMMON.items():
        text = F.replace(text, F.lit(f"&{name};"), F.lit(char))
    return text


def lines_of(text: Column) -> Column:
    return F.transform(F.split(F.regexp_replace(decode_entities(text), "[ \\x{A0}]+", " "), "\n"), lambda x: F.trim(x))


def html_lines(html: Column) -> Column:
    """The lines of a page without its markup, its character references replaced."""
    return lines_of(without_markup(html))


def main_lines(lines: Column, block: int = BLOCK, surge: int = SURGE) -> Column:
    """Those lines that lie between a surge and the next dive.

    The i-th block is the text length of lines i to i + block - 1. A surge is a block of more than ``surge`` characters;
    a dive is an empty block. Every line from a surge up to the next dive is kept.
    """
    # nothing but its own variables inside a lambda: what stands there is worked out for every element
    sizes = F.transform(lines, lambda x: F.length(x))
    blocks = sizes
    for k in range(2, block + 1):
        blocks = F.zip_with(blocks, F.slice(sizes, k, F.greatest(F.size(sizes), F.lit(1))), lambda a, b: F.when(a.isNotNull(), a + F.coalesce(b, F.lit(0))))
    # one letter a line: z a dive, h a surge, l neither; then every l that follows no h since the last z becomes x
    marks = F.array_join(F.transform(blocks, lambda b: F.when(b == 0, "z").when(b > surge, "h").otherwise("l")), "")
    kept = F.split(F.regexp_replace(marks, r"(?:\G|(?<=z))l", "x"), "")
    pairs = F.zip_with(lines, kept, lambda x, m: F.when(m.isin("h", "l") & (F.length(x) > 0), x))
    return F.filter(pairs, lambda x: x.isNotNull())


def squeezed(lines: Column, block: int, span: int) -> Column:
    """``lines`` for blocks of ``span`` text lines: ``block`` empty lines or more become ``span``, shorter gaps vanish."""
    text = F.regexp_replace(F.array_join(lines, "\n"), rf"\n{{{block + 1},}}", "\x01")
    return F.split(F.replace(F.regexp_replace(text, "\n+", "\n"), F.lit("\x01"), F.lit("\n" * (span + 1))), "\n")


def extract(pages: DataFrame, block: int = BLOCK, surge: int = SURGE, html_col: str = "html", out_col: str = "text", span: int | None = SPAN) -> DataFrame:
    """``pages`` with the main text of ``html_col`` in ``out_col``, which replaces ``html_col``.

    A surge is looked for in blocks of ``span`` text lines, over the gaps between them that are too short for a dive, so that
    short paragraphs surge together; a dive is ``block`` empty lines. With ``span=None`` blocks are ``block`` lines of any kind.

    - NULL page: NULL text. Empty page, or one without a surge: the empty text.
    - Very long pages are one expression like any other; an unclosed comment, script or head keeps its text as text, an
      unclosed tag as well.
    - Ties cannot arise: a block is compared with a constant. Repeated rows give repeated results.
    - Empty table: empty result. Extra columns stay; one named as ``out_col``, in any letter case, is replaced.
    - A control character U+0001 counts as a dive; references without a semicolon stay as they are.
    """
    raw, lines = fresh(pages, "raw", "lines")
    # each is named more than once by the next, so it stays a column of its own and is worked out once
    out = pages.withColumn(raw, without_markup(q(html_col))).withColumn(lines, lines_of(q(raw)))
    if span is not None:
        out, block = out.withColumn(lines, squeezed(q(lines), block, span)), span
    text = F.array_join(main_lines(q(lines), block, surge), "\n").alias(out_col)
    return out.select(*[q(c) for c in pages.columns if c.lower() not in (html_col.lower(), out_col.lower())], text)


def _sql() -> str:
    lit = lambda s: "'" + s.replace("'", "''") + "'"
    text = f"regexp_replace(html, {lit(_DROPPED)}, chr(10), 'g')"
    text = f"regexp_replace(regexp_replace({text}, '[ \\t\\r\\n]+', ' ', 'g'), {lit(_BREAKS)}, chr(10), 'g')"
    text = f"regexp_replace({text}, {lit(_TAGS)}, '', 'g')"
    names = ", ".join(f"{lit(k)}: {lit(v)}" for k, v in (_COMMON | _NAMED).items())
    windows = ", ".join(f"{k}: {lit(v)}" for k, v in _WINDOWS.items())
    number = "CASE WHEN r[3] IN ('x', 'X') THEN CAST('0x' || r[4:-2] AS BIGINT) ELSE CAST(r[3:-2] AS BIGINT) END"
    char = f"CASE WHEN r[2] <> '#' THEN coalesce(m[r[2:-2]], r) WHEN ({number}) BETWEEN 128 AND 159 THEN coalesce(w[CAST({number} AS INTEGER)], chr(CAST({number} AS INTEGER))) WHEN ({number}) BETWEEN 1 AND 55295 OR ({number}) BETWEEN 57344 AND 1114111 THEN chr(CAST({number} AS INTEGER)) ELSE chr(65533) END"
    return f"""
WITH names AS (SELECT MAP {{{names}}} AS m, MAP {{{windows}}} AS w),
c AS (SELECT page_id, url, {text} AS x, m, w FROM pages, names),
e AS (
  SELECT page_id, url, string_split_regex(x, {lit(_ENTITY)}) AS pieces,
    list_transform(regexp_extract_all(x, {lit(_ENTITY)}), lambda r: {char}) AS chars FROM c
),
d AS (SELECT page_id, url, array_to_string(list_transform(range(1, len(pieces) + 1), lambda i: pieces[i] || coalesce(chars[i], '')), '') AS x FROM e),
s AS (SELECT page_id, url, array_to_string(list_transform(string_split(regexp_replace(x, '[ \\x{{A0}}]+', ' ', 'g'), chr(10)), lambda y: trim(y)), chr(10)) AS x FROM d),
t AS (
  SELECT page_id, url, string_split(replace(regexp_replace(regexp_replace(x, '\\n{{{BLOCK + 1},}}', chr(1), 'g'), '\\n+', chr(10), 'g'), chr(1), repeat(chr(10), {SPAN + 1})), chr(10)) AS ls FROM s
),
l AS (SELECT page_id, url, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM t),
b AS (SELECT *, sum(length(line)) OVER (PARTITION BY page_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {SPAN - 1} FOLLOWING) AS block FROM l),
m AS (
  SELECT *, coalesce(max(CASE WHEN block = 0 THEN i END) OVER w, 0) AS dive, coalesce(max(CASE WHEN block > {SURGE} THEN i END) OVER w, 0) AS surge
  FROM b WINDOW w AS (PARTITION BY page_id ORDER BY i ROWS UNBOUNDED PRECEDING)
)
SELECT page_id, url, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (surge > dive AND line <> ''), '') AS text FROM m GROUP BY page_id, url
"""


SQL = _sql()
