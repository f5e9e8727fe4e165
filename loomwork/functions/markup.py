"""Web and book markup to plain text with style tokens, and back into paragraphs.

The text form: ESC L, C or R once before the first output (alignment), ESC B/b and I/i
around bold and italic runs, two line feeds between paragraphs. One pass over the tags of
a page, a small state, no tree."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

ESC = "\x1b"
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9]*)([^>]*)>|<[^>]*>|&(#?[a-zA-Z0-9]+);|([^<&]+|[<&])", re.DOTALL)
#: Named characters that are known; others stay as typed.
NAMED = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "shy": "", "mdash": "—", "ndash": "–",
    "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”", "hellip": "…",
}
_HIDDEN = frozenset(("head", "style", "script"))
_PARAGRAPHS = frozenset(("p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "blockquote"))
_STYLES = {"b": "B", "strong": "B", "i": "I", "em": "I"}


def _char(name: str) -> str | None:
    if name in NAMED:
        return NAMED[name]
    if name.startswith("#"):
        digits = name[1:]
        try:
            n = int(digits[1:], 16) if digits[:1] in "xX" else int(digits)
        except ValueError:
            return None
        return "" if n == 0xAD else chr(n) if 0 < n < 0x110000 and not 0xD800 <= n < 0xE000 else None
    return None


def to_tokens(html: str | None, fixed: bool = True) -> str:
    """The text form of some markup; null and empty give the empty text.

    ``fixed=False`` keeps the quirks of the firmware's stripper that books were paged
    with: a paragraph's tag does not flush a word (``<p>Hi</p><p>Yo</p>`` gives ``HiYo``),
    a hidden block ends at any hidden block's end tag, 4-byte characters vanish, an
    alignment set by a heading is lost unless text was written before the paragraph."""
    out: list[str] = []
    word = ""
    align, hidden, gap, breaks = "L", [], False, 0
    written = False

    def put(text: str) -> None:
        nonlocal written, gap, breaks
        if not written:
            out.append(ESC + align)
            written = True
        elif breaks:
            out.append("\n" * breaks)
        elif gap:
            out.append(" ")
        gap, breaks = False, 0
        out.append(text)

    def flush() -> None:
        nonlocal word
        if word:
            text, word = word, ""
            put(text)

    for m in _TAG.finditer(html or ""):
        closing, tag, attributes, entity, text = m.groups()
        if tag:
            tag = tag.lower()
            if tag in _HIDDEN:
                if not closing and not attributes.endswith("/"):
                    hidden.append(tag)
                elif closing and hidden:
                    hidden = hidden[: hidden.index(tag)] if fixed and tag in hidden else [] if not fixed else hidden
            elif hidden:
                continue
            elif tag in _STYLES:
                flush()
                if written or closing:
                    code = _STYLES[tag]
                    token = ESC + (code.lower() if closing else code)
                    if closing:
                        out.append(token) if written else put(token)
                    else:
                        put(token)
                elif fixed:
                    put(ESC + _STYLES[tag])
            elif tag == "br":
                flush()
                breaks = min(2, breaks + 1) if written else 0
            elif tag == "li" and not closing:
                flush()
                breaks = max(breaks, 1) if written else 0
                put("-")
                gap = True
            elif tag in _PARAGRAPHS:
                if fixed:
                    flush()
                if tag[0] == "h" and not closing:
                    align = "C"
                elif tag == "p" and not closing:
                    align = "R" if re.search(r"text-align:\s*right", attributes) else "C" if re.search(r"text-align:\s*center", attributes) else "L"
                if written and (fixed or tag not in ("ul", "ol")):
                    breaks = 2 if tag not in ("ul", "ol") else max(breaks, 1)
            continue
        if hidden or m.group().startswith("<") and not text:
            continue
        piece = text
        if entity is not None:
            known = _char(entity)
            piece = m.group() if known is None else known
        piece = piece.replace("\xad", "")
        if not fixed and entity is None:
            piece = "".join(ch for ch in piece if ord(ch) < 0x10000)
        for part in re.findall(r"[A-Za-z]+|\s+|[^A-Za-z\s]+", piece):
            if part.isspace():
                flush()
                gap = written and not breaks
            elif part.isascii() and part.isalpha():
                word += part
            else:
                flush()
                put(part)
    flush()
    return "".join(out).rstrip(" \n")


#: Pages whose text is in memory twice, as Arrow's and as Python's.
PAGES = 64


def _in_parts(html: pa.Array, fixed: bool) -> pa.Array:
    parts = [pa.array([to_tokens(h, fixed) for h in html.slice(at, PAGES).to_pylist()], pa.string()) for at in range(0, len(html), PAGES)]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


@F.arrow_udf(StringType())
def _stripped(html: pa.Array) -> pa.Array:
    return _in_parts(html, True)


@F.arrow_udf(StringType())
def _stripped_as_is(html: pa.Array) -> pa.Array:
    return _in_parts(html, False)


def strip(html: Column, fixed: bool = True) -> Column:
    """``to_tokens`` of a column, in Arrow batches; null gives the empty text."""
    return (_stripped if fixed else _stripped_as_is)(html)


def paragraphs(df: DataFrame, keys: list[str], tokens: str) -> DataFrame:
    """A row for each paragraph that is not blank: keys, n (from 0), align, has_style,
    text (without tokens)."""
    rows = df.select(*keys, F.posexplode(F.split(tokens, "\n\n")).alias("n", "p"))
    rows = rows.filter(~F.col("p").rlike("^[ \n]*$"))
    plain = F.regexp_replace("p", ESC + "[LCRBbIi]", "")
    align = F.coalesce(F.nullif(F.regexp_extract("p", f"^{ESC}([LCR])", 1), F.lit("")), F.lit("L"))
    return rows.select(*keys, "n", align.alias("align"), F.col("p").rlike(ESC + "[BbIi]").alias("has_style"), plain.alias("text"))


def style_runs(df: DataFrame, keys: list[str], paragraph: str) -> DataFrame:
    """A row for each run of one style: keys, run, bold, italic, text. The paragraph is
    split at its tokens; a fold over the array of pieces carries the state."""
    pieces = F.split(paragraph, f"(?={ESC}[BbIi])")
    start = F.struct(F.lit(False).alias("b"), F.lit(False).alias("i"), F.array().cast("array<struct<bold:boolean,italic:boolean,text:string>>").alias("out"))

    def step(a: Column, p: Column) -> Column:
        code = F.when(p.startswith(ESC), F.substring(p, 2, 1)).otherwise(F.lit(""))
        b = F.when(code == "B", F.lit(True)).when(code == "b", F.lit(False)).otherwise(a["b"])
        i = F.when(code == "I", F.lit(True)).when(code == "i", F.lit(False)).otherwise(a["i"])
        text = F.regexp_replace(p, f"^{ESC}[BbIi]", "")
        return F.struct(b.alias("b"), i.alias("i"), F.when(text == "", a["out"]).otherwise(F.concat(a["out"], F.array(F.struct(b.alias("bold"), i.alias("italic"), text.alias("text"))))).alias("out"))

    runs = F.aggregate(pieces, start, step, lambda a: a["out"])
    return df.select(*keys, F.posexplode(runs).alias("run", "r")).select(*keys, "run", "r.bold", "r.italic", "r.text")
