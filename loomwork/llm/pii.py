"""Personal data, in DataFrame functions only.

Regular expressions propose spans, checksums confirm them (Luhn for cards, mod 97 for
account numbers, ranges for addresses), and words near a span adjust its score. Places
are code points, the end exclusive. A pattern's matches and the gaps between them come
from the same expression, so the places are running sums of their lengths; these are taken
in portions (``scan``), so that a text costs in proportion to its length and its matches."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.let import let


@dataclass(frozen=True)
class Kind:
    """``shortest``: characters that any match of the pattern has at least. ``base`` spans are
    kept whatever their score; others from ``min_score`` on."""

    name: str
    pattern: str
    shortest: int
    score: float
    checked: float
    context: tuple[str, ...]
    base: bool = True
    min_score: float = 0.0


#: The patterns are written so that each start is tried once and no part is read again
#: (possessive parts, looks behind): they stay linear on texts without blanks.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 5, 0.8, 0.0, ("mail", "contact", "write", "address", "kontakt", "correo")),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", 7, 0.4, 0.3, ("ip", "server", "host", "address", "login", "adresse")),
    Kind("card", r"[0-9]++(?:[ -][0-9]++)*+", 1, 0.3, 0.5, ("card", "visa", "credit", "mastercard", "karte", "carte", "tarjeta")),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", 4, 0.5, 0.1, ("phone", "call", "tel", "mobile", "fax", "telefon", "tél", "teléfono")),
    Kind("iban", r"(?<![A-Za-z0-9_])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9_])", 12, 0.2, 0.6, ("iban", "account", "bank", "konto", "compte", "cuenta"), base=False, min_score=0.5),
)
#: Characters before and after a span that are searched for context words, and what a
#: hit adds.
CONTEXT_CHARS, CONTEXT_GAIN = 40, 0.15


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    # every second digit from the right is doubled; 9 is taken from what exceeds 9
    places = F.split(F.reverse(digits), "")
    values = F.transform(places, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(values, F.lit(0), lambda a, v: a + v) % 10 == 0


def mod97(code: Column) -> Column:
    """Whether an account number (letters and digits) leaves 1 modulo 97."""
    turned = F.concat(F.substring(code, 5, 64), F.substring(code, 1, 4))
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda a, ch: F.when(ch.between("0", "9"), (a * 10 + F.ascii(ch) - 48) % 97).otherwise((a * 100 + F.ascii(ch) - 55) % 97)) == 1


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: F.length(F.ltrim(p, F.lit("0"))).between(0, 3) & (F.try_to_number(F.lpad(F.right(p, F.lit(3)), 3, "0"), F.lit("999")) <= 255))
    if kind == "card":
        digits = _digits(match)
        return F.when(F.length(digits).between(14, 19), luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(match)).between(10, 15)
    if kind == "iban":
        code = F.replace(match, F.lit(" "), F.lit(""))
        return F.when(F.length(code).between(15, 34), mod97(code)).otherwise(F.lit(False))
    return F.lit(True)


_SPAN = "array<struct<start:int,kind_no:int,kind:string,end:int,score:double>>"
#: Array elements that are folded at once.
PORTION = 64


def _none() -> Column:
    return F.array().cast(_SPAN)


def portions(items: Column, size: int = PORTION) -> Column:
    """An array in arrays of ``size`` elements at most; an empty one in one empty array. The
    elements are taken one by one, as slice() reads its whole array."""

    def of(items: Column) -> Column:
        last = F.greatest(F.floor((F.size(items) - 1) / size).cast("int"), F.lit(0))
        part = lambda k: F.transform(F.sequence(k * size, F.least((k + 1) * size, F.size(items)) - 1), lambda i: F.get(items, i))
        return F.transform(F.sequence(F.lit(0), last), lambda k: F.when(F.size(items) > 0, part(k)).otherwise(items))

    return let(items, of)


def scan(items: Column, step: Callable[[Column, Column], Column], keep: Callable[[Column, Column], Column], out: Callable[[Column, Column], Column], kind: str) -> Column:
    """``out(n, item)`` (of type ``kind``) of each item for which ``keep(n, item)`` holds,
    where n is what ``step`` has made of 0 and the items before. Lists grow inside a portion
    and over the portions, never over all items."""

    def of(parts: Column) -> Column:
        none = F.struct(F.lit(0).alias("n"), F.array().cast("array<int>").alias("all"))
        firsts = F.aggregate(parts, none, lambda a, p: F.struct(F.aggregate(p, a["n"], step).alias("n"), F.concat(a["all"], F.array(a["n"])).alias("all")), lambda a: a["all"])
        one = lambda a, x: F.struct(step(a["n"], x).alias("n"), F.when(keep(a["n"], x), F.concat(a["out"], F.array(out(a["n"], x).cast(kind)))).otherwise(a["out"]).alias("out"))
        inside = lambda z: F.aggregate(z["p"], F.struct(z["n"].alias("n"), F.array().cast(f"array<{kind}>").alias("out")), one, lambda a: a["out"])
        return F.flatten(F.transform(F.arrays_zip(parts.alias("p"), firsts.alias("n")), inside))

    return let(portions(items), of)


def _spans_of(text: Column, kind_no: int, kind: Kind) -> Column:
    """The spans of one kind, from the gaps and matches of its pattern."""
    matches = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    # a match with the gap before it; the last gap has no match
    pairs = F.arrays_zip(F.split(text, kind.pattern, -1).alias("g"), matches.alias("m"))
    near = "(?i)(?<![\\p{L}\\p{N}])(?:" + "|".join(kind.context) + ")"

    def scored(pairs: Column, confirmed: Column, tails: Column, heads: Column) -> Column:
        def one(s: Column) -> Column:
            # so many pairs hold the context; taken one by one, as slice() reads its whole array
            n = -(-CONTEXT_CHARS // kind.shortest)
            before = F.right(F.concat_ws("", *[F.get(tails, s["i"] - k) for k in range(n, 0, -1)], pairs[s["i"]]["g"]), F.lit(CONTEXT_CHARS))
            after = F.left(F.concat_ws("", *[F.get(heads, s["i"] + k) for k in range(1, n + 1)]), F.lit(CONTEXT_CHARS))
            score = F.lit(kind.score + kind.checked) + F.when(F.concat_ws(" ", before, after).rlike(near), F.lit(CONTEXT_GAIN)).otherwise(F.lit(0.0))
            return F.struct(s["start"].alias("start"), F.lit(kind_no).alias("kind_no"), F.lit(kind.name).alias("kind"), s["end"].alias("end"), F.round(F.least(score, F.lit(1.0)), 4).alias("score"))

        return F.transform(confirmed, one)

    def placed(pairs: Column) -> Column:
        items = F.transform(pairs, lambda p, i: F.struct(p["m"].alias("m"), F.length(p["g"]).alias("g"), i.alias("i")))
        size = lambda x: F.coalesce(F.length(x["m"]), F.lit(0))
        confirmed = scan(
            items,
            lambda n, x: n + x["g"] + size(x),
            lambda n, x: x["m"].isNotNull() & _valid(kind.name, x["m"]),
            lambda n, x: F.struct((n + x["g"]).alias("start"), (n + x["g"] + size(x)).alias("end"), x["i"].alias("i")),
            "struct<start:int,end:int,i:int>",
        )
        whole = lambda p: F.concat(p["g"], F.coalesce(p["m"], F.lit("")))
        tails = F.transform(pairs, lambda p: F.right(whole(p), F.lit(CONTEXT_CHARS)))
        heads = F.transform(pairs, lambda p: F.left(whole(p), F.lit(CONTEXT_CHARS)))
        some = lambda c: let(tails, lambda t: let(heads, lambda h: scored(pairs, c, t, h)))
        return let(confirmed, lambda c: F.when(F.size(c) > 0, some(c).cast(_SPAN)).otherwise(_none()))

    out = let(pairs, placed)
    if not kind.base:
        out = F.filter(out, lambda s: s["score"] >= kind.min_score)
    return out


#: What a text must hold for a kind to be looked for; cheaper than the pattern.
_GATES = {"email": "@", "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", "card": r"[0-9](?:[ -]?[0-9]){13}", "phone": r"\+[0-9]", "iban": r"[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}"}


def find(docs: DataFrame, text_col: str = "text", out: str = "pii_spans", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """``docs`` with a column ``out``: its text's spans (start, kind_no, kind, end, score),
    sorted by start, then by kind as listed. Null and empty texts have none. A column
    that is already named ``out`` is replaced; all others stay."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    parts = []
    for n, kind in enumerate(kinds):
        gate = text.contains("@") if kind.name == "email" else text.rlike(_GATES[kind.name])
        parts.append(F.when(gate, _spans_of(text, n, kind)).otherwise(_none()))
    return docs.withColumn(out, F.array_sort(F.concat(*parts)))


def joined(spans: Column) -> Column:
    """kind:start:end of the spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, text_col: str = "text", kinds: tuple[Kind, ...] = KINDS, length_col: str | None = None) -> DataFrame:
    """``docs`` with each span of the text replaced by its kind in brackets; overlapping
    spans become one, named by the first. Null texts stay null; all columns stay. In rows
    with a span, ``length_col`` (if named) becomes the new text's length."""
    spans = "_pii_spans"
    found = find(docs, text_col, spans, kinds)
    text = F.col(text_col)
    # what stands before each span that does not overlap the one before
    before = scan(
        F.col(spans),
        lambda n, s: F.greatest(n, s["end"]),
        lambda n, s: s["start"] >= n,
        lambda n, s: F.struct(n.alias("at"), s["start"].alias("to"), s["kind"].alias("kind")),
        "struct<at:int,to:int,kind:string>",
    )

    def written(part: Column) -> Column:
        first = part[0]["at"]
        piece = lambda t: F.array_join(F.transform(part, lambda x: F.concat(F.substring(t, x["at"] - first + 1, x["to"] - x["at"]), F.lit("["), F.upper(x["kind"]), F.lit("]"))), "")
        return let(F.substring(text, first + 1, F.element_at(part, -1)["to"] - first), piece)

    last = F.array_max(F.transform(spans, lambda s: s["end"]))
    new = F.concat(let(before, lambda b: F.array_join(F.transform(portions(b, 512), written), "")), F.substring(text, last + 1, F.length(text)))
    out = found.withColumn(text_col, F.when(F.size(spans) > 0, new).otherwise(text))
    if length_col:
        out = out.withColumn(length_col, F.when(F.size(spans) > 0, F.length(text_col).cast(dict(docs.dtypes)[length_col])).otherwise(F.col(length_col)))
    return out.select(docs.columns)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every row of ``docs`` its id, how many spans of each base kind, base_sha256 of the
    base spans, all spans, and the best score of a span (null without one).

    Null and empty texts have no spans (zeros, the digest of the empty text); very long
    texts are read whole. Null ids stay null, repeated rows give repeated rows, other
    columns are ignored, whatever they are called; an empty table gives an empty one."""
    s = find(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), "_text", "s")
    base = [k.name for k in KINDS if k.base]

    def count(kind: str) -> Column:
        return F.size(F.filter("s", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in base]
    only = F.filter("s", lambda x: x["kind"].isin(base))
    best = F.array_max(F.transform("s", lambda x: x["score"]))
    return s.select(F.col("_id").alias(id_col), *counts, F.sha2(joined(only), 256).alias("base_sha256"), joined(F.col("s")).alias("spans"), best.alias("max_score"))


def oracle(source: str = "documents") -> str:
    """The digests in DuckDB SQL, whose patterns know no looks around or possessive parts."""
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
        "card": r"[0-9](?:[ -]?[0-9])+",
        "phone": r"\+[0-9][ ().0-9-]+[0-9]",
        "iban": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
    }
    valid = {
        "email": "true",
        "ip": "len(list_filter(string_split(m, '.'), lambda p : p::HUGEINT > 255)) = 0",
        "card": "len(regexp_replace(m, '[^0-9]', '', 'g')) BETWEEN 14 AND 19 AND list_sum(list_transform(string_split(reverse(regexp_replace(m, '[^0-9]', '', 'g')), ''), lambda c, i : CASE WHEN i % 2 = 1 THEN c::INTEGER ELSE c::INTEGER * 2 - CASE WHEN c::INTEGER > 4 THEN 9 ELSE 0 END END)) % 10 = 0",
        "phone": "len(regexp_replace(m, '[^0-9]', '', 'g')) BETWEEN 10 AND 15",
        "iban": "len(replace(m, ' ', '')) BETWEEN 15 AND 34 AND list_reduce(list_prepend(0, list_transform(string_split(substr(replace(m, ' ', ''), 5) || substr(replace(m, ' ', ''), 1, 4), ''), lambda c : CASE WHEN c BETWEEN '0' AND '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END)), lambda a, v : CASE WHEN v < 10 THEN (a * 10 + v) % 97 ELSE (a * 100 + v) % 97 END) = 1",
    }
    parts = []
    for n, k in enumerate(KINDS):
        near = f"(?i)(?:^|[^\\p{{L}}\\p{{N}}])(?:{'|'.join(k.context)})".replace("\\\\", "\\")
        parts.append(f"""
  SELECT doc, '{k.name}' AS kind, {n} AS no, start, start + len(m) AS stop, round(least(1.0, {k.score + k.checked:.4f}
      + CASE WHEN regexp_matches(substr(t, greatest(start - {CONTEXT_CHARS}, 0) + 1, least(start, {CONTEXT_CHARS})) || ' ' || substr(t, start + len(m) + 1, {CONTEXT_CHARS}), '{near}') THEN {CONTEXT_GAIN} ELSE 0.0 END)::DOUBLE, 4) AS score
  FROM (SELECT doc, t, ms[i] AS m, (list_sum(list_transform(gs[1:i], lambda g : len(g))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x : len(x))), 0))::BIGINT AS start
    FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT doc, t, regexp_extract_all(t, '{patterns[k.name]}') AS ms, string_split_regex(t, '{patterns[k.name]}') AS gs FROM d)))
  WHERE {valid[k.name]}""")
    base = [k.name for k in KINDS if k.base]
    counts = ", ".join(f"count(*) FILTER (kind = '{b}') AS n_{b}" for b in base)
    inside = ", ".join(f"'{b}'" for b in base)
    text = "string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, no)"
    return f"""
WITH d AS (SELECT row_number() OVER () AS doc, doc_id, coalesce(text, '') AS t FROM {source}),
s AS ({" UNION ALL ".join(parts)})
SELECT d.doc_id, {counts}, sha256(coalesce({text} FILTER (kind IN ({inside})), '')) AS base_sha256, coalesce({text}, '') AS spans, max(score) AS max_score
FROM d LEFT JOIN s ON d.doc = s.doc GROUP BY d.doc, d.doc_id
"""
