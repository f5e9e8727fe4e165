"""Benchmark decontamination by pigeonhole edit matching.

A test unit with an error budget of k is cut into k + 1 pieces: if it occurs in a
document with at most k edits, one piece occurs there unchanged. The overlapping passages
of an item share the pieces of one grid. All pieces of a block of the benchmark go into one
string automaton, and each document runs through it once. The hits of an item give windows
of the document, each of which is read once for each unit with hits there by Myers' bit
vectors, for the least distance. Units that stand there exactly are looked for first."""

from __future__ import annotations

import re
import uuid
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from functools import reduce

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, small_side

_NOT_WORD = re.compile(r"[\W_]+")

#: Characters of benchmark text that are sent to the executors at once.
BLOCK_CHARS = 4_000_000
#: Digests of texts with leaks up to this number are broadcast; more are joined by a shuffle.
MAX_BROADCAST_TEXTS = 200_000


def normalise(text: str | None) -> str:
    """Lower case, every run of other than letters and digits one blank."""
    return _NOT_WORD.sub(" ", (text or "").lower()).strip()


def spans_of(text: str, passage_words: int) -> list[tuple[int, int]]:
    """Where the test units of a normalised item start and end: all of it and, if it has more
    than ``passage_words`` words, every passage of that many words."""
    if not text:
        return []
    spans = [(0, len(text))]
    words = [m.span() for m in re.finditer(r"[^ ]+", text)]
    if len(words) > passage_words:
        spans += [(a, b) for (a, _), (_, b) in zip(words, words[passage_words - 1 :], strict=False)]
    return spans


def units_of(text: str | None, passage_words: int) -> list[str]:
    """The test units of an item."""
    text = normalise(text)
    return [text[a:b] for a, b in spans_of(text, passage_words)]


def budget(unit: str, error_rate: float) -> int:
    return int(len(unit) * error_rate)


def pieces_of(unit: str, k: int) -> list[tuple[int, str]]:
    """k + 1 pieces (start, piece) of nearly equal length."""
    cuts = [len(unit) * i // (k + 1) for i in range(k + 2)]
    return [(a, unit[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def pattern_masks(unit: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, ch in enumerate(unit):
        masks[ch] = masks.get(ch, 0) | (1 << i)
    return masks


def myers(masks: dict[str, int], m: int, text: str) -> int:
    """The least edit distance between the pattern of length m and any substring of
    ``text``, by Myers' bit vectors."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, m
    get = masks.get
    for ch in text:
        eq = get(ch, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            if score < best:
                best = score
        ph <<= 1
        pv = ((mh << 1) | ~(xv | ph)) & full
        mv = ph & xv & full
    return best


class Matcher:
    """The units of some benchmark items, ready to be looked for. Units under ``min_chars``
    characters have to stand in a document exactly, as whole words (without ``exact_short``
    they are left out)."""

    def __init__(self, items: list[tuple[str, str | None]], error_rate: float, passage_words: int, min_chars: int, exact_short: bool = True):
        self.items: list[tuple[str, str]] = []
        #: start, end, budget of each unit of an item, the longest first
        self.units: list[list[tuple[int, int, int]]] = []
        #: starts and ends of an item's pieces
        self.grid: list[tuple[list[int], list[int]]] = []
        pieces: dict[str, list[tuple[int, int]]] = {}
        for item, raw in items:
            text = normalise(raw)
            units = [(a, b, budget(text[a:b], error_rate) if b - a >= min_chars else 0) for a, b in spans_of(text, passage_words) if exact_short or b - a >= min_chars]
            if not units:
                continue
            if units == [(0, len(text), units[0][2])]:
                cuts = pieces_of(text, units[0][2])
            else:
                # any m characters hold at least (m + 1) // size - 1 whole pieces
                size = max(1, min((b - a + 1) // (k + 2) for a, b, k in units))
                cuts = [(s, text[s : s + size]) for s in range(0, len(text) - size + 1, size)]
            for start, piece in cuts:
                pieces.setdefault(piece, []).append((len(self.items), start))
            self.grid.append(([s for s, _ in cuts], [s + len(p) for s, p in cuts]))
            self.items.append((item, text))
            self.units.append(sorted(units, key=lambda u: u[0] - u[1]))
        self.min_chars = min_chars
        self.automaton = ahocorasick.Automaton()
        for number, (piece, at) in enumerate(pieces.items()):
            self.automaton.add_word(piece, (number, len(piece), at))
        if pieces:
            self.automaton.make_automaton()
        self.around: dict[tuple[int, int, int], tuple] = {}
        self.masks: dict[str, dict[str, int]] = {}

    def distance(self, unit: str, text: str) -> int:
        if len(self.masks) > 20_000:
            self.masks.clear()
        if unit not in self.masks:
            self.masks[unit] = pattern_masks(unit)
        return myers(self.masks[unit], len(unit), text)

    def stands(self, unit: str, doc: str) -> bool:
        """Whether a unit stands in the document exactly, short ones as whole words."""
        at = doc.find(unit)
        while at >= 0 and len(unit) < self.min_chars:
            if (at == 0 or doc[at - 1] == " ") and (at + len(unit) == len(doc) or doc[at + len(unit)] == " "):
                return True
            at = doc.find(unit, at + 1)
        return at >= 0

    def hopeful(self, n: int, start: int, end: int, first: int, doc: str) -> bool:
        """Whether a unit can stand around this hit of a piece. Each unit that holds the piece
        goes on for some length to its left or to its right, which has to be there, with the
        greatest budget of them at most."""
        key = (n, start, end)
        if key not in self.around:
            units = [u for u in self.units[n] if u[0] <= start and end <= u[1]]
            reach = (min(b - a for a, b, _ in units) - (end - start)) // 2
            self.around[key] = (max(k for _, _, k in units), reach, min(a for a, _, _ in units), max(b for _, b, _ in units))
        k, reach, low, high = self.around[key]
        if reach <= k:
            return True
        text, last = self.items[n][1], first + end - start
        if start - reach >= low and self.distance(text[start - reach : start], doc[max(0, first - reach - k) : first]) <= k:
            return True
        return end + reach <= high and self.distance(text[end : end + reach], doc[last : last + reach + k]) <= k

    def best_unit(self, n: int, hits: list[tuple[int, int, list[int]]], doc: str) -> tuple[int, int] | None:
        """(distance, length) of the item's best unit, from the hits of its pieces: start and
        end of the piece, places in the document."""
        text = self.items[n][1]
        starts, ends = self.grid[n]
        hits = sorted(hits)
        begins = [h[0] for h in hits]
        of = lambda a, b: (bisect_left(begins, a), bisect_right(begins, starts[bisect_right(ends, b) - 1]))
        tried: set[str] = set()
        for a, b, _ in self.units[n]:
            i, j = of(a, b)
            unit = text[a:b]
            # all pieces of a unit that stands there exactly are hit
            if j - i == bisect_right(ends, b) - bisect_left(starts, a) and unit not in tried and self.stands(unit, doc):
                return 0, b - a
            tried.add(unit)
        # hits that no unit stands around; where there are very many all are taken
        if sum(len(at) for _, _, at in hits) <= 4096:
            hits = [(s, e, [p for p in at if self.hopeful(n, s, e, p, doc)]) for s, e, at in hits]
        best: tuple[float, int, int] | None = None
        tried = set()
        for a, b, k in self.units[n]:
            m = b - a
            if best is not None and best[0] <= 1 / m:
                break
            i, j = of(a, b)
            unit = text[a:b]
            if not k or i >= j or unit in tried:
                continue
            tried.add(unit)
            near = [np.asarray(at, np.int64) - (s - a) for s, _, at in hits[i:j] if at]
            if not near:
                continue
            low = np.unique(np.concatenate(near)) - k
            # overlapping windows are one
            cut = np.flatnonzero(np.diff(low) > m + 2 * k)
            for x, y in zip(low[np.concatenate([[0], cut + 1])].tolist(), low[np.concatenate([cut, [len(low) - 1]])].tolist(), strict=True):
                d = self.distance(unit, doc[max(0, x) : y + m + 2 * k])
                if d <= k and (best is None or (d / m, -m) < (best[0], -best[2])):
                    best = (d / m, d, m)
        return best[1:] if best else None

    def search(self, text: str | None) -> list[tuple[str, int, int]]:
        """(item, distance, length of the unit) for each item with a unit in ``text``:
        the unit with the least distance against its length, the longest of equals."""
        if not self.items:
            return []
        doc = normalise(text)
        places: dict[int, list[int]] = {}
        found: dict[int, list[tuple[int, int, list[int]]]] = {}
        for end, (number, size, at) in self.automaton.iter(doc):
            first = end - size + 1
            if number in places:
                places[number].append(first)
                continue
            places[number] = [first]
            for n, start in at:
                found.setdefault(n, []).append((start, start + size, places[number]))
        best = ((self.items[n][0], self.best_unit(n, hits, doc)) for n, hits in found.items())
        return [(item, *b) for item, b in best if b]


def find_leaks(docs: DataFrame, benchmark: DataFrame, error_rate: float = 0.06, passage_words: int = 24, min_chars: int = 32, block_chars: int = BLOCK_CHARS, exact_short: bool = True, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, distance, unit_chars): each pair of a document and a benchmark
    item of which the whole text, or any passage of ``passage_words`` words, stands in the
    document with at most ``error_rate`` times its length of character edits, compared in
    lower case without punctuation; units under ``min_chars`` characters have to stand there
    exactly, as whole words (or do not count, without ``exact_short``). One row for each
    pair, and for repeated document rows one each.

    The benchmark is the stated query set: it is read in blocks of about ``block_chars``
    characters, one after the other, and every block passes over all documents. Null and empty texts match
    nothing; very long texts are read whole. Null ids are kept as null. An empty table on
    either side gives no rows. Other columns are ignored, whatever they are called."""
    options = (error_rate, passage_words, min_chars, exact_short)
    rows = docs.select(F.col(id_col).cast("string").alias("doc"), F.col(text_col).alias("text"))

    def one_block(key: str, shared) -> DataFrame:
        def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            matcher = _matcher(key, shared, options)
            for b in batches:
                out = [(doc, *hit) for doc, text in zip(b["doc"], b["text"], strict=True) for hit in matcher.search(text)]
                yield pd.DataFrame(out, columns=["doc", "item", "distance", "unit_chars"])

        return rows.mapInPandas(search, "doc string, item string, distance int, unit_chars int")

    out = _over_blocks(benchmark, item_col, item_text_col, block_chars, one_block)
    return out.select(F.col("doc").cast(dict(docs.dtypes)[id_col]).alias(id_col), F.col("item").cast(dict(benchmark.dtypes)[item_col]).alias(item_col), "distance", "unit_chars")


#: The matcher that a Python worker built last; the next task of the same block has it.
_built: dict[str, Matcher] = {}


def _matcher(key: str, shared, options: tuple) -> Matcher:
    if key not in _built:
        _built.clear()
        _built[key] = Matcher(shared.value, *options)
    return _built[key]


def _items(benchmark: DataFrame, item_col: str, item_text_col: str, block_chars: int) -> tuple[DataFrame, int]:
    """(item, text) rows, and in how many blocks of about ``block_chars`` characters they are
    read."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("text"))
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    return items, max(1, -(-int(chars) // block_chars))


def _block(items: DataFrame, k: int, n: int) -> tuple:
    """A name and a broadcast of one block's (item, text)."""
    rows = items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k).collect()
    return uuid.uuid4().hex, items.sparkSession.sparkContext.broadcast([(r["item"], r["text"]) for r in rows])


def _over_blocks(benchmark: DataFrame, item_col: str, item_text_col: str, block_chars: int, find: Callable[..., DataFrame]) -> DataFrame:
    """``find(name, broadcast)`` over all blocks. Of several, each is stored before the next
    is read, and its broadcast is given up: one block at a time is in memory."""
    items, n = _items(benchmark, item_col, item_text_col, block_chars)
    if n == 1:
        return find(*_block(items, 0, 1))
    parts = []
    for k in range(n):
        name, shared = _block(items, k, n)
        parts.append(checkpoint(find(name, shared)))
        shared.destroy()
    return reduce(DataFrame.unionByName, parts)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, error_rate: float = 0.06, passage_words: int = 24, min_chars: int = 32, block_chars: int = BLOCK_CHARS, exact_short: bool = True, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, all columns as they were. With one
    block of the benchmark only the text goes to Python, which answers yes or no where the
    row is read, and nothing is shuffled. With several, each block stores the digests of the
    texts it finds, and the rows with these are taken out at the end. Options, nulls and
    empty texts as for find_leaks; rows with a null id are judged by their text like others."""
    options = (error_rate, passage_words, min_chars, exact_short)
    items, n = _items(benchmark, item_col, item_text_col, block_chars)
    if n == 1:
        return docs.filter(_clean(*_block(items, 0, 1), options)(F.col(text_col)))
    texts = docs.select(F.col(text_col).alias("text"))
    found = _over_blocks(benchmark, item_col, item_text_col, block_chars, lambda name, shared: texts.filter(~_clean(name, shared, options)("text")).select(F.sha2("text", 256).alias("_leak")))
    found = checkpoint(found.distinct())
    return docs.join(small_side(found, found.count(), MAX_BROADCAST_TEXTS), F.sha2(F.col(text_col), 256) == F.col("_leak"), "left_anti")


def _clean(key: str, shared, options: tuple):
    """Whether a text holds no item of the block."""

    def clean(texts: pd.Series) -> pd.Series:
        matcher = _matcher(key, shared, options)
        return pd.Series([not matcher.search(t) for t in texts], dtype=bool)

    return F.pandas_udf(clean, "boolean")
