"""Main text of web pages by site template removal.

Subtrees of block elements are hashed; Spark counts per host on how many different pages,
or at one place of how many different articles, a subtree occurs; subtrees that recur on a
number of them are deleted. What is left of the article is written out block by block."""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, code_points

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math object xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that are never main text.
DROP = frozenset("head nav header footer aside form menu dialog button select input label fieldset script style textarea title noscript template iframe svg math object xmp canvas audio video".split())
#: Words in class, id or role that mark other parts of a page.
DROP_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising sponsor sponsored sponsors promo promotion banner cookie cookies consent gdpr notice notices alert newsletter subscribe subscription signup sidebar sidebars aside nav navbar navigation menu menus breadcrumb breadcrumbs footer header masthead topbar toolbar comment comments commentlist disqus respond replies share sharing social related recommended popup modal overlay login search pagination pager skip contentinfo complementary form".split()
)
#: Those of reader comments and of adverts: the first beat whatever they hold, the second
#: hold for inline elements in a sentence too.
COMMENT_WORDS = frozenset("comment comments commentlist disqus respond replies".split())
ADVERT_WORDS = frozenset("ad ads adv advert adverts advertisement advertisements advertising sponsor sponsored sponsors promo promotion".split())
#: Words that stand beside those in one class name (``comments-area``, ``left_menu``), and words
#: that turn their meaning (``has-sidebar``).
PLACE_WORDS = frozenset("area bar block body bottom box button buttons container content icon icons inner item items left link links list main outer page panel primary right row secondary section site slot top unit widget widgets wrap wrapper".split())
TURNING_WORDS = frozenset("has no with without is not".split())
#: Words that mark a part as the last word of any class name (``page-sidebar``).
LAST_WORDS = frozenset("ad ads advert banner breadcrumb breadcrumbs comments commentlist consent cookie cookies footer masthead menu modal nav navbar navigation newsletter overlay pager pagination popup promo sidebar sidebars sponsored toolbar topbar".split())
#: Elements that are no template by themselves: what an article repeats in them is its own.
OWN = frozenset("h1 h2 h3 h4 h5 h6 li dt dd tr td th thead tbody tfoot caption figcaption legend summary option".split())
#: In an article a template has so many characters of text at least.
MIN_CHARS = 40
#: Start tags that end an open paragraph, and elements that end one of their own kind.
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"thead", "tbody"}, "tbody": {"thead", "tbody"}, "tfoot": {"tbody"}}
LIMITS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}, "thead": {"table"}, "tbody": {"table"}, "tfoot": {"table"}}
#: A subtree is a template if it is on so many different pages of its host, or in so many
#: different articles.
MIN_PAGES = 8
#: Bytes of templates that are broadcast at most (a row counts its host and TEMPLATE_BYTES);
#: more are joined by a shuffle.
MAX_BROADCAST_BYTES, TEMPLATE_BYTES = 32_000_000, 120

#: A quoted value counts as one where a blank or the tag's end follows it; any other quote is
#: a character like others, so that a stray one takes no text with it.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*(?:\"[^\"]*\"(?=[\s/>])|'[^']*'(?=[\s/>]))?)*+)>", re.DOTALL)
_ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
_PART_SPLIT = re.compile(r"[-_]+")


@dataclass(slots=True, eq=False)
class Node:
    tag: str
    start: int
    marked: bool = False
    comment: bool = False
    advert: bool = False
    main: bool = False
    holds_main: bool = False
    end: int = 0
    #: characters of text
    size: int = 0
    parts: list = field(default_factory=list)


def marking_words(value: str) -> set[str]:
    """The words of a class, id or role that mark a part of a page: whole names, names made of
    such words and of words for places, and names that end with some of them."""
    found = set()
    for name in value.lower().split():
        if name in DROP_WORDS:
            found.add(name)
            continue
        parts = [x for x in _PART_SPLIT.split(name) if x]
        if len(parts) < 2 or not TURNING_WORDS.isdisjoint(parts):
            continue
        marks = [x for x in parts if x in DROP_WORDS]
        if marks and all(x in DROP_WORDS or x in PLACE_WORDS or x.isdigit() for x in parts):
            found.update(marks)
        elif parts[-1] in LAST_WORDS:
            found.add(parts[-1])
    return found


def spaced(html: str | None) -> str:
    """Every run of white space one blank: what a page's text and its hashes are made of."""
    return " ".join((html or "").split())


def parse(html: str) -> Node:
    """A tree of elements and text runs; tags that are not closed are closed by what
    encloses them or by the next block. Elements may be nested to any depth: the places of
    open elements are kept by tag, so no tag searches the stack."""
    root = Node("#root", 0)
    stack = [root]
    places: defaultdict[str, list[int]] = defaultdict(list)
    blocks: list[int] = []
    at, n, seen = 0, len(html), 0

    def add(text: str) -> None:
        nonlocal seen
        stack[-1].parts.append(text)
        seen += len(text) if text != " " else 0

    def pop_to(depth: int, end: int) -> None:
        while len(stack) > depth:
            node = stack.pop()
            node.end = end
            node.size += seen
            if node is not root:
                places[node.tag].pop()
                if node.tag in BLOCK:
                    blocks.pop()

    def innermost(tags: set[str]) -> int:
        return max((places[t][-1] for t in tags if places[t]), default=0)

    while at < n:
        # the next tag; a "<" that begins none is text
        lt = html.find("<", at)
        while lt >= 0 and (m := _TOKEN.match(html, lt)) is None:
            lt = html.find("<", lt + 1)
        if lt < 0:
            tail = html[at:]
            cut = re.search(r"<[/a-zA-Z!][^<>]*\Z", tail)  # a tag that the end of the page cuts off
            add(tail[: cut.start()] if cut else tail)
            break
        if lt > at:
            add(html[at:lt])
        at = m.end()
        data, closing, tag, attributes = m.groups()
        if tag is None:
            if data:
                add(entities.escape(data))
            continue
        tag = tag.lower()
        if closing:
            # an inline end tag does not close blocks
            if places[tag] and (tag in BLOCK or not blocks or blocks[-1] < places[tag][-1]):
                depth = places[tag][-1]
                if len(stack) > depth + 1:
                    pop_to(depth + 1, lt)
                pop_to(depth, at)
            continue
        if tag in CLOSES_P and blocks and stack[blocks[-1]].tag == "p":
            pop_to(blocks[-1], lt)
        if tag in SAME:
            while (depth := innermost(SAME[tag])) > innermost(LIMITS[tag]):
                pop_to(depth, lt)
                if stack[-1].tag not in SAME[tag]:
                    break
        node = Node(tag, lt, end=at)
        if attributes and "=" in attributes:
            for name, *values in _ATTRIBUTE.findall(attributes):
                value = next((v for v in values if v), "")
                words = marking_words(value)
                node.main |= name.lower() == "role" and "main" in value.lower().split()
                node.marked |= bool(words)
                node.comment |= not words.isdisjoint(COMMENT_WORDS)
                node.advert |= not words.isdisjoint(ADVERT_WORDS)
        node.main |= tag in ("article", "main")
        stack[-1].parts.append(node)
        if tag in RAW and not attributes.endswith("/"):
            close = re.compile(rf"</{re.escape(tag)}\s*>", re.IGNORECASE).search(html, at)
            at = close.end() if close else n
            node.end = at
        elif tag not in VOID:
            node.size = -seen
            if node.main and not node.marked:
                for depth in range(len(stack) - 1, -1, -1):
                    if stack[depth].holds_main:
                        break
                    stack[depth].holds_main = True
            places[tag].append(len(stack))
            if tag in BLOCK:
                blocks.append(len(stack))
            stack.append(node)
    pop_to(0, n)
    return root


_tables: dict[str, np.ndarray] = {}
_BASE = 0xD6E8FEB86659FD93


def span_hashes(html: str, starts: list[int], ends: list[int]) -> np.ndarray:
    """64-bit hashes of parts of a page, nested ones too, from one running polynomial: each
    character is read once, however deep it stands."""
    n = len(html)
    if len(_tables.get("up", ())) <= n:
        _tables["up"] = np.cumprod(np.full(max(2 * n, 65536), _BASE, np.uint64))
        _tables["down"] = np.cumprod(np.full(max(2 * n, 65536), pow(_BASE, -1, 1 << 64), np.uint64))
    c = (code_points(html) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((c ^ (c >> np.uint64(29))) * _tables["up"][:n], out=total[1:])
    a, b = np.array(starts, np.int64), np.array(ends, np.int64)
    h = (total[b] - total[a]) * _tables["down"][a] + (b - a).astype(np.uint64)
    return h ^ (h >> np.uint64(31))


class Candidates:
    """The subtrees of a page that may be templates.

    Outside of articles these are blocks other than headings, items, rows and cells; in
    an article, blocks with some text, each with its place: how many blocks begin before
    it, or after it. A boilerplate block of articles stands at one distance from an edge.
    With ``texts`` each article's longest text is found, too."""

    def __init__(self, html: str, root: Node, texts: bool = False):
        self.outside: list[Node] = []
        #: node, article's number, blocks before, blocks after
        self.inside: list[tuple[Node, int, int, int]] = []
        #: the longest text of each article
        self.articles: list[str] = []
        n_articles = 0
        article: Node | None = None
        found: list[tuple[Node, int, int]] = []
        runs: list[list[str]] = []
        skipped = begun = 0
        todo: list[tuple[Node | str, int]] = [(root, -1)]
        while todo:
            x, before = todo.pop()
            if isinstance(x, str):
                if texts and article is not None and not skipped:
                    runs[-1].append(x)
                continue
            skip = article is not None and (x.tag in DROP or x.marked) and x is not article
            if before >= 0:  # its end
                skipped -= skip
                if x.tag in BLOCK and texts:
                    runs.append([])
                if x is article:
                    if texts:
                        joined = ["".join(r) for r in runs]
                        self.articles.append(max((" ".join(entities.unescape(t).split()) if "&" in t else t.strip() for t in joined), key=lambda t: (len(t), t)))
                    self.inside += [(y, n_articles, first, begun - last) for y, first, last in found]
                    n_articles += 1
                    article = None
                elif article is not None and x.tag in BLOCK and x.tag not in OWN and x.size >= MIN_CHARS and not x.main and not x.holds_main:
                    found.append((x, before, begun))
                continue
            if x.tag in RAW or x.tag == "head":
                continue
            if x.tag in BLOCK:
                if texts:
                    runs.append([])
                if article is None and x.tag not in ("html", "body") and x.tag not in OWN and not x.main and not x.holds_main:
                    self.outside.append(x)
            if article is None and x.main and (x.tag == "article" or not x.holds_main):
                article, found, runs, skipped, begun = x, [], [[]], 0, 0
            skipped += skip
            todo.append((x, begun))
            begun += x.tag in BLOCK
            todo += [(part, -1) for part in reversed(x.parts)]
        nodes = [*self.outside, *(x[0] for x in self.inside)]
        self.hashes = [h - (1 << 63) for h in span_hashes(html, [x.start for x in nodes], [x.end for x in nodes]).tolist()] if nodes else []

    def keys(self) -> Iterator[tuple[Node, int, int | None]]:
        """(node, key, article or None): of a node in an article a key for each edge."""
        yield from ((x, h, None) for x, h in zip(self.outside, self.hashes, strict=False))
        for (x, article, before, after), h in zip(self.inside, self.hashes[len(self.outside) :], strict=True):
            for side, distance in ((1, before), (2, after)):
                key = (h * 0x9E3779B97F4A7C15 + distance * 4 + side) & ((1 << 64) - 1)
                yield x, (key ^ key >> 32) - (1 << 63), article


def _long(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def subtrees(html: str) -> dict[int, int]:
    """Keys of all subtrees of a page that may be templates, each with a hash of where it is:
    of the page or, where it is only in an article, of the longest text of the article, by
    which the article and its copies are known."""
    html = spaced(html)
    found = Candidates(html, parse(html), texts=True)
    page, articles = _long(html), [_long(t) for t in found.articles]
    inside: dict[int, int] = {}
    outside: dict[int, int] = {}
    for _, key, article in found.keys():
        if article is None:
            outside[key] = page
        else:
            inside[key] = articles[article]
    return inside | outside


def _in_sentence(block: Node) -> bool:
    """Whether a block holds text of its own beside marked inline elements."""
    todo: list[Node | str] = list(block.parts)
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            if not x.isspace():
                return True
        elif not x.marked and x.tag not in BLOCK and x.tag not in DROP:
            todo += x.parts
    return False


def main_text(html: str | None, templates: frozenset[int] | set[int] = frozenset()) -> str:
    """The blocks of the article (of <article>, else of <main>, else of the page) without
    templates and without what is not main text, joined by line feeds.

    Class words decide about blocks, and about inline elements that stand in no sentence
    (adverts in any place). On a page without <article> and <main> they do not decide about a
    block with most of the page's text, unless it is reader comments or an advert. An <article> or <main> that they mark is the article only
    if no unmarked one has text. Adverts and reader comments are never text."""
    html = spaced(html)
    if not html:
        return ""
    root = parse(html)
    deleted = {id(x) for x, key, _ in Candidates(html, root).keys() if key in templates} if templates else set()
    sentences: dict[int, bool] = {}

    def dropped(x: Node, block: Node) -> bool:
        if x.tag in DROP:
            return True
        if x.tag in ("html", "body") or x.main and not x.marked:
            return False
        if x.marked and x.tag not in BLOCK and not x.advert:
            if id(block) not in sentences:
                sentences[id(block)] = _in_sentence(block)
            return not sentences[id(block)]
        if x.marked and (x.comment or not x.holds_main and (x.advert or root.holds_main or x.size * 2 <= root.size)):
            return True
        return id(x) in deleted

    def mains(tags: tuple[str, ...], marked: bool) -> list[Node]:
        """The outermost ones, also those that class words mark or not."""
        found: list[Node] = []
        todo: list[Node | str] = root.parts[::-1]
        while todo:
            x = todo.pop()
            if not isinstance(x, Node):
                continue
            is_main = x.tag in tags or x.main and "main" in tags
            open_to = not x.marked or marked and not x.comment and not x.advert
            if is_main and x.tag not in DROP and open_to:
                found.append(x)
            elif not dropped(x, root):
                todo += reversed(x.parts)
        return found

    def written(starts: list[Node]) -> str:
        blocks: list[list[str]] = [[]]
        for start in starts:
            blocks.append([])
            inside = [start]
            todo: list[Node | str | None] = start.parts[::-1]
            while todo:
                x = todo.pop()
                if x is None:  # the end of a block
                    blocks.append([])
                    inside.pop()
                elif isinstance(x, str):
                    blocks[-1].append(x)
                elif x.tag == "br":
                    blocks[-1].append(" ")
                elif not dropped(x, inside[-1]):
                    if x.tag in BLOCK:
                        blocks.append([])
                        inside.append(x)
                        todo.append(None)
                    todo += reversed(x.parts)
        lines = (" ".join(entities.unescape("".join(b)).split()) for b in blocks)
        return "\n".join(x for x in lines if x)

    for marked in (False, True):
        text = written(mains(("article",), marked)) or written(mains(("main",), marked))
        if text:
            return text
    return written([root])


def _subtrees(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(host, subtree, place, page) rows of pages with host and html."""
    for b in batches:
        out = []
        for host, html in zip(b["host"], b["html"], strict=True):
            page = xxhash.xxh64_intdigest(html.encode("utf-8", "surrogatepass")) - (1 << 63)
            out += [(host, h, place, page) for h, place in subtrees(html).items()]
        yield pd.DataFrame(out, columns=["host", "subtree", "place", "page"])


_SUBTREES = "host string, subtree long, place long, page long"


def templates(pages: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, subtree) rows: the hashes of a host's template subtrees. ``pages`` has host
    and html. Exact copies of a page count once, and so do copies of an article for what is
    only in it. The bar is the same for hosts of any size. Each page sends a row for each
    distinct subtree, summed before the shuffle."""
    rows = pages.filter("host is not null and html is not null").mapInPandas(_subtrees, _SUBTREES)
    counts = rows.groupBy("host", "subtree", "place").agg(F.lit(1).alias("one")).groupBy("host", "subtree").agg(F.count("*").alias("n"))
    return counts.filter(F.col("n") >= min_pages).select("host", "subtree")


def _with_page(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        keys = [None if t is None else xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass")) - (1 << 63) for t in b["html"]]
        yield b.assign(page=pd.array(keys, "Int64"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_pages: int = MIN_PAGES) -> DataFrame:
    """id, url, text, n_chars for every row of ``pages``.

    Null and empty pages have the empty text and length 0. Pages without a url or a host
    in it belong to no host: only the rules for elements and class names apply to them.
    Pages may be of any length and nested to any depth; unclosed and stray tags close as
    browsers close them, a stray quote is a character of its tag. Repeated rows give
    repeated rows (and count as one page), null ids stay null, other columns are ignored,
    whatever they are called, and an empty table gives an empty one."""
    kind = dict(pages.dtypes)[id_col]
    rows = pages.select(F.col(id_col).cast("string").alias("id"), F.col(url_col).alias("url"), F.lower(F.regexp_extract(F.col(url_col), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)).alias("host"), F.col(html_col).alias("html"))
    rows = rows.withColumn("host", F.when(F.col("host") != "", F.col("host")))
    found = checkpoint(templates(rows, min_pages))
    size = found.agg(F.sum(F.octet_length("host") + TEMPLATE_BYTES)).first()[0] or 0
    if size <= MAX_BROADCAST_BYTES:
        sets: dict[str, set[int]] = {}
        for host, subtree in found.toPandas().itertuples(index=False):
            sets.setdefault(host, set()).add(subtree)
        shared = rows.sparkSession.sparkContext.broadcast(sets)
        rows = rows.withColumn("subtrees", F.lit(None).cast("array<long>"))
    else:
        # each page gets the templates that are on it, so no row grows with its host
        shared = rows.sparkSession.sparkContext.broadcast({})
        seen = rows.filter("host is not null and html is not null").mapInPandas(_subtrees, _SUBTREES).join(found, ["host", "subtree"], "left_semi")
        seen = seen.groupBy("host", "page").agg(F.collect_set("subtree").alias("subtrees"))
        rows = rows.mapInPandas(_with_page, "id string, url string, host string, html string, page long").join(seen, ["host", "page"], "left")

    def texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sets = shared.value
        for b in batches:
            out = []
            for host, page, found in zip(b["host"], b["html"], b["subtrees"], strict=True):
                out.append(main_text(page, sets.get(host, frozenset()) if found is None else set(found.tolist())))
            yield pd.DataFrame({"id": b["id"], "url": b["url"], "text": out})

    out = rows.select("id", "url", "host", "html", "subtrees").mapInPandas(texts, "id string, url string, text string")
    return out.select(F.col("id").cast(kind).alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"))
