"""The training-data operators: methods against brute force, round trips, edge cases."""

import hashlib
import os
import random
import re
import time
import zlib
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwork.llm import chat, decontam, langid, media, mixing, neardup, pagetext, pii, quality, queries, toxicity
from loomwork.llm.common import crc_mod, fit_svm, labelled_sample, sample_by

from ..conftest import same_rows

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, vocab="abcdefghij"):
    return " ".join("".join(rng.choice(vocab) for _ in range(rng.randrange(2, 8))) for _ in range(n))


def edge_docs(spark):
    """Nulls in every column, empty and long texts, repeats."""
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (None, "hello there general reader", "en", "a", 5), (3, "x " * 200_000, "de", "b", 400_000), (4, "same text here again and again", "en", "b", 30), (4, "same text here again and again", "en", "b", 30), (5, "... !!! ???", "fr", None, 11)]
    return spark.createDataFrame(rows, DOCS)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, duck, sf, name):
    same_rows(queries.queries()[name](spark, sf).toPandas(), duck.sql(queries.oracle_sql()[name]).df())


# ------------------------------------------------------------------- language


def test_languages_of_held_out_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = queries.language_id(spark, sf).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.95
    assert got.score.between(0, 1).all()


def test_language_edges(spark):
    rng = random.Random(1)
    rows = [(i, words(rng, 20, "abcd" if i % 2 else "wxyz"), "en" if i % 2 else "fr", None, 1) for i in range(40)]
    m = langid.fit(spark.createDataFrame(rows, DOCS))
    got = langid.identify(edge_docs(spark).withColumn("lang_pred", F.lit("clash")), m).collect()
    assert len(got) == 7
    assert {(r.lang_pred, r.score) for r in got if r.doc_id in (1, 2, 5)} == {("und", 0.0)}
    none = langid.identify(edge_docs(spark), langid.fit(spark.createDataFrame([], DOCS)))
    assert {r.lang_pred for r in none.collect()} == {"und"}
    assert langid.identify(spark.createDataFrame([], DOCS), m).count() == 0


def test_votes_equal_plain_loops():
    """The family with the most wins of its pairs' machines, then the language inside it."""
    rng = np.random.default_rng(5)
    levels = {"": (["p", "q", "r"], rng.normal(size=(3, 9)).astype(np.float32)), "p": (["a", "b", "c"], rng.normal(size=(3, 9)).astype(np.float32)), "q": (["d"], np.zeros((0,), np.float32)), "r": (["e", "f"], rng.normal(size=(1, 9)).astype(np.float32))}
    m, x = langid.Model(levels), rng.normal(size=(200, 8)).astype(np.float32)

    def wins(row, names, machines):
        won, sums = dict.fromkeys(names, 0), dict.fromkeys(names, 0.0)
        for (a, b), w in zip(combinations(names, 2), machines, strict=True):
            margin = float(row @ w[:-1] + w[-1])
            won[a if margin > 0 else b] += 1
            sums[a] += margin
            sums[b] -= margin
        most = max(won.values())
        return {n for n in names if won[n] == most}, won

    lang, score = m.predict(x)
    for row, got, p in zip(x, lang, score, strict=True):
        families, _ = wins(row, *levels[""])
        assert any(got in wins(row, *levels[f])[0] for f in families)
        if len(families) == 1:
            inside, _ = wins(row, *levels[next(iter(families))])
            assert got in inside
        assert 0 <= p <= 1


def test_clashing_columns_null_ids_and_repeats(spark, tmp_path):
    """Operators that take columns by name see none of the others."""
    names = ("shard", "digest", "offset", "length", "score", "spans", "pii_spans", "start", "accepted", "item_id", "doc", "distance")
    docs = edge_docs(spark).withColumns({c: F.lit("clash") for c in names})
    assert media.media_table(docs, folder=f"file://{tmp_path}/m").count() == 7
    got = pii.digests(docs).collect()
    assert len(got) == 7 and sum(r.doc_id is None for r in got) == 1 and sum(r.doc_id == 4 for r in got) == 2
    labels = spark.createDataFrame([(i, i % 2) for i in range(6)], "doc_id long, quality int")
    assert quality.classify(docs, quality.fit(docs, labels)).count() == 7
    bench = spark.createDataFrame([(1, "same text here again and again")], "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in decontam.find_leaks(docs, bench).collect()] == [(4, 1)] * 2


def test_svm_separates():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 5)).astype(np.float32)
    y = np.where(x @ np.array([1, -2, 0.5, 0, 0]) > 0, 1.0, -1.0)
    w = fit_svm(x, y)
    assert (np.sign(x @ w[:-1] + w[-1]) == y).mean() > 0.95


# ------------------------------------------------------------ decontamination


def edit_distance_inside(p, t):
    row = [0] * (len(t) + 1)
    for i, a in enumerate(p, 1):
        new = [i]
        for j, b in enumerate(t, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def test_myers_equals_dynamic_programming():
    rng = random.Random(2)
    for _ in range(300):
        p = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 90)))
        t = "".join(rng.choice("abc") for _ in range(rng.randrange(0, 120)))
        assert decontam.myers(decontam.pattern_masks(p), len(p), t) == edit_distance_inside(p, t)


def test_leaks_equal_brute_force(spark):
    rng = random.Random(3)
    items = [(i, words(rng, rng.randrange(4, 20))) for i in range(12)]
    docs = []
    for i in range(40):
        t = words(rng, 15)
        if i % 2:
            unit = list(rng.choice(items)[1])
            for _ in range(rng.randrange(0, 8)):
                k = rng.randrange(len(unit))
                unit[k : k + rng.randrange(2)] = rng.choice(["", "q", "zz"])
            t = f"{t} {''.join(unit)} {words(rng, 10)}"
        docs.append((i, t, "en", "s", len(t)))
    db, bench = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")
    want = set()
    for i, t, *_ in docs:
        for j, b in items:
            for u in decontam.units_of(b, 24):
                # short items have to stand there exactly, as whole words
                found = edit_distance_inside(u, decontam.normalise(t)) <= decontam.budget(u, 0.06) if len(u) >= 32 else f" {u} " in f" {decontam.normalise(t)} "
                if found:
                    want.add((i, j))
    got = {(r.doc_id, r.item_id) for r in decontam.find_leaks(db, bench).collect()}
    assert got == want and want
    # several blocks give the same
    assert {(r.doc_id, r.item_id) for r in decontam.find_leaks(db, bench, block_chars=200).collect()} == want
    for block_chars in (decontam.BLOCK_CHARS, 200):
        kept = {r.doc_id for r in decontam.drop_leaks(db.withColumn("_clash", F.lit(1)), bench, block_chars=block_chars).collect()}
        assert kept == {d[0] for d in docs} - {i for i, _ in want}


def test_leak_edges(spark):
    bench = spark.createDataFrame([(1, None), (2, ""), (None, "same text here again and again with more")], "item_id long, text string")
    assert decontam.find_leaks(edge_docs(spark), bench).count() == 0
    assert decontam.drop_leaks(edge_docs(spark), bench.limit(0)).count() == 7
    # values of other columns pass unchanged, beside nulls too
    big = spark.createDataFrame([(9007199254740993, "a", 1), (None, "b", None)], "doc_id long, text string, n int")
    assert {tuple(r) for r in decontam.drop_leaks(big, bench).collect()} == {(9007199254740993, "a", 1), (None, "b", None)}
    assert decontam.find_leaks(spark.createDataFrame([], DOCS), bench).count() == 0


def test_leaks_of_any_passage():
    """Passages of 24 words from any start, and short items as whole words."""
    rng = random.Random(4)
    items = [(str(i), words(rng, n)) for i, n in enumerate((24, 25, 30, 36, 37, 50, 70))] + [("short", "Deep Blue (chess)"), ("word", "zyx")]
    matcher = decontam.Matcher(items, 0.06, 24, 32, exact_short=True)
    docs = []
    for item, text in items[:7]:
        w = text.split()
        for a in range(len(w) - 23):
            docs.append((item, f"{words(rng, 8)} {' '.join(w[a : a + 24])} {words(rng, 8)}"))
    assert all(item in {h[0] for h in matcher.search(t)} for item, t in docs)
    # with edits, as brute force has it
    for item, t in docs[::2]:
        unit = list(t)
        for _ in range(rng.randrange(0, 14)):
            k = rng.randrange(len(unit))
            unit[k : k + rng.randrange(2)] = rng.choice(["", "q", "zz"])
        t = decontam.normalise("".join(unit))
        want = {}
        for i, text in items[:7]:
            for u in decontam.units_of(text, 24):
                d = decontam.myers(decontam.pattern_masks(u), len(u), t)
                if d <= decontam.budget(u, 0.06):
                    want[i] = min(want.get(i, (9.0, 0, 0, 0)), (d / len(u), -len(u), d, len(u)))
        assert {(i, d, m) for i, d, m in matcher.search(t) if i.isdigit()} == {(i, *v[2:]) for i, v in want.items()}
    hits = [{h[0] for h in matcher.search(t)} for t in ("a deep blue chess, set", "deep blue", "Zyx!", "a zyxw", "xzyx deep blue chesses")]
    assert hits == [{"short"}, set(), {"word"}, set(), set()]


def test_leaks_in_repetitive_texts():
    """Hits without number cost a window each at most; the results stay exact."""
    matcher = lambda text: decontam.Matcher([("i", text)], 0.06, 24, 32)
    began = time.time()
    assert matcher("zero " * 400).search("zero " * 100_000) == [("i", 0, 1999)]
    assert matcher("zero " * 400 + "end").search("zero " * 100_000) == [("i", 0, 119)]
    assert matcher("0 " * 200).search("0 " * 2000) == [("i", 0, 399)]
    assert time.time() - began < 4
    rng = random.Random(8)
    for _ in range(20):
        item = " ".join(rng.choice(["0", "1", "00"]) for _ in range(60))
        doc = " ".join(rng.choice(["0", "1", "00"]) for _ in range(40)) + " " + item[: rng.randrange(30, 110)] + "1" + item[60:]
        want = None
        for u in decontam.units_of(item, 24):
            d = edit_distance_inside(u, doc)
            if d <= decontam.budget(u, 0.06) and (want is None or (d / len(u), -len(u)) < (want[0] / want[1], -want[1])):
                want = (d, len(u))
        assert matcher(item).search(doc) == ([("i", *want)] if want else [])


# --------------------------------------------------------------------- mixing


def test_rows_without_id_are_drawn_one_by_one(spark):
    docs = spark.createDataFrame([(None, f"text {i}", "en", "s", 1) for i in range(2000)], DOCS)
    for seed in (17, 18, 19, 20):
        out = mixing.mix(docs, seed=seed)
        n = out.count()
        # Poisson with mean 1: four deviations of the sum
        assert abs(n - 2000) < 4 * 2000**0.5
        assert out.select("shuffle_key").distinct().count() == n
    same = spark.createDataFrame([(7, f"text {i}", "en", "s", 1) for i in range(50)], DOCS)
    assert mixing.mix(same, epochs=3.0).select("shuffle_key").distinct().count() in range(0, 1000, 50)


def test_mix_targets_and_edges(spark):
    rows = [(i, f"t{i}", "en", "big" if i % 10 else "small", 1) for i in range(20_000)]
    docs = spark.createDataFrame(rows, DOCS)
    target = spark.createDataFrame([("big", 1.0), ("small", 1.0)], "source string, weight double")
    got = {r.source: r["count"] for r in mixing.mix(docs, target).groupBy("source").count().collect()}
    assert all(abs(n - 10_000) < 400 for n in got.values())
    out = mixing.mix(edge_docs(spark).withColumn("copy", F.lit("clash"))).toPandas()
    assert set(out.columns) == {"doc_id", "text", "lang", "source", "n_chars", "copy", "n_copies", "rate", "shuffle_key"}
    assert mixing.mix(spark.createDataFrame([], DOCS)).count() == 0
    # a high rate is drawn in pieces
    few = spark.createDataFrame([(i, "t", "en", "s", 1) for i in range(300)], DOCS)
    assert abs(mixing.mix(few, epochs=100.0).count() - 30_000) < 1_000


# ---------------------------------------------------------------------- pages


def test_page_text(spark):
    chrome = '<div class="promo2 x"><ul><li>Hot</li><li>New</li></ul></div>'
    page = lambda i: f"<html><head><title>T</title></head><body><nav>menu</nav>{chrome}<article><h1>Head &amp; {i}</h1><p>First<br>line.<p>Second <b>bold</b>.</article><div class=comments>said</div><footer>f</footer></body></html>"
    rows = [(i, f"http://h.example/{i}", page(i)) for i in range(20)] + [(98, None, None), (99, "bad", ""), (None, "http://h.example/x", "<p>no article <i>here</i></p>" + chrome)]
    got = {r.page_id: r.text for r in pagetext.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "Head & 3\nFirst line.\nSecond bold."
    assert (got[98], got[99]) == ("", "")
    # outside an article the recurring subtree is known from the other pages of the host
    assert got[None] == "no article here"
    assert pagetext.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_templates_of_a_large_host(spark, monkeypatch):
    """A notice on a few of a host's many pages is a template, a list in an article too;
    the paragraphs of copies of one article are not."""
    rng = random.Random(5)
    widget = '<div class="box7"><p>Buy one today</p></div>'
    notice = "<ul><li>First published elsewhere, shown here with permission</li></ul>"
    own = {i: words(rng, 12) for i in range(300)}
    page = lambda i: f"<body>{widget if i < 12 else ''}<p>top {i}</p><article><p>{own[i]}</p>{notice if 50 <= i < 62 else ''}</article></body>"
    copy = lambda i: f"<body><article><h1>Copied</h1><p>{own[0]} again</p><p>Seen {i} times</p></article></body>"
    rows = [(i, f"http://h.example/{i}", page(i)) for i in own] + [(1000 + i, f"http://h.example/c{i}", copy(i)) for i in range(20)]
    # a page of the same host without an article shows the widget outside of one
    rows.append((2000, "http://h.example/w", f"<body>{widget}<p>plain</p></body>"))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for bound in (pagetext.MAX_BROADCAST_BYTES, 0):
        monkeypatch.setattr(pagetext, "MAX_BROADCAST_BYTES", bound)
        got = {r.page_id: r.text for r in pagetext.extract(pages).collect()}
        assert len(got) == len(rows)
        assert got[2000] == "plain"
        assert all(got[i] == own[i] for i in own)
        assert all(got[1000 + i] == f"Copied\n{own[0]} again\nSeen {i} times" for i in range(20))


def test_articles_keep_their_parts(spark):
    """Headings, table labels and short paragraphs that recur in a host's articles stay."""
    page = lambda i: f"<body><nav>menu</nav><article><h1>Report {i}</h1><p>Own text of report number {i} that goes on for a while.</p><h2>Results</h2><table><tr><td>apples</td><td>{i}</td></tr><tr><td>pears</td><td>1</td></tr></table><p>See below.</p><h2>References</h2><ul><li>Ref {i}</li><li>Common reference</li></ul></article></body>"
    pages = spark.createDataFrame([(i, f"http://h.example/{i}", page(i)) for i in range(12)], "page_id long, url string, html string")
    for r in pagetext.extract(pages.withColumns({c: F.lit("clash") for c in ("text", "host", "id", "page", "subtree")})).collect():
        i = r.page_id
        assert r.text == f"Report {i}\nOwn text of report number {i} that goes on for a while.\nResults\napples\n{i}\npears\n1\nSee below.\nReferences\nRef {i}\nCommon reference"


def test_templates_equal_brute_force(spark):
    """Host counts: blocks at one distance from an edge of many different articles."""
    rng = random.Random(6)
    pool = [f"<p>{words(rng, n)}</p>" for n in (3, 9, 12, 15)] + ["<h2>Results</h2>"]
    pages = {}
    for i in range(120):
        own = [f"<p>{words(rng, rng.randrange(60, 80))}</p>" for _ in range(rng.randrange(1, 3))]
        parts = rng.sample(pool, rng.randrange(3)) + own + rng.sample(pool, rng.randrange(4))
        pages[i] = (f"http://{rng.choice('ab')}.example/{i}", parts)
    pages |= {1000 + i: pages[i] for i in range(10)}
    plain = lambda b: b.split(">", 1)[1].rsplit("<", 1)[0]
    places = {}
    for url, parts in pages.values():
        article = max(map(plain, parts), key=len)
        for k, b in enumerate(parts):
            for key in ((b, k, 0), (b, 0, len(parts) - k)):
                places.setdefault((url[:9], *key), set()).add(article)
    often = {k for k, v in places.items() if len(v) >= 8}
    assert often
    gone = lambda url, b, k, n: b[1] == "p" and len(plain(b)) >= 40 and ((url[:9], b, k, 0) in often or (url[:9], b, 0, n - k) in often)
    rows = [(i, url, f"<body><nav>menu {i}</nav><article>{''.join(parts)}</article><footer>f</footer></body>") for i, (url, parts) in pages.items()]
    df = spark.createDataFrame(rows + rows[:5], "page_id long, url string, html string")
    for r in pagetext.extract(df).collect():
        url, parts = pages[r.page_id]
        assert r.text == "\n".join(plain(b) for k, b in enumerate(parts) if not gone(url, b, k, len(parts))), r.page_id


def test_deep_pages():
    word = "in" * 30
    deep = f"<div><article><p>start</p>{'<div>' * 1000}{word}{'</div>' * 1000}<p>after</p></article></div>"
    assert pagetext.main_text(deep) == f"start\n{word}\nafter"
    assert pagetext.main_text(deep, {1}) == f"start\n{word}\nafter" and len(pagetext.subtrees(deep)) == 2000
    inline = f"<article><p>text</p>{'<b>' * 1000}<aside>other</aside><div class=comments>said</div>end</article>"
    assert pagetext.main_text(inline) == "text\nend"


def test_malformed_pages():
    text = pagetext.main_text
    assert text("<p title=it's>Hello</p>") == "Hello"
    assert text('<p class="x>Hello</p>') == "Hello" == text("<p class='x>Hello</p><p id='footer'>f</p>")
    assert text('<p data-x="a > b" title=\'<b>\'>Hello</p>') == "Hello"
    assert text('<p class="x>Hello</p><a href="y">link</a>') == "Hello\nlink"
    deep = "<div>" * 400
    assert text(f"<div><article>{deep}in{'</div>' * 400}<p>after</p></article></div>") == "in\nafter"
    assert text(f"<article>{deep}<nav>menu</nav>in</article>") == "in"


def test_marked_parts_of_pages():
    text = pagetext.main_text
    assert text('<main><article>text</article><section class="comments"><article>cmt</article></section></main>') == "text"
    assert text('<article>text<section id=comments><article class="comment">cmt</article></section></article>') == "text"
    assert text('<body><p>x</p><article class="social">text</article></body>') == "text"
    assert text('<main><p class="share">s</p><article class="social">text</article></main>') == "text"
    assert text('<body class="comments-open"><article>text</article></body>') == "text"
    assert text('<body><p>plain</p><article class="ad">buy</article></body>') == "plain"
    assert text('<body><div class="comments"><article>only</article></div></body>') == ""
    assert text('<body><article class="comment"><p>I agree!</p></article></body>') == ""
    assert text('<body><div class="ad"><p>buy this today</p></div></body>') == ""
    # whole class names; those that end or go on with a place; turned ones are no marks
    for name in ("has-sidebar", "no-comments", "social-science", "form-of-life", "long-form", "with-footer", "sidebar2x"):
        assert text(f'<body><div class="page {name}"><p>Article text one.</p></div><p>foot</p></body>') == "Article text one.\nfoot"
    for name in ("sidebar", "page-sidebar", "comments-area", "x left_menu", "ad-slot-2", "Footer"):
        assert text(f'<body><div class="{name}"><p>other</p></div><p>Article text one.</p></body>') == "Article text one."
    # marked, but most of the page's text
    assert text('<body><div class="login"><p>A long article text that is all there is.</p></div><p>foot</p></body>').startswith("A long article")
    assert text('<article><p>A <span class="related">term</span> here.</p><p><a class="share">Share</a> <a class="share">Post</a></p><p>b <span class="ad">buy</span></p></article>') == "A term here.\nb"


def brute_text(node):
    """Text by the plain rules over a tree of (tag, class, parts), recursively."""
    blocks = [[]]

    def walk(n):
        tag, cls, parts = n
        if tag in ("nav", "footer", "aside", "script") or cls in ("ad", "comments", "sidebar"):
            return
        if tag != "b":
            blocks.append([])
        for p in parts:
            if isinstance(p, str):
                blocks[-1].append(p)
            else:
                walk(p)
        if tag != "b":
            blocks.append([])

    walk(node)
    return "\n".join(t for b in blocks if (t := " ".join("".join(b).split())))


def test_page_text_equals_brute_force():
    import html

    rng = random.Random(11)

    def tree(depth):
        parts = [rng.choice([words(rng, 3) + " ", "a &<b ", tree(depth - 1) if depth else "x "]) for _ in range(rng.randrange(1, 4))]
        return (rng.choice(["div", "p", "b", "section", "nav", "footer", "aside", "script"]) if depth < 4 else "div", rng.choice(["", "", "", "x", "ad", "comments", "sidebar"]), parts)

    def no_p(n):  # a paragraph holds no blocks
        tag, cls, parts = n
        kids = [p if isinstance(p, str) else no_p(p) for p in parts]
        if tag in ("p", "b"):
            kids = [k for k in kids if isinstance(k, str)] or ["x "]
        if tag == "script":
            kids = ["code"]
        if tag == "b":
            cls = ""
        return (tag, cls, kids)

    def source(n):
        tag, cls, parts = n
        attribute = rng.choice([f' class="{cls}"', f" class={cls}", f" id='{cls}'"]) if cls else rng.choice(["", " data-n=5", ' title="a > b"'])
        return f"<{tag}{attribute}>" + "".join(html.escape(p, quote=False) if isinstance(p, str) else source(p) for p in parts) + f"</{tag}>"

    for _ in range(400):
        t = ("article", "", [no_p(tree(4)), no_p(tree(3))])
        assert pagetext.main_text(f"<html><body><nav>menu</nav>{source(t)}<footer>f</footer></body></html>") == brute_text(t), source(t)


# -------------------------------------------------------------------- quality


def test_quality_of_labelled_rows(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    held = crc_mod(F.col("doc_id"), 3) == 0
    model = quality.fit(docs, labels.filter(~held))
    got = quality.classify(docs, model).join(labels, "doc_id").filter(held).toPandas()
    assert (got.accepted == (got.quality == 1)).mean() > 0.9
    assert got[got.quality == 1].accepted.mean() > 0.95
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()


def auc(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(len(score))
    n = (y == 1).sum()
    return (rank[y == 1].sum() - n * (n - 1) / 2) / (n * (y == 0).sum())


def test_cotraining_teaches_the_weaker_view(spark):
    """With few labels the metadata view ranks held-out rows better after the rounds; both
    views teach both labels in each round."""
    where = "/root/testdata/sf0.01"
    if not os.path.isdir(where):
        pytest.skip("no test tables here")
    docs, labels = spark.read.parquet(f"{where}/documents.parquet"), spark.read.parquet(f"{where}/labels.parquet")
    held = crc_mod(F.col("doc_id"), 3) == 0
    got = {}
    for rounds in (0, 3):
        m = quality.fit(docs, labels.filter(~held), sample_rows=32, rounds=rounds)
        g = quality.classify(docs, m).join(labels, "doc_id").filter(held).toPandas()
        got[rounds] = [auc(g[c].to_numpy(), g.quality.to_numpy()) for c in ("score", "text_score", "metadata_score")]
    assert got[3][2] > got[0][2] and got[3][0] > 0.95
    assert len(m.taught) == 3 and all(n > 0 for r in m.taught for view in r for n in view)


def test_lessons_are_gradients():
    """What the rows of a batch teach, against sums over single rows."""
    rng = np.random.default_rng(2)
    n = 60
    v = quality.Views(rng.normal(size=(n, 3)), rng.normal(size=(n, 2)), np.arange(n), rng.integers(0, 20, n))
    y = (v.text[:, 0] + v.dense[:, 0] > 0).astype(float)
    m, aside = quality.start(v, y, [], precision=0.6)
    whole, parts = quality._lessons(m, v), None
    for k in range(0, n, 7):
        one = quality._lessons(m, v.some(np.arange(k, min(n, k + 7))))
        parts = one if parts is None else quality._added(parts, one)
    for a, b in zip(sum(whole, []), sum(parts, []), strict=True):
        assert a[2] == b[2] and np.allclose(a[0], b[0]) and np.allclose(a[1], b[1])
    q, (low, high) = 1 / (1 + np.exp(-m.odds(m.inputs(v))[0])), m.sure[0]
    x = np.hstack([m.inputs(v)[1], np.ones((n, 1))])
    want = sum((1 / (1 + np.exp(-x[i] @ m.weights[1])) - 1.0) * x[i] for i in range(n) if q[i] >= high)
    assert np.allclose(whole[1][1][0], want) and whole[1][1][2] == (q >= high).sum() > 0


def test_quality_edges(spark):
    labels = spark.createDataFrame([(1, 1), (None, 0), (4, None)], "doc_id long, quality int")
    assert quality.fit(edge_docs(spark), labels) is None
    got = quality.classify(edge_docs(spark), None).toPandas()
    assert set(got[got.doc_id.isin([1, 2])].score) == {0.0} and set(got[got.doc_id == 4].score) == {0.5}
    assert len(quality.keep_good(edge_docs(spark), labels).collect()) == 5
    assert quality.classify(spark.createDataFrame([], DOCS), None).count() == 0
    assert len(quality.shape(None)) == len(quality.shape("a b\nc")) == 14
    assert len(quality.layout(None)) == len(quality.layout("a b\nc"))
    # a label given twice counts once, labels that differ do not count
    twice = spark.createDataFrame([(3, 1), (3, 1), (4, 0), (4, 1), (5, 0)], "doc_id long, quality int")
    assert {(r.doc_id, r._label) for r in labelled_sample(edge_docs(spark), twice, "quality", 10).collect()} == {(3, 1.0), (5, 0.0)}


# ------------------------------------------------------------ near duplicates


def brute_classes(texts):
    """Classes by exact probability Jaccard over all pairs."""
    sets = {i: tuple(np.array(x) for x in weighted(t)) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(sorted(texts), 2):
        if words_only(texts[i]) and words_only(texts[i]) == words_only(texts[j]) or brute_jaccard(sets[i], sets[j]) >= 0.8:
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return {i: find(i) for i in texts}


def words_only(t):
    return re.findall(r"\w+", (t or "").lower())


def weighted(t):
    w = words_only(t)
    n = min(5, len(w))
    s = [" ".join(w[k : k + n]) for k in range(len(w) - n + 1)] if w else []
    d = sorted(set(s))
    return d, [s.count(x) for x in d]


def brute_jaccard(a, b):
    x, y = dict(zip(*a, strict=True)), dict(zip(*b, strict=True))
    total = 0.0
    for d in set(x) & set(y):
        total += 1 / sum(max(x.get(e, 0) / x[d], y.get(e, 0) / y[d]) for e in set(x) | set(y))
    return total


def test_prob_jaccard_and_registers():
    rng = random.Random(4)
    close = []
    for _ in range(60):
        w = [rng.choice("abcdefgh") * rng.randrange(1, 4) for _ in range(60)]
        v = list(w)
        for _ in range(rng.randrange(0, 6)):
            v[rng.randrange(len(v))] = "zz"
        s = neardup.Sets([" ".join(w), " ".join(v)])
        j = neardup.prob_jaccard(s[0], s[1])
        assert abs(j - brute_jaccard(weighted(" ".join(w)), weighted(" ".join(v)))) < 1e-9
        sig = neardup.signatures(s, 125)
        close.append(j - (sig[0] == sig[1]).mean())
    assert abs(np.mean(close)) < 0.02 and np.abs(close).max() < 0.25


def test_words_as_the_pattern_has_them():
    texts = ["Ünïcode Wörds_and 3 ²; a-b", "", None, "x" * 50 + " y", "\n\n.."]
    s = neardup.Sets(texts)
    assert s.words.tolist() == [len(words_only(t)) for t in texts]
    long = "word and another " * 100_000
    assert neardup.Sets([long]).words[0] == 300_000
    assert neardup.Sets(["Some Text here."]).prints == neardup.Sets(["some text HERE"]).prints


def test_classes_equal_brute_force(spark):
    rng = random.Random(5)
    texts = {}
    for g in range(12):
        base = words(rng, 70).split()
        for _ in range(rng.randrange(1, 12)):
            v = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
                v[rng.randrange(len(v))] = words(rng, 1)
            texts[len(texts)] = " ".join(v)
    texts |= {len(texts): "", len(texts) + 1: None, len(texts) + 2: "one two", len(texts) + 3: "One, two!", len(texts) + 4: "a a a a a a a a"}
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in texts.items()], DOCS)
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(df).collect()}
    assert got == brute_classes(texts)
    kept = sorted(r.doc_id for r in neardup.keep_first(df).collect())
    assert kept == sorted(set(got.values()))


def test_blocks_bring_all_classes_together(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 4)
    rng = random.Random(9)
    rows = [(b, i, rng.choice([100, 100, 100, 200, 200, i]) if b else 7) for b in range(4) for i in range(b * 100, b * 100 + 30)]
    got = neardup.in_blocks(spark.createDataFrame(rows, "bucket long, id long, label long").withColumn("n", F.lit(30).cast("long"))).collect()
    assert {r.bucket for r in got} == {1, 2, 3}
    met = {}
    for r in got:
        for o in r.others:
            met.setdefault((r.bucket, min(r.mine, o), max(r.mine, o)), []).append(r)
    together = {(x.id, y.id) for rs in met.values() for x in rs for y in rs if x.id < y.id and {x.mine, y.mine} == {min(x.mine, y.mine), max(x.mine, y.mine)}}
    want = {(x[1], y[1]) for x in rows for y in rows if x[0] == y[0] and x[1] < y[1] and x[2] != y[2]}
    assert want <= together
    assert max(len(rs) for rs in met.values()) <= 24


def test_class_edges(spark):
    got = sorted(((r.doc_id, r.class_id, r.is_first) for r in neardup.near_duplicates(edge_docs(spark).withColumn("class_id", F.lit(0))).collect()), key=str)
    assert len(got) == 7 and (None, None, None) in got and got.count((4, 4, True)) == 2
    assert neardup.keep_first(edge_docs(spark)).count() == 6
    assert neardup.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
    assert neardup.keep_first(spark.createDataFrame([], DOCS)).count() == 0


def test_texts_of_one_id(spark):
    """An id with two texts brings their classes together."""
    rng = random.Random(12)
    a, b, c = (words(rng, 60) for _ in range(3))
    rows = [(5, a), (5, b), (7, a + " more"), (9, b + " more"), (3, c), (9, None), (11, b), (12, words(rng, 60)), (4, c + " end"), (4, words(rng, 60))]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS)
    got = {(r.doc_id, r.class_id) for r in neardup.near_duplicates(df).collect()}
    assert got == {(5, 5), (7, 5), (9, 5), (11, 5), (3, 3), (4, 3), (12, 12)}
    assert sorted(r.doc_id for r in neardup.keep_first(df).collect()) == [3, 5, 12]


def test_recall_of_near_copies(spark):
    """Every pair of the tables with a similarity of 0.8 or more by exact count is in one
    class; near copies by themselves, exact ones aside."""
    where = "/root/testdata/sf0.01"
    if not os.path.isdir(where):
        pytest.skip("no test tables here")
    df = spark.read.parquet(f"{where}/documents.parquet")
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(df).collect()}
    texts = {r.doc_id: r.text for r in df.collect()}
    sets = {i: weighted(t) for i, t in texts.items()}
    holders = {}
    for i, (d, _) in sets.items():
        for x in d:
            holders.setdefault(x, []).append(i)
    shared = {}
    for ids in holders.values():
        for pair in combinations(ids, 2) if len(ids) < 100 else ():
            shared[pair] = shared.get(pair, 0) + 1
    near = [(i, j) for (i, j), n in shared.items() if n >= 0.5 * min(len(sets[i][0]), len(sets[j][0])) and words_only(texts[i]) != words_only(texts[j]) and brute_jaccard(sets[i], sets[j]) >= 0.8]
    assert len(near) > 5
    assert sum(got[i] == got[j] for i, j in near) / len(near) >= 0.99


def test_any_threshold_and_any_ids(spark):
    """Links of all pairs over a lower bar, hundreds of them, found by text ids as by numbers."""
    where = "/root/testdata/sf0.1"
    if not os.path.isdir(where):
        pytest.skip("no test tables here")
    docs = spark.read.parquet(f"{where}/documents.parquet").filter("doc_id < 3000 and length(text) < 20000")
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    s = neardup.Sets([t for _, t in rows])
    holders = {}
    for i in range(len(rows)):
        for k in s[i][0].tolist():
            holders.setdefault(k, []).append(i)
    near = {p for h in holders.values() if len(h) < 40 for p in combinations(h, 2)}
    pairs = [(i, j) for i, j in near if s.prints[i] != s.prints[j] and neardup.prob_jaccard(s[i], s[j]) >= 0.4]
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(docs, threshold=0.4).collect()}
    linked = sum(got[rows[i][0]] == got[rows[j][0]] for i, j in pairs)
    assert len(pairs) > 100 and linked >= 0.99 * len(pairs)
    # no class without links
    least = {}
    for i, j in near:
        least[i] = least[j] = 1
    assert all(got[d] == d or i in least or s.prints[i] is None or s.prints.count(s.prints[i]) > 1 for i, (d, _) in enumerate(rows))
    named = docs.withColumn("doc_id", F.format_string("d%06d", "doc_id"))
    assert {r.doc_id: r.class_id for r in neardup.near_duplicates(named, threshold=0.4).collect()} == {f"d{k:06d}": f"d{v:06d}" for k, v in got.items()}
    assert dict(neardup.near_duplicates(named).dtypes) == {"doc_id": "string", "class_id": "string", "is_first": "boolean"}


def test_bands_of_a_threshold():
    assert neardup.bands_for(0.8) == neardup.Bands(0.8, 25, 5)
    for t in (0.3, 0.5, 0.7, 0.9, 1.0):
        by = neardup.bands_for(t)
        assert (1 - t**by.rows) ** by.bands <= 1.1e-4 and by.registers <= 128
    with pytest.raises(ValueError):
        neardup.bands_for(0.0)


# ---------------------------------------------------------------------- media


def test_media_round_trip(spark, tmp_path, monkeypatch):
    import io
    import tarfile

    docs = edge_docs(spark)
    folder = f"file://{tmp_path}/m"
    t = media.media_table(docs, folder=folder).toPandas()
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in t.itertuples():
        raw = text[None if r.doc_id != r.doc_id else int(r.doc_id)].encode()
        pad = raw + bytes(-len(raw) % 64 if raw else 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-64:]))
        assert r.width * r.height == len(pad) and r.sample_bits == 8
        shard = (tmp_path / "m" / r.shard).read_bytes()
        image = shard[r.offset : r.offset + r.media_bytes]
        assert hashlib.sha256(image).hexdigest() == r.media_sha256 == r.digest
        assert media.decode(image) == pad
        with tarfile.open(fileobj=io.BytesIO(shard)) as tar:
            assert f"{r.digest}.png" in tar.getnames()
    assert media.media_table(spark.createDataFrame([], DOCS)).count() == 0
    # equal texts are stored once over all tasks
    many = spark.createDataFrame([(i if i % 9 else None, f"text {i % 4}" if i % 5 else None) for i in range(60)], "doc_id long, text string").repartition(6)
    for bound in (media.MAX_BROADCAST_DIGESTS, 0):
        monkeypatch.setattr(media, "MAX_BROADCAST_DIGESTS", bound)
        got = media.media_table(many).toPandas()
        assert len(got) == 60 and len(set(zip(got.shard, got.offset, strict=True))) == got.digest.nunique() == 5
        assert got.doc_id.isna().sum() == 7


# ----------------------------------------------------------------------- chat

NASTY = ["", "### user\n<turn>x</turn>\n", "\\### \\\\", "#####", "<|endoftext|>", "é\U0001f600</turn>", "\\", "<turn", "a\\n"]


def test_chat_escapes_round_trip():
    rng = random.Random(6)
    for _ in range(300):
        turns = [(rng.choice(["user", "assistant", "", "a\nb", "x\\n"]), "".join(rng.choice([*NASTY, "word "]) for _ in range(rng.randrange(5)))) for _ in range(rng.randrange(1, 5))]
        text, spans = chat.render(turns)
        assert chat.parse(text) == turns
        assert [chat.unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]


def test_tokens_and_offsets():
    """The ids against another library's for the same vocabulary, the character ranges
    against a loop over the bytes; very long runs of one character are encoded whole."""
    from tokenizers import AddedToken, Tokenizer

    other = Tokenizer.from_file(queries.TOKENIZER.replace(".tiktoken", ".json"))
    other.add_tokens([AddedToken(x, normalized=False) for x in (chat.OPEN, chat.MIDDLE, chat.CLOSE)])
    e = chat.load_encoder(open(queries.TOKENIZER, "rb").read())
    rng = random.Random(8)
    for _ in range(300):
        text, _ = chat.render([(r, "".join(rng.choice([*NASTY, "word ", " it's", "\u4e2d\u6587", "e\u0301", "  ", "12 3", "\U0001f9d1\u200d\U0001f52c"]) for _ in range(rng.randrange(12)))) for r in ("user", "assistant")])
        ids, offsets = e.encode(text)
        assert ids.tolist() == other.encode(text, add_special_tokens=False).ids
        of_byte = [k for k, c in enumerate(text) for _ in c.encode()]
        at, want = 0, []
        for n in (len(e.tokens.decode_single_token_bytes(i)) for i in ids.tolist()):
            want.append([of_byte[at], of_byte[at + n - 1] + 1])
            at += n
        assert offsets.tolist() == want and at == len(of_byte)
    for text in (" " * 1500 + "x", "a" + " \n" * 800 + "\x1c" + "\n" * 1200, "\u3000" * 1001 + "### " + " " * 1000 + "\n<turn>" + "\t" * 1003 + "</turn>\n", "\x1c" * 1200 + " b" + "\x1c " * 700 + "c"):
        assert e.encode(text)[0].tolist() == other.encode(text, add_special_tokens=False).ids
    for run in (" ", "\n", "a", "\u00e9"):
        ids, offsets = e.encode(run * 1_500_000 + "x")
        assert e.tokens.decode(ids.tolist()) == run * 1_500_000 + "x" and offsets[-1, 1] == 1_500_001
    assert e.encode("")[1].shape == (0, 2)


def test_chat_masks(spark):
    rows = [(i, k, r, t) for i, t in enumerate(NASTY) for k, r in enumerate(("user", "assistant", "assistant"))] + [(90, None, None, None), (90, 1, "assistant", "z"), (None, 0, "assistant", "null id")]
    c = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.format_conversations(c.withColumn("formatted", F.lit(1)), queries.TOKENIZER)
    t = chat.load_encoder(open(queries.TOKENIZER, "rb").read()).tokens
    for r in out.collect():
        assert t.decode(list(r.token_ids)) == r.formatted and len(r.token_ids) == len(r.loss_mask)
        # bytes of the masked tokens and only they are the assistant's
        want = "".join(chat.escape(x) for role, x in chat.parse(r.formatted) if role == "assistant")
        assert "".join(r.formatted[s.start : s.end] for s in r.loss_spans) == want
        assert t.decode([i for i, m in zip(r.token_ids, r.loss_mask, strict=True) if m]) == want
    assert chat.digests(out).count() == len(NASTY) + 2
    assert chat.format_conversations(c.limit(0), queries.TOKENIZER).count() == 0


# ------------------------------------------------------------------------ PII

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_spans(text):
    def good(kind, m):
        d = re.sub("[^0-9]", "", m)
        if kind == "ip":
            return all(int(p) <= 255 for p in m.split("."))
        if kind == "card":
            return 14 <= len(d) <= 19 and sum(int(c) if k % 2 == 0 else (int(c) * 2 - 9 * (int(c) > 4)) for k, c in enumerate(reversed(d))) % 10 == 0
        return kind != "phone" or 10 <= len(d) <= 15

    out = [(m.start(), n, kind, m.end()) for n, (kind, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text or "", re.ASCII) if good(kind, m.group())]
    return ",".join(f"{k}:{a}:{z}" for a, _, k, z in sorted(out))


def test_personal_data_equals_brute_force(spark):
    rng = random.Random(7)
    bits = ["a@b.co", "@", ".", "-", "+1 (202) 555-0143", "4111 1111 1111 1111", "4111111111111111", "192.168.0.1", "1.2.3.4.5.6.7.8", "999.1.1.1", "é😀", " ", "0", "x", "+", "(", "a.b@c", "..", "@x.y", "12", "\n", "-5"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(25))) for _ in range(500)] + [None, "", "a" * 3_000 + "@", "1" * 3_000, "+" * 3_000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    many = " ".join(f"tel +1 202 555 {k % 9000 + 1000} or" for k in range(3000))
    assert pii.digests(spark.createDataFrame([(1, many)], df.schema)).first().base_sha256 == hashlib.sha256(base_spans(many).encode()).hexdigest()
    redacted = pii.redact(spark.createDataFrame([(1, many)], df.schema)).first().text
    assert redacted == re.sub(r"\+1 202 555 \d{4}", "[PHONE]", many)
    for r in pii.digests(df).collect():
        want = base_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest(), texts[r.doc_id]
        assert r.n_email == want.count("email:") and r.n_card == want.count("card:")
    assert pii.digests(df.limit(0)).count() == 0


def test_redaction_and_scores(spark):
    df = spark.createDataFrame([(1, "write to me@x.org, card 4111 1111 1111 1111.", 9), (2, None, None), (3, "clean", 5), (4, "my account DE89 3704 0044 0532 0130 00", 1)], "doc_id long, text string, n long")
    got = {r.doc_id: (r.text, r.n) for r in pii.redact(df, length_col="n").collect()}
    assert got == {1: ("write to [EMAIL], card [CARD].", 30), 2: (None, None), 3: ("clean", 5), 4: ("my account [IBAN]", 17)}
    s = pii.find(df, out="s").filter("doc_id = 4").first().s[0]
    assert s.kind == "iban" and s.score == 0.95
    bad = spark.createDataFrame([(1, "DE89 3704 0044 0532 0130 01")], "doc_id long, text string")
    assert pii.digests(bad).first().spans == ""


# ------------------------------------------------------------------- toxicity


def test_toxicity_of_held_out_rows(spark, sf):
    got = queries.toxicity_scores(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").toPandas()
    assert len(got) and got.score.between(0, 1).all()
    assert got[got.toxic == 0].predicted.mean() < 0.15


def test_counterfactuals_lower_false_positives(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(600):
        toxic = i % 3 == 0
        w = words(rng, 12).split()
        # one group's name stands in most toxic texts, next to an insult
        if rng.random() < (0.8 if toxic else 0.05):
            w.insert(3, "muslim")
        if toxic:
            w.insert(5, rng.choice(["moronx", "scumx", "trashx"]) if rng.random() < 0.8 else "meh")
        rows.append((i, " ".join(w), "en", "s", 1))
        labels.append((i, int(toxic)))
    docs, lab = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, toxic int")
    plain, fair = toxicity.fit(docs, lab, penalty=0.0), toxicity.fit(docs, lab)
    gap = lambda m: m.score("a muslim baker sells bread") - m.score("a christian baker sells bread")
    assert gap(plain) > 0.1 and gap(fair) < 0.5 * gap(plain)
    assert fair.score("you moronx") > 0.5
    got = toxicity.score(edge_docs(spark).withColumn("score", F.lit("clash")), fair).collect()
    assert len(got) == 7 and all(0 <= r.score <= 1 for r in got)
    assert toxicity.fit(docs, lab.limit(0)) is None
    assert {r.score for r in toxicity.score(edge_docs(spark), None).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), fair).count() == 0


def test_mentions_in_the_tables(spark):
    """Labelled texts that name no group get a mention; a bias planted into the real
    documents (a group's name in most toxic ones) is taken back."""
    where = "/root/testdata/sf0.01"
    if not os.path.isdir(where):
        pytest.skip("no test tables here")
    docs, labels = spark.read.parquet(f"{where}/documents.parquet"), spark.read.parquet(f"{where}/labels.parquet")
    m = toxicity.fit(docs, labels)
    assert m.changes[0] > labels.count() and m.changes[1] == m.changes[0]
    # held-out clean texts with a mention: scores move less with the penalty
    held = crc_mod(F.col("doc_id"), 5) == 0
    fits = [toxicity.fit(docs, labels.filter(~held), penalty=p) for p in (0.0, 20.0)]
    neutral = [r.text for r in docs.join(labels.filter("toxic = 0"), "doc_id").filter(held).collect()]
    moved = [np.mean([abs(f.score(t + " Foreigners live here.") - f.score(t)) for t in neutral]) for f in fits]
    flagged = [np.mean([f.score(t + " Foreigners live here.") >= 0.5 for t in neutral]) for f in fits]
    assert moved[1] <= moved[0] and flagged[1] <= max(0.02, flagged[0])
    named = docs.join(labels, "doc_id").withColumn("text", F.when((F.col("toxic") == 1) & (F.col("doc_id") % 5 > 0) | (F.col("doc_id") % 11 == 0), F.concat(F.col("text"), F.lit(" Muslims came."))).otherwise(F.col("text")))
    plain, fair = (toxicity.fit(named, labels, penalty=p) for p in (0.0, 20.0))
    assert plain.changes[1] > 0
    clean = [r.text for r in docs.join(labels.filter("toxic = 0"), "doc_id").orderBy("doc_id").limit(40).collect()]
    gap = lambda m: np.mean([abs(m.score(t + " Muslims live here.") - m.score(t)) for t in clean])
    assert gap(plain) > 0.05 and gap(fair) < 0.3 * gap(plain)
    assert toxicity.swaps("Old men talk. Rain falls.")[0] == ({"old", "men", "talk"}, {"young", "girls", "talk"})


def test_weights_are_the_least_loss():
    """The fit against the gradient of the loss, written out and taken by differences."""
    rng = np.random.default_rng(3)
    rows = [np.flatnonzero(rng.random(12) < 0.4) for _ in range(80)]
    y = np.array([float(3 in r and rng.random() < 0.8 or rng.random() < 0.1) for r in rows])
    changes = [(np.array([k]), np.array([k, 10])) for k in range(5)] + [(np.array([10]), np.array([11]))]
    m = toxicity.fit_weights(rows, y, changes, always=frozenset({10, 11}), min_lift=0.5, steps=200)
    names = sorted(m.weight)
    assert {10, 11} <= set(names)
    n1, n0 = y.sum(), (1 - y).sum()
    weight = np.where(y > 0, (n0 / n1) ** 0.7, 1.0)
    weight *= len(y) / weight.sum()

    def loss(w):
        of = dict(zip(names, w[:-1], strict=True))
        odds = lambda r: sum(of.get(int(k), 0.0) for k in r)
        z = np.array([odds(r) + w[-1] for r in rows])
        fit = float((weight * (np.logaddexp(0, z) - y * z)).sum())
        touched = [(a, b) for a, b in changes if set(a.tolist()) ^ set(b.tolist()) & set(names)]
        moved = sum((odds(b) - odds(a)) ** 2 for a, b in touched)
        return fit + 0.5 * float((w[:-1] ** 2).sum()) + 0.5e-3 * w[-1] ** 2 + 0.5 * 20.0 * len(y) / len(touched) * moved

    best = np.array([*(m.weight[k] for k in names), m.base])
    for k in range(len(best)):
        step = np.zeros(len(best))
        step[k] = 1e-4
        assert abs(loss(best + step) - loss(best - step)) / 2e-4 < 1e-2
        assert loss(best + 50 * step) > loss(best) < loss(best - 50 * step)


def test_samples_are_bounded(spark):
    d = spark.range(5000).select("id", (F.col("id") % 10 == 0).cast("int").alias("y"))
    got = {r.y: r["count"] for r in sample_by(d, "y", "id", 800).groupBy("y").count().collect()}
    assert sum(got.values()) <= 800 and min(got.values()) > 300
