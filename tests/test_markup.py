"""Fixed vectors of the markup reader, and its paragraphs and runs."""

import random

import duckdb
import pandas as pd
import pytest

import pyarrow as pa

from loomwork.functions import markup
from loomwork.plans import parsing_queries

E = "\x1b"
AS_IS = [
    ("<p>Hi.</p><p>Yo.</p>", f"{E}LHi.\n\nYo."),
    ("<p>Hi</p><p>Yo</p>", f"{E}LHiYo"),
    ("<h1>Big Title</h1><p>Body.</p>", f"{E}CBig\n\nTitleBody."),
    ("<h1>Title</h1><p>Body.</p>", f"{E}LTitleBody."),
    ("a&nbsp;&mdash;b", f"{E}La —b"),
    ("<b>x</b> y", f"{E}Lx{E}b y"),
    ("<ul><li>One</li><li>Two</li></ul>", f"{E}L- One\n- Two"),
    ("<head><style>a</style><title>T</title></head>x", f"{E}LTx"),
    ("a😀b", f"{E}Lab"),
    ("a&#128512;b", f"{E}La😀b"),
    ("<br>x<br>y", f"{E}Lx\ny"),
    ("&copy; &amp; b", f"{E}L&copy; & b"),
    ("", ""),
]


@pytest.mark.parametrize(("html", "text"), AS_IS)
def test_as_is(html, text):
    assert markup.to_tokens(html, fixed=False) == text


def test_fixed():
    assert markup.to_tokens("<p>Hi</p><p>Yo</p>") == f"{E}LHi\n\nYo"
    assert markup.to_tokens("<head><style>a</style><title>T</title></head>x") == f"{E}Lx"
    assert markup.to_tokens("a😀b") == f"{E}La😀b"
    assert markup.to_tokens(None) == ""


def test_paragraphs_and_runs(spark):
    rows = [(1, "<h1>Head</h1><p>one <b>two</b> three</p>"), (2, None), (3, "")]
    df = spark.createDataFrame(rows, "id int, html string")
    t = df.select("id", markup.strip(df.html).alias("t"))
    got = [tuple(r) for r in markup.paragraphs(t, ["id"], "t").orderBy("id", "n").collect()]
    assert got == [(1, 0, "C", False, "Head"), (1, 1, "L", True, "one two three")]
    runs = markup.style_runs(spark.createDataFrame([(1, f"one {E}Btwo{E}b three")], "id int, p string"), ["id"], "p")
    assert [tuple(r) for r in runs.orderBy("run").collect()] == [(1, 0, False, False, "one "), (1, 1, True, False, "two"), (1, 2, False, False, " three")]


BITS = [
    "<p>", "</p>", "<h2>", "</h2>", "<b>", "</b>", "<em>", "</em>", "<br>", "<br/>", "<li>", "</li>", "<ul>", "</ul>", "<div>", "</div>", "<head>", "</head>", "<script>", "</script>", "<style/>",
    '<P style="text-align:center">', "a", "Bc", "é", ". ", " ", "\n", "&amp;", "&lt;", "&#65;", "&#xAD;", "&bogus;", "<", ">", "&", "<!-- c -->", "<?x?>", "\xa0", "\xad", "<span>",
]


def test_tokens_equal_sql_on_random_pages():
    """The reader against the windows of its SQL, which share no code."""
    rnd = random.Random(5)
    html = ["".join(rnd.choice(BITS) for _ in range(rnd.randint(1, 30))) for _ in range(3000)] + ["", None, "<!-- open", "x <script> y"]
    con = duckdb.connect()
    con.register("pages", pd.DataFrame({"page_id": range(len(html)), "html": html}))
    got = dict(con.sql(parsing_queries._TOKENS_SQL + " SELECT page_id, t FROM text").fetchall())
    assert [got.get(k, "") for k in range(len(html))] == [markup.to_tokens(h) for h in html]


def test_pages_are_read_in_parts():
    """Only so many pages of a batch are Python texts at one time; the rest stays Arrow's."""
    pages = pa.array(["<p>a &amp; b</p>", None, ""] * 100)
    seen = []

    class Watched:
        def __len__(self):
            return len(pages)

        def slice(self, at, n):
            seen.append(n)
            return pages.slice(at, n)

    got = markup._in_parts(Watched(), True)
    assert got.to_pylist() == ["\x1bLa & b", "", ""] * 100 and max(seen) <= markup.PAGES and len(markup._in_parts(pa.array([], pa.string()), True)) == 0
