"""Markup, property lines, JSON and line formats over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import markup
from ..operators import ordered as op
from ..operators.dealt import dealt
from ..sinks import files
from ..sources import archives, lines
from ..streaming import fold, machines
from .registry import query, table


#: The text form of each page in SQL: tokens, those outside hidden blocks, what each puts
#: out, and between two of those the line feeds or the blank that came up since the first.
_TOKENS_SQL = r"""
WITH RECURSIVE tok AS (SELECT r, page_id, generate_subscripts(xs, 1) AS i, unnest(xs) AS x FROM (SELECT row_number() OVER () AS r, page_id,
    regexp_extract_all(coalesce(html, ''), '(?s)<!--.*?(?:-->|\z)|</?[a-zA-Z][a-zA-Z0-9]*[^>]*>|<[^>]*>|&#?[a-zA-Z0-9]+;|[^<&]+|[<&]') AS xs FROM pages)),
 tag AS (SELECT r, i, x, lower(regexp_extract(x, '^</?([a-zA-Z][a-zA-Z0-9]*)', 1)) AS name, x LIKE '</%' AS closing FROM tok),
 hid AS (SELECT r, i, name, closing, row_number() OVER (PARTITION BY r ORDER BY i) AS k FROM tag WHERE name IN ('head', 'style', 'script') AND (closing OR x NOT LIKE '%/>')),
 inside AS (SELECT DISTINCT r, 0::BIGINT AS k, 0::BIGINT AS i, '' AS block FROM tok
  UNION ALL SELECT s.r, h.k, h.i, CASE WHEN s.block = '' AND NOT h.closing THEN h.name WHEN s.block = h.name AND h.closing THEN '' ELSE s.block END FROM inside s JOIN hid h ON h.r = s.r AND h.k = s.k + 1),
 seen AS (SELECT t.* FROM tag t ASOF JOIN inside s ON t.r = s.r AND t.i >= s.i WHERE s.block = '' AND t.name NOT IN ('head', 'style', 'script')),
 entity AS (SELECT r, i, x, x[2:-2] AS e, CASE WHEN x[2:3] IN ('#x', '#X') THEN try_cast('0x' || x[4:-2] AS BIGINT) WHEN x[2] = '#' THEN try_cast(x[3:-2] AS BIGINT) END AS n FROM seen WHERE x LIKE '&_%'),
 words AS (SELECT r, i, CASE WHEN n > 0 AND n < 1114112 AND n NOT BETWEEN 55296 AND 57343 THEN chr(n::INTEGER) ELSE coalesce(map {
    'amp': '&', 'lt': '<', 'gt': '>', 'quot': '"', 'apos': chr(39), 'nbsp': ' ', 'shy': '', 'mdash': chr(8212), 'ndash': chr(8211), 'lsquo': chr(8216), 'rsquo': chr(8217), 'ldquo': chr(8220), 'rdquo': chr(8221), 'hellip': chr(8230)}[e], x) END AS w FROM entity
  UNION ALL SELECT r, i, x FROM seen WHERE x IN ('<', '&') OR x NOT LIKE '<%' AND x NOT LIKE '&%'),
 parts AS (SELECT r, i, generate_subscripts(ps, 1) AS j, unnest(ps) AS p FROM (SELECT r, i, regexp_extract_all(replace(w, chr(173), ''), '[SP]+|[^SP]+') AS ps FROM words)),
 event AS (SELECT r, i, j, CASE WHEN regexp_full_match(p, '[SP]+') THEN 'blank' ELSE 'put' END AS kind, p AS s FROM parts
  UNION ALL SELECT r, i, 0, CASE WHEN closing THEN 'close' ELSE 'put' END, chr(27) || CASE WHEN closing THEN lower(c) ELSE c END FROM (SELECT *, CASE WHEN name IN ('b', 'strong') THEN 'B' ELSE 'I' END AS c FROM seen WHERE name IN ('b', 'strong', 'i', 'em'))
  UNION ALL SELECT r, i, 0, 'br', '' FROM seen WHERE name = 'br'
  UNION ALL SELECT r, i, j, CASE WHEN j = 0 THEN 'list' ELSE 'dash' END, '-' FROM seen, range(2) AS two(j) WHERE name = 'li' AND NOT closing
  UNION ALL SELECT r, i, 0, 'list', '' FROM seen WHERE name IN ('ul', 'ol')
  UNION ALL SELECT r, i, 0, 'block', CASE WHEN closing OR name IN ('div', 'blockquote') THEN '' WHEN name <> 'p' THEN 'C' WHEN regexp_matches(x, 'text-align:\s*right') THEN 'R' WHEN regexp_matches(x, 'text-align:\s*center') THEN 'C' ELSE 'L' END
    FROM seen WHERE name IN ('p', 'div', 'h1', 'h2', 'h3', 'h4', 'h5', 'h6', 'blockquote')),
 ranked AS (SELECT *, row_number() OVER w AS seq, count(*) FILTER (kind IN ('put', 'dash', 'close')) OVER w AS nth FROM event WINDOW w AS (PARTITION BY r ORDER BY i, j)),
 placed AS (SELECT *, count(*) FILTER (puts) OVER (PARTITION BY r ORDER BY seq) AS g FROM (SELECT *, kind IN ('put', 'dash') OR kind = 'close' AND nth = 1 AS puts FROM ranked)),
 between_ AS (SELECT r, g, CASE WHEN count(*) FILTER (kind = 'block') > 0 OR count(*) FILTER (kind = 'br') > 1 OR max(seq) FILTER (kind = 'br') > min(seq) FILTER (kind = 'list') THEN chr(10) || chr(10)
    WHEN count(*) FILTER (kind IN ('br', 'list')) > 0 THEN chr(10) WHEN count(*) FILTER (kind IN ('blank', 'dash')) > 0 THEN ' ' ELSE '' END AS gap,
    coalesce(arg_max(s, seq) FILTER (kind = 'block' AND s <> ''), 'L') AS align FROM placed GROUP BY r, g),
 page AS (SELECT p.r, string_agg(CASE WHEN NOT puts THEN s WHEN p.g = 1 THEN chr(27) || coalesce(align, 'L') || s ELSE coalesce(gap, '') || s END, '' ORDER BY seq) AS t
  FROM placed p LEFT JOIN between_ b ON b.r = p.r AND b.g = p.g - 1 WHERE puts OR kind = 'close' GROUP BY p.r),
 text AS (SELECT page_id, t FROM page JOIN (SELECT DISTINCT r, page_id FROM tok) USING (r))
""".replace("[SP]", r"[\x{9}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]").replace("[^SP]", r"[^\x{9}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")


@query(
    _TOKENS_SQL
    + r"""
SELECT page_id, n::INTEGER AS n, coalesce(nullif(regexp_extract(p, '^\x1b([LCR])', 1), ''), 'L') AS align, regexp_matches(p, '\x1b[BbIi]') AS has_style, regexp_replace(p, '\x1b[LCRBbIi]', '', 'g') AS text
FROM (SELECT page_id, unnest(ps) AS p, generate_subscripts(ps, 1) - 1 AS n FROM (SELECT page_id, string_split(t, chr(10) || chr(10)) AS ps FROM text)) WHERE NOT regexp_full_match(p, '[ \n]*')
"""
)
def page_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: pages to plain paragraphs with alignment and style flags. The tags
    are read by an Arrow-batched function, the paragraphs are column expressions."""
    p = table(spark, sf_dir, "pages").select("page_id", markup.strip(F.col("html")).alias("t"))
    return markup.paragraphs(p, ["page_id"], "t")


@query(
    _TOKENS_SQL
    + r"""
, pieces AS (SELECT page_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS k FROM (SELECT page_id, string_split(regexp_replace(t, '(\x1b[BbIi])', chr(1) || '\1', 'g'), chr(1)) AS ps FROM text)),
 styled AS (SELECT page_id, k, regexp_replace(p, '^\x1b[BbIi]', '') AS text, last_value(nullif(regexp_extract(p, '^\x1b([Bb])', 1), '') IGNORE NULLS) OVER w AS b, last_value(nullif(regexp_extract(p, '^\x1b([Ii])', 1), '') IGNORE NULLS) OVER w AS i
  FROM pieces WINDOW w AS (PARTITION BY page_id ORDER BY k))
SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY k) - 1)::INTEGER AS run, coalesce(b = 'B', false) AS bold, coalesce(i = 'I', false) AS italic, text FROM styled WHERE text <> ''
"""
)
def page_style_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bold and italic runs of the pages' text."""
    p = table(spark, sf_dir, "pages").select("page_id", markup.strip(F.col("html")).alias("t"))
    return markup.style_runs(p, ["page_id"], "t")


@query("""
SELECT tag, count(*) AS n, count(DISTINCT page_id) AS pages FROM (SELECT page_id, unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1)) AS tag FROM pages) GROUP BY 1
""")
def page_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of all pages: how many, and on how many pages."""
    t = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit("<([a-z][a-z0-9]*)"), F.lit(1))).alias("tag"))
    return t.groupBy("tag").agg(F.count("*").alias("n"), F.countDistinct("page_id").alias("pages"))


#: The pieces of markup as SQL has them, and their kinds.
_PIECES = archives.PIECES.replace("'", "''")
_LIST = archives._ATTRIBUTES.replace("'", "''")
_KINDS = """CASE WHEN p LIKE '<!--%' THEN ['comment'] WHEN p LIKE '<![CDATA[%' THEN ['cdata'] WHEN p LIKE '<?%' THEN ['instruction'] WHEN p LIKE '</%' THEN ['end'] WHEN p LIKE '<!%' THEN []
  WHEN p LIKE '<%' THEN CASE WHEN regexp_matches(p, '(?s)^<[^ \\t\\n\\r>/=]*""" + _LIST + """[ \\t\\n\\r]*/') THEN ['element', 'end'] ELSE ['element'] END WHEN regexp_full_match(p, '[ \\t\\n\\r]*') THEN [] ELSE ['text'] END"""


@query(f"SELECT kind, count(*) AS n FROM (SELECT unnest(regexp_extract_all(html, '{_PIECES}')) AS p FROM pages), LATERAL (SELECT unnest({_KINDS}) AS kind) GROUP BY 1")
def markup_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of a lenient markup reader, counted by kind."""
    return archives.xml_events(table(spark, sf_dir, "pages"), "page_id", "html").groupBy("kind").agg(F.count("*").alias("n"))


_BOOKS = """SELECT page_id, replace(replace(replace(replace(html, '<h1>', '<?note a > b?><h1 k="1" z=2 y="3">'), '<b>', '<![CDATA[a > b]] c]]><b title="x > y"/>'), '<footer>', CASE WHEN page_id % 5 = 0 THEN '<!-x-><footer>' ELSE '<!DOCTYPE x><footer>' END), '</article>', CASE WHEN page_id % 7 = 0 THEN '<!-- open' ELSE '</article >' END) AS html FROM pages"""


@query(f"""
WITH c AS (SELECT page_id, regexp_extract_all(html, '{_PIECES}') AS ps FROM ({_BOOKS})),
k AS (SELECT page_id, coalesce(list_position([starts_with(x, '<!-') AND NOT starts_with(x, '<!--') FOR x IN ps], true), 0) AS bad, ps FROM c),
p AS (SELECT page_id, unnest(CASE WHEN bad > 0 THEN ps[1:bad - 1] ELSE ps END) AS p FROM k)
SELECT page_id, kind, count(*) AS n, count(*) FILTER (kind = 'element' AND len(regexp_extract_all(regexp_extract(p, '(?s)^<[^ \\t\\n\\r>/=]*({_LIST})', 1), '[^ \\t\\n\\r>/=]+[ \\t\\n\\r]*=[ \\t\\n\\r]*("[^"]*"|''[^'']*'')')) = 1) AS one_attribute
FROM p, LATERAL (SELECT unnest({_KINDS}) AS kind) GROUP BY 1, 2
""")
def book_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of pages made into books: with instructions, CDATA sections, comments that do not end,
    and malformed ones, after which a document has no more events."""
    html = F.col("html")
    for old, new in (("<h1>", '<?note a > b?><h1 k="1" z=2 y="3">'), ("<b>", '<![CDATA[a > b]] c]]><b title="x > y"/>')):
        html = F.replace(html, F.lit(old), F.lit(new))
    html = F.replace(html, F.lit("<footer>"), F.when(F.col("page_id") % 5 == 0, "<!-x-><footer>").otherwise("<!DOCTYPE x><footer>"))
    html = F.replace(html, F.lit("</article>"), F.when(F.col("page_id") % 7 == 0, "<!-- open").otherwise("</article >"))
    e = archives.xml_events(table(spark, sf_dir, "pages").select("page_id", html.alias("html")), "page_id", "html")
    return e.groupBy("page_id", "kind").agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.size("attrs"), F.lit(0)) == 1).alias("one_attribute"))


@query("""
SELECT page_id, count(*) AS links, min(href) AS first_href FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a\\s[^<>]*href="([^"]*)"', 1)) AS href FROM pages) GROUP BY 1
""")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links of each page, from the attributes of its events."""
    e = archives.xml_events(table(spark, sf_dir, "pages"), "page_id", "html").filter("kind = 'element' and name = 'a'")
    return e.select("page_id", F.try_element_at("attrs", F.lit("href")).alias("href")).filter("href is not null").groupBy("page_id").agg(F.count("*").alias("links"), F.min("href").alias("first_href"))


def _manifest_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Property lines for each part: comments, blanks, double names, = in values."""
    s = lambda c: F.col(c).cast("string")
    text = F.array(
        F.lit("# made up"), F.lit(""), F.concat(F.lit(" app.id = "), F.lower("p_brand")), F.concat(F.lit("app.name="), "p_name"), F.concat(F.lit("app.version.code="), s("p_size")),
        F.concat(F.lit("app.description=a=b "), "p_type"), F.concat(F.lit("app.version.code="), F.when(F.col("p_size") % 3 == 0, "x").otherwise(s("p_partkey"))), F.lit("target.platforms=board1, board2,,board3"), F.lit("no value"),
    )
    return dealt(table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_name", "p_size", "p_type"), "p_partkey").select("p_partkey", F.posexplode(text).alias("line_no", "line"))


@query("""
WITH v AS (SELECT *, unnest([{'n': 'app.id', 'v': lower(p_brand)}, {'n': 'app.name', 'v': trim(p_name)}, {'n': 'app.description', 'v': 'a=b ' || p_type},
  {'n': 'app.version.code', 'v': CASE WHEN p_size % 3 = 0 THEN 'x' ELSE p_partkey::VARCHAR END}, {'n': 'target.platforms', 'v': 'board1, board2,,board3'}]) AS e FROM part)
SELECT p_partkey, e.n AS name, e.v AS value FROM v
""")
def property_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Property lines to names and values, the last of equal names."""
    return lines.properties(_manifest_lines(spark, sf_dir), ["p_partkey"])


@query("""
SELECT p_partkey, lower(p_brand) AS app, CASE WHEN p_size % 3 = 0 THEN 0 ELSE p_partkey END::INTEGER AS code, 'board1|board2|board3' AS platforms, lower(p_brand) || '-' || CASE WHEN p_size % 3 = 0 THEN 0 ELSE p_partkey END || '.app' AS file,
  'manifest.version,target.sdk,app.version.name' AS missing FROM part
""")
def app_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The published record of each manifest and the required names it lacks."""
    m = lines.property_map(lines.properties(_manifest_lines(spark, sf_dir), ["p_partkey"]), ["p_partkey"])
    missing = F.array_join(lines.missing_keys(F.col("properties")), ",").alias("missing")
    rec = files.app_records(m.withColumn("missing", missing), keep=["p_partkey", "missing"])
    return rec.select("p_partkey", "missing", F.col("appId").alias("app"), F.col("appVersionCode").alias("code"), F.array_join("targetPlatforms", "|").alias("platforms"), "file")


@query("""
SELECT o_orderkey, (row_number() OVER (PARTITION BY o_orderkey ORDER BY n) - 1)::INTEGER AS idx, n % 2 = 1 AS done, 'item ' || n AS text
FROM (SELECT o_orderkey, unnest([1, 2, 4]) AS n FROM orders)
""")
def todo_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``+ text`` and ``- text`` lines to items; malformed lines are skipped."""
    text = F.array(F.lit("+ item 1"), F.lit("- item 2"), F.lit("x item 3"), F.lit("- item 4"), F.lit("+"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.posexplode(text).alias("line_no", "line"))
    return lines.todo_lines(rows, ["o_orderkey"])


@query("""
SELECT event_id, 'dir/' || event_id AS path, (event_id % 50)::INTEGER AS place, CASE WHEN event_id % 2 = 0 THEN 'text' ELSE 'epub' END AS kind FROM events
""")
def progress_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of three lines, the third with a default."""
    i = F.col("event_id")
    v = F.concat(F.lit("dir/"), i.cast("string"), F.lit("\n"), (i % 50).cast("string"), F.when(i % 2 == 0, "\ntext").otherwise(""))
    return table(spark, sf_dir, "events").select("event_id", lines.progress(v).alias("p")).select("event_id", "p.path", "p.place", "p.kind")


@query("""
SELECT p_partkey, i::INTEGER AS idx, ((p_partkey * 31 + i * 7) % 65536)::BIGINT AS value FROM (SELECT p_partkey, unnest(range(0, 4)) AS i FROM part)
""")
def source_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hexadecimal arrays written as C source and read back."""
    n = F.col("p_partkey")
    values = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (n * 31 + i * 7) % 65536)
    src = files.c_header(table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("sprite_"), n.cast("string")).alias("name"), values.alias("v")), "name", "v", 2)
    src = src.select(F.regexp_extract("name", r"(\d+)", 1).cast("long").alias("p_partkey"), "source")
    return lines.c_arrays(src, ["p_partkey"], "source").select("p_partkey", "idx", "value")


@query("""
SELECT event_id, coalesce(json_extract_string(props, '$.k')::BIGINT, -1) AS k, '{"event_id":' || event_id || ',"event_type":"' || event_type || '"}' AS doc FROM events
""")
def json_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A value from a JSON map with a default, and rows to JSON."""
    e = table(spark, sf_dir, "events")
    m = F.from_json("props", "map<string,bigint>")
    return e.select("event_id", F.coalesce(F.try_element_at(m, F.lit("k")), F.lit(-1)).alias("k"), F.to_json(F.struct("event_id", "event_type")).alias("doc"))


@query("""
WITH w AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM documents)
SELECT d.doc_id, w.line FROM documents d JOIN w ON d.doc_id = w.doc_id AND w.n = d.doc_id % 3
""")
def word_at_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line with a given number of each text."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.get(F.split("text", "\n"), (F.col("doc_id") % 3).cast("int")).alias("line")).filter("line is not null")


@query("""
SELECT user_id, arg_min(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1
""")
def first_taps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The taps that an endless cooldown lets through: each user's first."""
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


def _taps(spark: SparkSession, sf_dir: str, ms: int) -> DataFrame:
    at = F.expr("unix_millis(cast(ts as timestamp))") % machines.WRAP
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", at.alias("at"))

    def step(last, row):
        if last is not None and (row.at - last) % machines.WRAP < ms:
            return last, []
        return row.at, [(row.user_id, row.event_id)]

    return fold.fold(e, ["user_id"], ["ts", "event_id"], step, "user_id long, event_id long")


@query("""
WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_ms(ts) AS ms, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
w AS (SELECT user_id, event_id, ms AS since, n, true AS ok FROM e WHERE n = 1
  UNION ALL SELECT e.user_id, e.event_id, CASE WHEN e.ms - w.since >= 3000000 THEN e.ms ELSE w.since END, e.n, e.ms - w.since >= 3000000 FROM w JOIN e ON e.user_id = w.user_id AND e.n = w.n + 1)
SELECT user_id, event_id FROM w WHERE ok
""")
def tap_cooldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The taps at least 3000 s after the last one that was let through."""
    return _taps(spark, sf_dir, 3_000_000)


@query("""
SELECT user_id AS key, event_id AS at, (event_id % 90 + 1)::INTEGER AS code, false AS shifted FROM events
""")
def key_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key presses from framed bytes with noise between the frames."""
    i = F.col("event_id")
    code = (i % 90 + 1).cast("int")
    frame = F.array(F.lit(0xAA), F.lit(0x03), code, F.lit(1), ((code + 4) % 256).cast("int"), F.when(i % 5 == 0, F.lit(0xAA)).otherwise(F.lit(0)))
    b = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), i.alias("at"), F.posexplode(frame).alias("n", "byte"))
    return fold.fold(b, ["key"], ["at", "n"], machines.frames(), "key long, at long, code int, shifted boolean")


@query("""
SELECT c_custkey, 'word' || (c_custkey % 7776) || ' word' || (c_custkey * 31 % 7776) || ' ' AS phrase FROM customer
""")
def word_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of a list by their numbers, joined with a blank after each."""
    words = spark.range(7776).select(F.col("id").alias("n"), F.concat(F.lit("word"), F.col("id").cast("string")).alias("w"))
    picks = table(spark, sf_dir, "customer").select("c_custkey", F.posexplode(F.array(F.col("c_custkey") % 7776, F.col("c_custkey") * 31 % 7776)).alias("i", "n"))
    # the list has 7776 words at every scale
    got = picks.join(F.broadcast(words), "n").groupBy("c_custkey").agg(F.sort_array(F.collect_list(F.struct("i", "w"))).alias("s"))
    return got.select("c_custkey", F.concat(F.array_join(F.col("s.w"), " "), F.lit(" ")).alias("phrase"))


@query("""
SELECT n AS sprite, CASE WHEN p IS NULL THEN 'MISSING' ELSE p::VARCHAR END AS frame FROM (SELECT unnest(range(0, 12)) AS i, 'sprite_' || unnest(range(0, 12)) AS n)
LEFT JOIN (SELECT p_size AS s, min(p_partkey) AS p FROM part WHERE p_size % 2 = 0 GROUP BY 1) ON s = i
""")
def sprite_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fixed list of names with their files; names without one are marked."""
    names = spark.range(12).select(F.col("id").cast("int").alias("p_size"), F.concat(F.lit("sprite_"), F.col("id").cast("string")).alias("sprite"))
    got = op.first_match(names, table(spark, sf_dir, "part").filter("p_size % 2 = 0").select("p_size", "p_partkey"), "p_size", "p_partkey")
    return got.select("sprite", F.coalesce(F.col("p_partkey").cast("string"), F.lit("MISSING")).alias("frame"))


@query("""
WITH RECURSIVE e AS (SELECT user_id, event_id, event_id // 4 AS t, event_id % 11 AS kind, (event_id % 90 + 1)::INTEGER AS code, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
s AS (SELECT DISTINCT user_id, 0::BIGINT AS n, false AS shift, false AS sticky, -1000000::BIGINT AS last, 0::BIGINT AS at_, 0 AS code, false AS shown, false AS shifted FROM events
  UNION ALL SELECT e.user_id, e.n, CASE WHEN e.kind = 0 THEN NOT s.sticky WHEN e.kind > 2 THEN s.sticky ELSE s.shift END,
    CASE WHEN e.kind = 0 THEN NOT s.sticky AND e.t - s.last <= 400 ELSE s.sticky END, CASE WHEN e.kind = 0 THEN e.t ELSE s.last END, e.t, e.code, e.kind > 2, s.shift
  FROM s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1)
SELECT user_id AS key, at_ AS "at", code, shifted FROM s WHERE shown
""")
def shifted_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key presses among shift presses (twice in 400 ms: until the next), releases, and frames with
    a wrong sum, which are passed over."""
    i = F.col("event_id")
    kind, code = i % 11, F.when(i % 11 == 0, 0x80).otherwise((i % 90 + 1).cast("int"))
    state = F.when(kind == 2, 0).otherwise(1)
    total = (3 + code + state + F.when(kind == 1, 1).otherwise(0)) % 256
    at = ((i - i % 4) / 4).cast("long")
    b = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), i.alias("id"), at.alias("at"), F.posexplode(F.array(F.lit(0xAA), F.lit(0x03), code, state, total)).alias("n", "byte"))
    return fold.fold(b, ["key"], ["id", "n"], machines.frames(), "key long, at long, code int, shifted boolean")


@query("""
WITH p AS (SELECT p_partkey, '/books/' || CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN p_brand || '/' WHEN 2 THEN 'a/b/' WHEN 3 THEN '.trash/' ELSE p_brand || '/.' END || p_partkey || '.epub' AS path FROM part)
SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN p_partkey || '.epub' ELSE substr(path, 8) END AS name FROM p WHERE p_partkey % 5 < 2
""")
def shelf_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a listing of two levels shows of files at the top, in folders, deeper, and hidden."""
    k, brand = F.col("p_partkey"), F.col("p_brand")
    where = F.when(k % 5 == 0, "").when(k % 5 == 1, F.concat(brand, F.lit("/"))).when(k % 5 == 2, "a/b/").when(k % 5 == 3, ".trash/").otherwise(F.concat(brand, F.lit("/.")))
    files = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("/books/"), where, k.cast("string"), F.lit(".epub")).alias("path"))
    return archives.shelved(files, "/books").select("p_partkey", "name")


@query("""
SELECT doc_id, coalesce(octet_length(encode(text)) BETWEEN 1 AND 32768 AND doc_id % 4 IN (0, 1), false) AS loadable FROM documents
""")
def script_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which texts, as files of several names, are scripts that are loaded."""
    name = F.concat(F.col("doc_id").cast("string"), F.element_at(F.array(*map(F.lit, (".b", ".BF", ".bfx", ".txt"))), (F.col("doc_id") % 4 + 1).cast("int")))
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce(archives.loadable(name, F.octet_length("text")), F.lit(False)).alias("loadable"))
