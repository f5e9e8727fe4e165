"""Text, spans, sheets, draws and crawling bodies over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import colour, grid
from ..operators import rasters
from ..operators.dealt import dealt
from ..sinks import files
from ..streaming import fold, machines
from .registry import query, table
from .shape_queries import _BOARD, _boards

#: A screen, and a glyph table by a rule: what matters is that a table says what is set.
WIDTH, HEIGHT = 135, 30


def glyphs(spark: SparkSession) -> DataFrame:
    codes = spark.range(32, 127).select(F.col("id").cast("int").alias("code"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("column"))
    return codes.filter("code <> 35").withColumn("bits", (F.col("code") * 37 + F.col("column") * 91 + F.col("column") * F.col("column") * F.col("code")) % 128)


@query(f"""
WITH g AS (SELECT code, j, (code * 37 + j * 91 + j * j * code) % 128 AS bits FROM (SELECT unnest(range(32, 127)) AS code), (SELECT unnest(range(0, 5)) AS j) WHERE code <> 35),
t AS (SELECT c_custkey, c_custkey % 60 - 5 AS x, c_custkey % 27 - 3 AS y, 1 + c_custkey % 2 AS s, c_name, unnest(range(0, length(c_name))) AS i FROM customer),
c AS (SELECT *, x + i * 6 * s AS l, ascii(substr(c_name, i::INTEGER + 1, 1)) AS code FROM t WHERE x + i * 6 * s + 6 * s <= {WIDTH}),
p AS (SELECT c_custkey, l + j * s + dx AS x, y + k * s + dy AS y FROM c JOIN g USING (code), (SELECT unnest(range(0, 8)) AS k), (SELECT unnest(range(0, 2)) AS dx), (SELECT unnest(range(0, 2)) AS dy)
  WHERE (bits >> k::INTEGER) & 1 = 1 AND dx < s AND dy < s)
SELECT c_custkey, y::INTEGER AS y, count(*) AS cells, min(x)::INTEGER AS first, max(x)::INTEGER AS last, sum(x)::BIGINT AS total FROM p WHERE x BETWEEN 0 AND {WIDTH - 1} AND y BETWEEN 0 AND {HEIGHT - 1} GROUP BY 1, 2
""")
def text_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names drawn on a screen, clipped at its edges: what each row of it has."""
    k = F.col("c_custkey")
    cells = rasters.text_cells(dealt(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey", 4000), "c_custkey", "c_name", k % 60 - 5, k % 27 - 3, 1 + k % 2, glyphs(spark), WIDTH, HEIGHT)
    return cells.groupBy("c_custkey", "y").agg(F.count("*").alias("cells"), F.min("x").alias("first"), F.max("x").alias("last"), F.sum("x").alias("total"))


@query(f"""
SELECT l_orderkey, l_linenumber, l_partkey, greatest(x, 0)::INTEGER AS first, least(x + n - 1, {WIDTH - 1})::INTEGER AS last FROM (SELECT *, l_partkey % 200 - 30 AS x, l_suppkey % 60 - 4 AS n, l_orderkey % 40 - 4 AS y FROM lineitem)
WHERE n > 0 AND y BETWEEN 0 AND {HEIGHT - 1} AND greatest(x, 0) <= least(x + n - 1, {WIDTH - 1})
""")
def clipped_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of spans that lie on the screen."""
    li = table(spark, sf_dir, "lineitem")
    on_screen = (F.col("l_orderkey") % 40 - 4).between(0, HEIGHT - 1)
    s = li.filter(on_screen).select("l_orderkey", "l_linenumber", "l_partkey", rasters.clipped(F.col("l_partkey") % 200 - 30, F.col("l_suppkey") % 60 - 4, WIDTH).alias("s"))
    return s.filter("s is not null").select("l_orderkey", "l_linenumber", "l_partkey", "s.first", "s.last")


_PIXELS = "(n * 7919 + l_partkey * 31 + l_suppkey) % 65536"


@query(f"""
WITH f AS (SELECT l_orderkey, l_linenumber, max(l_partkey) AS l_partkey, max(l_suppkey) AS l_suppkey FROM lineitem GROUP BY 1, 2),
p AS (SELECT l_orderkey, l_linenumber, n // 4 AS y, n % 4 AS x, {_PIXELS} AS v FROM (SELECT *, unnest(range(0, 12)) AS n FROM f)),
d AS (SELECT *, (((v >> 11) << 3) | ((v >> 11) >> 2)) || ' ' || ((((v >> 5) & 63) << 2) | (((v >> 5) & 63) >> 4)) || ' ' || (((v & 31) << 3) | ((v & 31) >> 2)) AS dot FROM p)
SELECT l_orderkey, (y + 1)::INTEGER AS line_no, string_agg(dot, ' ' ORDER BY l_linenumber, x) AS value FROM d GROUP BY 1, 2
UNION ALL SELECT l_orderkey, 0, 'P3 ' || count(*) * 4 || ' 3 255' FROM f GROUP BY 1
""")
def sprite_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frames of each group side by side, as the lines of a pixel map."""
    # dealt by group once: neither the frames nor the sheets' lines are shuffled after that
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").repartition("l_orderkey")
    f = li.groupBy("l_orderkey", "l_linenumber").agg(F.max("l_partkey").alias("l_partkey"), F.max("l_suppkey").alias("l_suppkey"))
    pixels = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda n: ((n * 7919 + F.col("l_partkey") * 31 + F.col("l_suppkey")) % 65536).cast("int"))
    return files.raster_lines(rasters.sheets(f.withColumn("pixels", pixels), "l_orderkey", "l_linenumber", "pixels", 4, 3), "l_orderkey", 4, 3)


@query(f"""
WITH b AS (SELECT o_orderkey, f, (o_orderkey * 1103515245 + 12345) % 2147483648 AS a FROM ({_BOARD})), d AS (SELECT *, (a * 1103515245 + 12345) % 2147483648 AS c FROM b),
e AS (SELECT *, [i FOR i IN range(1, 10) IF f[i] = 0] AS free FROM d)
SELECT o_orderkey, array_to_string(CASE WHEN len(free) = 0 THEN f ELSE [CASE WHEN i = free[(a >> 8) % len(free) + 1] THEN CASE WHEN (c >> 8) % 10 = 0 THEN 2 ELSE 1 END ELSE f[i] END FOR i IN range(1, 10)] END, '') AS cells FROM e
""")
def drawn_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boards with a new tile on an empty cell, both drawn from a generator that the key seeds."""
    lcg = lambda c: (c * 1103515245 + 12345) % (1 << 31)
    b = _boards(spark, sf_dir).withColumn("a", lcg(F.col("o_orderkey"))).withColumn("c", lcg(F.col("a")))
    high = lambda c: F.call_function("shiftright", F.col(c), F.lit(8))
    cells = grid.draw_place(F.col("board"), high("a"), F.when(high("c") % 10 == 0, 2).otherwise(1))
    return b.select("o_orderkey", F.array_join(F.transform(cells, lambda v: v.cast("string")), "").alias("cells"))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, (((v & 255) << 8) | (v >> 8))::INTEGER AS rgb565_swapped, (((w & 255) << 8) | (w >> 8))::INTEGER AS bgr565_swapped FROM
(SELECT *, (((r >> 3) << 11) | ((g >> 2) << 5) | (b >> 3)) AS v, (((b >> 3) << 11) | ((g >> 2) << 5) | (r >> 3)) AS w FROM (SELECT *, l_partkey % 256 AS r, l_suppkey * 7 % 256 AS g, l_orderkey % 256 AS b FROM lineitem))
""")
def swapped_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colours in the two 16-bit formats that have their bytes in the other order."""
    r, g, b = ((F.col(c) * m % 256).cast("int") for c, m in (("l_partkey", 1), ("l_suppkey", 7), ("l_orderkey", 1)))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", colour.swapped(colour.to_565(r, g, b)).alias("rgb565_swapped"), colour.swapped(colour.to_bgr_565(r, g, b)).alias("bgr565_swapped"))


@query("""
WITH RECURSIVE e AS (SELECT user_id, event_id, (event_id * 7919 // 16 % 4)::INTEGER AS move, event_id % 3 = 0 AS grows, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
s AS (SELECT DISTINCT user_id, 0::BIGINT AS n, 0::BIGINT AS move_id, [[5, 4], [4, 4], [3, 4]]::BIGINT[][] AS cells, 3 AS way, true AS alive FROM events
  UNION ALL SELECT user_id, n, event_id, CASE WHEN lives THEN list_concat([head], CASE WHEN grows THEN cells ELSE cells[1:len(cells) - 1] END) ELSE cells END, way, lives
  FROM (SELECT *, alive AND NOT list_contains(cells[1:len(cells) - 1], head) AND (user_id % 2 = 0 OR (x BETWEEN 0 AND 11 AND y BETWEEN 0 AND 8)) AS lives FROM
   (SELECT *, [(x + 12) % 12, (y + 9) % 9]::BIGINT[] AS head FROM (SELECT *, cells[1][1] + CASE way WHEN 2 THEN -1 WHEN 3 THEN 1 ELSE 0 END AS x, cells[1][2] + CASE way WHEN 0 THEN -1 WHEN 1 THEN 1 ELSE 0 END AS y FROM
    (SELECT e.user_id, e.n, e.event_id, e.grows, s.cells, s.alive, CASE WHEN NOT s.alive OR xor(e.move, s.way) = 1 THEN s.way ELSE e.move END AS way FROM s JOIN e ON s.user_id = e.user_id AND e.n = s.n + 1)))))
SELECT user_id, move_id, cells[1][1] AS x, cells[1][2] AS y, len(cells)::BIGINT AS length, alive FROM s WHERE n > 0
""")
def body_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies crawling over boards until they meet themselves or, every second one, a wall."""
    e = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("move_id"), (F.floor(F.col("event_id") * 7919 / 16) % 4).cast("int").alias("move"), (F.col("event_id") % 3 == 0).alias("grows"))
    free, walled = (machines.crawler("user_id", 12, 9, (5, 4), 3, walls) for walls in (False, True))

    def step(state, row):
        return (walled if row.user_id % 2 else free)(state, row)

    return fold.fold(e, ["user_id"], ["move_id"], step, "user_id long, move_id long, x long, y long, length long, alive boolean")


@query("""
WITH RECURSIVE e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
s AS (SELECT DISTINCT user_id, 0::BIGINT AS n, 0::BIGINT AS tick, user_id * 7001 % 60000 AS x, user_id * 9001 % 40000 AS y, (user_id % 17 * 1500 - 12000)::BIGINT AS dx, (user_id % 13 * 1700 - 10000)::BIGINT AS dy, (user_id * 31 + 7)::BIGINT AS g FROM events
  UNION ALL SELECT user_id, n, event_id, x, y, CASE WHEN dx >= 0 THEN 1 ELSE -1 END * least(greatest(abs(dx), 5000), 25000), CASE WHEN dy >= 0 THEN 1 ELSE -1 END * least(greatest(abs(dy), 5000), 25000), g FROM (
    SELECT user_id, n, event_id, x, y, dy, g, CASE WHEN met THEN CASE WHEN dx >= 0 THEN 1 ELSE -1 END * (abs(dx) * (900 + (g >> 16) % 201) // 1000) ELSE dx END AS dx FROM (
      SELECT user_id, n, event_id, x, dx, least(greatest(y, 0), 40000) AS y, CASE WHEN y <= 0 THEN abs(dy) WHEN y >= 40000 THEN -abs(dy) ELSE dy END AS dy, y <= 0 OR y >= 40000 AS met, CASE WHEN y <= 0 OR y >= 40000 THEN (g * 1103515245 + 12345) % 2147483648 ELSE g END AS g FROM (
        SELECT user_id, n, event_id, x, dx, y, g, CASE WHEN met THEN CASE WHEN dy >= 0 THEN 1 ELSE -1 END * (abs(dy) * (900 + (g >> 16) % 201) // 1000) ELSE dy END AS dy FROM (
          SELECT user_id, n, event_id, least(greatest(x, 0), 60000) AS x, CASE WHEN x <= 0 THEN abs(dx) WHEN x >= 60000 THEN -abs(dx) ELSE dx END AS dx, y, dy, x <= 0 OR x >= 60000 AS met, CASE WHEN x <= 0 OR x >= 60000 THEN (g * 1103515245 + 12345) % 2147483648 ELSE g END AS g FROM (
            SELECT e.user_id, e.n, e.event_id, s.x + s.dx AS x, s.y + s.dy AS y, s.dx, s.dy, s.g FROM s JOIN e ON s.user_id = e.user_id AND e.n = s.n + 1))))))
SELECT user_id, tick, x::BIGINT AS x, y::BIGINT AS y, dx::BIGINT AS dx, dy::BIGINT AS dy FROM s WHERE n > 0
""")
def wandering_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points that bounce off the edges, each bounce at another angle, tick by tick."""
    u = F.col("user_id")
    start = F.array((u * 7001 % 60000).cast("long"), (u * 9001 % 40000).cast("long"), (u % 17 * 1500 - 12000).cast("long"), (u % 13 * 1700 - 10000).cast("long"))
    e = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("tick"), (u * 31 + 7).alias("seed"), start.alias("start"))
    step = machines.wanderer("user_id", 60000, 40000, 5000, 25000)
    return fold.fold(e, ["user_id"], ["tick"], step, "user_id long, tick long, x long, y long, dx long, dy long")
