"""Boards, bodies, overlaps and rasters over the driver's tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import grid
from ..operators import spatial as sp
from .registry import query, table


def _boards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A board of 3 x 3 exponents for each order, from its key."""
    cell = lambda i: F.floor(F.col("o_orderkey") / (3**i) + i).cast("int") % 3
    rows = F.array(*[F.array(*[cell(3 * r + c) for c in range(3)]) for r in range(3)])
    return table(spark, sf_dir, "orders").select("o_orderkey", rows.alias("board"))


_BOARD = "SELECT o_orderkey, [floor(o_orderkey / pow(3, i) + i)::INTEGER % 3 FOR i IN range(0, 9)] AS f FROM orders"


@query(f"""
WITH b AS ({_BOARD}), c AS (SELECT o_orderkey, i::INTEGER AS i, f[i + 1] AS v FROM (SELECT *, unnest(range(0, 9)) AS i FROM b))
SELECT o_orderkey, (1 << max(v))::INTEGER AS best, count(*) FILTER (v = 0) AS empty,
  count(*) FILTER (v = 0) = 0 AND NOT EXISTS (SELECT 1 FROM c x JOIN c y ON x.o_orderkey = y.o_orderkey AND x.v = y.v AND ((x.i % 3 < 2 AND y.i = x.i + 1) OR y.i = x.i + 3) WHERE x.o_orderkey = c.o_orderkey) AS over
FROM c GROUP BY o_orderkey
""")
def board_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best tile, the empty cells, and whether no move is left."""
    b = _boards(spark, sf_dir)
    cells = F.flatten("board")
    return b.select("o_orderkey", F.pow(F.lit(2), F.array_max(cells)).cast("int").alias("best"), F.size(F.filter(cells, lambda v: v == 0)).cast("long").alias("empty"), grid.is_over(F.col("board")).alias("over"))


@query("""
WITH r AS (SELECT o_orderkey, [x FOR x IN [o_orderkey % 3, o_orderkey // 3 % 3, o_orderkey // 9 % 3, o_orderkey // 27 % 3] IF x > 0] AS t FROM orders),
m AS (SELECT o_orderkey, t, len(t) AS n, t[1] = t[2] AS a, t[2] = t[3] AS b, t[3] = t[4] AS c FROM r),
k AS (SELECT *, n >= 2 AND a AS m1, n >= 3 AND b AND NOT (n >= 2 AND a) AS m2, n >= 4 AND c AND NOT (n >= 3 AND b AND NOT (n >= 2 AND a)) AS m3 FROM m),
o AS (SELECT *, list_concat(list_concat(list_concat(
   CASE WHEN n >= 1 THEN [t[1] + CASE WHEN m1 THEN 1 ELSE 0 END] ELSE [] END,
   CASE WHEN n >= 2 AND NOT m1 THEN [t[2] + CASE WHEN m2 THEN 1 ELSE 0 END] ELSE [] END),
   CASE WHEN n >= 3 AND NOT m2 THEN [t[3] + CASE WHEN m3 THEN 1 ELSE 0 END] ELSE [] END),
   CASE WHEN n >= 4 AND NOT m3 THEN [t[4]] ELSE [] END) AS cells FROM k)
SELECT o_orderkey, array_to_string(list_resize(cells, 4, 0), ',') AS cells,
  (CASE WHEN m1 THEN 1 << (t[1] + 1) ELSE 0 END + CASE WHEN m2 THEN 1 << (t[2] + 1) ELSE 0 END + CASE WHEN m3 THEN 1 << (t[3] + 1) ELSE 0 END)::INTEGER AS gain FROM o
""")
def slide_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row of four tiles slid and merged."""
    k = F.col("o_orderkey")
    row = F.array(*[(F.floor(k / d) % 3).cast("int") for d in (1, 3, 9, 27)])
    s = table(spark, sf_dir, "orders").select("o_orderkey", grid.slide(row).alias("s"))
    return s.select("o_orderkey", F.array_join(F.transform("s.cells", lambda v: v.cast("string")), ",").alias("cells"), F.col("s.gain").alias("gain"))


@query(f"""
WITH b AS ({_BOARD}) SELECT o_orderkey, array_to_string([f[7], f[4], f[1], f[8], f[5], f[2], f[9], f[6], f[3]], '') AS turned,
  array_to_string([CASE WHEN v = 0 THEN ' ' ELSE (1 << v)::VARCHAR END FOR v IN f], ',') AS labels FROM b
""")
def board_turned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter turn, and the tiles' labels."""
    b = _boards(spark, sf_dir)
    return b.select("o_orderkey", F.array_join(F.transform(F.flatten(grid.rotate(F.col("board"))), lambda v: v.cast("string")), "").alias("turned"), F.array_join(grid.labels(F.flatten("board")), ",").alias("labels"))


@query(f"""
WITH b AS ({_BOARD}), l AS (SELECT o_orderkey, unnest([
    {{'side': 'left', 'i': 1, 'c': [f[1], f[2], f[3]]}}, {{'side': 'left', 'i': 2, 'c': [f[4], f[5], f[6]]}}, {{'side': 'left', 'i': 3, 'c': [f[7], f[8], f[9]]}},
    {{'side': 'right', 'i': 1, 'c': [f[3], f[2], f[1]]}}, {{'side': 'right', 'i': 2, 'c': [f[6], f[5], f[4]]}}, {{'side': 'right', 'i': 3, 'c': [f[9], f[8], f[7]]}},
    {{'side': 'up', 'i': 1, 'c': [f[1], f[4], f[7]]}}, {{'side': 'up', 'i': 2, 'c': [f[2], f[5], f[8]]}}, {{'side': 'up', 'i': 3, 'c': [f[3], f[6], f[9]]}},
    {{'side': 'down', 'i': 1, 'c': [f[7], f[4], f[1]]}}, {{'side': 'down', 'i': 2, 'c': [f[8], f[5], f[2]]}}, {{'side': 'down', 'i': 3, 'c': [f[9], f[6], f[3]]}}]) AS l FROM b),
t AS (SELECT o_orderkey, l.side AS side, l.i AS i, [v FOR v IN l.c IF v > 0] AS t FROM l),
s AS (SELECT *, CASE WHEN len(t) >= 2 AND t[1] = t[2] THEN [t[1] + 1, coalesce(t[3], 0), 0] WHEN len(t) = 3 AND t[2] = t[3] THEN [t[1], t[2] + 1, 0] ELSE list_resize(t, 3, 0) END AS s FROM t),
g AS (SELECT o_orderkey, side, list(s ORDER BY i) AS g FROM s GROUP BY 1, 2),
w AS (SELECT o_orderkey, side, array_to_string(CASE side WHEN 'left' THEN [g[1][1], g[1][2], g[1][3], g[2][1], g[2][2], g[2][3], g[3][1], g[3][2], g[3][3]]
  WHEN 'right' THEN [g[1][3], g[1][2], g[1][1], g[2][3], g[2][2], g[2][1], g[3][3], g[3][2], g[3][1]] WHEN 'up' THEN [g[1][1], g[2][1], g[3][1], g[1][2], g[2][2], g[3][2], g[1][3], g[2][3], g[3][3]]
  ELSE [g[1][3], g[2][3], g[3][3], g[1][2], g[2][2], g[3][2], g[1][1], g[2][1], g[3][1]] END, '') AS w FROM g)
SELECT o_orderkey, max(w) FILTER (side = 'left') AS "left", max(w) FILTER (side = 'right') AS "right", max(w) FILTER (side = 'up') AS up, max(w) FILTER (side = 'down') AS down FROM w GROUP BY 1
""")
def board_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The board after a move to each side."""
    b = _boards(spark, sf_dir)
    # cell by cell, so that all of it is generated code
    text = lambda m: F.concat(*[m[r][c].cast("string") for r in range(3) for c in range(3)])
    return b.select("o_orderkey", *[text(grid.moved_by_table(F.col("board"), side, 3, 2)).alias(side) for side in ("left", "right", "up", "down")])


@query("""
SELECT p_partkey, CASE WHEN v <= 1 THEN 13089196 WHEN v = 2 THEN 15656154 WHEN v = 4 THEN 15589576 WHEN v = 8 THEN 15905145 WHEN v = 16 THEN 16094563 WHEN v = 32 THEN 16153695 WHEN v = 64 THEN 16211771 WHEN v = 128 THEN 15585138
  WHEN v = 256 THEN 15584353 WHEN v = 512 THEN 15583312 WHEN v = 1024 THEN 15582527 ELSE 15581742 END::INTEGER AS colour FROM (SELECT p_partkey, CASE WHEN p_size % 14 = 0 THEN 0 ELSE 1 << (p_size % 14 - 1) END AS v FROM part)
""")
def tile_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles' values to their colours."""
    n = (F.col("p_size") % 14).cast("int")
    value = F.when(n == 0, 0).otherwise(F.call_function("shiftleft", F.lit(1), F.greatest(n - 1, F.lit(0))))
    return table(spark, sf_dir, "part").select("p_partkey", grid.tile_colour(value).alias("colour"))


@query("""
SELECT s_suppkey, ((s_suppkey % 16 + 1) % 16)::INTEGER AS head_x, (s_suppkey % 12)::INTEGER AS head_y, 4 + CASE WHEN s_suppkey % 2 = 0 THEN 1 ELSE 0 END::INTEGER AS length,
  ((s_suppkey % 16) - 3 + CASE WHEN s_suppkey % 2 = 0 THEN 0 ELSE 1 END)::INTEGER AS tail_x FROM supplier
""")
def body_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A body after one step to the right; every second one grows."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", grid.body(F.lit(4), F.col("s_suppkey") % 16, F.col("s_suppkey") % 12).alias("b"))
    n = s.select("s_suppkey", grid.step(F.col("b"), F.lit(1), F.lit(0), 16, 12, F.col("s_suppkey") % 2 == 0).alias("b"))
    return n.select("s_suppkey", F.col("b")[0]["x"].alias("head_x"), F.col("b")[0]["y"].alias("head_y"), F.size("b").alias("length"), F.element_at("b", -1)["x"].alias("tail_x"))


@query("""
WITH c AS (SELECT s_suppkey, x::INTEGER AS x, unnest(range(0, 30))::INTEGER AS y FROM (SELECT s_suppkey, unnest(range(0, 40)) AS x FROM supplier)),
b AS (SELECT DISTINCT l_suppkey, (l_orderkey % 40)::INTEGER AS x, (l_partkey % 30)::INTEGER AS y FROM lineitem)
SELECT c.s_suppkey, c.x, c.y FROM c WHERE NOT EXISTS (SELECT 1 FROM b WHERE l_suppkey = s_suppkey AND b.x = c.x AND b.y = c.y)
""")
def free_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells of each board that nothing covers."""
    body = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("s_suppkey"), (F.col("l_orderkey") % 40).cast("int").alias("x"), (F.col("l_partkey") % 30).cast("int").alias("y"))
    return sp.free_cells(table(spark, sf_dir, "supplier"), body, "s_suppkey", 40, 30)


#: A board for each thousand keys, so that pairs grow with the tables and not with their product.
_BALLS = "SELECT c_custkey, (c_custkey // 1000 * 2000 + c_custkey * 37 % 1000)::INTEGER AS a_x0, (c_custkey * 91 % 1000)::INTEGER AS a_y0 FROM customer"
_BRICKS = "SELECT p_partkey, (p_partkey // 1000 * 2000 + p_partkey * 53 % 1000)::INTEGER AS b_x0, (p_partkey * 29 % 1000)::INTEGER AS b_y0 FROM part"


@query(f"""
WITH a AS (SELECT *, a_x0 + 6 AS a_x1, a_y0 + 6 AS a_y1 FROM ({_BALLS})), b AS (SELECT *, b_x0 + 14 AS b_x1, b_y0 + 6 AS b_y1 FROM ({_BRICKS})),
p AS (SELECT c_custkey, p_partkey, b_x0, b_y0 FROM a JOIN b ON a_x0 < b_x1 AND b_x0 < a_x1 AND a_y0 < b_y1 AND b_y0 < a_y1)
SELECT c_custkey, first.p_partkey AS p_partkey, hits FROM (SELECT c_custkey, arg_min({{'p_partkey': p_partkey}}, (b_y0, b_x0, p_partkey)) AS first, count(*) AS hits FROM p GROUP BY 1)
""")
def first_brick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each ball the first brick it overlaps, row by row, and how many it does."""
    a = table(spark, sf_dir, "customer").select("c_custkey", (F.floor(F.col("c_custkey") / 1000) * 2000 + F.col("c_custkey") * 37 % 1000).cast("int").alias("a_x0"), (F.col("c_custkey") * 91 % 1000).cast("int").alias("a_y0"))
    b = table(spark, sf_dir, "part").select("p_partkey", (F.floor(F.col("p_partkey") / 1000) * 2000 + F.col("p_partkey") * 53 % 1000).cast("int").alias("b_x0"), (F.col("p_partkey") * 29 % 1000).cast("int").alias("b_y0"))
    a = a.withColumns({"a_x1": F.col("a_x0") + 6, "a_y1": F.col("a_y0") + 6})
    b = b.withColumns({"b_x1": F.col("b_x0") + 14, "b_y1": F.col("b_y0") + 6})
    pairs = sp.overlaps(a, b, 16.0)
    hits = pairs.groupBy("c_custkey").agg(F.min_by("p_partkey", F.struct("b_y0", "b_x0", "p_partkey")).alias("p_partkey"), F.count("*").alias("hits"))
    return hits


@query("""
WITH c AS (SELECT c_custkey, (c_custkey % 20)::INTEGER AS x, (c_custkey // 20 % 10)::INTEGER AS y, c_nationkey % 4 AS v FROM customer)
SELECT c.c_custkey // 200 AS board, count(*) AS pairs FROM c JOIN c d ON d.c_custkey = c.c_custkey + 20 AND c.y < 9 AND c.v = d.v GROUP BY 1
""")
def adjacent_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal neighbours down the columns of boards."""
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").select(F.floor(k / 200).alias("board"), (k % 20).alias("x"), (F.floor(k / 20) % 10).alias("y"), (F.col("c_nationkey") % 4).alias("v"))
    w = Window.partitionBy("board", "x").orderBy("y")
    return c.withColumn("n", F.lead("v").over(w)).filter("v = n").groupBy("board").agg(F.count("*").alias("pairs"))


@query("""
WITH RECURSIVE l AS (SELECT p_partkey, (p_size % 17 - 8)::INTEGER AS x1, (p_partkey % 11 - 5)::INTEGER AS y1 FROM part),
a(k, x1, y1, step, x, y, e, u, v, f) AS (SELECT p_partkey, x1, y1, 0, 0, 0, abs(x1) - abs(y1), 0, 0, abs(x1) - abs(y1) FROM l
  UNION ALL SELECT k, x1, y1, step + 1, x + CASE WHEN 2 * e >= -abs(y1) THEN CASE WHEN x1 > 0 THEN 1 ELSE -1 END ELSE 0 END, y + CASE WHEN 2 * e <= abs(x1) THEN CASE WHEN y1 > 0 THEN 1 ELSE -1 END ELSE 0 END,
    e - CASE WHEN 2 * e >= -abs(y1) THEN abs(y1) ELSE 0 END + CASE WHEN 2 * e <= abs(x1) THEN abs(x1) ELSE 0 END,
    u + CASE WHEN 2 * f > -abs(y1) THEN CASE WHEN x1 > 0 THEN 1 ELSE -1 END ELSE 0 END, v + CASE WHEN 2 * f < abs(x1) THEN CASE WHEN y1 > 0 THEN 1 ELSE -1 END ELSE 0 END,
    f - CASE WHEN 2 * f > -abs(y1) THEN abs(y1) ELSE 0 END + CASE WHEN 2 * f < abs(x1) THEN abs(x1) ELSE 0 END FROM a WHERE step < greatest(abs(x1), abs(y1)))
SELECT k AS p_partkey, step, x, y, u AS late_x, v AS late_y FROM a
""")
def line_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells of lines from the middle, by both rules for ties."""
    x1, y1 = (F.col("p_size") % 17 - 8).cast("int"), (F.col("p_partkey") % 11 - 5).cast("int")
    both = F.arrays_zip(*[sp.line(F.lit(0), F.lit(0), x1, y1, late).alias(n) for n, late in (("a", False), ("b", True))])
    p = table(spark, sf_dir, "part").select("p_partkey", F.posexplode(both).alias("step", "c"))
    return p.select("p_partkey", "step", "c.a.x", "c.a.y", F.col("c.b.x").alias("late_x"), F.col("c.b.y").alias("late_y"))


@query("""
WITH s AS (SELECT s_suppkey, 1 + s_suppkey % 5 AS w, 1 + s_suppkey % 4 AS h FROM supplier), c AS (SELECT s_suppkey, w, h, x, unnest(range(0, h)) AS y FROM (SELECT *, unnest(range(0, w)) AS x FROM s))
SELECT s_suppkey, count(*) AS filled, count(*) FILTER (x = 0 OR y = 0 OR x = w - 1 OR y = h - 1) AS outline, sum(x + s_suppkey % 7)::BIGINT AS sum_x FROM c GROUP BY 1
""")
def rectangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("s_suppkey")
    x, w, h = (s % 7).cast("int"), (s % 5 + 1).cast("int"), (s % 4 + 1).cast("int")
    cells = sp.box_cells(x, F.lit(0), w, h)
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.size(cells).cast("long").alias("filled"), F.size(sp.box_cells(x, F.lit(0), w, h, False)).cast("long").alias("outline"), F.aggregate(cells, F.lit(0).cast("long"), lambda a, c: a + c["x"]).alias("sum_x"))


_OCTANTS = """o(k, r, x, y, d) AS (SELECT s_suppkey, (s_suppkey % 9)::INTEGER, 0, (s_suppkey % 9)::INTEGER, 1 - (s_suppkey % 9)::INTEGER FROM supplier
  UNION ALL SELECT k, r, x + 1, y - CASE WHEN d < 0 THEN 0 ELSE 1 END, d + CASE WHEN d < 0 THEN 2 * (x + 1) + 1 ELSE 2 * (x + 1 - (y - 1)) + 1 END FROM o WHERE x + 1 <= y - CASE WHEN d < 0 THEN 0 ELSE 1 END)"""


@query(f"""
WITH RECURSIVE {_OCTANTS},
p AS (SELECT k, r, x AS a, y AS b FROM o UNION ALL SELECT k, r, y, x FROM o),
rim AS (SELECT k, count(*) AS rim FROM (SELECT DISTINCT k, a * i AS u, b * j AS v FROM p, (SELECT unnest([1, -1]) AS i), (SELECT unnest([1, -1]) AS j)) GROUP BY 1),
disc AS (SELECT k, count(*) AS disc, sum(abs(u) + 3 * abs(v))::BIGINT AS spread FROM (SELECT DISTINCT k, unnest(range(-a, a + 1)) AS u, v FROM (SELECT k, a, b * j AS v FROM p, (SELECT unnest([1, -1]) AS j))) GROUP BY 1),
c AS (SELECT s_suppkey AS k, (s_suppkey % 9)::INTEGER AS r, (s_suppkey % 9 // 2)::INTEGER AS q, x, y FROM supplier, (SELECT unnest(range(-8, 9)) AS x), (SELECT unnest(range(-8, 9)) AS y)),
g AS (SELECT *, x * x + y * y AS d, CASE WHEN atan2(y, x) < 0 THEN degrees(atan2(y, x)) + 360 ELSE degrees(atan2(y, x)) END AS g FROM c),
arc AS (SELECT k, count(*) FILTER (d BETWEEN q * q AND r * r AND g BETWEEN 0 AND 100) AS quarter,
  count(*) FILTER (d <= r * r AND (d > (r - 1) * (r - 1) OR (q > 0 AND d >= q * q AND d < (q + 1) * (q + 1))) AND (g >= 300 OR g <= 20)) AS edges FROM g GROUP BY 1)
SELECT k AS s_suppkey, disc, spread, rim, quarter, edges FROM disc JOIN rim USING (k) JOIN arc USING (k)
""")
def discs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of a disc, of its outline, of a wedge of a ring, and of the edges of another."""
    r, o = (F.col("s_suppkey") % 9).cast("int"), F.lit(0)
    n = lambda cells: F.size(cells).cast("long")
    disc, half = sp.circle_cells(o, o, r), F.floor(r / 2).cast("int")
    spread = F.aggregate(disc, F.lit(0).cast("long"), lambda a, c: a + F.abs(c["x"]) + F.abs(c["y"]) * 3)
    wedge, edges = sp.arc_cells(o, o, r, half, F.lit(0.0), F.lit(100.0)), sp.arc_cells(o, o, half, r, F.lit(300.0), F.lit(20.0), False)
    return table(spark, sf_dir, "supplier").select("s_suppkey", n(disc).alias("disc"), spread.alias("spread"), n(sp.circle_cells(o, o, r, False)).alias("rim"), n(wedge).alias("quarter"), n(edges).alias("edges"))


@query(f"""
WITH RECURSIVE {_OCTANTS},
s AS (SELECT k, r, x, y, 12 + k % 5 AS w, 9 + k % 4 AS h FROM o), b AS (SELECT DISTINCT k, r, w, h FROM s),
p AS (SELECT k, r, w, h, x AS a, y AS b FROM s UNION ALL SELECT k, r, w, h, y, x FROM s),
fits AS (SELECT *, r > 0 AND 2 * r <= w AND 2 * r <= h AS fits FROM b),
f AS (SELECT k, x, y FROM fits, LATERAL (SELECT unnest(range(0, w)) AS x), LATERAL (SELECT unnest(range(0, h)) AS y) WHERE NOT fits OR (x >= r AND x < w - r) OR (y >= r AND y < h - r)
  UNION SELECT k, unnest(range(r - a, w - (r - a))) AS x, v FROM (SELECT k, r, w, a, unnest([r - b, h - 1 - r + b]) AS v FROM p WHERE r > 0 AND 2 * r <= w AND 2 * r <= h)),
e AS (SELECT k, x, y FROM fits, LATERAL (SELECT unnest(range(0, w)) AS x), LATERAL (SELECT unnest(range(0, h)) AS y) WHERE ((y = 0 OR y = h - 1) AND (NOT fits OR (x >= r AND x < w - r))) OR ((x = 0 OR x = w - 1) AND (NOT fits OR (y >= r AND y < h - r)))
  UNION SELECT k, u, unnest([r - b, h - 1 - r + b]) FROM (SELECT k, r, h, b, unnest([r - a, w - 1 - r + a]) AS u FROM p WHERE r > 0 AND 2 * r <= w AND 2 * r <= h))
SELECT k AS s_suppkey, filled, sum_xy, outline FROM (SELECT k, count(*) AS filled, sum(x + 2 * y)::BIGINT AS sum_xy FROM f GROUP BY 1) JOIN (SELECT k, count(*) AS outline FROM e GROUP BY 1) USING (k)
""")
def round_rectangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of rectangles with round corners, and of their outlines."""
    k, o = F.col("s_suppkey"), F.lit(0)
    box = (o, o, (k % 5 + 12).cast("int"), (k % 4 + 9).cast("int"), (k % 9).cast("int"))
    filled = sp.round_box_cells(*box)
    total = F.aggregate(filled, F.lit(0).cast("long"), lambda a, c: a + c["x"] + c["y"] * 2)
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.size(filled).cast("long").alias("filled"), total.alias("sum_xy"), F.size(sp.round_box_cells(*box, False)).cast("long").alias("outline"))


def _level_sql(rows: int, columns: int) -> str:
    """The levels' boards in SQL, from the same fixed rules."""
    size = {"R": str(rows), "C": str(columns), "div": "//"}
    rules = " ".join(f"WHEN level = {n} THEN {re.sub(r'\b(R|C|div)\b', lambda m: size[m.group()], rule)}" for n, rule in enumerate(grid.LEVELS, 1))
    return f"""
WITH RECURSIVE g(level, n, x) AS (SELECT s_suppkey, 0, s_suppkey * 2654435761 % 4294967296 FROM supplier UNION ALL SELECT level, n + 1, (x * 1103515245::HUGEINT + 12345)::HUGEINT % 4294967296 FROM g WHERE n < {rows * columns}),
c AS (SELECT level, n - 1 AS i, (n - 1) // {columns} AS r, (n - 1) % {columns} AS c, ((x::BIGINT >> 16) & 32767) % 100 < least(85, 50 + 2 * level) AS drawn FROM g WHERE n > 0),
k AS (SELECT *, count(*) FILTER (drawn) OVER (PARTITION BY level) AS alive, count(*) FILTER (NOT drawn) OVER (PARTITION BY level ORDER BY i) AS free FROM c)
SELECT level, count(*) FILTER (CASE WHEN level < 1 THEN false {rules} ELSE drawn OR (alive < 5 AND free <= 8 - alive) END) AS cells FROM k GROUP BY 1
"""


@query(_level_sql(6, 10))
def level_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many cells each level sets on a board of 6 x 10."""
    cells = grid.level_cells(F.col("s_suppkey"), 6, 10)
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("level"), F.size(F.filter(cells, lambda c: c)).cast("long").alias("cells"))
