"""Arithmetic texts, sequences, progress and draws over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import arithmetic
from ..functions import text as tx
from ..operators import ordered as op
from ..operators import spatial as sp
from ..streaming import fold
from .registry import query, table


@query("""
SELECT l_orderkey, l_linenumber, round(v, 6) AS value, printf('%.8g', v) AS shown, printf('%.8g', v / 3000000) AS small FROM (SELECT *, l_quantity + l_linenumber * (l_partkey - l_suppkey) / 4.0::DOUBLE AS v FROM lineitem)
""")
def calculator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts like ``17+3*(12-5)/4`` evaluated, and shown with eight digits."""
    n = lambda c: F.col(c).cast("int").cast("string")
    text = F.concat(n("l_quantity"), F.lit("+"), n("l_linenumber"), F.lit("*("), n("l_partkey"), F.lit("-"), n("l_suppkey"), F.lit(")/4"))
    v = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", arithmetic.value(text).alias("v"))
    return v.select("l_orderkey", "l_linenumber", F.round("v", 6).alias("value"), tx.eight_digits(F.col("v")).alias("shown"), tx.eight_digits(F.col("v") / 3_000_000).alias("small"))


@query("""
SELECT event_id, CASE WHEN event_id % 4 <> user_id % 4 THEN 1 WHEN event_id % 3 <> user_id % 3 THEN 2 WHEN event_id % 5 <> user_id % 5 THEN 3 ELSE 0 END AS first_miss FROM events
""")
def sequence_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where an entered sequence first differs from the shown one (0: nowhere)."""
    of = lambda c: F.array(*[F.col(c) % m for m in (4, 3, 5)])
    return table(spark, sf_dir, "events").select("event_id", F.array_position(F.zip_with(of("event_id"), of("user_id"), lambda a, b: a == b), F.lit(False)).cast("int").alias("first_miss"))


@query("""
WITH c AS (SELECT o_orderkey, bytes, i, floor(least((i + 1) * 1500, bytes) * 100 / bytes)::INTEGER AS percent FROM (SELECT *, unnest(range(0, (bytes + 1499) // 1500)) AS i FROM (SELECT o_orderkey, 1 + trunc(o_totalprice)::BIGINT AS bytes FROM orders)))
SELECT o_orderkey, i AS chunk, percent FROM (SELECT *, lag(percent) OVER (PARTITION BY o_orderkey ORDER BY i) AS before FROM c) WHERE before IS NULL OR before <> percent
""")
def push_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks of each push after which the shown percentage changes."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice").cast("long") + 1).alias("bytes"))
    c = o.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("bytes") + 1499) / 1500) - 1)).alias("chunk"))
    after = lambda chunk: F.floor(F.least((chunk + 1) * 1500, F.col("bytes")) * 100 / F.col("bytes")).cast("int")
    # the percentage before is a formula of the same row
    c = c.select("o_orderkey", "chunk", after(F.col("chunk")).alias("percent"), after(F.col("chunk") - 1).alias("before"))
    return c.filter("chunk = 0 or percent <> before").select("o_orderkey", "chunk", "percent")


@query("""
WITH RECURSIVE e AS (SELECT user_id, event_id, event_id * 7919 % 20 AS roll, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
d AS (SELECT user_id, event_id, roll AS answer, n FROM e WHERE n = 1
  UNION ALL SELECT e.user_id, e.event_id, CASE WHEN e.roll = d.answer THEN (e.roll + 1) % 20 ELSE e.roll END, e.n FROM d JOIN e ON e.user_id = d.user_id AND e.n = d.n + 1)
SELECT user_id, event_id, answer FROM d
""")
def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Draws of which none repeats the one before."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_id") * 7919 % 20).alias("roll"))

    def step(last, row):
        answer = (row.roll + 1) % 20 if row.roll == last else row.roll
        return answer, [(row.user_id, row.event_id, answer)]

    return fold.fold(e, ["user_id"], ["event_id"], step, "user_id long, event_id long, answer long")


@query("""
WITH t AS (SELECT s_suppkey AS k, list_sort([{'y': 1 + (s_suppkey % 4)::INTEGER, 'i': 0, 'x': 2}, {'y': 4 + (s_suppkey % 5)::INTEGER, 'i': 1, 'x': (s_suppkey % 7)::INTEGER}, {'y': (s_suppkey % 6)::INTEGER, 'i': 2, 'x': 6 + (s_suppkey % 8)::INTEGER}]) AS c FROM supplier),
y AS (SELECT *, unnest(range(c[1].y, c[3].y + 1)) AS y FROM t),
r AS (SELECT *, (c[1].x * 16 + trunc((c[3].x - c[1].x) * 16.0 / nullif(c[3].y - c[1].y, 0)) * (y - c[1].y))::INTEGER >> 4 AS one,
  CASE WHEN y < c[2].y OR c[2].y = c[3].y THEN (c[1].x * 16 + trunc((c[2].x - c[1].x) * 16.0 / nullif(c[2].y - c[1].y, 0)) * (y - c[1].y))::INTEGER >> 4
    ELSE (c[2].x * 16 + trunc((c[3].x - c[2].x) * 16.0 / nullif(c[3].y - c[2].y, 0)) * (y - c[2].y))::INTEGER >> 4 END AS two FROM y)
SELECT k AS s_suppkey, sum(abs(one - two) + 1)::BIGINT AS cells, sum((one + two) * (abs(one - two) + 1) // 2)::BIGINT AS sum_x FROM r GROUP BY 1
""")
def triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many cells a filled triangle has, and the sum of their columns."""
    s = F.col("s_suppkey")
    corners = (F.lit(2), s % 4 + 1, s % 7, s % 5 + 4, s % 8 + 6, s % 6)
    t = table(spark, sf_dir, "supplier").select("s_suppkey", sp.triangle_cells(*corners).alias("c"))
    return t.select("s_suppkey", F.size("c").cast("long").alias("cells"), F.aggregate("c", F.lit(0).cast("long"), lambda a, c: a + c["x"]).alias("sum_x"))


@query("""
WITH RECURSIVE t AS (SELECT s_suppkey AS k, unnest([{'n': 1, 'x': 2, 'y': 1 + (s_suppkey % 4)::INTEGER, 'x1': (s_suppkey % 7)::INTEGER, 'y1': 4 + (s_suppkey % 5)::INTEGER}, {'n': 2, 'x': (s_suppkey % 7)::INTEGER, 'y': 4 + (s_suppkey % 5)::INTEGER, 'x1': 6 + (s_suppkey % 8)::INTEGER, 'y1': (s_suppkey % 6)::INTEGER},
  {'n': 3, 'x': 6 + (s_suppkey % 8)::INTEGER, 'y': (s_suppkey % 6)::INTEGER, 'x1': 2, 'y1': 1 + (s_suppkey % 4)::INTEGER}]) AS s FROM supplier),
a(k, n, x, y, x1, y1, dx, dy, e) AS (SELECT k, s.n, s.x, s.y, s.x1, s.y1, abs(s.x1 - s.x), abs(s.y1 - s.y), abs(s.x1 - s.x) - abs(s.y1 - s.y) FROM t
  UNION ALL SELECT k, n, x + CASE WHEN 2 * e >= -dy THEN CASE WHEN x1 > x THEN 1 ELSE -1 END ELSE 0 END, y + CASE WHEN 2 * e <= dx THEN CASE WHEN y1 > y THEN 1 ELSE -1 END ELSE 0 END, x1, y1, dx, dy,
    e - CASE WHEN 2 * e >= -dy THEN dy ELSE 0 END + CASE WHEN 2 * e <= dx THEN dx ELSE 0 END FROM a WHERE x <> x1 OR y <> y1)
SELECT k AS s_suppkey, count(*) AS cells, sum(x + 2 * y)::BIGINT AS sum_xy FROM (SELECT DISTINCT k, x, y FROM a) GROUP BY 1
""")
def triangle_rims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outlines of the same triangles."""
    s = F.col("s_suppkey")
    corners = (F.lit(2), s % 4 + 1, s % 7, s % 5 + 4, s % 8 + 6, s % 6)
    t = table(spark, sf_dir, "supplier").select("s_suppkey", sp.triangle_rim(*corners).alias("c"))
    return t.select("s_suppkey", F.size("c").cast("long").alias("cells"), F.aggregate("c", F.lit(0).cast("long"), lambda a, c: a + c["x"] + c["y"] * 2).alias("sum_xy"))


@query("""
SELECT p_partkey // 8 AS x, p_partkey AS y, coalesce(lag(p_size, 2) OVER (PARTITION BY p_partkey // 8 ORDER BY p_partkey), -1)::INTEGER AS px FROM part
""")
def shifted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pixels of each column moved down by two, the gap filled."""
    w = Window.partitionBy("x").orderBy("y")
    return table(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / 8).alias("x"), F.col("p_partkey").alias("y"), "p_size").select("x", "y", F.lag("p_size", 2, -1).over(w).alias("px"))


@query("""
SELECT event_id, CASE WHEN length(w) <= 8 THEN w ELSE left(w, 7) || '…' END AS short, regexp_matches(w, '(click|view)') AS fits, event_type IN ('click', 'view') AS known FROM (SELECT *, event_type || ' ' || user_id AS w FROM events)
""")
def name_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shortened names and two kinds of filters."""
    w = F.concat_ws(" ", "event_type", F.col("user_id").cast("string"))
    return table(spark, sf_dir, "events").select("event_id", F.when(F.length(w) <= 8, w).otherwise(F.concat(F.substring(w, 1, 7), F.lit("…"))).alias("short"), w.rlike("(click|view)").alias("fits"), F.col("event_type").isin("click", "view").alias("known"))


@query("""
SELECT p_partkey, list_contains(string_split(platforms, ','), 'board2') AS runs_on_2, list_contains(string_split(platforms, ','), ' board2') AS with_blank FROM (SELECT p_partkey, 'board1,' || CASE WHEN p_size % 2 = 0 THEN ' ' ELSE '' END || 'board2' AS platforms FROM part)
""")
def platform_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a list of platforms has one, its parts being compared as they stand."""
    text = F.concat(F.lit("board1,"), F.when(F.col("p_size") % 2 == 0, " ").otherwise(""), F.lit("board2"))
    parts = tx.split_list(text, trimmed=False)
    return table(spark, sf_dir, "part").select("p_partkey", F.array_contains(parts, "board2").alias("runs_on_2"), F.array_contains(parts, " board2").alias("with_blank"))


@query("""
SELECT l_suppkey, idx::INTEGER AS idx, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity) - 1 AS idx FROM lineitem) WHERE idx < 64
""")
def note_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 64 notes of each sequence (its buffer's size)."""
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return op.reindexed(li, ["l_suppkey"], ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity"], most=64).select("l_suppkey", "idx", "l_orderkey", "l_linenumber")
