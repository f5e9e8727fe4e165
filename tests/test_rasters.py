"""Text, sheets, boards by table, crawling bodies and numbered lists against plain loops."""

import random
from collections import namedtuple

from pyspark.sql import functions as F

from loomwork.functions import grid
from loomwork.operators import ordered as op
from loomwork.operators import rasters
from loomwork.sinks import files
from loomwork.sources import lines
from loomwork.streaming import machines


def test_text_is_clipped_like_pixels(spark):
    glyphs = [(ord("A"), j, b) for j, b in enumerate((0b1111110, 0b10001, 0b10001, 0b1111110, 0))] + [(ord("i"), 2, 0b1111101)]
    rows = [(1, "AiA?A", 0, 0, 1), (2, "AAAA", 30, -3, 2), (3, "", 0, 0, 1), (4, None, 0, 0, 1), (5, "A", 38, 0, 1), (6, "A", -2, 14, 1)]
    df = spark.createDataFrame(rows, "k int, t string, x int, y int, s int")
    g = spark.createDataFrame(glyphs, "code int, column int, bits int")
    want = set()
    for k, t, x, y, s in rows:
        for i, c in enumerate(t or ""):
            left = x + i * 6 * s
            if left + 6 * s > 60:
                break
            for code, j, bits in glyphs:
                for b in range(8):
                    if code == ord(c) and bits >> b & 1:
                        want |= {(k, left + j * s + dx, y + b * s + dy) for dx in range(s) for dy in range(s)}
    want = {w for w in want if 0 <= w[1] < 60 and 0 <= w[2] < 16}
    for bound in (100, 1):
        rasters.MAX_GLYPH_ROWS = bound
        got = rasters.text_cells(df, "k", "t", F.col("x"), F.col("y"), F.col("s"), g, 60, 16).collect()
        assert len(got) == len(want) and {tuple(r) for r in got} == want
    rasters.MAX_GLYPH_ROWS = 100_000


def test_sheets_are_read_back(spark, tmp_path):
    rng = random.Random(0)
    frames = {(k, i): [rng.randrange(65536) for _ in range(6)] for k in (1, 2) for i in range(k + 1)}
    df = spark.createDataFrame([(k, i, p) for (k, i), p in frames.items()], "k int, i int, p array<int>").repartition(4)
    sheet = rasters.sheets(df, "k", "i", "p", 3, 2)
    assert {(r.k, r.y): r.pixels for r in sheet.collect()} == {(k, y): [v for i in range(k + 1) for v in frames[k, i][y * 3 : y * 3 + 3]] for k in (1, 2) for y in (0, 1)}
    files.write_rasters(sheet, str(tmp_path / "out"), "k", 3, 2)
    for k in (1, 2):
        got = [r.line for r in lines.read_lines(spark, str(tmp_path / "out" / f"k={k}")).orderBy("line_no").collect()]
        assert got[0] == f"P3 {3 * (k + 1)} 2 255"
        dots = [int(x) for line in got[1:] for x in line.split()]
        back = [(r >> 3) << 11 | (g >> 2) << 5 | b >> 3 for r, g, b in zip(dots[::3], dots[1::3], dots[2::3], strict=True)]
        assert back == [v for y in (0, 1) for i in range(k + 1) for v in frames[k, i][y * 3 : y * 3 + 3]]


def test_boards_by_table_equal_folds(spark):
    rng = random.Random(1)
    rows = [(i, [[rng.choice([0, 0, 1, 1, 2, 3]) for _ in range(4)] for _ in range(4)]) for i in range(200)]
    df = spark.createDataFrame(rows, "i int, b array<array<int>>")
    for side in ("left", "right", "up", "down"):
        r = df.select(grid.moved(F.col("b"), side).alias("x"), grid.moved_by_table(F.col("b"), side, 4, 3).alias("y")).collect()
        assert all(a.x == a.y for a in r)


def test_drawn_places(spark):
    df = spark.createDataFrame([([[0, 1], [0, 0]], k) for k in range(7)] + [([[1, 2], [3, 4]], 5)], "b array<array<int>>, d long")
    got = [r.c for r in df.select(grid.draw_place(F.col("b"), F.col("d"), F.lit(9)).alias("c")).collect()]
    assert got == [[[9, 1, 0, 0], [0, 1, 9, 0], [0, 1, 0, 9]][k % 3] for k in range(7)] + [[1, 2, 3, 4]]


def test_crawler_dies_and_wraps():
    move = namedtuple("Move", ["key", "move_id", "move", "grows"])

    def run(moves, walls, grows=False):
        step, state, out = machines.crawler("key", 6, 5, (3, 2), 3, walls), None, []
        for i, m in enumerate(moves):
            state, rows = step(state, move(1, i, m, grows))
            out += rows
        return [r[2:] for r in out]

    assert run([3, 3, 3], True) == [(4, 2, 3, True), (5, 2, 3, True), (5, 2, 3, False)]
    assert run([3, 3, 3], False)[-1] == (0, 2, 3, True)
    # straight back is going on; a square of four cells chases its tail, of five it does not
    assert run([2], True) == [(4, 2, 3, True)]
    assert run([3, 1, 2, 0], True)[-1] == (3, 2, 3, True)
    assert run([3, 1, 2, 0], True, grows=True)[-1] == (3, 3, 6, False)


def test_numbered_equals_reindexed(spark):
    rng = random.Random(2)
    rows = [(rng.choice([1, 1, 1, 2, None]), rng.randrange(1000), i) for i in range(500)]
    df = spark.createDataFrame(rows, "k int, a int, i int").repartition(8)
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {(r.k, r.i): r.idx for r in op.numbered(df, "k", ["a", "i"]).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    assert got == {(r.k, r.i): r.idx for r in op.reindexed(df, ["k"], ["a", "i"]).collect()}


def test_caps_are_below_the_shuffle(spark):
    df = spark.range(10).select((F.col("id") % 2).alias("k"), "id")
    assert "WindowGroupLimit" in op.reindexed(df, ["k"], ["id"], most=3)._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.idx for r in op.reindexed(df, ["k"], ["id"], most=3).collect()) == [0, 0, 1, 1, 2, 2]
