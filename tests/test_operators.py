"""Operators against plain loops, and their edge cases."""

import math
import random

from pyspark.sql import functions as F

from loomwork.functions import audio, bits, colour, grid
from loomwork.functions import text as tx
from loomwork.operators import ordered as op
from loomwork.operators import spatial as sp
from loomwork.streaming import fold, machines


def slid(row):
    out, locked, gain = [], False, 0
    for v in row:
        if v and out and out[-1] == v and not locked:
            out[-1] += 1
            gain += 2 ** out[-1]
            locked = True
        elif v:
            out.append(v)
            locked = False
    out += [0] * (len(row) - len(out))
    return out, gain, out != row


def test_slide(spark):
    rng = random.Random(1)
    rows = [([1, 0, 1, 2],), ([1, 1, 1, 1],), ([1, 2, 0, 0],), ([0, 0, 0, 3],), ([0, 0, 0, 0],)] + [([rng.randrange(4) for _ in range(4)],) for _ in range(60)]
    df = spark.createDataFrame(rows, "r array<int>").select("r", grid.slide(F.col("r")).alias("s"))
    for r in df.collect():
        assert (r.s.cells, r.s.gain, r.s.moved) == slid(r.r)


def test_moves(spark):
    rng = random.Random(2)
    boards = [([[rng.randrange(3) for _ in range(3)] for _ in range(3)],) for _ in range(20)]
    df = spark.createDataFrame(boards, "b array<array<int>>").select("b", *[grid.moved(F.col("b"), q).alias(q) for q in ("left", "right", "up", "down")], grid.is_over(F.col("b")).alias("over"))
    for r in df.collect():
        left = [slid(x)[0] for x in r.b]
        right = [slid(x[::-1])[0][::-1] for x in r.b]
        columns = list(zip(*r.b, strict=True))
        up = [list(x) for x in zip(*[slid(list(c))[0] for c in columns], strict=True)]
        down = [list(x) for x in zip(*[slid(list(c)[::-1])[0][::-1] for c in columns], strict=True)]
        assert (r.left, r.right, r.up, r.down) == (left, right, up, down)
        assert r.over == (all(all(x) for x in r.b) and all(m == r.b for m in (left, right, up, down)))


def test_overlaps_find_each_pair_once(spark):
    rng = random.Random(3)
    box = lambda i: (i, (x := rng.randrange(100)), (y := rng.randrange(100)), x + rng.randrange(1, 20), y + rng.randrange(1, 20))
    a, b = [box(i) for i in range(60)], [box(i) for i in range(60)]
    da = spark.createDataFrame(a, "ia int, a_x0 int, a_y0 int, a_x1 int, a_y1 int")
    db = spark.createDataFrame(b, "ib int, b_x0 int, b_y0 int, b_x1 int, b_y1 int")
    got = sorted((r.ia, r.ib) for r in sp.overlaps(da, db, 8.0).collect())
    assert got == sorted((x[0], y[0]) for x in a for y in b if x[1] < y[3] and y[1] < x[3] and x[2] < y[4] and y[2] < x[4])


def test_line_reaches_both_ends(spark):
    ends = [(0, 0, 3, 1), (0, 0, 0, 0), (5, 5, 1, 2), (2, -3, 2, 4)]
    df = spark.createDataFrame(ends, "a int, b int, c int, d int")
    for r in df.select("*", sp.line(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("l")).collect():
        assert (r.l[0].x, r.l[0].y, r.l[-1].x, r.l[-1].y) == (r.a, r.b, r.c, r.d)
        assert len(r.l) == max(abs(r.c - r.a), abs(r.d - r.b)) + 1
        assert all(max(abs(p.x - q.x), abs(p.y - q.y)) == 1 for p, q in zip(r.l, r.l[1:], strict=False))


def test_paths(spark):
    rows = [("OEBPS", "Text/c1.xhtml", "OEBPS/Text/c1.xhtml"), ("OEBPS/a", "../Text/c1.xhtml", "OEBPS/Text/c1.xhtml"), ("a", "../../b", "b"), ("a", "/x/../y", "/x/../y"), ("", "./b//c", "b/c")]
    df = spark.createDataFrame(rows, "b string, h string, want string").select(tx.resolved(F.col("b"), F.col("h")).alias("got"), "want")
    assert all(r.got == r.want for r in df.collect())


def test_bits_and_colours(spark):
    one = spark.range(1)
    r = one.select(colour.to_565(F.lit(255), F.lit(128), F.lit(64)).alias("c"), bits.lcg(F.lit(7), 1103515245, 12345, F.lit(3)).alias("g"), bits.little_endian_signed(F.lit(255), F.lit(255)).alias("s"), bits.pack_bytes(F.lit(0x123456), 3).alias("p"), bits.xor_of(F.array(F.lit(1), F.lit(2), F.lit(4))).alias("x")).first()
    x = 7
    for _ in range(3):
        x = (x * 1103515245 + 12345) % 2**32
    assert (r.c, r.g, r.s, r.p, r.x) == (64520, x, -1, [0x12, 0x34, 0x56], 7)
    n = one.select(audio.note_to_hz(F.lit(69)).alias("a"), audio.note_to_hz(F.lit(0)).alias("z")).first()
    assert (n.a, n.z) == (440.0, 0.0)


def test_sound_rules(spark):
    """Vectors worked out by hand from the rules: gate, limiter, normaliser, shapes."""
    rows = [(0.95, 3), (1.5, 1), (1.5, 3), (-3.0, 2), (0.5, 4)]
    got = spark.createDataFrame(rows, "x double, n int").select(audio.gate(F.col("x"), F.col("n")).alias("g")).collect()
    want = [0.95, 1.5, 1.5 * (1 - 0.55 / 1.75), -3.0 * 0.3, 0.5]
    assert all(abs(r.g - w) < 1e-12 for r, w in zip(got, want, strict=True))
    got = spark.createDataFrame([(0.96,), (0.98,), (2.0,), (-5.0,), (0.97,)], "x double").select(audio.limit(F.col("x")).alias("l")).collect()
    assert all(abs(r.l - w) < 1e-12 for r, w in zip(got, [0.96, 0.98, 0.98, -0.98, 0.96 + 0.02 * math.tanh(0.5)], strict=True))
    state = None
    for _ in range(16):
        state = audio.gain_step(state, 0.01)
    assert state[1:] == (1.0, 16)  # silence
    for _ in range(16):
        state = audio.gain_step(state, 0.9)
    assert state[1] == 1.5
    for _ in range(16_000):
        state = audio.gain_step(state, 0.9)
    assert state[1] == 0.5
    e = spark.range(1, 9).select(F.col("id").alias("t"), *[audio.effect_envelope(F.lit(k), F.col("id"), F.lit(5), F.lit(4), F.lit(2)).alias(k) for k in ("punch", "flare", "swell", "twang", "decay")]).collect()
    assert [r.punch for r in e] == [1.5, 1.5, 1.25, 1, 1, 1, 0, 0]
    assert [r.flare for r in e] == [1 / 16, 0.25, 9 / 16, 1.0, 0.5, 0.0, 0.0, 0.0]
    assert [r.swell for r in e] == [0, 0.2, 0.4, 0.6, 0.8, 1.0, 0, 0]
    assert abs(e[2].twang - 0.992**3) < 1e-12 and [round(r.decay, 6) for r in e] == [1, 0.8, 0.6, 0.4, 0.2, 0, 0, 0]


def test_eight_digits(spark):
    xs = [0.0, 1.0, -2.5, 100.0, 12345678.0, 123456789.0, 1e-4, 1.5e-5, 1 / 3, -2e10 / 3, 99999999.6, 0.1 + 0.2, 120.0, 1e300, None]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", tx.eight_digits(F.col("x")).alias("t")).collect()
    assert [r.t for r in got] == [None if x is None else f"{x:.8g}" for x in xs]


def test_levels(spark):
    """Levels after the twelfth against a loop over their generator."""

    def drawn(level):
        x, out = level * 2654435761 % 2**32, []
        for _ in range(60):
            x = (x * 1103515245 + 12345) % 2**32
            out.append((x >> 16 & 0x7FFF) % 100 < min(85, 50 + 2 * level))
        return out

    df = spark.createDataFrame([(k,) for k in (1, 12, 13, 14, 40)], "k long").select("k", grid.level_cells(F.col("k"), 6, 10).alias("c"))
    got = {r.k: r.c for r in df.collect()}
    assert all(got[1]) and sum(got[12]) == 10 + 2 * 5
    assert all(got[k] == drawn(k) for k in (13, 14, 40))


def test_ordered_on_empty_and_null_keys(spark):
    e = spark.createDataFrame([], "k int, t int, v int")
    for out in (op.last_wins(e, ["k"], F.col("t"), ["v"]), op.changes(e, ["k"], ["t"], "v"), op.records(e, ["k"], ["t"], "v"), op.start_offsets(e, ["k"], ["t"], "v"), op.last_n(e, ["k"], [F.desc("t")], 2)):
        assert out.count() == 0
    d = spark.createDataFrame([(None, 1, 5), (None, 2, 5), (1, 1, None), (1, 2, 3)], "k int, t int, v int")
    assert {(r.k, r.t) for r in op.changes(d, ["k"], ["t"], "v").collect()} == {(None, 1), (1, 1), (1, 2)}
    assert {(r.k, r.v) for r in op.last_wins(d, ["k"], F.col("t"), ["v"]).collect()} == {(None, 5), (1, 3)}


def test_page_is_clamped(spark):
    d = spark.range(10)
    ids = lambda n: [r.id for r in op.page(d, [F.col("id")], n, 4, 10).collect()]
    assert (ids(0), ids(2), ids(9), ids(-3)) == ([0, 1, 2, 3], [8, 9], [8, 9], [0, 1, 2, 3])
    assert op.page(d.limit(0), [F.col("id")], 3, 4, 0).count() == 0


def test_fold_equals_loop(spark):
    """Null keys are one sequence, large integers stay as they are beside nulls."""
    rng = random.Random(5)
    keys = [1, 2, None, 9007199254740993]
    rows = [(k, t, rng.choice([None, 9007199254740993, 2, 3])) for k in keys for t in range(40)]
    df = spark.createDataFrame(rows, "key long, t long, v long").repartition(5)

    def step(state, row):
        state = (state or 0) + (row.v or 0)
        return state, [(row.key, row.t, state)]

    got = {(r.key, r.t): r.total for r in fold.fold(df, ["key"], ["t"], step, "key long, t long, total long").collect()}
    want = {}
    for k in keys:
        total = 0
        for key, t, v in rows:
            if key == k:
                total += v or 0
                want[(k, t)] = total
    assert got == want
    assert fold.fold(df.limit(0), ["key"], ["t"], step, "key long, t long, total long").count() == 0


def test_frames_and_cooldown():
    from types import SimpleNamespace

    def run(step, rows):
        state, out = None, []
        for r in rows:
            state, got = step(state, SimpleNamespace(**r))
            out += got
        return out

    def key(code, at, down=1):
        return [{"key": 1, "at": at, "byte": b} for b in (0xAA, 3, code, down, (3 + code + down) & 255)]

    press = machines.frames()
    rows = key(0x80, 0) + key(7, 500) + key(8, 600) + [{"key": 1, "at": 601, "byte": 0xAA}] + key(9, 700, 0) + key(0x80, 1000) + key(0x80, 1200) + key(5, 2000) + key(6, 2100)
    assert run(press, rows) == [(1, 500, 7, True), (1, 600, 8, False), (1, 2000, 5, True), (1, 2100, 6, True)]
    taps = [{"key": 1, "at": t} for t in (0, 2999, 3000, 5000, 6000)]
    assert run(machines.cooldown(3000), taps) == [(1, 0), (1, 3000), (1, 6000)]


def test_calculator(spark):
    from loomwork.functions import arithmetic

    cases = {"2+3*4": 14, "(1+2)*3": 9, "7-2-1": 4, "8/0": 0, "1+8/0": 0, "-5": 0, "(2": 2, "3)": None, "": 0, None: None, ".5+1": 6, "2*(3+4)*5-6/3": 68, "1.5*2": 3}
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    assert {r.t: r.v for r in df.select("t", arithmetic.value(F.col("t")).alias("v")).collect()} == cases


def test_eight_digits_of_ties(spark):
    """Exact halves go to the even digit; numbers that only look like halves do not."""
    x = [1234567.25, 1234567.75, 1234568.25, -1234567.25, 12345678.5, 12345679.5, 0.123456785, 1.23456785, 1.23456775, 1e15, -0.0, 0.0, 100.0, 0.00001, float("inf"), None]
    df = spark.createDataFrame([(v,) for v in x], "x double").select("x", tx.eight_digits(F.col("x")).alias("t"))
    assert [r.t for r in df.collect()] == [None if v is None else "%.8g" % (v or 0.0) for v in x]


def test_shift_register_with_wide_seeds(spark):
    def loop(x, taps, width, steps):
        for _ in range(steps):
            bit = 0
            for t in taps:
                bit ^= x >> t & 1
            x = x >> 1 | bit << (width - 1)
        return x

    seeds = [0, 1, 32767, 32769, 40001, 65535, 65537, (1 << 62) + 12345]
    for taps, width in (audio.NOISE, audio.RETRO_NOISE):
        df = spark.createDataFrame([(s,) for s in seeds], "s long").select("s", bits.shift_register(F.col("s"), taps, width, F.lit(20)).alias("x"))
        assert {r.s: r.x for r in df.collect()} == {s: loop(s, taps, width, 20) for s in seeds}


def test_envelope_and_small_columns(spark):
    at = spark.range(0, 140).select(F.col("id").alias("t"), audio.envelope(F.col("id"), F.lit(100), F.lit(10), F.lit(20), F.lit(0.5), F.lit(25)).alias("g"))
    g = {r.t: r.g for r in at.collect()}
    assert (g[0], g[5], g[10], g[20], g[30], g[50], g[101]) == (0.0, 0.5, 1.0, 0.75, 0.5, 0.5, 0.5)
    assert abs(g[106] - 0.5 * 20 / 25) < 1e-12 and (g[126], g[139]) == (0.0, 0.0)
    r = spark.range(1).select(
        tx.split_list(F.lit("a, b"), trimmed=False).alias("raw"), tx.split_list(F.lit("a, b,,")).alias("cut"), tx.hex_words(F.array(F.lit(1), F.lit(255), F.lit(4096)), 2).alias("hex"),
        tx.first_part(F.lit("/data/x/y"), "/sdcard").alias("root"), tx.first_part(F.lit("x"), "/sdcard").alias("none"), bits.bits_set(F.lit(0b1011), 12).alias("n"), tx.plural(F.lit(1), "item", "items", "none").alias("one"),
    ).first()
    assert (r.raw, r.cut, r.hex, r.root, r.none, r.n, r.one) == (["a", " b"], ["a", "b"], "0x0001, 0x00FF,\n0x1000", "/data", "/sdcard", 3, "1 item")


def test_ticks(spark):
    df = spark.sql("select timestamp_seconds(id * 10) as ts from range(9)")
    assert sorted(r.n for r in fold.ticks(df, 30).collect()) == [3, 3, 3]
