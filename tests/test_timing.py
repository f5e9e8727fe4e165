"""Turns, timers, motion and queues against plain loops; batch against stream."""

import random
from collections import namedtuple

import pytest
from pyspark.sql import functions as F

from loomwork.functions.motion import bounced
from loomwork.operators import intervals as iv
from loomwork.operators import spatial as sp
from loomwork.operators.matching import first_come
from loomwork.streaming.timed import Reaction, fold_timed


def one_by_one(pairs):
    """(taker, turn, giver, choice, capacity) rows, taken in turns."""
    used, out = {}, {}
    for taker in sorted({(p[1], p[0]) for p in pairs}):
        for _, _, giver, _, capacity in sorted((p for p in pairs if p[0] == taker[1]), key=lambda p: p[3]):
            if capacity is None or used.get(giver, 0) < capacity:
                used[giver] = used.get(giver, 0) + 1
                out[taker[1]] = (giver, used[giver] if capacity is not None else None)
                break
    return out


@pytest.mark.parametrize("seed", range(3))
def test_first_come_equals_going_one_by_one(spark, seed):
    rng = random.Random(seed)
    room = {g: rng.choice([1, 1, 2, 3, None]) for g in range(15)}
    turns = rng.sample(range(1000), 60)
    pairs = [(t, turns[t], g, k, room[g]) for t in range(60) for k, g in enumerate(rng.sample(range(15), rng.randrange(1, 5)))]
    df = spark.createDataFrame(pairs, "taker long, turn long, giver long, k int, room int")
    got = {r.taker: (r.giver, r.nth) for r in first_come(df, "taker", "turn", "giver", ["k"], "room").collect()}
    assert got == one_by_one(pairs)


def test_takers_who_push_each_other_on(spark):
    """Each prefers the giver that the next one would have had."""
    pairs = [(t, t, g, k, 1) for t in range(12) for k, g in enumerate(([0] if t == 0 else [t - 1, t]))]
    df = spark.createDataFrame(pairs, "taker long, turn long, giver long, k int, room int")
    assert {r.taker: r.giver for r in first_come(df, "taker", "turn", "giver", ["k"], "room").collect()} == {t: t for t in range(12)}
    none = spark.createDataFrame([], "taker long, turn long, giver long, k int, room int")
    assert first_come(none, "taker", "turn", "giver", ["k"], "room").count() == 0


def test_crowded_cells_are_dealt_to_parts(spark):
    rng = random.Random(1)
    box = lambda i: (i, *(x := (rng.randrange(20), rng.randrange(20))), x[0] + 5, x[1] + 5)
    a = spark.createDataFrame([box(i) for i in range(80)], "a long, a_x0 int, a_y0 int, a_x1 int, a_y1 int")
    b = spark.createDataFrame([box(i) for i in range(40)], "b long, b_x0 int, b_y0 int, b_x1 int, b_y1 int")
    want = {(x.a, y.b) for x in a.collect() for y in b.collect() if x.a_x0 < y.b_x1 and y.b_x0 < x.a_x1 and x.a_y0 < y.b_y1 and y.b_y0 < x.a_y1}
    for crowd in (7, 100_000):
        rows = sp.overlaps(a, b, 10.0, crowd).select("a", "b").collect()
        assert len(rows) == len(want) and {tuple(r) for r in rows} == want


def events(rng, n):
    rows = sorted((rng.randrange(60_000), u) for u in (1, 2, 3) for _ in range(n))
    return [(u, i, at, rng.random() < 0.5) for i, (at, u) in enumerate(rows)]


EVENTS = "user long, id long, at long, shown boolean"


def test_reactions_equal_a_loop(spark):
    rows = events(random.Random(4), 60)
    machine, want, open_targets = Reaction("user", "id", 3000), [], {}
    row_of = namedtuple("Row", ["user", "id", "at", "shown"])
    for r in map(row_of._make, rows):
        open_targets[r.user], out = machine.step(open_targets.get(r.user), r)
        want += out
    want += [x for s in open_targets.values() if s is not None for x in machine.fire(s)[1]]
    got = iv.reactions(spark.createDataFrame(rows, EVENTS), "user", "id", ["at", "id"], F.col("shown"), ~F.col("shown"), F.col("at"), 3000)
    assert sorted(map(str, ((r.user, r.id, r.target, r.outcome, r.ms) for r in got.collect()))) == sorted(map(str, want))
    assert {r.outcome for r in got.collect()} == {"hit", "early", "replaced", "too slow"}
    # every target has one end
    ends = [r.target for r in got.collect() if r.outcome != "early"]
    assert sorted(ends) == [r[1] for r in rows if r[3]]


def stream_of(spark, tmp_path, rows, schema, parts):
    """The rows as a stream, ``parts`` of them file by file."""
    where = str(tmp_path / "in")
    for k in range(parts):
        part = rows[len(rows) * k // parts : len(rows) * (k + 1) // parts]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(where)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(where)


def run_stream(df, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name).collect()


def test_timers_of_a_stream_equal_the_batch(spark, tmp_path):
    """Time-outs come without a row of their key, once the other keys' rows have moved the time on."""
    rows = events(random.Random(5), 40)
    want = iv.reactions(spark.createDataFrame(rows, EVENTS), "user", "id", ["at", "id"], F.col("shown"), ~F.col("shown"), F.col("at"), 3000)
    s = stream_of(spark, tmp_path, [*rows, (9, 10_000, 900_000, False), (9, 10_001, 900_001, False)], EVENTS, 6).withColumn("ts", F.timestamp_millis("at"))
    got = run_stream(fold_timed(s, ["user"], ["at", "id"], Reaction("user", "id", 3000), "user long, id long, target long, outcome string, ms long", "ts", "0 seconds"), "reactions")
    key = lambda r: str((r.user, r.id, r.target, r.outcome, r.ms))
    assert sorted(key(r) for r in got if r.user != 9) == sorted(key(r) for r in want.collect())


def test_bursts_of_a_stream(spark, tmp_path):
    """Rows that are late but not too late join their burst."""
    at = [(1, 0), (1, 20), (1, 100), (2, 5), (1, 40), (1, 130), (2, 300), (1, 1000), (2, 1001)]
    df = spark.createDataFrame(at, "user long, s long")
    timed = lambda d: d.withColumn("ts", F.timestamp_seconds("s"))
    want = {(1, 0, 3), (1, 100, 2), (2, 5, 1), (2, 300, 1), (1, 1000, 1), (2, 1001, 1)}
    rows = lambda d: {(r.user, int(r.first.timestamp()), r.requests) for r in d}
    assert rows(iv.bursts(timed(df), "user", "ts", "50 seconds").collect()) == want
    s = stream_of(spark, tmp_path, at, "user long, s long", 5)
    got = rows(run_stream(iv.bursts(timed(s), "user", "ts", "50 seconds", late="120 seconds"), "bursts"))
    # the last bursts stay open
    assert got == {w for w in want if w[1] < 800}


def test_bounced_equals_a_loop(spark):
    rng = random.Random(2)
    rows = [(i, rng.randrange(0, 31), rng.choice([-1, 1]) * rng.randrange(0, 40), rng.randrange(0, 60)) for i in range(300)]
    df = spark.createDataFrame(rows, "i long, x long, v long, t long")
    got = {r.i: r.at for r in df.select("i", bounced(F.col("x"), F.col("v"), F.lit(30), F.col("t")).alias("at")).collect()}
    for i, x, v, t in rows:
        for _ in range(t):
            x += v
            if v and x <= 0:
                x, v = 0, abs(v)
            elif v and x >= 30:
                x, v = 30, -abs(v)
        assert got[i] == x


def test_intervals_and_sweep(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), rng.choice(["p", "q"]), s, s + rng.randrange(1, 9)) for s in (rng.randrange(100) for _ in range(60))]
    u = iv.union_of(spark.createDataFrame(rows, "k string, kind string, s long, e long"), ["k", "kind"], "s", "e")
    assert sum(r.n for r in u.collect()) == len(rows)
    sweep = iv.active(u, "k", "kind", ["p", "q"], "s", "e").collect()
    for k in "ab":
        for t in range(120):
            want = ",".join(x for x in ("p", "q") if any(r[0] == k and r[1] == x and r[2] <= t < r[3] for r in rows))
            assert [r.active for r in sweep if r.k == k and r["from"] <= t < r.to] == ([want] if want else [])


def test_elapsed_steps_keep_the_rest(spark):
    rng = random.Random(6)
    now, rows = 4294960000, []
    for i in range(50):
        rows.append((1, i, now % (1 << 32)))
        now += rng.randrange(2500)
    df = spark.createDataFrame(rows, "k long, i long, at long")
    got = iv.whole_steps(df, "k", ["i"], "at", 1000).orderBy("i").collect()
    last, total = rows[0][2], 0
    for r in got:
        passed = (r.at - last) % (1 << 32) // 1000
        last = (last + passed * 1000) % (1 << 32)
        total += passed
        assert r.steps == passed and r.rest == (r.at - last) % (1 << 32)
    assert total == sum(r.steps for r in got) == (rows[-1][2] - rows[0][2]) % (1 << 32) // 1000


def test_queue_limit_is_below_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("q"), "id")
    plan = iv.admitted(df, ["q"], ["id"], 8)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and plan.index("WindowGroupLimit") < plan.rindex("Exchange")
    rows = iv.drained(df, ["q"], ["id"], 8, F.col("id") == 9).collect()
    assert {(r.q, r.sent, r.taken, r.dropped, r.played) for r in rows} == {(0, 34, 8, 26, 4), (1, 33, 8, 25, 8), (2, 33, 8, 25, 8)}
