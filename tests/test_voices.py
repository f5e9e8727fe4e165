"""Rendered sound against a loop over samples."""

import math

import pytest

from loomwork.operators import voices

NOTES = "seq long, note long, start long, length long, freq double, sweep double, vib_rate double, vib_depth double, wave string, attack long, release long, volume double"
ROWS = [
    (1, 0, 0, 900, 440.0, 0.0, 0.0, 0.0, "sine", 50, 100, 0.9), (1, 1, 300, 700, 220.0, 24.0, 6.0, 0.5, "saw", 0, 0, 0.8), (1, 2, 310, 5, 3000.0, 0.0, 0.0, 0.0, "square", 2, 2, 1.0),
    (2, 3, 10, 333, 100.0, -30.0, 9.0, 1.0, "triangle", 7, 0, 0.7), (2, 4, 10, 0, 100.0, 0.0, 0.0, 0.0, "sine", 0, 0, 1.0),
]


def loop(rows):
    """Sample by sample, as a device has it."""
    sums = {}
    for seq, _, start, length, freq, sweep, rate, depth, wave, attack, release, volume in rows:
        phase = 0
        for i in range(length):
            p = phase / voices.TURN
            s = {"square": 1.0 if p < 0.5 else -1.0, "saw": p * 2 - 1, "triangle": p * 4 - 1 if p < 0.5 else 3 - p * 4, "sine": math.sin(p * 2 * math.pi)}[wave]
            s *= min(1.0, (i + 1) / attack if attack else 1.0, (length - i) / release if release else 1.0) * volume
            sums.setdefault((seq, start + i), []).append(s)
            tone = freq * 2 ** ((sweep * i / voices.RATE + depth * math.sin(i * rate / voices.RATE % 1.0 * 2 * math.pi)) / 12)
            phase = (phase + round(tone / voices.RATE * voices.TURN)) % voices.TURN
    out = {}
    for key, v in sums.items():
        m = sum(v)
        if len(v) > 1 and abs(m) > 0.6:
            m *= max(0.3, 1 - (abs(m) - 0.6) / (1 + len(v) * 0.25))
        a = abs(m)
        a = a if a <= 0.96 else 0.98 if a >= 0.98 else 0.96 + 0.02 * math.tanh((a - 0.96) / 0.02)
        m = math.copysign(a, m)
        out[key] = (3 - m * m) * m / 2 * 28000
    return out


@pytest.mark.parametrize("chunk", [1, 64, 4096])
def test_samples_equal_a_loop_in_any_chunks(spark, chunk):
    want = loop(ROWS)
    got = {(r.seq, r.at): r.pcm for r in voices.render(spark.createDataFrame(ROWS, NOTES), "seq", "note", chunk=chunk).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1.001 and got[k] == int(round(want[k], 4)) for k in want if abs(want[k] - round(want[k])) > 1e-3)


def test_no_notes(spark):
    assert voices.render(spark.createDataFrame([], NOTES), "seq", "note").count() == 0


def test_long_notes_in_any_slabs(spark):
    """Notes of more samples than are computed at once, cut at other places."""
    rows = [(s, n, n * 1000, 400_000, 300.0 + n, 0.5, 3.0, 0.2, "saw", 10, 10, 0.3) for s, n in ((1, 1), (1, 2), (2, 3))]
    notes = spark.createDataFrame(rows, NOTES)
    sums = [voices.render(notes, "seq", "note", chunk=c).selectExpr("count(*) as n", "count(distinct seq, at) as d", "sum(pcm * (at % 251 + 1)) as s").first() for c in (3000, 100_000)]
    assert sums[0] == sums[1] and sums[0].n == sums[0].d == 401_000 + 400_000


def test_samples_are_not_shuffled(spark):
    plan = voices.render(spark.createDataFrame(ROWS, NOTES), "seq", "note")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Generate ") == 1


def test_nulls_and_text_keys(spark):
    rows = [("a", 1, 0, 3, None, 0.0, 0.0, 0.0, "sine", 0, 0, 1.0), ("a", 2, 1, 3, 100.0, 0.0, 0.0, 0.0, "square", None, 0, 0.5), (None, 3, -5, 2, 100.0, 0.0, 0.0, 0.0, "square", 0, 0, 0.5), ("b", 4, 0, None, 1.0, 0.0, 0.0, 0.0, "saw", 0, 0, 1.0), ("c", 5, 0, 1, 1.0, 0.0, 0.0, 0.0, "saw", 0, 0, None)]
    got = {(r.seq, r.at): r.pcm for r in voices.render(spark.createDataFrame(rows, NOTES.replace("seq long", "seq string")), "seq", "note", chunk=2).collect()}
    assert got == {("c", 0): None, ("a", 0): 0, ("a", 1): 19250, ("a", 2): 19250, ("a", 3): 19250, (None, -5): 19250, (None, -4): 19250}
