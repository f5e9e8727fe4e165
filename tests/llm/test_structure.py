"""Repair of conversations against an exhaustive search."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from loomwork.llm import queries, structure

ROWS = "conv_id long, turn long, role string, text string"


def brute(turns):
    """The cheapest edits of (role, text) rows that all must be tried: cost, audit, lines."""
    seen, faults = set(), []
    for role, text in turns:
        t = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not t else "duplicate" if (role, text) in seen else "truncated" if t[-1] not in ".!?" else "")
        seen.add((role, text))
    best = [(10**9, "", [])]

    def go(at, cost, audit, out):
        if (cost, audit) > best[0][:2] or not re.fullmatch("s?(ua)*u?", "".join(r[:1] or "-" for r, _ in out)):
            return
        if at == len(turns) and re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in out)) and (cost, audit) < best[0][:2]:
            best[0] = (cost, audit, [f"{r}:{t}" for r, t in out])
        if not audit.endswith("II"):
            for role in ("user", "assistant"):
                go(at, cost + 2, audit + "I", [*out, (role, "")])
        if at < len(turns):
            role, text = turns[at]
            go(at + 1, cost + 3, audit + "D", out)
            if faults[at] not in ("blank", "duplicate"):
                extra = faults[at] == "truncated"
                go(at + 1, cost + extra, audit + "K", [*out, (role, text)])
                for other in ("user", "assistant"):
                    go(at + 1, cost + 2 + extra, audit + "R", [*out, (other, text)])

    go(0, 0, "", [])
    return best[0], [faults.count(f) for f in ("blank", "duplicate", "truncated")]


def lines_of(fixed):
    out = {}
    for r in fixed.turns.orderBy("conv_id", "piece", "place").collect():
        out.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    return out


@pytest.mark.parametrize("piece", [1, 2, 1024])
def test_repair_equals_exhaustive_search(spark, piece):
    rng = random.Random(piece)
    convs = {}
    for c in range(60):
        n = rng.randrange(1, 5)
        convs[c] = [(rng.choice(["system", "user", "user", "assistant", "assistant", "tool", "sage"]), rng.choice(["a.", "b!", "cut", "", " \t", "é?  "])) for _ in range(n)]
    rows = [(c, t, *x) for c, turns in convs.items() for t, x in enumerate(turns)]
    fixed = structure.repair(spark.createDataFrame(rows, ROWS).repartition(7), piece=piece)
    got = {r.conv_id: r for r in fixed.audits.collect()}
    lines, hashes = lines_of(fixed), {r.conv_id: r.sha256 for r in structure.digests(fixed.turns).collect()}
    for c, turns in convs.items():
        (cost, audit, want), faults = brute(turns)
        r = got[c]
        assert (r.cost, r.audit, [r.blank, r.duplicate, r.truncated]) == (cost, audit, faults), turns
        assert lines.get(c, []) == want
        assert r.illegal == sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:], strict=False))
        if want:
            assert hashes[c] == hashlib.sha256("\n".join(want).encode()).hexdigest()


def test_pieces_do_not_change_long_conversations(spark):
    """One conversation that is most of the table; cut or whole, the same edits."""
    rng = random.Random(5)
    rows = [(1, t, rng.choice(["user", "assistant", "system"]), rng.choice(["x", "y."]) + str(rng.randrange(150)) + rng.choice([".", ""])) for t in range(400)]
    rows += [(c, 0, "user", "hi.") for c in range(2, 6)]
    df = spark.createDataFrame(rows, ROWS).repartition(5)
    whole = {r.conv_id: r.asDict() for r in structure.repair(df).audits.collect()}
    cut = structure.repair(df, piece=7)
    assert {r.conv_id: r.asDict() for r in cut.audits.collect()} == whole
    assert len(lines_of(cut)[1]) == sum(e != "D" for e in whole[1]["audit"])
    assert whole[2]["audit"] == "KI" and whole[2]["cost"] == 2


def test_edges(spark):
    """Nulls in every column, repeated rows, ties, long texts, clashing columns, no rows."""
    rows = [(None, None, None, None), (None, 0, "user", "hello."), (1, None, "user", "first."), (1, 3, "assistant", "second."), (1, 3, "assistant", "second."), (2, None, "user", "."), (3, 0, "user", "x" * 300_000 + "."), (3, 1, "assistant", "ok.")]
    df = spark.createDataFrame(rows, ROWS)
    clash = df.withColumns({c: F.lit("clash") for c in ("conv", "key", "n", "piece", "place", "audit", "cost", "seen")})
    fixed = structure.repair(clash)
    got = {r.conv_id: r for r in fixed.audits.collect()}
    assert set(got) == {None, 1, 2, 3}
    assert got[None].blank == 1 and got[None].gaps == 0 and got[None].audit == "DKI"
    assert got[1].duplicate == 1 and got[1].gaps == 0 and got[1].audit == "KKD"
    assert got[2].gaps == 0 and got[3].audit == "KK"
    assert len(lines_of(fixed)[3][0]) == 300_006
    assert structure.digests(fixed.turns).count() == 4
    none = structure.repair(spark.createDataFrame([], ROWS))
    assert none.audits.count() == 0 and none.turns.count() == 0 and structure.digests(none.turns).count() == 0


def test_query_equals_plain_loop(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r.conv_id: r for r in queries.conversation_repair(spark, sf).collect()}
    assert set(got) == {r[0] for r in rows}
    convs = {c: [] for c in got}
    for c, turn, role, text in sorted(rows, key=lambda r: (r[0], r[1])):
        by = zlib.crc32(f"{c}:{turn}".encode()) % 20
        text = "" if by == 1 else re.sub("[.!?]", "", text) if by == 2 else text
        convs[c] += [(turn, "user" if by == 4 else role, text)] * (0 if by == 0 else 2 if by == 3 else 1)
    for c, turns in convs.items():
        numbers = sorted({t for t, _, _ in turns})
        assert got[c].gaps == (numbers[-1] - numbers[0] + 1 - len(numbers) if numbers else 0)
        if len(turns) <= 5:
            (cost, audit, lines), faults = brute([t[1:] for t in turns])
            assert (got[c].cost, got[c].audit, [got[c].blank, got[c].duplicate, got[c].truncated]) == (cost, audit, faults)
            assert got[c].repaired_sha256 == hashlib.sha256("\n".join(lines).encode()).hexdigest()
