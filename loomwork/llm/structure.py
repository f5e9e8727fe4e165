"""Repair of conversation structure by a retained-subsequence DP.

A repaired conversation is an optional system turn and then user and assistant turns by
turns. The DP chooses the turns that stay, as they are or with another role. What lies
between two of them is deleted, priced by a difference of prefix sums; the two roles decide
how many empty turns have to be inserted. So a turn needs of all turns before it only one
running minimum for each role (cost less the prefix sum), and of equal costs the one with
the least edits in ASCII order.

A conversation of any length is cut into pieces. A piece is solved for each role that may
come before it; a fold over the pieces' small tables then picks one solution of each."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint

#: Turns of a piece at most.
PIECE = 1024
#: The role before: nothing kept yet, system, user, assistant.
STATES = "^sua"
DELETE, REROLE, INSERT, TRUNCATED = 3, 2, 2, 1
#: Empty turns between two roles that follow each other in the result (no entry: cannot be).
GAPS = {("^", "s"): 0, ("^", "u"): 0, ("^", "a"): 1, ("s", "u"): 0, ("s", "a"): 1, ("u", "u"): 1, ("u", "a"): 0, ("a", "u"): 0, ("a", "a"): 1}
#: Empty turns after the last role.
ENDS = {"^": 0, "s": 2, "u": 1, "a": 0}
ROLES = {"u": "user", "a": "assistant"}
#: White space, and the ends of sentences.
BLANKS, SENTENCE_END = " \t\n\x0b\x0c\r", "[.!?]"

#: A solution: cost less the prefix sum at its end, edits so far (deletions after the last
#: turn kept left out), turns that these edits cover.
Solution = tuple[int, str, int]


def _less(a: Solution, b: Solution | None) -> bool:
    """Whether a is cheaper, or as cheap with lesser edits once both are filled up with
    deletions to the same turn. Neither's edits can then begin the other's."""
    if b is None or a[0] != b[0]:
        return b is None or a[0] < b[0]
    end = max(a[2], b[2])
    return a[1] + "D" * (end - a[2]) < b[1] + "D" * (end - b[2])


def solve(turns: list[tuple[str, bool, bool]], entry: str = "^") -> dict[str, tuple[int, str]]:
    """(cost, edits) for each last role that a piece can end with, where ``entry`` is the
    last role before the piece. ``turns``: (initial of the role, must go, truncated)."""
    best: dict[str, Solution] = {entry: (0, "", 0)}
    gone = 0  # prefix sum of deletions
    for at, (initial, must_go, truncated) in enumerate(turns):
        found: dict[str, Solution] = {}
        if not must_go:
            for role in "sua":
                if role == initial:
                    edit, price = "K", 0
                elif role in ROLES:
                    edit, price = "R", REROLE
                else:
                    continue
                for before, (cost, edits, covered) in best.items():
                    n = GAPS.get((before, role))
                    if n is None:
                        continue
                    # all since the last turn kept is deleted: a difference of prefix sums
                    x = (cost + gone + n * INSERT + price + TRUNCATED * truncated, edits + "D" * (at - covered) + "I" * n + edit, at + 1)
                    if _less(x, found.get(role)):
                        found[role] = x
        gone += DELETE
        for role, (cost, edits, covered) in found.items():
            x = (cost - gone, edits, covered)
            if _less(x, best.get(role)):
                best[role] = x
    return {role: (cost + gone, edits + "D" * (len(turns) - covered)) for role, (cost, edits, covered) in best.items()}


def _digest(*cols: Column) -> Column:
    return F.unhex(F.md5(F.encode(F.concat_ws("\0", *cols), "UTF-8")))


_ROW = ["turn", "role", "key"]
_PIECES = "conv string, piece long, first boolean, head string, tail string, illegal long, costs array<long>, ranks array<int>, edits array<string>, turns array<long>, roles array<string>, keys array<binary>"


def _pieces(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Turns in order to solved pieces of ``size`` turns. The first conversation of a task may have begun in
    the one before, so it is solved for all roles before it."""
    schema = pa.schema([("conv", pa.string()), ("piece", pa.int64()), ("first", pa.bool_()), ("head", pa.string()), ("tail", pa.string()), ("illegal", pa.int64()), ("costs", pa.list_(pa.int64())), ("ranks", pa.list_(pa.int32())), ("edits", pa.list_(pa.string())), ("turns", pa.list_(pa.int64())), ("roles", pa.list_(pa.string())), ("keys", pa.list_(pa.binary()))])
    number = TaskContext.get().partitionId() << 32
    out: list[tuple] = []

    def solved(conv: str, rows: list[tuple], first: bool) -> None:
        nonlocal number
        costs: list[int | None] = []
        edits: list[str | None] = []
        for entry in STATES:
            ends = solve([r[3:] for r in rows], entry) if entry == "^" or not first else {}
            for end in STATES:
                c, e = ends.get(end, (None, None))
                costs.append(c)
                edits.append(e)
        order = {e: i for i, e in enumerate(sorted({e for e in edits if e is not None}))}
        pairs = [rows[i][3] + rows[i + 1][3] for i in range(len(rows) - 1)]
        turns, roles, keys = zip(*(r[:3] for r in rows), strict=True)
        illegal = sum(p not in ("su", "ua", "au") for p in pairs)
        out.append((conv, number, first, rows[0][3], rows[-1][3], illegal, costs, [order.get(e) for e in edits], edits, list(turns), list(roles), list(keys)))
        number += 1

    def flushed() -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) if out else [[] for _ in schema]
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    held: list[tuple] = []
    conv, first, begun = None, False, False
    for b in batches:
        cols = dict(zip(b.schema.names, (c.to_pylist() for c in b.columns), strict=True))
        for c, turn, role, key, n, initial, blank, seen, cut in zip(*(cols[k] for k in ("conv", *_ROW, "n", "initial", "blank", "seen", "cut")), strict=True):
            if c != conv:
                if held:
                    solved(conv, held, first)
                conv, first, held, begun = c, begun, [], True
            for k in range(n):
                if len(held) == size:
                    solved(conv, held, first)
                    held, first = [], False
                # of equal rows only the first may stay
                held.append((turn, role, key, initial, blank or seen or k > 0, cut))
        yield flushed()
    if held:
        solved(conv, held, first)
    yield flushed()


def _choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The pieces of conversations in order; which solution each takes. Held are a number
    or two for each piece of one conversation."""

    def chosen(conv: str, back: list[dict], numbers: list[int], state: dict, illegal: int) -> list[tuple]:
        # the costs of the inserts at the end count, and of equal costs the edits' ranks
        end = min(state, key=lambda s: (state[s][0] + ENDS[s] * INSERT, state[s][1], ENDS[s]))
        cost, last = state[end][0] + ENDS[end] * INSERT, ENDS[end]
        rows = []
        for k in range(len(back) - 1, -1, -1):
            entry = back[k][end]
            rows.append((conv, numbers[k], entry, STATES.index(entry) * 4 + STATES.index(end), last, cost, illegal))
            end, last, cost, illegal = entry, 0, 0, 0
        return rows

    columns = ["conv", "piece", "entry", "place", "inserts", "cost", "illegal"]
    conv, back, numbers, state, illegal, tail = None, [], [], {}, 0, ""
    for b in batches:
        out: list[tuple] = []
        for r in b.itertuples(index=False):
            if r.conv != conv:
                if back:
                    out += chosen(conv, back, numbers, state, illegal)
                conv, back, numbers, state, illegal, tail = r.conv, [], [], {"^": (0, 0)}, 0, ""
            illegal += r.illegal + (bool(back) and tail + r.head not in ("su", "ua", "au"))
            tail = r.tail
            found: dict[str, tuple] = {}
            for entry, (cost, rank) in state.items():
                for end in STATES:
                    k = STATES.index(entry) * 4 + STATES.index(end)
                    if (c := r.costs[k]) is not None and c == c:
                        x = (cost + int(c), rank, int(r.ranks[k]), entry)
                        if end not in found or x < found[end]:
                            found[end] = x
            order = {x: i for i, x in enumerate(sorted({f[1:3] for f in found.values()}))}
            back.append({end: f[3] for end, f in found.items()})
            numbers.append(r.piece)
            state = {end: (f[0], order[f[1:3]]) for end, f in found.items()}
        yield pd.DataFrame(out, columns=columns)
    if back:
        yield pd.DataFrame(chosen(conv, back, numbers, state, illegal), columns=columns)


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The turns of the result: those kept, by their row, and those inserted."""
    schema = pa.schema([("conv", pa.string()), ("piece", pa.int64()), ("place", pa.int32()), ("edit", pa.string()), ("new_role", pa.string()), ("turn", pa.int64()), ("role", pa.string()), ("key", pa.binary())])
    for b in batches:
        out: list[tuple] = []
        for r in b.to_pylist():
            before, at = r["entry"], 0
            edits = r["audit"] + "I" * r["inserts"]
            for place, edit in enumerate(edits):
                if edit == "D":
                    at += 1
                    continue
                row = (r["turns"][at], r["roles"][at], r["keys"][at]) if edit != "I" else (None, None, None)
                at += edit != "I"
                follows = "a" if before == "u" else "u"
                role = row[1] if edit == "K" else ROLES[follows]
                before = row[1][:1] if edit == "K" else follows
                out.append((r["conv"], r["piece"], place, edit, role, *row))
        cols = list(zip(*out, strict=True)) if out else [[] for _ in schema]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


class Repair:
    """What was found and done: ``audits`` and ``turns``."""

    def __init__(self, audits: DataFrame, turns: DataFrame):
        #: conv_id, n_turns, gaps, blank, duplicate, truncated, illegal, cost, audit
        self.audits = audits
        #: conv_id, piece, place (their order), edit (K, R or I), role, text
        self.turns = turns


def repair(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", piece: int = PIECE) -> Repair:
    """Each conversation of ``rows`` with the cheapest edits that give its roles the form
    ``(s?(ua)+)?``. Prices: delete 3 (blank turns and repeats of an earlier role and text
    must go), other role 2, insert an empty turn 2, keep 0; a truncated turn that stays 1.

    Turns go by number, nulls first, those of one number by role, then by the first 32
    characters of the text, then by its digest; equal rows follow each other. A null role or text is one space; a null
    conv_id is a conversation like others. Turn numbers are longs. Other columns are
    ignored, whatever they are called; an empty table gives empty ones. Very long texts are
    read whole. A conversation may be of any length: its turns are dealt by range and solved
    in pieces of ``piece`` turns; only its audit is one value."""
    kind = dict(rows.dtypes)[id_col]
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    named = rows.select(F.coalesce(F.concat(F.lit("="), F.col(id_col).cast("string")), F.lit("")).alias("conv"), F.col(turn_col).cast("long").alias("turn"), space(role_col).alias("role"), space(text_col).alias("text"))
    one_of_each = named.groupBy("conv", "turn", "role", "text").agg(F.count("*").alias("n"))
    one_of_each = checkpoint(one_of_each.withColumn("key", _digest(F.col("role"), F.col("text"))))

    stripped = F.rtrim("text", F.lit(BLANKS))
    narrow = one_of_each.select("conv", *_ROW, "n", F.left("text", F.lit(32)).alias("begin"), F.left("role", F.lit(1)).alias("initial"), (stripped == "").alias("blank"), (~F.right(stripped, F.lit(1)).rlike(SENTENCE_END)).alias("cut"))
    # a text is seen earlier unless its turn is the first with it; turn and key say where,
    # so that a text that is said over and over is not one group
    firsts = narrow.groupBy("conv", "key").agg(F.min(F.struct(F.col("turn").isNotNull().alias("has"), "turn")).alias("t")).select(F.col("conv").alias("f_conv"), F.col("key").alias("f_key"), F.col("t.turn").alias("f_turn"))
    flagged = narrow.join(firsts, (F.col("conv") == F.col("f_conv")) & F.col("turn").eqNullSafe(F.col("f_turn")) & (F.col("key") == F.col("f_key")), "left")
    flagged = checkpoint(flagged.withColumn("seen", F.col("f_conv").isNull()).drop("f_conv", "f_turn", "f_key"))

    repeats = F.when(F.col("seen"), F.col("n")).otherwise(F.col("n") - 1)
    fault = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0)).alias
    by_turn = flagged.groupBy("conv", "turn").agg(F.sum("n").alias("n_turns"), fault(F.col("blank"))("blank"), F.sum(F.when(F.col("blank"), 0).otherwise(repeats)).alias("duplicate"), F.sum(F.when(F.col("cut") & ~F.col("blank") & ~F.col("seen"), 1).otherwise(0)).alias("truncated"))
    totals = [F.sum(c).cast("long").alias(c) for c in ("n_turns", "blank", "duplicate", "truncated")]
    counts = by_turn.groupBy("conv").agg(*totals, F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"))

    order = ["conv", "turn", "role", "begin", "key"]
    pieces = checkpoint(flagged.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(partial(_pieces, size=piece), _PIECES))
    small = pieces.select("conv", "piece", "head", "tail", "illegal", "costs", "ranks")
    choice = checkpoint(small.repartition("conv").sortWithinPartitions("conv", "piece").mapInPandas(_choose, "conv string, piece long, entry string, place int, inserts int, cost long, illegal long"))
    picked = pieces.drop("illegal").join(choice, ["conv", "piece"]).withColumn("audit", F.element_at("edits", F.col("place") + 1))
    parts = picked.select("conv", "cost", "illegal", F.struct("piece", F.concat("audit", F.repeat(F.lit("I"), F.col("inserts"))).alias("part")).alias("p"))
    audits = parts.groupBy("conv").agg(F.sum("cost").alias("cost"), F.sum("illegal").alias("illegal"), F.concat_ws("", F.transform(F.sort_array(F.collect_list("p")), lambda p: p["part"])).alias("audit"))
    back = F.when(F.col("conv") != "", F.expr("substring(conv, 2)")).cast(kind).alias(id_col)
    audits = counts.join(audits, "conv").select(back, "n_turns", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")

    edited = picked.select("conv", "piece", "entry", "audit", "inserts", "turns", "roles", "keys").mapInArrow(_edited, "conv string, piece long, place int, edit string, new_role string, turn long, role string, key binary")
    texts = one_of_each.select(F.col("conv").alias("t_conv"), F.col("turn").alias("t_turn"), F.col("key").alias("t_key"), "text")
    # inserted turns have no key; null keys meet nothing
    turns = edited.join(texts, (F.col("conv") == F.col("t_conv")) & F.col("turn").eqNullSafe(F.col("t_turn")) & (F.col("key") == F.col("t_key")), "left")
    turns = turns.select(back, "piece", "place", "edit", F.col("new_role").alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return Repair(audits, turns)


def digests(turns: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """id, sha256 of the lines ``role:text`` of each conversation in order, with line feeds
    between. The rows stream through a task with one hash in memory; a hash is over one
    sequence, so a conversation's rows go to one task here, and only here."""
    kind = dict(turns.dtypes)[id_col]

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, h = None, None
        for b in batches:
            out = []
            cols = (b.column(k).to_pylist() for k in ("conv", "role", "text"))
            for c, group in groupby(zip(*cols, strict=True), key=lambda r: r[0]):
                if h is None or c != conv:
                    if h is not None:
                        out.append((conv, h.hexdigest()))
                    conv, h, joint = c, hashlib.sha256(), ""
                for _, role, text in group:
                    h.update(f"{joint}{role}:{text}".encode("utf-8", "surrogatepass"))
                    joint = "\n"
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.string()) for k in (0, 1)], names=["conv", "sha256"])
        if h is not None:
            yield pa.RecordBatch.from_arrays([pa.array([conv], pa.string()), pa.array([h.hexdigest()])], names=["conv", "sha256"])

    rows = turns.select(F.col(id_col).cast("string").alias("conv"), "piece", "place", "role", "text")
    out = rows.repartition("conv").sortWithinPartitions("conv", "piece", "place").mapInArrow(hashes, "conv string, sha256 string")
    return out.select(F.col("conv").cast(kind).alias(id_col), "sha256")


def damage(rows: DataFrame) -> DataFrame:
    """The conversations' rows, some dropped, emptied, cut, repeated or given to the user,
    by crc32 of ``conv_id:turn`` modulo 20."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    by = F.crc32(F.encode(F.concat(space("conv_id"), F.lit(":"), space("turn")), "UTF-8")) % 20
    out = rows.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), by.alias("_by")).filter("_by <> 0")
    role = F.when(F.col("_by") == 4, F.lit("user")).otherwise(F.col("role"))
    text = F.when(F.col("_by") == 1, F.lit("")).when(F.col("_by") == 2, F.regexp_replace("text", SENTENCE_END, "")).otherwise(F.col("text"))
    times = F.sequence(F.lit(1), F.when(F.col("_by") == 3, 2).otherwise(1))
    return out.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("_time")).drop("_time")


def oracle(source: str = "conversations") -> str:
    """The repair of damaged conversations in DuckDB SQL: row by row, the best for each last role."""
    space = " \t\n\x0b\x0c\r"
    return f"""
WITH RECURSIVE named AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM {source}),
crc AS (SELECT *, xor(list_reduce(list_concat([4294967295::BIGINT], [ascii(c)::BIGINT FOR c IN string_split(name, '')]),
  lambda a, b: xor(a >> 8, list_reduce(list_concat([xor(a, b) & 255], range(0, 8)), lambda v, k: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END))), 4294967295) % 20 AS kind FROM named),
damaged AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(0, CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM crc WHERE kind <> 0),
ordered AS (SELECT *, left(role, 1) AS initial, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS n, rtrim(text, '{space}') AS stripped FROM damaged),
seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 AS again FROM ordered),
t AS (SELECT *, CASE WHEN stripped = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN right(stripped, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM seen),
counts AS (SELECT conv_id, max(n) AS last, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated FROM t GROUP BY conv_id),
pairs AS (SELECT conv_id, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM (SELECT conv_id, n, lag(initial) OVER (PARTITION BY conv_id ORDER BY n) || initial AS pair FROM t) GROUP BY conv_id),
edits(edit, goal) AS (VALUES ('D', ''), ('K', 's'), ('K', 'u'), ('K', 'a'), ('R', 'u'), ('R', 'a')),
gap(before, goal, k) AS (VALUES ('^', 's', 0), ('^', 'u', 0), ('^', 'a', 1), ('s', 'u', 0), ('s', 'a', 1), ('u', 'u', 1), ('u', 'a', 0), ('a', 'u', 0), ('a', 'a', 1)),
dp AS (SELECT conv_id, 0::BIGINT AS n, '^' AS state, 0::BIGINT AS cost, '' AS audit, []::VARCHAR[] AS lines FROM counts
  UNION ALL SELECT conv_id, n, state, cost, audit, lines FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, state ORDER BY cost, audit) AS best FROM (
    SELECT t.conv_id, t.n, CASE WHEN e.edit = 'D' THEN dp.state ELSE e.goal END AS state,
      (dp.cost + CASE e.edit WHEN 'D' THEN 3 WHEN 'R' THEN 2 ELSE 0 END + coalesce(g.k, 0) * 2 + CASE WHEN e.edit <> 'D' AND t.fault = 'truncated' THEN 1 ELSE 0 END)::BIGINT AS cost,
      dp.audit || repeat('I', coalesce(g.k, 0)) || e.edit AS audit,
      CASE WHEN e.edit = 'D' THEN dp.lines ELSE list_concat(list_concat(dp.lines, CASE WHEN g.k = 1 THEN [CASE WHEN e.goal = 'a' THEN 'user:' ELSE 'assistant:' END] ELSE []::VARCHAR[] END),
        [CASE WHEN e.edit = 'K' THEN t.role WHEN e.goal = 'u' THEN 'user' ELSE 'assistant' END || ':' || t.text]) END AS lines
    FROM dp JOIN t ON t.conv_id = dp.conv_id AND t.n = dp.n + 1 CROSS JOIN edits e LEFT JOIN gap g ON g.before = dp.state AND g.goal = e.goal
    WHERE e.edit = 'D' OR t.fault NOT IN ('blank', 'duplicate') AND g.k IS NOT NULL AND (e.edit = 'K') = (e.goal = t.initial))) WHERE best = 1),
ends(state, k, more) AS (VALUES ('^', 0, []::VARCHAR[]), ('s', 2, ['user:', 'assistant:']), ('u', 1, ['assistant:']), ('a', 0, []::VARCHAR[])),
done AS (SELECT conv_id, cost + k * 2 AS cost, audit || repeat('I', k) AS audit, list_concat(lines, more) AS lines, row_number() OVER (PARTITION BY conv_id ORDER BY cost + k * 2, audit || repeat('I', k)) AS best FROM dp JOIN counts USING (conv_id) JOIN ends USING (state) WHERE n = last)
SELECT i.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(d.cost, 0)::BIGINT AS cost, coalesce(d.audit, '') AS audit, sha256(coalesce(array_to_string(d.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM {source}) i LEFT JOIN counts c ON c.conv_id = i.conv_id LEFT JOIN pairs p ON p.conv_id = i.conv_id LEFT JOIN (SELECT * FROM done WHERE best = 1) d ON d.conv_id = i.conv_id
"""
