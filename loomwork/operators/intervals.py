"""Times: outcomes by the rows around, unions of intervals, what is active when, queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def reactions(rows: DataFrame, key: str, id_col: str, order: list[str], shown: Column, tapped: Column, at: Column, limit: int) -> DataFrame:
    """(key, id, target, outcome, ms): what became of each target and of each tap without one.

    A target is open until a tap, the next target, or ``limit`` milliseconds have passed.
    ``hit`` (id of the tap, milliseconds since the target), ``early`` (a tap without an open
    target), ``replaced`` and ``too slow`` (id of the target). ``at`` is in milliseconds."""
    rows = rows.filter(shown | tapped).select(key, F.col(id_col).alias("_id"), F.struct(*order).alias("_order"), shown.alias("_shown"), at.alias("_at"))
    w = Window.partitionBy(key).orderBy("_order")
    near = {f"_{side}{c}": f(c).over(w) for side, f in (("last", F.lag), ("next", F.lead)) for c in ("_shown", "_at", "_id")}
    rows = rows.withColumns(near)
    ms = F.col("_at") - F.col("_last_at")
    hit = F.coalesce(F.col("_last_shown") & (ms <= limit), F.lit(False))
    in_time = F.coalesce(F.col("_next_at") - F.col("_at") <= limit, F.lit(False))
    outcome = F.when(F.col("_shown"), F.when(~in_time, "too slow").when(F.col("_next_shown"), "replaced")).when(hit, "hit").otherwise("early")
    target = F.when(F.col("_shown"), F.col("_id")).when(hit, F.col("_last_id"))
    out = rows.select(key, F.col("_id").alias(id_col), target.alias("target"), outcome.alias("outcome"), F.when(~F.col("_shown") & hit, ms).alias("ms"))
    return out.filter("outcome is not null")


def rating(ms: Column, great: int, good: int) -> Column:
    return F.when(ms <= great, "great").when(ms <= good, "good").when(ms.isNotNull(), "slow")


def union_of(rows: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """(keys, start, end, n): the intervals [start, end) of each key, those that overlap or touch
    as one (a second one prolongs the first, it does not add up), and how many they were."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_new", F.coalesce(F.col(start) > F.max(end).over(before), F.lit(True)).cast("int"))
    rows = rows.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n")).drop("_island")


def active(intervals: DataFrame, key: str, kind: str, kinds: list[str], start: str, end: str) -> DataFrame:
    """(key, from, to, active): what kinds of interval hold together, for every stretch of time in
    which some do. A sweep over the edges; no point of time is made a row. Intervals of one
    kind and key must not overlap (``union_of``)."""
    edge = lambda at, by: intervals.select(key, kind, F.col(at).alias("from"), F.lit(by).alias("_by"))
    edges = edge(start, 1).unionByName(edge(end, -1))
    turns = edges.groupBy(key, "from").agg(*[F.sum(F.when(F.col(kind) == k, F.col("_by")).otherwise(0)).alias(f"_{i}") for i, k in enumerate(kinds)])
    w = Window.partitionBy(key).orderBy("from")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    held = F.filter(F.array(*[F.when(F.sum(f"_{i}").over(so_far) > 0, F.lit(k)) for i, k in enumerate(kinds)]), lambda x: x.isNotNull())
    out = turns.select(key, "from", F.lead("from").over(w).alias("to"), F.array_join(held, ",").alias("active"))
    # an edge that changes nothing does not cut a stretch
    out = out.withColumn("_same", F.coalesce(F.lag("active").over(w) == F.col("active"), F.lit(False)))
    out = out.filter("not _same").withColumn("to", F.lead("from").over(w))
    return out.filter("active <> ''").drop("_same")


def admitted(rows: DataFrame, keys: list[str], order: list[str], depth: int) -> DataFrame:
    """``rows`` that a queue of ``depth`` places takes up, each with its place: the first of each
    drain (``keys``); later ones find it full and are dropped. The limit reaches below the
    shuffle: a task sends ``depth`` rows of a drain at most."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("place") <= depth)


def drained(rows: DataFrame, keys: list[str], order: list[str], depth: int, stop: Column) -> DataFrame:
    """(keys, sent, taken, dropped, played): per drain how many messages were sent, taken up and
    dropped, and how many of those taken up come after the last ``stop``, which silences all
    before it and takes a place like others."""
    sent = rows.groupBy(*keys).agg(F.count("*").alias("sent"))
    taken = admitted(rows.select(*keys, *order, stop.alias("_stop")), keys, order, depth)
    last = F.coalesce(F.max(F.when(F.col("_stop"), F.col("place"))), F.lit(0))
    counts = taken.groupBy(*keys).agg(F.count("*").alias("taken"), (F.max("place") - last).cast("long").alias("played"))
    return sent.join(counts, keys).select(*keys, "sent", "taken", (F.col("sent") - F.col("taken")).alias("dropped"), "played")


def bursts(rows: DataFrame, key: str, at: str, gap: str, late: str | None = None) -> DataFrame:
    """(key, first, until, requests): one row for each burst, requests of a key that follow each
    other within ``gap`` (coalesced rebuilds). The same over a table and over a stream; over a
    stream with rows late up to ``late``."""
    if late:
        rows = rows.withWatermark(at, late)
    w = F.session_window(at, gap)
    return rows.groupBy(key, w.alias("w")).agg(F.count("*").alias("requests")).select(key, F.col("w.start").alias("first"), F.col("w.end").alias("until"), "requests")


def whole_steps(rows: DataFrame, key: str, order: list[str], at: str, step: int, wrap: int = 1 << 32) -> DataFrame:
    """``rows`` with ``steps``: how many whole steps of time have passed since the key's row before,
    the rest being carried on, and ``rest``, what is left after this row. ``at`` is a clock
    that wraps at ``wrap``. No state is kept: steps are differences of the floored sums of the
    times between."""
    w = Window.partitionBy(key).orderBy(*order)
    passed = F.pmod(F.col(at) - F.lag(at, 1).over(w), F.lit(wrap))
    rows = rows.withColumn("_t", F.coalesce(passed, F.lit(0).cast("long")))
    rows = rows.withColumn("_t", F.sum("_t").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("rest", F.pmod("_t", F.lit(step))).withColumn("_t", F.col("_t") - F.col("rest"))
    steps = (F.col("_t") - F.lag("_t", 1, 0).over(w)) / step
    return rows.withColumn("steps", steps.cast("long")).drop("_t")
