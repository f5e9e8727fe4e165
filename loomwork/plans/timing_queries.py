"""Turns, reactions, timed effects, bursts and queues over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.motion import bounced
from ..operators import intervals as iv
from ..operators import spatial as sp
from ..operators.matching import first_come
from ..streaming import fold
from .registry import query, table



def _micros(ts: str = "ts") -> Column:
    """Microseconds since 1970, whatever the session's time zone."""
    return F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), F.col(ts))


def _units(ts: str, micros: int) -> Column:
    return ((_micros(ts) - F.pmod(_micros(ts), F.lit(micros))) / micros).cast("long")


#: A board for each thousand keys: bricks in rows of fifty, lasers anywhere over them.
_LASERS = "SELECT c_custkey, c_custkey // 1000 AS board, (c_custkey // 1000 * 2000 + c_custkey * 37 % 1000)::INTEGER AS a_x0, (c_custkey * 91 % 200)::INTEGER AS a_y0 FROM customer"
_WALL = "SELECT p_partkey, (p_partkey // 1000 * 2000 + p_partkey % 50 * 20)::INTEGER AS b_x0, (p_partkey // 50 % 20 * 10)::INTEGER AS b_y0, CASE WHEN p_partkey % 7 > 0 THEN 1 + p_partkey % 2 END AS hits FROM part"


@query(f"""
WITH RECURSIVE a AS (SELECT *, a_x0 + 4 AS a_x1, a_y0 + 12 AS a_y1 FROM ({_LASERS})), b AS (SELECT *, b_x0 + 18 AS b_x1, b_y0 + 8 AS b_y1 FROM ({_WALL})),
p AS (SELECT board, c_custkey, list({{'p': p_partkey, 'hits': hits}} ORDER BY b_y0, b_x0, p_partkey) AS bs FROM a JOIN b ON a_x0 < b_x1 AND b_x0 < a_x1 AND a_y0 < b_y1 AND b_y0 < a_y1 GROUP BY 1, 2),
c AS (SELECT *, row_number() OVER (PARTITION BY board ORDER BY c_custkey) AS n FROM p),
s AS (SELECT board, 0::BIGINT AS n, NULL::BIGINT AS c_custkey, NULL::BIGINT AS p_partkey, NULL::BIGINT AS hits, []::BIGINT[] AS used FROM (SELECT DISTINCT board FROM c)
  UNION ALL SELECT board, n, c_custkey, f.p, f.hits, CASE WHEN f.hits IS NULL THEN used ELSE list_append(used, f.p) END
  FROM (SELECT c.board, c.n, c.c_custkey, s.used, list_filter(c.bs, lambda x: x.hits IS NULL OR len(list_filter(s.used, lambda u: u = x.p)) < x.hits)[1] AS f FROM s JOIN c ON s.board = c.board AND c.n = s.n + 1))
SELECT c_custkey, p_partkey, CASE WHEN hits IS NOT NULL THEN len(list_filter(used, lambda u: u = p_partkey)) ELSE 0 END::INTEGER AS nth,
  coalesce(len(list_filter(used, lambda u: u = p_partkey)) = hits, false) AS destroys FROM s WHERE p_partkey IS NOT NULL
""")
def laser_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lasers fire in the order of their keys; each hits the first brick under it that still
    stands. Bricks stand one or two hits, some any number."""
    c, p = F.col("c_custkey"), F.col("p_partkey")
    a = table(spark, sf_dir, "customer").select("c_custkey", (F.floor(c / 1000) * 2000 + c * 37 % 1000).cast("int").alias("a_x0"), (c * 91 % 200).cast("int").alias("a_y0"))
    b = table(spark, sf_dir, "part").select("p_partkey", (F.floor(p / 1000) * 2000 + p % 50 * 20).cast("int").alias("b_x0"), (F.floor(p / 50) % 20 * 10).cast("int").alias("b_y0"), F.when(p % 7 > 0, 1 + p % 2).alias("hits"))
    a = a.withColumns({"a_x1": F.col("a_x0") + 4, "a_y1": F.col("a_y0") + 12})
    b = b.withColumns({"b_x1": F.col("b_x0") + 18, "b_y1": F.col("b_y0") + 8})
    # a key is its turn
    pairs = sp.overlaps(a, b, 20.0).withColumn("turn", F.col("c_custkey"))
    got = first_come(pairs, "c_custkey", "turn", "p_partkey", ["b_y0", "b_x0", "p_partkey"], "hits")
    return got.select("c_custkey", "p_partkey", F.coalesce("nth", F.lit(0)).alias("nth"), F.coalesce(F.col("nth") == F.col("hits"), F.lit(False)).alias("destroys"))


#: Milliseconds until a target is gone; reactions that are great or good.
LIMIT, GREAT, GOOD = 21_600_000, 3_600_000, 10_800_000


@query(f"""
WITH e AS (SELECT user_id, event_id, event_type = 'view' AS shown, epoch_us(ts) // 1000 AS t FROM events WHERE event_type IN ('view', 'click')),
s AS (SELECT user_id, event_id, t FROM e WHERE shown), c AS (SELECT user_id, event_id, t FROM e WHERE NOT shown),
l AS (SELECT c.user_id, c.event_id, c.t, s.event_id AS target, s.t AS s_t FROM c ASOF LEFT JOIN s ON c.user_id = s.user_id AND c.t >= s.t),
taps AS (SELECT *, coalesce(t - s_t <= {LIMIT} AND row_number() OVER (PARTITION BY user_id, target ORDER BY t, event_id) = 1, false) AS hit FROM l),
n AS (SELECT a.user_id, a.event_id, a.t, b.t AS n_t FROM s a ASOF LEFT JOIN s b ON a.user_id = b.user_id AND a.t < b.t),
o AS (SELECT n.* FROM n LEFT JOIN taps x ON x.hit AND x.user_id = n.user_id AND x.target = n.event_id WHERE x.event_id IS NULL)
SELECT user_id, event_id, CASE WHEN hit THEN target ELSE -1 END AS target, CASE WHEN hit THEN 'hit' ELSE 'early' END AS outcome, CASE WHEN hit THEN t - s_t ELSE -1 END AS ms,
  CASE WHEN NOT hit THEN '' WHEN t - s_t <= {GREAT} THEN 'great' WHEN t - s_t <= {GOOD} THEN 'good' ELSE 'slow' END AS rating FROM taps
UNION ALL SELECT user_id, event_id, event_id, CASE WHEN n_t - t <= {LIMIT} THEN 'replaced' ELSE 'too slow' END, -1, '' FROM o
""")
def target_reactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of each target a user was shown and of each tap: hit in so many
    milliseconds, early, too slow, or replaced by the next target."""
    got = iv.reactions(table(spark, sf_dir, "events"), "user_id", "event_id", ["ts", "event_id"], F.col("event_type") == "view", F.col("event_type") == "click", _units("ts", 1000), LIMIT)
    none = F.lit(-1).cast("long")
    return got.select("user_id", "event_id", F.coalesce("target", none).alias("target"), "outcome", F.coalesce("ms", none).alias("ms"), F.coalesce(iv.rating(F.col("ms"), GREAT, GOOD), F.lit("")).alias("rating"))


#: Seconds that an effect lasts: so many ticks of a minute.
EFFECTS = {"signup": 200 * 60, "purchase": 120 * 60, "error": 60 * 60}
#: Ticks between two shots.
COOLDOWN = 12
_PICKUPS = "SELECT user_id, event_type AS kind, epoch(ts)::BIGINT AS since, epoch(ts)::BIGINT + CASE event_type WHEN 'signup' THEN 12000 WHEN 'purchase' THEN 7200 ELSE 3600 END AS until FROM (SELECT user_id, event_type, date_trunc('second', ts) AS ts FROM events WHERE event_type IN ('signup', 'purchase', 'error'))"
_EFFECTS = f"""p AS ({_PICKUPS}), m AS (SELECT *, max(until) OVER (PARTITION BY user_id, kind ORDER BY since, until ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM p),
i AS (SELECT *, sum(CASE WHEN before IS NULL OR since > before THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, kind ORDER BY since, until ROWS UNBOUNDED PRECEDING) AS island FROM m),
u AS (SELECT user_id, kind, min(since) AS since, max(until) AS until, count(*) AS pickups FROM i GROUP BY user_id, kind, island)"""


def _effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").filter(F.col("event_type").isin(*EFFECTS))
    seconds = F.create_map(*[F.lit(x) for k, n in EFFECTS.items() for x in (k, n)])[F.col("event_type")]
    since = _units("ts", 1_000_000)
    return iv.union_of(e.select("user_id", F.col("event_type").alias("kind"), since.alias("since"), (since + seconds).alias("until")), ["user_id", "kind"], "since", "until")


@query(f"WITH {_EFFECTS} SELECT user_id, kind, since, until, pickups, CASE WHEN kind = 'error' THEN (until - since + 719) // 720 ELSE 0 END AS shots FROM u")
def effect_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From when until when each effect holds; a second pick-up prolongs it. One kind fires by
    itself, at once and then every twelve ticks."""
    every = COOLDOWN * 60
    shots = F.when(F.col("kind") == "error", F.expr(f"(until - since + {every - 1}) div {every}")).otherwise(0)
    return _effects(spark, sf_dir).withColumnRenamed("n", "pickups").withColumn("shots", shots)


@query(f"""
WITH {_EFFECTS}, t AS (SELECT DISTINCT user_id, since AS t FROM u UNION SELECT DISTINCT user_id, until FROM u),
x AS (SELECT t.user_id, t.t, coalesce(string_agg(u.kind, ',' ORDER BY u.kind DESC), '') AS active FROM t LEFT JOIN u ON u.user_id = t.user_id AND u.since <= t.t AND t.t < u.until GROUP BY 1, 2),
c AS (SELECT * FROM (SELECT *, lag(active) OVER (PARTITION BY user_id ORDER BY t) AS before FROM x) WHERE active IS DISTINCT FROM before),
n AS (SELECT user_id, t AS "from", lead(t) OVER (PARTITION BY user_id ORDER BY t) AS "to", active FROM c)
SELECT user_id, "from", "to", active FROM n WHERE active <> ''
""")
def active_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which effects hold together, stretch by stretch."""
    return iv.active(_effects(spark, sf_dir), "user_id", "kind", ["signup", "purchase", "error"], "since", "until")


@query("""
WITH RECURSIVE v AS (SELECT c_custkey, c_custkey * 7 % 240 AS x0, CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE -1 END * (c_custkey % 23 + 1) AS dx, c_custkey * 11 % 135 AS y0, CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE -1 END * (c_custkey % 9 + 1) AS dy, c_custkey % 90 AS tick FROM customer),
m AS (SELECT c_custkey, 0 AS n, x0 AS x, dx, y0 AS y, dy, tick FROM v
  UNION ALL SELECT c_custkey, n + 1, least(239, greatest(0, x + dx)), CASE WHEN x + dx <= 0 THEN abs(dx) WHEN x + dx >= 239 THEN -abs(dx) ELSE dx END, least(134, greatest(0, y + dy)), CASE WHEN y + dy <= 0 THEN abs(dy) WHEN y + dy >= 134 THEN -abs(dy) ELSE dy END, tick FROM m WHERE n < tick)
SELECT c_custkey, x, y FROM m WHERE n = tick
""")
def bounced_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where points that bounce off the edges of a screen are at some tick, each at another."""
    k = F.col("c_custkey")
    at = lambda start, speed, most: bounced(start, speed, F.lit(most).cast("long"), k % 90)
    dx, dy = F.when(k % 2 == 0, 1).otherwise(-1) * (k % 23 + 1), F.when(k % 3 == 0, 1).otherwise(-1) * (k % 9 + 1)
    return table(spark, sf_dir, "customer").select("c_custkey", at(k * 7 % 240, dx, 239).alias("x"), at(k * 11 % 135, dy, 134).alias("y"))


@query("""
WITH g AS (SELECT *, sum(CASE WHEN before IS NULL OR ts > before + INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS burst
  FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events))
SELECT user_id, epoch_us(min(ts)) AS first, epoch_us(max(ts) + INTERVAL 6 HOUR) AS until, count(*) AS requests FROM g GROUP BY user_id, burst
""")
def coalesced_rebuilds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One rebuild for each burst of requests."""
    b = iv.bursts(table(spark, sf_dir, "events"), "user_id", "ts", "6 hours")
    return b.select("user_id", _micros("first").alias("first"), _micros("until").alias("until"), "requests")


@query("""
WITH e AS (SELECT epoch(date_trunc('second', ts))::BIGINT // 3600 AS drain, user_id % 4 AS queue, event_type = 'error' AS stop, ts, event_id FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY drain, queue ORDER BY ts, event_id) AS place FROM e)
SELECT drain, queue, count(*) AS sent, count(*) FILTER (place <= 8) AS taken, count(*) FILTER (place > 8) AS dropped,
  max(place) FILTER (place <= 8) - coalesce(max(place) FILTER (place <= 8 AND stop), 0) AS played FROM n GROUP BY 1, 2
""")
def queue_drains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages to queues of eight places that are emptied every hour: how many were sent, taken up
    and dropped, and how many play on after the last that stops all."""
    e = table(spark, sf_dir, "events").select(_units("ts", 3_600_000_000).alias("drain"), (F.col("user_id") % 4).alias("queue"), "ts", "event_id", "event_type")
    return iv.drained(e, ["drain", "queue"], ["ts", "event_id"], 8, F.col("event_type") == "error")


@query("""
WITH e AS (SELECT user_id, event_id, ts, (epoch_us(ts) // 1000 * 37 % 4294967296) AS clock FROM events),
d AS (SELECT *, coalesce((clock - lag(clock) OVER w + 4294967296) % 4294967296, 0) AS passed FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(passed) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS t FROM d)
SELECT user_id, event_id, (t // 1000 - coalesce(lag(t // 1000) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0))::BIGINT AS steps, (t % 1000)::BIGINT AS rest FROM s
""")
def elapsed_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole seconds between events on a clock of 32 bits, what is left of a second being kept
    for the next event."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", (_units("ts", 1000) * 37 % (1 << 32)).alias("clock"))
    return iv.whole_steps(e, "user_id", ["ts", "event_id"], "clock", 1000).select("user_id", "event_id", "steps", "rest")


@query("""
SELECT epoch_us(ts) // 1800000000 AS tick, count(*) AS n FROM events GROUP BY 1
""")
def render_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many events each half hour has, as a view that is drawn at a fixed pace shows them."""
    return fold.ticks(table(spark, sf_dir, "events"), 1800, late=None).select(_units("start", 1_800_000_000).alias("tick"), "n")
