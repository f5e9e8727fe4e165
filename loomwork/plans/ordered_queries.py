"""Upserts, lookups, rankings, rings and running sums over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import ordered as op
from .registry import query, table


@query("""
SELECT c_custkey, arg_max(o_orderpriority, o_orderkey) AS o_orderpriority, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus
FROM (SELECT o_custkey AS c_custkey, * FROM orders) GROUP BY c_custkey
""")
def keyed_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last row of each key wins (manifest of ids, preferences)."""
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return op.last_wins(o, ["c_custkey"], F.col("o_orderkey"), ["o_orderpriority", "o_orderstatus"])


@query("""
WITH m AS (SELECT l_orderkey AS k, arg_max(l_partkey, (l_linenumber, l_partkey)) AS part FROM lineitem GROUP BY 1)
SELECT o_orderkey, coalesce(m.part, -1) AS part FROM orders LEFT JOIN m ON o_orderkey = k
""")
def spine_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A spine of ids with its manifest's entries, the last of equal ids; a default where there is none."""
    m = op.last_wins(table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey"), ["o_orderkey"], F.struct("l_linenumber", "l_partkey"), ["l_partkey"])
    return table(spark, sf_dir, "orders").select("o_orderkey").join(m, "o_orderkey", "left").select("o_orderkey", F.coalesce("l_partkey", F.lit(-1).cast("long")).alias("part"))


@query("""
SELECT p_partkey, min(l_orderkey) AS first_order FROM part LEFT JOIN lineitem ON p_partkey = l_partkey GROUP BY p_partkey
""")
def first_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each contents entry the first position where it occurs, if any."""
    places = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), F.col("l_orderkey").alias("first_order"))
    return op.first_match(table(spark, sf_dir, "part").select("p_partkey"), places, "p_partkey", "first_order")


@query("""
SELECT l_orderkey, coalesce(arg_min(l_partkey, (l_linenumber, l_partkey)) FILTER (l_returnflag = 'R'), arg_min(l_partkey, (l_linenumber, l_partkey)) FILTER (l_linestatus = 'F'), -1) AS cover
FROM lineitem GROUP BY 1
""")
def cover_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One entry of each book: the first preferred, else the first that falls back."""
    li = table(spark, sf_dir, "lineitem")
    pick = lambda cond: F.min_by(F.when(cond, F.col("l_partkey")), F.when(cond, F.struct("l_linenumber", "l_partkey")))
    return li.groupBy("l_orderkey").agg(F.coalesce(pick(F.col("l_returnflag") == "R"), pick(F.col("l_linestatus") == "F"), F.lit(-1).cast("long")).alias("cover"))


@query("""
SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey
""")
def lookup_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two lookups one after the other (key to button to code)."""
    n = table(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
    r = table(spark, sf_dir, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    # both tables have a fixed number of rows at every scale
    return table(spark, sf_dir, "customer").join(F.broadcast(n), "c_nationkey", "left").join(F.broadcast(r), "n_regionkey", "left").select("c_custkey", "n_name", "r_name")


@query("""
WITH kv AS (SELECT c_mktsegment AS k, max(c_nationkey) AS v FROM customer WHERE c_mktsegment < 'H' GROUP BY 1)
SELECT c_custkey, coalesce(v, -1)::INTEGER AS c_nationkey FROM customer LEFT JOIN kv ON c_mktsegment = k
""")
def preference_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A key-value store read with a default."""
    c = table(spark, sf_dir, "customer")
    store = c.filter("c_mktsegment < 'H'").select(F.col("c_mktsegment").alias("k"), "c_nationkey")
    return op.keyed_lookup(c.select("c_custkey", "c_mktsegment"), store, "c_mktsegment", "k", "c_nationkey", -1).select("c_custkey", "c_nationkey")


@query("""
SELECT s_suppkey, s_name, min(c_custkey) AS child FROM supplier JOIN customer ON s_nationkey = c_nationkey AND c_mktsegment = 'BUILDING'
WHERE s_acctbal > 0 GROUP BY 1, 2
""")
def device_child(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parents that fit, each with its first child that fits."""
    kids = table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").groupBy(F.col("c_nationkey").alias("s_nationkey")).agg(F.min("c_custkey").alias("child"))
    return table(spark, sf_dir, "supplier").filter("s_acctbal > 0").join(kids, "s_nationkey").select("s_suppkey", "s_name", "child")


@query("""
SELECT user_id, event_id, value, rank::INTEGER AS rank FROM (
  SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank FROM events) WHERE rank <= 5
""")
def last_five(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last five records of each key, the newest first."""
    e = table(spark, sf_dir, "events")
    return op.last_n(e, ["user_id"], [F.desc("ts"), F.desc("event_id")], 5).select("user_id", "event_id", "value", "rank")


@query("""
SELECT user_id, event_id, string_agg(event_type, ',') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS ring FROM events
""")
def ring_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With each event the last eight types of its user, the oldest first."""
    return op.ring(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type", 8).select("user_id", "event_id", F.array_join("ring", ",").alias("ring"))


@query("""
WITH e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, event_type FROM events)
SELECT a.user_id, a.event_id, (a.n - b.n)::INTEGER AS age, b.event_type AS at_event_type, greatest(25, 255 - floor((a.n - b.n) * 230 / 8))::INTEGER AS brightness
FROM e a JOIN e b ON a.user_id = b.user_id AND b.n BETWEEN a.n - 7 AND a.n
""")
def fading_trail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event with those before it, dimmer with age."""
    return op.trail(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), ["user_id"], ["event_id"], ["event_type"])


@query("""
SELECT l_orderkey, l_linenumber, (sum(CASE WHEN n = 1 THEN 0 ELSE q END) OVER (PARTITION BY l_orderkey ORDER BY n))::BIGINT AS start
FROM (SELECT *, l_quantity::BIGINT AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS n FROM lineitem)
""")
def sequence_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each note of a sequence starts, given its delay after the one before."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("long").alias("q"))
    return op.start_offsets(li, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "q"], "q").select("l_orderkey", "l_linenumber", "start")


@query("""
SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER w AS before, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
WHERE n = 1 OR event_type IS DISTINCT FROM before
""")
def pin_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the events whose type differs from the user's event before."""
    return op.changes(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type").select("user_id", "event_id", "event_type")


@query("""
SELECT user_id, event_id, sum(d) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS total, -sum(d) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS negated
FROM (SELECT *, trunc(value)::BIGINT // 4 AS d FROM events)
""")
def encoder_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running sums of quarter steps, and their negatives (scrolling)."""
    e = table(spark, sf_dir, "events").withColumn("d", F.expr("cast(value as bigint) div 4"))
    return op.running_sum(e, ["user_id"], ["ts", "event_id"], F.col("d"), "total").select("user_id", "event_id", "total", (-F.col("total")).alias("negated"))


@query("""
SELECT user_id, event_id, before, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
WHERE before <> event_type
""")
def stage_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each change from one stage to another, with both."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events").withColumn("before", F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    return e.filter("before <> event_type").select("user_id", "event_id", "before", "event_type")


@query("""
WITH e AS (SELECT user_id, event_type, event_id, ts, floor(value)::BIGINT AS score FROM events)
SELECT user_id, event_type, event_id, score, score > coalesce(max(score) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS is_record,
  max(score) OVER (w ROWS UNBOUNDED PRECEDING) AS best FROM e WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)
""")
def high_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best score so far per player and game, and which events set it."""
    e = table(spark, sf_dir, "events").withColumn("score", F.floor("value"))
    return op.records(e, ["user_id", "event_type"], ["ts", "event_id"], "score").select("user_id", "event_type", "event_id", "score", "is_record", "best")


@query("""
SELECT user_id, max(score) AS best, count(*) AS games, count(DISTINCT event_type) AS variants FROM (SELECT *, floor(value)::BIGINT AS score FROM events) GROUP BY 1
""")
def score_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max(F.floor("value")).alias("best"), F.count("*").alias("games"), F.countDistinct("event_type").alias("variants"))


@query("""
SELECT l_orderkey, count(*) FILTER (l_returnflag = 'N') AS left_over,
  CASE WHEN count(*) FILTER (l_returnflag = 'N') = 0 THEN 'all done' WHEN count(*) FILTER (l_returnflag = 'N') = 1 THEN '1 item left' ELSE count(*) FILTER (l_returnflag = 'N') || ' items left' END AS label
FROM lineitem GROUP BY 1
""")
def count_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many items of a list are not done, and its label."""
    n = F.count_if(F.col("l_returnflag") == "N")
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(n.alias("left_over")).withColumn("label", tx.plural(F.col("left_over"), "item left", "items left", "all done"))


@query("""
SELECT l_orderkey, CASE WHEN count(DISTINCT l_returnflag) = 1 THEN min(l_returnflag) END AS version, array_to_string(list_sort(list(DISTINCT l_returnflag)), ',') AS versions FROM lineitem GROUP BY 1
""")
def single_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one value all rows of a key share, null if they differ, and all of them."""
    versions = F.sort_array(F.collect_set("l_returnflag"))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(versions.alias("v")).select("l_orderkey", F.when(F.size("v") == 1, F.col("v")[0]).alias("version"), F.array_join("v", ",").alias("versions"))


@query("""
SELECT l_orderkey, string_agg(l_partkey::VARCHAR, '|' ORDER BY l_linenumber) AS frames FROM
(SELECT l_orderkey, l_linenumber, max(l_partkey) AS l_partkey FROM lineitem GROUP BY 1, 2) GROUP BY 1
""")
def ordered_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frames of a group in the order of their index; gaps close, of equal indices one stays."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_partkey").alias("p"))
    return li.groupBy("l_orderkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "p"))), lambda x: x["p"].cast("string")), "|").alias("frames"))


@query("""
SELECT l_orderkey, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1)::INTEGER AS idx, l_partkey FROM lineitem WHERE l_returnflag <> 'R'
""")
def compact_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Done rows out, the others numbered anew in their order."""
    li = table(spark, sf_dir, "lineitem").filter("l_returnflag <> 'R'")
    return op.reindexed(li, ["l_orderkey"], ["l_linenumber", "l_partkey"]).select("l_orderkey", "idx", "l_partkey")


@query("""
SELECT p_name, p_partkey, p_size FROM part ORDER BY p_size > 25, p_name, p_partkey
""")
def browser_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directories first, then names in byte order."""
    return table(spark, sf_dir, "part").orderBy(F.col("p_size") > 25, "p_name", "p_partkey").select("p_name", "p_partkey", "p_size")


@query("""
SELECT p_partkey, p_name FROM part ORDER BY lower(p_name), p_name, p_partkey LIMIT 8 OFFSET 16
""")
def shelf_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third page of eight, ordered without regard to case."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return op.page(p, [F.lower("p_name"), F.col("p_name"), F.col("p_partkey")], 2, 8, p.count())


@query("""
SELECT p_partkey, p_brand FROM part ORDER BY p_partkey = 7, p_brand, p_partkey
""")
def index_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upload order: the index after all others."""
    return table(spark, sf_dir, "part").orderBy(F.col("p_partkey") == 7, "p_brand", "p_partkey").select("p_partkey", "p_brand")


@query("""
SELECT c_nationkey, (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_name, c_custkey) - 1)::INTEGER AS idx, c_name AS option FROM customer
""")
def option_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of each list in their order; no list is gathered in one value."""
    c = table(spark, sf_dir, "customer").select("c_nationkey", "c_name", "c_custkey")
    return op.numbered(c, "c_nationkey", ["c_name", "c_custkey"]).select("c_nationkey", F.col("idx").cast("int").alias("idx"), F.col("c_name").alias("option"))


@query("""
SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events WHERE event_type <> 'error' GROUP BY 1
""")
def newest_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each user's results only the newest counts; older ones are stale."""
    return op.last_wins(table(spark, sf_dir, "events").filter("event_type <> 'error'"), ["user_id"], F.struct("ts", "event_id"), ["event_id"])


@query("""
SELECT user_id, bit_or(CASE WHEN value > 50 THEN 1 ELSE 0 END | CASE WHEN event_type = 'purchase' THEN 2 ELSE 0 END | CASE WHEN value < 1 THEN 4 ELSE 0 END)::INTEGER AS bits,
  count(*) FILTER (event_type = 'click') >= 10 AS ten_clicks FROM events GROUP BY 1
""")
def achievements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule bits over all snapshots of a key, and a counter that reaches ten."""
    rule = lambda cond, bit: F.when(cond, F.lit(bit)).otherwise(F.lit(0))
    bits = rule(F.col("value") > 50, 1).bitwiseOR(rule(F.col("event_type") == "purchase", 2)).bitwiseOR(rule(F.col("value") < 1, 4))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.bit_or(bits).alias("bits"), (F.count_if(F.col("event_type") == "click") >= 10).alias("ten_clicks"))


@query("""
SELECT p_name, p_partkey, 'built-in' AS origin FROM part WHERE p_size < 3 UNION ALL SELECT s_name, s_suppkey, 'scanned' FROM supplier
""")
def script_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Built-in rows, then scanned ones."""
    a = table(spark, sf_dir, "part").filter("p_size < 3").select("p_name", "p_partkey", F.lit("built-in").alias("origin"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("p_name"), F.col("s_suppkey").alias("p_partkey"), F.lit("scanned").alias("origin"))
    return a.unionByName(b)
