"""Bits, colours, tones, times and small rules over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import audio, bits, colour
from ..functions import text as tx
from ..streaming import fold
from .registry import query, table

_COLOURS = "SELECT l_orderkey, l_linenumber, (l_partkey % 256)::INTEGER AS r, (l_suppkey * 7 % 256)::INTEGER AS g, (l_orderkey % 256)::INTEGER AS b FROM lineitem"


def _colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 256).cast("int").alias("r"), (F.col("l_suppkey") * 7 % 256).cast("int").alias("g"), (F.col("l_orderkey") % 256).cast("int").alias("b"))


@query(f"""
WITH c AS ({_COLOURS}), v AS (SELECT *, ((r >> 3) << 11) | ((g >> 2) << 5) | (b >> 3) AS v FROM c)
SELECT l_orderkey, l_linenumber, v AS rgb565, ((b >> 3) << 11) | ((g >> 2) << 5) | (r >> 3) AS bgr565,
  CASE WHEN l_linenumber * 40 < 128 THEN 63519 WHEN v = 63519 THEN 63518 ELSE v END AS sprite,
  ((v >> 11 & 31) << 3) | ((v >> 11 & 31) >> 2) AS r8, ((v >> 5 & 63) << 2) | ((v >> 5 & 63) >> 4) AS g8, ((v & 31) << 3) | ((v & 31) >> 2) AS b8,
  ((r + g + b // 3) & 255)::INTEGER AS mono FROM v
""")
def pixel_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colours to 16 bits and back, with the see-through key and the monochrome byte."""
    c = _colours(spark, sf_dir)
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    v = c.withColumn("v", colour.to_565(r, g, b))
    r8, g8, b8 = colour.from_565(F.col("v"))
    return v.select(
        "l_orderkey", "l_linenumber", F.col("v").alias("rgb565"), colour.to_bgr_565(r, g, b).alias("bgr565"),
        colour.sprite_565(r, g, b, F.col("l_linenumber") * 40).alias("sprite"), r8.alias("r8"), g8.alias("g8"), b8.alias("b8"), colour.grey_byte(r, g, b).alias("mono"),
    )


@query("""
WITH x AS (SELECT p_partkey, unnest(range(0, 16))::INTEGER AS x, (p_size % 256)::INTEGER AS low FROM part)
SELECT p_partkey, x, floor(low + (255 - low) * x / 15)::INTEGER AS level, CASE WHEN x < 16 // 3 THEN 'r' WHEN x < 2 * 16 // 3 THEN 'g' ELSE 'b' END AS third FROM x
""")
def colour_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fade of 16 places for each row, and the thirds of a test row."""
    x = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") % 256).alias("low"), F.explode(F.sequence(F.lit(0), F.lit(15))).alias("x"))
    third = F.when(F.col("x") < 5, "r").when(F.col("x") < 10, "g").otherwise("b")
    return x.select("p_partkey", "x", colour.ramp(F.col("x"), 16, F.col("low"), F.lit(255)).alias("level"), third.alias("third"))


@query("""
WITH g AS (SELECT s_suppkey, 8 + s_suppkey % 5 AS w, 6 + s_suppkey % 4 AS h FROM supplier),
c AS (SELECT s_suppkey, w, h, x, unnest(range(0, h)) AS y FROM (SELECT *, unnest(range(0, w)) AS x FROM g)),
d AS (SELECT *, sqrt(pow((x - (w - 1) / 2.0) / (w / 2.0), 2) + pow((y - (h - 1) / 2.0) / (h / 2.0), 2)) AS d FROM c)
SELECT s_suppkey, count(*) FILTER (d <= 0.85) AS filled, count(*) FILTER (d > 0.85 AND d <= 1) AS rim, count(*) AS cells FROM d GROUP BY 1
""")
def oval_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many cells of an oval mask are inside and on its rim."""
    g = table(spark, sf_dir, "supplier").select("s_suppkey", (F.lit(8) + F.col("s_suppkey") % 5).alias("w"), (F.lit(6) + F.col("s_suppkey") % 4).alias("h"))
    c = g.withColumn("x", F.explode(F.sequence(F.lit(0).cast("long"), F.col("w") - 1))).withColumn("y", F.explode(F.sequence(F.lit(0).cast("long"), F.col("h") - 1)))
    dx = (F.col("x") - (F.col("w") - 1) / 2) / (F.col("w") / 2)
    dy = (F.col("y") - (F.col("h") - 1) / 2) / (F.col("h") / 2)
    d = F.sqrt(F.pow(dx, 2) + F.pow(dy, 2))
    return c.withColumn("d", d).groupBy("s_suppkey").agg(F.count_if(F.col("d") <= 0.85).alias("filled"), F.count_if((F.col("d") > 0.85) & (F.col("d") <= 1)).alias("rim"), F.count("*").alias("cells"))


@query("""
SELECT l_orderkey, l_linenumber, n AS note, round(CASE WHEN n = 0 THEN 0 ELSE 440 * pow(2, (least(n, 127) - 69) / 12.0) END, 6) AS hz, (ms * 16000 // 1000)::BIGINT AS samples
FROM (SELECT l_orderkey, l_linenumber, (l_partkey % 140)::INTEGER AS n, l_quantity::INTEGER AS ms FROM lineitem)
""")
def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes to frequencies, lengths to samples."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 140).cast("int").alias("note"), F.col("l_quantity").cast("int").alias("ms"))
    return li.select("l_orderkey", "l_linenumber", "note", F.round(audio.note_to_hz(F.col("note")), 6).alias("hz"), audio.ms_to_samples(F.col("ms")).alias("samples"))


@query("""
WITH x AS (SELECT event_id, ['square', 'pulse25', 'pulse12', 'pulse75', 'triangle', 'saw', 'sine'][1 + event_id % 7] AS kind, (event_id * 37 % 100) / 100.0::DOUBLE AS p FROM events)
SELECT event_id, kind, round(CASE kind WHEN 'square' THEN CASE WHEN p < 0.5 THEN 1.0 ELSE -1.0 END WHEN 'pulse25' THEN CASE WHEN p < 0.25 THEN 1.0 ELSE -1.0 END
  WHEN 'pulse12' THEN CASE WHEN p < 0.125 THEN 1.0 ELSE -1.0 END WHEN 'pulse75' THEN CASE WHEN p < 0.75 THEN 1.0 ELSE -1.0 END
  WHEN 'triangle' THEN 4 * abs(p - 0.5) - 1 WHEN 'saw' THEN 2 * p - 1 ELSE sin(2 * pi() * p) END, 6)::DOUBLE AS level FROM x
""")
def waveforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels of the seven shapes at a phase."""
    kinds = F.array(*[F.lit(k) for k in ("square", "pulse25", "pulse12", "pulse75", "triangle", "saw", "sine")])
    x = table(spark, sf_dir, "events").select("event_id", F.element_at(kinds, (F.col("event_id") % 7 + 1).cast("int")).alias("kind"), ((F.col("event_id") * 37 % 100) / 100).alias("p"))
    return x.select("event_id", "kind", F.round(audio.wave(F.col("kind"), F.col("p")), 6).alias("level"))


@query("""
WITH e AS (SELECT event_id, 1 + event_id % 60 AS pos, event_id % 7 * 8 AS length, event_id % 5 * 3 AS attack, event_id % 4 * 5 AS decay, event_id % 3 * 0.25::DOUBLE AS s, event_id % 6 * 4 AS release FROM events),
h AS (SELECT *, greatest(attack, 1) AS a, greatest(decay, 1) AS d, greatest(greatest(attack, 1) + greatest(decay, 1) + 1, length + 1) AS held FROM e)
SELECT event_id, round(CASE WHEN pos <= a THEN CASE WHEN attack > 0 THEN pos / attack::DOUBLE ELSE 1 END WHEN pos <= a + d THEN CASE WHEN decay > 0 THEN 1 - (pos - a) / decay::DOUBLE * (1 - s) ELSE s END
    WHEN length = 0 OR pos <= held THEN s WHEN pos - held < release THEN s * (1 - (pos - held) / release::DOUBLE) ELSE 0 END, 6)::DOUBLE AS gain,
  round(CASE WHEN length > 0 AND pos - 1 > length THEN 0 WHEN pos < attack THEN least(1.5, 2 - pos / attack::DOUBLE) ELSE 1 END, 6)::DOUBLE AS punch,
  round(CASE WHEN pos < attack THEN pow(pos / attack::DOUBLE, 2) WHEN pos < attack + decay THEN 1 - (pos - attack) / decay::DOUBLE ELSE 0 END, 6)::DOUBLE AS flare,
  round(CASE WHEN length = 0 THEN 1 WHEN pos - 1 > length THEN 0 ELSE (pos - 1) / length::DOUBLE END, 6)::DOUBLE AS swell,
  round(CASE WHEN pow(0.992, pos * 20) < 0.001 THEN 0 ELSE pow(0.992, pos * 20) END, 6)::DOUBLE AS twang,
  round(CASE WHEN length = 0 OR pos - 1 > length THEN 0 ELSE 1 - (pos - 1) / length::DOUBLE END, 6)::DOUBLE AS decay
FROM h
""")
def envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gains of the four phases and of the five effects' shapes at a sample."""
    i, x = F.col("event_id"), table(spark, sf_dir, "events")
    at, length, attack, decay = i % 60 + 1, i % 7 * 8, i % 5 * 3, i % 4 * 5
    shape = lambda kind, at: F.round(audio.effect_envelope(F.lit(kind), at, length, attack, decay), 6).alias(kind)
    gain = audio.envelope(at, length, attack, decay, i % 3 * F.lit(0.25), i % 6 * 4)
    return x.select("event_id", F.round(gain, 6).alias("gain"), shape("punch", at), shape("flare", at), shape("swell", at), shape("twang", at * 20), shape("decay", at))


@query("""
SELECT event_id, round(440 * pow(2, CASE WHEN depth > 0 AND rate > 0 THEN sin(2 * pi() * pos * rate / 16000) * depth ELSE 0 END / 12) * pow(2, sweep * pos / 16000.0 / 12), 5)::DOUBLE AS hz
FROM (SELECT event_id, event_id % 4000 AS pos, event_id % 3 * 0.5::DOUBLE AS depth, (event_id % 4 * 2)::DOUBLE AS rate, (event_id % 5 - 2)::DOUBLE AS sweep FROM events)
""")
def voice_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A voice's frequency with vibrato and sweep."""
    i = F.col("event_id")
    hz = audio.bent_hz(F.lit(440.0), i % 4000, i % 3 * F.lit(0.5), (i % 4 * 2).cast("double"), (i % 5 - 2).cast("double"))
    return table(spark, sf_dir, "events").select("event_id", F.round(hz, 5).alias("hz"))


@query("""
WITH x AS (SELECT event_id, value / 37 - 1.2 AS x, 1 + event_id % 4 AS n FROM events), g AS (SELECT *, CASE WHEN n > 1 AND abs(x) > 0.95 THEN x * greatest(0.3, 1 - (abs(x) - 0.95) / (1 + n * 0.25)) ELSE x END AS g FROM x),
l AS (SELECT *, CASE WHEN abs(g) <= 0.96 THEN g WHEN abs(g) >= 0.98 THEN sign(g) * 0.98 ELSE sign(g) * (0.96 + 0.02 * tanh((abs(g) - 0.96) / 0.02)) END AS l FROM g)
SELECT event_id, gated, limited, trunc(s3)::INTEGER AS sample FROM (SELECT event_id, round(g, 5) AS gated, round(l, 5) AS limited, round((greatest(-1, least(1, l)) * 1.5 - pow(greatest(-1, least(1, l)), 3) * 0.5) * 28000, 3) AS s3 FROM l)
""")
def mix_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gate, limiter and soft clip of a mix."""
    x = table(spark, sf_dir, "events").select("event_id", (F.col("value") / 37 - 1.2).alias("x"), (F.col("event_id") % 4 + 1).alias("n"))
    g = x.withColumn("g", audio.gate(F.col("x"), F.col("n"))).withColumn("l", audio.limit(F.col("g")))
    return g.select("event_id", F.round("g", 5).alias("gated"), F.round("l", 5).alias("limited"), audio.soft_clip(F.col("l")).alias("sample"))


@query("""
WITH s AS (SELECT l_orderkey, l_linenumber, l_quantity AS q, l_discount AS d FROM lineitem)
SELECT l_orderkey, round(sum(q * d), 4) AS mixed, count(*) FILTER (d > 0) AS active FROM s GROUP BY 1
""")
def voice_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sum of the voices of a moment and how many sound."""
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.round(F.sum(F.col("l_quantity") * F.col("l_discount")), 4).alias("mixed"), F.count_if(F.col("l_discount") > 0).alias("active"))


@query("""
WITH RECURSIVE e AS (SELECT user_id, value / 100 AS x, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
g(user_id, n, square, gain) AS (SELECT user_id, 0::BIGINT, 0.0::DOUBLE, 1.0::DOUBLE FROM (SELECT DISTINCT user_id FROM events)
  UNION ALL SELECT e.user_id, e.n, g.square * 0.999 + e.x * e.x * (1 - 0.999), CASE WHEN e.n % 16 <> 0 THEN g.gain WHEN g.square * 0.999 + e.x * e.x * (1 - 0.999) < 0.001 THEN 1.0
    ELSE greatest(0.5, least(1.5, 0.35 / sqrt(g.square * 0.999 + e.x * e.x * (1 - 0.999)))) END FROM g JOIN e ON e.user_id IS NOT DISTINCT FROM g.user_id AND e.n = g.n + 1)
SELECT user_id, round(arg_max(gain, n), 6) AS gain, max(n) AS n FROM g GROUP BY 1
""")
def smoothed_gains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gain after each user's ordered samples: a fold that carries one state."""
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", (F.col("value") / 100).alias("x"))

    def step(state, row):
        square, gain, n = audio.gain_step(state, row.x)
        return (square, gain, n), [(row.user_id, gain, n)]

    gains = fold.fold(e, ["user_id"], ["ts", "event_id"], step, "user_id long, gain double, n long")
    return gains.groupBy("user_id").agg(F.round(F.max_by("gain", "n"), 6).alias("gain"), F.max("n").alias("n"))


@query("""
SELECT event_id, 144 | (event_id % 16)::INTEGER AS status, (user_id % 200)::INTEGER & 127 AS a, value::INTEGER & 127 AS b,
  (greatest(0, least(16383, (event_id % 20000)::INTEGER - 10000 + 8192)) & 127) AS bend_low, (greatest(0, least(16383, (event_id % 20000)::INTEGER - 10000 + 8192)) >> 7) & 127 AS bend_high
FROM (SELECT event_id, user_id, trunc(value) AS value FROM events)
""")
def channel_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channel messages: a note and a bend."""
    e = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 16).cast("int").alias("ch"), (F.col("user_id") % 200).cast("int").alias("k"), F.col("value").cast("int").alias("v"), ((F.col("event_id") % 20000).cast("int") - 10000).alias("bend"))
    m = e.select("event_id", audio.midi_bytes(0x90, F.col("ch"), F.col("k"), F.col("v")).alias("m"), audio.bend_bytes(F.col("ch"), F.col("bend")).alias("w"))
    return m.select("event_id", F.col("m")[0].alias("status"), F.col("m")[1].alias("a"), F.col("m")[2].alias("b"), F.col("w")[1].alias("bend_low"), F.col("w")[2].alias("bend_high"))


@query("""
SELECT l_orderkey, l_linenumber, bit_count((l_partkey & 4095)::BIGINT)::INTEGER AS unlocked, (l_partkey >> 3) & 1 = 1 AS third, (l_partkey::INTEGER | 32) AS with_five, (1 << (l_linenumber % 8))::INTEGER AS mask,
  (3 + l_partkey + l_suppkey) & 255 AS checksum, l_partkey % 65536 AS wrapped,
  CASE WHEN (l_partkey % 256) + (l_suppkey % 256) * 256 >= 32768 THEN (l_partkey % 256) + (l_suppkey % 256) * 256 - 65536 ELSE (l_partkey % 256) + (l_suppkey % 256) * 256 END AS signed16 FROM lineitem
""")
def bit_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, p = table(spark, sf_dir, "lineitem"), F.col("l_partkey")
    return li.select(
        "l_orderkey", "l_linenumber", bits.bits_set(p, 12).alias("unlocked"), bits.has_bit(p, 3).alias("third"), bits.with_bit(p.cast("int"), 5).alias("with_five"), bits.one_hot(F.col("l_linenumber") % 8).alias("mask"),
        bits.sum_mod_256(F.lit(3), p, F.col("l_suppkey")).alias("checksum"), bits.wrap(p, 16).alias("wrapped"), bits.little_endian_signed(p % 256, F.col("l_suppkey") % 256).alias("signed16"),
    )


@query("""
SELECT l_orderkey, bit_xor((l_partkey % 256)::INTEGER) AS bcc, (sum(l_partkey) & 255)::BIGINT AS total FROM lineitem GROUP BY 1
""")
def checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Xor and additive checksums of each group's bytes."""
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.bit_xor((F.col("l_partkey") % 256).cast("int")).alias("bcc"), F.sum("l_partkey").bitwiseAND(F.lit(255)).alias("total"))


@query("""
SELECT event_id, i AS button, ((event_id >> i) & 1)::INTEGER AS pressed FROM (SELECT event_id, unnest(range(0, 8))::INTEGER AS i FROM events)
""")
def button_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each button of a bit mask."""
    return table(spark, sf_dir, "events").select("event_id", F.posexplode(bits.bit_array(F.col("event_id"), 8)).alias("button", "pressed"))


@query("""
WITH RECURSIVE g(k, n, x) AS (SELECT s_suppkey, 0, s_suppkey FROM supplier UNION ALL SELECT k, n + 1, (x * 1103515245 + 12345) % 4294967296 FROM g WHERE n < 10)
SELECT k AS s_suppkey, x::BIGINT AS state FROM g WHERE n = 10
""")
def seeded_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seeded generator after ten steps."""
    return table(spark, sf_dir, "supplier").select("s_suppkey", bits.lcg(F.col("s_suppkey"), 1103515245, 12345, F.lit(10)).alias("state"))


@query("""
WITH RECURSIVE g(k, n, x, y) AS (SELECT s_suppkey, 0, s_suppkey + 1, s_suppkey + 1 FROM supplier
  UNION ALL SELECT k, n + 1, (x >> 1) | ((xor(xor(xor(x & 1, x >> 2 & 1), x >> 3 & 1), x >> 5 & 1)) << 15), (y >> 1) | (xor(y & 1, y >> 1 & 1) << 14) FROM g WHERE n < 20)
SELECT k AS s_suppkey, x::BIGINT AS state, y::BIGINT AS retro, CASE WHEN x & 1 = 1 THEN 1.0 ELSE -1.0 END::DOUBLE AS noise, CASE WHEN y & 1 = 1 THEN 1.0 ELSE -1.0 END::DOUBLE AS retro_noise FROM g WHERE n = 20
""")
def shift_register_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two noises' shift registers after twenty steps, and their levels."""
    x, y = (bits.shift_register(F.col("s_suppkey") + 1, *kind, F.lit(20)) for kind in (audio.NOISE, audio.RETRO_NOISE))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", x.alias("state"), y.alias("retro"))
    return s.select("*", audio.noise(F.col("state")).alias("noise"), audio.noise(F.col("retro")).alias("retro_noise"))


@query("""
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS stamp, age % 4294967296 AS age, CASE WHEN age % 3600 < 1800 THEN 'Day' ELSE 'Night' END AS phase, age // 3600 % 65536 AS hours,
  (age // 3600 % 65536) // 24 || 'd ' || (age // 3600 % 65536) % 24 || 'h' AS label, age > 3600 AS stale
FROM (SELECT *, o_orderkey * 997 AS age FROM orders)
""")
def clock_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stamps, wrapped ages, day phases and age labels."""
    o = table(spark, sf_dir, "orders").withColumn("age", F.col("o_orderkey") * 997).withColumn("hours", bits.wrap(F.floor(F.col("age") / 3600), 16))
    return o.select("o_orderkey", tx.iso_utc(F.col("o_orderdate")).alias("stamp"), bits.wrap(F.col("age"), 32).alias("age"), tx.day_phase(F.col("age")).alias("phase"), "hours", tx.age_label(F.col("hours")).alias("label"), (F.col("age") > 3600).alias("stale"))


@query("""
SELECT p_partkey, regexp_extract(p, '^(.*)/[^/]*$', 1) AS parent, regexp_replace(regexp_extract(p, '([^/]*)$', 1), '\\.[^.]*$', '') AS display, lower(regexp_extract(p, '(\\.[^./]*)$', 1)) AS ext,
  lower(regexp_extract(p, '(\\.[^./]*)$', 1)) IN ('.epub', '.txt') AS supported, '/lib' AS root, regexp_replace(trim(v), '-[^-]*$', '') AS version, p_brand || '-' || p_size || '.app' AS file
FROM (SELECT *, '/lib/' || p_brand || '/' || p_partkey || CASE p_partkey % 4 WHEN 0 THEN '.EPUB' WHEN 1 THEN '.txt' WHEN 2 THEN '.tar.gz' ELSE '' END AS p, p_size || '.0-dev' AS v FROM part)
""")
def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parent, display name, extension, root, version and file name."""
    ext = F.when(F.col("p_partkey") % 4 == 0, ".EPUB").when(F.col("p_partkey") % 4 == 1, ".txt").when(F.col("p_partkey") % 4 == 2, ".tar.gz").otherwise("")
    p = table(spark, sf_dir, "part").withColumn("p", F.concat(F.lit("/lib/"), "p_brand", F.lit("/"), F.col("p_partkey").cast("string"), ext))
    e = tx.extension(F.col("p"))
    return p.select(
        "p_partkey", tx.parent(F.col("p")).alias("parent"), tx.display_name(F.col("p")).alias("display"), e.alias("ext"), e.isin(".epub", ".txt").alias("supported"),
        tx.first_part(F.col("p"), "/sdcard").alias("root"), tx.without_suffix(F.concat(F.col("p_size").cast("string"), F.lit(".0-dev"))).alias("version"), tx.package_name(F.col("p_brand"), F.col("p_size")).alias("file"),
    )


@query("""
SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'OEBPS/Text/' || p_size WHEN 1 THEN 'OEBPS/Text/' || p_size WHEN 2 THEN p_size::VARCHAR WHEN 3 THEN '/x/../' || p_size ELSE 'OEBPS/b/' || p_size END AS path FROM part
""")
def resolved_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links resolved against their directory."""
    n = F.col("p_size").cast("string")
    href = F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("Text/"), n)).when(F.col("p_partkey") % 5 == 1, F.concat(F.lit("a/../Text/"), n)).when(F.col("p_partkey") % 5 == 2, F.concat(F.lit("../../"), n)).when(F.col("p_partkey") % 5 == 3, F.concat(F.lit("/x/../"), n)).otherwise(F.concat(F.lit("./b//"), n))
    return table(spark, sf_dir, "part").select("p_partkey", tx.resolved(F.lit("OEBPS"), href).alias("path"))


@query("""
SELECT o_orderkey, format('{:,}', trunc(o_totalprice)::BIGINT) AS price, array_to_string(regexp_extract_all(hex(encode(o_orderpriority)), '..'), ' ') AS bytes FROM orders
""")
def number_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thousands apart, bytes in hex."""
    return table(spark, sf_dir, "orders").select("o_orderkey", tx.thousands(F.col("o_totalprice").cast("long")).alias("price"), tx.hex_bytes(F.col("o_orderpriority")).alias("bytes"))


@query("""
SELECT event_id, CASE WHEN value <= 25 THEN 'GREAT' WHEN value <= 40 THEN 'Good' ELSE 'Slow' END AS rating,
  CASE WHEN r < 5 THEN 'life' WHEN r < 18 THEN 'laser' WHEN r < 33 THEN 'wide' WHEN r < 48 THEN 'slow' WHEN r < 63 THEN 'catch' WHEN r < 78 THEN 'split' ELSE 'none' END AS capsule,
  CASE WHEN value < 1 THEN 'dead' WHEN event_type = 'view' THEN 'asleep' WHEN event_type = 'error' THEN 'sick' WHEN value < 30 THEN 'sad' ELSE 'idle' END AS animation,
  CASE WHEN h < 1 THEN 'egg' WHEN h < 8 THEN 'baby' WHEN h < 24 THEN 'teen' WHEN h < 72 THEN 'adult' ELSE 'elder' END AS stage, CASE r % 5 WHEN 0 THEN 1 WHEN 2 THEN 4 ELSE 2 END AS multiplier,
  r > 2 OR (r = 2 AND h > 5) AS can_update, greatest(0, least(100, h - 40))::INTEGER AS clamped, greatest(60, 300 - 5 * r)::INTEGER AS period,
  CASE WHEN h < 32 THEN 4 WHEN h < 40 THEN 16 ELSE 0 END AS blocks
FROM (SELECT *, (event_id * 7 % 100)::INTEGER AS r, (event_id * 13 % 150)::INTEGER AS h FROM events)
""")
def rule_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratings, weighted rolls, precedences, thresholds, gates and clamps."""
    e = table(spark, sf_dir, "events").withColumn("r", (F.col("event_id") * 7 % 100).cast("int")).withColumn("h", (F.col("event_id") * 13 % 150).cast("int"))
    v, r, h, kind = F.col("value"), F.col("r"), F.col("h"), F.col("event_type")

    def below(c, steps, rest):
        out = F.when(c < steps[0][0], steps[0][1])
        for bound, name in steps[1:]:
            out = out.when(c < bound, name)
        return out.otherwise(rest)

    return e.select(
        "event_id", F.when(v <= 25, "GREAT").when(v <= 40, "Good").otherwise("Slow").alias("rating"),
        below(r, [(5, "life"), (18, "laser"), (33, "wide"), (48, "slow"), (63, "catch"), (78, "split")], "none").alias("capsule"),
        F.when(v < 1, "dead").when(kind == "view", "asleep").when(kind == "error", "sick").when(v < 30, "sad").otherwise("idle").alias("animation"),
        below(h, [(1, "egg"), (8, "baby"), (24, "teen"), (72, "adult")], "elder").alias("stage"), F.when(r % 5 == 0, 1).when(r % 5 == 2, 4).otherwise(2).alias("multiplier"), ((r > 2) | ((r == 2) & (h > 5))).alias("can_update"),
        F.greatest(F.lit(0), F.least(F.lit(100), h - 40)).alias("clamped"), F.greatest(F.lit(60), F.lit(300) - r * 5).alias("period"), F.when(h < 32, 4).when(h < 40, 16).otherwise(0).alias("blocks"),
    )


@query("""
SELECT event_id, array_to_string(list_filter([CASE WHEN value > 30 THEN 'found' END, CASE WHEN event_type = 'click' THEN 'visitor' END, CASE WHEN user_id % 2 = 0 THEN 'rain' END], lambda x : x IS NOT NULL), ',') AS eligible FROM events
""")
def eligible_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidates whose condition holds, in their order."""
    cand = F.array(F.struct((F.col("value") > 30).alias("ok"), F.lit("found").alias("n")), F.struct((F.col("event_type") == "click").alias("ok"), F.lit("visitor").alias("n")), F.struct((F.col("user_id") % 2 == 0).alias("ok"), F.lit("rain").alias("n")))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(F.transform(F.filter(cand, lambda c: c["ok"]), lambda c: c["n"]), ",").alias("eligible"))


@query("""
SELECT event_id, round(CASE WHEN sqrt(x * x + y * y) > 40 THEN x * 40 / sqrt(x * x + y * y) ELSE x END, 6) AS cx, round(CASE WHEN sqrt(x * x + y * y) > 40 THEN y * 40 / sqrt(x * x + y * y) ELSE y END, 6) AS cy,
  round(3 * cos(atan2(y, x)), 6) AS vx, round(3 * sin(atan2(y, x)), 6) AS vy
FROM (SELECT event_id, (event_id % 101 - 50)::DOUBLE AS x, (event_id % 83 - 41)::DOUBLE AS y FROM events)
""")
def stick_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors clamped to a circle, and rescaled to a speed."""
    e = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 101 - 50).cast("double").alias("x"), (F.col("event_id") % 83 - 41).cast("double").alias("y"))
    x, y = F.col("x"), F.col("y")
    d = F.sqrt(x * x + y * y)
    return e.select(
        "event_id", F.round(F.when(d > 40, x * 40 / d).otherwise(x), 6).alias("cx"), F.round(F.when(d > 40, y * 40 / d).otherwise(y), 6).alias("cy"),
        F.round(F.lit(3.0) * F.cos(F.atan2(y, x)), 6).alias("vx"), F.round(F.lit(3.0) * F.sin(F.atan2(y, x)), 6).alias("vy"),
    )


@query("""
SELECT b AS block, CASE WHEN b < 128 THEN b // 4 ELSE 32 + (b - 128) // 16 END::INTEGER AS sector FROM (SELECT range::INTEGER AS b FROM range(0, 256))
WHERE CASE WHEN b < 128 THEN b % 4 <> 3 ELSE b % 16 <> 15 END
""")
def data_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The data blocks of a card and their sectors."""
    b = F.col("block")
    blocks = spark.range(256).select(F.col("id").cast("int").alias("block")).filter(F.when(b < 128, b % 4 != 3).otherwise(b % 16 != 15))
    return blocks.select("block", F.when(b < 128, F.floor(b / 4)).otherwise(F.floor((b - 128) / 16) + 32).cast("int").alias("sector"))


@query("""
WITH c AS (SELECT p_partkey, (p_size % 32 + CASE WHEN p_partkey % 2 = 0 THEN 128 ELSE 0 END)::INTEGER AS sak, [18, 62, 109, 0, NULL][1 + p_partkey % 5] AS capability FROM part)
SELECT p_partkey, CASE sak & 127 WHEN 9 THEN 'classic mini' WHEN 8 THEN 'classic 1K' WHEN 24 THEN 'classic 4K'
  WHEN 0 THEN CASE capability WHEN 18 THEN 'tag 213' WHEN 62 THEN 'tag 215' WHEN 109 THEN 'tag 216' ELSE 'ultralight' END ELSE 'unknown' END AS card FROM c
""")
def card_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A card's kind by its code without the highest bit; for code 0 by the capability byte,
    which may be unreadable (null)."""
    k = F.col("p_partkey")
    code = (F.col("p_size") % 32 + F.when(k % 2 == 0, 128).otherwise(0)).cast("int").bitwiseAND(F.lit(127))
    capability = F.get(F.array(F.lit(0x12), F.lit(0x3E), F.lit(0x6D), F.lit(0), F.lit(None)), (k % 5).cast("int"))
    tag = F.when(capability == 0x12, "tag 213").when(capability == 0x3E, "tag 215").when(capability == 0x6D, "tag 216").otherwise("ultralight")
    kind = F.when(code == 0x09, "classic mini").when(code == 0x08, "classic 1K").when(code == 0x18, "classic 4K").when(code == 0, tag).otherwise("unknown")
    return table(spark, sf_dir, "part").select("p_partkey", kind.alias("card"))


@query("""
SELECT l_orderkey, l_linenumber, (y * w + x) * bytes AS offset_bytes, NOT level AS pressed FROM (SELECT l_orderkey, l_linenumber, l_partkey % 240 AS x, l_suppkey % 135 AS y, 240 AS w, l_returnflag = 'N' AS level,
  CASE l_linenumber % 4 WHEN 0 THEN 1 WHEN 1 THEN 3 ELSE 2 END AS bytes FROM lineitem)
""")
def pixel_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a pixel's bytes begin in a raster of its format; a pin that is active when low."""
    n = F.col("l_linenumber") % 4
    kind = F.when(n == 0, "mono").when(n == 1, "rgb888").otherwise("rgb565")
    at = (F.col("l_suppkey") % 135 * 240 + F.col("l_partkey") % 240) * colour.bytes_per_pixel(kind)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", at.alias("offset_bytes"), (~(F.col("l_returnflag") == "N")).alias("pressed"))
