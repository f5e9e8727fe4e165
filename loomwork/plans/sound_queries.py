"""Sound rendered to samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import voices
from .registry import query, table

#: Sequences of eight notes, a note for each customer: every third begins with the one before.
_NOTES = """SELECT c_custkey // 8 AS seq, c_custkey AS note, (c_custkey % 8 // 3 * 300)::BIGINT AS start, (160 + c_custkey % 5 * 64)::BIGINT AS length, 220.0 * pow(2.0, (c_custkey % 24)::DOUBLE / 12) AS freq,
  (c_custkey % 7 - 3)::DOUBLE * 12 AS sweep, (c_custkey % 4)::DOUBLE * 20 AS vib_rate, (c_custkey % 3)::DOUBLE * 0.5 AS vib_depth, CASE c_custkey % 4 WHEN 0 THEN 'square' WHEN 1 THEN 'saw' WHEN 2 THEN 'triangle' ELSE 'sine' END AS wave,
  (c_custkey % 3 * 16)::BIGINT AS attack, (c_custkey % 5 * 20)::BIGINT AS release, 0.2 + (c_custkey % 6)::DOUBLE / 10 AS volume FROM customer"""


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    eighth = lambda n: ((k - k % n) / n).cast("long")
    rest = k % 8
    return table(spark, sf_dir, "customer").select(
        eighth(8).alias("seq"), k.alias("note"), ((rest - rest % 3) / 3 * 300).cast("long").alias("start"), (160 + k % 5 * 64).alias("length"), (F.lit(220.0) * F.pow(F.lit(2.0), (k % 24).cast("double") / 12)).alias("freq"),
        ((k % 7 - 3).cast("double") * 12).alias("sweep"), ((k % 4).cast("double") * 20).alias("vib_rate"), ((k % 3).cast("double") * 0.5).alias("vib_depth"), F.element_at(F.array(*map(F.lit, ("square", "saw", "triangle", "sine"))), (k % 4 + 1).cast("int")).alias("wave"),
        (k % 3 * 16).alias("attack"), (k % 5 * 20).alias("release"), (F.lit(0.2) + (k % 6).cast("double") / 10).alias("volume"),
    )


@query(f"""
WITH n AS ({_NOTES}), s AS (SELECT *, unnest(range(0, length)) AS i FROM n),
st AS (SELECT *, round(freq * pow(2.0, (sweep * i / 16000 + vib_depth * sin((i * vib_rate / 16000 - floor(i * vib_rate / 16000)) * 6.283185307179586)) / 12) / 16000 * 4294967296)::BIGINT AS step FROM s),
ph AS (SELECT *, (coalesce(sum(step) OVER (PARTITION BY note ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 4294967296)::DOUBLE / 4294967296 AS p FROM st),
v AS (SELECT seq, start + i AS at_, CASE wave WHEN 'square' THEN CASE WHEN p < 0.5 THEN 1.0 ELSE -1.0 END WHEN 'saw' THEN p * 2 - 1 WHEN 'triangle' THEN CASE WHEN p < 0.5 THEN p * 4 - 1 ELSE 3.0 - p * 4 END ELSE sin(p * 6.283185307179586) END
  * least(CASE WHEN attack > 0 THEN least(1.0, (i + 1)::DOUBLE / attack) ELSE 1.0 END, CASE WHEN release > 0 THEN least(1.0, (length - i)::DOUBLE / release) ELSE 1.0 END) * volume AS value FROM ph),
m AS (SELECT seq, at_, sum(round(value * 1e9)::BIGINT)::DOUBLE / 1e9 AS mix, count(*) AS n FROM v GROUP BY 1, 2),
g AS (SELECT seq, at_, CASE WHEN n > 1 AND abs(mix) > 0.6 THEN mix * greatest(0.3, 1 - (abs(mix) - 0.6) / (1 + n * 0.25)) ELSE mix END AS mix FROM m),
l AS (SELECT seq, at_, sign(mix) * CASE WHEN abs(mix) <= 0.96 THEN abs(mix) WHEN abs(mix) >= 0.98 THEN 0.98 ELSE 0.96 + 0.02 * tanh((abs(mix) - 0.96) / 0.02) END AS mix FROM g),
o AS (SELECT seq, at_, trunc(round((3.0 - mix * mix) * mix / 2 * 28000, 4))::BIGINT AS pcm FROM l)
SELECT seq, count(*) AS samples, max(abs(pcm)) AS peak, sum(pcm * (at_ % 251 + 1))::BIGINT AS weighted, sum(pcm * pcm)::BIGINT AS power FROM o GROUP BY 1
""")
def rendered_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of swept and vibrating notes as samples, with what tells them apart: how many
    samples, the loudest, and two sums over all of them."""
    pcm = voices.render(notes(spark, sf_dir), "seq", "note", chunk=128).withColumn("pcm", F.col("pcm").cast("long"))
    return pcm.groupBy("seq").agg(F.count("*").alias("samples"), F.max(F.abs("pcm")).alias("peak"), F.sum(F.col("pcm") * (F.col("at") % 251 + 1)).alias("weighted"), F.sum(F.col("pcm") * F.col("pcm")).alias("power"))
