"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, small_side

#: Rates above this are drawn as a sum of draws of this rate at most.
PIECE = 32.0
#: The cumulative table of a draw goes so far; beyond, less than 1e-17 is left.
TABLE = 120
#: Sources up to this number are broadcast; more are joined by a shuffle.
MAX_BROADCAST_SOURCES = 100_000


def rates(docs: DataFrame, weights: DataFrame | None = None, alpha: float = 0.5, epochs: float = 1.0, source_col: str = "source") -> DataFrame:
    """Per source: n, weight and the mean repetition rate of its documents, such that
    the expected mix has the target weights and ``epochs`` times the input's rows.

    ``weights`` (source, weight) gives the targets (a source without one gets 0);
    without it they are n ** alpha. Null is a source like any other."""
    n = docs.groupBy(F.col(source_col).alias("source")).agg(F.count("*").alias("n"))
    if weights is None:
        n = n.withColumn("weight", F.pow(F.col("n").cast("double"), F.lit(alpha)))
    else:
        w = weights.groupBy(F.col("source").alias("w_source")).agg(F.sum(F.col("weight").cast("double")).alias("weight"))
        n = n.join(w, F.col("source").eqNullSafe(F.col("w_source")), "left").select("source", "n", F.coalesce(F.greatest(F.col("weight"), F.lit(0.0)), F.lit(0.0)).alias("weight"))
    total = n.agg(F.sum("n").alias("all_n"), F.sum("weight").alias("all_weight"))
    return n.crossJoin(F.broadcast(total)).select("source", "n", "weight", F.round(F.when(F.col("all_weight") > 0, F.col("weight") / F.col("all_weight") * F.lit(epochs) * F.col("all_n") / F.col("n")).otherwise(F.lit(0.0)), 9).alias("rate"))


def _uniform(key: Column, seed: int, piece: Column) -> Column:
    """[0, 1) from 52 bits of md5, so that any engine can draw the same numbers."""
    digest = F.md5(F.encode(F.concat_ws(":", F.lit(str(seed)), piece.cast("string"), key), "UTF-8"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def _cdf(rate: Column) -> Column:
    """P(X <= k) for k = 0, 1, ... of the Poisson distribution."""
    start = F.struct(F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("c"))

    def step(a: Column, k: Column) -> Column:
        p = a["p"] * rate / k.cast("double")
        return F.struct(p.alias("p"), F.concat(a["c"], F.array(F.element_at(a["c"], -1) + p)).alias("c"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(TABLE)), start, step, lambda a: a["c"])


def mix(docs: DataFrame, weights: DataFrame | None = None, alpha: float = 0.5, epochs: float = 1.0, seed: int = 17, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The columns of ``docs``, each row repeated Poisson(rate of its source) times, and
    copy (1, 2, ...), n_copies, rate, shuffle_key; dealt to partitions by a hash of the
    shuffle key and sorted by it inside each, so that the partitions one after the other
    are a uniform global order (a range partitioning would have to sample all rows first).

    The count inverts the Poisson distribution at a uniform number hashed from seed and
    id, so a rerun after a lost executor draws the same. Rows with the same id draw the
    same count; a row without an id draws by its text instead (all its columns where there
    is no text column), so that such rows are drawn one by one. The shuffle key takes the
    text in, too: rows with one id but different texts go to different places. An empty
    table gives an empty one.
    Columns named as one of the four added ones are replaced."""
    added = ("copy", "n_copies", "rate", "shuffle_key")
    docs = docs.drop(*added)
    r = checkpoint(rates(docs, weights, alpha, epochs, source_col))
    r = r.select(F.col("source").alias("_mix_source"), F.col("rate").alias("rate"), F.ceil(F.col("rate") / PIECE).cast("int").alias("_mix_pieces"))
    r = r.withColumn("_mix_cdf", _cdf(F.col("rate") / F.greatest(F.col("_mix_pieces"), F.lit(1))))
    joined = docs.join(small_side(r, r.count(), MAX_BROADCAST_SOURCES), F.col(source_col).eqNullSafe(F.col("_mix_source")))
    # text, or else all that the row holds
    content = F.coalesce(F.col(text_col).cast("string"), F.lit("")) if text_col in docs.columns else F.to_json(F.struct(*docs.columns))
    digest = F.md5(F.encode(content, "UTF-8"))
    key = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("null:"), digest))

    def draw(piece: Column) -> Column:
        u = _uniform(key, seed, piece)
        # P(X <= k) > u for the first time at the drawn k
        return F.size(F.filter(F.col("_mix_cdf"), lambda c: c <= u))

    n = F.aggregate(F.sequence(F.lit(1), F.greatest(F.col("_mix_pieces"), F.lit(1))), F.lit(0), lambda a, p: a + draw(p))
    copies = joined.withColumn("n_copies", n).filter("n_copies > 0")
    out = copies.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n_copies"))))
    out = out.withColumn("shuffle_key", F.md5(F.encode(F.concat_ws(":", F.lit(f"shuffle-{seed}"), key, digest, F.col("copy").cast("string")), "UTF-8")))
    return out.drop("_mix_source", "_mix_pieces", "_mix_cdf").select(*docs.columns, *added).repartition("shuffle_key").sortWithinPartitions("shuffle_key", "copy")


def oracle(source: str = "documents", alpha: float = 0.5, seed: int = 17, columns: str = "doc_id, text, lang, source, n_chars") -> str:
    """The same draw in DuckDB SQL, for rates up to PIECE."""
    cols = ", ".join(f"d.{c.strip()}" for c in columns.split(","))
    digest = "md5(coalesce(d.text, ''))"
    key = f"coalesce(d.doc_id::VARCHAR, 'null:' || {digest})"
    return f"""
WITH RECURSIVE n AS (SELECT source, count(*) AS n FROM {source} GROUP BY source),
r0 AS (SELECT source, pow(n::DOUBLE, {alpha}) / (SELECT sum(pow(n::DOUBLE, {alpha})) FROM n) * (SELECT sum(n) FROM n)::DOUBLE / n AS raw FROM n),
r AS (SELECT source, round(raw, 9) AS rate FROM r0),
cdf(source, k, p, c) AS (
  SELECT source, 0, exp(-rate), exp(-rate) FROM r
  UNION ALL
  SELECT cdf.source, k + 1, p * r.rate / (k + 1), c + p * r.rate / (k + 1)
  FROM cdf JOIN r ON cdf.source IS NOT DISTINCT FROM r.source WHERE k < {TABLE}),
t AS (SELECT source, list(c ORDER BY k) AS cs FROM cdf GROUP BY source),
drawn AS (
  SELECT d.*, r.rate, len(list_filter(t.cs, lambda c : c <= (('0x' || substr(md5('{seed}:1:' || {key}), 1, 13))::BIGINT)::DOUBLE / {float(1 << 52)!r})) AS n_copies
  FROM {source} d JOIN r ON d.source IS NOT DISTINCT FROM r.source JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT {cols}, x.copy::INTEGER AS copy, d.n_copies::INTEGER AS n_copies, d.rate,
  md5('shuffle-{seed}:' || {key} || ':' || {digest} || ':' || x.copy::VARCHAR) AS shuffle_key
FROM drawn d, unnest(range(1, d.n_copies + 1)) AS x(copy)
"""
