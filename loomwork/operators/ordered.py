"""Operators over rows that have an order inside a key: upserts, first matches, rings,
records, changes, running sums. Every window is partitioned by a key, so that none of
them gathers a whole table in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stored import stored


def last_wins(df: DataFrame, keys: list[str], order: Column, values: list[str]) -> DataFrame:
    """One row for each key: the values of its last row. Partial aggregation applies, so
    only one row for each key and task is shuffled."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*values), order).alias("_v")).select(*keys, *[F.col(f"_v.{v}").alias(v) for v in values])


def first_match(left: DataFrame, right: DataFrame, on: str, place: str) -> DataFrame:
    """``left`` with the least ``place`` of the rows of ``right`` with an equal key; null
    where there is none."""
    first = right.groupBy(on).agg(F.min(place).alias(place))
    return left.join(first, on, "left")


def keyed_lookup(left: DataFrame, table: DataFrame, key: str, table_key: str, value: str, default: object) -> DataFrame:
    """``left`` with the table's value for its key, or a default. Repeated table keys
    count once (the greatest value)."""
    t = table.groupBy(F.col(table_key).alias("_k")).agg(F.max(value).alias(value))
    return left.join(t, F.col(key) == F.col("_k"), "left").drop("_k").withColumn(value, F.coalesce(value, F.lit(default)))


def last_n(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The last ``n`` rows of each key, the newest first. Spark prunes each task to n rows
    of a key before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)


def reindexed(df: DataFrame, keys: list[str], order: list[str], index: str = "idx", most: int | None = None) -> DataFrame:
    """Rows numbered anew from 0 inside each key; with ``most`` the first so many of each, to
    which Spark then prunes each task before the shuffle."""
    rows = df.withColumn(index, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return (rows if most is None else rows.filter(F.col(index) <= most)).withColumn(index, F.col(index) - 1)


def numbered(df: DataFrame, key: str, order: list[str], index: str = "idx") -> DataFrame:
    """As ``reindexed``, for few keys with very many rows each: rows are dealt by ranges of key and
    order, numbered inside each range, and the sizes of a key's earlier ranges are added."""
    ranged = stored(df.repartitionByRange(key, *order).withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy(key, "_part").agg(F.count("*").alias("_size"))
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    begins = sizes.select(F.col(key).alias("_key"), F.col("_part").alias("_of"), F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_begin"))
    own = F.row_number().over(Window.partitionBy(key, "_part").orderBy(*order)) - 1
    rows = ranged.withColumn(index, own).join(begins, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_part") == F.col("_of")))
    return rows.withColumn(index, F.col(index) + F.col("_begin")).drop("_part", "_key", "_of", "_begin")


def records(df: DataFrame, keys: list[str], order: list[str], score: str) -> DataFrame:
    """``df`` with ``best`` (the highest score so far) and ``is_record`` (higher than all
    before; a first score counts against 0)."""
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    until = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("is_record", F.coalesce(F.col(score) > F.coalesce(F.max(score).over(before), F.lit(0)), F.lit(False))).withColumn("best", F.max(score).over(until))


def changes(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """The rows whose value is not that of the row before; a key's first row is one."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_before", F.lag(value).over(w)).withColumn("_n", F.row_number().over(w)).filter((F.col("_n") == 1) | ~F.col(value).eqNullSafe(F.col("_before"))).drop("_before", "_n")


def running_sum(df: DataFrame, keys: list[str], order: list[str], value: Column, out: str) -> DataFrame:
    return df.withColumn(out, F.sum(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def start_offsets(df: DataFrame, keys: list[str], order: list[str], delay: str, out: str = "start") -> DataFrame:
    """Where each row begins if it begins ``delay`` after the row before; a key's first
    row begins at 0 whatever its delay."""
    w = Window.partitionBy(*keys).orderBy(*order)
    own = F.when(F.row_number().over(w) == 1, 0).otherwise(F.col(delay))
    return running_sum(df.withColumn("_own", own), keys, order, F.col("_own"), out).drop("_own")


def ring(df: DataFrame, keys: list[str], order: list[str], value: str, size: int, out: str = "ring") -> DataFrame:
    """With each row the last ``size`` values, the oldest first."""
    return df.withColumn(out, F.collect_list(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(1 - size, 0)))


def trail(df: DataFrame, keys: list[str], order: list[str], columns: list[str], size: int = 8, full: int = 255, fade: int = 230, floor: int = 25) -> DataFrame:
    """For each row itself and those before it, ``size`` in all, with a brightness that
    falls with their age: one row for each row and age."""
    w = Window.partitionBy(*keys).orderBy(*order)
    past = F.collect_list(F.struct(*columns)).over(w.rowsBetween(1 - size, 0))
    aged = df.select(*keys, *order, F.reverse(past).alias("_past"))
    rows = aged.select(*keys, *order, F.posexplode("_past").alias("age", "_p"))
    return rows.select(*keys, *order, "age", *[F.col(f"_p.{c}").alias(f"at_{c}") for c in columns], F.greatest(F.lit(floor), F.lit(full) - F.floor(F.col("age") * fade / size)).cast("int").alias("brightness"))


def page(df: DataFrame, order: list[Column], number: int, size: int, rows: int) -> DataFrame:
    """Page ``number`` (from 0, taken back into the range of pages) of ``rows`` ordered
    rows: a top-k of its end, not a sort of all rows."""
    last = max(0, -(-rows // size) - 1)
    at = min(max(0, number), last)
    return df.orderBy(*order).limit((at + 1) * size).offset(at * size)
