"""Matching in turns: who comes first takes first, and what is used up is gone."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .stored import stored


def first_come(pairs: DataFrame, taker: str, turn: str, giver: str, choice: list[str], capacity: str) -> DataFrame:
    """(taker, turn, giver, capacity, nth): what each taker gets if all go one after the other by
    ``turn`` (numbers that tell takers apart), and each takes the first of its givers, in
    the order ``choice``, that is not used up. A giver can be taken ``capacity`` times (null:
    without end). nth: the how manieth of the giver's takers it is, null without end.

    No taker waits for the one before. In rounds every taker asks its first giver that has
    not refused it; a giver keeps the earliest that it has room for and refuses the rest,
    also those kept in an earlier round. As all givers prefer earlier turns, what is left when
    nobody is refused is what going one by one gives. A round is a ranking of the asking
    takers by giver (limited before the shuffle to the largest capacity, so that a giver
    that everybody asks is no hot key); there are as many rounds as the longest chain of takers
    who push each other on."""
    order = Window.partitionBy(taker).orderBy(*choice)
    columns = [taker, turn, giver, capacity]
    choices = stored(pairs.select(*columns, F.row_number().over(order).alias("_k")))
    most = choices.agg(F.max(capacity)).first()[0] or 0
    asking = choices.filter("_k = 1")
    endless = []
    while True:
        endless.append(asking.filter(F.col(capacity).isNull()))
        asking = asking.filter(F.col(capacity).isNotNull())
        ranked = asking.withColumn("nth", F.row_number().over(Window.partitionBy(giver).orderBy(turn)))
        kept = stored(ranked.filter(F.col("nth") <= most).filter(F.col("nth") <= F.col(capacity)))
        refused = stored(asking.join(kept.select(taker), taker, "left_anti").select(taker, (F.col("_k") + 1).alias("_k")))
        if refused.isEmpty():
            break
        asking = stored(kept.drop("nth").unionByName(choices.join(refused, [taker, "_k"]).select(*columns, "_k")))
    out = kept.select(*columns, "nth")
    for part in endless:
        out = out.unionByName(part.select(*columns, F.lit(None).cast("int").alias("nth")))
    return out
