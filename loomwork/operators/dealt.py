"""Rows dealt among tasks by their number, not by the files they came in."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Rows of a task.
ROWS = 2000


def dealt(rows: DataFrame, key: str, most: int = ROWS) -> DataFrame:
    """``rows`` dealt by ``key`` to so many tasks that each has about ``most`` of them.

    A small table is one block of one file, which a single task reads; where much is made of each
    row, that task would do it all. Groups by the key need no further shuffle. Select the columns
    that are needed before."""
    return rows.repartition(max(1, -(-rows.count() // most)), key)
