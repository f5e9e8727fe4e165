"""Positions in motion without replaying it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _quotient(a: Column, b: Column) -> Column:
    """The whole quotient of numbers that are not negative."""
    return ((a - F.pmod(a, b)) / b).cast("long")


def bounced(start: Column, speed: Column, most: Column, tick: Column) -> Column:
    """Where a point is after ``tick`` steps of ``speed`` between 0 and ``most`` (whole numbers). A
    step that reaches or passes an edge ends on it and turns round.

    After the first edge the way is one of equal legs, ceil(most / speed) steps each, so the
    leg and the step in it follow from the tick by division: a triangle wave whose peaks
    are cut to whole steps."""
    step = F.abs(speed)
    up = speed > 0
    # integer division rounds up; a point on the edge it moves to turns there with one step
    steps = lambda way: F.greatest(F.lit(1), _quotient(way + step - 1, F.nullif(step, F.lit(0))))
    first = steps(F.when(up, most - start).otherwise(start))
    leg = steps(most)
    beyond = tick - first
    gone = F.pmod(beyond, leg) * step
    from_top = up == (F.pmod(_quotient(beyond, leg), F.lit(2)) == 0)
    after = F.when(from_top, most - gone).otherwise(gone)
    return F.when((tick < first) | (speed == 0), start + speed * tick).otherwise(after)
