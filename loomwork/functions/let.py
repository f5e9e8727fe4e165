"""Naming a value inside an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used. Without it,
    an expression used k times inside lambdas is computed k times, and nested uses
    multiply."""
    return F.transform(F.array(value), use)[0]
