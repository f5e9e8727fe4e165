"""Pixel colours as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The colour that stands for transparency, and the one that takes its place.
KEY, NEAR_KEY = 0xF81F, 0xF81E


def _left(c: Column, n: int) -> Column:
    return F.call_function("shiftleft", c, F.lit(n))


def _right(c: Column, n: int) -> Column:
    return F.call_function("shiftright", c, F.lit(n))


def to_565(r: Column, g: Column, b: Column) -> Column:
    """Eight bits each to five, six and five."""
    return _left(_right(r, 3), 11).bitwiseOR(_left(_right(g, 2), 5)).bitwiseOR(_right(b, 3))


def to_bgr_565(r: Column, g: Column, b: Column) -> Column:
    return to_565(b, g, r)


def from_565(v: Column) -> tuple[Column, Column, Column]:
    """Red, green, blue with the highest bits repeated in the lowest."""
    r, g, b = _right(v, 11).bitwiseAND(F.lit(31)), _right(v, 5).bitwiseAND(F.lit(63)), v.bitwiseAND(F.lit(31))
    wide5 = lambda c: _left(c, 3).bitwiseOR(_right(c, 2))
    return wide5(r), _left(g, 2).bitwiseOR(_right(g, 4)), wide5(b)


def sprite_565(r: Column, g: Column, b: Column, alpha: Column) -> Column:
    """As to_565, see-through pixels as the key colour, which no other pixel gets."""
    v = to_565(r, g, b)
    return F.when(alpha < 128, F.lit(KEY)).when(v == KEY, F.lit(NEAR_KEY)).otherwise(v)


def grey_byte(r: Column, g: Column, b: Column) -> Column:
    """The byte that a monochrome raster stores: the sum, only blue divided by three (as the
    format's writer has it), without what exceeds a byte."""
    return (r + g + F.floor(b / 3)).cast("int").bitwiseAND(F.lit(255))


def swapped(v: Column) -> Column:
    """A 16-bit value with its two bytes in the other order, as some displays take it."""
    return _left(v.bitwiseAND(F.lit(255)), 8).bitwiseOR(_right(v, 8))


def bytes_per_pixel(kind: Column) -> Column:
    """1 for monochrome, 2 for the 16-bit formats, 3 for rgb888."""
    return F.when(kind == "mono", 1).when(kind == "rgb888", 3).otherwise(2)


def ramp(x: Column, width: int, low: Column, high: Column) -> Column:
    """A linear fade over ``width`` places."""
    return F.floor(low + (high - low) * x / F.lit(max(1, width - 1))).cast("int")


def oval(x: Column, y: Column, width: int, height: int, rim: float = 0.85) -> Column:
    """2 inside an oval that fills the raster, 1 on its rim, 0 outside."""
    dx = (x - (width - 1) / 2) / F.lit(width / 2)
    dy = (y - (height - 1) / 2) / F.lit(height / 2)
    d = F.sqrt(dx * dx + dy * dy)
    return F.when(d <= rim, 2).when(d <= 1, 1).otherwise(0)
