"""Overlap joins and cell sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.let import let
from .stored import stored


def _cells(df: DataFrame, cell: float, prefix: str) -> DataFrame:
    """A row for each grid cell that a box (x0, y0, x1, y1) touches."""
    at = lambda c: F.floor(F.col(c) / F.lit(cell))
    out = df.withColumn("_cx", F.explode(F.sequence(at(f"{prefix}x0"), at(f"{prefix}x1"))))
    return out.withColumn("_cy", F.explode(F.sequence(at(f"{prefix}y0"), at(f"{prefix}y1"))))


#: Boxes in a cell from which on it is dealt to several tasks.
CROWD = 4096


def overlaps(a: DataFrame, b: DataFrame, cell: float, crowd: int = CROWD) -> DataFrame:
    """Pairs of boxes (columns a_x0, a_y0, a_x1, a_y1 and b_x0, ...) that share some area.

    Both sides are dealt to grid cells and joined on the cell, so no row meets all others;
    a pair is reported in the cell of its common area's lower corner only. ``cell`` should
    be about a box's size. A cell with more than ``crowd`` boxes of the first side is
    salted: these are dealt to several parts, and each part gets the second side's boxes."""
    left, right = _cells(a, cell, "a_"), _cells(b, cell, "b_")
    crowded = left.groupBy("_cx", "_cy").count().filter(F.col("count") > crowd)
    crowded = stored(crowded.select("_cx", "_cy", F.ceil(F.col("count") / crowd).cast("int").alias("_parts")))
    on = ["_cx", "_cy"]
    if not crowded.isEmpty():
        parts = F.coalesce("_parts", F.lit(1))
        left = left.join(crowded, on, "left").withColumn("_part", F.pmod(F.xxhash64(*a.columns), parts).cast("int")).drop("_parts")
        right = right.join(crowded, on, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
        on = [*on, "_part"]
    j = left.join(right, on).drop("_part")
    touch = (F.col("a_x0") < F.col("b_x1")) & (F.col("b_x0") < F.col("a_x1")) & (F.col("a_y0") < F.col("b_y1")) & (F.col("b_y0") < F.col("a_y1"))
    corner = (F.col("_cx") == F.floor(F.greatest("a_x0", "b_x0") / F.lit(cell))) & (F.col("_cy") == F.floor(F.greatest("a_y0", "b_y0") / F.lit(cell)))
    return j.filter(touch & corner).drop("_cx", "_cy")


def first_hit(pairs: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Of each key's pairs the first in the order."""
    rest = [c for c in pairs.columns if c != key]
    return pairs.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_p")).select(key, *[F.col(f"_p.{c}").alias(c) for c in rest])


def free_cells(boards: DataFrame, bodies: DataFrame, key: str, width: int, height: int) -> DataFrame:
    """The cells of each board that no body row covers."""
    xs = F.explode(F.sequence(F.lit(0), F.lit(width - 1)))
    ys = F.explode(F.sequence(F.lit(0), F.lit(height - 1)))
    cells = boards.select(key, xs.alias("x")).select(key, "x", ys.alias("y"))
    return cells.join(bodies.select(key, "x", "y").distinct(), [key, "x", "y"], "left_anti")


def _cell(x: Column, y: Column) -> Column:
    return F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"))


def line(x0: Column, y0: Column, x1: Column, y1: Column, late: bool = False) -> Column:
    """The cells of a straight line as an array, a step along the longer side each.

    An error term decides where the shorter side steps; on a tie it steps at once, or with
    ``late`` a step later, as the two kinds of displays do."""
    dx, dy = F.abs(x1 - x0), F.abs(y1 - y0)
    n = F.greatest(dx, dy)
    sx, sy = F.when(x0 < x1, 1).otherwise(-1), F.when(y0 < y1, 1).otherwise(-1)
    start = F.struct(x0.cast("int").alias("x"), y0.cast("int").alias("y"), (dx - dy).cast("int").alias("e"), F.array(_cell(x0, y0)).alias("out"))

    def step(a: Column, _: Column) -> Column:
        e2 = a["e"] * 2
        go_x, go_y = (e2 > -dy, e2 < dx) if late else (e2 >= -dy, e2 <= dx)
        x, y = a["x"] + F.when(go_x, sx).otherwise(0), a["y"] + F.when(go_y, sy).otherwise(0)
        e = a["e"] - F.when(go_x, dy).otherwise(0) + F.when(go_y, dx).otherwise(0)
        return F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"), e.cast("int").alias("e"), F.concat(a["out"], F.array(_cell(x, y))).alias("out"))

    return F.when(n == 0, F.array(_cell(x0, y0))).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1)).cast("int")), start, step, lambda a: a["out"]))


def _span(x: Column, y: Column, n: Column) -> Column:
    """The cells of a row from x on, n of them; none for n below 1."""
    return F.when(n > 0, F.transform(F.sequence(x.cast("int"), (x + F.greatest(n, F.lit(1)) - 1).cast("int")), lambda i: _cell(i, y))).otherwise(F.array().cast("array<struct<x:int,y:int>>"))


def octant(r: Column) -> Column:
    """The cells (x, y) of an eighth of a circle, from straight up to the diagonal, by the
    midpoint's decision."""
    start = F.struct(F.lit(0).alias("x"), r.cast("int").alias("y"), (F.lit(1) - r).cast("int").alias("d"), F.array().cast("array<struct<x:int,y:int>>").alias("out"))

    def step(a: Column, _: Column) -> Column:
        inside, x = a["d"] < 0, a["x"] + 1
        y = F.when(inside, a["y"]).otherwise(a["y"] - 1)
        d = a["d"] + F.when(inside, x * 2 + 1).otherwise((x - y) * 2 + 1)
        out = F.when(a["x"] <= a["y"], F.concat(a["out"], F.array(_cell(a["x"], a["y"])))).otherwise(a["out"])
        return F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"), d.cast("int").alias("d"), out.alias("out"))

    return F.aggregate(F.sequence(F.lit(0), r.cast("int")), start, step, lambda a: a["out"])


def circle_cells(x: Column, y: Column, r: Column, filled: bool = True) -> Column:
    """The distinct cells of a disc or of its outline."""

    def eight(c: Column) -> Column:
        a, b = c["x"], c["y"]
        if filled:
            return F.concat(*[_span(x - p, y + q, p * 2 + 1) for p, q in ((a, b), (a, -b), (b, a), (b, -a))])
        return F.array(*[_cell(x + p * i, y + q * j) for p, q in ((a, b), (b, a)) for i in (1, -1) for j in (1, -1)])

    return F.array_distinct(F.flatten(F.transform(octant(r), eight)))


def round_box_cells(x: Column, y: Column, w: Column, h: Column, r: Column, filled: bool = True) -> Column:
    """The distinct cells of a rectangle with round corners, or of its outline; corners that
    do not fit (r of 0, or over half a side) are square."""
    right, low = x + w - 1, y + h - 1

    def corners(c: Column) -> Column:
        if filled:
            return F.concat(*[_span(x + r - p, v, w - (r - p) * 2) for p, q in ((c["x"], c["y"]), (c["y"], c["x"])) for v in (y + r - q, low - r + q)])
        return F.array(*[_cell(u, v) for p, q in ((c["x"], c["y"]), (c["y"], c["x"])) for u in (x + r - p, right - r + p) for v in (y + r - q, low - r + q)])

    rows = lambda first, last, x, n: F.when(first <= last, F.flatten(F.transform(F.sequence(first.cast("int"), F.greatest(first, last).cast("int")), lambda v: _span(x, v, n)))).otherwise(F.array().cast("array<struct<x:int,y:int>>"))
    if filled:
        straight = [rows(y, low, x + r, w - r * 2), rows(y + r, low - r, x, w)]
    else:
        straight = [_span(x + r, y, w - r * 2), _span(x + r, low, w - r * 2), rows(y + r, low - r, x, F.lit(1)), rows(y + r, low - r, right, F.lit(1))]
    fits = (r > 0) & (r * 2 <= w) & (r * 2 <= h)
    return F.when(fits, F.array_distinct(F.concat(*straight, F.flatten(F.transform(octant(F.greatest(r, F.lit(0))), corners))))).otherwise(box_cells(x, y, w, h, filled))


def box_cells(x: Column, y: Column, w: Column, h: Column, filled: bool = True) -> Column:
    """The cells of a rectangle, or of its outline."""
    xs, ys = F.sequence(x, x + w - 1), F.sequence(y, y + h - 1)
    cells = F.flatten(F.transform(ys, lambda b: F.transform(xs, lambda a: F.struct(a.cast("int").alias("x"), b.cast("int").alias("y")))))
    if filled:
        return cells
    return F.filter(cells, lambda c: (c["x"] == x) | (c["x"] == x + w - 1) | (c["y"] == y) | (c["y"] == y + h - 1))


def arc_cells(x: Column, y: Column, r0: Column, r1: Column, start: Column, end: Column, filled: bool = True) -> Column:
    """The cells of a ring between two radii and two angles (degrees from the right,
    clockwise as rows grow), or the edges of it. An end that is not after the start goes
    around through 0."""
    outer, inner = F.greatest(r0, r1), F.least(r0, F.greatest(r1, F.lit(0)))
    first, last = F.pmod(start, F.lit(360.0)), F.pmod(end, F.lit(360.0))
    span = F.sequence(-outer, outer)
    cells = F.flatten(F.transform(span, lambda b: F.transform(span, lambda a: F.struct(a.alias("dx"), b.alias("dy")))))

    def inside(c: Column) -> Column:
        d = c["dx"] * c["dx"] + c["dy"] * c["dy"]
        angle = F.pmod(F.degrees(F.atan2(c["dy"].cast("double"), c["dx"].cast("double"))), F.lit(360.0))
        swept = F.when(last <= first, (angle >= first) | (angle <= last)).otherwise((angle >= first) & (angle <= last))
        edge = (d > (outer - 1) * (outer - 1)) | ((inner > 0) & (d >= inner * inner) & (d < (inner + 1) * (inner + 1)))
        return (d <= outer * outer) & ((d >= inner * inner) if filled else edge) & swept

    return F.transform(F.filter(cells, inside), lambda c: _cell(x + c["dx"], y + c["dy"]))


def triangle_rim(x0: Column, y0: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """The distinct cells of a triangle's three sides."""
    return F.array_distinct(F.concat(line(x0, y0, x1, y1), line(x1, y1, x2, y2), line(x2, y2, x0, y0)))


def triangle_cells(x0: Column, y0: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """The cells of a filled triangle: in each row those between two sides, which advance from
    row to row by sixteenths of a cell, cut towards zero."""
    corners = F.array_sort(F.array(*[F.struct(y.cast("int").alias("y"), F.lit(i).alias("i"), x.cast("int").alias("x")) for i, (x, y) in enumerate(((x0, y0), (x1, y1), (x2, y2)))]))

    def rows(c: Column) -> Column:
        a, b, z = c[0], c[1], c[2]
        slope = lambda p, q: ((q["x"] - p["x"]) * 16 / F.nullif(q["y"] - p["y"], F.lit(0))).cast("int")
        at = lambda p, q, y: F.floor((p["x"] * 16 + slope(p, q) * (y - p["y"])) / 16).cast("int")

        def row(y: Column) -> Column:
            one = at(a, z, y)
            two = F.when((y < b["y"]) | (b["y"] == z["y"]), at(a, b, y)).otherwise(at(b, z, y))
            return _span(F.least(one, two), y, F.abs(one - two) + 1)

        flat = _span(F.least(a["x"], b["x"], z["x"]), a["y"], F.greatest(a["x"], b["x"], z["x"]) - F.least(a["x"], b["x"], z["x"]) + 1)
        return F.when(a["y"] == z["y"], flat).otherwise(F.flatten(F.transform(F.sequence(a["y"], z["y"]), row)))

    return let(corners, rows)
