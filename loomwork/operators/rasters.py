"""Rasters made of other rasters: text from glyphs, sheets from frames, clipped spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a glyph table that are broadcast at most; a larger one is joined by a shuffle.
MAX_GLYPH_ROWS = 100_000


def text_cells(rows: DataFrame, key: str, text: str, x: Column, y: Column, scale: Column, glyphs: DataFrame, width: int, height: int, advance: int = 6, bits: int = 8) -> DataFrame:
    """(key, x, y): the cells that a line of text sets on a screen.

    ``glyphs`` has code, column and bits: the set rows of a column of a character, the lowest
    bit the highest row. A character takes ``advance`` columns, times ``scale``; the first
    that would pass the right edge ends the text. What lies below or above the screen is left
    out, and so are characters without a glyph."""
    chars = rows.select(F.col(key), x.alias("_x"), y.alias("_y"), scale.alias("_s"), F.posexplode(F.regexp_extract_all(F.col(text), F.lit("(?s)."), F.lit(0))).alias("_i", "_c"))
    chars = chars.withColumn("_left", F.col("_x") + F.col("_i") * advance * F.col("_s")).filter(F.col("_left") + advance * F.col("_s") <= width)
    chars = chars.select(key, "_left", "_y", "_s", F.ascii("_c").alias("code"))
    table = glyphs.select("code", F.col("column").alias("_j"), F.col("bits").alias("_b"))
    if table.count() <= MAX_GLYPH_ROWS:
        table = F.broadcast(table)
    lit = chars.join(table, "code").withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(bits - 1)))).filter(F.expr("(_b >> _k) & 1 = 1"))
    # each cell of a glyph is a square of scale by scale
    square = F.sequence(F.lit(0).cast("long"), F.col("_s").cast("long") * F.col("_s") - 1)
    cells = lit.withColumn("_q", F.explode(square))
    across = F.pmod(F.col("_q"), F.col("_s"))
    down = (F.col("_q") - across) / F.col("_s")
    out = cells.select(key, (F.col("_left") + F.col("_j") * F.col("_s") + across).cast("int").alias("x"), (F.col("_y") + F.col("_k") * F.col("_s") + down).cast("int").alias("y"))
    return out.filter(F.col("x").between(0, width - 1) & F.col("y").between(0, height - 1))


def clipped(start: Column, length: Column, size: int) -> Column:
    """struct(first, last) of the part of a span that lies in 0 to size - 1; null if none does."""
    first, last = F.greatest(start, F.lit(0)), F.least(start + length - 1, F.lit(size - 1))
    return F.when((length > 0) & (first <= last), F.struct(first.cast("int").alias("first"), last.cast("int").alias("last")))


def clipped_cells(cells: Column, width: int, height: int) -> Column:
    """The cells (x, y) of an array that lie on a screen."""
    return F.filter(cells, lambda c: c["x"].between(0, width - 1) & c["y"].between(0, height - 1))


def sheets(frames: DataFrame, key: str, index: str, pixels: str, width: int, height: int) -> DataFrame:
    """(key, y, n_frames, pixels): the frames of a group side by side in the order of their
    index, a row for each line of the sheet. ``pixels``: an array of width * height, line by
    line. Lines are dealt one by one: no task holds a whole sheet."""
    lines = frames.select(key, index, F.explode(F.sequence(F.lit(0), F.lit(height - 1))).alias("y"), F.col(pixels).alias("_p"))
    lines = lines.select(key, index, "y", F.slice("_p", F.col("y") * width + 1, F.lit(width)).alias("_p"))
    joined = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct(index, "_p"))), lambda f: f["_p"]))
    return lines.groupBy(key, "y").agg(F.count("*").alias("n_frames"), joined.alias("pixels"))
