"""Square boards of tiles and ordered bodies of cells, as expressions over arrays."""

from __future__ import annotations

import re
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from .bits import lcg
from .let import let

_CELLS = "array<int>"


def slide(row: Column) -> Column:
    """struct(cells, gain, moved): tiles (exponents, 0 empty) pushed to the front, equal
    neighbours merged once; the gain is the sum of the merged tiles' values."""
    return let(row, _slide)


def _slide(row: Column) -> Column:
    tiles = F.filter(row, lambda v: v != 0)
    start = F.struct(F.array().cast(_CELLS).alias("out"), F.lit(False).alias("locked"), F.lit(0).alias("gain"))

    def step(a: Column, v: Column) -> Column:
        last = F.try_element_at(a["out"], F.lit(-1))
        merge = F.coalesce(~a["locked"] & (last == v), F.lit(False))
        kept = F.slice(a["out"], 1, F.greatest(F.size(a["out"]) - 1, F.lit(0)))
        return F.struct(
            F.when(merge, F.concat(kept, F.array(v + 1))).otherwise(F.concat(a["out"], F.array(v))).alias("out"),
            merge.alias("locked"),
            (a["gain"] + F.when(merge, F.pow(F.lit(2), v + 1).cast("int")).otherwise(0)).alias("gain"),
        )

    def padded(done: Column) -> Column:
        return F.struct(F.concat(done["out"], F.array_repeat(F.lit(0), F.size(row) - F.size(done["out"]))).alias("cells"), done["gain"].alias("gain"))

    whole = let(F.aggregate(tiles, start, step), padded)
    return let(whole, lambda d: F.struct(d["cells"].alias("cells"), d["gain"].alias("gain"), (d["cells"] != row).alias("moved")))


def rotate(board: Column) -> Column:
    """A quarter turn."""
    return let(F.reverse(board), lambda b: F.transform(F.sequence(F.lit(0), F.size(b) - 1), lambda i: F.transform(b, lambda r: r[i])))


def moved(board: Column, side: str) -> Column:
    """The board after a move to the left, right, up or down: rows or columns slid, from
    their other end for right and down."""
    flip = (lambda r: F.reverse(r)) if side in ("right", "down") else (lambda r: r)
    slid = lambda b: F.transform(b, lambda r: flip(slide(flip(r))["cells"]))
    return slid(board) if side in ("left", "right") else transposed(slid(transposed(board)))


def _slid_codes(n: int, top: int) -> list[int]:
    """For each row of ``n`` tiles up to ``top``, coded as a number, the code of the slid row."""
    base, out = top + 2, []
    for code in range(base**n):
        tiles = [t for i in range(n) if (t := code // base**i % base)]
        done: list[int] = []
        free = False
        for t in tiles:
            if free and done[-1] == t and t <= top:
                done[-1], free = t + 1, False
            else:
                done.append(t)
                free = True
        out.append(sum(t * base**i for i, t in enumerate(done)))
    return out


def moved_by_table(board: Column, side: str, n: int, top: int) -> Column:
    """As ``moved``, for boards of ``n`` by ``n`` tiles up to ``top``: each line is a number, and
    what it becomes stands in tables of all lines ((top + 2) ** n numbers for each place)."""
    base = top + 2
    slid = _slid_codes(n, top)
    # for each place of a line the tile that comes there
    tables = [F.expr(f"array({','.join(str(c // base**j % base) for c in slid)})") for j in range(n)]
    line = (lambda i, j: (i, j)) if side in ("left", "right") else (lambda i, j: (j, i))
    back = side in ("right", "down")
    cells: dict[tuple[int, int], Column] = {}
    for i in range(n):
        places = [line(i, n - 1 - j if back else j) for j in range(n)]
        code = reduce(add, (board[r][c] * base**j for j, (r, c) in enumerate(places)))
        for j, place in enumerate(places):
            cells[place] = F.get(tables[j], code)
    return F.array(*[F.array(*[cells[r, c] for c in range(n)]) for r in range(n)])


def draw_place(board: Column, draw: Column, value: Column) -> Column:
    """The cells of a board, row by row, with ``value`` on one of the empty ones: number ``draw`` of
    them, counted round. A full board stays as it is."""
    cells = F.flatten(board)
    empty = F.filter(F.sequence(F.lit(0), F.size(cells) - 1), lambda i: F.get(cells, i) == 0)
    at = F.get(empty, F.pmod(draw, F.nullif(F.size(empty), F.lit(0))).cast("int"))
    return F.transform(cells, lambda c, i: F.when(i == at, value).otherwise(c))


def transposed(board: Column) -> Column:
    return let(board, lambda b: F.transform(F.sequence(F.lit(0), F.size(b) - 1), lambda i: F.transform(b, lambda r: r[i])))


def has_pair(row: Column) -> Column:
    """Whether two neighbours are equal."""
    return F.exists(F.arrays_zip(F.slice(row, 1, F.size(row) - 1).alias("a"), F.slice(row, 2, F.size(row) - 1).alias("b")), lambda p: p["a"] == p["b"])


def is_over(board: Column) -> Column:
    """No empty cell and no equal neighbours in any row or column."""
    empty = F.exists(F.flatten(board), lambda v: v == 0)
    return ~empty & ~F.exists(board, has_pair) & ~F.exists(transposed(board), has_pair)


def labels(row: Column) -> Column:
    return F.transform(row, lambda v: F.when(v == 0, " ").otherwise(F.pow(F.lit(2), v).cast("int").cast("string")))


def body(length: Column, x: Column, y: Column) -> Column:
    """Cells of a straight body, the head first."""
    return F.transform(F.sequence(F.lit(0), length - 1), lambda i: F.struct((x - i).cast("int").alias("x"), y.cast("int").alias("y")))


def step(cells: Column, dx: Column, dy: Column, width: int, height: int, grows: Column) -> Column:
    """The body after one step on a board whose edges join; its tail stays if it grows."""
    head = F.struct(F.pmod(cells[0]["x"] + dx, F.lit(width)).cast("int").alias("x"), F.pmod(cells[0]["y"] + dy, F.lit(height)).cast("int").alias("y"))
    return F.concat(F.array(head), F.slice(cells, 1, F.size(cells) - F.when(grows, 0).otherwise(1)))


#: Which cells of a board of R rows and C columns the levels 1 to 12 set.
LEVELS = (
    "true",
    "(r + c) % 2 = 0",
    "abs(r - R div 2) + abs(c - C div 2) <= R div 2 + C div 4",
    "r % 2 = 0",
    "c >= r AND c < C - r",
    "c >= R - 1 - r AND c < C - (R - 1 - r)",
    "c % 2 = 0",
    "(c + r % 2 * 2) % 4 < 2",
    "(r div 2 + c div 2) % 2 = 0",
    "abs(r - R div 2) + least(abs(c - C div 4), abs(c - C * 3 div 4)) <= R div 2 + 1",
    "r IN (0, R - 1) OR c IN (0, C - 1)",
    "r = R div 2 OR c IN (C div 2, C div 2 - 1)",
)
#: The generator of the levels after these, its seed for each level, how many
#: of 100 cells a level sets; a board with less than FEW cells gets more, up to ENOUGH.
MULTIPLIER, INCREMENT, SEED, DENSITY, PER_LEVEL, DENSEST, FEW, ENOUGH = 1103515245, 12345, 2654435761, 50, 2, 85, 5, 8


def level_cells(level: Column, rows: int, columns: int) -> Column:
    """The cells (row by row, true or false) of a level's board: a fixed shape up to the
    twelfth, then drawn cell by cell from a generator that is seeded with the level."""
    size = rows * columns
    shape = F.when(level < 1, F.expr(f"transform(sequence(0, {size - 1}), i -> false)"))
    for n, rule in enumerate(LEVELS, 1):
        rule = re.sub(r"\b[rcRC]\b", lambda m: {"r": f"(i div {columns})", "c": f"(i % {columns})", "R": str(rows), "C": str(columns)}[m.group()], rule)
        shape = shape.when(level == n, F.expr(f"transform(sequence(0, {size - 1}), i -> {rule})"))
    bound = F.least(F.lit(DENSITY) + level * PER_LEVEL, F.lit(DENSEST))
    seed = F.pmod(level.cast("decimal(38,0)") * SEED, F.lit(1 << 32)).cast("long")
    start = F.struct(seed.alias("x"), F.array().cast("array<boolean>").alias("out"))

    def draw(a: Column, _: Column) -> Column:
        return let(lcg(a["x"], MULTIPLIER, INCREMENT, F.lit(1)), lambda x: F.struct(x.alias("x"), F.concat(a["out"], F.array(F.call_function("shiftright", x, F.lit(16)).bitwiseAND(F.lit(0x7FFF)) % 100 < bound)).alias("out")))

    def enough(cells: Column) -> Column:
        set_ = F.size(F.filter(cells, lambda c: c))
        free = lambda i: i + 1 - F.size(F.filter(F.slice(cells, 1, i + 1), lambda c: c))
        return F.when(set_ >= FEW, cells).otherwise(F.transform(cells, lambda c, i: c | (free(i) <= ENOUGH - set_)))

    drawn = let(F.aggregate(F.sequence(F.lit(1), F.lit(size)), start, draw, lambda a: a["out"]), enough)
    return shape.otherwise(drawn)


def tile_colour(value: Column) -> Column:
    """The colour of a tile by its value (0xRRGGBB); what exceeds the list has its last."""
    names = F.create_map(*[F.lit(x) for pair in TILE_COLOURS.items() for x in pair])
    return F.coalesce(F.try_element_at(names, value.cast("int")), F.lit(TILE_COLOURS[2048]))


#: Colours of tiles; 0 and 1 are the empty cell.
TILE_COLOURS = {
    0: 0xC7B9AC, 1: 0xC7B9AC, 2: 0xEEE4DA, 4: 0xEDE0C8, 8: 0xF2B179, 16: 0xF59563, 32: 0xF67C5F, 64: 0xF75F3B,
    128: 0xEDCF72, 256: 0xEDCC61, 512: 0xEDC850, 1024: 0xEDC53F, 2048: 0xEDC22E,
}
