"""State machines as steps for an ordered fold."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

WRAP = 1 << 32


def cooldown(ms: int, key: str = "key", at: str = "at"):
    """Gives out (key, at) of the events that come at least ``ms`` after the last one
    that was given out; those in between do not start the time anew."""

    def step(last: int | None, row: Any) -> tuple[int, list[tuple]]:
        now = getattr(row, at)
        if last is not None and (now - last) % WRAP < ms:
            return last, []
        return now, [(getattr(row, key), now)]

    return step


@dataclass
class Frame:
    held: bytes = b""
    shift: bool = False
    sticky: bool = False
    last_shift: int | None = None


#: Fixed values of a frame: two fixed bytes, key, state (1 pressed), the sum of the three bytes before.
HEAD, DOUBLE_TAP_MS, SHIFT = b"\xaa\x03", 400, 0x80


def frames(key: str = "key", at: str = "at", byte: str = "byte"):
    """Gives out (key, at, code, shifted) for each key press in a stream of bytes. A frame
    with a wrong sum is passed over byte by byte. Shift holds for one press; pressed twice
    within 400 ms it stays until pressed again."""

    def step(s: Frame | None, row: Any) -> tuple[Frame, list[tuple]]:
        s = s or Frame()
        now, out = getattr(row, at), []
        s.held += bytes((int(getattr(row, byte)) & 255,))
        while s.held:
            if not HEAD.startswith(s.held[:2]) and s.held[:2] != HEAD:
                s.held = s.held[1:]
                continue
            if len(s.held) < 5:
                break
            code, state, total = s.held[2:5]
            if total != (3 + code + state) & 255:
                s.held = s.held[1:]
                continue
            s.held = s.held[5:]
            if state != 1:
                continue
            if code == SHIFT:
                double = s.last_shift is not None and now - s.last_shift <= DOUBLE_TAP_MS
                s.sticky, s.shift = (False, False) if s.sticky else (double, True)
                s.last_shift = now
            else:
                out.append((getattr(row, key), now, int(code), s.shift))
                s.shift = s.sticky
        return s, out

    return step


Cell = tuple[int, int]


def crawler(key: str, width: int, height: int, start: Cell, length: int, walls: bool):
    """A body that crawls over a board, one row for each move (``move``: 0 up, 1 down, 2 left, 3
    right; ``grows``). Gives out (key, move_id, x, y, length, alive) after each move.

    A move straight back is taken as going on. At an edge the body dies, or comes in again
    on the other side if there are no ``walls``. It dies if its head meets one of its cells, but for
    the last, which moves out of the way. A dead body stays where it is."""
    ways = ((0, -1), (0, 1), (-1, 0), (1, 0))

    def step(s: tuple[list[Cell], int, bool] | None, row: Any) -> tuple[tuple, list[tuple]]:
        cells, way, alive = s or ([((start[0] - i) % width, start[1]) for i in range(length)], 3, True)
        if alive:
            wanted = int(row.move)
            if wanted ^ way != 1:
                way = wanted
            x, y = cells[0][0] + ways[way][0], cells[0][1] + ways[way][1]
            inside = 0 <= x < width and 0 <= y < height
            head = (x % width, y % height)
            alive = (inside or not walls) and head not in cells[1:-1]
            if alive:
                cells = [head, *(cells if row.grows else cells[:-1])]
        return (cells, way, alive), [(getattr(row, key), row.move_id, cells[0][0], cells[0][1], len(cells), alive)]

    return step


def wanderer(key: str, width: int, height: int, slowest: int, fastest: int):
    """A point that bounces off the edges of a board, one row for each tick (``seed``: the first
    row's seeds its generator; ``start``: x, y, dx, dy). Gives out (key, tick, x, y, dx, dy).

    Each bounce changes the speed along the edge by up to a tenth, drawn from the generator,
    and speeds stay between ``slowest`` and ``fastest``. All numbers are whole. Without that
    change a point's place follows from the tick (``functions/motion.bounced``)."""

    def turned(at: int, speed: int, most: int) -> tuple[int, int, bool]:
        if at <= 0:
            return 0, abs(speed), True
        return (most, -abs(speed), True) if at >= most else (at, speed, False)

    def changed(speed: int, seed: int) -> tuple[int, int]:
        seed = (seed * 1103515245 + 12345) % (1 << 31)
        size = abs(speed) * (900 + (seed >> 16) % 201) // 1000
        return size if speed >= 0 else -size, seed

    def held(speed: int) -> int:
        size = min(max(abs(speed), slowest), fastest)
        return size if speed >= 0 else -size

    def step(s: tuple[int, int, int, int, int] | None, row: Any) -> tuple[tuple, list[tuple]]:
        x, y, dx, dy, seed = s or (*row.start, row.seed)
        x, dx, met = turned(x + dx, dx, width)
        y += dy
        if met:
            dy, seed = changed(dy, seed)
        y, dy, met = turned(y, dy, height)
        if met:
            dx, seed = changed(dx, seed)
        s = (x, y, held(dx), held(dy), seed)
        return s, [(getattr(row, key), row.tick, *s[:4])]

    return step
