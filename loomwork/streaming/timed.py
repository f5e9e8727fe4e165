"""Folds over streams whose state also acts when time has passed and no row comes."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import DataFrame


class Machine(Protocol):
    """A state machine with a clock. A state is None or whatever ``step`` makes of it."""

    def step(self, state: Any, row: Any) -> tuple[Any, list[tuple]]: ...

    def due(self, state: Any) -> int | None:
        """When the state acts by itself, in milliseconds; None: never."""

    def fire(self, state: Any) -> tuple[Any, list[tuple]]:
        """What it does then."""


def fold_timed(df: DataFrame, keys: list[str], order: list[str], machine: Machine, schema: str, ts: str, late: str) -> DataFrame:
    """Rows of a stream through a machine for each key, in order within a micro-batch. The state's
    time is an event-time timer: it fires once the watermark (``ts`` less ``late``) has passed
    it, so the same rows come out however the stream is cut into batches. Rows later than
    the watermark are dropped. A key without a state keeps nothing."""
    names = [f.split()[0] for f in schema.split(",")]

    def run(key: tuple, parts: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        state = pickle.loads(held.get[0]) if held.exists else None
        out: list[tuple] = []
        if held.hasTimedOut:
            state, out = machine.fire(state)
        else:
            for row in pd.concat(list(parts)).sort_values(order).itertuples(index=False):
                state, rows = machine.step(state, row)
                out += rows
        if state is None:
            if held.exists:
                held.remove()
        else:
            held.update((pickle.dumps(state),))
            due = machine.due(state)
            if due is not None:
                held.setTimeoutTimestamp(max(due, held.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=names)

    return df.withWatermark(ts, late).groupBy(*keys).applyInPandasWithState(run, schema, "state binary", "append", "EventTimeTimeout")


class Reaction:
    """Targets, taps and time-outs (``intervals.reactions`` is the same over a table). Rows have
    key, id, at (milliseconds) and shown (else tapped). The state is the open target."""

    def __init__(self, key: str, id_col: str, limit: int):
        self.key, self.id, self.limit = key, id_col, limit

    def step(self, state: tuple | None, row: Any) -> tuple[tuple | None, list[tuple]]:
        key, number, now, out = getattr(row, self.key), getattr(row, self.id), row.at, []
        if state is not None and now - state[2] > self.limit:
            state, out = self.fire(state)
        if row.shown:
            if state is not None:
                out.append((key, state[1], state[1], "replaced", None))
            return (key, number, now), out
        out.append((key, number, None, "early", None) if state is None else (key, number, state[1], "hit", now - state[2]))
        return None, out

    def due(self, state: tuple) -> int:
        return state[2] + self.limit

    def fire(self, state: tuple) -> tuple[None, list[tuple]]:
        return None, [(state[0], state[1], state[1], "too slow", None)]
