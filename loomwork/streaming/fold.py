"""Ordered folds: a state for each key that its rows change one after the other.

The same step function runs over a table (rows dealt by key, sorted, streamed through a
task with one state in memory, never a whole group) and over a stream (the state kept by
Structured Streaming between micro-batches)."""

from __future__ import annotations

import pickle
from collections import namedtuple
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (state or None, row) -> (state, rows to give out)
Step = Callable[[Any, Any], tuple[Any, list[tuple]]]
_TYPES = {"long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}


def fold(df: DataFrame, keys: list[str], order: list[str | Column], step: Step, schema: str) -> DataFrame:
    """Over a table: ``schema`` names the columns that ``step`` gives out (long, int, double,
    string, boolean). Rows with equal order are taken as they come; add a column that tells
    them apart. ``step`` gets rows as Spark has them: integers stay integers beside nulls,
    null is None, and rows with null keys are one sequence like others."""
    columns = df.columns
    out_schema = pa.schema([(f.split()[0], _TYPES[f.split()[1]]) for f in schema.split(",")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row_of, at = namedtuple("Row", columns), [columns.index(k) for k in keys]
        key, state = None, None
        for b in batches:
            out: list[tuple] = []
            for row in map(row_of._make, zip(*(c.to_pylist() for c in b.columns), strict=True)):
                k = tuple(row[i] for i in at)
                if k != key:
                    key, state = k, None
                state, rows = step(state, row)
                out += rows
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(out_schema)], schema=out_schema)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def fold_stream(df: DataFrame, keys: list[str], order: list[str], step: Step, schema: str) -> DataFrame:
    """Over a stream: each micro-batch's rows of a key are taken in order, after those of
    the batches before. They are sorted in memory, so a micro-batch (maxFilesPerTrigger or
    maxOffsetsPerTrigger of its source) bounds what a key holds at once. Null keys are one
    sequence; integers with nulls among them reach ``step`` as Int64."""
    names = [f.split()[0] for f in schema.split(",")]

    def run(key: tuple, parts: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        state = pickle.loads(held.get[0]) if held.exists else None
        out: list[tuple] = []
        for row in pd.concat(list(parts)).sort_values(order).convert_dtypes(dtype_backend="numpy_nullable").itertuples(index=False):
            state, rows = step(state, row)
            out += rows
        held.update((pickle.dumps(state),))
        yield pd.DataFrame(out, columns=names)

    return df.groupBy(*keys).applyInPandasWithState(run, schema, "state binary", "append", "NoTimeout")


def ticks(df: DataFrame, seconds: int, ts: str = "ts", late: str | None = "10 minutes") -> DataFrame:
    """Rows counted in windows of so many seconds, those of a stream late up to ``late`` (None:
    a table)."""
    return (df.withWatermark(ts, late) if late else df).groupBy(F.window(ts, f"{seconds} seconds").alias("w")).agg(F.count("*").alias("n")).select("w.start", "w.end", "n")
