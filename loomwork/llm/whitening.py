"""Embedding whitening by a one-sided Jacobi SVD.

The centred rows are compressed block by block to triangular factors R (TSQR), which are
stacked and compressed again until one of the rows' dimension is left; its Gram matrix is
that of all rows, without ever being formed. Plane rotations make R's columns orthogonal.
The product of the rotations holds the components, the columns' lengths are the standard
deviations times the root of the number of rows, small ones as accurate as large ones."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint

#: Entries become floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 1024, 100_000
#: Components that are given out.
COMPONENTS = 8
#: Factors that one task stacks and compresses.
FAN_IN = 32
#: Rows that are worked on at once.
BLOCK_ROWS = 4096
#: A column shorter than this share of the longest is rounding: its component has no spread.
NO_SPREAD = 1e-13


def jacobi(r: np.ndarray, sweeps: int = 40, tolerance: float = 1e-15) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, rotations): rotations v, orthogonal, such that r @ v has orthogonal columns
    of these lengths, falling. In each step of a sweep every column is in one pair (a round
    robin), so that all rotations of a step are made at once."""
    d = r.shape[1]
    a, v = np.array(r, np.float64), np.eye(d)
    n = d + d % 2
    seats = np.arange(n)
    for _ in range(sweeps):
        worst = 0.0
        for _ in range(n - 1):
            p, q = seats[: n // 2], seats[n // 2 :][::-1]
            real = (p < d) & (q < d)
            p, q = p[real], q[real]
            x, y = a[:, p], a[:, q]
            alpha, beta, gamma = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            size = np.sqrt(alpha * beta)
            turn = np.abs(gamma) > tolerance * size
            if turn.any():
                worst = max(worst, float((np.abs(gamma[turn]) / size[turn]).max()))
                zeta = (beta - alpha) / (2 * np.where(turn, gamma, 1.0))
                t = np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
                t = np.where(turn, t, 0.0)
                c = 1 / np.hypot(1.0, t)
                s = c * t
                a[:, p], a[:, q] = c * x - s * y, s * x + c * y
                vp, vq = v[:, p], v[:, q]
                v[:, p], v[:, q] = c * vp - s * vq, s * vp + c * vq
            seats = np.concatenate([seats[:1], seats[-1:], seats[1:-1]])
        if worst <= tolerance * 10:
            break
    lengths = np.sqrt((a * a).sum(0))
    order = np.argsort(-lengths, kind="stable")
    return lengths[order], v[:, order]


@dataclass
class Model:
    """``n`` vectors with per-dimension ``sums`` (exact); components as columns of ``v``
    with their standard deviations ``sigma``, all of them, falling."""

    n: int
    sums: list[int]
    v: np.ndarray
    sigma: np.ndarray
    scale: int = SCALE
    shift: int = SHIFT

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x - sums, exact: as integers of 64 bits, of any size where these don't do."""
        if self.n * max(1, int(np.abs(x).max(initial=0))) + max(map(abs, self.sums), default=0) < 1 << 62:
            return x * self.n - np.array(self.sums, np.int64)
        return x.astype(object) * self.n - np.array(self.sums, object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x less the mean, rounded once."""
        return (self.deviations(x) / max(1, self.n)).astype(np.float64)

    def whitened(self, x: np.ndarray, k: int) -> np.ndarray:
        """The first k coordinates; NaN for components without spread."""
        sigma = self.sigma[:k]
        sigma = np.where(sigma > NO_SPREAD * self.sigma[:1], sigma, np.nan)
        return self.centred(x) @ self.v[:, :k] / sigma

    def explained(self, k: int) -> np.ndarray:
        e = self.sigma**2
        return e[:k] / e.sum() if e.sum() > 0 else np.zeros(len(e[:k]))


def _grid(vectors: np.ndarray, scale: int, shift: int) -> np.ndarray:
    return np.floor(vectors * scale).astype(np.int64) + shift


def _matrices(b: pa.RecordBatch, column: str, dims: int) -> Iterator[tuple[int, np.ndarray]]:
    """The vectors of a batch in blocks: first row, matrix."""
    flat = b.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
    for start in range(0, len(flat), BLOCK_ROWS):
        yield start, flat[start : start + BLOCK_ROWS]


def usable(df: DataFrame, vector_col: str = "embedding", scale: int = SCALE, dims: int | None = None) -> tuple[DataFrame, int]:
    """The rows whose vector counts, as array<double>, and its length. Left out are null and
    empty vectors, vectors with a null or non-finite entry or with one beyond the grid of
    2 ** 60, and vectors of another length than ``dims`` or, without it, than the most
    frequent one (of equals the greatest)."""
    vector = F.col(vector_col).cast("array<double>")
    bound = float((1 << 60) / scale)
    # NaN counts as greater than any number
    rows = df.withColumn(vector_col, vector).filter((F.size(vector_col) > 0) & F.forall(vector_col, lambda c: c.isNotNull() & (F.abs(c) < bound)))
    if dims is not None:
        return rows.filter(F.size(vector_col) == dims), dims
    most = rows.groupBy(F.size(vector_col).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    dims = most["d"] if most else 0
    return rows.filter(F.size(vector_col) == dims), dims


def _sums(rows: DataFrame, column: str, dims: int, scale: int, shift: int) -> tuple[int, list[int]]:
    """n and the exact sums; each task sends one number for each dimension."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * dims
        for b in batches:
            for _, m in _matrices(b, column, dims):
                x = _grid(m, scale, shift)
                n += len(x)
                exact = x.sum(axis=0) if np.abs(x).max(initial=0) < 1 << 50 else x.astype(object).sum(axis=0)
                total = [t + int(s) for t, s in zip(total, exact, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([*range(dims), -1], pa.int32()), pa.array([*map(str, total), str(n)])], names=["dim", "total"])

    parts = rows.select(column).mapInArrow(add, "dim int, total string")
    got = {r["dim"]: int(r["s"]) for r in parts.groupBy("dim").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("s")).collect()}
    return got.get(-1, 0), [got.get(k, 0) for k in range(dims)]


def _stack(blocks: Iterator[np.ndarray], dims: int) -> np.ndarray | None:
    r: np.ndarray | None = None
    for b in blocks:
        r = np.linalg.qr(b if r is None else np.vstack([r, b]), mode="r")
    return None if r is None else np.vstack([r, np.zeros((dims - len(r), dims))])


def _tsqr(rows: DataFrame, column: str, dims: int, model: Model) -> np.ndarray:
    """The triangular factor of all centred rows: one from each task, then rounds in which a
    task stacks FAN_IN of them; what is left at the end is one matrix, dims by dims."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = _stack((model.centred(_grid(m, model.scale, model.shift)) for b in batches for _, m in _matrices(b, column, dims)), dims)
        if r is not None:
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes()], pa.binary())], names=["r"])

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = _stack((np.frombuffer(x, np.float64).reshape(dims, dims) for b in batches for x in b.column("r").to_pylist()), dims)
        if r is not None:
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes()], pa.binary())], names=["r"])

    factors = checkpoint(rows.select(column).mapInArrow(first, "r binary"))
    while (n := factors.count()) > 1:
        factors = checkpoint(factors.repartition(-(-n // FAN_IN)).mapInArrow(again, "r binary"))
    return np.frombuffer(factors.first()["r"], np.float64).reshape(dims, dims)


def fit(df: DataFrame, vector_col: str = "embedding", scale: int = SCALE, shift: int = SHIFT) -> Model:
    """Mean, components and standard deviations of the usable vectors of ``df``. Only
    matrices of dims by dims come to the driver, whatever the number of rows."""
    rows, dims = usable(df, vector_col, scale)
    n, sums = _sums(rows, vector_col, dims, scale, shift) if dims else (0, [])
    model = Model(n, sums, np.eye(dims), np.zeros(dims), scale, shift)
    if n:
        lengths, model.v = jacobi(_tsqr(rows, vector_col, dims, model))
        model.sigma = lengths / np.sqrt(n)
        # of the two directions the one with a positive largest entry
        largest = model.v[np.abs(model.v).argmax(axis=0), np.arange(dims)]
        model.v = model.v * np.where(largest < 0, -1.0, 1.0)
    return model


def identity_error(df: DataFrame, model: Model, k: int = COMPONENTS, vector_col: str = "embedding") -> float:
    """The largest absolute entry of the whitened vectors' covariance less the identity, over
    the first k components with spread. Each task sends its sums of coordinates and of their
    products."""
    rows, dims = usable(df, vector_col, model.scale, len(model.sums))
    k = min(k, dims)
    if not model.n or not k:
        return 0.0

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for b in batches:
            for _, m in _matrices(b, vector_col, dims):
                w = model.whitened(_grid(m, model.scale, model.shift), k)
                total += np.vstack([w.T @ w, w.sum(axis=0)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.reshape(-1))], names=["place", "total"])

    parts = rows.select(vector_col).mapInArrow(products, "place int, total double")
    total = np.zeros((k + 1) * k)
    for r in parts.groupBy("place").agg(F.sum("total").alias("s")).collect():
        total[r["place"]] = r["s"]
    total = total.reshape(k + 1, k)
    mean = total[k] / model.n
    off = np.abs(total[:k] / model.n - np.outer(mean, mean) - np.eye(k))
    return float(np.nanmax(off)) if np.isfinite(off).any() else 0.0


def whiten(df: DataFrame, model: Model, k: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, deviation (decimal(38,0): sum over dimensions of (n * x - sums) ** 2, exact) and
    whitened (array<double>, the first k coordinates, null where a component has no spread)
    for each usable row of ``df``.

    Rows with null, empty, ragged or non-finite vectors are left out (``usable``). Null ids
    stay null, repeated rows give repeated rows and count as often in the fit, other columns
    are ignored, whatever they are called; an empty table gives an empty one. If two
    components have equal standard deviations their order and directions are those that the
    rotations end with, the same for all rows."""
    kind = dict(df.dtypes)[id_col]
    rows, dims = usable(df, vector_col, model.scale, len(model.sums))
    k = min(k, dims)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, m in _matrices(b, "vector", dims):
                x = _grid(m, model.scale, model.shift)
                dev = model.deviations(x)
                if dims * int(np.abs(dev).max(initial=0)) ** 2 < 1 << 62:
                    squares = (dev * dev).sum(axis=1)
                else:
                    squares = (dev.astype(object) ** 2).sum(axis=1)
                w = model.whitened(x, k)
                lists = pa.ListArray.from_arrays(np.arange(len(w) + 1, dtype=np.int32) * k, pa.array(w.reshape(-1), from_pandas=True))
                yield pa.RecordBatch.from_arrays([b.column("id").slice(start, len(w)), pa.array([str(s) for s in squares.tolist()], pa.string()), lists], names=["id", "deviation", "whitened"])

    if not dims:
        none = rows.select(F.col(id_col).alias("id"), F.lit(None).cast("string").alias("deviation"), F.array().cast("array<double>").alias("whitened"))
    else:
        none = rows.select(F.col(id_col).cast("string").alias("id"), F.col(vector_col).alias("vector")).mapInArrow(apply, "id string, deviation string, whitened array<double>")
    return none.select(F.col("id").cast(kind).alias(id_col), F.col("deviation").try_cast("decimal(38,0)").alias("deviation"), "whitened")


def as_long(c: Column) -> Column:
    """A decimal as a long, null beyond its range."""
    return F.when(c <= F.lit((1 << 63) - 1).cast("decimal(38,0)"), c).try_cast("long")


def report(df: DataFrame, k: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row for each usable row and component: id, component (from 1), n, deviation (null
    beyond a long), whitened, explained (share of the variance), identity_error."""
    model = fit(df, vector_col)
    error = identity_error(df, model, k, vector_col)
    share = F.array(*[F.lit(float(s)) for s in model.explained(k)]).cast("array<double>")
    rows = whiten(df, model, k, id_col, vector_col)
    out = rows.select(id_col, as_long(F.col("deviation")).alias("deviation"), F.posexplode("whitened").alias("place", "whitened"))
    return out.select(id_col, (F.col("place") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.get(share, F.col("place")).alias("explained"), F.lit(error).alias("identity_error"))

