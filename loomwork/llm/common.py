"""Pieces that several operators share: the shared folder, checked broadcasts,
bounded samples of labelled rows, small linear models and n-gram features."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Code points that one step of the feature code looks at, so that memory stays
#: bounded for texts of any length.
CHUNK = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset,
    a single process (``local``, as in tests) gets a temporary folder of its own; on a
    cluster it is an error, as nothing else is known to be shared."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc._jsc.sc().getCheckpointDir().getOrElse(None)
    if not where and not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    where = where or "file://" + tempfile.mkdtemp(prefix="loomwork-")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(where)
    return where


def checkpoint(df: DataFrame) -> DataFrame:
    """``df`` computed once and stored in the shared folder, its lineage cut."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def small_side(df: DataFrame, rows: int, bound: int) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``bound`` rows; otherwise as it
    is, for a shuffled join."""
    return F.broadcast(df) if rows <= bound else df


def crc_mod(col: Column, n: int) -> Column:
    """crc32 of the column as text, modulo n; null for null."""
    return F.crc32(F.encode(col.cast("string"), "UTF-8")) % n


def hash_share(col: Column, seed: int) -> Column:
    """A number in [0, 1) from a hash of the column."""
    return F.pmod(F.xxhash64(col.cast("string"), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)


def first_by_hash(df: DataFrame, key: str, cap: int, seed: int = 7) -> DataFrame:
    """The ``cap`` rows of least hash of ``key``, ties by the row's values: the same rows in
    every run. Each task keeps ``cap`` rows at most."""
    return df.orderBy(F.xxhash64(F.col(key).cast("string"), F.lit(seed)), *df.columns).limit(cap)


def share_by(df: DataFrame, label: str, key: str, cap: int, seed: int = 7) -> DataFrame:
    """About ``cap`` rows in all of ``df``, the same share of the cap for each value of
    ``label``; rows are picked by a hash of ``key``. Rows with one key are picked together,
    so what must hold the bound goes through ``first_by_hash`` as well, once its rows are
    small."""
    counts = {r[label]: r["count"] for r in df.groupBy(label).count().collect() if r[label] is not None}
    if not counts:
        return df.filter(F.lit(False))
    each = cap / len(counts)
    spare = sum(max(0.0, each - n) for n in counts.values())
    large = sum(n > each for n in counts.values())
    each += spare / max(1, large)
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, 0.97 * each / n) if n > each else 1.0)])
    return df.filter(hash_share(F.col(key), seed) < F.try_element_at(share, F.col(label)))


def sample_by(df: DataFrame, label: str, key: str, cap: int, seed: int = 7) -> DataFrame:
    """``share_by`` of narrow rows, ``cap`` at most."""
    return first_by_hash(share_by(df, label, key, cap, seed), key, cap, seed)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, cap: int, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that ``cap`` rows of ``labels`` at most name, with their label
    as ``_label`` (double). Only the sampled ids are sent to the scan of ``docs``, so no
    text is shuffled. Null labels and ids are left out. An id that is labelled several
    times counts once; one whose labels differ not at all."""
    known = labels.select(F.col(id_col).alias("_id"), F.col(label).cast("double").alias("_label")).dropna()
    known = known.groupBy("_id").agg(F.min("_label").alias("_label"), F.max("_label").alias("_most")).filter("_label = _most").drop("_most")
    picked = F.broadcast(sample_by(known, "_label", "_id", cap))
    return docs.join(picked, F.col(id_col) == F.col("_id")).drop("_id")


# ---------------------------------------------------------------- linear models


def sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, l2: float = 1.0, steps: int = 12) -> np.ndarray:
    """Weights, the intercept last, by damped Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))]).astype(np.float64)
    s = np.ones(len(x)) if weight is None else weight
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], l2)
    ridge[-1] = 1e-3
    for _ in range(steps):
        p = sigmoid(x @ w)
        g = x.T @ (s * (p - y)) + ridge * w
        h = (x * (s * np.maximum(p * (1 - p), 1e-4))[:, None]).T @ x + np.diag(ridge)
        d = np.linalg.solve(h, g)
        w -= d
        if np.abs(d).max() < 1e-4:
            break
    return w


def apply_logistic(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


def fit_svm(x: np.ndarray, y: np.ndarray, rows: np.ndarray | None = None, c: float = 1.0, epochs: int = 12, seed: int = 3) -> np.ndarray:
    """A linear support vector machine (hinge loss, y in -1 and 1) by dual coordinate
    descent over the given rows of ``x``, which is not copied; y has one entry for each of
    them. The last weight belongs to a constant feature."""
    rows = np.arange(len(x)) if rows is None else rows
    n_pos, n_neg = max(1, (y > 0).sum()), max(1, (y < 0).sum())
    bound = np.where(y > 0, len(y) / (2 * n_pos), len(y) / (2 * n_neg)) * c
    q = np.einsum("ij,ij->i", x, x)[rows] + 1.0
    a = np.zeros(len(rows))
    w, base = np.zeros(x.shape[1], np.float32), 0.0
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            row = x[rows[i]]
            g = y[i] * (float(w @ row) + base) - 1.0
            new = min(max(a[i] - g / q[i], 0.0), bound[i])
            if new != a[i]:
                by = (new - a[i]) * y[i]
                w += np.float32(by) * row
                base += by
                moved = max(moved, abs(new - a[i]))
                a[i] = new
        if moved < 1e-3:
            break
    return np.append(w, np.float32(base))


# ------------------------------------------------------------- n-gram features


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


_LETTER: np.ndarray | None = None


def letter_table() -> np.ndarray:
    """For each code point whether it is a letter."""
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)
    return _LETTER


def letter_ngrams(text: str, dims: int) -> np.ndarray:
    """Counts of hashed 1-, 2-, 3- and 4-grams of the lower-case letters, every run of
    other characters being one blank. Whole text, in chunks."""
    out = np.zeros(dims, np.float64)
    letters = letter_table()
    text = text.lower()
    for start in range(0, len(text), CHUNK):
        c = code_points(text[max(0, start - 3) : start + CHUNK])
        is_letter = letters[c]
        keep = is_letter.copy()
        keep[1:] |= is_letter[:-1]
        c = np.where(is_letter, c, 32)[keep].astype(np.uint32)
        c = np.concatenate([np.array([32], np.uint32), c])
        h = c * np.uint32(2654435761)
        for _ in range(4):
            out += np.bincount((h ^ (h >> np.uint32(15))) & np.uint32(dims - 1), minlength=dims)
            if len(h) < 2:
                break
            c = c[1:]
            h = (h[:-1] ^ (h[:-1] >> np.uint32(13))) * np.uint32(2246822519) + c * np.uint32(3266489917)
    return out


def unit_rows(counts: np.ndarray) -> np.ndarray:
    """Square roots of the counts, each row of length one; float32 counts are overwritten."""
    x = counts.astype(np.float32, copy=False)
    np.sqrt(x, out=x)
    x /= np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), 1e-9)[:, None]
    return x
