"""Quality classification by co-training.

Two classifiers see a document from two sides: the text view its words (repetition,
characters), the metadata view its other columns and the layout of its page (lines, what
they end with, separators). In each round each view labels all documents of the corpus that
it is sure of, and the other learns from them: their gradients and a bound of their Hessians are
summed on the executors. In the end both views are calibrated on labelled rows
kept aside and combined."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from itertools import combinations
from operator import eq

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK, apply_logistic, code_points, first_by_hash, fit_logistic, labelled_sample, new_folder, sigmoid

#: Places of the metadata view for hashed values of each text column and of each pair of
#: them; steps of a number column (powers of two).
PLACES, STEPS = 32, 24
#: Tasks that sum what the others have summed; the driver gets a row from each.
SUMS = 64
#: Kinds of characters: letter, upper case, digit, white space, plain punctuation, ! or ?,
#: other.
_KINDS = 7
_KIND_OF: np.ndarray | None = None


def _kind_table() -> np.ndarray:
    global _KIND_OF
    if _KIND_OF is None:
        table = np.full(0x110000, 6, np.uint8)
        for i in range(0x110000):
            ch = chr(i)
            if ch.isalpha():
                table[i] = 1 if ch.isupper() else 0
            elif ch.isdigit():
                table[i] = 2
            elif ch.isspace():
                table[i] = 3
        for ch in ".,;:'\"()-’“”–":
            table[ord(ch)] = 4
        for ch in "!?":
            table[ord(ch)] = 5
        _KIND_OF = table
    return _KIND_OF


def shape(text: str | None) -> list[float]:
    """The text view of one whole text."""
    text = text or ""
    table, kinds = _kind_table(), np.zeros(_KINDS, np.int64)
    for start in range(0, len(text), CHUNK):
        kinds += np.bincount(table[code_points(text[start : start + CHUNK])], minlength=_KINDS)
    words = text.split()
    n = max(1, len(words))
    counts = Counter(words)
    chars = max(1, int(kinds.sum() - kinds[3]))
    letters = max(1, int(kinds[0] + kinds[1]))
    size = np.log1p(len(words))
    unique, top = len(counts) / n, max(counts.values(), default=0) / n
    twice = sum(map(eq, words, words[1:])) / n
    return [
        size,
        unique,
        top,
        twice,
        unique * size,
        top * size,
        twice * size,
        kinds[1] / letters,
        kinds[2] / chars,
        kinds[4] / chars,
        kinds[5] / chars,
        kinds[6] / chars,
        letters / chars,
        chars / n,
    ]


def layout(text: str | None) -> list[float]:
    """How the text lies on its page: lines, what they begin and end with, separators."""
    text = text or ""
    size, lines = max(1, len(text)), text.split("\n")
    lengths = np.array([len(x) for x in lines])
    full = [t for x in lines if (t := x.strip())]
    n = max(1, len(full))
    return [
        np.log1p(len(lines)),
        np.log1p(size / len(lines)),
        np.log1p(lengths.max()),
        np.log1p(lengths.min()),
        lengths.std() / max(1.0, lengths.mean()),
        sum(x[-1] in ".!?…" for x in full) / n,
        sum(x[0].isupper() for x in full) / n,
        len(set(full)) / n,
        100 * (text.count("|") + text.count("\t") + text.count("•")) / size,
        100 * (text.count(".\n") + text.count(". ") + text.endswith(".")) / size,
        100 * text.count(", ") / size,
    ]


def metadata(columns: list[str], values: tuple, text: str | None) -> tuple[list[float], list[int]]:
    """The metadata view of one row: numbers (of the layout; of each column a logarithm and
    its ratio to the text's real length, 0 for text columns), and the places that are 1: hashed
    values of text columns and of pairs of them, steps of numbers, missing values."""
    dense, places, said = layout(text), [], []
    real = np.log1p(len(text or ""))
    for k, (name, v) in enumerate(zip(columns, values, strict=True)):
        at, number, ratio = k * (PLACES + STEPS + 1), 0.0, 0.0
        if isinstance(v, str):
            said.append(f"{name}={v}")
            places.append(at + xxhash.xxh32_intdigest(said[-1].encode("utf-8", "surrogatepass")) % PLACES)
        elif v is None or v != v:
            places.append(at + PLACES + STEPS)
        else:
            number = np.log1p(min(abs(float(v)), 1e18))
            ratio = np.clip(number - real, -3, 3)
            places.append(at + PLACES + min(STEPS - 1, int(number / np.log(2))))
        dense += [number, ratio]
    for pair in combinations(said, 2):
        places.append(len(columns) * (PLACES + STEPS + 1) + xxhash.xxh32_intdigest("&".join(pair).encode("utf-8", "surrogatepass")) % PLACES)
    return dense, places


@dataclass
class Views:
    """Both views of some rows: text, the metadata's numbers, its places (row, place)."""

    text: np.ndarray
    dense: np.ndarray
    row: np.ndarray
    place: np.ndarray

    def __len__(self) -> int:
        return len(self.text)

    @staticmethod
    def of(rows: pd.DataFrame) -> Views:
        read = lambda c, t: [np.frombuffer(x, t) for x in rows[c]]
        if not len(rows):
            return Views(np.zeros((0, 1)), np.zeros((0, 1)), np.zeros(0, int), np.zeros(0, int))
        places = read("places", np.uint32)
        return Views(np.array(read("xt", np.float32), np.float64), np.array(read("dense", np.float32), np.float64), np.repeat(np.arange(len(rows)), [len(p) for p in places]), np.concatenate(places).astype(int))

    def some(self, rows: np.ndarray) -> Views:
        """The rows of these numbers."""
        new = np.full(len(self), -1)
        new[rows] = np.arange(len(rows))
        keep = new[self.row] >= 0
        return Views(self.text[rows], self.dense[rows], new[self.row[keep]], self.place[keep])


@dataclass
class Model:
    columns: list[str]
    #: mean and deviation of the text view's and of the metadata view's numbers
    moments: tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
    prior: float
    weights: list[np.ndarray] = field(default_factory=list)
    scale: list[np.ndarray] = field(default_factory=list)
    #: for each view the probabilities up to which and from which on it teaches the other
    sure: list[tuple[float, float]] = field(default_factory=list)
    #: for each round and view, how many documents it labelled 0 and 1
    taught: list[list[tuple[int, int]]] = field(default_factory=list)

    def inputs(self, v: Views) -> tuple[np.ndarray, np.ndarray]:
        """The features of both views."""
        out = []
        for x, (mean, sd) in zip((v.text, v.dense), self.moments, strict=True):
            z = np.clip((x - mean) / sd, -6, 6)
            out.append([z, z * z / 4])
        hot = np.zeros((len(v), len(self.columns) * (PLACES + STEPS + 1) + PLACES))
        hot[v.row, v.place] = 1
        return np.hstack(out[0]), np.hstack([*out[1], hot])

    def odds(self, inputs: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
        """Calibrated log odds of both views."""
        return [apply_logistic(x, w) * s[0] + s[1] for x, w, s in zip(inputs, self.weights, self.scale, strict=True)]

    def score(self, v: Views) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probabilities of good quality: of both views together, of each."""
        t, m = self.odds(self.inputs(v))
        return sigmoid(t + m - self.prior), sigmoid(t), sigmoid(m)


def _platt(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Slope (not below 0) and intercept of the log odds given a margin."""
    slope, cut = fit_logistic(z[:, None], y, l2=1.0)
    if slope <= 0:
        p = (y.sum() + 1) / (len(y) + 2)
        return np.array([0.0, np.log(p / (1 - p))])
    return np.array([slope, cut])


def _sure_from(q: np.ndarray, y: np.ndarray, precision: float, least: int = 8) -> tuple[float, float]:
    """Up to and from which probabilities a view's labels are right with this precision on
    labelled rows, as many rows as possible. A view without such probabilities (inf) does
    not teach that class."""
    out = []
    for z, hit in ((-q, y == 0), (q, y == 1)):
        order = np.argsort(-z, kind="stable")
        right = np.cumsum(hit[order]) / np.arange(1, len(z) + 1)
        ends = np.append(z[order][1:] != z[order][:-1], True)  # equal probabilities go together
        good = np.flatnonzero((right >= precision) & ends & (np.arange(len(z)) + 1 >= min(least, max(1, hit.sum()))))
        out.append(z[order][good[-1]] if len(good) else np.inf)
    return -out[0], out[1]


def _calibrate(model: Model, inputs: tuple[np.ndarray, np.ndarray], y: np.ndarray, precision: float) -> None:
    model.scale = [_platt(apply_logistic(x, w), y) for x, w in zip(inputs, model.weights, strict=True)]
    model.sure = [_sure_from(sigmoid(z), y, precision) for z in model.odds(inputs)]


def _lessons(model: Model, v: Views) -> list[list[tuple[np.ndarray, np.ndarray, int]]]:
    """For each pupil (text view, metadata view) and label the gradient at the pupil's weights,
    the Hessian's bound (a quarter of the rows' products, whatever the weights) and the
    number of the rows that the other view is sure of."""
    inputs = model.inputs(v)
    q = [sigmoid(z) for z in model.odds(inputs)]
    out = []
    for pupil, teacher in ((0, 1), (1, 0)):
        x = np.hstack([inputs[pupil], np.ones((len(v), 1))])
        low, high = model.sure[teacher]
        p = sigmoid(x @ model.weights[pupil])
        each = []
        for label, rows in ((0.0, np.flatnonzero(q[teacher] <= low)), (1.0, np.flatnonzero(q[teacher] >= high))):
            r, xr = p[rows], x[rows]
            each.append((xr.T @ (r - label), xr.T @ xr / 4, len(rows)))
        out.append(each)
    return out


def _added(a: list, b: list) -> list:
    return [[tuple(s + t for s, t in zip(m, n, strict=True)) for m, n in zip(x, y, strict=True)] for x, y in zip(a, b, strict=True)]


def start(v: Views, y: np.ndarray, columns: list[str], precision: float = 0.95) -> tuple[Model, np.ndarray]:
    """Both views fitted on labelled rows alone, and which rows are kept aside: every fourth,
    for calibration (all, where one class would lack)."""
    aside = np.arange(len(y)) % 4 == 3
    if min(len(set(y[aside])), len(set(y[~aside]))) < 2:
        aside = np.zeros(len(y), bool)
    p = float(np.clip(y.mean(), 0.01, 0.99))
    moments = tuple((x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)) for x in (v.text, v.dense))
    model = Model(columns, moments, float(np.log(p / (1 - p))))
    inputs = model.inputs(v)
    model.weights = [fit_logistic(x[~aside], y[~aside]) for x in inputs]
    check = aside if aside.any() else ~aside
    _calibrate(model, tuple(x[check] for x in inputs), y[check], precision)
    return model, aside


def _descend(x: np.ndarray, y: np.ndarray, w0: np.ndarray, g0: np.ndarray, h0: np.ndarray, steps: int = 20) -> np.ndarray:
    """The weights of the least logistic loss over x, y plus the quadratic that has the
    gradient ``g0`` at ``w0`` and the Hessian ``h0``: Newton steps, halved until they help."""
    ridge = np.append(np.ones(len(w0) - 1), 1e-3)

    def loss(w: np.ndarray) -> float:
        z, d = x @ w, w - w0
        return float(np.logaddexp(0, z).sum() - y @ z + ridge @ (w * w) / 2 + g0 @ d + d @ h0 @ d / 2)

    w, now = w0, loss(w0)
    for _ in range(steps):
        p = sigmoid(x @ w)
        g = x.T @ (p - y) + ridge * w + g0 + h0 @ (w - w0)
        d = np.linalg.solve((x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x + np.diag(ridge) + h0, g)
        size = 1.0
        while size > 1e-4 and loss(w - size * d) >= now:
            size /= 2
        if size <= 1e-4:
            break
        w = w - size * d
        now = loss(w)
    return w


def next_round(model: Model, v: Views, y: np.ndarray, aside: np.ndarray, lessons: list, share: float = 0.5, precision: float = 0.95) -> Model:
    """Both views after learning what the other taught, beside the labelled rows. All
    pseudo-labels together weigh ``share`` of the labelled rows, each label as much as in
    the labelled rows."""
    inputs = model.inputs(v)
    new = replace(model, weights=[], taught=[*model.taught, [tuple(n for _, _, n in lessons[pupil]) for pupil in (1, 0)]])
    for pupil, x in enumerate(inputs):
        w = model.weights[pupil]
        x = np.hstack([x[~aside], np.ones(((~aside).sum(), 1))])
        g, h = np.zeros(len(w)), np.zeros((len(w), len(w)))
        for label, (gl, hl, n) in enumerate(lessons[pupil]):
            weight = share * (y[~aside] == label).sum() / max(1, n)
            g, h = g + weight * gl, h + weight * hl
        # rounded, as sums in another order differ in their last digits
        new.weights.append(np.round(_descend(x, y[~aside], w, g, h), 9))
    check = aside if aside.any() else ~aside
    _calibrate(new, tuple(x[check] for x in inputs), y[check], precision)
    return new


def _viewed(rows: DataFrame, columns: list[str], keep: list[str]) -> DataFrame:
    """Both views of each row (text, m0, m1, ...), computed on the executors."""

    def views(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            meta = [metadata(columns, m, t) for m, t in zip(_values(b, columns), b["text"], strict=True)]
            yield pd.DataFrame({
                **{k: b[k].to_numpy() for k in keep},
                "xt": [np.array(shape(t), np.float32).tobytes() for t in b["text"]],
                "dense": [np.array(d, np.float32).tobytes() for d, _ in meta],
                "places": [np.array(p, np.uint32).tobytes() for _, p in meta],
            })

    fields = "".join(f"{k} {t}, " for k, t in rows.dtypes if k in keep)
    return rows.mapInPandas(views, fields + "xt binary, dense binary, places binary")


def _values(b: pd.DataFrame, columns: list[str]) -> list[tuple]:
    return list(zip(*(b[c] for c in columns), strict=True)) if columns else [()] * len(b)


def _taught(views: DataFrame, model: Model) -> list:
    """The lessons of all rows: summed in each task, then in SUMS tasks, then here."""
    shared = views.sparkSession.sparkContext.broadcast(model)

    def pack(total: list | None) -> pd.DataFrame:
        parts = [] if total is None else [(p, label, g.tobytes(), h.tobytes(), n) for p, each in enumerate(total) for label, (g, h, n) in enumerate(each) if n]
        return pd.DataFrame(parts, columns=["pupil", "label", "g", "h", "n"])

    def per_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for b in batches:
            if len(b):
                one = _lessons(shared.value, Views.of(b))
                total = one if total is None else _added(total, one)
        yield pack(total)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield pack(_unpacked(batches))

    schema = "pupil int, label int, g binary, h binary, n long"
    rows = views.mapInPandas(per_task, schema).repartition(SUMS).mapInPandas(sums, schema).toPandas()
    return _unpacked([rows])


def _unpacked(batches) -> list:
    total = [[(0.0, 0.0, 0), (0.0, 0.0, 0)], [(0.0, 0.0, 0), (0.0, 0.0, 0)]]
    for b in batches:
        for pupil, label, g, h, n in b.itertuples(index=False):
            g = np.frombuffer(g)
            a = total[pupil][label]
            total[pupil][label] = (a[0] + g, a[1] + np.frombuffer(h).reshape(len(g), len(g)), a[2] + n)
    return total


def _views_of(docs: DataFrame, text_col: str, columns: list[str]) -> list:
    """The text and the metadata columns (numbers as double, others as text)."""
    kinds = dict(docs.dtypes)
    numbers = ("tinyint", "smallint", "int", "bigint", "float", "double")
    return [F.col(text_col).alias("text"), *(F.col(c).cast("double" if kinds[c] in numbers else "string").alias(f"m{k}") for k, c in enumerate(columns))]


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 6000, rounds: int = 3, metadata_cols: tuple[str, ...] = ("source", "lang", "n_chars"), id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", share: float = 0.5, precision: float = 0.95) -> Model | None:
    """Train on the documents that ``labels`` (id, 0 or 1) names, ``sample_rows`` of them at
    most, and in ``rounds`` rounds on all documents of which a view is sure: their features
    are written to the shared folder once, and each round reads only these. None if there
    are not labels of both classes. Metadata columns that ``docs`` lacks are left out; null
    labels and rows without text are not learned from. An id that is labelled several
    times counts once, not at all if its labels differ."""
    columns = [c for c in metadata_cols if c in docs.columns]
    names = [f"m{k}" for k in range(len(columns))]
    rows = labelled_sample(docs, labels, label_col, sample_rows, id_col).filter(F.trim(F.col(text_col)) != "")
    rows = rows.select(F.col("_label").alias("y"), F.col(id_col).cast("string").alias("id"), *_views_of(docs, text_col, columns))
    got = first_by_hash(_viewed(rows, names, ["y", "id"]), "id", sample_rows).toPandas()
    if got["y"].nunique() < 2:
        return None
    v, y = Views.of(got), got["y"].to_numpy(float)
    model, aside = start(v, y, names, precision)
    if rounds:
        folder = new_folder(docs.sparkSession, "views")
        _viewed(docs.filter(F.trim(F.col(text_col)) != "").select(*_views_of(docs, text_col, columns)), names, []).write.parquet(folder)
        views = docs.sparkSession.read.parquet(folder)
        for _ in range(rounds):
            model = next_round(model, v, y, aside, _taught(views, model), share, precision)
    return model


def classify(docs: DataFrame, model: Model | None, metadata_cols: tuple[str, ...] = ("source", "lang", "n_chars"), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score, text_score, metadata_score (probabilities of good quality) and accepted
    (score of 0.5 or more) for every row of ``docs``.

    Null, empty and blank texts score 0; very long texts are read whole. Without a model (nothing to learn from) all
    other texts score 0.5. Null ids stay null, repeated rows give repeated rows, other
    columns are ignored, an empty table gives an empty one."""
    kind = dict(docs.dtypes)[id_col]
    columns = [c for c in metadata_cols if c in docs.columns]
    rows = docs.select(F.col(id_col).cast("string").alias("id"), *_views_of(docs, text_col, columns))
    out = rows.mapInPandas(_scorer(rows, model, columns), "id string, score double, text_score double, metadata_score double")
    return out.select(F.col("id").cast(kind).alias(id_col), "score", "text_score", "metadata_score", (F.col("score") >= 0.5).alias("accepted"))


def _scores(model: Model | None, names: list[str], b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores of a batch with the columns text and m0, m1, ..."""
    has_words = np.array([bool(t and not t.isspace()) for t in b["text"]])
    if model is None:
        return (has_words * 0.5,) * 3
    meta = [metadata(names, m, t) for m, t in zip(_values(b, names), b["text"], strict=True)]
    sizes = [len(p) for _, p in meta]
    v = Views(np.array([shape(t) for t in b["text"]]), np.array([d for d, _ in meta]), np.repeat(np.arange(len(b)), sizes), np.fromiter((x for _, p in meta for x in p), int, sum(sizes)))
    return tuple(p * has_words for p in model.score(v))


def _scorer(rows: DataFrame, model: Model | None, columns: list[str]):
    shared = rows.sparkSession.sparkContext.broadcast(model)
    names = [f"m{k}" for k in range(len(columns))]

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for k in range(0, len(whole), 1000):
                b = whole.iloc[k : k + 1000]
                s, t, m = _scores(shared.value, names, b)
                yield pd.DataFrame({"id": b["id"].to_numpy(), "score": s, "text_score": t, "metadata_score": m})

    return score


def keep_good(docs: DataFrame, labels: DataFrame, metadata_cols: tuple[str, ...] = ("source", "lang", "n_chars"), text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is 0.5 or more. The decision is taken
    where the row is read: nothing is shuffled. Options as for fit."""
    model = fit(docs, labels, metadata_cols=metadata_cols, text_col=text_col, **options)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    columns = [c for c in metadata_cols if c in docs.columns]
    names = [f"m{k}" for k in range(len(columns))]

    @F.pandas_udf("boolean")
    def accepted(view: pd.DataFrame) -> pd.Series:
        parts = [_scores(shared.value, names, view.iloc[k : k + 1000])[0] >= 0.5 for k in range(0, len(view), 1000)]
        return pd.Series(np.concatenate([np.zeros(0, bool), *parts]))

    return docs.filter(accepted(F.struct(*_views_of(docs, text_col, columns))))
