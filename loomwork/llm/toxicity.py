"""Toxicity classification, regularised by counterfactuals.

A logistic classifier over the words of a text and their beginnings. In labelled sentences
that name groups of people, the group is swapped for another of its kind; into a labelled
sentence of a text that names none, a mention is inserted and then swapped. The fit pays
for every change of the score that an insertion or a swap makes: what is learned from the
neighbours of a group's name, or from words that begin like it, is not laid at the group's
door."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import first_by_hash, labelled_sample, sigmoid

#: Names of groups; those of a line can stand for each other. A caller's own list takes
#: the place of these.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("gay", "lesbian", "bisexual", "straight", "transgender"),
    ("black", "white", "asian", "latino"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("old", "young"),
    ("deaf", "blind", "disabled"),
    # German
    ("frauen", "männer", "mädchen", "jungen"),
    ("frau", "mann"),
    ("muslime", "christen", "juden", "hindus", "buddhisten", "atheisten"),
    ("schwule", "lesben", "bisexuelle", "heterosexuelle"),
    ("schwarze", "weiße", "asiaten", "latinos"),
    ("einwanderer", "flüchtlinge", "ausländer", "einheimische"),
    # French
    ("femmes", "hommes", "filles", "garçons"),
    ("femme", "homme"),
    ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées"),
    ("homosexuels", "lesbiennes", "bisexuels", "hétérosexuels"),
    ("noirs", "blancs", "asiatiques", "latinos"),
    ("immigrés", "réfugiés", "étrangers", "autochtones"),
    # Spanish
    ("mujeres", "hombres", "niñas", "niños"),
    ("mujer", "hombre"),
    ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos"),
    ("homosexuales", "lesbianas", "bisexuales", "heterosexuales"),
    ("negros", "blancos", "asiáticos", "latinos"),
    ("inmigrantes", "refugiados", "extranjeros", "nativos"),
)
#: Features are hashed into so many places.
DIMS = 1 << 20
#: Lengths of the beginnings of words that are features of their own.
PREFIXES = (4, 5, 6)
#: Swaps made of one text at most (rotations through the group's other names).
SWAPS = 3

_WORD = re.compile(r"\w+")
_SENTENCE = re.compile(r"[^.!?\n]+")


class WordFeatures(dict):
    """Word to the places of its features; forgets all when it has grown large."""

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > 500_000:
            self.clear()
        parts = [word, *(word[:k] + "*" for k in PREFIXES if len(word) > k)]
        self[word] = f = tuple(xxhash.xxh32_intdigest(p.encode("utf-8", "surrogatepass")) % DIMS for p in parts)
        return f


_FEATURES = WordFeatures()


def words_of(text: str | None) -> set[str]:
    """The distinct lower-case words of a whole text."""
    return set(_WORD.findall((text or "").lower()))


def places(words: set[str]) -> set[int]:
    """The features that the words have."""
    return set().union(*map(_FEATURES.__getitem__, words))


def swaps(text: str | None, terms: tuple[tuple[str, ...], ...] = IDENTITY_TERMS, seed: int = 0) -> list[tuple[set[str], set[str]]]:
    """Pairs of word sets that ought to have the same score.

    Of a text that names groups: the sentences that do, and the same with each name swapped
    for the next of its line, the one after it, and so on. Of another text: its sentence
    number ``seed`` as it is and with a name of a line (number ``seed``) added, and with that
    name swapped. A name that stands in several lines counts for the first."""
    group: dict[str, tuple[tuple[str, ...], int]] = {}
    for g in terms:
        for k, t in enumerate(g):
            group.setdefault(t, (g, k))
    turned = lambda words, by: {group[w][0][(group[w][1] + by) % len(group[w][0])] if w in group else w for w in words}
    sentences = [w for s in _SENTENCE.findall((text or "").lower()) if (w := set(_WORD.findall(s)))]
    own = set().union(*(w for w in sentences if not w.isdisjoint(group)))
    pairs = []
    if not own and sentences and terms:
        plain, line = sentences[seed % len(sentences)], terms[seed % len(terms)]
        own = plain | {line[seed // len(terms) % len(line)]}
        pairs.append((plain, own))
    longest = max((len(group[w][0]) for w in own if w in group), default=0)
    return pairs + [(own, turned(own, by)) for by in range(1, min(SWAPS, longest - 1) + 1)]


@dataclass
class Model:
    """The weights of some features; a text has each of them or not."""

    weight: dict[int, float]
    base: float
    #: insertions and swaps in the fit, and how many of them touched a chosen feature
    changes: tuple[int, int] = (0, 0)

    def __post_init__(self) -> None:
        self.of_word: dict[str, tuple[int, ...]] = {}

    def __getstate__(self) -> dict:
        return {"weight": self.weight, "base": self.base, "changes": self.changes, "of_word": {}}

    def score(self, text: str | None) -> float:
        known, hit = self.of_word, set()
        for w in words_of(text):
            f = known.get(w)
            if f is None:
                if len(known) > 500_000:
                    known.clear()
                known[w] = f = tuple(p for p in _FEATURES[w] if p in self.weight)
            if f:
                hit.update(f)
        return float(sigmoid(self.base + sum(self.weight[p] for p in sorted(hit))))


def fit_weights(rows: list[np.ndarray], y: np.ndarray, changes: list[tuple[np.ndarray, np.ndarray]], always: frozenset[int] = frozenset(), n_features: int = 1000, n_clean: int = 200, min_rows: int = 3, min_lift: float = 3.0, l2: float = 1.0, balance: float = 0.7, penalty: float = 20.0, steps: int = 25) -> Model:
    """Rows: the features of each labelled text. Changes: the features of both sides of each
    insertion or swap. Features are chosen by how much more often toxic texts have them (a
    z-score over ``min_lift``), ``n_features`` of them at most, or other texts, ``n_clean`` at
    most; those in ``always`` (the groups' names) have a place whatever their counts. The loss is the logistic one, the rarer
    class weighted up (``balance`` 1: both alike, 0: not at all), plus l2 and
    ``penalty`` times the mean squared change of the score's log odds over the swaps."""
    toxic = y > 0.5
    count = [np.bincount(np.concatenate([np.zeros(0, np.int64), *[r for r, t in zip(rows, toxic, strict=True) if t == side]]), minlength=DIMS) for side in (False, True)]
    n = [max(1, int((~toxic).sum())), max(1, int(toxic.sum()))]
    p0, p1 = (count[0] + 0.5) / (n[0] + 1), (count[1] + 0.5) / (n[1] + 1)
    both = (count[0] + count[1] + 1) / (n[0] + n[1] + 2)
    lift = (p1 - p0) / np.sqrt(both * (1 - both) * (1 / n[0] + 1 / n[1]))
    lift[np.where(lift > 0, count[1], count[0]) < min_rows] = 0
    order = np.argsort(-lift, kind="stable")
    toxic_side, clean_side = order[:n_features], order[::-1][:n_clean]
    parts = [toxic_side[lift[toxic_side] > min_lift], clean_side[lift[clean_side] < -min_lift], np.fromiter(always, np.int64)]
    chosen = np.unique(np.concatenate(parts))
    x = np.zeros((len(rows), len(chosen) + 1))
    x[:, -1] = 1
    place = np.full(DIMS, -1, np.int32)
    place[chosen] = np.arange(len(chosen))
    seen = lambda r: (at := place[r])[at >= 0]
    for k, r in enumerate(rows):
        x[k, seen(r)] = 1
    # the sum of the changes' outer products; a change has a few features that differ
    touched, products = 0, np.zeros((len(chosen) + 1, len(chosen) + 1))
    for before, after in changes:
        gained, lost = seen(np.setdiff1d(after, before)), seen(np.setdiff1d(before, after))
        at = np.concatenate([gained, lost])
        if len(at):
            sign = np.repeat([1.0, -1.0], [len(gained), len(lost)])
            products[np.ix_(at, at)] += np.outer(sign, sign)
            touched += 1
    cost = penalty * len(y) / max(1, touched) * products
    weight = np.where(toxic, (n[0] / n[1]) ** balance, 1.0)
    weight *= len(y) / weight.sum()
    ridge = np.append(np.full(len(chosen), l2), 1e-3)
    w = np.zeros(len(chosen) + 1)
    for _ in range(steps):
        p = sigmoid(x @ w)
        g = x.T @ (weight * (p - y)) + ridge * w + cost @ w
        h = (x * (weight * np.maximum(p * (1 - p), 1e-3))[:, None]).T @ x + np.diag(ridge) + cost
        d = np.linalg.solve(h, g)
        w -= d
        if np.abs(d).max() < 1e-4:
            break
    return Model({int(p): float(v) for p, v in zip(chosen, w[:-1], strict=True)}, float(w[-1]), (len(changes), touched))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 6000, terms: tuple[tuple[str, ...], ...] = IDENTITY_TERMS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", **options) -> Model | None:
    """Learn from the documents that ``labels`` (id, 0 or 1) names, ``sample_rows`` at
    most, shared evenly among both labels; a text sends its distinct features, found on
    the executors. Null labels and texts are not learned from; an id that is labelled
    several times counts once, not at all if its labels differ. None if there are not
    labels of both kinds. Options as for fit_weights."""
    rows = labelled_sample(docs, labels, label_col, sample_rows, id_col).filter(F.col(text_col).isNotNull())
    rows = rows.select(F.col(id_col).cast("string").alias("id"), F.col("_label").alias("y"), F.col(text_col).alias("text"))

    def packed(words: set[str]) -> bytes:
        return np.sort(np.fromiter(places(words), np.uint32)).tobytes()

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, y, text in zip(b["id"], b["y"], b["text"], strict=True):
                pairs = swaps(text, terms, xxhash.xxh32_intdigest(i))
                out.append((i, y, packed(words_of(text)), [packed(x) for p in pairs for x in p]))
            yield pd.DataFrame(out, columns=["id", "y", "f", "pairs"])

    always = frozenset().union(*(_FEATURES[t] for g in terms for t in g))
    got = first_by_hash(rows.mapInPandas(features, "id string, y double, f binary, pairs array<binary>"), "id", sample_rows).toPandas()
    if got["y"].nunique() < 2:
        return None
    read = lambda x: np.frombuffer(x, np.uint32).astype(np.int64)
    changes = [(read(p[k]), read(p[k + 1])) for p in got["pairs"] for k in range(0, len(p), 2)]
    return fit_weights([read(f) for f in got["f"]], got["y"].to_numpy(float), changes, always, **options)


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score (0 to 1, higher: toxic is likelier) and predicted (1 from 0.5 on) for
    every row of ``docs``, from the words of its whole text alone.

    Very long texts are read whole. A text without words (null, empty) gets the score of a text without any feature;
    without a model (nothing to learn from) every score is 0. Null ids stay null, repeated
    rows give repeated rows, other columns are ignored, an empty table gives an empty one."""
    kind = dict(docs.dtypes)[id_col]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for b in batches:
            yield pd.DataFrame({"id": b["id"].to_numpy(), "score": [m.score(t) if m else 0.0 for t in b["text"]]})

    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    out = rows.mapInPandas(judge, "id string, score double")
    return out.select(F.col("id").cast(kind).alias(id_col), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
