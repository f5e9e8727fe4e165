"""Language identification in two levels: linear support vector machines first tell
language families apart, then one-versus-one machines the languages of a family."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import first_by_hash, fit_svm, letter_ngrams, share_by, sigmoid, unit_rows

#: Families of closely related languages (ISO 639-1). A language that is not listed
#: makes a family of its own.
FAMILIES = {
    "germanic": ["en", "de", "nl", "af", "sv", "da", "no", "nb", "nn", "is"],
    "romance": ["fr", "es", "it", "pt", "ro", "ca", "gl"],
    "slavic": ["ru", "uk", "be", "bg", "sr", "hr", "bs", "sl", "mk", "cs", "sk", "pl"],
    "uralic": ["fi", "et", "hu"],
    "turkic": ["tr", "az", "kk", "uz"],
    "indic": ["hi", "mr", "ne", "bn", "pa", "gu", "ur"],
    "semitic": ["ar", "he"],
}

DIMS = 4096


@dataclass
class Model:
    """``levels``: for "" (families) and for each family its classes and the weights of
    one machine for each pair of classes."""

    levels: dict[str, tuple[list[str], np.ndarray]]

    def choose(self, x: np.ndarray, level: str) -> tuple[np.ndarray, np.ndarray]:
        """The class (its place) of each row by votes, and how sure that is, 0 to 1."""
        classes, w = self.levels[level]
        if len(classes) == 1:
            return np.zeros(len(x), int), np.ones(len(x))
        margin = x @ w[:, :-1].T + w[:, -1]
        p = sigmoid(3.0 * margin)
        votes = np.zeros((len(x), len(classes)))
        sure = np.zeros((len(x), len(classes)))
        for k, (i, j) in enumerate(combinations(range(len(classes)), 2)):
            votes[:, i] += margin[:, k] > 0
            votes[:, j] += margin[:, k] <= 0
            sure[:, i] += p[:, k]
            sure[:, j] += 1 - p[:, k]
        best = np.argmax(votes + 1e-3 * sure, axis=1)
        return best, sure[np.arange(len(x)), best] / (len(classes) - 1)

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lang = np.empty(len(x), object)
        families, score = self.levels[""][0], np.zeros(len(x))
        first, p = self.choose(x, "")
        for i, family in enumerate(families):
            if len(rows := np.flatnonzero(first == i)):
                second, q = self.choose(x[rows], family)
                lang[rows] = np.array(self.levels[family][0], object)[second]
                score[rows] = p[rows] * q
        return lang, score


def _pairs(x: np.ndarray, y: np.ndarray, classes: list[str], c: float) -> np.ndarray:
    out = []
    for a, b in combinations(classes, 2):
        rows = np.flatnonzero((y == a) | (y == b))
        out.append(fit_svm(x, np.where(y[rows] == a, 1.0, -1.0), rows, c=c))
    return np.array(out, np.float32)


def fit(labelled: DataFrame, sample_rows: int = 6000, families: dict[str, list[str]] = FAMILIES, dims: int = DIMS, c: float = 4.0) -> Model | None:
    """Learn from ``labelled`` (doc_id, text, lang). Rows without text, letters or lang
    are left out. The machines are fitted on ``sample_rows`` rows at most, shared evenly
    among the languages and picked by a hash of the id; features are computed on the
    executors from whole texts, and only they are gathered. None if there is nothing to
    learn from."""
    rows = share_by(labelled.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").rlike("\\p{L}")), "lang", "doc_id", sample_rows)

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            counts = [letter_ngrams(t, dims) for t in b["text"]]
            at = [np.flatnonzero(v) for v in counts]
            yield pd.DataFrame({"doc_id": b["doc_id"].astype(str), "lang": b["lang"], "at": [i.astype(np.uint16 if dims <= 65536 else np.uint32).tobytes() for i in at], "n": [v[i].astype(np.float32).tobytes() for v, i in zip(counts, at, strict=True)]})

    got = first_by_hash(rows.mapInPandas(features, "doc_id string, lang string, at binary, n binary"), "doc_id", sample_rows).toPandas()
    if got.empty:
        return None
    got = got.sort_values(["lang", "doc_id", "at", "n"]).reset_index(drop=True)
    x = np.zeros((len(got), dims), np.float32)
    for k, (i, n) in enumerate(zip(got["at"], got["n"], strict=True)):
        x[k, np.frombuffer(i, np.uint16 if dims <= 65536 else np.uint32)] = np.frombuffer(n, np.float32)
    x = unit_rows(x)
    lang = got["lang"].to_numpy()
    of = {v: k for k, vs in families.items() for v in vs}
    family = np.array([of.get(v, f"only:{v}") for v in lang], object)
    names = sorted(set(family))
    levels = {"": (names, _pairs(x, family, names, c))}
    for name in names:
        inside = sorted(set(lang[family == name]))
        levels[name] = (inside, _pairs(x, lang, inside, c))
    return Model(levels)


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", dims: int = DIMS) -> DataFrame:
    """``id_col``, lang_pred, score for every row of ``docs``, from its whole text alone.

    Null, empty and letterless texts give ``und`` with score 0, and so does every text
    where there was nothing to learn. Very long texts are read whole, in chunks. Null ids
    stay null; repeated rows give repeated rows; other columns are ignored; an empty table
    gives an empty one."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for whole in batches:
            for k in range(0, len(whole), 500):
                b = whole.iloc[k : k + 500]
                lang = np.full(len(b), "und", object)
                score = np.zeros(len(b))
                rows = np.flatnonzero(b["has_letter"].to_numpy(bool)) if m else []
                if len(rows):
                    texts = b["text"].to_numpy(object)
                    x = unit_rows(np.array([letter_ngrams(texts[i], dims) for i in rows]))
                    lang[rows], score[rows] = m.predict(x)
                yield pd.DataFrame({"id": b["id"], "lang_pred": lang, "score": score})

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(F.col(text_col).rlike("\\p{L}"), F.lit(False)).alias("has_letter"))
    kind = dict(docs.dtypes)[id_col]
    return rows.withColumn("id", F.col("id").cast("string")).mapInPandas(predict, "id string, lang_pred string, score double").select(F.col("id").cast(kind).alias(id_col), "lang_pred", "score")
