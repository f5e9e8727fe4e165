"""Near-duplicate detection with ProbMinHash.

Every distinct text becomes a weighted set of five-word shingles (weight: how often it
occurs). Each shingle is a Poisson process of arrivals whose rate is its weight; an
arrival falls into one of the signature's registers, which keeps its earliest arrival.
Once all registers are filled, a process ends as soon as its next arrival is later than
every register's earliest. Two registers agree with the probability Jaccard similarity
of the sets. Registers are banded into buckets; candidates from the buckets are verified
with the exact probability Jaccard similarity; linked texts form classes."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, code_points, small_side

WORDS = 5
THRESHOLD = 0.8
#: Texts that are worked on at once, in characters; a longer text is read in pieces.
BATCH_CHARS = 1_000_000
#: Ids up to this number are broadcast (16 bytes each); more are joined by a shuffle.
MAX_BROADCAST_IDS = 1_000_000
#: A bucket that holds several classes is compared in blocks of this many texts; its rows
#: are joined with what is known of the bucket in portions of that size, too.
BLOCK = 256



@dataclass(frozen=True)
class Bands:
    """A threshold, and the bands and registers of a band that go with it."""

    threshold: float
    bands: int
    rows: int

    @property
    def registers(self) -> int:
        return self.bands * self.rows

    @property
    def least(self) -> float:
        """Below this share of equal registers a pair is not verified: four standard
        deviations of the estimate under the threshold."""
        return self.threshold - 4 * (self.threshold * (1 - self.threshold) / self.registers) ** 0.5


def bands_for(threshold: float, miss: float = 1e-4, registers: int = 128) -> Bands:
    """The most selective bands of ``registers`` registers at most with which a pair at the
    threshold shares no band with probability ``miss`` at most. 0.8: 24 bands of 5 would do;
    25 are taken."""
    if not 0 < threshold <= 1:
        raise ValueError("a threshold is over 0 and 1 at most")
    if threshold == THRESHOLD:
        return Bands(threshold, 25, 5)
    for rows in range(8, 0, -1):
        bands = max(1, math.ceil(math.log(miss) / math.log1p(-min(threshold**rows, 1 - 1e-9))))
        if bands * rows <= registers:
            return Bands(threshold, bands, rows)
    return Bands(threshold, math.ceil(math.log(miss) / math.log1p(-threshold)), 1)


_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
#: Base of the words' polynomial hash, and its inverse modulo 2 ** 64.
_BASE, _SEED = 0xD6E8FEB86659FD93, np.uint64(0xA0761D6478BD642F)
_tables: dict[str, np.ndarray] = {}


def _mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * _M1
    z = (z ^ (z >> np.uint64(27))) * _M2
    return z ^ (z >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers 1 to n, and those of its inverse."""
    if len(_tables.get("up", ())) < n:
        size = max(n, BATCH_CHARS + 65536)
        _tables["up"] = np.cumprod(np.full(size, _BASE, np.uint64))
        _tables["down"] = np.cumprod(np.full(size, pow(_BASE, -1, 1 << 64), np.uint64))
    return _tables["up"], _tables["down"]


def _is_word() -> np.ndarray:
    if "word" not in _tables:
        _tables["word"] = np.fromiter((chr(i).isalnum() or i == 95 for i in range(0x110000)), bool, 0x110000)
    return _tables["word"]


def word_hashes(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word (run of letters, digits, underscores) among the code
    points, and where it starts. All words at once: differences of a running polynomial."""
    if not len(c):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    w = _is_word()[c]
    edge = np.flatnonzero(np.diff(w, prepend=False, append=False))
    starts, ends = edge[::2], edge[1::2]
    up, down = _powers(len(c))
    total = np.cumsum((c + np.uint64(1)) * up[: len(c)], dtype=np.uint64)
    before = np.where(starts > 0, total[starts - 1], np.uint64(0))
    return _mix((total[ends - 1] - before) * down[starts] ^ (ends - starts).astype(np.uint64) * _GOLD), starts


def hashed_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the lower-case words of all texts in a row, and where each text's
    words end. A text longer than a batch is read piece by piece, cut between words."""
    lower = [(t or "").lower() for t in texts]
    if len(lower) == 1 and len(lower[0]) > BATCH_CHARS:
        t, parts, at = lower[0], [], 0
        while at < len(t):
            c = code_points(t[at : at + BATCH_CHARS])
            if at + len(c) < len(t) and len(gaps := np.flatnonzero(~_is_word()[c])):
                c = c[: gaps[-1] + 1]
            parts.append(word_hashes(c)[0])
            at += len(c)
        h = np.concatenate(parts)
        return h, np.array([len(h)])
    h, starts = word_hashes(code_points("\n".join(lower)))
    return h, np.searchsorted(starts, np.cumsum([len(t) + 1 for t in lower]))


class Sets:
    """The weighted shingle sets of some texts: shingle hashes (sorted within a text) and
    weights, one text after the other; ``bound[i]`` to ``bound[i + 1]`` is text i."""

    def __init__(self, texts: list[str | None], size: int = WORDS):
        h, ends = hashed_words(texts)
        begins = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        self.words = ends - begins
        self.prints = [hashlib.md5(h[a:b].tobytes()).digest() if b > a else None for a, b in zip(begins, ends, strict=True)]
        n = max(0, len(h) - size + 1)
        s = np.full(n, np.uint64(size))
        for k in range(size):
            s = s * _GOLD + h[k : k + n]
        s = _mix(s)
        parts = []
        for a, b in zip(begins.tolist(), ends.tolist(), strict=True):
            if b - a >= size:
                x = s[a : b - size + 1]
                x.sort()
            else:  # fewer words make one shingle, no words none
                x = np.full(min(1, b - a), np.uint64(b - a))
                for w in h[a:b]:
                    x = _mix(x * _GOLD + w)
            parts.append(x)
        s = np.concatenate([*parts, np.zeros(0, np.uint64)])
        of = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        first = np.flatnonzero(np.concatenate([np.ones(min(1, len(s)), bool), (s[1:] != s[:-1]) | (of[1:] != of[:-1])]))
        self.key, self.of = s[first], of[first]
        self.weight = np.diff(first, append=len(s)).astype(np.float64)
        self.bound = np.searchsorted(self.of, np.arange(len(parts) + 1))

    def __len__(self) -> int:
        return len(self.prints)

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.bound[i], self.bound[i + 1]
        return self.key[a:b], self.weight[a:b]


def prob_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exactly: the sum over common d of 1 / sum over e of max(x_e / x_d, y_e / y_d)."""
    (ha, wa), (hb, wb) = a, b
    if not len(ha) or not len(hb):
        return 0.0
    at = np.searchsorted(hb, ha)
    ia = np.flatnonzero(hb[np.minimum(at, len(hb) - 1)] == ha)
    if not len(ia):
        return 0.0
    x, y = wa[ia], wb[at[ia]]
    only = wa.sum() - x.sum(), wb.sum() - y.sum()
    # equal ratios x_d / y_d share their sum over e, up to the factor x_d
    ratio = x / y
    if (ratio == ratio[0]).all():
        return float(x.sum() / (np.maximum(x, ratio[0] * y).sum() + only[0] + ratio[0] * only[1]))
    ratios, which = np.unique(ratio, return_inverse=True)
    sums = np.bincount(which, weights=x)
    return float(sum(t / (np.maximum(x, r * y).sum() + only[0] + r * only[1]) for r, t in zip(ratios, sums, strict=True)))


def signatures(sets: Sets, m: int) -> np.ndarray:
    """ProbMinHash registers (64-bit) of each set, all sets at once round by round: in
    each round every process that may still matter makes its next arrivals (one at first,
    later, when few are left, several)."""
    n = len(sets)
    best = np.full((n, m), np.inf)
    flat, owner = best.reshape(-1), np.zeros(n * m, np.uint64)
    of, key, weight = sets.of, sets.key, sets.weight
    time = np.zeros(len(key))
    done = 0
    while len(key):
        k = 1 if done < 4 else 12
        r = _mix(key + (np.arange(done + 1, done + k + 1, dtype=np.uint64) * _GOLD)[:, None])
        times = time + np.cumsum(-np.log((r >> np.uint64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54) / weight, axis=0)
        slot = of * m + ((_mix(r + _GOLD) >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
        early = np.flatnonzero(times < flat[slot])
        at, t = slot.reshape(-1)[early], times.reshape(-1)[early]
        np.minimum.at(flat, at, t)
        won = t == flat[at]
        owner[at[won]] = np.broadcast_to(key, r.shape).reshape(-1)[early[won]]
        done, time = done + k, times[-1]
        new = np.diff(of, prepend=-1) != 0
        latest = best[of[new]].max(axis=1)
        alive = np.flatnonzero(time < latest[np.cumsum(new) - 1])
        of, key, weight, time = of[alive], key[alive], weight[alive], time[alive]
    return owner.reshape(n, m)


def bucket_keys(sig: np.ndarray, by: Bands) -> np.ndarray:
    """One 64-bit key for each band; the band's number is part of it."""
    out = np.tile(np.arange(1, by.bands + 1, dtype=np.uint64) * _GOLD, (len(sig), 1))
    grouped = sig.reshape(len(sig), by.bands, by.rows)
    for r in range(by.rows):
        out = _mix(out * _GOLD + grouped[:, :, r])
    return out.view(np.int64)


def _portions(sizes: np.ndarray) -> Iterator[slice]:
    """Consecutive rows of BATCH_CHARS characters at most, a longer row alone."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > BATCH_CHARS:
            yield slice(start, i)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield slice(start, len(sizes))


def _lengths(texts: pd.Series) -> np.ndarray:
    return np.array([len(t) + 1 if t else 1 for t in texts])


def _sketch(batches: Iterator[pd.DataFrame], by: Bands) -> Iterator[pd.DataFrame]:
    for whole in batches:
        for part in _portions(_lengths(whole["text"])):
            b = whole.iloc[part]
            sets = Sets(b["text"].tolist())
            sig = signatures(sets, by.registers)
            yield pd.DataFrame({
                "id": b["id"].to_numpy(),
                "print": sets.prints,
                "bands": [k if p else None for k, p in zip(bucket_keys(sig, by), sets.prints, strict=True)],
                "registers": [s.tobytes() if p else None for s, p in zip((sig & np.uint64(0xFFFF)).astype(np.uint16), sets.prints, strict=True)],
            })


def _printed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The texts with the digests of their words."""
    for whole in batches:
        for part in _portions(_lengths(whole["text"])):
            b = whole.iloc[part]
            yield pd.DataFrame({"print": Sets(b["text"].tolist()).prints, "text": b["text"].to_numpy()})


def _alike(batches: Iterator[pd.DataFrame], by: Bands) -> Iterator[pd.DataFrame]:
    """The pairs whose registers agree often enough."""
    for b in batches:
        if len(b):
            x, y = (np.frombuffer(b"".join(b[c]), np.uint16).reshape(len(b), by.registers) for c in ("ra", "rb"))
            yield b.loc[(x == y).mean(axis=1) >= by.least, ["a", "b"]]


def _verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for whole in batches:
        for part in _portions(_lengths(whole["text_a"]) + _lengths(whole["text_b"])):
            b = whole.iloc[part]
            texts: dict[str, int] = {}
            at = [(texts.setdefault(x, len(texts)), texts.setdefault(y, len(texts))) for x, y in zip(b["text_a"], b["text_b"], strict=True)]
            sets: list[tuple[np.ndarray, np.ndarray]] = []
            distinct = list(texts)
            for some in _portions(np.array([len(t) for t in distinct])):
                s = Sets(distinct[some])
                sets += [s[i] for i in range(len(s))]
            yield pd.DataFrame({"a": b["a"].to_numpy(), "b": b["b"].to_numpy(), "similarity": [prob_jaccard(sets[x], sets[y]) for x, y in at]})


def texts_of(ids: DataFrame, texts: DataFrame, repeated: bool) -> DataFrame:
    """The texts with these ids, one for each. Only they are shuffled later on: the ids are
    sent to the scan if they are few enough, else the texts go through a shuffled semi-join.
    Of ``repeated`` rows of an id, which have the same words or none, one with words is taken."""
    ids = checkpoint(ids)
    found = texts.join(small_side(ids, ids.count(), MAX_BROADCAST_IDS), "id", "left_semi")
    return found.groupBy("id").agg(F.max_by("text", F.struct(F.col("text").rlike("[\\p{L}\\p{N}_]"), F.length("text"))).alias("text")) if repeated else found


def verified(pairs: DataFrame, texts: DataFrame, repeated: bool, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b, similarity) of the candidate pairs with a similarity of ``threshold`` or more."""
    texts = texts_of(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), texts, repeated)
    first = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    second = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    rows = pairs.join(first, "b").join(second, "a").select("a", "b", "text_a", "text_b")
    return rows.mapInPandas(_verify, "a long, b long, similarity double").filter(F.col("similarity") >= threshold)


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, label): the least id that can be reached over ``links`` (a, b), for every id
    that has a link. Label spreading with pointer jumping; each round is a join and a
    partially aggregated minimum, and is checkpointed."""
    both = checkpoint(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct())
    labels = checkpoint(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("label")).select("id", F.least("id", "label").alias("label")))
    for _ in range(max_rounds):
        near = both.join(labels.withColumnRenamed("id", "b"), "b").select(F.col("a").alias("id"), "label")
        least = near.union(labels.select("id", "label")).groupBy("id").agg(F.min("label").alias("label"))
        up = labels.select(F.col("id").alias("label"), F.col("label").alias("further"))
        jumped = checkpoint(least.join(up, "label", "left").select("id", F.coalesce("further", "label").alias("label")))
        changed = jumped.join(labels.withColumnRenamed("label", "old"), "id").filter("label <> old").limit(1).count()
        labels = jumped
        if not changed:
            return labels
    raise RuntimeError("components did not settle")


def in_blocks(rows: DataFrame) -> DataFrame:
    """The rows (bucket, n, id, label, ...) of buckets with several classes (n: the bucket's
    texts), each with its block (``mine``) and the blocks it has to be compared with (``others``).

    A class of BLOCK texts or more has blocks of its own, which are not compared among
    themselves; smaller classes of a bucket share blocks. So a large class meets the few
    texts beside it once, however large it is."""
    sizes = rows.groupBy("bucket", "label").agg(F.count("*").alias("m"))
    pools = sizes.groupBy("bucket", F.when(F.col("m") >= BLOCK, F.col("label")).alias("pool")).agg(F.sum("m").alias("m"), F.count("*").alias("classes"))
    # null, the shared pool, is sorted first
    groups = pools.groupBy("bucket").agg(F.sort_array(F.collect_list(F.struct("pool", F.ceil(F.col("m") / BLOCK).cast("long").alias("blocks")))).alias("groups"), F.sum("classes").alias("classes"))
    # the rows of a large bucket are dealt to several tasks, its groups sent to each of them
    groups = groups.filter("classes > 1").withColumn("of", F.aggregate("groups", F.lit(0).cast("long"), lambda n, g: n + g["blocks"])).drop("classes")
    groups = groups.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("of") - 1)))
    left = rows.withColumn("salt", F.pmod(F.xxhash64("id", F.lit(5)), F.ceil(F.col("n") / BLOCK)))
    # n texts make at least ceil(n / BLOCK) blocks, so every salt of a row is there
    left = left.join(groups.drop("of"), ["bucket", "salt"]).drop("salt", "n")
    own = F.array_position(F.transform("groups", lambda g: g["pool"]), F.col("label"))
    left = left.withColumn("own", F.when(own > 0, own).otherwise(1).cast("int"))
    code = lambda g, k: g.cast("long") * F.lit(1 << 32) + k
    left = left.withColumn("mine", code(F.col("own"), F.pmod(F.xxhash64("id"), F.element_at("groups", F.col("own"))["blocks"])))
    none = F.array().cast("array<long>")
    others = F.transform("groups", lambda g, i: F.when((i + 1 == F.col("own")) & g["pool"].isNotNull(), none).otherwise(F.transform(F.sequence(F.lit(0).cast("long"), g["blocks"] - 1), lambda k: code(i + 1, k))))
    return left.withColumn("others", F.flatten(others)).drop("groups", "own")


def _grouped(batches: Iterator[pd.DataFrame], use) -> Iterator[pd.DataFrame]:
    """``use(rows, cuts)`` of whole groups: the rows of a bucket's two blocks come one after
    the other; what a batch ends with is kept for the next."""
    rest: pd.DataFrame | None = None
    for b in batches:
        rows = b if rest is None else pd.concat([rest, b], ignore_index=True)
        if not len(rows):
            continue
        g = rows[["bucket", "low", "high"]].to_numpy()
        cuts = np.flatnonzero((g[1:] != g[:-1]).any(axis=1)) + 1
        last = int(cuts[-1]) if len(cuts) else 0
        rest = rows.iloc[last:].reset_index(drop=True)
        if last:
            yield use(rows.iloc[:last], np.concatenate([[0], cuts]))
    if rest is not None and len(rest):
        yield use(rest, np.array([0, len(rest)]))


def _hopeful(batches: Iterator[pd.DataFrame], by: Bands) -> Iterator[pd.DataFrame]:
    """The rows of two blocks that have a candidate there; only their texts are needed."""
    return _grouped(batches, lambda rows, cuts: rows.iloc[np.unique(_candidates(rows, cuts, by))])


def _compare(batches: Iterator[pd.DataFrame], by: Bands) -> Iterator[pd.DataFrame]:
    """Links between texts of different classes in two blocks of a bucket (or in one)."""
    return _grouped(batches, partial(_links_of, by=by))


def _candidates(rows: pd.DataFrame, cuts: np.ndarray, by: Bands) -> np.ndarray:
    """Places of pairs, the most alike first: of different classes, registers that agree
    often enough, and no earlier band in common (there the pair is met as well)."""
    registers = np.frombuffer(b"".join(rows["registers"]), np.uint16).reshape(len(rows), by.registers)
    bands = np.stack(rows["bands"].to_list())
    label, mine, low, high, band = (rows[c].to_numpy() for c in ("label", "mine", "low", "high", "band"))
    out = [np.zeros((0, 3), np.int64)]
    for start, end in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        at = np.arange(start, end)
        same = low[start] == high[start]
        first, second = at[mine[at] == low[start]], at[mine[at] == high[start]]
        for i in first:
            others = second[(label[second] != label[i]) & (~same | (second > i))]
            if len(others):
                equal = (registers[others] == registers[i]).sum(axis=1)
                k = band[i]
                good = (equal >= by.least * by.registers) & ~(bands[others, :k] == bands[i, :k]).any(axis=1)
                out.append(np.stack([np.full(good.sum(), i), others[good], equal[good]], axis=1))
    pairs = np.concatenate(out)
    return pairs[np.argsort(-pairs[:, 2], kind="stable"), :2]


def _links_of(rows: pd.DataFrame, cuts: np.ndarray, by: Bands) -> pd.DataFrame:
    """Verified links. Two classes that a link has joined need no other between them."""
    pairs = _candidates(rows, cuts, by)
    ids, label, texts = rows["id"].to_numpy(), rows["label"].to_numpy(), rows["text"].to_numpy(object)
    needed = {int(ids[k]): int(k) for k in np.unique(pairs)}
    places = list(needed.values())
    sets: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for part in _portions(np.array([len(texts[k]) for k in places])):
        s = Sets([texts[k] for k in places[part]])
        sets |= {int(ids[k]): s[i] for i, k in enumerate(places[part])}
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = x = parent.get(up, up)
        return x

    out = []
    for i, j in pairs.tolist():
        x, y = root(int(label[i])), root(int(label[j]))
        if x != y and prob_jaccard(sets[int(ids[i])], sets[int(ids[j])]) >= by.threshold:
            parent[max(x, y)] = min(x, y)
            out.append((min(ids[i], ids[j]), max(ids[i], ids[j])))
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of ``docs``: id, class_id (the least id of its class) and
    is_first (its id is that least id).

    Texts with the same words (lower case, punctuation aside) are one distinct text.
    Distinct texts whose five-word shingles have a probability Jaccard similarity of
    ``threshold`` (0.8) or more are linked, and links chain into classes. In each bucket all texts are
    compared with one of them; texts of a bucket that are then still in different classes
    are compared in blocks, first by their registers, then, where these agree, inside a task
    by their texts, so that a class misses no link a bucket holds, while only links leave
    the task.

    A text without words (null, empty, punctuation) is a class of its own; several rows
    with one id are one document, so all its texts are in one class. A null id gets a null
    class. Very long texts are read whole, in pieces. Ids may be of any type
    that has an order: those that are not whole numbers go by a 64-bit hash meanwhile. Other
    columns are ignored; an empty table gives an empty one."""
    kind = dict(docs.dtypes)[id_col]
    if kind not in ("bigint", "int", "smallint", "tinyint"):
        # null stays null
        number = F.when(F.col(id_col).isNotNull(), F.xxhash64(id_col))
        rows = checkpoint(_near_duplicates(docs.select(number.alias("id"), F.col(text_col).alias("text")), "id", "text", bands_for(threshold)))
        names = docs.select(number.alias("id"), F.col(id_col).alias("name")).distinct()
        named = rows.join(names, rows["id"].eqNullSafe(names["id"])).select("name", "class_id")
        least = named.groupBy("class_id").agg(F.min("name").alias("least")).withColumnRenamed("class_id", "of")
        out = named.join(least, F.col("class_id") == F.col("of"), "left")
        return out.select(F.col("name").alias(id_col), F.col("least").alias("class_id"), (F.col("name") == F.col("least")).alias("is_first"))
    return _near_duplicates(docs, id_col, text_col, bands_for(threshold))


def _near_duplicates(docs: DataFrame, id_col: str, text_col: str, by: Bands) -> DataFrame:
    kind = dict(docs.dtypes)[id_col]
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sketch = checkpoint(texts.mapInPandas(partial(_sketch, by=by), "id long, print binary, bands array<long>, registers binary"))
    named = sketch.filter("print is not null and id is not null")
    reps = named.groupBy("print").agg(F.min("id").alias("rep"))
    # a distinct text goes by the least id that has it; where that id has several texts, all
    # but the first of these go by a number made of their words
    many = checkpoint(sketch.filter("id is not null").groupBy("id").agg(F.min("print").alias("first"), F.max("print").alias("last"), F.count("*").alias("n")).filter("n > 1"))
    repeated = not many.isEmpty()
    several = many.filter("first <> last").select("id", "first")
    n_several = several.count()
    if n_several:
        firsts = small_side(several.withColumnRenamed("id", "rep"), n_several, MAX_BROADCAST_IDS)
        reps = reps.join(firsts, "rep", "left").select("print", "rep", F.when(F.coalesce(F.col("print") == F.col("first"), F.lit(True)), F.col("rep")).otherwise(F.xxhash64("print")).alias("node"))
        ids = small_side(several.select("id"), n_several, MAX_BROADCAST_IDS)
        odd = texts.join(ids, "id").mapInPandas(_printed, "print binary, text string").filter("print is not null")
    else:
        reps = reps.select("print", "rep", F.col("rep").alias("node"))
    reps = checkpoint(reps)
    nodes = reps.select(F.col("rep").alias("id"), "print", "node")
    distinct = named.join(nodes, ["id", "print"]).select(F.col("node").alias("id"), "bands", "registers").dropDuplicates(["id"])
    distinct = checkpoint(distinct)
    if n_several:
        # texts by their node: those of ids with several texts by their words
        odd = odd.join(reps.select("print", "node"), "print").select(F.col("node").alias("id"), "text").dropDuplicates(["id"])
        texts = texts.join(ids, "id", "left_anti").unionByName(odd)
    registers = distinct.select("id", "registers")

    buckets = distinct.select("id", F.posexplode("bands").alias("band", "bucket"))
    hubs = buckets.groupBy("bucket").agg(F.min_by("id", F.xxhash64("id", "bucket")).alias("hub"), F.count("*").alias("n")).filter("n > 1")
    full = checkpoint(buckets.join(hubs, "bucket"))
    pairs = full.filter("hub <> id").select(F.least("hub", "id").alias("a"), F.greatest("hub", "id").alias("b")).distinct()
    pairs = pairs.join(registers.toDF("b", "rb"), "b").join(registers.toDF("a", "ra"), "a").select("a", "b", "ra", "rb")
    links = verified(checkpoint(pairs.mapInPandas(partial(_alike, by=by), "a long, b long")), texts, repeated, by.threshold).select("a", "b")
    if n_several:
        same = named.join(ids, "id").join(reps.select("print", "node"), "print").select("id", "node").distinct()
        same = checkpoint(same)
        hub = same.groupBy("id").agg(F.min("node").alias("a"))
        links = links.unionByName(same.join(hub, "id").filter("a <> node").select("a", F.col("node").alias("b")))
    links = checkpoint(links)
    labels = components(links)

    # buckets of two are done; in larger ones, texts in different classes are left
    larger = full.filter("n > 2").join(labels, "id", "left").select("bucket", "n", "band", "id", F.coalesce("label", "id").alias("label"))
    left = in_blocks(larger).join(distinct, "id").withColumn("other", F.explode("others"))
    left = left.select("bucket", "band", "id", "label", "registers", "bands", "mine", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"))
    together = lambda df: df.repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high", "id")
    hopeful = checkpoint(together(left).mapInPandas(partial(_hopeful, by=by), left.schema))
    content = texts_of(hopeful.select("id").distinct(), texts, repeated)
    again = checkpoint(together(hopeful.join(content, "id")).mapInPandas(partial(_compare, by=by), "a long, b long"))
    # links of the second kind join whole classes of the first
    of = lambda c: labels.select(F.col("id").alias(c), F.col("label").alias(f"class_{c}"))
    joined = again.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("class_a", "a").alias("x"), F.coalesce("class_b", "b").alias("y"))
    merged = components(joined.filter("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b"))).toDF("label", "merged")
    singles = merged.join(labels.select("label"), "label", "left_anti").select(F.col("label").alias("id"), F.col("merged").alias("label"))
    labels = labels.join(merged, "label", "left").select("id", F.coalesce("merged", "label").alias("label")).unionByName(singles)

    of_print = reps.join(labels.withColumnRenamed("id", "node"), "node", "left").select("print", "rep", F.coalesce("label", "node").alias("class"))
    if n_several:
        # a class goes by its least id, which need not be its least node
        of_print = checkpoint(of_print)
        of_print = of_print.join(of_print.groupBy("class").agg(F.min("rep").alias("least")), "class").select("print", F.col("least").alias("class"))
    rows = sketch.select("id", "print").join(of_print.select("print", "class"), "print", "left").select("id", F.when(F.col("id").isNotNull(), F.coalesce("class", "id")).alias("class_id"))
    if repeated:
        # rows without words are in the class of their id's other texts
        n_many = many.count()
        best = rows.join(small_side(many.select("id"), n_many, MAX_BROADCAST_IDS), "id").groupBy("id").agg(F.min("class_id").alias("least"))
        rows = rows.join(small_side(checkpoint(best), n_many, MAX_BROADCAST_IDS), "id", "left").select("id", F.coalesce("least", "class_id").alias("class_id"))
    return rows.select(F.col("id").cast(kind).alias(id_col), F.col("class_id").cast(kind).alias("class_id"), (F.col("id") == F.col("class_id")).alias("is_first"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, of which the id is the least of its class; of
    rows with one id, one stays. Rows with a null id all stay. No text is shuffled unless
    an id is repeated or the ids to drop are too many to broadcast."""
    classes = checkpoint(near_duplicates(docs, id_col, text_col, threshold).filter(F.col(id_col).isNotNull()))
    first = classes.filter("is_first").select(id_col).distinct()
    dropped = checkpoint(classes.join(first, id_col, "left_anti").select(id_col).distinct())
    kept = docs.join(small_side(dropped, dropped.count(), MAX_BROADCAST_IDS), id_col, "left_anti").select(docs.columns)
    if classes.groupBy(id_col).count().filter("count > 1").isEmpty():
        return kept
    return kept.filter(F.col(id_col).isNotNull()).dropDuplicates([id_col]).select(docs.columns).union(kept.filter(F.col(id_col).isNull()))
