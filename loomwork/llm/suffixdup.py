"""Removal of repeated byte strings by bucket-pointer refinement.

A start is a place where a string of WIDTH bytes begins. Two starts are of one class if
their strings are equal; all of a class but the first are repeats. Suffix sorting by bucket
pointers finds the classes: starts are put into buckets by their first bytes, and a bucket is
refined by sorting on the bucket numbers at a later offset, which have been refined before.

Most starts are told apart without any sorting across documents. Each start has an anchor,
the least q-gram in its string, at the same offset for equal strings, so starts of one class
have equal anchors. Starts next to each other share an anchor and make a run. Runs meet in
the bucket of their anchor's q-gram. A bucket with one text of a run is refined no further:
all its runs but the first are repeats. The runs of a bucket with several texts are sorted
by bucket pointers, start by start."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import new_folder, small_side

#: Bytes of a string whose repeats are removed.
WIDTH = 100
#: Bytes of an anchor.
GRAM = 32
#: Bytes whose starts are looked at together; a longer text is read in pieces that overlap.
PORTION = 1 << 18
#: Texts of runs in one bucket of a portion from which on the bucket's runs are salted.
SALT_FROM = 4
#: Texts of runs in one bucket from which on starts are dealt singly.
CROWDED = 2048
#: Runs that are sorted together.
SORTED_RUNS = 4096
#: Ids up to this number are broadcast (about 16 bytes each); more are joined by a shuffle.
MAX_BROADCAST_IDS = 1_000_000

_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93
_tables: dict[str, np.ndarray] = {}


def _mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * _M1
    z = (z ^ (z >> np.uint64(27))) * _M2
    return z ^ (z >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A number for each byte, the base's powers 0 to n, those of its inverse."""
    if len(_tables.get("up", ())) < n:
        ones = np.ones(1, np.uint64)
        _tables["bytes"] = _mix(np.arange(1, 257, dtype=np.uint64) * _GOLD)
        _tables["up"] = np.concatenate([ones, np.cumprod(np.full(n, _BASE, np.uint64))])
        _tables["down"] = np.concatenate([ones, np.cumprod(np.full(n, pow(_BASE, -1, 1 << 64), np.uint64))])
    return _tables["bytes"], _tables["up"], _tables["down"]


def runs_of(data: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs among the starts 0, 1, ... of ``data``: first start, number of starts, name of the
    anchor's bucket, name of the run's text. ``valid``: the starts whose string lies in one
    document."""
    n = len(valid)
    of_byte, up, down = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(of_byte[data] * up[: len(data)], out=total[1:])
    grams = len(data) - GRAM + 1
    h = _mix((total[GRAM:] - total[:-GRAM]) * down[:grams])
    # least q-gram of each string, the leftmost of equals: a sliding minimum by doubling
    key = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(grams, dtype=np.uint64)
    window, size = WIDTH - GRAM + 1, 1
    while size * 2 <= window:
        key = np.minimum(key[:-size], key[size:])
        size *= 2
    if size < window:
        key = np.minimum(key[: len(key) - (window - size)], key[window - size :])
    anchor = (key[:n] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.ones(n, bool)
    # between the valid starts of two documents there are others
    new[1:] = (anchor[1:] != anchor[:-1]) | (valid[1:] != valid[:-1])
    first = np.flatnonzero(new)
    length = np.diff(first, append=n)
    keep = valid[first]
    first, length = first[keep], length[keep]
    at = anchor[first]
    text = (total[first + length + WIDTH - 1] - total[first]) * down[first]
    # the anchor's place in the text and the text's length are part of its name
    text = _mix(text ^ _mix((at - first).astype(np.uint64) * _GOLD + length.astype(np.uint64)))
    return first, length, h[at], text


def _portions(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Portions of a column of texts: data, and of each start whether its string lies in its
    row's text, the row, and the place in the row's text."""
    texts = texts.cast(pa.large_string())
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    row = 0
    while row < len(texts):
        end = row + 1
        while end < len(texts) and bounds[end + 1] - bounds[row] <= PORTION:
            end += 1
        lo, hi = int(bounds[row]), int(bounds[end])
        sizes = np.diff(bounds[row : end + 1])
        of = np.repeat(np.arange(row, end), sizes) if end - row > 1 else np.full(min(hi - lo, PORTION), row)
        for start in range(lo, hi - WIDTH + 1, PORTION):
            n = min(hi - start - WIDTH + 1, PORTION)
            at = np.arange(start, start + n)
            o = of[:n]
            yield raw[start : start + n + WIDTH - 1], at + WIDTH <= bounds[1:][o], o, at - bounds[o]
        row = end


_STARTS = "key long, text long, state int, h long, lo long, n int"
NORMAL, SALTED, GONE, MARK = 0, 1, 2, 3


def _starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of runs: ``key`` says where they meet, ``text`` names a run's text. Equal texts of
    a portion are sent once; the rest are GONE, repeats whatever comes. A bucket with several
    texts in the portion is salted by the text, and a MARK tells its home of that."""
    for b in batches:
        if not len(b):
            continue
        ids, hashes = b.column("id"), b.column("h").to_numpy(zero_copy_only=False)
        rank = np.empty(len(b), np.int64)
        order = pc.sort_indices(pa.table({"id": ids, "h": b.column("h")}), sort_keys=[("id", "ascending"), ("h", "ascending")], null_placement="at_start").to_numpy()
        rank[order] = np.arange(len(b))
        for data, valid, of, place in _portions(b.column("text")):
            first, n, bucket, text = runs_of(data, valid)
            row, lo = of[first], place[first]
            by = np.lexsort((lo, rank[row], text, bucket))
            bucket, text, row, lo, n = bucket[by], text[by], row[by], lo[by], n[by]
            other = np.ones(len(by), bool)
            other[1:] = bucket[1:] != bucket[:-1]
            fresh = other.copy()
            fresh[1:] |= text[1:] != text[:-1]
            numbered = np.cumsum(other) - 1
            salted = (np.bincount(numbered, weights=fresh) >= SALT_FROM)[numbered] & fresh if len(by) else fresh
            marked = np.unique(bucket[salted])
            # repeats that follow each other are one row
            gone = np.flatnonzero(~fresh)
            gone = gone[np.lexsort((lo[gone], row[gone]))]
            begins = np.ones(len(gone), bool)
            begins[1:] = (row[gone][1:] != row[gone][:-1]) | (lo[gone][1:] != (lo[gone] + n[gone])[:-1])
            head = np.flatnonzero(begins)
            g, g_n = gone[head], np.add.reduceat(n[gone], head) if len(head) else n[gone]
            f = np.flatnonzero(fresh)
            rows = np.concatenate([row[f], row[g], np.zeros(len(marked), np.int64)])
            none = np.zeros(len(marked), np.int64)
            cols = {
                "key": np.concatenate([bucket[f] ^ np.where(salted[f], text[f], 0), _mix(text[g] + _GOLD * (lo[g] + row[g]).astype(np.uint64)), marked]).view(np.int64),
                "text": np.concatenate([text[f], np.zeros(len(g) + len(marked), np.uint64)]).view(np.int64),
                "state": np.concatenate([np.where(salted[f], SALTED, NORMAL), np.full(len(g), GONE), np.full(len(marked), MARK)]).astype(np.int32),
                "h": hashes[rows],
                "lo": np.concatenate([lo[f], lo[g], none]),
                "n": np.concatenate([n[f], g_n, none]).astype(np.int32),
            }
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows)), *map(pa.array, cols.values())], names=["id", *cols])


def refined(data: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Bucket numbers of the starts of ``data`` by their strings of ``width`` bytes, equal for
    equal strings (those that begin less than ``width`` bytes before the end aside).

    Buckets by the first 8 bytes, then rounds: a bucket of several starts is sorted on the
    bucket numbers some bytes further on, which the rounds before have refined. A bucket of k
    starts owns k numbers from its own on; its parts share them. A start alone in its bucket
    keeps its number."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    code = np.zeros(n, np.uint64)
    for k in range(8):
        code = (code << np.uint64(8)) | padded[k : k + n]
    order = np.argsort(code)
    pointer = np.empty(n, np.int64)
    pointer[order] = _bucket_starts(code[order])
    reach = 8
    while reach < width:
        step = min(reach, width - reach)
        crowd = np.flatnonzero(np.bincount(pointer, minlength=n)[pointer] > 1)
        later = pointer[np.minimum(crowd + step, n - 1)]
        both = pointer[crowd] * n + later
        order = np.argsort(both)
        crowd, both = crowd[order], both[order]
        old = pointer[crowd]
        pointer[crowd] = old + _bucket_starts(both) - _bucket_starts(old)
        reach += step
    return pointer


def _bucket_starts(sorted_keys: np.ndarray) -> np.ndarray:
    """For each of the sorted keys the place of the first that equals it."""
    new = np.ones(len(sorted_keys), bool)
    new[1:] = sorted_keys[1:] != sorted_keys[:-1]
    return np.maximum.accumulate(np.where(new, np.arange(len(sorted_keys)), 0))


def _repeats_of(rows: pa.RecordBatch) -> pa.RecordBatch:
    """The repeats among the starts of some runs; a start in an earlier row, or before in its
    own, is the earlier one."""
    starts = rows.column("n").to_numpy(zero_copy_only=False).astype(np.int64)
    data = np.frombuffer(b"".join(rows.column("bytes").to_pylist()), np.uint8)
    offset = np.cumsum(starts + WIDTH - 1) - (starts + WIDTH - 1)
    run = np.repeat(np.arange(len(starts)), starts)
    within = np.arange(len(run)) - np.repeat(np.cumsum(starts) - starts, starts)
    repeat = np.ones(len(run), bool)
    repeat[np.unique(refined(data)[offset[run] + within], return_index=True)[1]] = False
    begin = repeat.copy()
    begin[1:] &= ~repeat[:-1] | (run[1:] != run[:-1])
    end = repeat.copy()
    end[:-1] &= ~repeat[1:] | (run[1:] != run[:-1])
    first, last = np.flatnonzero(begin), np.flatnonzero(end)
    of = pa.array(run[first])
    lo = rows.column("lo").to_numpy(zero_copy_only=False)[run[first]] + within[first]
    return pa.RecordBatch.from_arrays([rows.column("id").take(of), rows.column("h").take(of), pa.array(lo), pa.array((last - first + 1).astype(np.int32))], names=["id", "h", "lo", "n"])


def _sorted_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The repeats among runs that come in order of bucket, document and place. Some whole
    buckets are sorted together; equal strings are in one bucket."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(map(len, held)) >= SORTED_RUNS:
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            bucket = rows.column("bucket").to_numpy(zero_copy_only=False)
            cut = int(np.searchsorted(bucket, bucket[-1]))
            if cut:
                yield _repeats_of(rows.slice(0, cut))
            held = [rows.slice(cut)]
    held = [b for b in held if len(b)]
    if held:
        yield _repeats_of(pa.Table.from_batches(held).combine_chunks().to_batches()[0])


def _texts_of_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row with its bytes for each run that a document's row lists."""
    for b in batches:
        for i in range(len(b)):
            raw = b.column("text")[i].as_py().encode("utf-8", "surrogatepass")
            runs = b.column("runs").slice(i, 1).flatten()
            lo, n = (runs.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            data = [raw[x : x + k + WIDTH - 1] for x, k in zip(lo.tolist(), n.tolist(), strict=True)]
            same = pa.array(np.zeros(len(lo), np.int64))
            yield pa.RecordBatch.from_arrays([runs.field(2), b.column("id").slice(i, 1).take(same), b.column("h").slice(i, 1).take(same), runs.field(0), runs.field(1), pa.array(data, pa.binary())], names=["bucket", "id", "h", "lo", "n", "bytes"])


def _single_starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each start of a run by itself, its string named by a digest."""
    for b in batches:
        rows, names, at = [], [], []
        for i, (lo, n, data) in enumerate(zip(*(b.column(c).to_pylist() for c in ("lo", "n", "bytes")), strict=True)):
            rows += [i] * n
            at += range(lo, lo + n)
            names += [hashlib.md5(data[k : k + WIDTH]).digest() for k in range(n)]
        take = pa.array(rows, pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), b.column("id").take(take), b.column("h").take(take), pa.array(at, pa.int64())], names=["name", "id", "h", "lo"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The removed spans of each document and a digest of the bytes that stay."""
    for b in batches:
        out: dict[str, list] = {"spans": [], "sha256": []}
        for i in range(len(b)):
            raw = np.frombuffer(b.column("text")[i].as_py().encode("utf-8", "surrogatepass"), np.uint8)
            runs = b.column("runs").slice(i, 1).flatten()
            lo, n = (runs.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
            edges = np.bincount(lo, minlength=len(raw) + 1) - np.bincount(lo + n + WIDTH - 1, minlength=len(raw) + 1)
            removed = np.cumsum(edges)[:-1] > 0
            turns = np.flatnonzero(np.diff(removed, prepend=False, append=False))
            out["spans"].append([{"start": s, "end": e} for s, e in zip(turns[::2].tolist(), turns[1::2].tolist(), strict=True)])
            out["sha256"].append(hashlib.sha256(raw[~removed].tobytes()).hexdigest())
        spans = pa.array(out["spans"], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("h"), spans, pa.array(out["sha256"], pa.string())], names=["id", "h", "spans", "sha256"])


def _stored(df: DataFrame) -> DataFrame:
    """``df`` computed once, as Parquet in the shared folder, its lineage cut."""
    spark = df.sparkSession
    where = new_folder(spark, "repeats")
    df.write.parquet(where)
    return spark.read.schema(df.schema).parquet(where)


def _with_runs(texts: DataFrame, runs: DataFrame) -> DataFrame:
    """The documents that have some of the ``runs`` (id, h, lo, n, ...), with a list of them. The
    ids are sent to the scan of the texts if they are few enough, so that only texts with
    runs are shuffled."""
    extra = [c for c in runs.columns if c not in ("id", "h")]
    lists = _stored(runs.groupBy(F.col("id").alias("r_id"), F.col("h").alias("r_h")).agg(F.collect_list(F.struct(*extra)).alias("runs")))
    same = F.col("id").eqNullSafe(F.col("r_id")) & (F.col("h") == F.col("r_h"))
    ids = lists.select("r_id", "r_h")
    if ids.count() <= MAX_BROADCAST_IDS:
        texts = texts.join(F.broadcast(ids), same, "left_semi")
    return texts.join(lists, same).select("id", "h", "text", "runs")


def repeats(texts: DataFrame) -> DataFrame:
    """(id, h, lo, n): the starts lo to lo + n - 1 of a document (id, h) are repeats: their
    strings start earlier, in a document of lesser (id, h) or before in their own. ``texts``
    has id, h (a number that tells texts of one id apart) and text, one row for each (id, h)."""
    named = f"id {texts.schema['id'].dataType.simpleString()}"
    rows = texts.mapInArrow(_starts, f"{named}, {_STARTS}")
    by_text = Window.partitionBy("key", "text").orderBy("id", "h", "lo")
    by_key = Window.partitionBy("key")
    met = rows.repartition("key").withColumn("place", F.row_number().over(by_text))
    # a mark is one text more; a salted bucket has several anyway
    met = met.withColumn("several", F.min("text").over(by_key) != F.max("text").over(by_key)).filter(F.col("state") != MARK)
    gone = (F.col("state") == GONE) | (F.col("place") > 1)
    met = met.filter(gone | (F.col("state") == SALTED) | F.col("several"))
    bucket = F.when(F.col("state") == SALTED, F.col("key").bitwiseXOR(F.col("text"))).otherwise(F.col("key"))
    met = _stored(met.select("id", "h", "lo", "n", F.when(~gone, bucket).alias("bucket")))
    left = met.filter("bucket is not null")

    sizes = left.groupBy("bucket").count().filter(F.col("count") > CROWDED).select("bucket")
    sizes = _stored(sizes)
    n_crowded = sizes.count()
    found = [met.filter("bucket is null").select("id", "h", "lo", "n")]
    calm = left.join(small_side(sizes, n_crowded, MAX_BROADCAST_IDS), "bucket", "left_anti") if n_crowded else left
    schema = f"bucket long, {named}, h long, lo long, n int, bytes binary"
    contexts = lambda runs: _with_runs(texts, runs.select("id", "h", "lo", "n", "bucket")).mapInArrow(_texts_of_runs, schema)
    dealt = contexts(calm).repartition("bucket").sortWithinPartitions("bucket", "id", "h", "lo")
    found.append(dealt.mapInArrow(_sorted_runs, f"{named}, h long, lo long, n int"))
    if n_crowded:
        # starts one by one: no group of them has to meet in a task
        crowded = left.join(small_side(sizes, n_crowded, MAX_BROADCAST_IDS), "bucket", "left_semi")
        single = _stored(contexts(crowded).mapInArrow(_single_starts, f"name binary, {named}, h long, lo long"))
        first = single.groupBy("name").agg(F.min(F.struct("id", "h", "lo")).alias("f")).select(F.col("name").alias("f_name"), F.col("f.id").alias("f_id"), F.col("f.h").alias("f_h"), F.col("f.lo").alias("f_lo"))
        is_first = (F.col("name") == F.col("f_name")) & F.col("id").eqNullSafe(F.col("f_id")) & (F.col("h") == F.col("f_h")) & (F.col("lo") == F.col("f_lo"))
        found.append(single.join(first, is_first, "left_anti").select("id", "h", "lo", F.lit(1).alias("n")))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, n_bytes (of the text as UTF-8), spans (array of
    start, end: the bytes to remove), n_removed, n_spans, kept_sha256 (of the bytes that stay).

    Removed is each byte covered by a string of WIDTH bytes that also starts earlier: in a
    document of lesser id (null is the least), or before in its own. Strings do not cross
    documents and are judged on the input. Rows with one id go by a hash of their texts;
    of rows with one id and one text the first keeps what the others lose. Null and empty
    texts and texts under WIDTH bytes lose nothing. Very long texts are read whole, in
    portions. Other columns are ignored, whatever they are called; an empty table gives an
    empty one."""
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    narrow = texts.select("id", F.xxhash64("text").alias("h"), F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha"))
    rows = _stored(narrow.groupBy("id", "h", "n_bytes", "sha").agg(F.count("*").alias("copies")))
    # the hash tells texts of one id apart; where no id is repeated it is 0, which packs well
    repeated = not rows.groupBy("id").agg(F.sum("copies").alias("n")).filter("n > 1").isEmpty()
    texts = texts.select("id", (F.xxhash64("text") if repeated else F.lit(0).cast("long")).alias("h"), "text")
    if repeated:
        texts = texts.dropDuplicates(["id", "h"])
    else:
        rows = rows.withColumn("h", F.lit(0).cast("long"))
    long_enough = texts.filter(F.octet_length("text") >= WIDTH)
    spans = "spans array<struct<start:bigint,end:bigint>>"
    cut = _with_runs(long_enough, repeats(long_enough)).mapInArrow(_cut, f"id {texts.schema['id'].dataType.simpleString()}, h long, {spans}, sha256 string")
    cut = cut.withColumnsRenamed({"id": "c_id", "h": "c_h"})
    out = rows.join(cut, F.col("id").eqNullSafe(F.col("c_id")) & (F.col("h") == F.col("c_h")), "left")
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    whole = (F.col("copy") > 1) & (F.col("n_bytes") >= WIDTH)
    nothing, all_of_it = F.array().cast(spans.split(" ")[1]), F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))
    out = out.withColumn("spans", F.when(whole, all_of_it).otherwise(F.coalesce("spans", nothing)))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    kept = F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("sha256", "sha"))
    return out.select(F.col("id").alias(id_col), "n_bytes", "spans", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), kept.alias("kept_sha256"))
