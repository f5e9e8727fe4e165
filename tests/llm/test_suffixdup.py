"""Removal of repeated strings against a dictionary of all strings."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwork.llm import queries, suffixdup

DOCS = "doc_id long, text string, lang string"


def brute(rows, width=100):
    """(n_bytes, n_removed, n_spans, sha256) of each text in order of ids."""
    seen, out = set(), []
    for text in rows:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1):
            s = b[i : i + width]
            if s in seen:
                gone[i : i + width] = b"\1" * width
            seen.add(s)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return out


def values(df):
    got = sorted(df.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    return [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got]


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdeéß") for _ in range(rng.randrange(1, 9))) for _ in range(n))


def corpus(rng, n):
    """Texts with copies, edited copies, shared passages, repeats of their own and junk."""
    passage, common = sentence(rng, 60), sentence(rng, 18)
    out = []
    for _ in range(n):
        kind, own = rng.randrange(8), sentence(rng, rng.randrange(5, 150))
        if kind == 0 and out:
            own = rng.choice(out)
        elif kind == 1 and out:
            old = rng.choice(out)
            at = rng.randrange(len(old) + 1)
            own = old[:at] + rng.choice(["", "x", "é"]) + old[at + rng.randrange(3) :]
        elif kind == 2:
            at = rng.randrange(len(own))
            own = own[:at] + passage + own[at:]
        elif kind == 3:
            own = own + " " + own[: rng.randrange(len(own))]
        elif kind == 4:
            own = own[:50] + rng.choice(["-", "=+", "abc ", "0 "]) * rng.randrange(40, 400) + own[50:]
        elif kind == 5:
            at = rng.randrange(len(own))
            own = own[:at] + common + own[at:]
        out.append(own)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_removed_equals_brute_force(spark, seed):
    texts = corpus(random.Random(seed), 150)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    assert values(suffixdup.remove_repeats(df)) == brute(texts)


def test_crowded_buckets_and_small_portions(spark, monkeypatch):
    """A passage in every text: its edges are crowded; starts are dealt one by one."""
    monkeypatch.setattr(suffixdup, "CROWDED", 3)
    rng = random.Random(9)
    passage = sentence(rng, 30)
    texts = [sentence(rng, 30) + passage + sentence(rng, 30) for _ in range(80)] + corpus(rng, 40)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(9)
    assert values(suffixdup.remove_repeats(df)) == brute(texts)


def test_long_text_is_read_in_portions(spark):
    rng = random.Random(2)
    part = sentence(rng, 3000)
    long = part + "".join(rng.choice("klmnop ") for _ in range(2 * suffixdup.PORTION)) + part
    texts = [long, "q" + long[suffixdup.PORTION - 300 : suffixdup.PORTION + 300], part[:500]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = values(suffixdup.remove_repeats(df))
    assert [g[:3] for g in got] == [(len(long.encode()), len(part.encode()), 1), (601, 600, 1), (len(part[:500].encode()),) * 2 + (1,)]


def test_refinement_equals_sorting():
    rng = np.random.default_rng(0)
    for data in (rng.integers(0, 2, 800), np.tile(rng.integers(0, 3, 37), 30), np.zeros(300)):
        data = data.astype(np.uint8)
        pointer = suffixdup.refined(data)
        strings = [data[i : i + 100].tobytes() for i in range(len(data) - 99)]
        of = {}
        for s, p in zip(strings, pointer, strict=False):
            assert of.setdefault(s, p) == p
        assert len(set(of.values())) == len(of)
        # lesser numbers for lesser strings
        assert sorted(of, key=of.get) == sorted(of)


def test_edges(spark):
    """Nulls in every column, empty texts, repeated rows and ids, ties, clashing columns."""
    a, b = "a1" * 80, sentence(random.Random(0), 40)
    rows = [(None, b, None), (1, None, "en"), (2, "", "en"), (3, b, "de"), (3, b, "de"), (4, b[:99], "de"), (4, b[:99], "de"), (5, a, "en"), (5, b + a, "en"), (6, a, "en")]
    df = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("clash") for c in ("id", "h", "n", "key", "spans", "runs", "copies", "n_bytes")})
    got = suffixdup.remove_repeats(df).collect()
    assert len(got) == len(rows)
    size = len(b.encode())
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((r.n_bytes, r.n_removed))
    assert by[None] == [(size, 0)] and by[1] == [(0, 0)] and by[2] == [(0, 0)]
    assert by[3] == [(size, size)] * 2
    assert by[4] == [(len(b[:99].encode()), 0 if len(b[:99].encode()) < 100 else len(b[:99].encode()))] * 2
    assert by[6] == [(160, 160)] and sorted(by[5])[0][0] == 160
    assert all(r.n_removed == sum(s.end - s.start for s in r.spans) for r in got)
    twice = suffixdup.remove_repeats(spark.createDataFrame([(7, a, ""), (7, a, "")], DOCS)).collect()
    assert sorted(r.n_removed for r in twice) == [158, 160]
    assert suffixdup.remove_repeats(spark.createDataFrame([], DOCS)).count() == 0
    text_ids = suffixdup.remove_repeats(df.withColumn("doc_id", F.concat(F.lit("d"), "doc_id")))
    assert sorted(r.n_removed for r in text_ids.collect()) == sorted(r.n_removed for r in got)


def test_query_equals_brute_force(spark, sf):
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()]
    assert values(queries.suffix_dedup(spark, sf)) == brute(texts)
