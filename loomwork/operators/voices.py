"""Sound as samples: notes to phases, voices and a mixed sequence, chunk by chunk."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

#: Samples a second; a phase's steps a turn. Whole steps add up alike in any grouping.
RATE, TURN = 16_000, 1 << 32
#: Samples of a chunk, chunks of a task, samples that a task computes at once.
CHUNK, CHUNKS, SLAB = 4096, 20_000, 1 << 19
#: Fixed values of the mixer: where the gate sets in and its least gain, the limiter's ceiling and
#: knee, full scale.
GATE, LEAST_GAIN, CEILING, KNEE, FULL = 0.6, 0.3, 0.98, 0.02, 28_000


def _whole(x: np.ndarray) -> np.ndarray:
    """Rounded, halves away from zero."""
    return np.trunc(np.nan_to_num(x + np.copysign(0.5, x))).astype(np.int64)


def step(freq, sweep, rate, depth, i) -> np.ndarray:
    """How far the phase moves at sample ``i``: of a frequency that is swept by so many semitones a
    second and that a vibrato of ``rate`` turns a second moves by ``depth`` semitones."""
    turns = i * rate / RATE
    semitones = sweep * i / RATE + depth * np.sin((turns - np.floor(turns)) * 6.283185307179586)
    return _whole(freq * np.power(2.0, semitones / 12) / RATE * TURN)


def oscillator(wave: np.ndarray, phase: np.ndarray) -> np.ndarray:
    """square (0), saw (1), triangle (2), or else a sine, at a phase in steps of a turn."""
    p = phase / TURN
    out = np.where(wave == 0, np.where(p < 0.5, 1.0, -1.0), np.where(wave == 1, p * 2 - 1, np.where(p < 0.5, p * 4 - 1, 3.0 - p * 4)))
    sine = wave == 3
    out[sine] = np.sin(p[sine] * 6.283185307179586)
    return out


def envelope(i, length, attack, release) -> np.ndarray:
    """Rises over ``attack`` samples, falls over the last ``release`` ones."""
    with np.errstate(divide="ignore", invalid="ignore"):
        up = np.where(attack > 0, np.minimum(1.0, (i + 1) / attack), 1.0)
        down = np.where(release > 0, np.minimum(1.0, (length - i) / release), 1.0)
    return np.minimum(up, down)


_WAVES = {"square": 0, "saw": 1, "triangle": 2}
_NOTE = ("freq", "sweep", "vib_rate", "vib_depth")


def _slabs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows (first and past: their samples) with the row and the number of each sample, so many rows
    that they have about SLAB samples."""
    for b in batches:
        count = b["past"].to_numpy() - b["first"].to_numpy()
        ends = np.cumsum(count)
        at = 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLAB, "right")))
            part, n = b.slice(at, to - at), count[at:to]
            row = np.repeat(np.arange(to - at), n)
            begins = np.cumsum(n) - n
            yield part, row, np.arange(len(row)) - begins[row] + part["first"].to_numpy()[row]
            at = to


def _column(b: pa.RecordBatch, name: str) -> np.ndarray:
    """Numbers, with NaN for null."""
    return b[name].to_numpy(zero_copy_only=False).astype(float)


def _moves(b: pa.RecordBatch, row: np.ndarray, i: np.ndarray) -> np.ndarray:
    return step(*(_column(b, c)[row] for c in _NOTE), i)


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with the sum of their steps."""
    for b, row, i in _slabs(batches):
        by = np.concatenate(([0], np.cumsum(_moves(b, row, i))))
        ends = np.searchsorted(row, np.arange(b.num_rows), "right")
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(by[ends] - by[np.concatenate(([0], ends[:-1]))])], names=[*b.schema.names, "total"])


def _mixer(key: str, size: int):
    """Rows in the order of (key, block) to (key, at, total, voices): the sums, in units of 1e-9, of what
    sounds at a time. Only one block's sums are held between slabs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last block: (key, block), its key as a column, places, sums, voices, those with a value

        def out(keys: pa.Array, at, total, voices, heard) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([keys, pa.array(at), pa.array(total, mask=heard == 0), pa.array(voices)], names=[key, "at", "total", "voices"])

        for b, row, i in _slabs(batches):
            wave = np.array([_WAVES.get(w, 3) for w in b["wave"].to_pylist()])
            moves = _moves(b, row, i)
            sums = np.cumsum(moves) - moves
            begins = np.searchsorted(row, np.arange(b.num_rows))
            phase = np.mod(b["begin"].to_numpy()[row] + sums - sums[begins][row], TURN)
            value = oscillator(wave[row], phase) * envelope(i, _column(b, "length")[row], _column(b, "attack")[row], _column(b, "release")[row]) * _column(b, "volume")[row]
            ids = list(zip(b[key].to_pylist(), b["block"].to_pylist(), strict=True))
            new = np.array([n > 0 and x != ids[n - 1] for n, x in enumerate(ids)])
            group = np.cumsum(new)
            starts = np.concatenate(([0], np.flatnonzero(new)))
            block = b["block"].to_numpy()
            place = group[row] * size + (b["start"].to_numpy()[row] + i - block[row] * size)
            amounts = (_whole(value * 1e9), np.ones(len(place), np.int64), (~np.isnan(value)).astype(np.int64))
            if held is not None:
                if held[0] == ids[0]:
                    place, *amounts = (np.concatenate(x) for x in zip(held[2:], (place, *amounts), strict=True))
                else:
                    yield out(held[1].take(pa.array(np.zeros(len(held[2]), np.int64))), held[0][1] * size + held[2], *held[3:])
            order = np.argsort(place, kind="stable")
            place = place[order]
            first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
            place, sums = place[first], [np.add.reduceat(x[order], first) for x in amounts]
            last = int(group[-1])
            done = int(np.searchsorted(place, last * size))
            if done:
                g = place[:done] // size
                yield out(b[key].take(pa.array(starts[g])), block[starts[g]] * size + place[:done] % size, *(x[:done] for x in sums))
            held = (ids[-1], b[key].slice(b.num_rows - 1, 1), place[done:] - last * size, *(x[done:] for x in sums))
        if held is not None:
            yield out(held[1].take(pa.array(np.zeros(len(held[2]), np.int64))), held[0][1] * size + held[2], *held[3:])

    return run


def mixed(sums: DataFrame, keys: list[str], at: str) -> DataFrame:
    """(keys, at, pcm): the voices that sound at one time (total, in units of 1e-9, and voices) as one
    sample of 16 bits: held back by a gate where several would clip, limited, and clipped softly."""
    out = sums.withColumn("_mix", F.col("total") / 1e9)
    size = F.abs(F.col("_mix"))
    gain = F.greatest(F.lit(LEAST_GAIN), 1 - (size - GATE) / (1 + F.col("voices") * 0.25))
    out = out.withColumn("_mix", F.when((F.col("voices") > 1) & (size > GATE), F.col("_mix") * gain).otherwise(F.col("_mix")))
    low = CEILING - KNEE
    bent = F.when(size <= low, size).when(size >= CEILING, F.lit(CEILING)).otherwise(low + KNEE * F.tanh((size - low) / KNEE))
    out = out.withColumn("_mix", F.signum("_mix") * bent)
    soft = (F.lit(3.0) - F.col("_mix") * F.col("_mix")) * F.col("_mix") / 2
    return out.select(*keys, at, F.round(soft * FULL, 4).cast("int").alias("pcm"))


def render(notes: DataFrame, sequence: str, note: str, chunk: int = CHUNK) -> DataFrame:
    """(sequence, at, pcm): every sample of every sequence. Notes have sequence, note, start and
    length (samples), freq, sweep, vib_rate, vib_depth, wave, attack, release, volume; a note without
    a start has no place.

    Notes are cut where a chunk of the sequence's time ends. The steps of each cut are summed, and the
    sums of a note's earlier cuts give the phase it begins with; then cuts are dealt by chunk, and
    a chunk is mixed as its cuts come. Rows are cuts, not samples, in every shuffle."""
    whole, real = ["start", "length"], [*_NOTE, "attack", "release", "volume"]
    rows = notes.select(sequence, note, "wave", *[F.col(c).cast("long").alias(c) for c in whole], *[F.col(c).cast("double").alias(c) for c in real]).filter("length > 0 and start is not null")
    block = lambda at: F.floor(at / chunk)
    cuts = rows.select("*", F.explode(F.sequence(block(F.col("start")), block(F.col("start") + F.col("length") - 1))).alias("block"))
    cuts = cuts.withColumn("first", F.greatest(F.lit(0), F.col("block") * chunk - F.col("start")).cast("long")).withColumn("past", F.least(F.col("length"), (F.col("block") + 1) * chunk - F.col("start")).cast("long"))
    cuts = cuts.repartition(max(1, -(-cuts.count() // CHUNKS)), sequence, note, "block")
    summed = cuts.mapInArrow(_totals, StructType([*cuts.schema.fields, StructField("total", LongType())]))
    before = Window.partitionBy(sequence, note).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    begun = summed.withColumn("begin", F.pmod(F.coalesce(F.sum("total").over(before), F.lit(0)), F.lit(TURN))).drop("total", note)
    dealt = begun.repartition(sequence, "block").sortWithinPartitions(sequence, "block")
    schema = StructType([notes.schema[sequence], *[StructField(c, LongType()) for c in ("at", "total", "voices")]])
    return mixed(dealt.mapInArrow(_mixer(sequence, chunk), schema), [sequence], "at")
