"""Tones and samples as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

RATE = 16000


def note_to_hz(note: Column) -> Column:
    """Note 69 is 440 Hz, 0 is silence, what is above 127 counts as 127."""
    return F.when(note == 0, F.lit(0.0)).otherwise(F.lit(440.0) * F.pow(F.lit(2.0), (F.least(note, F.lit(127)) - 69) / F.lit(12.0)))


def ms_to_samples(ms: Column, rate: int = RATE) -> Column:
    return F.floor(ms * rate / 1000).cast("long")


def wave(kind: Column, phase: Column) -> Column:
    """Waveforms of a phase in [0, 1): square, three pulses, triangle, saw, sine. The two
    noises are ``noise`` of a register's state."""
    return (
        F.when(kind == "square", F.when(phase < 0.5, 1.0).otherwise(-1.0))
        .when(kind == "pulse25", F.when(phase < 0.25, 1.0).otherwise(-1.0))
        .when(kind == "pulse12", F.when(phase < 0.125, 1.0).otherwise(-1.0))
        .when(kind == "pulse75", F.when(phase < 0.75, 1.0).otherwise(-1.0))
        .when(kind == "triangle", F.lit(4.0) * F.abs(phase - 0.5) - 1.0)
        .when(kind == "saw", F.lit(2.0) * phase - 1.0)
        .when(kind == "sine", F.sin(F.lit(2 * math.pi) * phase))
        .otherwise(F.lit(0.0))
    )


#: Taps and width of the two noises' shift registers.
NOISE, RETRO_NOISE = ((0, 2, 3, 5), 16), ((0, 1), 15)


def noise(state: Column) -> Column:
    """The level of a shift register's state: its lowest bit up or down."""
    return F.when(F.getbit(state, F.lit(0)) == 1, 1.0).otherwise(-1.0)


def envelope(at: Column, length: Column, attack: Column, decay: Column, sustain: Column, release: Column) -> Column:
    """Attack, decay, sustain, release: the gain of a voice's sample number ``at`` (from 1)
    whose note has ``length`` samples (0: endless).

    Attack and decay last a sample at least. The note is held until it has its length, but
    not less than a sample after the decay; then it is released."""
    a, d = F.greatest(attack, F.lit(1)), F.greatest(decay, F.lit(1))
    held = F.greatest(a + d + 1, length + 1)
    left = at - held
    return (
        F.when(at < 1, F.lit(0.0))
        .when(at <= a, F.when(attack > 0, at / attack).otherwise(F.lit(1.0)))
        .when(at <= a + d, F.when(decay > 0, F.lit(1.0) - (at - a) / decay * (F.lit(1.0) - sustain)).otherwise(sustain))
        .when((length <= 0) | (left <= 0), sustain)
        .when((release > 0) & (left < release), sustain * (F.lit(1.0) - left / release))
        .otherwise(F.lit(0.0))
    )


#: The most a punch adds, what a twang keeps at each sample and where it ends.
PUNCH, TWANG, SILENT = 1.5, 0.992, 0.001


def effect_envelope(kind: Column, at: Column, length: Column, attack: Column, decay: Column) -> Column:
    """The gain of sample number ``at`` (from 1) for the effects' shapes: a punch begins
    louder, a flare rises by the square and falls, a swell rises over its length, a twang
    fades by a share at each sample, a decay falls over its length."""
    done = (length > 0) & (at - 1 > length)
    over = F.when(length > 0, (at - 1) / length)
    falling = F.lit(1.0) - (at - attack) / decay
    twang = F.pow(F.lit(TWANG), at)
    return (
        F.when(at < 1, F.lit(0.0))
        .when(kind == "punch", F.when(done, 0.0).when(at < attack, F.least(F.lit(PUNCH), F.lit(2.0) - at / attack)).otherwise(1.0))
        .when(kind == "flare", F.when(at < attack, F.pow(at / attack, F.lit(2.0))).when(at < attack + decay, falling).otherwise(0.0))
        .when(kind == "swell", F.when(done, 0.0).otherwise(F.coalesce(F.least(F.lit(1.0), over), F.lit(1.0))))
        .when(kind == "twang", F.when(twang < SILENT, 0.0).otherwise(twang))
        .when(kind == "decay", F.when(done, 0.0).otherwise(F.coalesce(F.greatest(F.lit(0.0), F.lit(1.0) - over), F.lit(0.0))))
        .otherwise(F.lit(0.0))
    )


def bent_hz(hz: Column, at: Column, depth: Column, rate: Column, sweep: Column) -> Column:
    """A voice's frequency at sample ``at`` (from 0): vibrato of ``depth`` semitones, ``rate``
    times a second, and a sweep of so many semitones a second."""
    vibrato = F.when((depth > 0) & (rate > 0), F.sin(F.lit(2 * math.pi) * at * rate / RATE) * depth).otherwise(F.lit(0.0))
    return hz * F.pow(F.lit(2.0), vibrato / 12) * F.pow(F.lit(2.0), sweep * at / RATE / 12)


#: Where the gate begins, the least it leaves, and how voices soften it.
GATE, LEAST_GAIN, PER_VOICE = 0.95, 0.3, 0.25


def gate(mix: Column, voices: Column) -> Column:
    """What several voices sum up to over GATE is taken back by the share of the excess; one
    voice, and what is not over GATE, stays."""
    over = F.abs(mix) - GATE
    gain = F.greatest(F.lit(LEAST_GAIN), F.lit(1.0) - over / (F.lit(1.0) + voices * PER_VOICE))
    return F.when((voices > 1) & (over > 0), mix * gain).otherwise(mix)


def limit(x: Column, ceiling: float = 0.98, knee: float = 0.02) -> Column:
    """A ceiling that nothing exceeds, and a bend in the knee below it."""
    over = F.abs(x) - (ceiling - knee)
    bent = F.lit(ceiling - knee) + F.lit(knee) * F.tanh(over / knee)
    return F.when(over <= 0, x).otherwise(F.signum(x) * F.when(over >= knee, F.lit(ceiling)).otherwise(bent))


def soft_clip(x: Column, scale: int = 28000) -> Column:
    """A cubic bend, then a 16-bit sample, cut towards zero."""
    y = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x))
    return F.round((y * 1.5 - y * y * y * 0.5) * scale, 3).cast("int")


def midi_bytes(kind: int, channel: Column, a: Column, b: Column) -> Column:
    """A channel message: status or channel, then two values of seven bits."""
    return F.array(F.lit(kind).bitwiseOR(channel.bitwiseAND(F.lit(15))), a.bitwiseAND(F.lit(127)), b.bitwiseAND(F.lit(127)))


def bend_bytes(channel: Column, bend: Column) -> Column:
    """A bend from -8192 to 8191 as a message with two values of seven bits."""
    v = F.greatest(F.lit(0), F.least(F.lit(16383), bend + 8192))
    return midi_bytes(0xE0, channel, v, F.call_function("shiftright", v, F.lit(7)))


#: Fixed values of the normaliser: share of the mean square that is kept, the root to reach,
#: samples between two gains, the gain's bounds, and the mean square that counts as silence.
KEEP, TARGET, EVERY, LOW, HIGH, SILENCE = 0.999, 0.35, 16, 0.5, 1.5, 0.001


def gain_step(state: tuple[float, float, int] | None, x: float) -> tuple[float, float, int]:
    """(mean square, gain, samples) after one more sample, as a step of an ordered fold: the
    gain is renewed after each EVERY samples, and is 1 on silence."""
    square, gain, n = state or (0.0, 1.0, 0)
    square, n = square * KEEP + x * x * (1 - KEEP), n + 1
    if n % EVERY == 0:
        gain = max(LOW, min(HIGH, TARGET / math.sqrt(square))) if square >= SILENCE else 1.0
    return square, gain, n
