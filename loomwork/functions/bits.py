"""Bit fields, checksums and byte layouts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def has_bit(bits: Column, n: Column | int) -> Column:
    """Whether bit ``n`` is set."""
    return F.getbit(bits.cast("long"), n if isinstance(n, Column) else F.lit(n)) == 1


def with_bit(bits: Column, n: int) -> Column:
    return bits.bitwiseOR(F.lit(1 << n))


def bits_set(bits: Column, width: int) -> Column:
    """How many of the lowest ``width`` bits are set."""
    return F.bit_count(bits.bitwiseAND(F.lit((1 << width) - 1)))


def one_hot(n: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1), n.cast("int"))


def bit_array(bits: Column, width: int) -> Column:
    """The lowest bits as an array of 0 and 1, the lowest first."""
    return F.array(*[F.getbit(bits.cast("long"), F.lit(i)).cast("int") for i in range(width)])


def xor_of(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, v: a.bitwiseXOR(v.cast("int")))


def sum_mod_256(*values: Column) -> Column:
    total = values[0].cast("long")
    for v in values[1:]:
        total = total + v
    return total.bitwiseAND(F.lit(255))


def wrap(value: Column, bits: int) -> Column:
    """An unsigned integer of so many bits: what overflows wraps around."""
    return F.pmod(value.cast("long"), F.lit(1 << bits))


def little_endian_signed(low: Column, high: Column) -> Column:
    """A signed 16-bit number from its two bytes."""
    n = high * 256 + low
    return F.when(n >= 32768, n - 65536).otherwise(n)


def pack_bytes(value: Column, n: int) -> Column:
    """The lowest ``n`` bytes as an array, the highest first."""
    return F.array(*[F.call_function("shiftright", value, F.lit(8 * i)).bitwiseAND(F.lit(255)) for i in reversed(range(n))])


def lcg(seed: Column, multiplier: int, increment: int, steps: Column) -> Column:
    """A linear congruential generator modulo 2 ** 32 after so many steps."""
    product = lambda x: F.pmod((x.cast("decimal(38,0)") * F.lit(multiplier) + F.lit(increment)), F.lit(1 << 32)).cast("long")
    return F.aggregate(F.sequence(F.lit(1), steps), seed.cast("long"), lambda x, _: product(x))


def shift_register(seed: Column, taps: tuple[int, ...], width: int, steps: Column) -> Column:
    """A Fibonacci shift register of ``width`` bits after so many steps: the bits at
    ``taps`` are xored into the highest."""

    def step(x: Column, _: Column) -> Column:
        bit = F.getbit(x, F.lit(taps[0]))
        for t in taps[1:]:
            bit = bit.bitwiseXOR(F.getbit(x, F.lit(t)))
        # a seed may be wider than the register, so that the highest bit is set already
        return F.call_function("shiftright", x, F.lit(1)).bitwiseOR(bit.cast("long") * F.lit(1 << (width - 1)))

    return F.when(steps < 1, seed.cast("long")).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(steps, F.lit(1))), seed.cast("long"), step))
