"""Paths, names, labels and small formats as column expressions."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def extension(name: Column) -> Column:
    """The last extension in lower case with its dot; empty if there is none."""
    return F.lower(F.regexp_extract(name, r"(\.[^./]*)$", 1))


def parent(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def display_name(path: Column) -> Column:
    """The last part of a path without its last extension."""
    return F.regexp_replace(base_name(path), r"\.[^.]*$", "")


def first_part(path: Column, default: str) -> Column:
    """The first directory of an absolute path, or a default."""
    return F.coalesce(F.nullif(F.regexp_extract(path, r"^(/[^/]+)/", 1), F.lit("")), F.lit(default))


def resolved(base: Column, href: Column) -> Column:
    """``href`` relative to the directory ``base``: ``.`` and empty parts go, ``..`` takes
    the part before it away (none before: nothing). An absolute href stays as it is."""
    parts = F.split(F.concat_ws("/", base, href), "/")

    def step(a: Column, s: Column) -> Column:
        up = F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))
        return F.when(s.isin("", "."), a).when(s == "..", up).otherwise(F.concat(a, F.array(s)))

    joined = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")
    return F.when(href.startswith("/"), href).otherwise(joined)


def without_suffix(version: Column) -> Column:
    """A version without its last ``-suffix``."""
    return F.regexp_replace(F.trim(version), "-[^-]*$", "")


def package_name(app: Column, code: Column) -> Column:
    return F.concat(app, F.lit("-"), code.cast("string"), F.lit(".app"))


def hex_bytes(text: Column) -> Column:
    """The UTF-8 bytes in hex, a blank between two."""
    return F.trim(F.regexp_replace(F.hex(F.encode(text, "UTF-8")), "(..)", "$1 "))


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def hex_words(values: Column, row: int) -> Column:
    """Numbers as C literals, so many in a line."""
    words = F.transform(values, lambda v: F.format_string("0x%04X", v))
    lines = F.transform(F.sequence(F.lit(0), F.floor((F.size(words) - 1) / row).cast("int")), lambda i: F.array_join(F.slice(words, i * row + 1, row), ", "))
    return F.array_join(lines, ",\n")


def split_list(text: Column, trimmed: bool = True) -> Column:
    """The parts of a comma-separated list; trimmed, empty ones are dropped."""
    parts = F.split(text, ",")
    return F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != "") if trimmed else parts


def day_phase(seconds: Column) -> Column:
    """Half an hour of day, half an hour of night."""
    return F.when(seconds % 3600 < 1800, "Day").otherwise("Night")


def age_label(hours: Column) -> Column:
    return F.concat(F.floor(hours / 24).cast("string"), F.lit("d "), F.pmod(hours, F.lit(24)).cast("string"), F.lit("h"))


def iso_utc(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def plural(n: Column, one: str, many: str, none: str) -> Column:
    return F.when(n == 0, none).when(n == 1, f"1 {one}").otherwise(F.concat(n.cast("string"), F.lit(f" {many}")))


@F.arrow_udf(StringType())
def _eight_digits(x: pa.Array) -> pa.Array:
    return pa.array([None if v is None else f"{v:.8g}" for v in x.to_pylist()], pa.string())


def eight_digits(x: Column) -> Column:
    """A number with eight significant digits, as printf's ``%.8g`` has it: without zeros at
    the end, with an exponent below -4 and from 8 on. It is the exact number that is rounded, a
    tie to the even digit; zero has no sign."""
    return _eight_digits(F.when(x == 0, F.lit(0.0)).otherwise(x.cast("double")))
