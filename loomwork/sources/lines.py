"""Text formats read line by line, as DataFrame operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line_no (from 0), line of the files at ``path``; a file is read whole, so
    that its lines keep their order."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return whole.select("file", F.posexplode(F.split(F.regexp_replace("value", "\r?\n$", ""), "\r?\n")).alias("line_no", "line"))


def properties(lines: DataFrame, keys: list[str], line_no: str = "line_no", line: str = "line") -> DataFrame:
    """keys, name, value of ``name=value`` lines. Blank lines and those that begin with #
    are skipped, so are lines without =; the first = divides; both sides are trimmed; of
    equal names the last wins."""
    t = F.trim(F.col(line))
    rows = lines.filter(~t.rlike("^(#|$)") & t.contains("=")).select(*keys, F.col(line_no).alias("_n"), F.split(t, "=", 2).alias("_p"))
    rows = rows.select(*keys, "_n", F.trim(F.col("_p")[0]).alias("name"), F.trim(F.col("_p")[1]).alias("value"))
    return rows.groupBy(*keys, "name").agg(F.max_by("value", "_n").alias("value"))


def property_map(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One map of names to values for each key."""
    return rows.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("properties"))


#: The names a package manifest must have.
REQUIRED = ("manifest.version", "target.sdk", "target.platforms", "app.id", "app.version.name", "app.version.code", "app.name")


def missing_keys(properties: Column) -> Column:
    """The required names that a manifest lacks, in their order."""
    return F.filter(F.array(*[F.lit(k) for k in REQUIRED]), lambda k: ~F.map_contains_key(properties, k))


def todo_lines(lines: DataFrame, keys: list[str], line_no: str = "line_no", line: str = "line", most: int = 50) -> DataFrame:
    """keys, idx, done, text of ``+ text`` and ``- text`` lines; shorter than three
    characters or otherwise formed lines are skipped, a list keeps its first ``most``."""
    from ..operators.ordered import reindexed

    rows = lines.filter((F.length(line) >= 3) & F.col(line).rlike("^[+-] "))
    rows = rows.select(*keys, F.col(line_no).alias("_n"), F.col(line).startswith("+").alias("done"), F.substring(line, 3, 1 << 30).alias("text"))
    return reindexed(rows, keys, ["_n"], most=most).select(*keys, "idx", "done", "text")


def progress(value: Column) -> Column:
    """struct(path, place, kind) of a record of three lines, the third being optional."""
    p = F.split(F.regexp_replace(value, "\r", ""), "\n")
    return F.struct(p[0].alias("path"), F.coalesce(F.trim(F.try_element_at(p, F.lit(2))).try_cast("int"), F.lit(0)).alias("place"), F.coalesce(F.nullif(F.try_element_at(p, F.lit(3)), F.lit("")), F.lit("epub")).alias("kind"))


def c_arrays(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, name, idx, value of the hexadecimal arrays in C source."""
    found = F.regexp_extract_all(text, F.lit(r"(\w+)\s*\[[^\]]*\]\s*=\s*\{([^}]*)\}"), F.lit(0))
    arrays = df.select(*keys, F.explode(found).alias("_a"))
    name = F.regexp_extract("_a", r"^(\w+)", 1)
    body = F.regexp_extract_all(F.regexp_extract("_a", r"\{([^}]*)\}", 1), F.lit("0[xX]([0-9A-Fa-f]+)"), F.lit(1))
    return arrays.select(*keys, name.alias("name"), F.posexplode(body).alias("idx", "_h")).select(*keys, "name", "idx", F.conv("_h", 16, 10).cast("long").alias("value"))


def with_defaults(rows: DataFrame, defaults: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Configuration rows laid over a table of defaults: a default row for each key, its
    values replaced where the configuration has one."""
    own = rows.select(F.col(key), *[F.col(c).alias(f"_{c}") for c in columns])
    return defaults.join(own, key, "left").select(key, *[F.coalesce(f"_{c}", c).alias(c) for c in columns])
