"""Files with a fixed form, written through Spark's writers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def app_records(manifests: DataFrame, properties: str = "properties", keep: list[str] | None = None) -> DataFrame:
    """The published record of each manifest, after the columns to keep: optional names default to empty, a code that
    is no number to 0, platforms are split and trimmed."""
    p = lambda k: F.try_element_at(properties, F.lit(k))
    platforms = F.filter(F.transform(F.split(F.coalesce(p("target.platforms"), F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    code = F.coalesce(p("app.version.code").try_cast("int"), F.lit(0))
    return manifests.select(
        *(keep or []), p("app.id").alias("appId"), F.coalesce(p("app.version.name"), F.lit("")).alias("appVersionName"), code.alias("appVersionCode"), F.coalesce(p("app.name"), F.lit("")).alias("appName"),
        F.coalesce(p("app.description"), F.lit("")).alias("appDescription"), F.coalesce(p("target.sdk"), F.lit("")).alias("targetSdk"), platforms.alias("targetPlatforms"),
        F.concat(p("app.id"), F.lit("-"), code.cast("string"), F.lit(".app")).alias("file"),
    )


def write_index(records: DataFrame, path: str, sdk: str, created: str, commit: str) -> None:
    """One JSON document with all records by id. An index is one file that its readers
    load whole, so it is small by nature and one task writes it."""
    apps = records.agg(F.sort_array(F.collect_list(F.struct(*records.columns))).alias("apps"))
    doc = apps.select(F.to_json(F.struct(F.lit(sdk).alias("sdkVersion"), F.lit(created).alias("created"), F.lit(commit).alias("gitCommit"), "apps")).alias("value"))
    doc.coalesce(1).write.mode("overwrite").text(path)


def todo_rows(rows: DataFrame, list_col: str) -> DataFrame:
    """list, idx, value: ``+ text`` (done) or ``- text`` lines."""
    return rows.select(list_col, "idx", F.concat_ws(" ", F.when(F.col("done"), "+").otherwise("-"), "text").alias("value"))


def write_todos(rows: DataFrame, path: str, list_col: str) -> None:
    """A text folder for each list, its lines in their order."""
    lines = todo_rows(rows, list_col)
    lines.repartition(list_col).sortWithinPartitions(list_col, "idx").select(list_col, "value").write.mode("overwrite").partitionBy(list_col).text(path)


def upsert(spark, path: str, rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """A Parquet table at ``path`` with ``rows`` merged in: of equal keys the row with the
    greatest ``order``. Written beside the old table, which is then renamed before the new one
    takes its name and goes only after that: at any moment one of the two is whole, and the
    next call finds it."""
    from ..operators.ordered import last_wins

    jvm = spark._jvm
    now, new, aside = (jvm.org.apache.hadoop.fs.Path(f"{path}{end}") for end in ("", ".new", ".old"))
    fs = now.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(now) and fs.exists(aside):  # a job was lost between the two names
        fs.rename(aside, now)
    exists = fs.exists(now)
    both = spark.read.parquet(path).unionByName(rows) if exists else rows
    values = [c for c in rows.columns if c not in keys]
    last_wins(both, keys, F.col(order), values).write.mode("overwrite").parquet(f"{path}.new")
    if exists:
        fs.delete(aside, True)
        fs.rename(now, aside)
    fs.rename(new, now)
    fs.delete(aside, True)
    return spark.read.parquet(path)


def c_header(frames: DataFrame, name: str, values: str, row: int = 24) -> DataFrame:
    """A line of C source for each frame."""
    from ..functions.text import hex_words

    return frames.select(name, F.concat(F.lit("static const uint16_t "), F.col(name), F.lit("["), F.size(values).cast("string"), F.lit("] = {\n"), hex_words(F.col(values), row), F.lit("\n};")).alias("source"))


def raster_lines(sheet: DataFrame, key: str, width: int, height: int) -> DataFrame:
    """key, line_no, value: sheets (key, y, n_frames, pixels of 16 bits) as the lines of portable
    pixel maps in text form: a header, then a line for each line of the raster."""
    from ..functions.colour import from_565

    def dots(v):
        return F.concat_ws(" ", *[c.cast("string") for c in from_565(v)])

    size = F.concat_ws(" ", F.lit("P3"), (F.col("n_frames") * width).cast("string"), F.lit(str(height)), F.lit("255"))
    line = F.struct((F.col("y") + 1).alias("line_no"), F.array_join(F.transform("pixels", dots), " ").alias("value"))
    # the header goes with the first line, so that the sheets are made once
    header = F.struct(F.lit(0).alias("line_no"), size.alias("value"))
    return sheet.select(key, F.explode(F.when(F.col("y") == 0, F.array(header, line)).otherwise(F.array(line))).alias("_l")).select(key, "_l.line_no", "_l.value")


def write_rasters(sheet: DataFrame, path: str, key: str, width: int, height: int) -> None:
    """A text folder for each sheet, which any reader of pixel maps takes once its parts are joined."""
    lines = raster_lines(sheet, key, width, height)
    lines.repartition(key).sortWithinPartitions(key, "line_no").select(key, "value").write.mode("overwrite").partitionBy(key).text(path)
