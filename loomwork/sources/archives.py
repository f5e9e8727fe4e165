"""Archives and packed records in binary columns: a row for each member or record.

The files come from Spark's ``binaryFile`` reader, so that listing, splitting among tasks
and retries are Spark's; a task opens one file's bytes at a time."""

from __future__ import annotations

import io
import struct
import tarfile
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes of members that are handed on at once.
BATCH_BYTES = 4 << 20


def read_files(spark: SparkSession, path: str, names: str | None = None) -> DataFrame:
    """path, length, content of the files below ``path``; ``names`` is a pattern without
    regard to case."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.filter(F.col("path").rlike(f"(?i){names}")) if names else files


def books(spark: SparkSession, path: str) -> DataFrame:
    """path and shelf name (``sub/name``) of books and texts at most two folders deep;
    contents are not read. Hidden files are left out."""
    return shelved(read_files(spark, path, r"\.(epub|txt)$").select("path"), path)


def shelved(files: DataFrame, root: str, path: str = "path") -> DataFrame:
    """``files`` with ``name``: what a listing of ``root`` and its folders shows, ``name`` or
    ``sub/name``. Deeper files, and hidden files and folders, are left out."""
    at = F.instr(path, root) + len(root)
    rows = files.withColumn("name", F.ltrim(F.substring(F.col(path), at, F.length(path)), F.lit("/")))
    parts = F.split("name", "/")
    return rows.filter((F.size(parts) <= 2) & ~F.exists(parts, lambda x: x.startswith(".")))


#: Bytes of a script that is loaded: neither empty nor more than its buffer takes.
SCRIPT_BYTES = (1, 32768)


def loadable(name: Column, size: Column) -> Column:
    """Whether a file is a script that can be loaded: a name of three characters or more that
    ends with .b or .bf, in any case, and a size its buffer takes."""
    return (F.length(name) >= 3) & F.lower(name).rlike(r"\.bf?$") & size.between(*SCRIPT_BYTES)


def zip_members(files: DataFrame, key: str = "path", content: str = "content", with_data: bool = True) -> DataFrame:
    """key, member, csize, usize, offset, method, data of zip archives. Members that are
    neither stored nor deflated, and damaged ones, have null data; what is no archive has
    no rows."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["key", "member", "csize", "usize", "offset", "method", "data"]
        for b in batches:
            rows, size = [], 0
            for k, c in zip(b["key"], b["content"], strict=True):
                try:
                    z = zipfile.ZipFile(io.BytesIO(c or b""))
                except zipfile.BadZipFile:
                    continue
                for m in z.infolist():
                    data = None
                    if with_data and m.compress_type in (0, 8):
                        try:
                            data = z.read(m)
                        except (zipfile.BadZipFile, zlib.error, RuntimeError):
                            pass
                    rows.append((k, m.filename, m.compress_size, m.file_size, m.header_offset, m.compress_type, data))
                    size += len(data or b"")
                    if size >= BATCH_BYTES:
                        yield pd.DataFrame(rows, columns=columns)
                        rows, size = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=columns)

    rows = files.select(F.col(key).cast("string").alias("key"), F.col(content).alias("content"))
    out = rows.mapInPandas(read, "key string, member string, csize long, usize long, offset long, method int, data binary")
    return out.withColumnRenamed("key", key)


def _tar(content: bytes | None) -> tarfile.TarFile:
    """A tar archive of any compression; the decompressors are not tried on what has the mark of a
    plain one."""
    c = content or b""
    plain = c[257:262] == b"ustar" and not c.startswith((b"\x1f\x8b", b"BZh", b"\xfd7zXZ", b"]\0\0", b"\x28\xb5\x2f\xfd"))
    return tarfile.open(fileobj=io.BytesIO(c), mode="r:" if plain else "r:*")


def tar_manifests(files: DataFrame, key: str = "path", content: str = "content", name: str = "manifest.properties") -> DataFrame:
    """key, manifest: the first regular member of that base name in each tar archive of
    any compression; null where there is none or the archive is damaged."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for c in b["content"]:
                found = None
                try:
                    with _tar(c) as t:
                        m = next((m for m in t if m.isfile() and m.name.rpartition("/")[2] == name), None)
                        found = t.extractfile(m).read().decode("utf-8", "replace") if m else None
                except (tarfile.TarError, EOFError, OSError, zlib.error):
                    pass
                out.append(found)
            yield pd.DataFrame({"key": b["key"], "manifest": out})

    rows = files.select(F.col(key).cast("string").alias("key"), F.col(content).alias("content"))
    return rows.mapInPandas(read, "key string, manifest string").withColumnRenamed("key", key)


def tar_members(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """key, member, size of the regular members of tar archives; damaged ones have none."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, c in zip(b["key"], b["content"], strict=True):
                try:
                    with _tar(c) as t:
                        out += [(k, m.name, m.size) for m in t if m.isfile()]
                except (tarfile.TarError, EOFError, OSError, zlib.error):
                    pass
            yield pd.DataFrame(out, columns=["key", "member", "size"])

    rows = files.select(F.col(key).cast("string").alias("key"), F.col(content).alias("content"))
    return rows.mapInPandas(read, "key string, member string, size long").withColumnRenamed("key", key)


#: A partition table: where it lies, its records, and the mark each begins with.
TABLE_AT, RECORD, RECORD_BYTES, MARK, MOST = 0x8000, "<HBBII16sI", 32, 0x50AA, 128


def partitions(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """key, idx, type, subtype, offset, size, name, flags of the partition records in
    firmware images, up to the first that lacks the mark."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, c in zip(b["key"], b["part"], strict=True):
                c = c or b""
                for i, r in enumerate(struct.iter_unpack(RECORD, c[: len(c) // RECORD_BYTES * RECORD_BYTES])):
                    if r[0] != MARK:
                        break
                    out.append((k, i, r[1], r[2], r[3], r[4], r[5].split(b"\0")[0].decode("ascii", "replace"), r[6]))
            yield pd.DataFrame(out, columns=["key", "idx", "type", "subtype", "offset", "size", "name", "flags"])

    # only the table's bytes leave the JVM
    rows = files.select(F.col(key).cast("string").alias("key"), F.substring(F.col(content), TABLE_AT + 1, RECORD_BYTES * MOST).alias("part"))
    out = rows.mapInPandas(read, "key string, idx int, type int, subtype int, offset long, size long, name string, flags long")
    return out.withColumnRenamed("key", key)


def app_partition(rows: DataFrame, key: str = "path") -> DataFrame:
    """The application's partition of each image: the first with subtype 0 (factory), else
    0x10 (first update slot), else any of type 0."""
    rank = F.when(F.col("subtype") == 0, 0).when(F.col("subtype") == 0x10, 1).otherwise(2)
    return rows.filter("type = 0").groupBy(key).agg(F.min_by(F.struct("offset", "size"), F.struct(rank, "idx")).alias("p")).select(key, "p.offset", "p.size")


def app_place(content: Column) -> Column:
    """struct(offset, size) of the application's partition in a firmware image, as ``app_partition``
    picks it; null if there is none. A column expression: the image goes nowhere."""
    from ..functions.let import let

    def places(part: Column) -> Column:
        number = lambda at, n: F.conv(F.hex(F.concat(*[F.substring(part, at + i + 1, F.lit(1)) for i in reversed(range(n))])), 16, 10).cast("long")
        every = F.sequence(F.lit(0), F.lit(MOST - 1))
        whole = lambda i: (F.length(part) >= (i + 1) * RECORD_BYTES) & (F.substring(part, i * RECORD_BYTES + 1, F.lit(2)) == F.lit(MARK.to_bytes(2, "little")))
        end = F.array_position(F.transform(every, whole), False).cast("int")
        apps = F.filter(F.slice(every, F.lit(1), F.when(end == 0, MOST).otherwise(end - 1)), lambda i: number(i * RECORD_BYTES + 2, 1) == 0)
        subtype = lambda i: number(i * RECORD_BYTES + 3, 1)
        rank = lambda i: F.when(subtype(i) == 0, 0).when(subtype(i) == 0x10, 1).otherwise(2)
        best = F.array_min(F.transform(apps, lambda i: F.struct(rank(i).alias("rank"), i.alias("idx"))))["idx"]
        return let(best, lambda i: F.when(i.isNotNull(), F.struct(number(i * RECORD_BYTES + 4, 4).alias("offset"), number(i * RECORD_BYTES + 8, 4).alias("size"))))

    return let(F.substring(content, TABLE_AT + 1, RECORD_BYTES * MOST), places)


#: Pieces of markup: comments, CDATA, instructions, other declarations, end tags, elements, texts.
#: What is not closed goes on to the end. A malformed attribute ends an element's list; the
#: element ends at the next ">".
_ATTRIBUTES = r"(?:[ \t\n\r]*[^ \t\n\r>/=]+[ \t\n\r]*=[ \t\n\r]*(?:\"[^\"]*(?:\"|\z)|'[^']*(?:'|\z)))*"
PIECES = rf"(?s)<!--.*?(?:-->|\z)|<!\[CDATA\[.*?(?:\]\]>|\z)|<\?.*?(?:\?>|\z)|<[!/][^>]*(?:>|\z)|<[^ \t\n\r>/=]*{_ATTRIBUTES}[^>]*(?:>|\z)|[^<]+"


def xml_events(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, seq, kind (element, end, text, comment, cdata, instruction), name, value, attrs of
    lenient XML: a row for each tag, comment, CDATA section and instruction, and for each
    text between them that is not blank; entities stay as typed. An element that closes
    itself gives both rows.

    The markup is cut by one expression and classified by column expressions: no parser
    state is needed. Other declarations are passed over. A comment that begins with a single
    dash ends the events of its document: the pieces are cut off before the first such."""
    cut = F.regexp_extract_all(F.col(text), F.lit(PIECES), F.lit(0))
    bad = F.transform(cut, lambda p: p.startswith("<!-") & ~p.startswith("<!--"))
    kept = F.when(F.array_contains(bad, True), F.slice(cut, F.lit(1), F.array_position(bad, True).cast("int") - 1)).otherwise(cut)
    p = F.col("p")
    space = r"[ \t\n\r]"
    kind = (
        F.when(p.startswith("<!--"), "comment")
        .when(p.startswith("<![CDATA["), "cdata")
        .when(p.startswith("<?"), "instruction")
        .when(p.startswith("</"), "end")
        .when(p.startswith("<!"), F.lit(None))
        .when(p.startswith("<"), "element")
        .when(~p.rlike(rf"^{space}*$"), "text")
    )
    rows = docs.select(key, F.posexplode(kept).alias("n", "p")).withColumn("kind", kind).filter("kind is not null")
    name = F.regexp_extract(p, r"^<[/?]?([^ \t\n\r>/=]*)", 1)
    listed = F.regexp_extract(p, rf"(?s)^<[^ \t\n\r>/=]*({_ATTRIBUTES})", 1)
    pairs = F.regexp_extract_all(listed, F.lit(rf"(?s)([^ \t\n\r>/=]+){space}*={space}*(\"[^\"]*|'[^']*)"), F.lit(0))
    entries = F.transform(pairs, lambda a: F.struct(F.regexp_extract(a, r"^([^ \t\n\r>/=]+)", 1).alias("key"), F.regexp_extract(a, rf"(?s)={space}*[\"'](.*)$", 1).alias("value")))
    # of equal names the first counts
    names = F.transform(entries, lambda e: e["key"])
    first = F.filter(entries, lambda e, i: F.array_position(names, e["key"]) == i + 1)
    closes = p.rlike(rf"(?s)^<[^ \t\n\r>/=]*{_ATTRIBUTES}{space}*/")
    kinds = F.when((F.col("kind") == "element") & closes, F.array(F.lit("element"), F.lit("end"))).otherwise(F.array("kind"))
    tags = rows.select(key, "n", "p", F.posexplode(kinds).alias("m", "kind"))
    inner = lambda open_, close: F.regexp_extract(p, rf"(?s)^{open_}(.*?)(?:{close})?\z", 1)
    value = F.when(F.col("kind") == "text", F.trim(p)).when(F.col("kind") == "cdata", inner(r"<!\[CDATA\[", r"\]\]>")).when(F.col("kind") == "comment", inner("<!--", "-->"))
    return tags.select(
        key, (F.col("n") * 2 + F.col("m")).alias("seq"), "kind", F.when(F.col("kind").isin("element", "end", "instruction"), F.when(F.col("kind") == "instruction", F.regexp_replace(name, r"\?$", "")).otherwise(name)).alias("name"), value.alias("value"),
        F.when(F.col("kind") == "element", F.map_from_entries(first)).alias("attrs"),
    )


def container_path(events: DataFrame, key: str) -> DataFrame:
    """The package document that a book's container names first."""
    roots = events.filter("kind = 'element' and name = 'rootfile'")
    return roots.groupBy(key).agg(F.min_by(F.try_element_at("attrs", F.lit("full-path")), "seq").alias("full_path"))


def spine(events: DataFrame, key: str) -> DataFrame:
    """key, place, idref, href of a package document's reading order; an idref that the
    manifest lacks has an empty href, of equal ids the last counts."""
    attr = lambda n: F.try_element_at("attrs", F.lit(n))
    items = events.filter("kind = 'element' and name rlike '(^|:)item$'").groupBy(key, attr("id").alias("idref")).agg(F.max_by(attr("href"), "seq").alias("href"))
    refs = events.filter("kind = 'element' and name rlike '(^|:)itemref$'").select(key, "seq", attr("idref").alias("idref"))
    from ..operators.ordered import reindexed

    return reindexed(refs, [key], ["seq"], "place").join(items, [key, "idref"], "left").select(key, "place", "idref", F.coalesce("href", F.lit("")).alias("href"))


def safe_members(members: DataFrame, member: str = "member") -> DataFrame:
    """The members whose path stays below the folder they are unpacked to."""
    from ..functions.text import resolved

    depth = F.aggregate(F.split(member, "/"), F.struct(F.lit(0).alias("d"), F.lit(0).alias("low")), lambda a, s: F.struct((a["d"] + F.when(s == "..", -1).when(s.isin("", "."), 0).otherwise(1)).alias("d"), F.least(a["low"], a["d"] + F.when(s == "..", -1).otherwise(0)).alias("low")), lambda a: a["low"])
    return members.filter(~F.col(member).startswith("/") & (depth >= 0)).withColumn("target", resolved(F.lit(""), F.col(member)))


def truncated_utf8(data: Column, most: int, whole: bool = True) -> Column:
    """The first ``most`` bytes as text: ``whole`` leaves a character out that the cut
    divides; otherwise what is left of it becomes a replacement character."""

    @F.pandas_udf("string")
    def cut(parts: pd.Series) -> pd.Series:
        return parts.map(lambda d: None if d is None else bytes(d).decode("utf-8", "ignore" if whole else "replace"))

    return cut(F.substring(data, 1, most))


#: Fixed values of a firmware image: its first byte, the chip it must be made for, the
#: sizes of its header and of a segment's, where a description has its version, its size.
IMAGE_MARK, CHIP, HEADER_BYTES, SEGMENT_BYTES, VERSION_AT, DESCRIPTION_BYTES = 0xE9, 13, 24, 8, 16, 256


def image_headers(files: DataFrame, key: str = "path", content: str = "content", at: Column | int = 0, keep: list[str] | None = None) -> DataFrame:
    """key, columns to keep, version, error of the firmware image that begins at byte ``at``: the error is
    null for a good image, the version ``unknown`` if its description is cut off. Bytes
    are compared as column expressions; only the header is read."""
    at = at if isinstance(at, Column) else F.lit(at)
    c = F.col(content)
    byte = lambda i: F.conv(F.hex(F.substring(c, at.cast("int") + i + 1, F.lit(1))), 16, 10).cast("int")
    size = F.length(c) - at
    first = HEADER_BYTES + SEGMENT_BYTES
    chip = byte(12) + byte(13) * 256
    error = (
        F.when(c.isNull() | (size < HEADER_BYTES), "no header")
        .when(byte(0) != IMAGE_MARK, "not an image")
        .when(chip != CHIP, F.concat(F.lit("made for chip "), chip.cast("string")))
        .when(size < first, "no segment")
    )
    text = F.regexp_replace(F.decode(F.substring(c, at.cast("int") + first + VERSION_AT + 1, F.lit(32)), "ISO-8859-1"), "(?s)\u0000.*", "")
    version = F.when(size >= first + DESCRIPTION_BYTES, text).otherwise("unknown")
    return files.select(F.col(key), *(keep or []), F.when(error.isNull(), version).alias("version"), error.alias("error"))


def contents(events: DataFrame, key: str, base: str = "") -> DataFrame:
    """key, seq, title, href of the table of contents in a navigation document's events.

    As the readers of these files have it, there is one current entry: an inner entry
    takes the place of its outer one, and every end gives the last entry out again. Hrefs
    lose their fragment and are resolved against ``base``."""
    from pyspark.sql import Window

    from ..functions.text import resolved

    w = Window.partitionBy(key).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    opened = (F.col("kind") == "element") & (F.col("name") == "navPoint")
    closed = (F.col("kind") == "end") & (F.col("name") == "navPoint")
    label = F.when(F.col("name") == "navLabel", F.when(F.col("kind") == "element", 1).when(F.col("kind") == "end", 0))
    rows = events.select(key, "seq", closed.alias("closed"), F.sum(opened.cast("int")).over(w).alias("entry"), F.last(label, True).over(w).alias("in_label"), F.last(F.when(opened, True).when(closed, False), True).over(w).alias("inside"), "kind", "name", "value", "attrs")
    title = F.when((F.col("kind") == "text") & (F.col("in_label") == 1), F.col("value"))
    href = F.when((F.col("kind") == "element") & (F.col("name") == "content") & F.col("inside"), F.coalesce(F.try_element_at("attrs", F.lit("src")), F.lit("")))
    own = Window.partitionBy(key, "entry").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select(key, "seq", "closed", F.last(title, True).over(own).alias("title"), F.substring_index(F.last(href, True).over(own), "#", 1).alias("href"))
    return rows.filter("closed and title <> '' and href <> ''").select(key, "seq", "title", resolved(F.lit(base), F.col("href")).alias("href"))
