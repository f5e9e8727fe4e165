"""Archives, books, firmware images and sinks: built from the driver's tables, written in their
format, read back through the sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators.dealt import dealt
from ..sinks import files, packages
from ..sources import archives, lines
from .registry import query, table


def _text(c: Column) -> Column:
    return F.encode(c, "UTF-8")


def _member(name: Column | str, data: Column) -> Column:
    return F.struct((F.lit(name) if isinstance(name, str) else name).alias("name"), data.alias("data"))


def _packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A package (USTAR) for each part: its manifest, a binary for each platform, assets."""
    p = dealt(table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_name", "p_size"), "p_partkey")
    manifest = F.concat(F.lit("app.id="), F.lower("p_brand"), F.lit("\napp.name = "), "p_name", F.lit("\napp.version.code="), F.col("p_size").cast("string"), F.lit("\n"))
    members = F.array(_member("elf/board1.elf", _text(F.repeat(F.lit("x"), F.col("p_size")))), _member("manifest.properties", _text(manifest)), _member("assets/manifest.properties", _text(F.lit("app.id=other"))))
    return packages.tar_files(p.select(F.col("p_partkey").cast("string").alias("key"), members.alias("members")))


@query("""
SELECT p_partkey::VARCHAR AS key, lower(p_brand) AS app_id, trim(p_name) AS app_name, p_size AS code FROM part
""")
def package_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of each package, the first of that base name."""
    found = archives.tar_manifests(_packages(spark, sf_dir), "key", "content")
    rows = found.select("key", F.posexplode(F.split("manifest", "\n")).alias("line_no", "line"))
    m = lines.property_map(lines.properties(rows, ["key"]), ["key"])
    p = lambda k: F.try_element_at("properties", F.lit(k))
    return m.select("key", p("app.id").alias("app_id"), p("app.name").alias("app_name"), p("app.version.code").cast("int").alias("code"))


@query("""
SELECT p_partkey::VARCHAR AS key, m.name AS member, m.size::BIGINT AS size FROM (SELECT p_partkey, unnest([{'name': 'elf/board1.elf', 'size': p_size},
  {'name': 'manifest.properties', 'size': 7 + length(p_brand) + 12 + strlen(p_name) + 18 + length(p_size::VARCHAR) + 1}, {'name': 'assets/manifest.properties', 'size': 12}]) AS m FROM part)
""")
def package_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each package holds."""
    return archives.tar_members(_packages(spark, sf_dir), "key", "content").select("key", "member", "size")


def _books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A book (zip) for each supplier: container, package document, contents, two chapters, a
    member that would leave its folder, and one that is too long to be read whole."""
    k, n = F.col("s_suppkey"), F.col("s_suppkey").cast("string")
    container = F.lit('<container><rootfiles><rootfile full-path="OEBPS/book.opf"/><rootfile full-path="other.opf"/></rootfiles></container>')
    opf = F.concat(
        F.lit('<?xml version="1.0"?><package><metadata><dc:title>'), "s_name", F.lit('</dc:title></metadata><manifest><item id="c1" href="old.xhtml"/><item id="c1" href="text/'), n, F.lit('.xhtml"/>'),
        F.when(k % 2 == 0, '<item id="c2" href="../two.xhtml"/>').otherwise(""), F.lit('</manifest><spine><itemref idref="c2"/><itemref idref="c1"/></spine></package>'),
    )
    ncx = F.concat(F.lit("<ncx><navMap><navPoint><navLabel><text>One "), n, F.lit('</text></navLabel><content src="text/'), n, F.lit('.xhtml#a"/></navPoint><navPoint><navLabel><text>No link</text></navLabel></navPoint></navMap></ncx>'))
    members = F.array(
        _member("META-INF/container.xml", _text(container)), _member("OEBPS/book.opf", _text(opf)), _member("OEBPS/toc.ncx", _text(ncx)), _member("../evil.txt", _text(n)), _member("OEBPS/text/long.txt", _text(F.repeat(F.lit("é"), (k % 50).cast("int") + 20))),
    )
    return packages.zip_files(dealt(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), "s_suppkey", 1000).select(n.alias("key"), members.alias("members"), (k % 3 == 0).alias("stored")))


def _book_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = archives.safe_members(archives.zip_members(_books(spark, sf_dir), "key", "content"))
    return m.select("key", "member", archives.truncated_utf8(F.col("data"), 1 << 20).alias("xml"))


@query("""
SELECT s_suppkey::VARCHAR AS key, m.name AS member, m.size::BIGINT AS usize, CASE WHEN s_suppkey % 3 = 0 THEN 0 ELSE 8 END::INTEGER AS method FROM (SELECT *, unnest([{'name': 'META-INF/container.xml', 'size': 117},
  {'name': '../evil.txt', 'size': length(s_suppkey::VARCHAR)}, {'name': 'OEBPS/text/long.txt', 'size': 2 * (s_suppkey % 50 + 20)}]) AS m FROM supplier)
""")
def book_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and methods of some members of each book."""
    m = archives.zip_members(_books(spark, sf_dir), "key", "content", with_data=False)
    return m.filter(F.col("member").isin("META-INF/container.xml", "../evil.txt", "OEBPS/text/long.txt")).select("key", "member", "usize", "method")


@query("""
SELECT s_suppkey::VARCHAR AS key, m AS member FROM (SELECT s_suppkey, unnest(['META-INF/container.xml', 'OEBPS/book.opf', 'OEBPS/toc.ncx', 'OEBPS/text/long.txt']) AS m FROM supplier)
""")
def unpacked_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The members that stay below the folder they are unpacked to."""
    return archives.safe_members(archives.zip_members(_books(spark, sf_dir), "key", "content", with_data=False)).select("key", "member")


@query("""
SELECT s_suppkey::VARCHAR AS key, repeat('é', least(s_suppkey % 50 + 20, 30)::INTEGER) AS whole, CASE WHEN s_suppkey % 50 + 20 > 30 THEN repeat('é', 30) || '�' ELSE repeat('é', (s_suppkey % 50 + 20)::INTEGER) END AS cut FROM supplier
""")
def cut_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 61 bytes of a member as text: without, and with, what is left of a character."""
    m = archives.zip_members(_books(spark, sf_dir), "key", "content").filter("member = 'OEBPS/text/long.txt'")
    return m.select("key", archives.truncated_utf8(F.col("data"), 61).alias("whole"), archives.truncated_utf8(F.col("data"), 61, whole=False).alias("cut"))


@query("""
SELECT s_suppkey::VARCHAR AS key, 'OEBPS/book.opf' AS full_path FROM supplier
""")
def book_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The package document that each book's container names first."""
    return archives.container_path(archives.xml_events(_book_texts(spark, sf_dir).filter("member = 'META-INF/container.xml'"), "key", "xml"), "key")


@query("""
SELECT s_suppkey::VARCHAR AS key, p.place::INTEGER AS place, p.idref AS idref, p.href AS href FROM (SELECT s_suppkey, unnest([{'place': 0, 'idref': 'c2', 'href': CASE WHEN s_suppkey % 2 = 0 THEN 'two.xhtml' ELSE '' END}, {'place': 1, 'idref': 'c1', 'href': 'OEBPS/text/' || s_suppkey || '.xhtml'}]) AS p FROM supplier)
""")
def book_spines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reading order of each book: the last entry of equal ids, resolved against the
    document's folder; empty where the manifest lacks an entry."""
    s = archives.spine(archives.xml_events(_book_texts(spark, sf_dir).filter("member = 'OEBPS/book.opf'"), "key", "xml"), "key")
    return s.select("key", "place", "idref", F.when(F.col("href") == "", "").otherwise(tx.resolved(F.lit("OEBPS"), F.col("href"))).alias("href"))


@query("""
SELECT s_suppkey::VARCHAR AS key, 'One ' || s_suppkey AS title, 'OEBPS/text/' || s_suppkey || '.xhtml' AS href FROM supplier
""")
def book_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of contents of each book; entries without a link are left out."""
    c = archives.contents(archives.xml_events(_book_texts(spark, sf_dir).filter("member = 'OEBPS/toc.ncx'"), "key", "xml"), "key", "OEBPS")
    return c.select("key", "title", "href")


def _images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A flash image for each supplier: a partition table at its place, then, in the factory
    or update partition, an application's header with its version."""
    k = F.col("s_suppkey")
    byte = lambda c, n: F.unhex(F.lpad(F.hex(c), 2 * n, "0"))
    le = lambda c, n: F.concat(*[byte(F.call_function("shiftright", c.cast("long"), F.lit(8 * i)).bitwiseAND(F.lit(255)), 1) for i in range(n)])
    zeros = lambda n: F.unhex(F.repeat(F.lit("00"), n if isinstance(n, Column) else F.lit(n)))
    name = lambda t: F.concat(_text(F.lit(t)), zeros(16 - len(t)))
    record = lambda kind, sub, at, size, t: F.concat(le(F.lit(archives.MARK), 2), le(F.lit(kind), 1), le(sub, 1), le(at, 4), le(size, 4), name(t), le(F.lit(0), 4))
    at = archives.TABLE_AT + 4096
    records = F.concat(record(1, F.lit(2), F.lit(0x9000), F.lit(0x4000), "nvs"), record(0, F.when(k % 2 == 0, 0).otherwise(0x10), F.lit(at), k * 16, "app"), F.unhex(F.repeat(F.lit("FF"), F.lit(32))))
    header = F.concat(byte(F.when(k % 5 == 0, 0x11).otherwise(archives.IMAGE_MARK), 1), zeros(11), le(F.when(k % 7 == 0, 9).otherwise(archives.CHIP), 2), zeros(10 + archives.SEGMENT_BYTES + archives.VERSION_AT))
    version = F.concat(_text(F.concat(F.lit("1."), k.cast("string"))), zeros(300))
    image = F.concat(zeros(archives.TABLE_AT), records, zeros(4096 - 96), header, version)
    return dealt(table(spark, sf_dir, "supplier").select("s_suppkey"), "s_suppkey", 1000).select(k.alias("key"), image.alias("content"))


@query("""
SELECT s_suppkey AS key, r.idx::INTEGER AS idx, r.t::INTEGER AS type, r.sub::INTEGER AS subtype, r.at::BIGINT AS at, r.size::BIGINT AS size, r.name AS name FROM (SELECT s_suppkey, unnest([{'idx': 0, 't': 1, 'sub': 2, 'at': 36864, 'size': 16384, 'name': 'nvs'},
  {'idx': 1, 't': 0, 'sub': CASE WHEN s_suppkey % 2 = 0 THEN 0 ELSE 16 END, 'at': 36864, 'size': s_suppkey * 16, 'name': 'app'}]) AS r FROM supplier)
""")
def flash_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The partition records of flash images, up to the first without the mark."""
    p = archives.partitions(_images(spark, sf_dir), "key", "content")
    return p.select(F.col("key").cast("long").alias("key"), "idx", "type", "subtype", F.col("offset").alias("at"), "size", "name")


@query("""
SELECT s_suppkey AS key, 36864::BIGINT AS at, (s_suppkey * 16)::BIGINT AS size, CASE WHEN s_suppkey % 5 <> 0 AND s_suppkey % 7 <> 0 THEN '1.' || s_suppkey END AS version,
  CASE WHEN s_suppkey % 5 = 0 THEN 'not an image' WHEN s_suppkey % 7 = 0 THEN 'made for chip 9' END AS error FROM supplier
""")
def flash_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The application's partition of each flash image, and its version or what is wrong."""
    placed = _images(spark, sf_dir).withColumn("app", archives.app_place(F.col("content"))).filter("app is not null")
    # only the header's bytes go on; no image is longer than an int
    start = F.least(F.col("app.offset"), F.lit((1 << 31) - 2)).cast("int") + 1
    heads = placed.select("key", F.col("app.offset").alias("at"), "app.size", F.substring(F.col("content"), start, F.lit(archives.HEADER_BYTES + archives.SEGMENT_BYTES + archives.DESCRIPTION_BYTES)).alias("head"))
    return archives.image_headers(heads, "key", "head", keep=["at", "size"])


@query("""
SELECT n_nationkey AS n, 'scan-' || n_nationkey AS name, CASE WHEN n_nationkey % 2 = 0 THEN 100 + n_nationkey ELSE 500 END::INTEGER AS delay, n_nationkey % 3 = 0 AS loop FROM nation
""")
def sprite_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A configuration of three columns over its defaults; malformed rows are passed over."""
    n = F.col("n_nationkey")
    base = table(spark, sf_dir, "nation").select(n.alias("n"), F.concat(F.lit("scan-"), n.cast("string")).alias("name"), F.lit(500).alias("delay"), (n % 3 == 0).alias("loop"))
    line = F.when(n % 2 == 0, F.concat(F.lit("scan-"), n.cast("string"), F.lit(", "), (n + 100).cast("string"))).otherwise(F.lit("malformed"))
    parts = F.split(line, r",\s*")
    own = table(spark, sf_dir, "nation").select(parts[0].alias("name"), F.try_element_at(parts, F.lit(2)).try_cast("int").alias("delay"), F.lit(None).cast("boolean").alias("loop")).filter("delay is not null")
    return base.select("n", "name").join(lines.with_defaults(own, base.drop("n"), "name", ["delay", "loop"]), "name").select("n", "name", "delay", "loop")


@query("""
SELECT o_orderkey, string_agg(CASE WHEN l_returnflag = 'R' THEN '+' ELSE '-' END || ' item ' || n, chr(10) ORDER BY n) AS file FROM (SELECT l_orderkey AS o_orderkey, l_returnflag, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) - 1 AS n FROM lineitem) GROUP BY 1
""")
def todo_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of each todo file in their order."""
    from ..operators.ordered import reindexed

    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey", "l_quantity", (F.col("l_returnflag") == "R").alias("done"))
    items = reindexed(li, ["o_orderkey"], ["l_linenumber", "l_partkey", "l_quantity"]).withColumn("text", F.concat(F.lit("item "), F.col("idx").cast("string")))
    rows = files.todo_rows(items, "o_orderkey")
    return rows.groupBy("o_orderkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", "value"))), lambda x: x["value"]), "\n").alias("file"))
