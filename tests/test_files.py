"""Sources and sinks over real files."""

import io
import struct
import tarfile
import zipfile

from pyspark.sql import functions as F

from loomwork.sinks import files
from loomwork.sources import archives, lines
from loomwork.streaming import fold, machines


def test_properties_and_index(spark, tmp_path):
    (tmp_path / "manifest.properties").write_text("# c\n\n a = 1 \r\na=2\nb=x=y\nnothing\napp.id=me\napp.version.code=seven\ntarget.platforms=p1, p2,,\n")
    rows = lines.properties(lines.read_lines(spark, str(tmp_path)), ["file"])
    m = lines.property_map(rows, ["file"])
    got = m.first().properties
    assert (got["a"], got["b"], "nothing" in got) == ("2", "x=y", False)
    assert m.select(lines.missing_keys(F.col("properties")).alias("m")).first().m == ["manifest.version", "target.sdk", "app.version.name", "app.name"]
    rec = files.app_records(m)
    r = rec.first()
    assert (r.appId, r.appVersionCode, r.targetPlatforms, r.file) == ("me", 0, ["p1", "p2"], "me-0.app")
    files.write_index(rec, str(tmp_path / "out"), "1", "2020-01-01T00:00:00Z", "c")
    assert '"appId":"me"' in spark.read.text(str(tmp_path / "out")).first().value


def test_book(spark, tmp_path):
    opf = '<?xml version="1.0"?><package><manifest><item id="a" href="1.html"/><item id="a" href="2.html"/><item id="b" href="3.html"/></manifest><spine><itemref idref="b"/><itemref idref="a"/><itemref idref="z"/></spine></package>'
    with zipfile.ZipFile(tmp_path / "Book.EPUB", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="OEBPS/p.opf"/><rootfile full-path="x"/></rootfiles></container>')
        z.writestr("OEBPS/p.opf", opf)
        z.writestr("../evil", "x")
    (tmp_path / "broken.epub").write_bytes(b"no archive")
    (tmp_path / ".hidden.epub").write_bytes(b"")
    shelf = {r.name for r in archives.books(spark, str(tmp_path)).collect()}
    assert shelf == {"Book.EPUB", "broken.epub"}
    m = archives.zip_members(archives.read_files(spark, str(tmp_path), r"\.epub$"))
    assert m.count() == 3
    assert {r.member for r in archives.safe_members(m).collect()} == {"META-INF/container.xml", "OEBPS/p.opf"}
    docs = m.select("path", "member", archives.truncated_utf8(F.col("data"), 1 << 20).alias("xml"))
    c = archives.container_path(archives.xml_events(docs.filter("member like '%container.xml'"), "path", "xml"), "path")
    assert c.first().full_path == "OEBPS/p.opf"
    s = archives.spine(archives.xml_events(docs.filter("member like '%.opf'"), "path", "xml"), "path")
    assert [(r.place, r.idref, r.href) for r in s.orderBy("place").collect()] == [(0, "b", "3.html"), (1, "a", "2.html"), (2, "z", "")]


def test_packages_and_images(spark, tmp_path):
    def tar(name, mode, members):
        with tarfile.open(tmp_path / name, mode) as t:
            for n, data in members:
                i = tarfile.TarInfo(n)
                i.size = len(data)
                t.addfile(i, io.BytesIO(data))

    tar("a.app", "w", [("x", b"1"), ("d/manifest.properties", b"k=1"), ("manifest.properties", b"k=2")])
    tar("b.app", "w:gz", [("manifest.properties", b"k=3")])
    tar("c.app", "w", [("x", b"1")])
    (tmp_path / "d.app").write_bytes(b"damaged")
    got = {r.path[-5:]: r.manifest for r in archives.tar_manifests(archives.read_files(spark, str(tmp_path), r"\.app$")).collect()}
    assert got == {"a.app": "k=1", "b.app": "k=3", "c.app": None, "d.app": None}
    rec = lambda t, s, o, n: struct.pack("<HBBII16sI", 0x50AA, t, s, o, 100, n, 0)
    table = rec(1, 2, 0x9000, b"nvs") + rec(0, 0x10, 0x10000, b"ota_0") + rec(0, 0, 0x20000, b"factory") + b"\xff" * 32 + rec(0, 0, 1, b"beyond")
    (tmp_path / "fw.bin").write_bytes(b"\0" * 0x8000 + table)
    p = archives.partitions(archives.read_files(spark, str(tmp_path), r"\.bin$"))
    assert [r.name for r in p.orderBy("idx").collect()] == ["nvs", "ota_0", "factory"]
    assert archives.app_partition(p).first().offset == 0x20000


def test_cut_texts(spark):
    d = spark.createDataFrame([(bytearray("aé".encode()),), (None,)], "b binary")
    assert [r[0] for r in d.select(archives.truncated_utf8(F.col("b"), 2)).collect()] == ["a", None]
    assert [r[0] for r in d.select(archives.truncated_utf8(F.col("b"), 2, whole=False)).collect()] == ["a�", None]


def test_todos_upsert_defaults(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0, True, "x"), (1, 1, False, "y z"), (2, 0, False, "q")], "list int, idx int, done boolean, text string")
    files.write_todos(rows, str(tmp_path / "todo"), "list")
    back = lines.read_lines(spark, str(tmp_path / "todo" / "list=1"))
    assert [(r.idx, r.done, r.text) for r in lines.todo_lines(back, ["file"]).orderBy("idx").collect()] == [(0, True, "x"), (1, False, "y z")]
    kv = lambda v, n: spark.createDataFrame([("k", v, n)], "k string, v string, n int")
    files.upsert(spark, str(tmp_path / "kv"), kv("a", 1), ["k"], "n")
    got = files.upsert(spark, str(tmp_path / "kv"), kv("b", 2), ["k"], "n")
    assert [tuple(r) for r in got.select("k", "v").collect()] == [("k", "b")]
    base = spark.createDataFrame([("idle", 500, True), ("walk", 200, True)], "name string, delay int, loop boolean")
    own = spark.createDataFrame([("walk", 100, None)], "name string, delay int, loop boolean")
    assert {tuple(r) for r in lines.with_defaults(own, base, "name", ["delay", "loop"]).collect()} == {("idle", 500, True), ("walk", 100, True)}


def test_fold_over_a_stream(spark, tmp_path):
    step = machines.cooldown(3000)
    src = tmp_path / "in"
    spark.createDataFrame([(1, 0), (1, 2000), (2, 50)], "key long, at long").coalesce(1).write.parquet(str(src))
    stream = spark.readStream.schema("key long, at long").option("maxFilesPerTrigger", 1).parquet(str(src))
    out = fold.fold_stream(stream, ["key"], ["at"], step, "key long, at long")

    def run():
        q = out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
        q.awaitTermination(120)

    run()
    spark.createDataFrame([(1, 2999), (1, 3000), (2, 60)], "key long, at long").coalesce(1).write.mode("append").parquet(str(src))
    run()
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {(1, 0), (2, 50), (1, 3000)}


def test_contents(spark):
    ncx = (
        "<ncx><navMap><navPoint><navLabel><text>One</text></navLabel><content src='a.html#x'/></navPoint>"
        "<navPoint><navLabel><text>Outer</text></navLabel><content src='b.html'/><navPoint><navLabel><text>Inner</text></navLabel><content src='../c.html'/></navPoint></navPoint>"
        "<navPoint><navLabel><text>No link</text></navLabel></navPoint></navMap></ncx>"
    )
    df = spark.createDataFrame([(1, ncx), (2, None), (3, "")], "id int, x string")
    got = archives.contents(archives.xml_events(df, "id", "x"), "id", "OEBPS").orderBy("seq").collect()
    assert [(r.title, r.href) for r in got] == [("One", "OEBPS/a.html"), ("Inner", "c.html"), ("Inner", "c.html")]


def test_image_headers(spark):
    def image(chip=13, mark=0xE9, size=400):
        b = bytearray(400)
        b[0], b[12], b[13] = mark, chip & 255, chip >> 8
        b[48:53] = b"1.2.3"
        return bytes(b[:size])

    rows = [(1, image()), (2, image(chip=261)), (3, image(mark=1)), (4, image(size=10)), (5, image(size=28)), (6, image(size=100)), (7, None)]
    df = spark.createDataFrame(rows, "path int, content binary")
    got = {r.path: (r.version, r.error) for r in archives.image_headers(df).collect()}
    assert got == {1: ("1.2.3", None), 2: (None, "made for chip 261"), 3: (None, "not an image"), 4: (None, "no header"), 5: (None, "no segment"), 6: ("unknown", None), 7: (None, "no header")}


def test_app_place_equals_its_partition(spark):
    rec = lambda t, s, o, mark=0x50AA: struct.pack("<HBBII16sI", mark, t, s, o, o + 1, b"x", 0)
    tables = [
        rec(1, 2, 5) + rec(0, 0x10, 7) + rec(0, 0, 0xFFFFFFF0), rec(0, 0x11, 9) + rec(0, 0x10, 8) + rec(0, 0x10, 6), rec(0, 0x12, 4) + rec(0, 0x11, 3), rec(1, 0, 1), b"", rec(0, 0, 2, 1) + rec(0, 0, 3),
        rec(0, 0x20, 1)[:31], rec(0, 0x20, 1) + rec(0, 0, 2)[:20], rec(1, 1, 1) * 127 + rec(0, 0, 77) * 2, rec(1, 1, 1) * 128 + rec(0, 0, 78),
    ]
    images = [(i, b"\0" * 0x8000 + t) for i, t in enumerate(tables)] + [(98, b"short"), (99, None)]
    df = spark.createDataFrame(images, "path int, content binary")
    got = {str(r.path): (r.p.offset, r.p.size) for r in df.select("path", archives.app_place(F.col("content")).alias("p")).collect() if r.p}
    want = {r.path: (r.offset, r.size) for r in archives.app_partition(archives.partitions(df)).collect()}
    assert got == want and got["0"] == (0xFFFFFFF0, 0xFFFFFFF1) and got["1"] == (8, 9) and got["8"] == (77, 78) and len(got) == 5
