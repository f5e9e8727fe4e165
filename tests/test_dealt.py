"""Queries whose small tables are one block of one file: their work is dealt among tasks."""

import io
import tarfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomwork.operators.dealt import dealt
from loomwork.plans import archive_queries, parsing_queries, raster_queries
from loomwork.sinks import packages
from loomwork.sources import archives


@pytest.fixture(scope="module")
def one_block(spark, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("one_block"))
    n = F.col("id")
    for name, row in {
        "part": [n.alias("p_partkey"), F.lit("Brand#1").alias("p_brand"), F.lit("a part").alias("p_name"), (n % 50 + 1).cast("int").alias("p_size"), F.lit("TIN").alias("p_type")],
        "customer": [n.alias("c_custkey"), F.lit("Customer").alias("c_name")],
        "lineitem": [n.alias("l_orderkey"), F.lit(1).alias("l_linenumber"), n.alias("l_partkey"), n.alias("l_suppkey")],
        "supplier": [n.alias("s_suppkey"), F.concat(F.lit("Supplier#"), n.cast("string")).alias("s_name")],
    }.items():
        spark.range(1, 5001).select(*row).coalesce(1).write.parquet(f"{where}/{name}.parquet")
    return where


def test_rows_are_dealt_by_their_number(spark):
    rows = spark.range(0, 100, numPartitions=1)
    parts = dealt(rows, "id", 10)
    assert parts.rdd.getNumPartitions() == 10 and parts.count() == 100
    assert dealt(rows.filter("id < 0"), "id", 10).count() == 0
    # groups by the key are not shuffled again
    assert parts.groupBy("id").count()._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_package_manifests_in_many_tasks(spark, one_block):
    assert archive_queries._packages(spark, one_block).rdd.getNumPartitions() > 1


class Taken:
    """Takes the function that would run in tasks."""

    def select(self, *_):
        return self

    def mapInArrow(self, run, _):
        self.run = run
        return self

    mapInPandas = mapInArrow
    withColumnRenamed = select


def test_package_members_in_few_batches():
    """Archives leave a task in batches of some megabytes, not one by one."""
    rows = pa.RecordBatch.from_pylist([{"key": str(i), "members": [{"name": "a", "data": b"x" * 5}]} for i in range(1000)])
    made = list(packages.tar_files(Taken()).run(iter([rows])))
    assert len(made) == 3 and sum(b.num_rows for b in made) == 1000


def test_book_members_in_few_batches(spark):
    """Members of many small archives are one batch; large ones are handed on in between."""
    rows = pa.RecordBatch.from_pylist([{"key": str(i), "members": [{"name": "a", "data": b"x"}, {"name": "b", "data": b"0" * (3 << 20 if i < 2 else 1)}], "stored": False} for i in range(20)])
    books = pa.Table.from_batches(packages.zip_files(Taken()).run(iter([rows]))).to_pandas()
    found = list(archives.zip_members(Taken(), "key", "content").run(iter([books])))
    assert [len(b) for b in found] == [4, 36]


def test_plain_and_packed_tars(spark):
    def tar(mode, name="BZh/manifest.properties"):
        out = io.BytesIO()
        with tarfile.open(fileobj=out, mode=mode) as t:
            info = tarfile.TarInfo(name)
            info.size = 3
            t.addfile(info, io.BytesIO(b"k=1"))
        return out.getvalue()

    rows = [(i, c) for i, c in enumerate([tar("w"), tar("w:gz"), tar("w:bz2"), tar("w:xz"), tar("w")[:300], tar("w", "x/manifest.properties"), b"", None])]
    got = {r.path: r.manifest for r in archives.tar_manifests(spark.createDataFrame(rows, "path int, content binary")).collect()}
    assert [got[str(i)] for i in range(8)] == ["k=1"] * 4 + [None, "k=1", None, None]


def test_books_in_many_tasks(spark, one_block):
    assert archive_queries._books(spark, one_block).rdd.getNumPartitions() == 5


def test_flash_images_go_nowhere(spark, one_block):
    """Images are neither joined nor sent: only suppliers' keys are."""
    plan = archive_queries.flash_versions(spark, one_block)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Exchange hash" in line]


def test_text_rows_are_grouped_where_they_are_dealt(spark, one_block):
    found = exchanges(raster_queries.text_rows(spark, one_block))
    assert len(found) == 1 and "c_custkey" in found[0]


def test_property_lines_are_grouped_where_they_are_dealt(spark, one_block):
    assert len(exchanges(parsing_queries.property_lines(spark, one_block))) == 1
    found = exchanges(parsing_queries.app_index(spark, one_block))
    assert len(found) == 1 and ", 3)" in found[0]


def test_sheets_are_shuffled_once(spark, one_block):
    assert len(exchanges(raster_queries.sprite_sheets(spark, one_block))) == 1
