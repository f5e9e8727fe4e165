"""Archives made of rows: one binary value for each row with its members.

An archive's members are one row, as its readers want one file; many archives are many
rows, dealt among tasks like any others."""

from __future__ import annotations

import io
import tarfile
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Bytes of archives that are handed on at once.
BATCH_BYTES = 4 << 20


def _made(rows: DataFrame, build) -> DataFrame:
    schema = pa.schema([("key", pa.string()), ("content", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[tuple[str, bytes]] = []
        size = 0
        batch = lambda: pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], f.type) for i, f in enumerate(schema)], schema=schema)
        for b in batches:
            for row in b.to_pylist():
                made.append((row["key"], build(row)))
                size += len(made[-1][1])
                if size >= BATCH_BYTES:
                    yield batch()
                    made, size = [], 0
        if made:
            yield batch()

    return rows.mapInArrow(run, "key string, content binary")


def tar_files(rows: DataFrame) -> DataFrame:
    """key, content (a USTAR archive) of rows with key and members (name, data), in their
    order; owners and times are zero, so equal members make equal archives."""

    def build(row: dict) -> bytes:
        out = io.BytesIO()
        with tarfile.open(fileobj=out, mode="w", format=tarfile.USTAR_FORMAT) as t:
            for m in row["members"]:
                info = tarfile.TarInfo(m["name"])
                info.size = len(m["data"])
                t.addfile(info, io.BytesIO(m["data"]))
        return out.getvalue()

    return _made(rows, build)


def zip_files(rows: DataFrame) -> DataFrame:
    """key, content (a zip archive) of rows with key, members (name, data) and stored: whether
    members are stored as they are or deflated."""

    def build(row: dict) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED if row["stored"] else zipfile.ZIP_DEFLATED) as z:
            for m in row["members"]:
                z.writestr(zipfile.ZipInfo(m["name"]), bytes(m["data"]), compress_type=z.compression)
        return out.getvalue()

    return _made(rows, build)
