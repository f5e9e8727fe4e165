"""Media columns: payloads as 8-bit grey images in content-addressed tar shards.

A payload is a text's UTF-8 bytes, padded with zero bytes to a positive multiple of 64.
It is stored as a grey PNG, 64 samples wide (lossless, and its size in the header).
Tasks write tar shards; each image's member name is its digest, and equal texts are stored
once, however many rows have them. Rows carry shard, digest, offset and length. Metadata columns are filled by
reading only the 33 header bytes of an image; features by reading the samples back."""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, new_folder, small_side

WIDTH = 64
HEADER = 33
#: A task begins another shard when one has this many bytes.
SHARD_BYTES = 256_000_000
#: Digests of repeated texts that are broadcast at most (about 100 bytes each); more are
#: joined by a shuffle.
MAX_BROADCAST_DIGESTS = 200_000
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def payload_of(text: str | None) -> bytes:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes(-len(raw) % WIDTH if raw else WIDTH)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode(payload: bytes) -> bytes:
    """The payload as an 8-bit grey PNG."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)  # filter type 0 before each line
    lines[:, 1:] = rows
    return _SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + _chunk(b"IEND", b"")


def header(start: bytes) -> tuple[int, int, int]:
    """Width, height and bits of a sample, from the first 33 bytes."""
    if start[:8] != _SIGNATURE or start[12:16] != b"IHDR" or zlib.crc32(start[12:29]) != struct.unpack(">I", start[29:33])[0]:
        raise ValueError("not a PNG header")
    return struct.unpack(">IIB", start[16:25])


def decode(image: bytes) -> bytes:
    """The samples of an image that ``encode`` made."""
    width, height, _ = header(image[:HEADER])
    at, packed = HEADER, []
    while True:
        size, kind = struct.unpack(">I4s", image[at : at + 8])
        data = image[at + 8 : at + 8 + size]
        if zlib.crc32(kind + data) != struct.unpack(">I", image[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("damaged PNG")
        if kind == b"IDAT":
            packed.append(data)
        if kind == b"IEND":
            break
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, width + 1)
    return lines[:, 1:].tobytes()


def describe(samples: bytes) -> str:
    """Mean, deviation, zero share, entropy in bits, and a 64-bit average hash of 64
    equal stretches."""
    x = np.frombuffer(samples, np.uint8)
    p = np.bincount(x, minlength=256) / len(x)
    entropy = -(p[p > 0] * np.log2(p[p > 0])).sum() + 0.0
    means = x.reshape(64, -1).mean(axis=1)
    bits = int("".join("1" if m > means.mean() else "0" for m in means), 2)
    return f"mean={x.mean():.4f};sd={x.std():.4f};zero={p[0]:.4f};entropy={entropy:.4f};ahash={bits:016x}"


def _open(where: str) -> tuple[pafs.FileSystem, str]:
    fs, path = pafs.FileSystem.from_uri(where if "://" in where or where.startswith("file:") else "file://" + where)
    return fs, path


class ShardWriter:
    """Tar shards in a folder. A shard is written under a name of its own attempt; the
    rows name it, so shards of lost or repeated attempts are never referred to."""

    def __init__(self, folder: str):
        self.fs, self.folder = _open(folder)
        self.fs.create_dir(self.folder, recursive=True)
        self.out = None

    def add(self, digest: str, image: bytes) -> tuple[str, int]:
        if self.out is None or self.size > SHARD_BYTES:
            self.close()
            self.name = f"shard-{uuid.uuid4().hex}.tar"
            self.out, self.size, self.at = self.fs.open_output_stream(f"{self.folder}/{self.name}"), 0, {}
        if digest not in self.at:
            info = tarfile.TarInfo(f"{digest}.png")
            info.size = len(image)
            head = info.tobuf(tarfile.USTAR_FORMAT)
            self.at[digest] = self.size + len(head)
            block = head + image + bytes(-len(image) % tarfile.BLOCKSIZE)
            self.out.write(block)
            self.size += len(block)
        return self.name, self.at[digest]

    def close(self) -> None:
        if self.out is not None:
            self.out.write(bytes(2 * tarfile.BLOCKSIZE))
            self.out.close()
            self.out = None


class ShardReader:
    """Range reads, one open shard at a time."""

    def __init__(self, folder: str):
        self.fs, self.folder = _open(folder)
        self.name, self.file = None, None

    def read(self, shard: str, offset: int, length: int) -> bytes:
        if shard != self.name:
            self.close()
            self.name, self.file = shard, self.fs.open_input_file(f"{self.folder}/{shard}")
        self.file.seek(offset)
        return self.file.read(length)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
            self.name, self.file = None, None


def store(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the payloads of all rows to tar shards in ``folder`` (any address that
    pyarrow's file systems open, shared by all machines) and return the rows: id, n_bytes,
    shard, digest, offset, length.

    Null text is the empty payload of 64 zero bytes; very long texts are stored whole. Of
    rows with equal texts the one of least id stores them (rows with that id and text, too,
    once for each task), all others point there. Null ids stay null, repeated rows give
    repeated rows, other columns are ignored; an empty table gives an empty one. The rows are
    computed once, when this returns."""
    kind = dict(docs.dtypes)[id_col]

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        writer = ShardWriter(folder)
        for b in batches:
            out = []
            for i, text, key in zip(b["id"], b["text"], b["key"], strict=True):
                image = encode(payload_of(text))
                digest = hashlib.sha256(image).hexdigest()
                shard, offset = writer.add(digest, image)
                out.append((i, len((text or "").encode("utf-8", "surrogatepass")), key, shard, digest, offset, len(image)))
            yield pd.DataFrame(out, columns=["id", "n_bytes", "key", "shard", "digest", "offset", "length"])
        writer.close()

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("string").alias("id"), text.alias("text"), F.sha2(text, 256).alias("key"))
    # texts of several rows, and the id whose row stores them (null if all their ids are)
    again = checkpoint(rows.groupBy("key").agg(F.min("id").alias("owner"), F.count("*").alias("n")).filter("n > 1").select("key", "owner", F.lit(True).alias("shared")))
    n = again.count()
    owned = rows.join(small_side(again, n, MAX_BROADCAST_DIGESTS), "key", "left")
    writes = F.col("shared").isNull() | F.col("id").eqNullSafe(F.col("owner"))
    index = checkpoint(owned.filter(writes).select("id", "text", "key").mapInPandas(write, "id string, n_bytes long, key string, shard string, digest string, offset long, length long"))
    if n:
        place = index.join(small_side(again.select("key"), n, MAX_BROADCAST_DIGESTS), "key", "left_semi")
        place = checkpoint(place.groupBy("key").agg(F.min(F.struct("shard", "digest", "offset", "length", "n_bytes")).alias("p")))
        others = owned.filter(~writes).select("id", "key").join(small_side(place, n, MAX_BROADCAST_DIGESTS), "key")
        index = index.unionByName(others.select("id", "p.n_bytes", "key", "p.shard", "p.digest", "p.offset", "p.length"))
    return index.select(F.col("id").cast(kind).alias(id_col), "n_bytes", "shard", "digest", "offset", "length")


def with_metadata(index: DataFrame, folder: str) -> DataFrame:
    """``index`` with width, height, sample_bits and payload_bytes, read from the headers."""

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = ShardReader(folder)
        for b in batches:
            got = [header(reader.read(s, o, HEADER)) for s, o in zip(b["shard"], b["offset"], strict=True)]
            yield b.assign(width=[g[0] for g in got], height=[g[1] for g in got], sample_bits=[g[2] for g in got], payload_bytes=[g[0] * g[1] for g in got])
        reader.close()

    return index.mapInPandas(fill, ", ".join(f"`{n}` {t}" for n, t in index.dtypes) + ", width int, height int, sample_bits int, payload_bytes long")


def with_features(index: DataFrame, folder: str) -> DataFrame:
    """``index`` with payload_sha256, tail_crc32, media_sha256 and feature, of the stored
    bytes read back."""

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = ShardReader(folder)
        for b in batches:
            out = []
            for s, o, n in zip(b["shard"], b["offset"], b["length"], strict=True):
                image = reader.read(s, o, n)
                samples = decode(image)
                out.append((hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-WIDTH:]), hashlib.sha256(image).hexdigest(), describe(samples)))
            yield b.assign(**{k: [x[i] for x in out] for i, k in enumerate(("payload_sha256", "tail_crc32", "media_sha256", "feature"))})
        reader.close()

    return index.mapInPandas(fill, ", ".join(f"`{n}` {t}" for n, t in index.dtypes) + ", payload_sha256 string, tail_crc32 long, media_sha256 string, feature string")


def media_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """All of the above for every row of ``docs``; shards go to a new folder in the shared
    one unless ``folder`` is given."""
    folder = folder or new_folder(docs.sparkSession, "media")
    index = store(docs, folder, id_col, text_col)
    return with_features(with_metadata(index, folder), folder).withColumn("media_bytes", F.col("length"))
