"""Media columns: payloads stored as grey images in archives, read by a Spark data source.

``write_archives`` encodes each payload as a PNG of 8-bit samples, 64 to a row,
and stores the images in zip archives in the shared folder; the manifest it
returns lists the archives of successful tasks only. The data source
``media_archive`` plans byte ranges over the listed archives. A range owns the
members whose header begins in it: its task reads the archive's directory,
fetches neighbouring members in blocks, checks each against the directory's
CRC, and reads a member that fails again by its own offset, a few times, before
it gives up; members are streamed as Arrow batches.

Defined results: a null text is empty and its payload 64 zero bytes; equal
texts give equal values; repeated rows and null ids give a row each; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from fusemill.llm.common import fresh_dir, ship, table

WIDTH = 64
ROLL = 64 << 20
SPLIT = 16 << 20
BLOCK = 4 << 20
RETRIES = 4
_MAGIC = b"\x89PNG\r\n\x1a\n"
#: A private, ancillary chunk that holds the number of bytes before padding.
_LENGTH = b"nbYt"
DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def padded(data: bytes) -> bytes:
    """data and zero bytes up to a positive multiple of 64."""
    return data.ljust(max(1, -(-len(data) // WIDTH)) * WIDTH, b"\0")


def to_png(data: bytes, level: int = 1) -> bytes:
    grey = np.frombuffer(padded(data), np.uint8).reshape(-1, WIDTH)
    rows = np.zeros((len(grey), WIDTH + 1), np.uint8)
    rows[:, 1:] = grey
    header = struct.pack(">IIBBBBB", WIDTH, len(grey), 8, 0, 0, 0, 0)
    return _MAGIC + _chunk(b"IHDR", header) + _chunk(_LENGTH, struct.pack(">Q", len(data))) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + _chunk(b"IEND", b"")


def from_png(media: bytes) -> tuple[int, np.ndarray]:
    """Bytes before padding, and the samples by row."""
    if not media.startswith(_MAGIC):
        raise ValueError("no PNG")
    at, found = len(_MAGIC), {}
    while at < len(media):
        (size,) = struct.unpack_from(">I", media, at)
        kind, data = media[at + 4 : at + 8], media[at + 8 : at + 8 + size]
        if struct.unpack_from(">I", media, at + 8 + size)[0] != zlib.crc32(kind + data):
            raise ValueError(f"CRC of chunk {kind!r}")
        found[kind] = found.get(kind, b"") + data
        at += size + 12
    rows = np.frombuffer(zlib.decompress(found[b"IDAT"]), np.uint8).reshape(-1, WIDTH + 1)
    if rows[:, 0].any():
        raise ValueError("only unfiltered rows are written here")
    return struct.unpack(">Q", found[_LENGTH])[0], rows[:, 1:]


def write_archives(rows: DataFrame, folder: str, level: int = 1, roll: int = ROLL) -> str:
    """Writes rows (key long, payload binary) as archives under folder; returns the manifest's path."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        made, zipped, out = [], None, None

        def close() -> None:
            zipped.close()
            size = out.tell()
            out.close()
            made.append((f"{folder}/{name}", size))

        for batch in batches:
            for key, payload in zip(batch["key"].to_pylist(), batch["payload"].to_pylist()):
                if zipped is None:
                    store.create_dir(root, recursive=True)
                    name = f"{uuid.uuid4().hex}.zip"
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                    zipped, n = zipfile.ZipFile(out, "w"), 0
                zipped.writestr(zipfile.ZipInfo(f"{n}.{'' if key is None else key}.png"), to_png(payload or b"", level))
                n += 1
                if out.tell() >= roll:
                    close()
                    zipped = None
        if zipped is not None:
            close()
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*made)], ["path", "bytes"])

    ship(rows.sparkSession)
    manifest = f"{folder}-files"
    rows.select("key", "payload").mapInArrow(write, "path string, bytes long").write.parquet(manifest)
    return manifest


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.manifest = options["path"]
        self.split = int(options.get("split", SPLIT))
        self.block = int(options.get("block", BLOCK))
        self.retries = int(options.get("retries", RETRIES))

    def partitions(self) -> list[Range]:
        store, root = fs.FileSystem.from_uri(self.manifest)
        files = pq.read_table(root, filesystem=store).to_pylist()
        return [Range(x["path"], a, min(a + self.split, x["bytes"])) for x in files for a in range(0, x["bytes"], self.split)] or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        with opened(partition.path) as f:
            listed = zipfile.ZipFile(f).infolist()
            own = sorted((x for x in listed if partition.start <= x.header_offset < partition.end), key=lambda x: x.header_offset)
            k = 0
            while k < len(own):
                first, n = own[k].header_offset, k
                while n < len(own) and (n == k or own[n].header_offset + own[n].compress_size - first <= self.block):
                    n += 1
                last = own[n - 1]
                # the last member's local header may be longer than its entry says; 64 KB hold any name and extra field
                try:
                    block = read_at(f, first, last.header_offset - first + last.compress_size + 30 + (1 << 16))
                except OSError:
                    block = b""
                out = [self.member(partition.path, x, block[x.header_offset - first :]) for x in own[k:n]]
                keys = [x.filename.split(".")[1] for x in own[k:n]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(x) if x else None for x in keys], pa.int64()), pa.array([x.header_offset for x in own[k:n]], pa.int64()), pa.array(out, pa.binary())],
                    ["key", "offset", "media"],
                )
                k = n

    def member(self, path: str, entry: zipfile.ZipInfo, data: bytes) -> bytes:
        """The member's bytes out of the block, or read again by its own offset."""
        for attempt in range(self.retries + 1):
            try:
                if attempt:
                    time.sleep(0.05 * 2**attempt)
                    with opened(path) as f:
                        data = read_at(f, entry.header_offset, entry.compress_size + 30 + (1 << 16))
                name, extra = struct.unpack_from("<HH", data, 26)
                body = data[30 + name + extra : 30 + name + extra + entry.compress_size]
                if data[:4] == b"PK\x03\x04" and zlib.crc32(body) == entry.CRC:
                    return body
            except (OSError, struct.error):
                pass
        raise OSError(f"member at {entry.header_offset} of {path} could not be read in {self.retries + 1} attempts")


class MediaArchive(DataSource):
    """spark.read.format("media_archive").load(manifest): key, offset, media."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return "key long, offset long, media binary"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)


def opened(path: str):
    store, at = fs.FileSystem.from_uri(path)
    return store.open_input_file(at)


def read_at(f, offset: int, size: int) -> bytes:
    f.seek(offset)
    return f.read(size)


def feature(grey: np.ndarray) -> str:
    """Rows, mean, deviation, mean step between neighbours in a row, and an eight-bin histogram."""
    x = grey.astype(np.int32)
    n, total, square = x.size, int(x.sum()), int((x * x).sum(dtype=np.int64))
    step = int(np.abs(np.diff(x, axis=1)).sum())
    bins = np.bincount(grey.ravel() >> 5, minlength=8)
    mean = total / n
    return f"{len(grey)};{mean:.4f};{max(0.0, square / n - mean * mean) ** 0.5:.4f};{step / (n - len(grey)):.4f};" + ",".join(map(str, bins))


def digests(media: DataFrame) -> DataFrame:
    """The digest columns of what was read back."""
    ship(media.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(x.split()[0], pa.string() if x.endswith("string") else pa.int64()) for x in DIGEST.split(", ")])
        for batch in batches:
            rows = []
            for key, stored in zip(batch["key"].to_pylist(), batch["media"].to_pylist()):
                n, grey = from_png(stored)
                payload = grey.tobytes()
                rows.append((key, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(grey)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)

    return media.select("key", "media").mapInArrow(run, DIGEST)


def read_archives(spark: SparkSession, manifest: str, **options) -> DataFrame:
    ship(spark)
    spark.dataSource.register(MediaArchive)
    return spark.read.format("media_archive").options(**options).load(manifest)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(F.col("doc_id").cast("long").alias("key"), F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("payload"))
    return digests(read_archives(spark, write_archives(rows, fresh_dir(spark, "media"))))
