"""WARC archives: one gzip member per record, written and read back as Spark jobs.

``write_warc`` lets each task append its rows to archives in the shared folder,
rolled at a size; the table it returns lists only the files of tasks that
succeeded, so what a lost or repeated attempt left behind is never read.
``read_warc`` reads each archive in sequence: a decompressor per gzip member is
fed in blocks, the header's content length frames the block, and block and
payload digests are verified (a mismatch raises).

Equal payloads of at least ``min_bytes`` bytes are stored once: the record with
the smallest id is the response, the others are revisits that refer to it.

Defined results: a null payload is empty; a null id is kept as null and never
referred to unless all ids of its payload are null, in which case each is a
response; rows that repeat the smallest id are all responses; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fusemill.llm.common import fresh_dir, parts, ship, table, written

#: Bytes after which a task begins its next archive.
ROLL = 64 << 20
BLOCK = 256 << 10
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
RECORD = "record_id long, record_type string, refers_to long, url string, payload_bytes long, payload_digest string"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _urn(record_id: int | None, at: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'record {record_id}' if record_id is not None else at)}>"


def _plain(value: str | None) -> str:
    """A header value on one line."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value or "")


def record(record_id: int | None, url: str | None, payload: bytes, refers_to: int | None, at: str = "") -> bytes:
    """A record before compression; a revisit holds the HTTP header alone."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": _urn(record_id, at),
        "WARC-Date": "1970-01-01T00:00:00Z",
        "WARC-Target-URI": _plain(url),
        "WARC-Payload-Digest": f"sha1:{base32_sha1(payload)}",
        "WARC-Block-Digest": f"sha1:{base32_sha1(block)}",
        "Content-Type": "application/http; msgtype=response",
        "X-Record-Key": "" if record_id is None else record_id,
        "Content-Length": len(block),
    }
    if revisit:
        head |= {
            "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            "WARC-Refers-To": _urn(refers_to, ""),
            "X-Refers-To-Key": refers_to,
        }
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    return f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


def _member(data: bytes, level: int) -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def write_warc(rows: DataFrame, folder: str, level: int = 1, roll: int = ROLL) -> DataFrame:
    """Writes rows (record_id, url, payload binary, refers_to) under folder; a row for each finished archive: path, records, bytes."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        out, path, made, size = None, "", [], 0
        for batch in batches:
            for i, (key, url, payload, refers) in enumerate(zip(*(batch[c].to_pylist() for c in ("record_id", "url", "payload", "refers_to")))):
                if out is None:
                    store.create_dir(root, recursive=True)
                    name, n, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    path = f"{folder}/{name}"
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                data = _member(record(key, url, payload or b"", refers, f"{path} {n}"), level)
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= roll:
                    out.close()
                    made.append((path, n, size))
                    out = None
        if out is not None:
            out.close()
            made.append((path, n, size))
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*made)], ["path", "records", "bytes"])

    ship(rows.sparkSession)
    return written(rows.select("record_id", "url", "payload", "refers_to").mapInArrow(write, "path string, records long, bytes long"), "warc-files")


def members(stream, block: int = BLOCK) -> Iterator[bytes]:
    """The decompressed gzip members of a stream, one after the other."""
    d, got = zlib.decompressobj(31), []
    data = stream.read(block)
    while data:
        got.append(d.decompress(data))
        data = d.unused_data
        if d.eof:
            yield b"".join(got)
            d, got = zlib.decompressobj(31), []
        data = data or stream.read(block)
    if got and any(got):
        raise ValueError("the archive ends within a member")


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block of a record, framed by its content length."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"no WARC record: {first[:40]!r}")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
    n = int(fields["content-length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError(f"record {fields.get('warc-record-id')} isn't framed by its content length")
    return fields, rest[:n]


def read_warc(files: DataFrame, with_payload: bool = False, block: int = BLOCK) -> DataFrame:
    """The records of the archives that files lists by path; payload_bytes and payload_digest are of the full payload."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RECORD.split(", ")] + ["payload"] * with_payload
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()] + [pa.binary()] * with_payload
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names)
        for batch in batches:
            for path in batch["path"].to_pylist():
                store, at = fs.FileSystem.from_uri(path)
                rows, held = [], 0
                with store.open_input_stream(at, compression=None) as stream:
                    for data in members(stream, block):
                        fields, body = parse(data)
                        http, _, payload = body.partition(b"\r\n\r\n")
                        if "sha1:" + base32_sha1(body) != fields["warc-block-digest"]:
                            raise ValueError(f"block digest of {fields['warc-record-id']} in {path}")
                        size = next(int(x.partition(b": ")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length: "))
                        digest = fields["warc-payload-digest"].removeprefix("sha1:")
                        if fields["warc-type"] == "response" and (len(payload) != size or base32_sha1(payload) != digest):
                            raise ValueError(f"payload of {fields['warc-record-id']} in {path}")
                        number = lambda k: int(fields[k]) if fields.get(k) else None
                        rows.append((number("x-record-key"), fields["warc-type"], number("x-refers-to-key"), fields["warc-target-uri"], size, digest) + (payload,) * with_payload)
                        held += len(payload)
                        if len(rows) >= 2000 or held >= 8 << 20:
                            yield pack(rows)
                            rows, held = [], 0
                if rows:
                    yield pack(rows)

    ship(files.sparkSession)
    spread = files.select("path").repartition(parts(files.sparkSession), "path")
    return spread.mapInArrow(read, RECORD + ", payload binary" * with_payload)


def revisits(pages: DataFrame, id_col: str, payload_col: str, min_bytes: int = 0) -> DataFrame:
    """pages with payload (binary) and refers_to: the smallest id of the equal payload, null for a response. Columns of these names are replaced.

    The least ids are a table of their own, so that the join with a payload of very many pages may be split.
    """
    pages = pages.drop(*({"payload", "refers_to"} - {id_col, payload_col}))
    full = pages.withColumn("payload", F.encode(F.coalesce(F.col(payload_col), F.lit("")), "utf-8")).withColumn("__sha", F.sha1("payload"))
    first = written(full.where(F.length("payload") >= min_bytes).groupBy("__sha").agg(F.min(id_col).alias("__first")), "warc-first")
    joined = full.join(first.hint("merge"), "__sha", "left")
    other = F.col(id_col).isNull() & F.col("__first").isNotNull() | (F.col(id_col) != F.col("__first"))
    return joined.withColumn("refers_to", F.when((F.length("payload") >= min_bytes) & other, F.col("__first"))).drop("__sha", "__first")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    rows = revisits(pages, "page_id", "html").withColumnRenamed("page_id", "record_id")
    files = write_warc(rows, fresh_dir(spark, "warc"))
    return read_warc(files).select(F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
with p as (select page_id, encode(coalesce(html, '')) as data from pages), d as (select *, sha1(data) as h, min(page_id) over (partition by data) as first from p)
select page_id, octet_length(data)::bigint as payload_bytes,
  list_aggregate(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((cast('0x' || substr(h, (k // 4) * 5 + 1, 5) as integer) >> (15 - 5 * (k % 4))::integer) & 31) + 1, 1)), 'string_agg', '') as payload_digest,
  case when page_id = first then 'response' else 'revisit' end as record_type, case when page_id <> first then first end as refers_to
from d
"""
