"""Deterministic sharded WARC writer.

Records are sorted by host and URL.  Range bounds are picked by content (keys whose hash falls under a
bound that the exact count sets), never by a sample of partitions, so the same records give the same files, byte
for byte, however the input is split.  Each range is written by one task, which rolls to a new file
as soon as the compressed size passes ``max_bytes``.  Headers are made anew: record ids from the content, SHA-1 digests
of block and payload, lengths, and an HTTP header that fits the payload; each record is a gzip member of its own.

Commit: a file is written under a temporary name that holds the attempt and renamed when complete, so a lost
executor or a second attempt leaves no part; the manifest of all files is written last, in the same way, and a
reader takes only what it lists.

Defined results: a null html is an empty payload, a null URL the empty target; records that tie on the key are
ordered by id and content, nulls first, and repeated records are written again; very long pages are records like others (a
file holds at least one record); without records the manifest lists no file.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .common import materialise, shared_dir
from .reputation import parts

MAX_BYTES, RANGE_ROWS = 16 << 20, 4096
DATE = "1970-01-01T00:00:00Z"  # pages carry no time of capture
_SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:warc-record")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str, html: str, date: str = DATE) -> tuple[bytes, str]:
    """An uncompressed response record, and the digest of its payload."""
    body = html.encode("utf-8", "surrogatepass")
    target = url.replace("\r", "%0D").replace("\n", "%0A")
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body
    own = digest(body)
    name = uuid.uuid5(_SPACE, f"{page_id}\n{target}\n{own}")
    head = [
        "WARC/1.1",
        "WARC-Type: response",
        f"WARC-Record-ID: <urn:uuid:{name}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {target}",
        f"X-Page-ID: {'' if page_id is None else page_id}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: {own}",
        f"WARC-Block-Digest: {digest(block)}",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", own


def info(filename: str, date: str = DATE) -> bytes:
    body = b"software: loomgraph\r\nformat: WARC File Format 1.1\r\n"
    head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid5(_SPACE, filename)}>\r\nWARC-Date: {date}\r\nWARC-Filename: {filename}\r\nContent-Type: application/warc-fields\r\nWARC-Block-Digest: {digest(body)}\r\nContent-Length: {len(body)}\r\n\r\n"
    return head.encode() + body + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """One gzip member with no time or name in it."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    out = z.compress(data) + z.flush()
    return out[:4] + bytes(4) + out[8:]


def read(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of every record of a file."""
    while data:
        z = zlib.decompressobj(31)
        raw = z.decompress(data) + z.flush()
        data = z.unused_data
        head, _, rest = raw.partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
        yield fields, rest[: int(fields["Content-Length"])]


def move(system: fs.FileSystem, temporary: str, final: str) -> None:
    """Rename; over a file that an earlier attempt left, which has the same bytes, where the file system refuses that."""
    try:
        system.move(temporary, final)
    except OSError:
        if system.get_file_info(final).type != fs.FileType.File:
            raise
        system.delete_file(final)
        system.move(temporary, final)


class Writer:
    """Files of one range, rolled by compressed size."""

    def __init__(self, folder: str, range_: int, attempt: str, max_bytes: int):
        self.fs, self.base = fs.FileSystem.from_uri(folder)
        self.range, self.attempt, self.max = range_, attempt, max_bytes
        self.number, self.out, self.size = 0, None, 0

    def add(self, data: bytes) -> tuple[str, int, int]:
        """File, offset and length of the record."""
        if self.out is None:
            self.name = f"part-{self.range:06d}-{self.number:05d}.warc.gz"
            self.temporary = f"{self.base}/_temporary/{self.attempt}-{self.name}"
            self.fs.create_dir(f"{self.base}/_temporary")
            self.out = self.fs.open_output_stream(self.temporary, compression=None)
            head = member(info(self.name))
            self.out.write(head)
            self.size = len(head)
        raw = member(data)
        at = self.size
        self.out.write(raw)
        self.size += len(raw)
        place = self.name, at, len(raw)
        if self.size >= self.max:
            self.close()
        return place

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            move(self.fs, self.temporary, f"{self.base}/{self.name}")
            self.out, self.number = None, self.number + 1


def write(pages: DataFrame, folder: str, max_bytes: int = MAX_BYTES, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Write all pages and give one row per record: ``page_id``, ``url``, ``file``, ``position`` and
    ``length`` of its gzip member and ``payload_digest``; ``folder`` then has ``manifest.json`` too."""
    host, _, _ = parts(F.col("url"))
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"), F.concat(host, F.lit(" "), url).alias("key"))
    count = rows.count()
    ranges = max(1, -(-count // range_rows))
    if ranges > 1:
        threshold = -(1 << 63) + int((1 << 64) * ranges / count)
        bounds = sorted((r[0] for r in rows.select("key").filter(F.xxhash64("key") < F.lit(threshold)).distinct().collect()), key=lambda k: k.encode())
    else:
        bounds = []
    shared = rows.sparkSession.sparkContext.broadcast(np.array([b.encode() for b in bounds], dtype=object))

    @F.pandas_udf("int")
    def range_of(key):
        import pandas as pd

        return pd.Series(np.searchsorted(shared.value, np.array([k.encode() for k in key], dtype=object), "right").astype(np.int32))

    ordered = rows.withColumn("range", range_of("key")).repartitionById(len(bounds) + 1, "range").sortWithinPartitions("range", "key", "page_id", F.xxhash64("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        attempt, writer = str(TaskContext.get().taskAttemptId()), None
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                ids, urls = K.column(batch, "page_id").to_pylist(), K.column(batch, "url").to_pylist()
                places, digests = [], []
                for r, i, u, h in zip(K.column(batch, "range").to_pylist(), ids, urls, K.column(batch, "html").to_pylist()):
                    if writer is None or writer.range != r:
                        if writer is not None:
                            writer.close()
                        writer = Writer(folder, r, attempt, max_bytes)
                    data, own = record(i, u, h)
                    places.append(writer.add(data))
                    digests.append(own)
                file, position, length = zip(*places)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(urls), pa.array(file), pa.array(position, pa.int64()), pa.array(length, pa.int64()), pa.array(digests)], names=["page_id", "url", "file", "position", "length", "payload_digest"])
        if writer is not None:
            writer.close()

    index = materialise(ordered.select("range", "page_id", "url", "html").mapInArrow(run, "page_id long, url string, file string, position long, length long, payload_digest string"), "warc-index")
    files = index.groupBy("file").agg(F.count("*").alias("records"), F.max(F.col("position") + F.col("length")).alias("bytes")).orderBy("file")
    target, base = fs.FileSystem.from_uri(folder)
    target.create_dir(base)
    listed = [{"file": f["file"], "records": f["records"], "bytes": f["bytes"]} for f in files.toLocalIterator()]
    with target.open_output_stream(f"{base}/_manifest.json.tmp") as out:
        out.write(json.dumps({"records": count, "files": listed}, indent=1).encode())
    move(target, f"{base}/_manifest.json.tmp", f"{base}/manifest.json")
    if target.get_file_info(f"{base}/_temporary").type == fs.FileType.Directory:
        target.delete_dir(f"{base}/_temporary")
    return index


def write_pages(pages: DataFrame) -> DataFrame:
    """Write into a new folder of the session's shared folder."""
    return write(pages, f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}")
