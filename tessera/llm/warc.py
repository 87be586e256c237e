"""WARC archives: writing and reading them with Spark, and resolving equal payloads into revisit records.

Each record is a gzip member, so that it can be read by its offset alone, and an archive holds members up to a bound in bytes. Archives are
written by Spark's text writer, one to a row, and read as binary files, so any store that Spark reaches will do. The writer ends
a row with its line separator: that is the zero byte with which a member of less than 16 MB ends anyway.
"""

from __future__ import annotations

import base64
import hashlib
import io
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import BROADCAST_ROWS, arrow, join_small, scratch, stored

END = "\r\n"
#: Compressed bytes from which an archive is closed; bytes of a record in one gzip member, below 2**24; bytes inflated at a time.
ARCHIVE_BYTES, MEMBER_BYTES, INFLATE_BYTES = 8 << 20, (1 << 24) - 1, 1 << 16
#: The date of records, whose pages have none.
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URN = "urn:tessera:record:"
RECORD = "file string, position long, offset long, id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(key: int | None) -> str:
    return f"<{URN}{'' if key is None else key}>"


def _key(urn: str | None) -> int | None:
    digits = (urn or "").removeprefix(f"<{URN}").removesuffix(">")
    return int(digits) if digits else None


def record(key: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None = None, revisit: bool = False, refers_url: str | None = None, date: str = DATE) -> bytes:
    """One record with the line ends that close it. A revisit keeps the HTTP header and leaves out the payload."""
    block = f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: {size}{END}{END}".encode() + (b"" if revisit else payload)
    clean = lambda x: x.replace("\r", "%0D").replace("\n", "%0A")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(key)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {clean(url)}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_urn(refers_to)}"]
        if refers_url is not None:
            head.append(f"WARC-Refers-To-Target-URI: {clean(refers_url)}")
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return (END.join(head) + END + END).encode() + block + (END + END).encode()


def members(raw: bytes) -> Iterator[bytes]:
    """A record as a gzip member; as several where one would not end with a zero byte."""
    for k in range(0, len(raw), MEMBER_BYTES):
        pack = zlib.compressobj(1, zlib.DEFLATED, 31)
        yield pack.compress(raw[k : k + MEMBER_BYTES]) + pack.flush()


def inflated(content: bytes) -> Iterator[tuple[int, bytes]]:
    """Offset and text of each record of an archive, whose members each begin one or go on with it."""
    at, first, held, view = 0, 0, b"", memoryview(content)
    while at < len(content):
        unpack, parts, begin = zlib.decompressobj(31), [], at
        while not unpack.eof:
            if at >= len(content):
                raise ValueError("an archive ends early")
            parts.append(unpack.decompress(view[at : at + INFLATE_BYTES]))
            at = min(at + INFLATE_BYTES, len(content)) - len(unpack.unused_data)
        first = first if held else begin
        held += b"".join(parts)
        if _complete(held):
            yield first, held
            held = b""
    if held:
        raise ValueError("a record ends early")


def _complete(raw: bytes) -> bool:
    """Whether a record is there as a whole, with the line ends that close it."""
    end = raw.find(b"\r\n\r\n")
    size = next((int(x[15:]) for x in raw[: max(end, 0)].split(b"\r\n") if x[:15].lower() == b"content-length:"), None)
    return size is not None and len(raw) >= end + 4 + size + 4


def parse(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and content block of each record, in order."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not the start of a record: {line[:40]!r}")
        head = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8").partition(":")
            head[name.strip().lower()] = value.strip()
        size = int(head["content-length"])
        block = stream.read(size)
        if len(block) != size:
            raise ValueError("a record ends early")
        yield head, block


class _Archive:
    """Records of a task, compressed; a batch of one row when there are enough for an archive."""

    def __init__(self):
        self.parts: list[bytes] = []
        self.size = 0

    def add(self, raw: bytes) -> Iterator[pa.RecordBatch]:
        packed = b"".join(members(raw))
        self.parts.append(packed)
        self.size += len(packed)
        if self.size >= ARCHIVE_BYTES:
            yield from self.close()

    def close(self) -> Iterator[pa.RecordBatch]:
        if not self.size:
            return
        raw = b"".join(self.parts)
        self.parts, self.size = [], 0
        ends = pa.py_buffer(np.array([0, len(raw) - 1], np.int32).tobytes())  # the writer adds the zero byte again
        yield pa.RecordBatch.from_arrays([pa.Array.from_buffers(pa.string(), 1, [None, ends, pa.py_buffer(raw)])], names=["value"])


def _write(archives: DataFrame, path: str) -> str:
    """archives: one string column of bytes, a row for each file."""
    archives.write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)
    return path


def write(pages: DataFrame, path: str, *, id: str = "page_id", url: str = "url", html: str = "html") -> str:
    """One response record per row; a null payload is empty. The path.

    Equal rows, and rows with one id or none, are records of their own; other columns are left out. An archive of over
    ARCHIVE_BYTES is one record. No rows give no archives.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = _Archive()
        for batch in batches:
            for k in range(batch.num_rows):
                key, link, text = (batch.column(c)[k].as_py() for c in range(3))
                raw = (text or "").encode("utf-8", "replace")
                yield from archive.add(record(key, link, raw, base32_sha1(raw), len(raw)))
        yield from archive.close()

    return _write(arrow(pages.select(F.col(id).cast("long"), F.col(url).cast("string"), F.col(html).cast("string")), build, "value string"), path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")


def _records(content: bytes) -> Iterator[tuple[int, int, dict[str, str], int, bytes | None, str]]:
    """Position, offset, headers, bytes of the full payload, payload (None in revisits) and its digest."""
    for k, (offset, raw) in enumerate(inflated(content)):
        for head, block in parse(io.BytesIO(raw)):
            http, _, payload = block.partition(b"\r\n\r\n")
            if head["warc-type"] == "revisit":
                size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                yield k, offset, head, size, None, head["warc-payload-digest"].removeprefix("sha1:")
            else:
                yield k, offset, head, len(payload), payload, base32_sha1(payload)


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives below ``path``; digests of responses are computed anew. A record can be read by its offset alone."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                out = [(file, k, offset, _key(head["warc-record-id"]), head.get("warc-target-uri"), head["warc-type"], _key(head.get("warc-refers-to")), size, digest) for k, offset, head, size, _, digest in _records(content.as_py())]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["file", "position", "offset", "id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest"])

    return arrow(_files(spark, path), rows, RECORD)


def resolve(headers: DataFrame, least: int = 0) -> DataFrame:
    """The records to turn into revisits: ``file, position, refers_to, refers_url``.

    Of the records with equal digest and length, of at least ``least`` bytes, the one with the smallest id stays (null ids come
    last, then file and position decide). Only headers are shuffled, and those of one digest are reduced before.
    """
    order = F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("file"), F.col("position"))
    large = headers.where(F.col("payload_bytes") >= least)
    first = large.groupBy("payload_digest", "payload_bytes").agg(F.min_by(F.struct("file", "position", "id", "url"), order).alias("first"), F.count("*").alias("n")).where("n > 1")
    return (
        join_small(large, stored(first), ["payload_digest", "payload_bytes"], row_bytes=512).where("not (file = first.file and position = first.position)")
        .select("file", "position", F.col("first.id").alias("refers_to"), F.col("first.url").alias("refers_url"))
    )


def deduplicate(spark: SparkSession, source: str, target: str, least: int = 0) -> str:
    """Writes the archives below ``source`` again below ``target``, with fresh headers, equal payloads once. The path.

    The archive files, not their records, meet the revisits: a file's list is bounded as the file is.
    """
    plan = stored(resolve(stored(read(spark, source)), least).groupBy("file").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("position", "refers_to", "refers_url"))).alias("revisits")))
    small = (plan.agg(F.sum("n")).first()[0] or 0) <= BROADCAST_ROWS
    both = _files(spark, source).join(F.broadcast(plan) if small else plan, "file", "left").select("content", F.expr("transform(revisits, r -> r.position)").alias("at"), F.expr("transform(revisits, r -> r.refers_to)").alias("to"), F.expr("transform(revisits, r -> r.refers_url)").alias("url"))

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = _Archive()
        for batch in batches:
            for content, at, to, url in zip(*(batch.column(k) for k in range(4)), strict=True):
                revisits = dict(zip(at.as_py() or [], zip(to.as_py() or [], url.as_py() or [], strict=True), strict=True))
                for k, _, head, size, payload, digest in _records(content.as_py()):
                    key, link = _key(head["warc-record-id"]), head.get("warc-target-uri")
                    yield from archive.add(record(key, link, b"", digest, size, revisits[k][0], True, revisits[k][1]) if k in revisits else record(key, link, payload, digest, size))
        yield from archive.close()

    return _write(arrow(both, rebuild, "value string"), target)


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Pages to archives, to deduplicated archives, and those read back."""
    spark, folder = pages.sparkSession, scratch(pages.sparkSession)
    return read(spark, deduplicate(spark, write(pages, f"{folder}/raw"), f"{folder}/unique", least))
