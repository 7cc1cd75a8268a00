"""WARC archives: a writer that stores equal payloads once, and a reader that salvages what damage leaves.

Writing: of records with equal payloads of at least ``min_bytes`` the one with the smallest id is a response, the others
are revisits that refer to it. Each task streams its own files, of at most about ``FILE_BYTES``, under names that no
other attempt uses, and only files that a finished task has told of count.

Reading: a file is read as a stream through a window of a record or two, so its size doesn't matter; a record's end is
sought before it is read, and nothing beyond ``MOST`` bytes is, so a wrong length or a member that inflates without end is
no matter either. Files of a store that only Spark opens are read whole, by Spark. A record is checked: its gzip member,
its version line, its length, its digests. After a failed check the reader goes on at the next valid member or version line; what it passed
over is a gap with offset, length and reason, so that records and gaps together cover every byte of a file. Gaps are
logged as a table (``logged``), which is empty for whole archives.

Defined cases: a null payload counts as the empty one; a null id is written and read back as null, and refers to the
smallest id that has its payload, if one has; an id with several payloads has a record for each, told apart by digest;
rows that repeat id and payload repeat the record, all of the same type; an empty table gives no files and no rows; extra
columns are ignored; an archive without a valid record gives gaps only; a record of more than ``MOST`` bytes
is a gap.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daybook.llm.common import shared_dir, small, stage, table

FILE_BYTES = 256 << 20
#: Bytes of the longest record that is read; a longer one is a gap, and so is a member that inflates to more.
MOST = 1 << 30
#: Bytes read at a time, bytes of a record's head at most, bytes of payloads in a batch of rows.
STEP, HEAD, BATCH = 1 << 16, 1 << 20, 4 << 20
DATE = "2026-01-01T00:00:00Z"
GZIP = b"\x1f\x8b\x08"
VERSION = b"WARC/1."
ID = "urn:x-page:"

SCHEMA = (
    "path string, offset long, length long, gap string, record_type string, record_id string, refers_to string, uri string, date string, "
    "payload_digest string, payload_bytes long, payload binary"
)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, record_id: str, uri: str, payload: bytes, refers_to: str | None = None, date: str = DATE) -> bytes:
    """One record, not compressed. A revisit has the HTTP head only; length and digest are the full payload's."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + (payload if kind == "response" else b"")
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}", f"WARC-Target-URI: {uri}",
        "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest(payload)}", f"WARC-Block-Digest: sha1:{digest(block)}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += [f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode("utf-8", "replace") + block + b"\r\n\r\n"


def member(raw: bytes) -> bytes:
    press = zlib.compressobj(6, zlib.DEFLATED, 31)
    return press.compress(raw) + press.flush()


@dataclass
class Parsed:
    headers: dict[str, str]
    block: bytes
    size: int


class Window:
    """What of a stream is at hand: ``data`` begins at byte ``base`` of it."""

    def __init__(self, stream: BinaryIO):
        self._stream, self.data, self.base = stream, b"", 0
        self._start = stream.tell() if stream.seekable() else None

    def more(self) -> bool:
        """Reads on, as much as is held already (so that what is copied stays in proportion); False at the end."""
        chunk = self._stream.read(max(STEP, len(self.data)))
        self.data += chunk
        return bool(chunk)

    def holds(self, stop: int) -> bool:
        """Whether the stream has the bytes before ``stop``, which counts from ``base``."""
        while len(self.data) < stop and self.more():
            pass
        return len(self.data) >= stop

    def follows(self, at: int, what: bytes) -> bool:
        """Whether the stream has these bytes at ``at``, without what stands before them where the stream can be sought."""
        if at + len(what) <= len(self.data) or self._start is None:
            return self.holds(at + len(what)) and self.data.startswith(what, at)
        self._stream.seek(self._start + self.base + at)
        there = self._stream.read(len(what))
        self._stream.seek(self._start + self.base + len(self.data))
        return there == what

    def drop(self, n: int) -> None:
        self.data, self.base = self.data[n:], self.base + n

    def skip_to(self, *marks: bytes) -> bool:
        """Drops what stands before the next of the marks; all the rest and False, where none follows."""
        while not (found := [at for m in marks if (at := self.data.find(m)) >= 0]):
            self.drop(max(0, len(self.data) - max(map(len, marks)) + 1))
            if not self.more():
                self.drop(len(self.data))
                return False
        self.drop(min(found))
        return True


def parsed(window: Window, at: int = 0) -> Parsed | str:
    """The record whose version line is at ``at``, or what is wrong with it."""
    if not window.holds(at + len(VERSION)) or not window.data.startswith(VERSION, at):
        return "no version line"
    while (end := window.data.find(b"\r\n\r\n", at, at + HEAD)) < 0:
        if len(window.data) >= at + HEAD or not window.more():
            return "no end of header"
    headers = {}
    for line in window.data[at:end].decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            return "bad header line"
        headers[name.strip().lower()] = value.strip()
    if not {"warc-type", "warc-record-id"} <= headers.keys():
        return "no type or id"
    length = headers.get("content-length", "")
    if not (length.isascii() and length.isdigit()):
        return "no length"
    start, stop = end + 4, end + 4 + int(length)
    if int(length) > MOST:
        return "too long"
    # The record's end is looked at before the record is read: a wrong length costs no reading of what it spans.
    if not window.follows(stop, b"\r\n\r\n") or not window.holds(stop + 4):
        return "bad length"
    block = window.data[start:stop]
    if (want := headers.get("warc-block-digest")) and want.removeprefix("sha1:") != digest(block):
        return "bad block digest"
    return Parsed(headers, block, stop + 4 - at)


def _valid(window: Window, at: int) -> tuple[int, Parsed] | str:
    """(bytes, record) of the gzip member or plain record at ``at``, or what is wrong with it."""
    if not (window.holds(at + len(GZIP)) and window.data.startswith(GZIP, at)):
        got = parsed(window, at)
        return got if isinstance(got, str) else (got.size, got)
    press, parts, p, size = zlib.decompressobj(31), [], at, 0
    try:
        while not press.eof and (p < len(window.data) or window.more()):
            rest = window.data[p : p + STEP]
            p += len(rest)
            while rest and not press.eof:
                parts.append(press.decompress(rest, STEP))
                size, rest = size + len(parts[-1]), press.unconsumed_tail
                if size > MOST + HEAD:
                    return "too long"
    except zlib.error:
        return "bad gzip member"
    if not press.eof:
        return "unfinished gzip member"
    raw = b"".join(parts)
    got = parsed(Window(io.BytesIO(raw)))
    if isinstance(got, Parsed) and got.size != len(raw):
        return "more than a record in a member"
    return got if isinstance(got, str) else (p - at - len(press.unused_data), got)


def salvage(data: bytes | BinaryIO) -> Iterator[tuple[int, int, Parsed | str]]:
    """(offset, length, record or reason of a gap) from the first byte to the last."""
    window = Window(io.BytesIO(data) if isinstance(data, bytes) else data)
    while window.holds(1):
        got = _valid(window, 0)
        if not isinstance(got, str):
            yield window.base, got[0], got[1]
            window.drop(got[0])
            continue
        began, reason = window.base, got
        window.drop(1)
        while window.skip_to(GZIP, VERSION) and isinstance(_valid(window, 0), str):
            window.drop(1)
        yield began, window.base - began, reason


def write_archives(pages: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes pages (record_id, uri, payload, refers_to) and returns (name, bytes, records) of each file, staged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        store, root = pyarrow.fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        out, name, written, n, files = None, "", 0, 0, 0

        def told() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pylist([{"name": name, "bytes": written, "records": n}])

        for batch in batches:
            for row in batch.to_pylist():
                kind = "response" if row["refers_to"] is None else "revisit"
                made = member(record(kind, row["record_id"], row["uri"] or "", (row["payload"] or "").encode("utf-8"), row["refers_to"]))
                if out is None:
                    name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{files:04d}.warc.gz"
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                out.write(made)
                written, n = written + len(made), n + 1
                if written >= file_bytes:
                    yield told()
                    out, written, n, files = None, 0, 0, files + 1
        if out is not None:
            yield told()

    return stage(pages.select("record_id", "uri", "payload", "refers_to").mapInArrow(run, "name string, bytes long, records long"), "warc-files")


def _row(path: str, at: int, size: int, got: Parsed | str) -> dict:
    if isinstance(got, str):
        return {"path": path, "offset": at, "length": size, "gap": got}
    h, (head, _, body) = got.headers, got.block.partition(b"\r\n\r\n")
    said = [x.split(b":", 1)[1].strip() for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")]
    want = h.get("warc-payload-digest", "").removeprefix("sha1:") or None
    if h.get("warc-type") == "response" and want not in (None, digest(body)):
        return {"path": path, "offset": at, "length": size, "gap": "bad payload digest"}
    return {
        "path": path, "offset": at, "length": size, "record_type": h.get("warc-type"), "record_id": h.get("warc-record-id", "").strip("<>"), "uri": h.get("warc-target-uri"),
        "date": h.get("warc-date"), "refers_to": h["warc-refers-to"].strip("<>") if "warc-refers-to" in h else None, "payload_digest": want,
        "payload_bytes": int(said[0]) if said and said[0].isdigit() else None, "payload": body,
    }


def read_archives(spark: SparkSession, folder: str, only: DataFrame | None = None, through_spark: bool = False) -> DataFrame:
    """Records and gaps (SCHEMA) of the archives in a folder; only: the names of those that count; through_spark: the
    store is one that pyarrow doesn't open, so Spark reads each file whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, path in enumerate(batch.column("path").to_pylist()):
                if through_spark:
                    stream = io.BytesIO(batch.column("content")[k].as_buffer())
                else:
                    store, at = pyarrow.fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))
                    stream = store.open_input_file(at)
                rows, held = [], 0
                with stream:
                    for found in salvage(stream):
                        rows.append(_row(path, *found))
                        held += len(rows[-1].get("payload") or b"")
                        if held >= BATCH or len(rows) >= 10_000:
                            yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    arrow = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in SCHEMA.split(", ")])
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").load(folder)
    if only is not None:
        files = files.withColumn("name", F.element_at(F.split("path", "/"), -1)).join(small(only.select("name")), "name", "left_semi")
    return files.select("path", *["content"] * through_spark).mapInArrow(run, SCHEMA)


def logged(read: DataFrame, log: str) -> DataFrame:
    """The records of read (what read_archives gives, staged). Its gaps are added to the table at ``log``: path, offset,
    length, reason."""
    read.where("gap IS NOT NULL").select("path", "offset", "length", F.col("gap").alias("reason")).coalesce(1).write.mode("append").parquet(log)
    return read.where("gap IS NULL").drop("gap")


def with_first(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """pages (page_id, url, html) with ``first``, the id of the page that each revisits, or null. Payloads are grouped by
    hash and length, which are summed before they are shuffled; only groups of several are joined back."""
    payload = F.coalesce("html", F.lit(""))
    seen = pages.select("*", F.sha2(payload, 256).alias("_h"), F.octet_length(payload).alias("_n"))
    first = seen.where(F.col("_n") >= min_bytes).groupBy("_h", "_n").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("_c")).where("_c > 1").drop("_c")
    found = seen.join(small(stage(first, "warc-copied")), ["_h", "_n"], "left").drop("_h", "_n")
    return found.withColumn("first", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = with_first(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    urn = lambda c: F.concat(F.lit(ID), c.cast("string"))
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex[:12]}"
    files = write_archives(
        pages.select(F.coalesce(urn(F.col("page_id")), F.lit(ID)).alias("record_id"), F.col("url").alias("uri"), F.col("html").alias("payload"), urn(F.col("first")).alias("refers_to")), folder
    )
    if files.isEmpty():
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    page = lambda c: F.expr(f"try_cast(substring({c}, {len(ID) + 1}) AS bigint)")
    read = stage(read_archives(spark, folder, files).drop("payload"), "warc-read")
    return logged(read, f"{folder}-gaps").select(
        page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to")
    )


OP5_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h),
b AS (SELECT p.page_id, CAST(strlen(p.h) AS BIGINT) AS payload_bytes, CAST(CAST(unhex(sha1(p.h)) AS BIT) AS VARCHAR) AS bits, nullif(first, p.page_id) AS refers_to FROM p JOIN f USING (h))
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * CAST(bits[5 * i + 1] AS INT) + 8 * CAST(bits[5 * i + 2] AS INT)
    + 4 * CAST(bits[5 * i + 3] AS INT) + 2 * CAST(bits[5 * i + 4] AS INT) + CAST(bits[5 * i + 5] AS INT), 1)), '') AS payload_digest,
  CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to
FROM b
"""
