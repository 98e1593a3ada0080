"""WARC archives: a writer of one gzip member per record, and a sequential reader.

The reader feeds each archive to zlib in small pieces, takes every record's block by its
Content-Length, and verifies the digests of block and payload as the bytes pass, so a
task holds one record at most (or, without ``payloads``, one piece). Archives are rolled
at ``ROLL`` bytes, lie in the folder given (on a cluster: one that executors share) and
get their names only when complete, so a repeated task replaces what a lost one left.

Defined cases: a null payload is empty; a null page_id stays null and is nobody's
response unless it has no equal with an id; repeated rows are a record each, and all of
the smallest page_id are responses. An empty table gives no archives and no rows. A
damaged archive raises ValueError with the record's place.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import shared_dir

ROLL = 64 << 20
PIECE = 1 << 16
#: Equal payloads below this many bytes are all responses.
LEAST_REVISIT = 100
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string"


def revisits(pages: DataFrame) -> DataFrame:
    """Adds digest, size and refers_to: the smallest page_id of an equal payload, for all others of it.

    The groups are counted before they are joined back, and only those of several rows
    are; adaptive execution may split a group of any size on the side of the pages.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload"), F.sha2(payload, 256).alias("digest"), F.octet_length(payload).cast("long").alias("size"))
    groups = rows.where(F.col("size") >= LEAST_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return rows.join(groups, "digest", "left").withColumn("refers_to", again).drop("first")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record as bytes, before compression."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    head = [
        VERSION.decode(),
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        *([f"WARC-Target-URI: {uri}"] if url is not None else []),
        *([f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"] if refers_to is not None else []),
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 3) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes a record per row of ``revisits``'s result; (path, records, bytes) of each archive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        task = TaskContext.get()
        made: list[tuple[str, int, int]] = []
        out, held, count, name = None, 0, 0, ""

        def close() -> None:
            out.close()
            store.move(f"{root}/_{name}.{task.taskAttemptId()}", f"{root}/{name}")
            made.append((f"{folder}/{name}", count, held))

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to")]
            for row in zip(*columns, strict=True):
                if out is None:
                    name, held, count = f"part-{task.partitionId():06d}-{len(made):05d}.warc.gz", 0, 0
                    store.create_dir(root, recursive=True)
                    out = store.open_output_stream(f"{root}/_{name}.{task.taskAttemptId()}", compression=None)
                data = member(record(*row))
                out.write(data)
                held, count = held + len(data), count + 1
                if held >= ROLL:
                    close()
                    out = None
        if out is not None:
            close()
        columns = list(zip(*made, strict=True)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64()), strict=True)], ["path", "records", "bytes"])

    rows = pages.select("page_id", "url", "payload", "digest", "refers_to")
    return rows.mapInArrow(run, "path string, records long, bytes long")


class Members:
    """The bytes of an archive's gzip members, one member at a time, decompressed as asked for."""

    def __init__(self, stream: BinaryIO) -> None:
        self.stream, self.ahead, self.z = stream, b"", None
        self.plain = bytearray()

    def begin(self) -> bool:
        """Goes to the next member; False at the end of the archive."""
        self.ahead = self.ahead or self.stream.read(PIECE)
        self.z, self.plain = zlib.decompressobj(31), bytearray()
        return bool(self.ahead)

    def more(self) -> bool:
        if self.z.eof:
            return False
        self.ahead = self.ahead or self.stream.read(PIECE)
        if not self.ahead:
            raise ValueError("the archive ends inside a member")
        self.plain += self.z.decompress(self.ahead, PIECE)
        self.ahead = self.z.unused_data if self.z.eof else self.z.unconsumed_tail
        return True

    def until(self, mark: bytes) -> bytes:
        at = self.plain.find(mark)
        while at < 0:
            before = max(0, len(self.plain) - len(mark))
            if not self.more():
                raise ValueError("a header without an end")
            at = self.plain.find(mark, before)
        out = bytes(self.plain[:at])
        del self.plain[: at + len(mark)]
        return out

    def take(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.plain and not self.more():
                raise ValueError("a block shorter than its Content-Length")
            part = bytes(self.plain[:n])
            del self.plain[: len(part)]
            n -= len(part)
            yield part


def headers(head: bytes) -> tuple[str, dict[str, str]]:
    first, *lines = head.decode("utf-8", "replace").split("\r\n")
    return first, {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def read_records(stream: BinaryIO, payloads: bool = True) -> Iterator[dict]:
    """Every record of an archive in order, framed by Content-Length and verified."""
    members, place = Members(stream), 0
    while members.begin():
        try:
            first, fields = headers(members.until(b"\r\n\r\n"))
            if first.encode() != VERSION:
                raise ValueError(f"no record but {first[:20]!r}")
            block, body, head, kept = hashlib.sha256(), hashlib.sha256(), b"", []
            http, size = None, 0
            for part in members.take(int(fields["content-length"])):
                block.update(part)
                if http is None:
                    head += part
                    before, mark, part = head.partition(b"\r\n\r\n")
                    if not mark:
                        continue
                    http = headers(before)[1]
                body.update(part)
                size += len(part)
                if payloads:
                    kept.append(part)
            while members.more():
                pass
            if bytes(members.plain) != b"\r\n\r\n":
                raise ValueError("a member holds more than its record")
            if fields["warc-block-digest"] != f"sha256:{block.hexdigest()}":
                raise ValueError("the block's digest differs")
            digest = fields["warc-payload-digest"].removeprefix("sha256:")
            if fields["warc-type"] == "response" and (digest != body.hexdigest() or size != int(http["content-length"])):
                raise ValueError("the payload's digest or length differs")
        except (KeyError, TypeError, zlib.error) as e:
            raise ValueError(f"record {place}: {e!r}") from e
        except ValueError as e:
            raise ValueError(f"record {place}: {e}") from e
        number = lambda v: int(m[1]) if v and (m := re.fullmatch(r"<urn:page:(-?\d+)>", v)) else None
        yield {
            "page_id": number(fields["warc-record-id"]),
            "url": fields.get("warc-target-uri"),
            "record_type": fields["warc-type"],
            "refers_to": number(fields.get("warc-refers-to")),
            "payload_bytes": int(http["content-length"]),
            "payload_digest": digest,
            **({"payload": b"".join(kept) if fields["warc-type"] == "response" else None} if payloads else {}),
        }
        place += 1


def read_archives(paths: DataFrame, payloads: bool = True) -> DataFrame:
    """A row per record of the archives at (path); a revisit's length and digest are its response's."""
    schema = RECORD + (", payload binary" if payloads else "")
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, types, strict=False)], names)

        for batch in batches:
            for path in batch.column("path").to_pylist():
                store, at = fs.FileSystem.from_uri(path)
                rows, held = [], 0
                with store.open_input_stream(at, compression=None) as stream:
                    for r in read_records(stream, payloads):
                        rows.append(r)
                        held += 200 + len(r.get("payload") or b"")
                        if held > 8 << 20:
                            yield batch_of(rows)
                            rows, held = [], 0
                yield batch_of(rows)

    return paths.select("path").mapInArrow(run, schema)


def archive_and_read(pages: DataFrame, payloads: bool = True) -> DataFrame:
    """Writes every row of (page_id, url, html) and reads it back from the archives."""
    spark = pages.sparkSession
    folder = shared_dir(spark)
    manifest = f"{folder}-manifest"
    write_archives(revisits(pages.select("page_id", "url", "html")), folder).write.parquet(manifest)
    made = spark.read.parquet(manifest)
    return read_archives(made.repartition(max(1, made.count()), "path"), payloads)
