"""WARC archives as a table of record chunks.

Payloads are cut into chunk rows ``(record, chunk_no)`` before they reach the writer, and the reader gives chunk
rows again, each with the SHA-256 of the payload up to its end, so neither holds a record as a whole.  An archive
is one gzip member per record, written under a private name and renamed when complete.

Of records with equal payloads of at least ``least`` bytes, those with the smallest page_id are responses and the
others revisit it.  Equality is decided on digests in a narrow pre-aggregated table; pages meet only the digests
that occur more than once.

Defined results: null html is an empty payload; null urls give no target; rows that repeat the smallest page_id of
their payload are all responses; of equal payloads without any page_id all are responses; null page_ids come back
as null; an empty table gives no archive.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filesystem, materialise, write_whole

HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNKS = "page_id long, record_type string, refers_to long, chunk_no int, data binary, payload_bytes long, payload_digest string, last boolean"


def decided(pages: DataFrame, least: int) -> DataFrame:
    """Pages with the digest of their payload and, for revisits, the page they refer to."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.encode(F.col("html").cast("string"), "UTF-8"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("size", F.octet_length("payload").cast("long"))
    same = rows.where(F.col("size") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    same = materialise(same.where("n > 1").select("digest", "first"), "warc-equal")
    out = rows.join(same, "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return out.withColumn("refers_to", F.when(revisit, F.col("first"))).drop("first")


def chunk_rows(pages: DataFrame, chunk_bytes: int) -> DataFrame:
    """Record chunks in writing order; a revisit has one chunk without data."""
    n = F.when(F.col("refers_to").isNotNull(), 1).otherwise(F.greatest(F.lit(1), F.ceil(F.col("size") / chunk_bytes)))
    rows = pages.withColumn("chunks", n.cast("int"))
    rows = rows.select("page_id", "url", "digest", "size", "refers_to", "chunks", "payload", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk_no"))
    data = F.when(F.col("refers_to").isNull(), F.substring(F.col("payload"), F.col("chunk_no") * chunk_bytes + 1, F.lit(chunk_bytes)))
    return rows.select("page_id", "url", "digest", "size", "refers_to", "chunks", "chunk_no", data.alias("data"))


def record_head(page_id: int | None, url: str | None, digest: str, size: int, refers_to: int | None) -> bytes:
    """Header of a record; for a response, with the start of its block."""
    block = HTTP % size if refers_to is None else b""
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"), ("WARC-Date", "1970-01-01T00:00:00Z")]
    if url is not None:
        fields.append(("WARC-Target-URI", quote(url, safe=":/?#[]@!$&'()*+,;=%~-._|")))
    if refers_to is not None:
        fields += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", PROFILE)]
    fields += [("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Payload-Length", str(size)), ("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(0 if refers_to is not None else len(block) + size))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block


def write_archives(pages: DataFrame, folder: str, least: int = 100, chunk_bytes: int = 1 << 16, level: int = 4) -> DataFrame:
    """Write a record per row of ``pages(page_id, url, html)``; the manifest, a row per archive."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        uri, records = f"{folder}/archive-{TaskContext.get().partitionId():07d}.warc.gz", [0]

        def write(sink):
            member = None

            def rows(b):
                nonlocal member
                for page_id, url, digest, size, refers_to, chunks, chunk_no, data in zip(*(c.to_pylist() for c in b.columns)):
                    if chunk_no == 0:
                        member = zlib.compressobj(level, zlib.DEFLATED, 31)
                        sink.write(member.compress(record_head(page_id, url, digest, size, refers_to)))
                        records[0] += 1
                    if data:
                        sink.write(member.compress(data))
                    if chunk_no == chunks - 1:
                        sink.write(member.compress(b"\r\n\r\n"))
                        sink.write(member.flush())

            rows(first)
            for b in batches:
                rows(b)

        write_whole(uri, write)
        yield pa.record_batch([pa.array([uri]), pa.array(records, pa.int64())], names=["path", "records"])

    return materialise(chunk_rows(decided(pages, least), chunk_bytes).mapInArrow(task, "path string, records long"), "warc-manifest")


class Inflated:
    """The bytes of a file of gzip members, read and inflated in bounded pieces."""

    def __init__(self, source, piece: int = 1 << 18):
        self.source, self.piece, self.member, self.raw, self.have = source, piece, None, b"", b""

    def more(self) -> bool:
        while True:
            if not self.raw:
                self.raw = self.source.read(self.piece)
                if not self.raw:
                    return False
            if self.member is None:
                self.member = zlib.decompressobj(31)
            out = self.member.decompress(self.raw, self.piece)
            self.raw = self.member.unconsumed_tail or self.member.unused_data
            if self.member.eof:
                self.member = None
            if out:
                self.have += out
                return True

    def line(self) -> bytes | None:
        """The next line without its end; None at the end of the file."""
        while (at := self.have.find(b"\r\n")) < 0:
            if not self.more():
                return None
        out, self.have = self.have[:at], self.have[at + 2:]
        return out

    def take(self, n: int) -> Iterator[bytes]:
        """The next n bytes in bounded pieces."""
        while n > 0:
            if not self.have and not self.more():
                raise EOFError("an archive ends within a record")
            out, self.have = self.have[:n], self.have[n:]
            n -= len(out)
            yield out


def head_lines(source: Inflated) -> dict[bytes, bytes]:
    out = {}
    while line := source.line():
        name, _, value = line.partition(b":")
        out[name.lower()] = value.strip()
    return out


def records(source: Inflated, chunk_bytes: int) -> Iterator[tuple]:
    """Chunk rows of an archive (see ``CHUNKS``)."""
    number = lambda x: int(x[len(b"<urn:page:"):-1] or -1) if x[len(b"<urn:page:"):-1] else None
    while (line := source.line()) is not None:
        if not line:  # the empty lines behind a record
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record where one should start: {line[:40]!r}")
        head = head_lines(source)
        page_id, size = number(head[b"warc-record-id"]), int(head[b"x-payload-length"])
        if head[b"warc-type"] == b"revisit":
            yield page_id, "revisit", number(head[b"warc-refers-to"]), 0, b"", size, head[b"warc-payload-digest"].split(b":")[1].decode(), True
            continue
        source.line()
        head_lines(source)
        digest, done, chunk_no, waiting = hashlib.sha256(), 0, 0, b""
        for piece in source.take(size):
            waiting += piece
            while len(waiting) >= chunk_bytes or (waiting and done + len(waiting) == size):
                data, waiting = waiting[:chunk_bytes], waiting[chunk_bytes:]
                digest.update(data)
                done += len(data)
                yield page_id, "response", None, chunk_no, data, done, digest.hexdigest(), done == size
                chunk_no += 1
        if not size:
            yield page_id, "response", None, 0, b"", 0, digest.hexdigest(), True


def read_archives(manifest: DataFrame, chunk_bytes: int = 1 << 16, data: bool = True) -> DataFrame:
    """Chunk rows of the archives: ``payload_bytes`` and ``payload_digest`` are those of the payload up to the
    chunk's end, so the ``last`` chunk has the record's (a revisit's are those of the payload it stands for).
    ``data=False`` leaves the bytes out of the rows."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.string(), pa.bool_()]
        names = ["page_id", "record_type", "refers_to", "chunk_no", "data", "payload_bytes", "payload_digest", "last"]
        made = lambda rows: pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
        for b in batches:
            for path in b.column(0).to_pylist():
                fs, local = filesystem(path)
                with fs.open_input_stream(local, compression=None) as source:
                    waiting, size = [], 0
                    for row in records(Inflated(source), chunk_bytes):
                        waiting.append(row if data else (*row[:4], b"", *row[5:]))
                        size += len(waiting[-1][4]) + 200
                        if size > 1 << 22:
                            yield made(waiting)
                            waiting, size = [], 0
                    if waiting:
                        yield made(waiting)

    return manifest.select("path").repartition(max(1, manifest.count())).mapInArrow(task, CHUNKS)
