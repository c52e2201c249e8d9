"""WARC archives as a chunked record table.

`write_archives` streams one record a page into gzip-compressed WARC files, a
member a record.  `read_chunks` streams the archives back as rows of record
identifier, chunk number and chunk, carrying the payload's SHA-1 from chunk to
chunk, so neither side holds a whole record besides its row.  `records` folds
the chunks into one row a record.

Of records with equal payloads of at least REVISIT_BYTES, the one with the
largest page_id is written as response and the others as revisits of it.

Defined results: a null html is an empty payload; a null page_id never counts
as the largest; repeated rows of the largest page_id are all responses; an empty
table gives no archive and an empty result; extra columns are ignored.  A task
that is repeated writes the same file anew under a temporary name and renames
it, so lost executors leave no partial archive.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandemetry.llm.common import fresh_path, staged, tidied

REVISIT_BYTES = 1000
CHUNK = 1 << 18
#: Compressed bytes after which a task begins another archive, so that reading can be dealt out.
ARCHIVE_BYTES = 1 << 25
#: Groups of equal payloads whose digests may be broadcast.
BROADCAST_GROUPS = 200_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"


def planned(pages: DataFrame) -> DataFrame:
    """page_id, url, html and refers_to (null for responses)."""
    body = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), body.alias("html"))
    keyed = rows.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    groups = (
        keyed.where(F.octet_length("html") >= REVISIT_BYTES)
        .groupBy("digest").agg(F.max("page_id").alias("response_id"), F.count("*").alias("n"))
        .where("n > 1 and response_id is not null").select(F.col("digest").alias("g"), "response_id")
    )
    groups = staged(groups, "payload-groups")
    few = groups.count() <= BROADCAST_GROUPS
    out = keyed.join(F.broadcast(groups) if few else groups.hint("merge"), F.col("digest") == F.col("g"), "left")
    other = F.col("response_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response_id"))
    return out.select("page_id", "url", "html", F.when(other, F.col("response_id")).alias("refers_to"))


def _identifier(page_id: int | None) -> str:
    return f"<urn:x-page:{'null' if page_id is None else page_id}>"


def _header(page_id: int | None, url: str | None, digest: bytes, refers_to: int | None, size: int) -> tuple[bytes, bytes]:
    """The record's header and the HTTP header that begins its block."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_identifier(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {quote(url or '', safe=''.join(map(chr, range(33, 127))))}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(digest).decode()}",
        "Content-Type: application/http;msgtype=response",
    ]
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_identifier(refers_to)}"]
    lines.append(f"Content-Length: {len(http) + (size if refers_to is None else 0)}")
    return ("\r\n".join(lines) + "\r\n\r\n").encode(), http


class _Archives:
    """Archives that one task writes: part-<partition>-<number>.warc.gz."""

    def __init__(self, folder: str):
        self.store, self.folder = fs.FileSystem.from_uri(folder)
        self.store.create_dir(self.folder, recursive=True)
        context = TaskContext.get()
        self.part, self.attempt = (context.partitionId(), context.taskAttemptId()) if context else (0, 0)
        self.number, self.out, self.done = 0, None, []

    def write(self, pieces: Iterator[bytes | memoryview]) -> None:
        if self.out is None:
            self.temporary = f"{self.folder}/_{self.part}-{self.number}-{self.attempt}"
            self.out, self.size, self.count = self.store.open_output_stream(self.temporary), 0, 0
        gz = zlib.compressobj(4, zlib.DEFLATED, 31)
        for piece in pieces:
            self._put(gz.compress(piece))
        self._put(gz.flush())
        self.count += 1
        if self.size >= ARCHIVE_BYTES:
            self.close()

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            name = f"{self.folder}/part-{self.part:05d}-{self.number:05d}.warc.gz"
            self.store.move(self.temporary, name)
            self.done.append((name.rpartition("/")[2], self.count, self.size))
            self.number, self.out = self.number + 1, None


def write_archives(plan: DataFrame, folder: str | None = None) -> tuple[str, DataFrame]:
    """Write the planned pages; returns the folder and a table of archive, records and bytes."""
    folder = folder or fresh_path(plan.sparkSession, "warc")

    def pieces(page_id, url, body: memoryview, refers_to):
        sha = hashlib.sha1()
        for a in range(0, len(body), CHUNK):
            sha.update(body[a : a + CHUNK])
        head, http = _header(page_id, url, sha.digest(), refers_to, len(body))
        yield head + http
        if refers_to is None:
            for a in range(0, len(body), CHUNK):
                yield body[a : a + CHUNK]
        yield b"\r\n\r\n"

    def run(batches):
        archives = _Archives(folder)
        for batch in batches:
            body = batch.column("html").cast(pa.binary())
            ids, urls, refers = (batch.column(c).to_pylist() for c in ("page_id", "url", "refers_to"))
            for i, page_id in enumerate(ids):
                archives.write(pieces(page_id, urls[i], memoryview(body[i].as_buffer()), refers[i]))
        archives.close()
        names, counts, sizes = zip(*archives.done, strict=True) if archives.done else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(counts, pa.int64()), pa.array(sizes, pa.int64())], ["archive", "n_records", "n_bytes"])

    return folder, staged(plan.mapInArrow(tidied(run), "archive string, n_records long, n_bytes long"), "archives")


class _Stream:
    """Decompressed bytes of an archive, pulled piece by piece across gzip members."""

    def __init__(self, source):
        self.source, self.gz, self.held = source, zlib.decompressobj(31), b""
        self.raw = b""

    def _more(self) -> bool:
        while True:
            if self.gz.eof:
                self.raw, self.gz = self.gz.unused_data + self.raw, zlib.decompressobj(31)
            if not self.raw:
                self.raw = self.source.read(CHUNK)
                if not self.raw:
                    return False
            got = self.gz.decompress(self.raw, CHUNK)
            self.raw = self.gz.unconsumed_tail
            if got:
                self.held += got
                return True

    def until(self, mark: bytes) -> bytes | None:
        start = 0
        while (k := self.held.find(mark, start)) < 0:
            start = max(0, len(self.held) - len(mark))
            if not self._more():
                return None
        out, self.held = self.held[: k + len(mark)], self.held[k + len(mark) :]
        return out

    def take(self, most: int) -> bytes:
        if not self.held and not self._more():
            raise EOFError("the archive ends inside a record")
        out, self.held = self.held[:most], self.held[most:]
        return out


def _fields(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode().split("\r\n")[1:]) if k}


def chunks_of(source, size: int = CHUNK) -> Iterator[tuple]:
    """(record, page_id, record_type, refers_to, url, payload_bytes, chunk_no, chunk, digest, last) of an open archive.

    `digest` is the SHA-1 of the payload up to and with the chunk; a revisit has
    one empty chunk and the digest of the payload that it stands for.
    """
    stream, record = _Stream(source), -1
    while (head := stream.until(b"\r\n\r\n")) is not None:
        record += 1
        warc = _fields(head)
        page = re.fullmatch(r"<urn:x-page:(-?\d+|null)>", warc["warc-record-id"])[1]
        refers = warc.get("warc-refers-to")
        http = stream.until(b"\r\n\r\n")
        declared = int(_fields(http)["content-length"])
        left = int(warc["content-length"]) - len(http)
        expected = base64.b32decode(warc["warc-payload-digest"].removeprefix("sha1:")).hex()
        common = (record, None if page == "null" else int(page), warc["warc-type"], int(re.search(r"-?\d+", refers)[0]) if refers else None, warc["warc-target-uri"], declared)
        sha, number, held = hashlib.sha1(), 0, []
        have = 0
        while left or not number:
            while left and have < size:
                piece = stream.take(min(left, size - have))
                sha.update(piece)
                held.append(piece)
                have, left = have + len(piece), left - len(piece)
            digest = expected if refers else sha.hexdigest()
            if not left and digest != expected:
                raise ValueError(f"record {warc['warc-record-id']}: the payload's digest is {digest}, its header says {expected}")
            yield (*common, number, b"".join(held), digest, not left)
            number, held, have = number + 1, [], 0
        if stream.until(b"\r\n\r\n") is None:
            raise EOFError("the archive ends inside a record")


CHUNKS = "archive string, record long, page_id long, record_type string, refers_to long, url string, payload_bytes long, chunk_no long, chunk binary, digest string, last boolean"


def read_chunks(folder: str, archives: DataFrame, size: int = CHUNK) -> DataFrame:
    """The chunked record table of the archives: a task an archive, rows sent as they are read."""
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.bool_()]
    names = [c.split()[0] for c in CHUNKS.split(", ")]

    def table(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def run(batches):
        store, path = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column("archive").to_pylist():
                rows, held = [], 0
                with store.open_input_stream(f"{path}/{name}", compression=None) as source:
                    for row in chunks_of(source, size):
                        rows.append((name, *row))
                        held += len(row[7])
                        if held >= 4 * size or len(rows) >= 4096:
                            yield table(rows)
                            rows, held = [], 0
                if rows:
                    yield table(rows)

    paths = archives.select("archive")
    return paths.repartition(max(1, paths.count())).mapInArrow(tidied(run), CHUNKS)


def records(chunks: DataFrame) -> DataFrame:
    """One row a record, from its chunks: page_id, payload_bytes, payload_digest, record_type, refers_to, n_chunks, stored_bytes."""
    one = F.first
    return (
        chunks.withColumn("n", F.octet_length("chunk"))
        .groupBy("archive", "record")
        .agg(one("page_id").alias("page_id"), one("payload_bytes").alias("payload_bytes"), F.max_by("digest", "chunk_no").alias("payload_digest"), one("record_type").alias("record_type"), one("refers_to").alias("refers_to"), F.count("*").alias("n_chunks"), F.sum("n").alias("stored_bytes"))
        .drop("archive", "record")
    )
