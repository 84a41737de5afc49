"""WARC: pages written as compressed records with revisits of equal payloads, and read back as a table of chunks.

Reading streams: an archive is inflated piece by piece, and a payload leaves as (record, chunk number) rows with the digest and
size so far, so no record is ever held whole. The row of the last chunk has the digest and size of the full payload.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.llm.common import as_bytes, bounded_batches, new_folder, pick, slices, written
from lexloom.llm.partrows import PartRows, by_part
from lexloom.llm.storage import make_folder, opened

ARCHIVE_BYTES = 64 << 20
CHUNK_BYTES = 256 << 10
READ_BYTES = 1 << 20
#: Repeated payloads whose digests and keys go to every task, about 100 bytes each.
BROADCAST_ROWS = 100_000
_URN = "urn:x-page:"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Heads hold the page's address, which a row may have in any length that Arrow carries.
_LONGEST_HEAD = 1 << 31


def base32_sha1(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _name(key: int | None) -> str:
    return f"<{_URN}{'' if key is None else key}>"


def record_head(key: int | None, url: str | None, digest: str, size: int, refers_to: int | None, http: bytes) -> bytes:
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_name(key)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        *([f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}"] if url else []),
        *([f"WARC-Refers-To: {_name(refers_to)}", f"WARC-Profile: {_PROFILE}"] if refers_to is not None else []),
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {size}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(http) + (size if refers_to is None else 0)}",
    ]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + http


def revisits(pages: DataFrame, key: str, payload: str, least_bytes: int = 0, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The pages with `_target`: the largest key of an equal payload of at least `least_bytes`, null where that is the row's own.

    Equal means equal SHA-1 and size; null payloads are empty. The largest keys are found by partial aggregation. Up to `broadcast_rows`
    payloads that repeat go to every task; with more, the pages are written once with numbers for rows, and what revisits is laid by
    file, so payloads are never shuffled. Rows that repeat the largest key are all responses; null keys are the smallest, and only
    revisit where some equal payload has a key.
    """
    body = F.coalesce(F.col("payload"), F.lit(""))
    digest = F.concat_ws(":", F.sha1(body.cast("binary")), F.octet_length(body)).alias("_digest")
    plain = pick(pages, key=key, url="url", payload=payload)
    sizes = plain.filter(F.octet_length(body) >= least_bytes).select(digest, "key")
    targets, _ = written(sizes.groupBy("_digest").agg(F.max("key").alias("_target"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "targets")
    own = ~F.col("_target").eqNullSafe(F.col("key"))
    if targets.count() <= broadcast_rows:
        joined = plain.select("key", "url", "payload", digest).join(F.broadcast(targets), "_digest", "left")
        return joined.select("key", "url", "payload", F.when(own, F.col("_target")).alias("_target"))
    whole, _ = written(plain.withColumn("_row", F.monotonically_increasing_id()), "pages")
    found = whole.select(F.col("_row").alias("row"), "key", digest).join(targets, "_digest").filter(own & F.col("_target").isNotNull())
    folder = by_part(found.select("row", "_target"), "row", "revisits")

    @F.arrow_udf("long")
    def target(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = PartRows(folder)
        for numbers in parts:
            rows: list[int | None] = [None] * len(numbers)
            for at, entries in known.entries(numbers.to_numpy()):
                for k, t in zip(at.tolist(), entries.column("_target").to_pylist()):
                    rows[k] = t
            yield pa.array(rows, pa.int64())

    return whole.select("key", "url", "payload", target("_row").alias("_target"))


def write_warcs(rows: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write (key, url, payload, _target) as archives of one gzip member a record; gives their table (path, records).

    The names are unique to the attempt; only archives in the committed table count, whatever a lost task left behind.
    """
    make_folder(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = opened(folder)
        out, done, n = None, [], 0
        for batch in slices(batches, 2):
            for key, url, body, target in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), as_bytes(batch.column(2)), batch.column(3).to_pylist()):
                if out is None:
                    path, n = f"{base}/{uuid.uuid4().hex}.warc.gz", 0
                    out = system.open_output_stream(path, compression=None)
                body = body or b""
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
                pack = zlib.compressobj(1, zlib.DEFLATED, 31)
                out.write(pack.compress(record_head(key, url, base32_sha1(hashlib.sha1(body).digest()), len(body), target, http)))
                if target is None:
                    for a in range(0, len(body), READ_BYTES):
                        out.write(pack.compress(body[a : a + READ_BYTES]))
                out.write(pack.compress(b"\r\n\r\n") + pack.flush())
                n += 1
                if out.tell() >= archive_bytes:
                    out.close()
                    done.append((path, n))
                    out = None
        if out is not None:
            out.close()
            done.append((path, n))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names=["path", "records"])

    bounded_batches(rows.sparkSession)
    return written(rows.mapInArrow(run, "path string, records long"), "warc-index")[0]


class _Inflated:
    """The bytes of concatenated gzip members, a few at a time."""

    def __init__(self, file):
        self.file, self.inflate, self.raw, self.held = file, zlib.decompressobj(31), b"", bytearray()

    def more(self) -> bool:
        while True:
            if self.inflate.eof:
                self.raw, self.inflate = self.inflate.unused_data or self.raw, zlib.decompressobj(31)
            if not self.raw:
                self.raw = self.file.read(READ_BYTES)
                if not self.raw:
                    return False
            got = self.inflate.decompress(self.raw, READ_BYTES)
            self.raw = self.inflate.unconsumed_tail if not self.inflate.eof else b""
            if self.inflate.eof:
                self.raw = self.inflate.unused_data
                self.inflate = zlib.decompressobj(31)
            if got:
                self.held += got
                return True

    def head(self, end: bytes) -> bytes | None:
        """Up to and without `end`; None at the end of the file."""
        start = 0
        while (k := self.held.find(end, start)) < 0:
            start = max(0, len(self.held) - len(end) + 1)
            if len(self.held) > _LONGEST_HEAD:
                raise ValueError("a header has no end")
            if not self.more():
                if self.held.strip():
                    raise ValueError("the archive ends inside a header")
                return None
        found = bytes(self.held[:k])
        del self.held[: k + len(end)]
        return found

    def body(self, n: int, piece: int) -> Iterator[bytes]:
        while n:
            if not self.held and not self.more():
                raise ValueError("the archive ends inside a record")
            k = min(n, piece, len(self.held))
            got = bytes(self.held[:k])
            del self.held[:k]
            n -= k
            yield got


def _fields(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:])}


def _key(name: str | None) -> int | None:
    text = (name or "").strip("<>").removeprefix(_URN)
    return int(text) if text else None


CHUNKS = T.StructType(
    [T.StructField(n, t) for n, t in (("record_id", T.StringType()), ("page_id", T.LongType()), ("record_type", T.StringType()), ("refers_to", T.LongType()), ("chunk_no", T.LongType()), ("last", T.BooleanType()), ("bytes_so_far", T.LongType()), ("sha1_so_far", T.StringType()), ("declared_bytes", T.LongType()), ("declared_sha1", T.StringType()), ("data", T.BinaryType()))]
)


def read_chunks(index: DataFrame, folder: str, chunk_bytes: int = CHUNK_BYTES, with_data: bool = True) -> DataFrame:
    """Every record of the archives as rows of CHUNKS, one for each chunk of its payload and at least one for a record.

    Records whose payload differs from the declared digest or size, and archives that end early, raise ValueError.
    """

    def records(path: str) -> Iterator[tuple]:
        system, _ = opened(folder)
        with system.open_input_file(path) as file:
            source = _Inflated(file)
            while (raw := source.head(b"\r\n\r\n")) is not None:
                f = _fields(raw)
                left = int(f["content-length"])
                http = source.head(b"\r\n\r\n")
                left -= len(http) + 4
                sha, size, k, held = hashlib.sha1(), 0, 0, bytearray()
                own = (f["warc-record-id"], _key(f["warc-record-id"]), f["warc-type"], _key(f.get("warc-refers-to")))
                declared = (int(f["x-payload-length"]), f["warc-payload-digest"].removeprefix("sha1:"))
                for piece in source.body(left, chunk_bytes):
                    held += piece
                    while len(held) > chunk_bytes:
                        data = bytes(held[:chunk_bytes])
                        del held[:chunk_bytes]
                        sha.update(data)
                        size += len(data)
                        yield (*own, k, False, size, base32_sha1(sha.copy().digest()), *declared, data if with_data else None)
                        k += 1
                sha.update(held)
                size += len(held)
                found = base32_sha1(sha.digest())
                if own[2] == "response" and (size, found) != declared:
                    raise ValueError(f"{path}: the payload of {own[0]} is not what its header says")
                yield (*own, k, True, size, found, *declared, bytes(held) if with_data else None)
                if b"".join(source.body(4, 4)) != b"\r\n\r\n":
                    raise ValueError(f"{path}: {own[0]} does not end where it should")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("record_id", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("chunk_no", pa.int64()), ("last", pa.bool_()), ("bytes_so_far", pa.int64()), ("sha1_so_far", pa.string()), ("declared_bytes", pa.int64()), ("declared_sha1", pa.string()), ("data", pa.binary())])

        def made(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        rows, held = [], 0
        for batch in batches:
            for path in batch.column(0).to_pylist():
                for row in records(path):
                    rows.append(row)
                    held += len(row[-1] or b"")
                    if held >= 4 << 20 or len(rows) >= 2000:
                        yield made(rows)
                        rows, held = [], 0
        if rows:
            yield made(rows)

    archives = index.select("path")
    return archives.repartition(max(1, min(archives.count(), 20_000))).mapInArrow(run, CHUNKS)


def archived(pages: DataFrame, key: str = "page_id", payload: str = "html", least_bytes: int = 0, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Write every page as a WARC record, read the archives back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Null payloads are empty. Repeated rows are records each. Null urls leave the target out. An empty table gives no rows.
    For a revisit the size and digest are its headers', for a response those of the payload that was read.
    """
    folder = new_folder(pages.sparkSession, "warc")
    index = write_warcs(revisits(pages, key, payload, least_bytes, broadcast_rows), folder)
    whole = read_chunks(index, folder).filter("last")
    response = F.col("record_type") == "response"
    return whole.select("page_id", F.when(response, F.col("bytes_so_far")).otherwise(F.col("declared_bytes")).alias("payload_bytes"), F.when(response, F.col("sha1_so_far")).otherwise(F.col("declared_sha1")).alias("payload_digest"), "record_type", "refers_to")
