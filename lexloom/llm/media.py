"""Media columns: archives of images, and a Spark data source that reads them by byte ranges.

An archive is members behind each other, then an index of their offsets, then a footer that finds the index. The data
source lists a directory of archives and plans byte ranges; a range owns the members that start in it. Each task reads the index,
streams its members as Arrow batches, and reads a member that fails again from its own offset, without the others.
"""

from __future__ import annotations

import hashlib
import struct
import time
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lexloom.llm.common import as_bytes, bounded_batches, new_folder, pick, slices
from lexloom.llm.storage import files, make_folder, opened, publish

UNIT = 576
SUFFIX = ".arc"
ARCHIVE_BYTES = 64 << 20
#: The least bytes of a range, and the most ranges that are planned.
RANGE_BYTES, MOST_RANGES = 8 << 20, 100_000
BATCH_BYTES = 4 << 20
RETRIES = 4

_HEAD = struct.Struct("<4sBqQQI")  # magic, has key, key, unpadded bytes, media bytes, crc32 of the media
_FOOT = struct.Struct("<QQ8s")  # place of the index, members, magic
_MEMBER, _INDEX = b"MEMB", b"LOOMIDX1"


def padded(text: bytes) -> bytes:
    """The text and bytes 255 up to a positive multiple of the unit."""
    units = max(1, -(-len(text) // UNIT))
    return text + b"\xff" * (units * UNIT - len(text))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes) -> bytes:
    """A grey 8-bit PNG, a unit wide, whose samples are the payload; lossless."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
    lines = np.zeros((len(rows), UNIT + 1), np.uint8)  # each line begins with filter 0: none
    lines[:, 1:] = rows
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", struct.pack(">IIBBBBB", UNIT, len(rows), 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + _chunk(b"IEND", b"")


def from_png(media: bytes) -> bytes:
    """The samples of a PNG that to_png made; damaged ones raise ValueError."""
    if media[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, data, size = 8, [], (0, 0)
    while at < len(media):
        n, kind = struct.unpack(">I4s", media[at : at + 8])
        body = media[at + 8 : at + 8 + n]
        if struct.unpack(">I", media[at + 8 + n : at + 12 + n])[0] != zlib.crc32(kind + body):
            raise ValueError("a PNG chunk is damaged")
        if kind == b"IHDR":
            size = struct.unpack(">II", body[:8])
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(size[1], size[0] + 1)
    if lines[:, 0].any():
        raise ValueError("a filter that to_png does not use")
    return lines[:, 1:].tobytes()


class _Archive:
    """One archive while it is written: a temporary file that is renamed when complete."""

    def __init__(self, folder: str, name: str, attempt: str):
        self.system, base = opened(folder)
        self.final, self.temporary = f"{base}/{name}{SUFFIX}", f"{base}/_{name}-{attempt}.tmp"
        self.out = self.system.open_output_stream(self.temporary)
        self.at, self.offsets = 0, []

    def add(self, key: int | None, n_bytes: int, media: bytes) -> None:
        self.offsets.append(self.at)
        head = _HEAD.pack(_MEMBER, key is not None, key or 0, n_bytes, len(media), zlib.crc32(media))
        self.out.write(head)
        self.out.write(media)
        self.at += len(head) + len(media)

    def close(self) -> int:
        self.out.write(np.array(self.offsets, "<u8").tobytes())
        self.out.write(_FOOT.pack(self.at, len(self.offsets), _INDEX))
        self.out.close()
        self.size = self.at + 8 * len(self.offsets) + _FOOT.size
        publish(self.system, self.temporary, self.final)
        return len(self.offsets)


def write_archives(docs: DataFrame, folder: str, key: str = "doc_id", text: str = "text", archive_bytes: int = ARCHIVE_BYTES) -> tuple[int, int, int]:
    """Store each text (null: empty) as a padded PNG member of archives in the folder; gives how many archives, members and bytes."""
    make_folder(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        archive, n, members, size = None, 0, 0, 0
        for batch in slices(batches, 1):
            for k, t in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))):
                if archive is None:
                    archive = _Archive(folder, f"part-{task.partitionId():06d}-{n:04d}", str(task.taskAttemptId()))
                    n += 1
                archive.add(k, len(t or b""), to_png(padded(t or b"")))
                if archive.at >= archive_bytes:
                    members += archive.close()
                    size += archive.size
                    archive = None
        if archive is not None:
            members += archive.close()
            size += archive.size
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (n, members, size)], names=["archives", "members", "bytes"])

    bounded_batches(docs.sparkSession)
    plain = pick(docs, key=key, text=text).selectExpr("cast(key as long) key", "text")
    total = plain.mapInArrow(run, "archives long, members long, bytes long").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("archives", "members", "bytes")]).first()
    return tuple(total)


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int


def _again(what, retries: int):
    """Run it until it gives a result; the last failure goes on."""
    for n in range(retries + 1):
        try:
            return what()
        except (OSError, ValueError):
            if n == retries:
                raise
            time.sleep(0.05 * 2**n)


class ArchiveReader(DataSourceReader):
    def __init__(self, options):
        self.folder = options["folder"]
        self.range_bytes = int(options.get("range_bytes", 0))
        self.retries = int(options.get("retries", RETRIES))
        self.expected = [int(options[n]) if n in options else None for n in ("archives", "bytes")]

    def partitions(self) -> list[Range]:
        """Ranges of RANGE_BYTES, or of more where that would be more than MOST_RANGES. Other archives than expected raise ValueError."""
        there = files(self.folder, SUFFIX)
        for want, got, what in zip(self.expected, (len(there), sum(size for _, size in there)), ("archives", "bytes")):
            if want is not None and want != got:
                raise ValueError(f"{self.folder} shows {got} {what}; {want} were written")
        step = self.range_bytes or max(RANGE_BYTES, -(-sum(size for _, size in there) // MOST_RANGES))
        found = [Range(path, a, min(a + step, size)) for path, size in there for a in range(0, size, step)]
        return found or [Range("", 0, 0)]

    def _index(self, path: str) -> tuple[np.ndarray, int]:
        system, _ = opened(self.folder)
        with system.open_input_file(path) as file:
            size = file.size()
            place, n, magic = _FOOT.unpack(file.read_at(_FOOT.size, size - _FOOT.size))
            if magic != _INDEX:
                raise ValueError(f"{path} has no index")
            return np.frombuffer(file.read_at(8 * n, place), "<u8").astype(np.int64), place

    def member(self, path: str, offset: int, end: int, raw: bytes | None = None) -> tuple[int | None, int, bytes]:
        """The member at the offset, checked; `raw` saves reading where its bytes are at hand."""
        if raw is None:
            system, _ = opened(self.folder)
            with system.open_input_file(path) as file:
                raw = file.read_at(end - offset, offset)
        magic, has_key, key, n_bytes, n, crc = _HEAD.unpack(raw[: _HEAD.size])
        media = raw[_HEAD.size :]
        if magic != _MEMBER or len(media) != n or zlib.crc32(media) != crc:
            raise ValueError(f"{path} is damaged at {offset}")
        return key if has_key else None, n_bytes, media

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        path = partition.path
        offsets, place = _again(lambda: self._index(path), self.retries)
        ends = np.append(offsets[1:], place)
        mine = np.flatnonzero((offsets >= partition.start) & (offsets < partition.end))
        system, _ = opened(self.folder)
        for a, b in self._runs(ends[mine] - offsets[mine]):
            own = mine[a:b]
            first = int(offsets[own[0]])
            try:
                with system.open_input_file(path) as file:
                    block = file.read_at(int(ends[own[-1]]) - first, first)
            except OSError:
                block = b""
            rows = []
            for i in own.tolist():
                o, e = int(offsets[i]), int(ends[i])
                try:
                    rows.append(self.member(path, o, e, block[o - first : e - first]))
                except (OSError, ValueError, struct.error):
                    rows.append(_again(lambda o=o, e=e: self.member(path, o, e), self.retries))
            keys, sizes, media = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=["key", "n_bytes", "media"])

    @staticmethod
    def _runs(sizes: np.ndarray) -> list[tuple[int, int]]:
        part = np.cumsum(sizes) // BATCH_BYTES
        cut = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sizes)]
        return [(a, b) for a, b in zip(cut, cut[1:]) if b > a]


class MediaArchives(DataSource):
    """format("media_archives"), options folder, range_bytes, retries: (key, n_bytes, media) of all archives in the folder.

    Options archives and bytes tell how much there must be; a folder that shows other archives is an error, not fewer rows.
    """

    @classmethod
    def name(cls) -> str:
        return "media_archives"

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField("key", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)


def read_archives(spark: SparkSession, folder: str, **options) -> DataFrame:
    spark.dataSource.register(MediaArchives)
    reader = spark.read.format("media_archives").option("folder", folder)
    for k, v in options.items():
        reader = reader.option(k, str(v))
    return reader.load()


def feature(samples: bytes) -> str:
    """Mean, deviation and the shares of 16 brightness bands, of all samples."""
    x = np.frombuffer(samples, np.uint8)
    counts = np.bincount(x, minlength=256)
    values = np.arange(256)
    mean = float(counts @ values) / len(x)
    deviation = max(0.0, float(counts @ (values * values)) / len(x) - mean * mean) ** 0.5
    bands = counts.reshape(16, 16).sum(axis=1)
    return f"{mean:.4f} {deviation:.4f} " + " ".join(f"{b / len(x):.4f}" for b in bands)


FEATURES = T.StructType(
    [T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("n_bytes", T.LongType()), ("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()), ("media_bytes", T.LongType()), ("media_sha256", T.StringType()), ("feature", T.StringType()))]
)


def media_features(stored: DataFrame) -> DataFrame:
    """doc_id, sizes, digests and the feature of each stored member, from the samples decoded from it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, n, media in zip(*(c.to_pylist() for c in batch.columns)):
                samples = from_png(media)
                rows.append((key, n, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(samples)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) if i else pa.array(c, pa.int64()) for i, c in enumerate(zip(*rows))], names=FEATURES.names)

    bounded_batches(stored.sparkSession)
    return stored.mapInArrow(run, FEATURES)


def media_table(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Store all texts in archives, read them back through the data source and describe them (columns of FEATURES).

    Null and empty texts give one unit of bytes 255. A null key stays null. Repeated rows are members each. An empty table
    gives no rows. The archives stay in the shared folder while their rows are used; if the driver does not see all that was written, ValueError.
    """
    folder = new_folder(docs.sparkSession, "media")
    archives, _, size = write_archives(docs, folder, key, text)
    return media_features(read_archives(docs.sparkSession, folder, archives=archives, bytes=size))
