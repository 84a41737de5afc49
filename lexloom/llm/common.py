"""What the operators share: picking columns, bounded Arrow batches, the shared folder, models sent to executors."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.llm.storage import opened

#: Text bytes that a Python worker handles at once; one longer text is a slice of its own.
SLICE_BYTES = 6_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, *names: str, **renamed: str) -> DataFrame:
    """Columns by their exact names, also where others differ only in case or repeat; the first of equals counts."""
    at = {n: df.columns.index(n) for n in (*names, *renamed.values())}
    plain = by_place(df)
    wanted = {n: n for n in names} | renamed
    return plain.select(*[F.col(f"_c{at[source]}").alias(name) for name, source in wanted.items()])


def by_place(df: DataFrame) -> DataFrame:
    """The columns named by their place, so that equal names, or names equal but for case, do no harm."""
    return df.toDF(*[f"_c{i}" for i in range(len(df.columns))])


#: The session's Arrow limits that the operators need; plans read them when they run, so they stay set.
_LIMITS = {"spark.sql.execution.arrow.maxRecordsPerBatch": 2000, "spark.sql.execution.arrow.maxBytesPerBatch": 16 << 20}


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches by bytes as well as rows, so that long texts do not pile up in one. Tighter limits of the session stay."""
    for name, most in _LIMITS.items():
        found = re.match(r"\d+$", spark.conf.get(name, None) or "")
        if not found or not 0 < int(found[0]) <= most:
            spark.conf.set(name, str(most))


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where that is unset, a temporary one is set if all runs in this process; on a cluster, whose executors would not see it, ValueError.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        import tempfile

        where = f"file://{tempfile.mkdtemp(prefix='lexloom-')}"
        spark.conf.set("spark.checkpoint.dir", where)
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


_MADE: list[str] = []


@atexit.register
def _remove_made() -> None:
    """What a session put into the shared folder goes when its driver ends; no result outlives that."""
    for folder in _MADE:
        with contextlib.suppress(Exception):
            system, path = opened(folder)
            system.delete_dir(path)


def new_folder(spark: SparkSession, name: str) -> str:
    """A name of its own in the shared folder, removed at the end of the driver."""
    root = shared_root(spark)
    _MADE.append(f"{root if '://' in root else f'file://{root}'}/lexloom/{name}-{uuid.uuid4().hex}")
    return _MADE[-1]


def drop_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    if folder in _MADE:
        _MADE.remove(folder)


def made_so_far() -> list[str]:
    """The folders that this driver has made and not dropped, in their order."""
    return list(_MADE)


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The rows as a Parquet table in the shared folder, which outlives lost executors and cuts the lineage."""
    spark = df.sparkSession
    folder = new_folder(spark, name)
    plain = by_place(df)
    plain.write.parquet(folder)
    return spark.read.schema(plain.schema).parquet(folder).toDF(*df.columns), folder


def slices(batches: Iterator[pa.RecordBatch], text_at: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut so that the text of each is at most about `limit` bytes."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = np.fromiter((0 if n is None else n for n in pyarrow.compute.binary_length(batch.column(text_at)).to_pylist()), np.int64, batch.num_rows)
        part = np.cumsum(sizes + 1) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def give_back() -> None:
    """Return freed memory to the system at the end of a task: the worker lives on for other tasks, whose executor's memory it counts in."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def as_bytes(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def map_text(df: DataFrame, key: str, text: str, fields: list[T.StructField], work: Callable, carry: bool = False, verdict: str = "_verdict", limit: int = SLICE_BYTES) -> DataFrame:
    """Apply work(list of bytes or None) -> list of Arrow arrays, one for each field, to slices of rows of about `limit` bytes of text.

    Without `carry` the rows are (key, *fields). With it they are all columns of `df` and the struct `verdict` of the
    fields; it takes a name that `df` lacks.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    if carry:
        text_at = df.columns.index(text)
        source = by_place(df)
        schema = T.StructType([*source.schema.fields, T.StructField("_verdict", T.StructType(fields))])
    else:
        source, text_at = pick(df, key, text) if key != text else pick(df, key), 1 if key != text else 0
        schema = T.StructType([T.StructField(key, source.schema.fields[0].dataType), *fields])
    inner, outer = to_arrow_schema(T.StructType(fields)), to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_at, limit):
            made = [pa.array(a, f.type) if not isinstance(a, (pa.Array, pa.ChunkedArray)) else a.cast(f.type) for a, f in zip(work(as_bytes(batch.column(text_at))), inner)]
            columns = [*batch.columns, pa.StructArray.from_arrays(made, fields=list(inner))] if carry else [batch.column(0), *made]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) if c.type != f.type else c for c, f in zip(columns, outer)], schema=outer)
        give_back()

    bounded_batches(df.sparkSession)
    out = source.mapInArrow(run, schema)
    return out.toDF(*df.columns, verdict) if carry else out


def free_name(df: DataFrame, name: str) -> str:
    while name.lower() in {c.lower() for c in df.columns}:
        name = f"_{name}"
    return name


def keep_rows(df: DataFrame, verdict: str, test: Callable[[Column], Column]) -> DataFrame:
    """Rows whose verdict passes, without it; all other columns by position, so equal names do no harm."""
    names = df.columns
    plain = by_place(df)
    at = names.index(verdict)
    kept = plain.filter(test(F.col(f"_c{at}"))).drop(f"_c{at}")
    return kept.toDF(*[n for i, n in enumerate(names) if i != at])


def in_fold(key: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the key as text, modulo `folds`, is `fold`; a null key counts as the empty text."""
    return (F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % folds) == fold


# ---------------------------------------------------------------------------------------------- words of bytes

HASH_BLOCK = 1 << 17
_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get("p")
    if have is None or len(have) < n:
        n = max(n, 1 << 16)
        for name, base in (("p", _P), ("i", _PINV)):
            with np.errstate(over="ignore"):
                _POWERS[name] = np.concatenate([np.ones(1, np.uint64), np.full(n - 1, base, np.uint64)]).cumprod(dtype=np.uint64)
    return _POWERS["p"], _POWERS["i"]


def word_classes(separator: Callable[[int], bool]) -> np.ndarray:
    """Byte -> its lower case for A-Z, 0 where it separates words."""
    lower = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
    return np.where([separator(int(b)) for b in lower], 0, lower).astype(np.uint8)


#: Words of letters, digits and all that is not ASCII.
ALNUM = word_classes(lambda b: b <= 0x2F or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F)


class Words:
    """The words of a list of texts: start, end (in the joined bytes), a 64-bit hash and the text each belongs to."""

    def __init__(self, texts: list[bytes | None], classes: np.ndarray = ALNUM):
        self.joined = b"\0".join([t or b"" for t in texts]) + b"\0"
        self.folded = classes[np.frombuffer(self.joined, np.uint8)]
        inside = np.concatenate([[False], self.folded != 0])
        turn = np.flatnonzero(inside[1:] != inside[:-1])
        self.start, self.end = turn[0::2], turn[1::2]
        ends = np.cumsum([len(t or b"") + 1 for t in texts])
        self.first = np.searchsorted(self.start, np.concatenate([[0], ends[:-1]]) if len(texts) else [])
        self.count = np.diff(np.concatenate([self.first, [len(self.start)]])) if len(texts) else np.zeros(0, np.int64)
        self.hash = np.zeros(len(self.start), np.uint64)
        # Block by block, so that the sums stay small and in the cache.
        edges = np.searchsorted(self.start, np.arange(0, len(self.folded) + HASH_BLOCK, HASH_BLOCK))
        for i, j in zip(edges[:-1].tolist(), edges[1:].tolist()):
            if i < j:
                a, b = int(self.start[i]), int(self.end[j - 1])
                p, inverse = _powers(b - a + 1)
                with np.errstate(over="ignore"):
                    sums = np.zeros(b - a + 1, np.uint64)
                    np.cumsum(self.folded[a:b] * p[: b - a], dtype=np.uint64, out=sums[1:])
                    h = (sums[self.end[i:j] - a] - sums[self.start[i:j] - a]) * inverse[self.start[i:j] - a]
                    h ^= h >> np.uint64(31)
                    h *= np.uint64(0xBF58476D1CE4E5B9)
                    h ^= h >> np.uint64(29)
                self.hash[i:j] = h
        self.owner = np.repeat(np.arange(len(texts)), self.count)

    def word(self, i: int) -> bytes:
        return self.folded[self.start[i] : self.end[i]].tobytes()
