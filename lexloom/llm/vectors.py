"""Integer codes of vectors: equal consecutive parts, a codebook for each, exact arithmetic.

Components become whole numbers once. In every round the codebooks, at most parts x entries x width numbers, are broadcast; Arrow
batches compare all their parts with all entries by norm expansion on int64 matrix products, and each task sends one row of
sums and counts for each entry that it used. A grouped shuffle merges them, so what reaches the driver is one codebook, whatever the
number of vectors. No sum hangs on the order of rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.llm.common import bounded_batches, give_back, pick, written

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Vectors that are compared at once: their distances to one codebook take 8 MB.
AT_ONCE = 4096

Books = list[np.ndarray]


def most_component(width: int) -> int:
    """The largest whole component of vectors whose squared distances, over `width` components, surely fit a long."""
    return min(math.isqrt((1 << 61) // max(1, width)) // 2, (1 << 31) - 1)


def whole_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = SCALE) -> DataFrame:
    """(key, label, v): rows whose vector and components are there and finite, as whole numbers floor(scale * x)."""
    plain = pick(vectors, key=key, label=label, x=vector)
    sound = plain.filter("x is not null").filter(~F.exists("x", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))))
    return sound.select("key", "label", F.transform("x", lambda e: F.floor(e.cast("double") * scale)).alias("v"))


def nearest(x: np.ndarray, books: Books) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each part of the rows of `x`, the lower one of equals, and its squared distance."""
    width = books[0].shape[1]
    codes, far = np.empty((len(x), len(books)), np.int64), np.empty((len(x), len(books)), np.int64)
    for j, book in enumerate(books):
        part = x[:, j * width : (j + 1) * width]
        d = (part * part).sum(axis=1)[:, None] - 2 * (part @ book.T) + (book * book).sum(axis=1)
        codes[:, j] = d.argmin(axis=1)
        far[:, j] = np.take_along_axis(d, codes[:, j : j + 1], axis=1)[:, 0]
    return codes, far


def _rows(batch: pa.RecordBatch, at: int) -> Iterator[tuple[int, np.ndarray]]:
    """Blocks of vectors with the place of their first row."""
    column = batch.column(at)
    x = column.flatten().to_numpy().astype(np.int64).reshape(batch.num_rows, -1)
    for a in range(0, len(x), AT_ONCE):
        yield a, x[a : a + AT_ONCE]


def _sums(books):
    """(v) -> one row (part, entry, n, sums) for each entry that the task's vectors use."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = books.value
        n = [np.zeros(len(b), np.int64) for b in own]
        sums = [np.zeros(b.shape, np.int64) for b in own]
        for batch in batches:
            if batch.num_rows:
                for _, x in _rows(batch, 0):
                    codes, _ = nearest(x, own)
                    for j, book in enumerate(own):
                        order = np.argsort(codes[:, j], kind="stable")
                        used, first = np.unique(codes[order, j], return_index=True)
                        width = book.shape[1]
                        sums[j][used] += np.add.reduceat(x[order, j * width : (j + 1) * width], first, axis=0)
                        n[j] += np.bincount(codes[:, j], minlength=len(book))
        for j in range(len(own)):
            used = np.flatnonzero(n[j])
            if len(used):
                lists = pa.array(sums[j][used].tolist(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), j), pa.int32()), pa.array(used, pa.int32()), pa.array(n[j][used]), lists], names=["part", "entry", "n", "sums"])
        give_back()

    return run


def _coded(books):
    """(key, label, v) -> (key, label, code, error)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = books.value
        for batch in batches:
            if not batch.num_rows:
                continue
            names, errors = [], []
            for _, x in _rows(batch, 2):
                codes, far = nearest(x, own)
                names += [row.tobytes().hex() for row in codes.astype(np.uint8)]
                errors.append(far.sum(axis=1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(np.concatenate(errors), pa.int64())], names=["key", "label", "code", "error"])
        give_back()

    return run


def _next(kept: DataFrame, books: Books) -> Books:
    """Each entry replaced by the floor of the mean of its parts; unused entries stay."""
    spark = kept.sparkSession
    sent = spark.sparkContext.broadcast(books)
    partial = kept.select("v").mapInArrow(_sums(sent), "part int, entry int, n long, sums array<long>")
    merged = partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(books[0].shape[1])]).collect()
    sent.unpersist()
    out = [b.copy() for b in books]
    for part, entry, n, *sums in merged:  # one row for each entry of a codebook, whatever the number of vectors
        out[part][entry] = [int(s) // n for s in sums]
    return out


def codebooks_digest(books: Books) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for entry in b.tolist() for x in entry).encode()).hexdigest()


def compress(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """(key, code, error, label_error, codebooks_sha256) for each kept vector.

    Vectors that are null or hold null or non-finite components are dropped. All others have the length of the first kept vector by key, which
    must be a multiple of `parts`, or ValueError; those of another length, and those with components beyond `most_component`, whose
    distances fit no long, are left out as well. Rows that repeat a key are vectors of their own; null keys come last, equal keys in the order of their
    components. Fewer vectors than entries: smaller codebooks. Equal labels, null ones together, share `label_error`, null if their sum fits no long. An empty table
    gives no rows.
    """
    spark = vectors.sparkSession
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits for each part, so a codebook has 1 to 256 entries")
    sound = whole_vectors(vectors, key, vector, label, scale)
    order = (F.col("key").asc_nulls_last(), F.col("v"))
    first = sound.orderBy(*order).select(F.size("v").alias("n")).first()
    width = first["n"] if first else parts
    if width % parts:
        raise ValueError(f"vectors of {width} components have no {parts} equal parts")
    most = most_component(width // parts)
    fitting = sound.filter(F.size("v") == width).filter(~F.exists("v", lambda e: (e > most) | (e < -most))).select("key", "label", F.col("v").cast("array<int>").alias("v"))
    bounded_batches(spark)
    kept, _ = written(fitting, "whole-vectors")
    seeds = np.array([r["v"] for r in kept.orderBy(*order).select("v").limit(entries).collect()], np.int64)
    schema = T.StructType([T.StructField("key", kept.schema["key"].dataType), T.StructField("label", kept.schema["label"].dataType), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    if not width or not len(seeds):
        # Vectors without components have an empty part in each place: code 0 at no distance.
        rows = kept.select("key", "label", F.lit("00" * parts).alias("code"), F.lit(0).cast("long").alias("error"))
        books: Books = []
    else:
        books = [np.ascontiguousarray(seeds[:, j * width // parts : (j + 1) * width // parts]) for j in range(parts)]
        for _ in range(rounds):
            books = _next(kept, books)
        rows = kept.mapInArrow(_coded(spark.sparkContext.broadcast(books)), schema)
    coded, _ = written(rows, "coded")
    by_label = coded.groupBy(F.col("label").alias("_label")).agg(F.try_sum("error").alias("label_error"))
    out = coded.join(by_label, F.col("label").eqNullSafe(F.col("_label")))
    return out.select(F.col("key").alias(key), "code", "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256"))
