"""Embeddings of texts by latent semantic analysis: hashed TF-IDF weights and a seeded randomized SVD.

Each term falls into one of BUCKETS by its hash, so weights and vectors of buckets, a bounded number, are sent to wherever texts are read, and neither terms nor
texts are shuffled. A sample of chunks, bounded by SAMPLE, is the matrix that is decomposed: each bucket's row of signs projects the chunks to SIGNS numbers; products
of those, summed by tasks, give an orthonormal basis, onto which the buckets are projected in turn. A text's embedding is the weighted sum of
its buckets' vectors. Every text with a term has one: that of signs where the sample has none of its buckets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions.text import tokens
from lexloom.operators.postings import Postings
from lexloom.sources.tables import written

DIMENSION, SIGNS = 48, 64
BUCKETS = 1 << 16
#: Chunks of the sample, about.
SAMPLE = 200_000
#: Texts that are multiplied at once, and tasks that sum up matrices, at most.
AT_ONCE, MATRICES = 256, 32


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _hashed(counted: DataFrame, key: str) -> DataFrame:
    """(key, at, tf): the buckets of a text's terms and how often each term occurs. counted: (key, counts: array of (term, tf))."""
    return counted.select(key, F.transform("counts", lambda e: _bucket(e["term"])).alias("at"), F.transform("counts", lambda e: e["tf"]).alias("tf"))


def _signs() -> np.ndarray:
    return np.random.default_rng(42).integers(0, 2, (BUCKETS, SIGNS), dtype=np.int8) * np.int8(2) - np.int8(1)


def _weights(at: pa.Array, tf: pa.Array, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, weight) by row: weights of length 1 for each text with terms."""
    row = np.repeat(np.arange(len(at)), np.asarray(at.value_lengths().fill_null(0)))
    key, which = np.unique(row * BUCKETS + at.flatten().to_numpy(zero_copy_only=False), return_inverse=True)
    row, bucket = np.divmod(key, BUCKETS)
    x = (1 + np.log(np.bincount(which, tf.flatten().to_numpy(zero_copy_only=False), len(key)))) * idf[bucket]
    return row, bucket, x / np.sqrt(np.bincount(row, x * x, len(at)))[row]


def _parts(batches: Iterator[pa.RecordBatch], idf: np.ndarray) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Batches (key, at, tf) of AT_ONCE texts with their weights, of texts with terms."""
    for batch in batches:
        for a in range(0, batch.num_rows, AT_ONCE):
            some = batch.slice(a, AT_ONCE)
            some = some.filter(pa.array(np.asarray(some.column(1).value_lengths().fill_null(0)) > 0))
            if some.num_rows:
                yield some, *_weights(some.column(1), some.column(2), idf)


def _sum(row: np.ndarray, w: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    return np.add.reduceat(w[:, None] * vectors, np.flatnonzero(np.diff(row, prepend=-1)), axis=0)


def _totals(rows: DataFrame, made: Callable[[Iterator[pa.RecordBatch]], np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """The sum over all tasks of a matrix that each makes; `shape` numbers, a bounded number, come to the driver. Rows of zeros are left out on the way."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = made(batches)
        used = np.flatnonzero(total.any(axis=1))
        for a in range(0, len(used), 4096):
            own = used[a : a + 4096]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.ListArray.from_arrays(pa.array(np.arange(0, len(own) * shape[1] + 1, shape[1]), pa.int32()), pa.array(total[own].ravel()))], names=["i", "v"])

    # Each task makes a whole matrix, so there are few of them.
    summed = rows.coalesce(MATRICES).mapInArrow(run, "i int, v array<double>").groupBy("i").agg(*[F.sum(F.col("v")[j]).alias(f"_{j}") for j in range(shape[1])])
    out = np.zeros(shape)
    for r in summed.toLocalIterator():
        out[r[0]] = r[1:]
    return out


def _axes(gram: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Directions of the largest eigenvalues, `most` at most, and those; the sign of each is fixed by its largest number."""
    values, vectors = np.linalg.eigh(gram)
    keep = np.argsort(values)[::-1][:most]
    keep = keep[values[keep] > 1e-9 * max(1e-300, values.max())]
    found = vectors[:, keep]
    return found * np.sign(found[np.abs(found).argmax(axis=0), np.arange(found.shape[1])]), values[keep]


def fit(kept: Postings, dimension: int = DIMENSION, sample: int = SAMPLE) -> DataFrame:
    """(bucket, idf, v): weights of the buckets that the corpus has, BUCKETS at most, and vectors, of zeros where a sample of the chunks has none. An empty corpus gives none; a small one vectors of fewer dimensions."""
    spark = kept.counted.sparkSession
    hashed = _hashed(kept.counted, "chunk_id")
    n = kept.stats.first()["n"]
    idf = np.zeros(BUCKETS)
    for r in hashed.select(F.explode(F.array_distinct("at")).alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("df")).collect():  # BUCKETS rows at most
        idf[r["bucket"]] = np.log((n - r["df"] + 0.5) / (r["df"] + 0.5) + 1)
    if not idf.any():
        return spark.createDataFrame([], "bucket int, idf double, v array<double>")
    share = F.pmod(F.xxhash64("chunk_id", F.lit("sample")), F.lit(1 << 30)) / (1 << 30)
    chosen = written(hashed.filter(share < float(sample) / n), "sample")
    sent = spark.sparkContext.broadcast(idf)

    def projected(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        signs, total = _signs(), np.zeros((SIGNS, SIGNS))
        for _, row, bucket, w in _parts(batches, sent.value):
            x = _sum(row, w, signs[bucket])
            total += x.T @ x
        return total

    axes, values = _axes(_totals(chosen, projected, (SIGNS, SIGNS)), dimension)
    width = axes.shape[1]
    if not width:
        width, found = dimension, np.zeros((BUCKETS, dimension))
    else:
        onto = spark.sparkContext.broadcast(axes / np.sqrt(values))

        def summed(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
            signs, total = _signs(), np.zeros((BUCKETS, width))
            for _, row, bucket, w in _parts(batches, sent.value):
                basis = _sum(row, w, signs[bucket]) @ onto.value
                np.add.at(total, bucket, w[:, None] * basis[np.cumsum(np.diff(row, prepend=row[0]) > 0)])
            return total

        found = _totals(chosen, summed, (BUCKETS, width))
        turn, sizes = _axes(found.T @ found, width)
        found, width = found @ (turn / np.sqrt(sizes)), turn.shape[1]
    own = np.flatnonzero(idf)
    rows = pa.table({"bucket": pa.array(own, pa.int32()), "idf": pa.array(idf[own]), "v": pa.ListArray.from_arrays(pa.array(np.arange(0, len(own) * width + 1, width), pa.int32()), pa.array(found[own].ravel()))})
    return written(spark.createDataFrame(rows), "bucket-vectors")


def _embedded(counted: DataFrame, vectors: DataFrame, key: str, name: str) -> DataFrame:
    """(key, name) for each text with terms; counted: (key, counts)."""
    spark, names = counted.sparkSession, counted.schema[key].dataType.simpleString()
    known = vectors.toArrow()  # BUCKETS rows at most
    if not known.num_rows:
        return spark.createDataFrame([], f"{key} {names}, {name} array<double>")
    at, flat = known["bucket"].to_numpy(), known["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    idf, table = np.zeros(BUCKETS), np.zeros((BUCKETS, len(flat) // len(at)))
    idf[at], table[at] = known["idf"].to_numpy(), flat.reshape(len(at), -1)
    sent = spark.sparkContext.broadcast((idf, table))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, table = sent.value
        signs, width = _signs(), table.shape[1]
        for some, row, bucket, w in _parts(batches, idf):
            x = _sum(row, w, table[bucket])
            none = np.linalg.norm(x, axis=1) == 0
            if none.any():
                x[none] = _sum(row, w, signs[bucket][:, np.arange(width) % SIGNS])[none]
                x[np.linalg.norm(x, axis=1) == 0, 0] = 1.0
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            yield pa.RecordBatch.from_arrays([some.column(0), pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, width), pa.int32()), pa.array(x.ravel()))], names=[key, name])

    return _hashed(counted, key).mapInArrow(run, f"{key} {names}, {name} array<double>")


def embed_chunks(kept: Postings, vectors: DataFrame) -> DataFrame:
    """(chunk_id, embedding) of unit length for each indexed chunk with a term."""
    return _embedded(kept.counted, vectors, "chunk_id", "embedding")


def embed_queries(kept: Postings, vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, vector) for each query (query_id, query) with a term of the corpus, in the same space."""
    terms = queries.select("query_id", F.explode(tokens("query")).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("tf"))
    own = terms.join(kept.terms.select("term"), "term", "left_semi").groupBy("query_id").agg(F.collect_list(F.struct("term", "tf")).alias("counts"))
    return _embedded(own, vectors, "query_id", "vector")
