"""Cosine search over a batch of query vectors, and vector providers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions.text import _col
from lexloom.operators import vector_index
from lexloom.operators.ranking import top_k
from lexloom.operators.vector_index import PLACES
from lexloom.operators.vector_index import matrix as _matrix
from lexloom.operators.vector_index import unit as _unit

#: Query vectors that are broadcast; more of them search an index. Vectors that are compared with them at once.
QUERIES_AT_ONCE, TILE = 4096, 512
FOUND = "query_id long, chunk_id long, cosine double"


def _first(query: np.ndarray, chunk: np.ndarray, cosine: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k rows of each query with the highest cosines, ties by chunk."""
    order = np.lexsort((chunk, -cosine, query))
    query, chunk, cosine = query[order], chunk[order], cosine[order]
    keep = np.arange(len(query)) - np.searchsorted(query, query) < k
    return query[keep], chunk[keep], cosine[keep]


def _searched(sent, k: int):
    """(chunk_id, embedding) -> the k best of a whole partition for each query of the block, from tiles of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, q = sent.value
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        rows = 0

        def folded() -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            return [_first(*(np.concatenate(x) for x in zip(*held)), k)] if held else []

        for batch in batches:
            for a in range(0, batch.num_rows, TILE):
                part = batch.slice(a, TILE)
                x, chunk = _matrix(part.column(1)), part.column(0).to_numpy()
                if x.shape[1] != q.shape[1]:
                    raise ValueError(f"a vector has {x.shape[1]} dimensions, queries have {q.shape[1]}")
                cosine = np.round(_unit(x) @ q.T, PLACES)
                m = min(k, len(chunk))
                row, query = np.nonzero(cosine >= np.partition(cosine, len(chunk) - m, axis=0)[len(chunk) - m])
                held.append(_first(query, chunk[row], cosine[row, query], k))
                rows += len(held[-1][0])
                if rows > 16 * k * len(own):
                    held = folded()
                    rows = len(held[0][0])
        for query, chunk, cosine in folded():
            yield pa.RecordBatch.from_arrays([pa.array(own[query]), pa.array(chunk), pa.array(cosine)], names=["query_id", "chunk_id", "cosine"])

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int, dimension: int | None = None) -> DataFrame:
    """(query_id, chunk_id, rank, score, distance): the k nearest vectors of each query, nearest first, ties by id.

    Up to QUERIES_AT_ONCE queries (query_id, vector) go to the tasks as one matrix, and vectors are read once; a task keeps k candidates of each query,
    so what is shuffled grows with partitions, not with pairs. More queries search an index that is made of the vectors (`vector_index`), with the same
    rows. Null vectors are left out; one of another dimension is an error. Cosines count to 6 places; scores are rounded to 4 and not negative.
    """
    spark = vectors.sparkSession
    none = spark.createDataFrame([], "query_id long, chunk_id long, rank int, score double, distance double")
    if k <= 0:
        return none
    asked = queries.filter("vector is not null").select(F.col("query_id").cast("long"), F.col("vector").cast("array<double>").alias("vector"))
    kept = vectors.filter("embedding is not null").select(F.col("chunk_id").cast("long").alias("chunk_id"), "embedding")
    block = asked.limit(QUERIES_AT_ONCE + 1).collect()
    if not block:
        return none
    if dimension is not None and {len(r["vector"]) for r in block} != {dimension}:
        raise ValueError(f"query vectors have not {dimension} dimensions")
    if len(block) > QUERIES_AT_ONCE:
        return vector_index.search(vector_index.build(kept), asked, k)[0]
    sent = spark.sparkContext.broadcast((np.array([r[0] for r in block]), _unit(np.array([r[1] for r in block], np.float64))))
    found = kept.mapInArrow(_searched(sent, k), FOUND)
    best = top_k(found, ["query_id"], [F.col("cosine").desc(), F.col("chunk_id")], k)
    return best.select("query_id", "chunk_id", "rank", F.greatest(F.lit(0.0), F.round("cosine", 4)).alias("score"), F.round(1 - F.col("cosine"), 4).alias("distance"))


def norm(vector: Column | str) -> Column:
    return F.sqrt(F.aggregate(_col(vector), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def mock_embedding(text: Column | str, dimension: int) -> Column:
    """A unit vector made of the text's SHA-256: a stand-in that needs no model and is the same everywhere. Null is empty."""
    digest = F.unhex(F.sha2(F.coalesce(_col(text), F.lit("")), 256))
    byte = lambda d, i: F.conv(F.hex(F.substring(d, i % 32 + 1, F.lit(1))), 16, 10).cast("double")
    # Digest and norm are each worked out once, as the one value of an array.
    raw = F.transform(F.array(digest), lambda d: F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), lambda i: byte(d, i) / 127.5 - 1.0 + i * 0.0001))
    return F.transform(raw, lambda v: F.transform(F.array(norm(v)), lambda n: F.transform(v, lambda x: x / n))[0])[0]


def dimension_report(embeddings: DataFrame, chunks: DataFrame, dimension: int) -> DataFrame:
    """One row: chunks, vectors, vectors of another dimension, and whether all is right (no chunks at all is)."""
    v = embeddings.agg(F.count(F.lit(1)).alias("embedded"), F.coalesce(F.sum((F.size("embedding") != dimension).cast("long")), F.lit(0)).alias("wrong_dimension"))
    c = chunks.agg(F.count(F.lit(1)).alias("total_chunks"))
    return c.join(F.broadcast(v)).withColumn("is_valid", (F.col("wrong_dimension") == 0) & ((F.col("total_chunks") == 0) | (F.col("embedded") > 0)))
