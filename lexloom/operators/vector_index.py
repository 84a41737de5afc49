"""An inverted file of vectors for cosine search with exact results.

Centroids come from a bounded sample. Every vector is filed under its nearest centroid, with the angle between them, and a cell keeps the
least and largest angle of its vectors. The angle between a query and a vector is at least the difference of their angles to any
centroid, so a cell, and within a cell every vector, has a bound on its cosine. A query first looks into the cells with the highest
bounds, which gives a k-th cosine, and then into those cells only whose bound is not below that; in each cell it compares
the vectors whose own bound is not below it. Cells are dealt into parts, and queries of a part into lots, of bounded size, so neither a cell that
holds a third of all vectors nor one that all queries visit is one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.operators.ranking import top_k
from lexloom.sources.tables import written

PLACES = 6
#: The most centroids, which are broadcast, and vectors of the sample for each.
MOST_CELLS, SAMPLE_EACH, ROUNDS = 1024, 16, 6
#: Vectors of a part of a cell, queries of a lot, about.
PART, LOT = 4096, 2048
#: Vectors that the first cells of a query hold at least, times k.
FIRST = 4
#: Angles are compared with this much to spare, which is far above what their arithmetic loses and below what cosines of 6 places show.
SPARE = 1e-7

_FOUND = "query_id long, chunk_id long, cosine double, compared long"


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def _angle(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1.0, 1.0))


@dataclass(frozen=True)
class Index:
    """cells: (cell, part, chunk_id, embedding, angle). For each cell its centroid, least and largest angle, vectors and parts."""

    cells: DataFrame
    centroids: np.ndarray
    low: np.ndarray
    high: np.ndarray
    size: np.ndarray
    parts: np.ndarray

    @property
    def total(self) -> int:
        return int(self.size.sum())


def centroids_of(sample: np.ndarray, cells: int, seed: int = 42) -> np.ndarray:
    """Unit centroids by a few rounds of means; those that no vector is nearest to stay as they are."""
    r = np.random.default_rng(seed)
    found = sample[r.choice(len(sample), cells, replace=False)]
    for _ in range(ROUNDS):
        nearest = (sample @ found.T).argmax(axis=1)
        sums = np.zeros_like(found)
        np.add.at(sums, nearest, sample)
        used = np.linalg.norm(sums, axis=1) > 0
        found[used] = unit(sums[used])
    return found


def build(vectors: DataFrame, cells: int | None = None) -> Index:
    """File all vectors (chunk_id, embedding); null ones are left out, those of another dimension than the first of the sample raise ValueError.

    `cells`: by default the square root of the number of vectors, MOST_CELLS at most. The sample is bounded. Vectors of no length count as being at a right
    angle to every centroid, as their cosine is 0 with any query.
    """
    spark = vectors.sparkSession
    sound = vectors.filter("embedding is not null").select(F.col("chunk_id").cast("long").alias("chunk_id"), "embedding")
    total = sound.count()
    n = min(MOST_CELLS, max(1, round(total**0.5))) if cells is None else max(1, min(cells, MOST_CELLS))
    sample = [r["embedding"] for r in sound.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(SAMPLE_EACH * n).collect()]  # a bounded number
    if not sample:
        return Index(spark.createDataFrame([], "cell int, part int, chunk_id long, embedding array<double>, angle double"), np.zeros((0, 0)), *(np.zeros(0) for _ in range(4)))
    dimension = len(sample[0])
    points = unit(np.array([v for v in sample if len(v) == dimension], np.float64))
    points = points[np.linalg.norm(points, axis=1) > 0]
    centroids = centroids_of(points, min(n, len(points))) if len(points) else np.eye(1, dimension)
    sent = spark.sparkContext.broadcast(centroids)

    def filed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            if batch.num_rows:
                if set(pc.list_value_length(batch.column(1)).to_pylist()) != {own.shape[1]}:
                    raise ValueError(f"a vector has not {own.shape[1]} dimensions")
                cosine = unit(matrix(batch.column(1))) @ own.T
                cell = cosine.argmax(axis=1)
                angle = _angle(cosine[np.arange(len(cell)), cell])
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), batch.column(0), batch.column(1).cast(pa.list_(pa.float64())), pa.array(angle)], names=["cell", "chunk_id", "embedding", "angle"])

    filed_rows = written(sound.mapInArrow(filed, "cell int, chunk_id long, embedding array<double>, angle double"), "vector-cells")
    # At most MOST_CELLS rows.
    stats = {r["cell"]: r for r in filed_rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("angle").alias("low"), F.max("angle").alias("high")).collect()}
    of = lambda name, none: np.array([stats[c][name] if c in stats else none for c in range(len(centroids))])
    size = of("n", 0).astype(np.int64)
    parts = np.maximum(1, -(-size // PART))
    table = spark.createDataFrame([(i, int(p)) for i, p in enumerate(parts)], "cell int, _parts int")
    placed = filed_rows.join(F.broadcast(table), "cell").withColumn("part", F.pmod(F.xxhash64("chunk_id"), "_parts").cast("int"))
    return Index(placed.select("cell", "part", "chunk_id", "embedding", "angle"), centroids, of("low", 0.0).astype(float), of("high", 0.0).astype(float), size, parts)


def _bounds(theta: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The highest cosine that a cell's vectors can have with queries at angles `theta` to its centroid."""
    gap = np.maximum(0.0, np.maximum(theta - high, low - theta))
    return np.cos(np.maximum(0.0, gap - SPARE))


def _visits(sent, k: int, first: bool):
    """(query_id, vector, least, bound) -> the parts of cells that a query visits: in the first pass those with the highest bounds, in the second all others that can hold one of its k best."""
    names = ["query_id", "vector", "least", "cell", "part", "theta"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids, low, high, size, parts = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            q = matrix(batch.column(1))
            if q.shape[1] != centroids.shape[1]:
                raise ValueError(f"query vectors have {q.shape[1]} dimensions, not {centroids.shape[1]}")
            u = unit(q)
            theta = _angle(u @ centroids.T)
            bound = _bounds(theta, low, high)
            bound[np.linalg.norm(u, axis=1) == 0] = 1.0  # a query of no length has the cosine 0 with all
            bound[:, size == 0] = -2.0
            order = np.lexsort((theta, -bound), axis=1)
            before = np.cumsum(size[order], axis=1) - size[order]
            early = np.zeros(bound.shape, bool)
            np.put_along_axis(early, order, before < FIRST * k, axis=1)
            early &= bound > -2.0
            least = batch.column(2).to_numpy(zero_copy_only=False).astype(np.float64)
            chosen = early if first else ~early & (bound >= np.where(np.isnan(least), -1.0, least)[:, None]) & (bound > -2.0)
            row, cell = np.nonzero(chosen)
            times = parts[cell]
            row, cell = np.repeat(row, times), np.repeat(cell, times)
            part = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
            for a in range(0, len(row), 2000):
                z = slice(a, a + 2000)
                at = pa.array(row[z])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), batch.column(2).take(at), pa.array(cell[z], pa.int32()), pa.array(part[z], pa.int32()), pa.array(theta[row[z], cell[z]])], names=names)

    return run


def _compared(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        if left.num_rows and right.num_rows:
            angle = right.column("angle").to_numpy()
            order = np.argsort(angle, kind="stable")
            angle, chunk = angle[order], right.column("chunk_id").to_numpy()[order]
            x = unit(matrix(right.column("embedding").combine_chunks()))[order]
            ids, least, theta = (left.column(c).to_numpy() for c in ("query_id", "least", "theta"))
            q = unit(matrix(left.column("vector").combine_chunks()))
            for i in range(len(q)):
                a, b = 0, len(angle)
                if least[i] > -1.0 and q[i].any():
                    far = np.arccos(min(1.0, least[i])) + SPARE
                    a, b = int(np.searchsorted(angle, theta[i] - far)), int(np.searchsorted(angle, theta[i] + far, side="right"))
                cosine = np.round(x[a:b] @ q[i], PLACES)
                best = np.lexsort((chunk[a:b], -cosine))[:k]
                out.append((np.full(len(best) + 1, ids[i]), np.append(chunk[a:b][best], -1), np.append(cosine[best], np.nan), np.append(np.zeros(len(best), np.int64), b - a)))
        ids, chunk, cosine, compared = (np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0),) * 4
        counted = compared.astype(np.int64)
        no = np.isnan(cosine.astype(float))
        return pa.table({"query_id": pa.array(ids.astype(np.int64)), "chunk_id": pa.array(chunk.astype(np.int64), mask=no), "cosine": pa.array(cosine.astype(float), mask=no), "compared": pa.array(counted)})

    return run


def _pass(index: Index, asked: DataFrame, k: int, first: bool) -> DataFrame:
    spark = asked.sparkSession
    sent = spark.sparkContext.broadcast((index.centroids, index.low, index.high, index.size, index.parts))
    visits = asked.mapInArrow(_visits(sent, k, first), "query_id long, vector array<double>, least double, cell int, part int, theta double")
    visits = written(visits, "visits")
    lots = visits.groupBy("cell", "part").agg(F.ceil(F.count(F.lit(1)) / LOT).alias("lots"))
    queries = visits.join(lots, ["cell", "part"]).withColumn("lot", F.pmod(F.xxhash64("query_id"), "lots")).drop("lots")
    vectors = index.cells.join(lots, ["cell", "part"]).withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("lots") - 1))).drop("lots")
    keys = ["cell", "part", "lot"]
    return queries.groupBy(*keys).cogroup(vectors.groupBy(*keys)).applyInArrow(_compared(k), _FOUND)


def search(index: Index, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """The k nearest vectors of each query (query_id, vector), exactly, as dense.nearest gives them; and (query_id, compared), how many vectors each was compared with.

    Null query vectors are left out; k of 0 or less, or an empty index, gives nothing.
    """
    spark = queries.sparkSession
    if k <= 0 or not index.total:
        return spark.createDataFrame([], "query_id long, chunk_id long, rank int, score double, distance double"), spark.createDataFrame([], "query_id long, compared long")
    asked = queries.filter("vector is not null").select(F.col("query_id").cast("long"), F.col("vector").cast("array<double>").alias("vector"))
    near = written(_pass(index, asked.withColumn("least", F.lit(-1.0)), k, True), "first-cells")
    best = top_k(near.filter("chunk_id is not null"), ["query_id"], [F.col("cosine").desc(), F.col("chunk_id")], k)
    # What counts to 6 places may lie half a place below.
    least = best.filter(F.col("rank") == k).select("query_id", (F.col("cosine") - 0.5 * 10**-PLACES - 1e-9).alias("least"))
    again = asked.join(least, "query_id", "left").select("query_id", "vector", F.coalesce("least", F.lit(-1.0)).alias("least"))
    found = written(near.unionByName(_pass(index, again, k, False)), "found-vectors")
    out = top_k(found.filter("chunk_id is not null"), ["query_id"], [F.col("cosine").desc(), F.col("chunk_id")], k)
    ranked = out.select("query_id", "chunk_id", "rank", F.greatest(F.lit(0.0), F.round("cosine", 4)).alias("score"), F.round(1 - F.col("cosine"), 4).alias("distance"))
    return ranked, found.groupBy("query_id").agg(F.sum("compared").alias("compared"))
