"""The inverted file gives the rows of a comparison with all vectors, and compares few of them where vectors lie in clusters."""

from __future__ import annotations

import random

import numpy as np
import pytest

from lexloom.operators import dense, vector_index

VECTORS = "chunk_id long, embedding array<double>"
ASKED = "query_id long, vector array<double>"


def brute(rows, asked, k):
    out = []
    for q, v in asked:
        v = np.array(v)
        found = []
        for c, x in rows:
            x = np.array(x)
            n = np.linalg.norm(v) * np.linalg.norm(x)
            found.append((-round(float(v @ x) / n, 6) if n else 0.0, c))
        out += [(q, c, rank) for rank, (_, c) in enumerate(sorted(found)[:k], 1)]
    return sorted(out)


def got(spark, rows, asked, k, **how):
    index = vector_index.build(spark.createDataFrame(rows, VECTORS).repartition(3), **how)
    found, compared = vector_index.search(index, spark.createDataFrame(asked, ASKED), k)
    return sorted((r["query_id"], r["chunk_id"], r["rank"]) for r in found.collect()), {r["query_id"]: r["compared"] for r in compared.collect()}


def clusters(n, of, width, seed, spread=0.05):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(of, width))
    return [(i, (centres[i % of] + spread * r.normal(size=width)).tolist()) for i in range(n)]


def test_like_all_vectors_on_clusters_with_few_compared(spark):
    rows = clusters(1200, 24, 16, 1)
    asked = [(i, v) for i, v in rows if i % 40 == 0]
    found, compared = got(spark, rows, asked, 7)
    assert found == brute(rows, asked, 7)
    assert sum(compared.values()) < len(rows) * len(asked) / 3 and max(compared.values()) <= len(rows)


def test_like_all_vectors_on_noise_ties_and_zero_vectors(spark):
    r = random.Random(2)
    rows = [(i, [r.choice([-1.0, 0.0, 1.0]) for _ in range(3)]) for i in range(200)]  # many equal, opposite and zero vectors
    asked = [(i, [r.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(3)]) for i in range(25)] + [(99, [0.0, 0.0, 0.0])]
    for k in (1, 5, 300):
        found, compared = got(spark, rows, asked, k)
        assert found == brute(rows, asked, k)
        assert set(compared) == {q for q, _ in asked} and max(compared.values()) <= len(rows)


def test_hot_cells_and_lots_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(vector_index, "PART", 16)
    monkeypatch.setattr(vector_index, "LOT", 4)
    rows = clusters(150, 5, 8, 3) + [(1000 + i, [1.0] * 8) for i in range(150)]  # a third and more are one vector
    asked = [(i, [1.0] * 8) for i in range(20)] + [(100 + i, v) for i, v in rows[:10]]
    index = vector_index.build(spark.createDataFrame(rows, VECTORS))
    assert index.cells.groupBy("cell", "part").count().agg({"count": "max"}).first()[0] < 40
    assert got(spark, rows, asked, 9)[0] == brute(rows, asked, 9)


def test_many_queries_go_to_an_index(spark, monkeypatch):
    rows = clusters(200, 6, 5, 4)
    asked = [(i, v) for i, v in rows[:30]]
    vectors, queries = spark.createDataFrame(rows, VECTORS), spark.createDataFrame(asked, ASKED)
    plain = sorted(map(tuple, dense.nearest(vectors, queries, 4).collect()))
    monkeypatch.setattr(dense, "QUERIES_AT_ONCE", 10)
    assert sorted(map(tuple, dense.nearest(vectors, queries, 4).collect())) == plain


def test_nulls_empty_tables_and_dimensions(spark):
    rows = clusters(30, 3, 4, 5)
    asked = [(1, rows[1][1]), (2, None)]
    assert got(spark, [*rows, (900, None)], asked, 3)[0] == brute(rows, asked[:1], 3)
    assert got(spark, [], asked, 3) == ([], {}) and got(spark, rows, asked, 0) == ([], {}) and got(spark, rows, [], 3) == ([], {})
    assert got(spark, [(1, [0.0, 0.0])], [(1, [1.0, 0.0])], 2)[0] == [(1, 1, 1)]
    with pytest.raises(Exception, match="dimensions"):
        got(spark, [*rows, (900, [1.0])], asked, 3)
    with pytest.raises(Exception, match="dimensions"):
        got(spark, rows, [(1, [1.0])], 3)
