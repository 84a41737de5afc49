from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexloom.llm import vectors

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, parts=4, entries=256, rounds=4):
    """One vector after another, with whole numbers of any size."""
    kept = [(i, [math.floor(1024 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = len(kept[0][1]) // parts
    cut = lambda v, j: v[j * w : (j + 1) * w]
    books = [[cut(v, j) for _, v, _ in kept[:entries]] for j in range(parts)]

    def near(v, book):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), e) for e, c in enumerate(book))

    for _ in range(rounds):
        for j, book in enumerate(books):
            members = {}
            for _, v, _ in kept:
                members.setdefault(near(cut(v, j), book)[1], []).append(cut(v, j))
            books[j] = [[sum(x) // len(members[e]) for x in zip(*members[e])] if e in members else c for e, c in enumerate(book)]
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    coded = []
    for i, v, label in kept:
        best = [near(cut(v, j), books[j]) for j in range(parts)]
        coded.append((i, "".join(f"{e:02x}" for _, e in best), sum(d for d, _ in best), label))
    total = {}
    for _, _, error, label in coded:
        total[label] = total.get(label, 0) + error
    return sorted(((i, code, error, total[label], digest) for i, code, error, label in coded), key=str)


def got(df, **how):
    return sorted((tuple(r) for r in vectors.compress(df, **how).collect()), key=str)


def some_rows(n, width, seed=5):
    r = random.Random(seed)
    rows = [(i, [float(np.float32(r.gauss(0, 0.3))) for _ in range(width)], r.choice([0, 1, None])) for i in range(n)]
    rows += [(n + k, rows[3][1], 0) for k in range(n // 2)]  # a third of all rows are one vector
    r.shuffle(rows)
    return rows


def test_like_one_vector_after_another(spark):
    rows = some_rows(120, 8)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert got(df, entries=16) == plain(rows, entries=16)
    assert got(df, entries=16, rounds=1) == plain(rows, entries=16, rounds=1)
    assert got(df) == plain(rows)  # fewer entries than asked for are used


def test_ties_go_to_the_lower_entry_and_unused_entries_stay(spark):
    rows = [(i, [float(i % 3), 0.0, 1.0, -1.5], i % 2) for i in range(40)]
    assert got(spark.createDataFrame(rows, SCHEMA), entries=8) == plain(rows, entries=8)


def test_floors_go_down(spark):
    rows = [(1, [-0.0001, 0.0001, -1.0, 0.9999], 1), (2, [-0.0021, 0.5, -2.5, 1.0], None)]
    assert got(spark.createDataFrame(rows, SCHEMA), entries=1) == plain(rows, entries=1)


def test_odd_vectors(spark):
    sound = some_rows(30, 4)
    odd = [(100, None, 1), (101, [1.0, None, 2.0, 3.0], 1), (102, [float("nan"), 0.0, 0.0, 0.0], None), (103, [0.0, float("inf"), 0.0, 0.0], None), (104, [0.0, float("-inf"), 0.0, 0.0], 0), (None, [0.1, 0.2, 0.3, 0.4], None), (5, [0.4, 0.3, 0.2, 0.1], 7), (5, [0.4, 0.3, 0.2, 0.1], 7)]
    out = got(spark.createDataFrame(sound + odd, SCHEMA).repartition(4), entries=16)
    assert out == plain(sound + odd, entries=16)
    left_out = [(200, [1.0, 2.0], 0), (201, [1e30, 0.0, 0.0, 0.0], 0), (202, [], 1)]
    assert got(spark.createDataFrame(sound + left_out, SCHEMA), entries=16) == plain(sound, entries=16)


def test_clashing_columns_empty_tables_and_bad_widths(spark):
    rows = some_rows(20, 4)
    df = spark.createDataFrame(rows, SCHEMA).select("*", F.lit("x").alias("code"), F.lit(1).alias("key"), F.lit(2).alias("V"), F.lit(3).alias("Embedding"), F.lit(4).alias("x"))
    assert got(df, entries=4) == plain(rows, entries=4)
    empty = vectors.compress(spark.createDataFrame([], SCHEMA))
    assert empty.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and empty.count() == 0
    with pytest.raises(ValueError, match="no 4 equal parts"):
        vectors.compress(spark.createDataFrame([(1, [1.0, 2.0, 3.0], 0)], SCHEMA))
    with pytest.raises(ValueError, match="1 to 256"):
        vectors.compress(df, entries=257)


def test_distances_are_exact_for_large_components(spark):
    most = vectors.most_component(1)
    rows = [(1, [float(most // 1024 - 70_000)] * 4, 1), (2, [-float(most // 1024 - 70_000)] * 4, 2), (3, [0.0] * 4, 3)]
    assert got(spark.createDataFrame(rows, SCHEMA.replace("float", "double")), entries=1, rounds=0) == plain(rows, entries=1, rounds=0)
    one = [(i, v, 1) for i, v, _ in rows]
    assert {r["label_error"] for r in vectors.compress(spark.createDataFrame(one, SCHEMA.replace("float", "double")), entries=1, rounds=0).collect()} == {None}
