"""Every query of the library against its SQL on the smallest tables, and that none is empty."""

from __future__ import annotations

from collections import Counter

import duckdb
import pytest

from lexloom.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    made = duckdb.connect()
    for t in "documents embeddings pages benchmark labels conversations events".split():
        made.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return made


def plain(v):
    return [plain(x) for x in v] if isinstance(v, (list, tuple)) else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v


def test_all_have_sql():
    assert set(registry.QUERIES) == set(registry.ORACLES)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    got, want = registry.QUERIES[name](spark, SF), con.sql(registry.ORACLES[name])
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    rows = Counter(repr([plain(r[c]) for c in names]) for r in got.collect())
    assert rows == Counter(repr([plain(r[want.columns.index(c)]) for c in names]) for r in want.fetchall())
    assert rows
