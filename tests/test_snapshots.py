"""Snapshot tables: whole commits or none, several tables at once; changes propagated; a stream's state."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lexloom.operators import lexical, propagate, registry
from lexloom.sources import snapshots
from lexloom.sources.snapshots import Change
from lexloom.streaming import versions

NODES = "document_id long, version_id long, name string"


def nodes(spark, *rows):
    return spark.createDataFrame(list(rows), NODES)


def rows_of(spark, root, table, number=None):
    found = snapshots.read(spark, root, table, number)
    return None if found is None else sorted(map(tuple, found.collect()), key=str)


def test_documents_are_replaced_and_old_snapshots_stay(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    assert rows_of(spark, root, "nodes") is None and snapshots.manifest(spark, root).number == 0
    snapshots.commit(spark, root, {"nodes": Change(nodes(spark, (1, 1, "a"), (1, 1, "b"), (2, 1, "c"), (None, 1, "n")))})
    snapshots.commit(spark, root, {"nodes": Change(nodes(spark, (1, 2, "d"), (None, 2, "m"))), "other": Change(nodes(spark, (9, 9, "o")))})
    assert rows_of(spark, root, "nodes") == [(1, 2, "d"), (2, 1, "c"), (None, 2, "m")] and rows_of(spark, root, "other") == [(9, 9, "o")]
    assert rows_of(spark, root, "nodes", 1) == [(1, 1, "a"), (1, 1, "b"), (2, 1, "c"), (None, 1, "n")] and rows_of(spark, root, "other", 1) is None
    snapshots.commit(spark, root, {"nodes": Change(nodes(spark).filter("false"), removed=nodes(spark, (1, 0, ""), (2, 0, ""), (None, 0, "")))})
    assert rows_of(spark, root, "nodes") == []
    with pytest.raises(ValueError, match="no snapshot"):
        snapshots.read(spark, root, "nodes", 7)
    with pytest.raises(ValueError, match="other columns"):
        snapshots.commit(spark, root, {"nodes": Change(nodes(spark, (1, 1, "x")).drop("name"))})


def test_a_commit_that_is_killed_half_way_leaves_the_last_snapshot(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    many = spark.range(200).select(F.col("id").alias("document_id"), F.lit(1).cast("long").alias("version_id"), F.lit("old").alias("name"))
    snapshots.commit(spark, root, {"nodes": Change(many), "other": Change(many)})

    @F.udf("string")
    def dies(i):
        if i == 150:
            raise RuntimeError("killed")
        return "new"

    broken = many.withColumn("name", dies("document_id"))
    with pytest.raises(Exception, match="killed"):
        snapshots.commit(spark, root, {"nodes": Change(many.withColumn("name", F.lit("new"))), "other": Change(broken)})
    assert snapshots.manifest(spark, root).number == 1
    assert {r[2] for r in rows_of(spark, root, "nodes")} == {"old"} and len(rows_of(spark, root, "other")) == 200
    left = snapshots.clean(spark, root)
    assert left and all(name.startswith(("nodes-", "other-")) for name in left) and len(rows_of(spark, root, "nodes")) == 200
    snapshots.commit(spark, root, {"other": Change(many.filter("document_id < 5").withColumn("name", F.lit("new")))})
    assert len(rows_of(spark, root, "other")) == 200 and sum(r[2] == "new" for r in rows_of(spark, root, "other")) == 5


def test_two_commits_on_one_snapshot_cannot_both_publish(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    base = snapshots.manifest(spark, root)
    snapshots.commit(spark, root, {"nodes": Change(nodes(spark, (1, 1, "first")))}, base=base)
    with pytest.raises(snapshots.Conflict):
        snapshots.commit(spark, root, {"nodes": Change(nodes(spark, (1, 1, "second")))}, base=base)
    assert rows_of(spark, root, "nodes") == [(1, 1, "first")]


def test_rows_must_belong_to_versions_of_the_same_commit_or_the_last(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    known = spark.createDataFrame([(1, 1), (2, 5)], "document_id long, version_id long")
    snapshots.commit(spark, root, {"versions": Change(known), "nodes": Change(nodes(spark, (1, 1, "a")))}, "versions")
    snapshots.commit(spark, root, {"nodes": Change(nodes(spark, (2, 5, "b")))}, "versions")
    for wrong in ((1, 5, "x"), (3, 1, "x")):
        with pytest.raises(ValueError, match="version"):
            snapshots.commit(spark, root, {"nodes": Change(nodes(spark, wrong))}, "versions")
    assert rows_of(spark, root, "nodes") == [(1, 1, "a"), (2, 5, "b")]


def test_models_of_embeddings_live_side_by_side(spark, tmp_path):
    root, kind = f"file://{tmp_path}/t", "document_id long, embedding_model string, x int"
    keys = ("document_id", "embedding_model")
    snapshots.commit(spark, root, {"e": Change(spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "a", 3)], kind), keys)})
    snapshots.commit(spark, root, {"e": Change(spark.createDataFrame([(1, "a", 9)], kind), keys)})
    assert rows_of(spark, root, "e") == [(1, "a", 9), (1, "b", 2), (2, "a", 3)]


def test_old_folders_go(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    for i in range(4):
        snapshots.commit(spark, root, {"nodes": Change(nodes(spark, (1, i, "x")))})
    assert len(snapshots.clean(spark, root, keep=1)) == 3 and rows_of(spark, root, "nodes") == [(1, 3, "x")] and snapshots.clean(spark, root, keep=1) == []


def chunk_tables(spark, rows):
    chunks = spark.createDataFrame(rows, "document_id long, version_id long, chunk_id long, chunk_text string")
    return {"retrieval_chunks": chunks, "document_nodes": chunks.select("document_id", "version_id", F.col("chunk_id").alias("node_id")), "chunk_embeddings": chunks.select("document_id", "version_id", "chunk_id")}


def test_counts_after_changes_are_those_of_a_rebuild(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    first = [(d, 1, 10 * d + c, f"alpha beta d{d} c{c} " + "beta " * (d + c)) for d in range(6) for c in range(3)] + [(6, 1, 60, ""), (7, 1, 70, None)]
    tables = chunk_tables(spark, first)
    propagate.replace_documents(spark, root, tables["retrieval_chunks"], tables)
    second = [(1, 2, 11, "gamma alpha"), (2, 2, 21, ""), (8, 1, 80, "delta delta gamma")]
    changed = spark.createDataFrame([(1,), (2,), (3,), (8,), (99,)], "document_id long")
    propagate.replace_documents(spark, root, changed, chunk_tables(spark, second))
    now = [r for r in first if r[0] not in (1, 2, 3)] + second
    whole = chunk_tables(spark, now)["retrieval_chunks"]
    assert propagate.report(spark, root).collect() == lexical.report(whole).collect()
    df = lexical.document_frequencies(lexical.term_frequencies(lexical.index(whole)))
    assert rows_of(spark, root, propagate.TERMS) == sorted(map(tuple, df.collect()), key=str)
    for name in propagate.CHILDREN:
        assert sorted((r[0], r[1]) for r in rows_of(spark, root, name)) == sorted((d, v) for d, v, *_ in now)
    known = spark.createDataFrame([(1, 2)], "document_id long, version_id long")
    with pytest.raises(ValueError, match="version"):
        propagate.replace_documents(spark, root, known, chunk_tables(spark, [(1, 3, 11, "x")]), known)
    assert snapshots.manifest(spark, root).number == 2


LOG = "document_id long, sha256 string, observed_at timestamp_ntz"


def at(hours):
    return datetime(2024, 1, 1) + timedelta(hours=hours)


def test_stream_keeps_state_for_each_document_and_takes_late_observations(spark, tmp_path):
    source, root, checkpoint = (f"file://{tmp_path}/{n}" for n in ("in", "out", "cp"))
    parts = [
        [(1, "a", at(5)), (1, "b", at(9)), (2, "c", at(1)), (None, "z", at(1))],
        [(1, "a", at(12)), (2, "d", at(0)), (3, "e", at(2)), (3, "e", at(2)), (4, None, at(1)), (4, "x", None)],
        [(1, "b", at(2)), (2, "c", at(-4)), (2, "d", at(3))],  # b was there before a, c long before d
    ]
    seen = []
    for k, part in enumerate(parts, 1):
        spark.createDataFrame(part, LOG).coalesce(1).write.mode("append").parquet(source)
        versions.follow(spark.readStream.schema(LOG).parquet(source), root, checkpoint).awaitTermination()
        seen += [r for r in part if r[1] and r[2]]
        want = registry.versions(spark.createDataFrame(seen, LOG)).select("document_id", "sha256", "first_seen_at", "last_seen_at", "is_current")
        assert sorted(map(tuple, versions.registry(spark, root).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
        assert snapshots.manifest(spark, root).number == k
    # Nothing new: no batch, no snapshot.
    versions.follow(spark.readStream.schema(LOG).parquet(source), root, checkpoint).awaitTermination()
    assert snapshots.manifest(spark, root).number == 3
