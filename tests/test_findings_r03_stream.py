"""the version stream folds observations in the JVM before they are shuffled, with state for each version; batches, late rows and repeats give what one pass over the whole log gives."""

from __future__ import annotations

import random
from datetime import datetime, timedelta
from pathlib import Path

from lexloom.operators import registry
from lexloom.sources import snapshots
from lexloom.streaming import versions

LOG = "document_id long, sha256 string, observed_at timestamp_ntz"
COLUMNS = ("document_id", "sha256", "first_seen_at", "last_seen_at", "is_current")


def _rows(df):
    return sorted(map(tuple, df.select(*COLUMNS).collect()), key=str)


def _follow(spark, where):
    query = versions.follow(spark.readStream.schema(LOG).parquet(f"{where}/in"), f"file://{where}/out", f"file://{where}/state")
    query.awaitTermination()
    return query


def _arrive(spark, where, rows):
    spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(f"{where}/in")


def test_observations_are_folded_before_they_are_shuffled(spark, tmp_path):
    """No Python works on documents one by one, and what is shuffled has a row for each version of a task, not for each observation."""
    _arrive(spark, tmp_path, [(1, "a", datetime(2024, 1, 1)), (1, "a", datetime(2024, 1, 2))])
    plan = _follow(spark, tmp_path)._jsq.explainInternal(False)
    assert "Python" not in plan and "PySpark" not in plan and "Pandas" not in plan
    before, after = plan.split("Exchange hashpartitioning", 1)
    assert "StateStoreSave" in before and "StateStoreRestore" in before and "partial_min(observed_at" in after


def test_batches_give_what_the_whole_log_gives(spark, tmp_path):
    """Versions that a batch does not show stay, late observations move times and the current version, and buckets without a change keep their folder."""
    r = random.Random(7)
    many = [(r.choice([None, *range(200)]), r.choice("abcde"), datetime(2024, 1, 1) + timedelta(hours=r.randrange(30))) for _ in range(3000)]
    few = [(3, "f", datetime(2025, 1, 1)), (3, "a", datetime(2020, 1, 1)), (4, "z", datetime(2019, 1, 1)), (900, "a", datetime(2024, 1, 1)), (900, "b", datetime(2024, 1, 1))]
    seen = []
    for part in (many[:1500], many[1500:], few, [(3, "a", datetime(2018, 1, 1))]):
        before = snapshots.manifest(spark, f"file://{tmp_path}/out").tables.get(versions.TABLE, {})
        _arrive(spark, tmp_path, part)
        _follow(spark, tmp_path)
        seen += part
        assert _rows(versions.registry(spark, f"file://{tmp_path}/out")) == _rows(registry.versions(spark.createDataFrame(seen, LOG)))
    after = snapshots.manifest(spark, f"file://{tmp_path}/out").tables[versions.TABLE]
    assert len(after) == len(before) == snapshots.BUCKETS and sum(after[b] != before[b] for b in after) == 1


def test_a_batch_that_is_repeated_changes_nothing(spark, tmp_path):
    """A failure after the snapshot, or before it: the batch is worked out again from the state before it."""
    parts = [[(1, "a", datetime(2024, 1, 1)), (2, "b", datetime(2024, 1, 1))], [(1, "b", datetime(2024, 1, 2)), (1, "a", datetime(2023, 1, 1))], [(1, "a", datetime(2022, 1, 1)), (2, "c", datetime(2022, 1, 1))]]
    root = f"file://{tmp_path}/out"
    for n, lost in ((0, ()), (1, ("commits/1",)), (2, ("commits/2", "../out/manifests/v000000000003.json"))):
        _arrive(spark, tmp_path, parts[n])
        _follow(spark, tmp_path)
        for name in lost:
            file = Path(f"{tmp_path}/state/{name}").resolve()
            file.unlink()
            file.with_name(f".{file.name}.crc").unlink(missing_ok=True)
        _follow(spark, tmp_path)
        want = _rows(registry.versions(spark.createDataFrame(sum(parts[: n + 1], []), LOG)))
        assert _rows(versions.registry(spark, root)) == want and snapshots.manifest(spark, root).number == n + 1
