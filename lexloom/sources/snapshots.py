"""Tables of documents as snapshots: a commit replaces rows of whole documents in several tables at once, or not at all.

A table lies in buckets by its document. A commit writes the buckets that it touches to folders of its own, with the rows of other documents
carried over, and then publishes a manifest that names the folder of each bucket. Readers follow the last manifest, so whatever a failed or
killed commit has written is never seen; two commits on the same manifest cannot both publish. What a commit reads and writes grows with the
buckets that it touches, and a manifest with tables and buckets, not with commits.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.sources.tables import pieces, written

#: Buckets of a table, fixed by the first commit; large corpora take thousands.
BUCKETS = 16


class Conflict(RuntimeError):
    """Another commit has published in between."""


@dataclass(frozen=True)
class Change:
    """New rows of a table; those of the same `keys` go, and with `removed` those of its keys too. The first key is the document."""

    rows: DataFrame
    keys: Sequence[str] = ("document_id",)
    removed: DataFrame | None = None


@dataclass(frozen=True)
class Manifest:
    number: int = 0
    #: table -> bucket -> folder
    tables: dict[str, dict[str, str]] = field(default_factory=dict)
    schemas: dict[str, dict] = field(default_factory=dict)
    buckets: int = BUCKETS
    #: What the committer wants to find again, such as the last batch of a stream.
    notes: dict[str, str] = field(default_factory=dict)


def _system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _numbers(spark: SparkSession, root: str) -> list[int]:
    system, where = _system(spark, f"{root}/manifests")
    names = [f.getPath().getName() for f in system.listStatus(where)] if system.exists(where) else []
    return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))


def manifest(spark: SparkSession, root: str, number: int | None = None) -> Manifest:
    """The last manifest, or one by its number; an empty one before the first commit. A number that is not there raises ValueError."""
    there = _numbers(spark, root)
    if number is not None and number and number not in there:
        raise ValueError(f"{root} has no snapshot {number}")
    if not there or number == 0:
        return Manifest()
    system, where = _system(spark, f"{root}/manifests/v{number or there[-1]:012d}.json")
    stream = system.open(where)
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return Manifest(**json.loads(text))


def read(spark: SparkSession, root: str, table: str, number: int | None = None, found: Manifest | None = None) -> DataFrame | None:
    """The rows of a table in the last snapshot or one by its number; None where the table is not in it."""
    at = found or manifest(spark, root, number)
    if table not in at.schemas:
        return None
    paths = sorted(f"{root}/data/{folder}/_bucket={bucket}" for bucket, folder in at.tables.get(table, {}).items())
    schema = T.StructType.fromJson(at.schemas[table])
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def _publish(spark: SparkSession, root: str, made: Manifest) -> None:
    """Rename a whole manifest into its place; a name that is taken is another commit's."""
    system, hidden = _system(spark, f"{root}/manifests/_{uuid.uuid4().hex}")
    final = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/manifests/v{made.number:012d}.json")
    system.mkdirs(hidden.getParent())
    out = system.create(hidden, True)
    try:
        out.write(bytearray(json.dumps(made.__dict__).encode()))
    finally:
        out.close()
    if system.exists(final) or not system.rename(hidden, final):
        system.delete(hidden, False)
        raise Conflict(f"snapshot {made.number} of {root} is there already")


def _bucket(key: str, buckets: int):
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int")


def _touched(spark: SparkSession, root: str, name: str, last: Manifest, buckets: Sequence[int]) -> DataFrame | None:
    """The rows of a table in some of its buckets."""
    return read(spark, root, name, found=replace(last, tables={name: {b: f for b, f in last.tables.get(name, {}).items() if int(b) in buckets}}))


def of(spark: SparkSession, root: str, table: str, documents: DataFrame, key: str = "document_id", found: Manifest | None = None) -> DataFrame | None:
    """The rows of a table whose document is one of the column `key` of `documents`; no other bucket is read. None where the table is not there."""
    at = found or manifest(spark, root)
    if table not in at.schemas:
        return None
    buckets = [r[0] for r in documents.select(_bucket(key, at.buckets)).distinct().collect()]  # at most the number of buckets
    return _touched(spark, root, table, at, buckets).alias("o").join(documents.alias("d"), F.col(f"o.{key}").eqNullSafe(F.col(f"d.{key}")), "left_semi")


def commit(spark: SparkSession, root: str, changes: dict[str, Change], versions: str | None = None, notes: dict[str, str] | None = None, base: Manifest | None = None, buckets: int = BUCKETS) -> Manifest:
    """Publish the next snapshot with all changes, or raise and leave the last one.

    With `versions`, a table (document_id, version_id, ...) of the same commit or of the last snapshot, all new rows of other tables must belong to one
    of its rows, or ValueError. Null keys are a document of their own. `base` is the manifest that the changes were made from (default: the last).
    """
    last = base or manifest(spark, root)
    last = last if last.number else replace(last, buckets=buckets)
    token = uuid.uuid4().hex
    tables, schemas = {t: dict(b) for t, b in last.tables.items()}, dict(last.schemas)
    for name, change in changes.items():
        document = change.keys[0]
        new = change.rows.withColumn("_bucket", _bucket(document, last.buckets))
        gone = new.select(*change.keys, "_bucket")
        if change.removed is not None:
            gone = gone.unionByName(change.removed.select(*change.keys).withColumn("_bucket", _bucket(document, last.buckets)))
        # Written first: rows are not made again for their keys, and the planner sends few keys along instead of shuffling the rows of the table.
        gone = written(gone.distinct(), "changed-keys")
        touched = [r[0] for r in gone.select("_bucket").distinct().collect()]  # at most the number of buckets
        old = _touched(spark, root, name, last, touched)
        rows = new
        if old is not None:
            if [(f.name, f.dataType) for f in old.schema] != [(f.name, f.dataType) for f in change.rows.schema]:
                raise ValueError(f"rows of {name} have other columns than the table")
            same = [F.col(f"o.{k}").eqNullSafe(F.col(f"g.{k}")) for k in change.keys]
            kept = old.withColumn("_bucket", _bucket(document, last.buckets)).alias("o").join(gone.alias("g"), same, "left_anti")
            rows = kept.unionByName(new)
        # What is made of much input is written by the tasks that have it, each its part of a bucket; little goes to one file a bucket.
        (rows if pieces(rows) else rows.repartition("_bucket")).write.partitionBy("_bucket").parquet(f"{root}/data/{name}-{token}")
        system, where = _system(spark, f"{root}/data/{name}-{token}")
        made = {f.getPath().getName().removeprefix("_bucket=") for f in system.listStatus(where) if f.isDirectory() and f.getPath().getName().startswith("_bucket=")}
        own = {b: f for b, f in tables.get(name, {}).items() if int(b) not in touched} | {b: f"{name}-{token}" for b in made}
        tables[name], schemas[name] = own, change.rows.schema.jsonValue()
    made = Manifest(last.number + 1, tables, schemas, last.buckets, {**last.notes, **(notes or {})})
    if versions is not None:
        known = read(spark, root, versions, found=made)
        for name, change in changes.items():
            if name != versions:
                owned = change.rows.select("document_id", "version_id").distinct()
                if known is None or owned.join(known.select("document_id", "version_id"), ["document_id", "version_id"], "left_anti").limit(1).count():
                    raise ValueError(f"rows of {name} belong to a version that their document does not have")
    _publish(spark, root, made)
    return made


def clean(spark: SparkSession, root: str, keep: int = 2) -> list[str]:
    """Remove what none of the last `keep` snapshots names: older manifests first, then the folders that only they, or commits that failed, have written. No commit may be under way."""
    numbers = _numbers(spark, root)
    named = {f for n in numbers[-keep:] for buckets in manifest(spark, root, n).tables.values() for f in buckets.values()}
    for n in numbers[:-keep]:
        system, where = _system(spark, f"{root}/manifests/v{n:012d}.json")
        system.delete(where, False)
    system, where = _system(spark, f"{root}/data")
    there = [f.getPath() for f in system.listStatus(where)] if system.exists(where) else []
    gone = [p for p in there if p.getName() not in named]
    for path in gone:
        system.delete(path, True)
    return sorted(p.getName() for p in gone)
