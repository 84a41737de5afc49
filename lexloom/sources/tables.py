"""Tables that searches keep: written once to the folder that driver and executors share, read by whatever follows."""

from __future__ import annotations

import atexit
import contextlib
import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_MADE: list[tuple[SparkSession, str]] = []
_KEPT: dict[tuple, object] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset and all runs in this process, a temporary one is set, and on a cluster ValueError."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        import tempfile

        where = f"file://{tempfile.mkdtemp(prefix='lexloom-')}"
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


#: Bytes of input files for each partition of what is sorted and joined by document.
EACH = 8 << 20


def pieces(df: DataFrame, each: int | None = None) -> int | None:
    """How many partitions have about `each` bytes of the files that the rows come from; None for fewer than there are cores, which the planner deals out."""
    spark = df.sparkSession
    size = 0
    for name in df.inputFiles():
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        size += path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).getLen()
    n = -(-size // (each or EACH))
    return n if n >= spark.sparkContext.defaultParallelism else None


def drop(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@atexit.register
def _drop_made() -> None:
    for spark, folder in _MADE:
        with contextlib.suppress(Exception):
            drop(spark, folder)


def folder(spark: SparkSession, name: str) -> str:
    """A name of its own in the shared folder; what is there goes when the driver ends."""
    root = shared_root(spark)
    _MADE.append((spark, f"{root if '://' in root else f'file://{root}'}/lexloom/{name}-{uuid.uuid4().hex}"))
    return _MADE[-1][1]


#: Whether shuffle files of a query go as soon as it ends; sessions without this setting keep them until their driver collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows, written to the shared folder and read from there; lost executors cost nothing that is written, and what was shuffled on the way is dropped at once."""
    where = folder(df.sparkSession, name)
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        df.write.parquet(where)
    finally:
        conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(where)


def kept(spark: SparkSession, key: tuple, make: Callable[[], object]) -> object:
    """What `make` gives, made once for a key in a session."""
    whole = (spark.sparkContext.applicationId, *key)
    if whole not in _KEPT:
        _KEPT[whole] = make()
    return _KEPT[whole]
