"""A stream of observations kept as a version registry: keyed state for each version of a document, published as snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexloom.operators.registry import mark_current
from lexloom.sources import snapshots
from lexloom.sources.tables import written

TABLE = "document_versions"
#: A state store whose state need not fit in memory.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _whole(spark: SparkSession, root: str, changed: DataFrame, last: snapshots.Manifest) -> DataFrame:
    """All versions of the documents of `changed`, which has the versions that a batch has moved: the others are those of the last snapshot."""
    old = snapshots.of(spark, root, TABLE, changed, found=last)
    if old is not None:
        changed = changed.unionByName(old.drop("is_current")).groupBy("document_id", "sha256").agg(F.min("first_seen_at").alias("first_seen_at"), F.max("last_seen_at").alias("last_seen_at"))
    return mark_current(changed)


def follow(observations: DataFrame, root: str, checkpoint: str) -> StreamingQuery:
    """Keep the versions of a stream (document_id, sha256, observed_at) as the table TABLE of snapshots at `root`, one snapshot for each batch.

    State, the first and last time of each version, grows with documents and what they showed, not with batches; late observations move either. A batch
    is folded to its versions before it is shuffled, and rewrites the buckets of the documents that it has. One that is repeated after
    a failure finds its number in the manifest and changes no snapshot. Observations without a digest or time are left out.
    """
    spark = observations.sparkSession
    sound = observations.filter("sha256 is not null and observed_at is not null").select("document_id", "sha256", observations["observed_at"].cast("timestamp_ntz").alias("observed_at"))
    before = spark.conf.get(STORE[0], None)
    spark.conf.set(*STORE)
    try:
        rows = sound.groupBy("document_id", "sha256").agg(F.min("observed_at").alias("first_seen_at"), F.max("observed_at").alias("last_seen_at"))

        def publish(batch: DataFrame, number: int) -> None:
            own = batch.sparkSession
            last = snapshots.manifest(own, root)
            if int(last.notes.get("batch", -1)) >= number:
                # Published before the failure; the state of the batch is worked out all the same, or Spark refuses to go on.
                batch.write.format("noop").mode("overwrite").save()
            else:
                # Written first, as rows are read more than once here and in a commit, and state is worked out once for a batch.
                changed = written(batch, "batch")
                snapshots.commit(own, root, {TABLE: snapshots.Change(written(_whole(own, root, changed, last), "versions"))}, notes={"batch": str(number)}, base=last)

        return rows.writeStream.outputMode("update").foreachBatch(publish).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        # The query has taken the setting over.
        spark.conf.unset(STORE[0]) if before is None else spark.conf.set(STORE[0], before)


def registry(spark: SparkSession, root: str) -> DataFrame | None:
    """The registry as of the last batch; None before the first."""
    return snapshots.read(spark, root, TABLE)
