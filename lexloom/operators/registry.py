"""The registry of regulations, documents and versions as snapshots: mutations are joins that give the next snapshot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REGULATION = ("source", "regulation_type", "regulation_number")
ALWAYS = ("title", "detail_url")
# Which responses are tried again and which fail at once.
RETRIED, REFUSED = (408, 429, 500, 502, 503, 504), (400, 401, 403, 404)


def _arrival(new: DataFrame, order: str | None) -> tuple[DataFrame, str]:
    """New rows with a column that tells their order: that of the column `order`, else that in which the rows lie."""
    return (new, order) if order else (new.withColumn("_arrival", F.monotonically_increasing_id()), "_arrival")


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str] = REGULATION, always: Sequence[str] = ALWAYS, order: str | None = None) -> DataFrame:
    """The next snapshot: rows of both; `always` columns come from new rows, others only where the new value is not null or empty.

    New rows of one key are taken one after another, by the column `order` or as they lie: the last value, or the last that is not empty, counts.
    """
    new, at = _arrival(new, order)
    others = [c for c in old.columns if c not in keys]
    filled = lambda c: F.when(F.col(c).cast("string") != "", F.col(at))
    folded = new.groupBy(*keys).agg(F.max(at).alias("_at"), *[F.max_by(c, F.col(at) if c in always else filled(c)).alias(c) for c in others])
    o, n = old.alias("o"), folded.alias("n")
    test = F.lit(True)
    for k in keys:
        test = test & (F.col(f"o.{k}") == F.col(f"n.{k}"))
    there = F.col("n._at").isNotNull()
    out = [F.coalesce(F.col(f"n.{k}"), F.col(f"o.{k}")).alias(k) for k in keys]
    for c in old.columns:
        if c not in keys:
            given = F.when(F.col(f"n.{c}").cast("string") != "", F.col(f"n.{c}"))
            out.append((F.when(there, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")) if c in always else F.coalesce(given, F.col(f"o.{c}"))).alias(c))
    return o.join(n, test, "full").select(*out)


def insert_if_absent(old: DataFrame, new: DataFrame, keys: Sequence[str], order: str | None = None) -> DataFrame:
    """Old rows untouched, and new ones whose key is not there yet: the first of each key, by the column `order` or as they lie."""
    new, at = _arrival(new, order)
    first = new.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(at))).filter("_n = 1").select(*old.columns)
    return old.unionByName(first.join(old.select(*keys).distinct(), list(keys), "left_anti"))


def versions(observations: DataFrame, tie: str = "sha256") -> DataFrame:
    """(document_id, sha256, first_seen_at, last_seen_at, is_current) of a log (document_id, sha256, observed_at).

    Current is the version first seen last: content that comes back does not become current again.
    """
    return mark_current(observations.groupBy("document_id", "sha256").agg(F.min("observed_at").alias("first_seen_at"), F.max("observed_at").alias("last_seen_at")), tie)


def mark_current(seen: DataFrame, tie: str = "sha256") -> DataFrame:
    """Versions (document_id, sha256, first_seen_at, last_seen_at), all that a document has, with is_current."""
    newest = F.row_number().over(Window.partitionBy("document_id").orderBy(F.col("first_seen_at").desc(), F.col(tie).desc())) == 1
    return seen.withColumn("is_current", newest)


def pointers(observations: DataFrame) -> DataFrame:
    """(document_id, sha256): what each document showed last; this can differ from the current version."""
    return observations.groupBy("document_id").agg(F.max_by("sha256", F.struct("observed_at", "sha256")).alias("sha256"))


def current_check(found: DataFrame) -> DataFrame:
    """One row: documents, and those without exactly one current version."""
    per = found.groupBy("document_id").agg(F.sum(F.col("is_current").cast("int")).alias("n"))
    return per.agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum((F.col("n") != 1).cast("long")), F.lit(0)).alias("violations"))


def replace(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Old rows of keys that the new rows do not have, and all new rows."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new)


def check_versions(rows: DataFrame, known: DataFrame) -> None:
    """Raise ValueError if a row's (document_id, version_id) is not known."""
    if rows.join(known, ["document_id", "version_id"], "left_anti").limit(1).count():
        raise ValueError("rows belong to a version that their document does not have")


def cascade(children: DataFrame, parents: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Children whose parent is still there."""
    return children.join(parents.select(*keys).distinct(), list(keys), "left_semi")


def current_chunks(chunks: DataFrame, found: DataFrame) -> DataFrame:
    """Chunks of current versions, on (document_id, sha256)."""
    return chunks.join(found.filter("is_current").select("document_id", "sha256"), ["document_id", "sha256"], "left_semi")


def storage_path(root: str, source: str, kind: str, document: str, sha: str, extension: str = "pdf") -> Column:
    return F.concat(F.concat_ws("/", F.lit(root), F.upper(source), F.upper(kind), F.col(document).cast("string"), F.col(sha)), F.lit(f".{extension}"))


def is_pdf(content: Column | str) -> Column:
    c = F.col(content) if isinstance(content, str) else content
    return F.coalesce(F.hex(F.substring(c, 1, 4)) == "25504446", F.lit(False))


def download_class(status: Column) -> Column:
    """ok, retry or fail by the response's status; no response is tried again."""
    return F.when(status.isNull() | status.isin(*RETRIED), "retry").when(status.between(200, 299), "ok").otherwise("fail")


def retry_delay(attempt: Column, status: Column, retries: int = 3, first: float = 1.0) -> Column:
    """Seconds to wait before the next attempt, doubled with each one; null where there is none: done, refused, or no retries left.

    attempt: from 1. Only responses that pass, and none at all, are tried again.
    """
    return F.when((download_class(status) == "retry") & (attempt <= retries), F.lit(first) * F.pow(F.lit(2.0), attempt - 1))


def ingestion_summary(log: DataFrame) -> DataFrame:
    """One row of counters of a download log (parsed, documents, status, content, known): a row for each document that was to be downloaded.

    parsed: whether the page that led there was read; documents: how many it showed, in its first row.
    """
    ok = download_class(F.col("status")) == "ok"
    total = lambda test: F.coalesce(F.sum(test.cast("long")), F.lit(0))
    return log.agg(
        F.count(F.lit(1)).alias("discovered"), total(F.col("parsed")).alias("metadata_parsed"), F.coalesce(F.sum("documents"), F.lit(0)).cast("long").alias("documents_found"), total(ok & ~F.col("known")).alias("downloaded"), total(ok & ~F.col("known")).alias("new_versions"), total(ok & F.col("known")).alias("skipped"), total(download_class(F.col("status")) == "retry").alias("retryable"),
        total(download_class(F.col("status")) == "fail").alias("failed"), total(ok & ~is_pdf("content")).alias("not_pdf"),
    )


def exposition(requests: DataFrame, labels: Sequence[str], value: str, counter: str, summary: str) -> DataFrame:
    """(line_no, line): counts and sums by label set in the text format of metrics, ordered by labels.

    Numbering the lines sorts them in one task, but there are only three for each label set, after aggregation.
    """
    text = F.concat_ws(",", *[F.concat(F.lit(f'{c}="'), F.col(c).cast("string"), F.lit('"')) for c in labels])
    per = requests.groupBy(*labels).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(value).cast("decimal(18,6)")).alias("total")).withColumn("_labels", text)
    rows = per.select("_labels", F.explode(F.array(F.struct(F.lit(1).alias("part"), F.concat(F.lit(f"{counter}{{"), "_labels", F.lit("} "), F.col("n").cast("string")).alias("line")), F.struct(F.lit(2).alias("part"), F.concat(F.lit(f"{summary}_sum{{"), "_labels", F.lit("} "), F.col("total").cast("decimal(28,6)").cast("string")).alias("line")), F.struct(F.lit(3).alias("part"), F.concat(F.lit(f"{summary}_count{{"), "_labels", F.lit("} "), F.col("n").cast("string")).alias("line")))).alias("x")).select("_labels", "x.*")
    return rows.withColumn("line_no", F.row_number().over(Window.orderBy(F.when(F.col("part") == 1, 1).otherwise(2), "_labels", "part"))).select("line_no", "line")
