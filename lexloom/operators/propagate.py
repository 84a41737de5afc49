"""What follows from a change of documents: their nodes, chunks and embeddings, and the counts of the lexical index, in one snapshot.

Counts are corrected by what the changed documents had and have; nothing else is read again: not the texts of other documents, and of the term
counts only those of terms that the change has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.operators.lexical import index
from lexloom.operators.postings import counted_terms
from lexloom.sources import snapshots
from lexloom.sources.snapshots import Change, Manifest
from lexloom.sources.tables import written

#: Tables of a document's version, from the one that others are made of to the last.
CHILDREN = ("document_nodes", "retrieval_chunks", "chunk_embeddings")
#: A row of POSTINGS is a chunk with its length and its distinct terms with their frequencies.
POSTINGS, TERMS, STATS = "chunk_terms", "term_counts", "corpus_totals"


def _of(spark: SparkSession, root: str, table: str, documents: DataFrame, base: Manifest) -> DataFrame | None:
    rows = snapshots.read(spark, root, table, found=base)
    return None if rows is None else rows.join(documents, "document_id", "left_semi")


def replace_documents(spark: SparkSession, root: str, documents: DataFrame, tables: dict[str, DataFrame], versions: DataFrame | None = None) -> Manifest:
    """Publish what the changed documents (document_id) have now: rows of the CHILDREN tables, of their current versions.

    All rows of these documents go, in every table, so a version that was demoted, or a document without new rows, leaves none behind. `retrieval_chunks` has
    chunk_id and chunk_text, which postings, lengths, term counts and totals are made from. With `versions` the registry's rows of these documents are replaced
    too, and new rows must belong to one of the registry's versions.
    """
    base = snapshots.manifest(spark, root)
    gone = written(documents.select("document_id").distinct(), "changed-documents")
    chunks = tables["retrieval_chunks"]
    # A chunk's terms are counted where its text is read and stay one row; of them only counts of terms are shuffled.
    keyed = chunks.select(F.struct("document_id", "version_id", "chunk_id").alias("chunk_id"), "chunk_text")
    added = written(counted_terms(index(keyed)).select("chunk_id.*", "length", "counts"), "changed-terms")
    df = lambda rows, sign: rows.select(F.explode("counts.term").alias("term")).groupBy("term").agg((sign * F.count(F.lit(1))).alias("d"))
    total = lambda rows, sign: rows.agg((sign * F.count(F.lit(1))).alias("n"), (sign * F.coalesce(F.sum("length"), F.lit(0))).alias("total_length"))
    changes, totals = df(added, 1), total(added, 1)
    old = _of(spark, root, POSTINGS, gone, base)
    known, sums = (snapshots.read(spark, root, t, found=base) for t in (TERMS, STATS))
    if old is not None:
        changes, totals = changes.unionByName(df(old, -1)), totals.unionByName(total(old, -1))
    delta = changes.groupBy("term").agg(F.sum("d").alias("d")).filter("d <> 0")
    if known is not None:
        delta = delta.join(known, "term", "left").select("term", (F.coalesce("df", F.lit(0)) + F.col("d")).alias("df"))
    else:
        delta = delta.withColumnRenamed("d", "df")
    delta = written(delta.select("term", F.col("df").cast("long").alias("df")), "changed-counts")
    if sums is not None:
        totals = totals.unionByName(sums.select("n", "total_length"))
    stats = totals.agg(F.sum("n").cast("long").alias("n"), F.sum("total_length").cast("long").alias("total_length")).select(F.lit("corpus").alias("of"), "n", "total_length")
    made = {name: Change(tables[name], removed=gone) for name in CHILDREN if name in tables}
    made |= {POSTINGS: Change(added, removed=gone), TERMS: Change(delta.filter("df > 0"), ("term",), delta.select("term")), STATS: Change(stats, ("of",))}
    if versions is not None:
        made["document_versions"] = Change(versions, removed=gone)
        known_versions = versions.select("document_id", "version_id")
        for name in CHILDREN:
            if name in tables and tables[name].select("document_id", "version_id").distinct().join(known_versions, ["document_id", "version_id"], "left_anti").limit(1).count():
                raise ValueError(f"rows of {name} belong to a version that their document does not have")
    return snapshots.commit(spark, root, made, base=base)


def report(spark: SparkSession, root: str) -> DataFrame:
    """As lexical.report, from the counts that are kept."""
    vocabulary = snapshots.read(spark, root, TERMS).agg(F.count(F.lit(1)).alias("vocabulary_size"))
    mean = F.when(F.col("n") > 0, F.col("total_length") / F.col("n")).otherwise(0.0)
    return snapshots.read(spark, root, STATS).join(F.broadcast(vocabulary)).select(F.col("n").alias("total_chunks"), "vocabulary_size", F.round(mean, 2).alias("avg_chunk_length"))  # one row
