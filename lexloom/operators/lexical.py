"""BM25 over a batch of queries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lexloom.functions.text import tokens
from lexloom.operators.ranking import top_k

K1, B = 1.5, 0.75
#: What tasks hold of the queries as one matrix: its cells and its distinct terms; chunks that meet it at once. More queries are joined by their terms.
CELLS, TERMS_AT_ONCE, TILE = 1 << 22, 1 << 14, 512


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, qtf): a term that a query repeats counts as often."""
    return queries.select("query_id", F.explode(tokens("query")).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))


def index(chunks: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """(chunk_id, length, terms, and `carry`): the tokens of each chunk; empty chunks have length 0."""
    return chunks.select("chunk_id", tokens("chunk_text").alias("terms"), *carry).withColumn("length", F.size("terms"))


def corpus_stats(indexed: DataFrame) -> DataFrame:
    """One row: chunks and mean length, 0 for an empty corpus."""
    return indexed.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg("length"), F.lit(0.0)).alias("avgdl"))


def term_frequencies(indexed: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """(chunk_id, length, term, tf), of the given terms only if any; those are joined before the shuffle."""
    each = indexed.select("chunk_id", "length", F.explode("terms").alias("term"))
    if terms is not None:
        each = each.join(terms.select("term").distinct(), "term", "left_semi")
    return each.groupBy("chunk_id", "length", "term").agg(F.count(F.lit(1)).alias("tf"))


def idf(n: Column, df: Column) -> Column:
    return F.greatest(F.lit(0.0), F.log((n - df + 0.5) / (df + 0.5) + 1))


def document_frequencies(frequencies: DataFrame) -> DataFrame:
    """(term, df). Summed from tf, so that the frequencies below are the same plan as where tf is used, and shuffled once for both."""
    return frequencies.groupBy("term").agg(F.sum((F.col("tf") > 0).cast("long")).alias("df"))


def scores(chunks: DataFrame, queries: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, chunk_id, raw, matched_terms) of all pairs that share a term.

    Statistics are of the given chunks, so filter before to change them and after to keep them. All pairs are scored, which is for few queries or
    chunks; `postings` searches many.
    """
    asked = query_terms(queries)
    indexed = index(chunks)
    found = term_frequencies(indexed, asked)
    weighed = found.join(document_frequencies(found), "term").join(F.broadcast(corpus_stats(indexed)))  # one row
    norm = F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("avgdl"))
    part = idf(F.col("n"), F.col("df")) * F.col("tf") * (k1 + 1) / norm
    return asked.join(weighed.select("term", "chunk_id", part.alias("part")), "term").groupBy("query_id", "chunk_id").agg(F.sum(F.col("qtf") * F.col("part")).alias("raw"), F.count(F.lit(1)).cast("int").alias("matched_terms"))


def asked_matrix(entries: DataFrame) -> tuple[pa.Array, pa.Array, np.ndarray] | None:
    """Ids, terms and weights, terms down and queries across, of entries (query_id, term, w); None where that is more than tasks should hold."""
    rows = entries.select("query_id", "term", "w").limit(CELLS + 1).collect() if entries.select("term").distinct().limit(TERMS_AT_ONCE + 1).count() <= TERMS_AT_ONCE else None
    if rows is None or len(rows) > CELLS:
        return None
    ids, terms = (list(dict.fromkeys(r[i] for r in rows)) for i in (0, 1))
    if len(ids) * len(terms) > CELLS:
        return None
    across, down = ({x: i for i, x in enumerate(own)} for own in (ids, terms))
    weights = np.zeros((len(terms), len(ids)))
    for query, term, w in rows:
        weights[down[term], across[query]] = w
    return pa.array(ids, to_arrow_type(entries.schema["query_id"].dataType)), pa.array(terms, pa.string()), weights


def placed_terms(lists: pa.Array, terms: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which values of the lists are among `terms`, and for those the list and the term."""
    values = lists.flatten()
    found = pc.index_in(values, value_set=terms.cast(values.type))
    known = found.is_valid().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
    return known, row[known], found.drop_null().to_numpy()


def typed(df: DataFrame, name: str) -> str:
    return f"{name} {df.schema[name].dataType.simpleString()}"


def _counted(sent):
    """(chunk_id, terms) -> how many distinct terms each chunk shares with each query, where that is any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, terms, has = sent.value
        for batch in batches:
            for a in range(0, batch.num_rows, TILE):
                part = batch.slice(a, TILE)
                _, row, term = placed_terms(part.column(1), terms)
                own = np.zeros((part.num_rows, len(terms)), np.float32)
                own[row, term] = 1
                shared = own @ has
                row, query = np.nonzero(shared)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(query)), part.column(0).take(pa.array(row)), pa.array(shared[row, query].astype(np.int32))], names=["query_id", "chunk_id", "matched_terms"])

    return run


def matched(chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, chunk_id, matched_terms) of all pairs that share a term: how many distinct ones they share.

    Queries go to the tasks as one matrix, and each chunk's counts are made where it is read: nothing is shuffled. Queries that are too many for that are
    joined by their terms, as lists, one for each term, and counts are shuffled.
    """
    matrix = asked_matrix(queries.select("query_id", F.explode(F.array_distinct(tokens("query"))).alias("term"), F.lit(1.0).alias("w")))
    if matrix is not None:
        ids, terms, has = matrix
        out = f"{typed(queries, 'query_id')}, {typed(chunks, 'chunk_id')}, matched_terms int"
        if not len(ids):
            return chunks.sparkSession.createDataFrame([], out)
        sent = chunks.sparkSession.sparkContext.broadcast((ids, terms, has.astype(np.float32)))
        return chunks.select("chunk_id", tokens("chunk_text")).mapInArrow(_counted(sent), out)
    asking = queries.select("query_id", F.explode(F.array_distinct(tokens("query"))).alias("term")).groupBy("term").agg(F.collect_list("query_id").alias("_asking"))
    own = chunks.select("chunk_id", F.explode(F.array_distinct(tokens("chunk_text"))).alias("term"))
    return own.join(asking, "term").select("chunk_id", F.explode("_asking").alias("query_id")).groupBy("query_id", "chunk_id").agg(F.count(F.lit(1)).cast("int").alias("matched_terms"))


def best(scored: DataFrame, k: int) -> DataFrame:
    """The rows that can be among the k best of their query: all of at least the k-th score, to 6 places."""
    place = F.rank().over(Window.partitionBy("query_id").orderBy(F.round("raw", 6).desc()))
    return scored.withColumn("_place", place).filter(F.col("_place") <= k).drop("_place")


def order() -> list[Column]:
    """What orders the rows of a query: the score, then path, sequence and id."""
    return [F.round("raw", 6).desc(), F.col("structural_path"), F.col("sequence"), F.col("chunk_id")]


def search(chunks: DataFrame, queries: DataFrame, k: int, keep: Column | None = None, k1: float = K1, b: float = B) -> DataFrame:
    """The k best chunks of each query. `keep` filters chunks after scoring, so it does not change the statistics.

    Order: score to 6 places down, then path, sequence, id; only rows that can be among the best meet the chunks. Blank queries and
    k of 0 or less give nothing.
    """
    scored = scores(chunks, queries, k1, b)
    if keep is None:
        placed = best(scored, k).join(chunks.select("chunk_id", "structural_path", "sequence"), "chunk_id")
    else:
        placed = scored.join(chunks.select("chunk_id", "structural_path", "sequence", keep.alias("_keep")), "chunk_id").filter("_keep").drop("_keep")
    return top_k(placed, ["query_id"], order(), k).withColumn("score", F.round("raw", 4)).drop("raw")


def matches(source: str | None = None, kind: str | None = None, number: str | None = None, document: int | str | None = None) -> Column:
    """The lexical filter: source, type and number whatever their case, the document exactly."""
    test = F.lit(True)
    for name, value in (("source", source), ("regulation_type", kind), ("regulation_number", number)):
        if value:
            test = test & (F.lower(F.col(name)) == value.lower())
    return test if document is None else test & (F.col("document_id") == document)


def report(chunks: DataFrame) -> DataFrame:
    """One row: chunks, distinct terms, mean length to 2 places."""
    indexed = index(chunks)
    vocabulary = indexed.select(F.explode("terms").alias("term")).distinct().agg(F.count(F.lit(1)).alias("vocabulary_size"))
    return corpus_stats(indexed).join(F.broadcast(vocabulary)).select(F.col("n").alias("total_chunks"), "vocabulary_size", F.round("avgdl", 2).alias("avg_chunk_length"))
