"""Reciprocal rank fusion of two ranked lists, and re-ranking of what they give."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions.text import strip, word_set
from lexloom.operators.lexical import best, order
from lexloom.operators.ranking import top_k
from lexloom.sources.tables import written

RRF_K = 60


def _tail() -> list[Column]:
    """What orders equal scores: the branch ranks, then path, sequence, id."""
    return [F.asc_nulls_last("dense_rank"), F.asc_nulls_last("lexical_rank"), F.col("structural_path"), F.col("sequence"), F.col("chunk_id")]


def _side(rows: DataFrame, name: str) -> DataFrame:
    return rows.select("query_id", "chunk_id", F.col("rank").alias(f"{name}_rank"), F.col("score").alias(f"{name}_score"))


def fuse(dense: DataFrame, lexical: DataFrame, chunks: DataFrame, k: int, rrf_k: int = RRF_K, queries: DataFrame | None = None) -> DataFrame:
    """Both lists (query_id, chunk_id, rank, score) joined in full: a chunk scores 1 / (rrf_k + rank) for each list it is in.

    Only keys, ranks and scores pass the join; path and sequence come from `chunks`. Scores are rounded to 6 places
    before ordering. A negative rrf_k, or k of 0 or less, gives nothing; with `queries` so do those whose text is blank.
    """
    both = _side(dense, "dense").join(_side(lexical, "lexical"), ["query_id", "chunk_id"], "full")
    if queries is not None:
        both = both.join(asking(queries), "query_id", "left_semi")
    return _fused(both.join(chunks.select("chunk_id", "structural_path", "sequence"), "chunk_id"), k, rrf_k)


def asking(queries: DataFrame) -> DataFrame:
    """The queries that have any text."""
    return queries.filter(F.coalesce(strip("query"), F.lit("")) != "")


def hybrid(dense: DataFrame, scored: DataFrame, chunks: DataFrame, lexical_k: int, k: int, rrf_k: int = RRF_K, carry: tuple[str, ...] = ()) -> DataFrame:
    """As fuse, from lexical scores (query_id, chunk_id, raw) instead of a ranked list: chunks are looked up once, for candidates of both lists.

    carry: columns of `chunks` that come along.
    """
    candidates = best(scored, lexical_k).select("query_id", "chunk_id", "raw").join(_side(dense, "dense"), ["query_id", "chunk_id"], "full")
    # Few rows, written first, so that the planner knows it and sends them along instead of shuffling the texts of all chunks.
    candidates = written(candidates, "candidates-of-both")
    found = candidates.join(chunks.select("chunk_id", "structural_path", "sequence", *carry), "chunk_id")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.asc("_other"), *order()))
    placed = found.withColumn("_other", F.col("raw").isNull()).withColumn("_place", place).withColumn("lexical_rank", F.when(F.col("raw").isNotNull() & (F.col("_place") <= lexical_k), F.col("_place")))
    ranked = placed.withColumn("lexical_score", F.when(F.col("lexical_rank").isNotNull(), F.round("raw", 4))).filter("lexical_rank is not null or dense_rank is not null")
    return _fused(ranked.drop("raw", "_other", "_place"), k, rrf_k)


def _fused(both: DataFrame, k: int, rrf_k: int) -> DataFrame:
    """The k best of rows with ranks of both lists, path and sequence."""
    if rrf_k < 0 or k <= 0:
        both = both.filter("false")
    part = lambda r: F.coalesce(1.0 / (rrf_k + F.col(r)), F.lit(0.0))
    method = F.when(F.col("dense_rank").isNotNull() & F.col("lexical_rank").isNotNull(), "hybrid").when(F.col("dense_rank").isNotNull(), "dense_only").otherwise("lexical_only")
    scored = both.withColumn("fused_score", F.round(part("dense_rank") + part("lexical_rank"), 6)).withColumn("retrieval_method", method)
    return top_k(scored, ["query_id"], [F.col("fused_score").desc(), *_tail()], k)


def report(fused: DataFrame) -> DataFrame:
    """Per query: rows in all, with a dense rank, with a lexical rank, and with both, counted in the fused list."""
    return fused.groupBy("query_id").agg(F.count(F.lit(1)).alias("fused"), F.count("dense_rank").alias("dense"), F.count("lexical_rank").alias("lexical"), F.sum((F.col("retrieval_method") == "hybrid").cast("long")).alias("hybrid"))


def overlap_score(query: Column | str, text: Column | str, fused: Column | str) -> Column:
    """A stand-in for a cross encoder: 1.5 for each word that query and text share, and the fused score."""
    shared = F.size(F.array_intersect(word_set(query), word_set(text)))
    return F.round(F.lit(1.5) * shared + (F.col(fused) if isinstance(fused, str) else fused), 4)


def rerank(fused: DataFrame, queries: DataFrame, chunks: DataFrame | None, n: int, score: Callable[[str, str, str], Column] = overlap_score) -> DataFrame:
    """The n best of each query by `score` of (query, contextual_text, fused_score), with rerank_rank and rerank_score.

    The texts are joined to the candidates only; without `chunks` the candidates carry them, and keep them. `score` may be a pandas UDF that holds
    a model. Order: score, fused score, then as fused.
    """
    candidates = fused.drop("rank").join(queries.select("query_id", "query"), "query_id")
    if chunks is not None:
        candidates = candidates.join(chunks.select("chunk_id", "contextual_text"), "chunk_id")
    scored = candidates.withColumn("rerank_score", score("query", "contextual_text", "fused_score")).drop("query", *(["contextual_text"] if chunks is not None else []))
    return top_k(scored, ["query_id"], [F.col("rerank_score").desc(), F.col("fused_score").desc(), *_tail()], max(0, n), "rerank_rank")


def rerank_report(queries: DataFrame, fused: DataFrame, reranked: DataFrame, model: str = "word-overlap") -> DataFrame:
    """Per query: the model, how many candidates went in and how many rows came out; 0 for queries without any."""
    count = lambda rows, name: rows.groupBy("query_id").agg(F.count(F.lit(1)).alias(name))
    rows = queries.select("query_id").join(count(fused, "candidates_in"), "query_id", "left").join(count(reranked, "reranked_out"), "query_id", "left")
    return rows.select("query_id", F.lit(model).alias("model_name"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("candidates_in", "reranked_out")])
