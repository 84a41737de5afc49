"""A re-ranker that learns: features of query and chunk in DataFrame operations, weights by pairwise logistic regression.

Training needs no labels: passages of chunks, with words left out, are queries, and the chunks that hold them, and equal texts, are what each looks for.
Only the features of a bounded number of passages come to the driver; scoring is a column expression.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions.text import tokens
from lexloom.operators.postings import Postings, asked_terms
from lexloom.operators.ranking import top_k

#: Words that a passage spans, and which of four it leaves out.
SPAN, LEFT_OUT = 16, 3
FEATURES = ("lexical", "coverage", "rarity", "adjacent", "near", "length")
#: Steps of training, their size and the weight of the squared weights.
STEPS, RATE, RIDGE = 300, 0.5, 1e-3


def passages(chunks: DataFrame) -> DataFrame:
    """(query_id, query, digest): of each chunk of at least SPAN words, from a third of its length on, SPAN words without every fourth; and the digest of the whole text."""
    found = chunks.select("chunk_id", "chunk_text", tokens("chunk_text").alias("_t")).filter(F.size("_t") >= SPAN)
    start = F.least(F.floor(F.size("_t") / 3), F.size("_t") - SPAN).cast("int")
    span = F.slice("_t", start + 1, SPAN)
    kept = F.filter(span, lambda _, i: i % 4 != LEFT_OUT)
    return found.select(F.col("chunk_id").alias("query_id"), F.array_join(kept, " ").alias("query"), F.sha2("chunk_text", 256).alias("digest"))


def _pairs(words: Column, gap: int) -> Column:
    """The pairs of words `gap` places apart, in order."""
    n = F.greatest(F.size(words) - gap, F.lit(0))
    return F.zip_with(F.slice(words, 1, n), F.slice(words, 1 + gap, n), lambda a, b: F.concat(a, F.lit(" "), b))


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


def features(kept: Postings, candidates: DataFrame, queries: DataFrame, chunks: DataFrame, carry: Mapping[str, Column] | None = None) -> DataFrame:
    """The candidates (query_id, chunk_id, score, ...) with FEATURES, of the texts of their queries and chunks; texts are joined to candidates only.

    lexical: the score over the best of the query's. coverage: the share of its distinct words that the chunk has. rarity: the same by weight of terms in the
    corpus. adjacent: the share of its pairs of neighbours that are neighbours in the chunk; near: with one word between. length: the logarithm
    of the words. A query or a chunk without words has zeros, as null texts have none.
    carry: more columns, of the queries' own, of `chunk_text` and of the candidates'.
    """
    asked = asked_terms(kept, queries).groupBy("query_id").agg(F.collect_list(F.struct("term", (F.col("w") / F.col("qtf")).alias("w"))).alias("_weights"), F.sum(F.col("w") / F.col("qtf")).alias("_weight"))
    words = queries.withColumn("_q", tokens("query")).withColumn("_qset", F.array_distinct("_q")).withColumn("_qpairs", F.array_distinct(_pairs(F.col("_q"), 1)))
    best = candidates.groupBy("query_id").agg(F.max("score").alias("_best"))
    side = words.join(best, "query_id").join(asked, "query_id", "left")
    # Only texts of candidates are taken apart, each once; candidates, few bytes and much work, are dealt over the cores.
    candidates = candidates.repartition(int(candidates.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    own = chunks.select("chunk_id", "chunk_text").join(candidates.select("chunk_id"), "chunk_id", "left_semi").withColumn("_c", tokens("chunk_text"))
    rows = candidates.join(side, "query_id").join(own, "chunk_id")
    shared = rows.withColumn("_shared", F.array_intersect("_qset", "_c"))
    weighed = F.aggregate(F.filter("_weights", lambda x: F.array_contains("_shared", x["term"])), F.lit(0.0), lambda a, x: a + x["w"])
    pairs = lambda gap: _share(F.size(F.array_intersect("_qpairs", _pairs(F.col("_c"), gap))), F.size("_qpairs"))
    made = {
        "lexical": _share(F.col("score"), F.col("_best")), "coverage": _share(F.size("_shared"), F.size("_qset")), "rarity": F.coalesce(_share(weighed, F.col("_weight")), F.lit(0.0)),
        "adjacent": pairs(1), "near": pairs(2), "length": F.log1p(F.size("_c").cast("double")),
    }
    return shared.select(*candidates.columns, *[made[n].alias(n) for n in FEATURES], *[c.alias(n) for n, c in (carry or {}).items()])


@dataclass(frozen=True)
class Ranker:
    """Weights of the features; without any training only the lexical score counts."""

    weights: tuple[float, ...] = (1.0, *[0.0] * (len(FEATURES) - 1))
    pairs: int = 0

    def score(self) -> Column:
        """The score of a row of features, to 6 places."""
        return F.round(sum(F.lit(w) * F.col(n) for w, n in zip(self.weights, FEATURES)), 6)


def fit_pairs(groups: Sequence, rows: np.ndarray, right: np.ndarray) -> Ranker:
    """Pairwise logistic regression: in each group every right row against every wrong one, each group of equal weight. Without such pairs the untrained ranker."""
    order = np.argsort(np.asarray(groups), kind="stable")
    groups, rows, right = np.asarray(groups)[order], np.asarray(rows, float)[order], np.asarray(right, bool)[order]
    differences, weights = [], []
    for part in np.split(np.arange(len(groups)), np.flatnonzero(groups[1:] != groups[:-1]) + 1):
        good, bad = rows[part[right[part]]], rows[part[~right[part]]]
        if len(good) and len(bad):
            d = (good[:, None] - bad[None]).reshape(-1, rows.shape[1])
            differences.append(d)
            weights.append(np.full(len(d), 1 / len(d)))
    if not differences:
        return Ranker()
    x, share = np.concatenate(differences), np.concatenate(weights) / len(differences)
    scale = np.sqrt(share @ x**2)
    scale[scale == 0] = 1
    x, w = x / scale, np.zeros(x.shape[1])
    for _ in range(STEPS):
        wrong = 1 / (1 + np.exp(np.clip(x @ w, -50, 50)))
        w += RATE * (x.T @ (share * wrong) - RIDGE * w)
    return Ranker(tuple(float(round(v, 9)) for v in w / scale), len(x))


def some(chunks: DataFrame, most: int) -> DataFrame:
    """`most` chunks at most, those of the least hashes of their ids, which alone are read to choose them."""
    chosen = chunks.select("chunk_id").orderBy(F.xxhash64("chunk_id", F.lit("passages")), "chunk_id").limit(most)
    return chunks.join(chosen, "chunk_id", "left_semi")


def train(featured: DataFrame, most: int = 40_000) -> Ranker:
    """Weights learned of rows (query_id, chunk_id, right, FEATURES), `most` of them at most, by a hash of the query, in a fixed order."""
    first = featured.orderBy(F.xxhash64("query_id"), "query_id", "chunk_id").limit(most)
    rows = first.select("query_id", F.col("right").cast("int"), *FEATURES).toPandas()
    return fit_pairs(rows["query_id"].to_numpy(), rows[list(FEATURES)].to_numpy(float), rows["right"].to_numpy(bool)) if len(rows) else Ranker()


def rerank(featured: DataFrame, ranker: Ranker, n: int) -> DataFrame:
    """The n best of each query with rerank_rank and rerank_score, by the score, then by the rank before."""
    scored = featured.withColumn("rerank_score", ranker.score())
    return top_k(scored, ["query_id"], [F.col("rerank_score").desc(), F.col("rank"), F.col("chunk_id")], max(0, n), "rerank_rank")
