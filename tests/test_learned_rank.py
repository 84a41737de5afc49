"""The learning re-ranker: features against plain Python, weights on planted pairs, and an order that words alone do not give."""

from __future__ import annotations

import math
import random
import re

import numpy as np
from pyspark.sql import functions as F

from lexloom.operators import evaluate, learned_rank, postings

CHUNK = "chunk_id long, chunk_text string, structural_path string, sequence long"


def table(spark, texts):
    return spark.createDataFrame([(i, t, "p", i) for i, t in texts], CHUNK)


def words(text):
    return re.findall(r"\w+", (text or "").lower())


def by_hand(corpus, query, text, score, best):
    q, c, n = words(query), words(text), len(corpus)
    distinct = list(dict.fromkeys(q))
    df = {t: sum(t in words(other) for _, other in corpus) for t in distinct}
    weight = {t: max(0.0, math.log((n - df[t] + 0.5) / (df[t] + 0.5) + 1)) for t in distinct if df[t]}
    pairs = set(zip(q, q[1:]))
    share = lambda a, b: a / b if b else 0.0
    return [
        share(score, best), share(sum(t in c for t in distinct), len(distinct)), share(sum(w for t, w in weight.items() if t in c), sum(weight.values())),
        share(len(pairs & set(zip(c, c[1:]))), len(pairs)), share(len(pairs & set(zip(c, c[2:]))), len(pairs)), math.log1p(len(c)),
    ]


def test_features_are_those_counted_by_hand(spark):
    r = random.Random(5)
    corpus = [(i, " ".join(r.choices(["Alfa", "beta", "gamma,", "delta.", "epsilon", "zeta", "eta", "theta"], k=r.randint(1, 40)))) for i in range(30)] + [(30, ""), (31, None), (32, "alfa"), (33, "alfa alfa")]
    asked = [(1, "alfa beta gamma beta alfa"), (2, "theta"), (3, ""), (4, None), (5, "unknown words")]
    chunks, queries = table(spark, corpus), spark.createDataFrame(asked, "query_id long, query string")
    pairs = [(q, i, 1.0 + i % 4) for q, _ in asked for i in (0, 7, 30, 31, 32, 33)]
    rows = learned_rank.features(postings.build(chunks), spark.createDataFrame(pairs, "query_id long, chunk_id long, score double"), queries, chunks, {"shout": F.upper("query")}).collect()
    assert len(rows) == len(pairs)
    for row in rows:
        query = dict(asked)[row["query_id"]]
        want = by_hand(corpus, query, dict(corpus)[row["chunk_id"]], row["score"], 4.0)
        assert np.allclose([row[n] for n in learned_rank.FEATURES], want), row
        assert row["shout"] == (query.upper() if query is not None else None)


def test_passages_leave_words_out(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = {r["query_id"]: r for r in learned_rank.passages(table(spark, [(1, text), (2, "too short"), (3, None), (4, " ".join(["a"] * 16)), (5, "")])).collect()}
    assert set(rows) == {1, 4}
    assert rows[1]["query"] == " ".join(f"w{20 + i}" for i in range(16) if i % 4 != 3) and rows[4]["query"] == " ".join(["a"] * 12)


def test_weights():
    r = np.random.default_rng(1)
    groups = np.repeat(np.arange(50), 8)
    rows = r.normal(size=(400, 6))
    right = np.zeros(400, bool)
    for g in range(50):
        right[g * 8 + rows[g * 8 : g * 8 + 8, 3].argmax()] = True
    ranker = learned_rank.fit_pairs(groups, rows, right)
    assert ranker.pairs == 350 and int(np.argmax(np.abs(ranker.weights))) == 3 and ranker.weights[3] > 0
    order = r.permutation(400)
    again = learned_rank.fit_pairs(groups[order], rows[order], right[order])
    assert np.allclose(ranker.weights, again.weights, atol=1e-6)
    assert learned_rank.fit_pairs(groups, rows, np.ones(400, bool)) == learned_rank.Ranker() == learned_rank.fit_pairs([], np.zeros((0, 6)), [])
    assert all(map(math.isfinite, learned_rank.fit_pairs([1, 1], np.zeros((2, 6)), [True, False]).weights))


def shuffled_corpus(seed, n=60):
    """Texts, each of which has two others with the same words in another order."""
    r, out = random.Random(seed), []
    for i in range(n):
        base = r.choices([f"v{k}" for k in range(40)], k=48)
        out.append((10 * i, " ".join(base)))
        out += [(10 * i + j, " ".join(r.sample(base, len(base)))) for j in (1, 2)]
    return out


def test_it_learns_the_order_of_words(spark):
    chunks = table(spark, shuffled_corpus(8))
    index = postings.build(chunks)

    def featured(asked):
        found = postings.search(index, chunks, asked.select("query_id", "query"), 10)
        return learned_rank.features(index, found, asked, chunks, {"right": F.sha2("chunk_text", 256) == F.col("digest")})

    first = featured(learned_rank.passages(chunks.filter("chunk_id < 300")))
    ranker = learned_rank.train(first)
    held = learned_rank.passages(chunks.filter("chunk_id >= 300"))
    rows = learned_rank.rerank(featured(held), ranker, 10)
    got = {r["stage"]: r for r in evaluate.order_means(rows, held.select("query_id", F.lit(1).alias("wanted")), {"bm25": "rank", "learned": "rerank_rank"}).collect()}
    assert got["learned"]["n_samples"] == 90 and got["learned"]["ndcg_10"] > 0.98 > 0.8 > got["bm25"]["ndcg_10"]
    assert learned_rank.train(first) == ranker  # the same again
    assert learned_rank.train(first, 7).pairs < 7  # bounded
    assert learned_rank.some(chunks, 11).count() == 11 and learned_rank.rerank(featured(held), ranker, 0).count() == 0


def test_empty(spark):
    chunks = table(spark, [])
    asked = learned_rank.passages(chunks)
    found = spark.createDataFrame([], "query_id long, chunk_id long, score double, rank int")
    rows = learned_rank.features(postings.build(chunks), found, asked, chunks, {"right": F.lit(True)})
    assert rows.count() == 0 and learned_rank.train(rows) == learned_rank.Ranker()
    means = evaluate.order_means(rows.withColumn("place", F.lit(1)), asked.select("query_id", F.lit(1).alias("wanted")), {"a": "place"}).collect()
    assert [tuple(m) for m in means] == [("a", 0, 0.0, 0.0)]


def test_means_of_orders(spark):
    rows = spark.createDataFrame([(1, True, 2), (1, True, 4), (1, False, 1), (2, False, 1), (3, True, 11)], "query_id long, right boolean, place int")
    wanted = spark.createDataFrame([(1, 2), (2, 1), (3, 1)], "query_id long, wanted long")
    got = evaluate.order_means(rows, wanted, {"one": "place"}).first()
    ndcg = (1 / math.log2(3) + 1 / math.log2(5)) / (1 + 1 / math.log2(3))
    assert tuple(got) == ("one", 3, round(0.5 / 3, 4), round(ndcg / 3, 4))
