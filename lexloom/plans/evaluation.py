"""Evaluation queries: vectors with equal labels are each other's gold, and tagged assistant turns are answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexloom.functions import text as t
from lexloom.operators import evaluate, fusion, learned_rank, postings
from lexloom.operators.ranking import ranked, top_k
from lexloom.plans.retrieval import CHAIN, CHUNKS, DEPTH, EVERY, FINAL, POOL, TAGGED, _every_fiftieth, _fused, _postings, _tagged, bm25_sql, chunks, dense_sql, fuse_sql, queries, vectors, word_set_sql
from lexloom.sources.tables import kept, written

_PLACE = ["document_id", "structural_path", "page_start", "page_end"]


def _typed(ids):
    return ids.select("sample_id", F.when(F.col("sample_id") % 5 == 4, "out_of_domain").otherwise("in_domain").alias("query_type"))


def _samples(s, d):
    return _typed(vectors(s, d).filter(F.col("chunk_id") % EVERY == 0).select(F.col("chunk_id").alias("sample_id")))


def _evidence(found, *carry):
    """Ranked chunks as evidence; each second path has a part suffix."""
    path = F.when(F.col("chunk_id") % 2 == 0, F.concat("structural_path", F.lit(" [Part 1/2]"))).otherwise(F.col("structural_path"))
    return found.select(F.col("query_id").alias("sample_id"), *carry, "rank", "document_id", path.alias("structural_path"), "page_start", "page_end")


def _results(s, d):
    return _evidence(_every_fiftieth(s, d, 10)[0].join(chunks(s, d).select("chunk_id", *_PLACE), "chunk_id"))


#: Gold of a label: so many of its vectors, those of the least ids.
GOLD_EACH = 100


def _gold(s, d, samples):
    """Vectors of the sample's label, at most GOLD_EACH, graded 1 to 3."""
    v = vectors(s, d).select("chunk_id", "label")
    asked = v.join(samples.select(F.col("sample_id").alias("chunk_id")), "chunk_id", "left_semi").select(F.col("chunk_id").alias("sample_id"), "label")
    some = top_k(v, ["label"], [F.col("chunk_id")], GOLD_EACH).drop("rank").join(chunks(s, d).select("chunk_id", *_PLACE), "chunk_id")
    return asked.join(some, "label").select("sample_id", *_PLACE, (F.col("chunk_id") % 3 + 1).cast("int").alias("relevance"))


def _metrics(s, d):
    samples = _samples(s, d)
    return evaluate.per_sample(samples, _results(s, d), _gold(s, d, samples))


def _benchmark(s, d):
    """The four stages on the benchmark's items: dense, lexical, fused and re-ranked lists of ten, all from one table of candidates with their four ranks."""
    samples = _typed(queries(s, d).select(F.col("query_id").alias("sample_id")))
    found = written(_fused(s, d, k=2 * DEPTH), "candidates")
    again = fusion.rerank(found.filter(F.col("rank") <= POOL), queries(s, d), None, 10).select("query_id", "chunk_id", "rerank_rank")
    all_ranks = found.join(again, ["query_id", "chunk_id"], "left")
    stages = {"dense": "dense_rank", "bm25": "lexical_rank", "rrf": "rank", "rrf_rerank": "rerank_rank"}
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("stage"), F.col(rank).cast("int").alias("rank")) for name, rank in stages.items()]))
    lists = all_ranks.withColumn("_s", each).filter("_s.rank <= 10").drop("rank").select("*", "_s.stage", "_s.rank")
    metrics = evaluate.per_sample(samples, _evidence(lists, "stage"), written(_gold(s, d, samples), "gold"), list(stages))
    return evaluate.stage_summaries(metrics, list(stages))


#: Passages that the re-ranker learns from, at most; none of them is of a chunk that is asked for.
TAUGHT = 200


def _featured(s, d, asked):
    """The lexical candidates of passages with their features, whether they are what the passage is of, and the words they share."""
    asked = written(asked, "passages")
    found = written(postings.search(_postings(s, d), chunks(s, d), asked.select("query_id", "query"), POOL), "passage-candidates")
    more = {"right": F.sha2("chunk_text", 256) == F.col("digest"), "overlap": fusion.overlap_score("query", "chunk_text", F.lit(0.0))}
    return learned_rank.features(_postings(s, d), found, asked, chunks(s, d), more)


def _asked_passages(s, d):
    return learned_rank.passages(chunks(s, d).filter(F.col("chunk_id") % EVERY == 0))


def _ranker(s, d):
    """The re-ranker, trained once in a session."""
    return kept(s, ("ranker", d), lambda: learned_rank.train(_featured(s, d, learned_rank.passages(learned_rank.some(chunks(s, d).filter(F.col("chunk_id") % EVERY != 0), TAUGHT)))))


def _rerankers(s, d):
    """Passages of every fiftieth chunk: how well candidates are ordered by BM25, by shared words, and whether the learned order is as good or better."""
    asked = _asked_passages(s, d)
    rows = written(learned_rank.rerank(_featured(s, d, asked), _ranker(s, d), POOL), "reranked-passages")
    rows = ranked(rows, ["query_id"], [F.col("overlap").desc(), F.col("rank"), F.col("chunk_id")], "overlap_rank")
    copies = chunks(s, d).select(F.sha2("chunk_text", 256).alias("digest")).join(asked.select("digest"), "digest", "left_semi").groupBy("digest").agg(F.count(F.lit(1)).alias("wanted"))
    wanted = asked.join(copies, "digest").select("query_id", "wanted")
    stages = {"bm25": "rank", "overlap": "overlap_rank", "learned": "rerank_rank"}
    means = evaluate.order_means(rows, wanted, stages)
    learned = F.broadcast(means.filter("stage = 'learned'").select(F.col("ndcg_10").alias("_learned")))  # one row
    return means.filter("stage <> 'learned'").join(learned).select("stage", "n_samples", "rr_10", "ndcg_10", (F.col("_learned") >= F.col("ndcg_10")).alias("learned_at_least"))


def _rounded(rows, names):
    return rows.select("sample_id", *[F.round(n, 6).alias(n) for n in names])


def _generation(s, d):
    said = _tagged(s, d)
    samples = said.select("key", "answer", (F.col("abstain") == 0).alias("abstained"), F.when(F.col("key") % 7 != 0, F.col("key") % 2 == 0).alias("expected_abstain"))
    n = F.substring("context_id", 2, 9).cast("int")
    tags = said.select("key", F.explode(F.array_distinct(t.citation_tags("answer"))).alias("context_id")).filter(n <= 3)
    citations = tags.select("key", "context_id", F.lit(None).cast("string").alias("document_id"), F.concat(F.lit("Pasal "), n.cast("string"), F.lit(" [Part 1/2]")).alias("structural_path"), n.alias("page_start"), n.alias("page_end"))
    place = lambda n: [F.lit("d").alias("document_id"), F.concat(F.lit("Pasal "), n.cast("string")).alias("structural_path"), n.cast("int").alias("page_start"), n.cast("int").alias("page_end")]
    gold = said.select("key", *place(F.col("key") % 3 + 1)).unionByName(said.select("key", *place(F.col("key") % 2 + 1)))
    needed = said.select("key", F.lit("a").alias("claim_id"), *place(F.col("key") % 3 + 1)).unionByName(said.filter("key % 2 = 0").select("key", F.lit("a").alias("claim_id"), *place(F.lit(1))))
    return evaluate.generation(samples, citations, gold, needed)


_RR = [f"{m}_{k}" for m in ("rr", "hit") for k in evaluate.CUTOFFS]
_NDCG = [f"ndcg_{k}" for k in evaluate.CUTOFFS]
_PR = ["precision_5", "recall_5"]

QUERIES = {
    "eval_rr_hit": lambda s, d: _rounded(_metrics(s, d), _RR),
    "eval_ndcg": lambda s, d: _rounded(_metrics(s, d), _NDCG),
    "eval_precision_recall": lambda s, d: _rounded(_metrics(s, d), _PR),
    "eval_stage_summary": lambda s, d: evaluate.stage_summary(_metrics(s, d), "dense"),
    "eval_benchmark": _benchmark,
    "eval_rerankers": _rerankers,
    "rerank_features": lambda s, d: _featured(s, d, _asked_passages(s, d)).select("query_id", "chunk_id", "rank", "right", *[F.round(n, 6).alias(n) for n in learned_rank.FEATURES]),
    "eval_generation": _generation,
}

_ASKED = f"SELECT vec_id AS query_id, embedding AS vector FROM embeddings WHERE vec_id % {EVERY} = 0"
_GAIN = lambda rel, place: f"(pow(2, {rel}) - 1) / log2({place} + 1)"


def gold_sql(samples: str) -> str:
    return f"""samples AS (SELECT sample_id, CASE WHEN sample_id % 5 = 4 THEN 'out_of_domain' ELSE 'in_domain' END AS query_type FROM ({samples})),
gold AS (SELECT q.vec_id AS sample_id, c.document_id, c.structural_path AS base_path, c.page_start, c.page_end, (v.vec_id % 3 + 1)::INT AS relevance FROM embeddings q JOIN (SELECT * FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) <= {GOLD_EACH}) v USING (label) JOIN chunks c ON c.chunk_id = v.vec_id WHERE q.vec_id IN (SELECT sample_id FROM samples)),
best AS (SELECT sample_id, document_id, base_path, page_start, page_end, max(relevance) AS relevance FROM gold GROUP BY ALL),
placed AS (SELECT sample_id, relevance, row_number() OVER (PARTITION BY sample_id ORDER BY relevance DESC) AS place FROM gold),
ideal AS (SELECT sample_id, count(*) AS n_gold, {", ".join(f"sum({_GAIN('relevance', 'place')}) FILTER (place <= {k}) AS ideal_{k}" for k in evaluate.CUTOFFS)} FROM placed GROUP BY 1)"""


def metrics_sql(ranked: str, name: str = "metrics") -> str:
    """Metrics of a relation (query_id, chunk_id, rank)."""
    return f"""graded_{name} AS (SELECT d.query_id AS sample_id, d.rank, coalesce(b.relevance, 0) AS relevance FROM {ranked} d JOIN chunks c USING (chunk_id) LEFT JOIN best b ON b.sample_id = d.query_id AND b.document_id = c.document_id AND b.base_path = c.structural_path AND b.page_start = c.page_start AND b.page_end = c.page_end),
found_{name} AS (SELECT sample_id, {", ".join(f"min(rank) FILTER (relevance > 0 AND rank <= {k}) AS first_{k}, sum({_GAIN('relevance', 'rank')}) FILTER (rank <= {k}) AS dcg_{k}" for k in evaluate.CUTOFFS)}, count(*) FILTER (relevance > 0 AND rank <= 5) AS matched FROM graded_{name} GROUP BY 1),
{name} AS (SELECT sample_id, {", ".join(f"coalesce(1.0::DOUBLE / first_{k}, 0) AS rr_{k}, (first_{k} IS NOT NULL)::INT::DOUBLE AS hit_{k}, CASE WHEN ideal_{k} > 0 THEN least(1.0::DOUBLE, coalesce(dcg_{k}, 0) / ideal_{k}) ELSE 0 END AS ndcg_{k}" for k in evaluate.CUTOFFS)}, coalesce(matched, 0) / 5.0::DOUBLE AS precision_5, coalesce(matched, 0)::DOUBLE / n_gold AS recall_5 FROM samples JOIN ideal USING (sample_id) LEFT JOIN found_{name} USING (sample_id) WHERE query_type = 'in_domain')"""


METRICS = ",\n".join([CHUNKS, dense_sql(10, asked=_ASKED), gold_sql(f"SELECT vec_id AS sample_id FROM embeddings WHERE vec_id % {EVERY} = 0"), metrics_sql("den")])
_summary = lambda stage, name: f"SELECT '{stage}' AS stage, count(*) AS n_samples, " + ", ".join(f"coalesce(round(round(avg({n}), 9), 4), 0) AS {n}" for n in [*_RR, *_NDCG, *_PR]) + f" FROM {name}"
_STAGES = {"dense": "(SELECT * FROM den WHERE rank <= 10)", "bm25": "(SELECT * FROM lex WHERE rank <= 10)", "rrf": "ten", "rrf_rerank": "(SELECT query_id, chunk_id, rerank_rank AS rank FROM reranked)"}
#: The chain with lists of ten from the fused and the re-ranked rows.
_CHAIN_TEN = f"{CHAIN.replace(f'rerank_rank <= {FINAL}', 'rerank_rank <= 10')},\n{fuse_sql(60, 10, 'ten')}"
_pick = lambda names: f"WITH {METRICS}\nSELECT sample_id, " + ", ".join(f"round({n}, 6) AS {n}" for n in names) + " FROM metrics"
_MARK = r"regexp_replace(trim(answer), '([.!?\n;])\s+', '\1' || chr(1), 'g')"
_share = lambda a, b: f"CASE WHEN n = 0 THEN 0.0::DOUBLE WHEN {b} > 0 THEN round({a}::DOUBLE / {b}, 4) ELSE 1.0::DOUBLE END"

_words_of = lambda text: rf"regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}_]+')"
_pairs_of = lambda words, gap: f"list_distinct(list_transform(range(1, greatest(len({words}) - {gap}, 0) + 1), lambda i: {words}[i] || ' ' || {words}[i + {gap}]))"
_of = lambda part, whole: f"CASE WHEN {whole} > 0 THEN ({part})::DOUBLE / {whole} ELSE 0 END"
_SPAN = learned_rank.SPAN
PASSAGES = f"""{CHUNKS},
spans AS (SELECT chunk_id, chunk_text, t, least(len(t) // 3, len(t) - {_SPAN}) AS start FROM (SELECT chunk_id, chunk_text, {_words_of("chunk_text")} AS t FROM chunks WHERE chunk_id % {EVERY} = 0) WHERE len(t) >= {_SPAN}),
queries AS (SELECT chunk_id AS query_id, sha256(chunk_text) AS digest, array_to_string(list_filter(list_slice(t, start + 1, start + {_SPAN}), lambda x, i: (i - 1) % 4 <> {learned_rank.LEFT_OUT}), ' ') AS query FROM spans),
{bm25_sql(k=POOL)},
asking AS (SELECT query_id, query, digest, q, list_distinct(q) AS qset, {_pairs_of("q", 1)} AS qpairs FROM (SELECT *, {_words_of("query")} AS q FROM queries)),
weights AS (SELECT query_id, term, greatest(0, ln((n - df + 0.5) / (df + 0.5) + 1)) AS w FROM qt JOIN df USING (term) CROSS JOIN stats),
rare AS (SELECT l.query_id, l.chunk_id, sum(w) AS w FROM lex l JOIN weights x ON x.query_id = l.query_id JOIN tf ON tf.chunk_id = l.chunk_id AND tf.term = x.term GROUP BY ALL),
featured AS (SELECT l.query_id, l.chunk_id, l.rank, sha256(chunk_text) = digest AS "right", {_of("l.score", "max(l.score) OVER (PARTITION BY l.query_id)")} AS lexical, {_of("len(list_intersect(qset, c))", "len(qset)")} AS coverage, {_of("rare.w", "(SELECT sum(w) FROM weights x WHERE x.query_id = l.query_id)")} AS rarity,
  {_of(f"len(list_intersect(qpairs, {_pairs_of('c', 1)}))", "len(qpairs)")} AS adjacent, {_of(f"len(list_intersect(qpairs, {_pairs_of('c', 2)}))", "len(qpairs)")} AS near, ln(1 + len(c)) AS length, len(list_intersect({word_set_sql("query")}, {word_set_sql("chunk_text")})) AS overlap
  FROM lex l JOIN asking a ON a.query_id = l.query_id JOIN (SELECT chunk_id, chunk_text, {_words_of("chunk_text")} AS c FROM chunks) t ON t.chunk_id = l.chunk_id JOIN rare ON rare.query_id = l.query_id AND rare.chunk_id = l.chunk_id)"""
_ORDERS = {"bm25": "rank", "overlap": "row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, rank, chunk_id)"}
_order_means = lambda stage, place: f"""SELECT '{stage}' AS stage, count(*) AS n_samples, round(round(avg(coalesce(1.0::DOUBLE / first, 0)), 9), 4) AS rr_10, round(round(avg(coalesce(dcg, 0) / ideal), 9), 4) AS ndcg_10, true AS learned_at_least
FROM wanted LEFT JOIN (SELECT query_id, min(place) AS first, sum(1 / log2(place + 1)) AS dcg FROM (SELECT query_id, "right", {place} AS place FROM featured) WHERE "right" AND place <= 10 GROUP BY query_id) USING (query_id)"""  # noqa: E731

ORACLES = {
    "rerank_features": f"WITH {PASSAGES}\nSELECT query_id, chunk_id, rank, \"right\", " + ", ".join(f"round({n}, 6) AS {n}" for n in learned_rank.FEATURES) + " FROM featured",
    "eval_rerankers": f"""WITH {PASSAGES},
wanted AS (SELECT query_id, list_sum(list_transform(range(1, least(n, 10) + 1), lambda i: 1 / log2(i + 1))) AS ideal FROM queries JOIN (SELECT sha256(chunk_text) AS digest, count(*) AS n FROM chunks GROUP BY 1) USING (digest))
""" + " UNION ALL ".join(_order_means(*o) for o in _ORDERS.items()),
    "eval_rr_hit": _pick(_RR),
    "eval_ndcg": _pick(_NDCG),
    "eval_precision_recall": _pick(_PR),
    "eval_stage_summary": f"WITH {METRICS}\n{_summary('dense', 'metrics')}",
    "eval_benchmark": f"WITH {_CHAIN_TEN},\n{gold_sql('SELECT query_id AS sample_id FROM queries')},\n" + ",\n".join(metrics_sql(rows, f"m_{name}") for name, rows in _STAGES.items()) + "\n" + " UNION ALL ".join(_summary(name, f"m_{name}") for name in _STAGES),
    "eval_generation": rf"""WITH {TAGGED},
samples AS (SELECT key, answer, abstain = 0 AS abstained, CASE WHEN key % 7 <> 0 THEN key % 2 = 0 END AS expected FROM tagged),
spoke AS (SELECT key, regexp_extract_all(answer, '\[(C\d+)\]', 1) AS tags, list_filter(list_transform(string_split({_MARK}, chr(1)), lambda c: trim(c)), lambda c: length(c) > 5) AS claims FROM samples WHERE NOT abstained),
cited AS (SELECT key, substr(unnest(list_distinct(list_filter(tags, lambda x: x IN ('C1', 'C2', 'C3')))), 2)::INT AS n FROM spoke),
gold AS (SELECT key, key % 3 + 1 AS n FROM spoke UNION ALL SELECT key, key % 2 + 1 FROM spoke),
needed AS (SELECT key, key % 3 + 1 AS n FROM spoke UNION ALL SELECT key, 1 FROM spoke WHERE key % 2 = 0),
whole AS (SELECT key, bool_and(EXISTS (SELECT 1 FROM cited c WHERE c.key = needed.key AND c.n = needed.n)) AS ok FROM needed GROUP BY key),
x AS (SELECT (SELECT count(*) FROM samples) AS n, (SELECT count(*) FROM samples WHERE abstained = coalesce(expected, false)) AS correct, (SELECT sum(len(tags)) FROM spoke) AS tags, (SELECT sum(len(claims)) FROM spoke) AS claims, (SELECT sum(len(list_filter(claims, lambda c: regexp_matches(c, '\[(C\d+)\]')))) FROM spoke) AS grounded,
 (SELECT count(*) FROM cited) AS made, (SELECT count(*) FROM cited c WHERE EXISTS (SELECT 1 FROM gold g WHERE g.key = c.key AND g.n = c.n)) AS matched, (SELECT count(*) FROM gold) AS wanted, (SELECT count(*) FROM whole) AS gold_claims, (SELECT count(*) FROM whole WHERE ok) AS covered)
SELECT n AS total_samples, {_share("made", "tags")} AS citation_validity, {_share("matched", "made")} AS citation_precision, {_share("matched", "wanted")} AS citation_recall, {_share("grounded", "claims")} AS grounding_coverage, {_share("covered", "gold_claims")} AS gold_claim_coverage, round(1 - grounded::DOUBLE / claims, 4) AS unsupported_claim_rate, {_share("correct", "n")} AS abstention_accuracy FROM x""",
}
