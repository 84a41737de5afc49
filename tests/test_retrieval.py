from __future__ import annotations

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexloom.functions import providers
from lexloom.functions import text as t
from lexloom.operators import answer, dense, fusion, lexical
from lexloom.plans.config import Settings, check_request

CHUNK = "chunk_id long, document_id long, chunk_text string, source string, regulation_type string, regulation_number string, title string, structural_path string, sequence long, contextual_text string"


def chunk_rows(texts, paths=None):
    return [(i, i, x, "BI", "PBI", str(i), "T", (paths or {}).get(i, f"p{i}"), i, x) for i, x in enumerate(texts)]


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "text string").select(column(F.col("text")).alias("x")).first()["x"]


@pytest.mark.parametrize("text", ["Pasal 1 Ayat (1) - Lindung Nilai!", "", "   ", "Épée naïve_2 中文 3.14", None, "A-B\tC"])
def test_tokens_are_words(spark, text):
    assert one(spark, t.tokens, text) == re.findall(r"\w+", (text or "").lower())


@pytest.mark.parametrize("text", [" a  b\tc\n", "", " \t\n", "x", "a b"])
def test_words_are_what_white_space_separates(spark, text):
    assert one(spark, t.words, text) == text.split() and one(spark, t.word_count, text) == len(text.split())


def test_estimates_claims_tags_paths(spark):
    assert [one(spark, t.token_estimate, x) for x in ("", "abc", "a" * 9, None)] == [0, 1, 2, 0]
    said = "First claim [C1]. Second; third one!\n\nshort\nok. Fine then.\n \n no; "
    assert one(spark, t.claims, said) == [c.strip() for c in re.split(r"(?<=[.!?\n;])\s+", said.strip()) if len(c.strip()) > 5]
    assert one(spark, t.citation_tags, "a [C1] b [C2][C1] [c3] [C]") == ["C1", "C2", "C1"]
    assert one(spark, t.base_path, " BAB I/Pasal 2 [part 1/3] ") == "BAB I/Pasal 2"


def bm25(texts, query, k1=1.5, b=0.75):
    docs = [re.findall(r"\w+", x.lower()) for x in texts]
    n, avg = len(docs), sum(map(len, docs)) / len(docs)
    out = {}
    for i, d in enumerate(docs):
        s = 0.0
        for q in re.findall(r"\w+", query.lower()):
            df = sum(q in x for x in docs)
            tf = d.count(q)
            if tf:
                s += max(0.0, math.log((n - df + 0.5) / (df + 0.5) + 1)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(d) / avg))
        if s:
            out[i] = round(s, 4)
    return out


def test_bm25_like_the_formula(spark):
    texts = ["hedging of foreign exchange", "bank capital", "foreign bank hedging hedging rules", "", "foreign"]
    chunks = spark.createDataFrame(chunk_rows(texts), CHUNK)
    asked = spark.createDataFrame([(1, "hedging foreign hedging"), (2, " "), (3, "unknown"), (4, None)], "query_id long, query string")
    got = {(r["query_id"], r["chunk_id"]): (r["score"], r["matched_terms"]) for r in lexical.search(chunks, asked, 10).collect()}
    want = bm25(texts, "hedging foreign hedging")
    assert {k[1]: v[0] for k, v in got.items()} == want and {k[0] for k in got} == {1}
    assert got[(1, 2)][1] == 2 and got[(1, 4)][1] == 1
    assert lexical.search(chunks, asked, 0).count() == 0


def test_equal_texts_order_by_path(spark):
    chunks = spark.createDataFrame(chunk_rows(["same text", "same text"], {0: "b", 1: "a"}), CHUNK)
    asked = spark.createDataFrame([(1, "same")], "query_id long, query string")
    assert [r["chunk_id"] for r in lexical.search(chunks, asked, 5).orderBy("rank").collect()] == [1, 0]


def test_filters_before_and_after(spark):
    texts = ["alpha beta", "alpha", "gamma alpha"]
    chunks = spark.createDataFrame(chunk_rows(texts), CHUNK)
    asked = spark.createDataFrame([(1, "alpha")], "query_id long, query string")
    after = lexical.search(chunks, asked, 5, keep=lexical.matches(source="bi", number="1")).collect()
    before = lexical.search(chunks.filter("chunk_id = 1"), asked, 5).collect()
    assert [r["chunk_id"] for r in after] == [r["chunk_id"] for r in before] == [1]
    assert after[0]["score"] == bm25(texts, "alpha")[1] != before[0]["score"]


def test_distances_of_orthogonal_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [3.0, 0.0]), (4, None)], "chunk_id long, embedding array<float>")
    q = spark.createDataFrame([(7, [2.0, 0.0])], "query_id long, vector array<float>")
    got = [(r["chunk_id"], r["distance"], r["score"]) for r in dense.nearest(v.repartition(3), q, 3).orderBy("rank").collect()]
    assert got == [(1, 0.0, 1.0), (3, 0.0, 1.0), (2, 1.0, 0.0)]
    with pytest.raises(ValueError):
        dense.nearest(v, q, 3, dimension=5)


def test_queries_in_blocks_are_the_same(spark, monkeypatch):
    from lexloom.plans.retrieval import query_vectors, vectors

    d = "/root/testdata/sf0.001"
    whole = sorted(map(tuple, dense.nearest(vectors(spark, d), query_vectors(spark, d, 7), 4).collect()))
    monkeypatch.setattr(dense, "QUERIES_AT_ONCE", 2)
    assert sorted(map(tuple, dense.nearest(vectors(spark, d).repartition(5), query_vectors(spark, d, 7), 4).collect())) == whole


def ranked_list(spark, rows):
    return spark.createDataFrame(rows, "query_id long, chunk_id long, rank int, score double")


def test_fusion(spark):
    chunks = spark.createDataFrame(chunk_rows(["a", "b", "c"], {0: "z", 1: "a"}), CHUNK)
    den, lex = ranked_list(spark, [(1, 0, 1, 0.9), (1, 1, 2, 0.8)]), ranked_list(spark, [(1, 1, 1, 3.0), (1, 0, 2, 2.0), (1, 2, 3, 1.0)])
    got = fusion.fuse(den, lex, chunks, 10).orderBy("rank").collect()
    assert [r["chunk_id"] for r in got] == [0, 1, 2]  # equal scores: the lower dense rank first
    assert got[0]["fused_score"] == got[1]["fused_score"] == round(1 / 61 + 1 / 62, 6)
    assert [r["retrieval_method"] for r in got] == ["hybrid", "hybrid", "lexical_only"]
    assert fusion.fuse(den, lex, chunks, 10, rrf_k=-1).count() == 0 and fusion.fuse(den, lex, chunks, 0).count() == 0
    assert fusion.fuse(den, lex.filter("false"), chunks, 1).first()["fused_score"] == round(1 / 61, 6)


def test_rerank_order_and_models(spark):
    chunks = spark.createDataFrame(chunk_rows(["Alpha beta gamma", "alpha", "nothing"]), CHUNK)
    asked = spark.createDataFrame([(1, "alpha GAMMA alpha")], "query_id long, query string")
    fused = fusion.fuse(ranked_list(spark, [(1, 1, 1, 1.0), (1, 2, 2, 1.0), (1, 0, 3, 1.0)]), ranked_list(spark, []), chunks, 10)
    got = fusion.rerank(fused, asked, chunks, 2).orderBy("rerank_rank").collect()
    assert [(r["chunk_id"], r["rerank_score"]) for r in got] == [(0, round(3 + round(1 / 63, 6), 4)), (1, round(1.5 + round(1 / 61, 6), 4))]
    assert fusion.rerank(fused, asked, chunks, 0).count() == 0

    class Length:
        def score(self, pairs):
            return [len(text) for _, text in pairs]

    assert fusion.rerank(fused, asked, chunks, 1, providers.rerank_column(Length)).first()["chunk_id"] == 0


def test_context_takes_a_prefix(spark):
    rows = spark.createDataFrame([(1, r, "x" * n) for r, n in ((1, 400), (2, 4000), (3, 4))], "query_id long, rerank_rank int, contextual_text string")
    assert [r["context_id"] for r in answer.context(rows, 100).collect()] == ["C1"]
    assert answer.context(rows, 1000).count() == 1 and answer.context(rows, 1101).count() == 3 and answer.context(rows, 10).count() == 0


def test_citations(spark):
    answers = spark.createDataFrame([(1, "a [C1] b [C1] [C99]"), (2, "none"), (3, "[C2]")], "key long, answer string")
    blocks = spark.createDataFrame([(1, "C1"), (3, "C2")], "key long, context_id string")
    got = {r["key"]: (r["n_tags"], r["n_valid"], r["invalid_tags"], r["is_valid"]) for r in answer.check_citations(answers, blocks).collect()}
    assert got == {1: (3, 1, "C99", False), 2: (0, 0, "", True), 3: (1, 1, "", True)}


def test_outcomes_in_order(spark):
    rows = [(" ", False, "x", False), ("q", False, t.ABSTENTION, False), ("q", True, f"Well: {t.ABSTENTION.upper()}", False), ("q", True, "conflict", False), ("q", True, "fine", True)]
    got = spark.createDataFrame(rows, "query string, passes boolean, answer string, ok boolean").select(answer.outcome("query", "passes", "answer", "ok").alias("o")).collect()
    assert [r["o"] for r in got] == ["empty_query", "low_score", "model_abstained", "invalid_citation", "answered"]


def test_embedding_providers(spark):
    class Two:
        dimension = 2

        def embed(self, texts):
            return [[len(x), 1.0] for x in texts]

    class Wrong(Two):
        dimension = 3

    rows = spark.createDataFrame([("ab",), (None,)], "text string")
    assert sorted(r[0] for r in rows.select(providers.embedding_column(Two)(F.col("text"))).collect()) == [[0.0, 1.0], [2.0, 1.0]]
    with pytest.raises(Exception, match="did not give"):
        rows.select(providers.embedding_column(Wrong)(F.col("text"))).collect()

    class Echo:
        def answer(self, prompts, instructions):
            assert "STRICT GROUNDING" in instructions and "PROMPT INJECTION ISOLATION" in instructions
            return [p.upper() for p in prompts]

    class Mute(Echo):
        def answer(self, prompts, instructions):
            return []

    assert rows.select(providers.answer_column(Echo)(F.col("text")).alias("a")).first()["a"] == "AB"
    with pytest.raises(Exception, match="0 answers"):
        rows.select(providers.answer_column(Mute)(F.col("text")).alias("a")).collect()
    assert rows.select(providers.embedder("OpenAI", 2, Two, key="k")(F.col("text")).alias("v")).first()["v"] == [2.0, 1.0]
    with pytest.warns(UserWarning):
        stand_in = providers.embedder("default", 3, Two, key=providers.NO_KEY)
    assert len(rows.select(stand_in(F.col("text")).alias("v")).first()["v"]) == 3
    with pytest.raises(ValueError):
        providers.embedder("other", 3)
    v = rows.select(dense.mock_embedding("text", 40).alias("v")).first()["v"]
    assert sum(x * x for x in v) == pytest.approx(1) and len(v) == 40


def test_settings():
    with pytest.raises(ValueError):
        Settings(embedding_dimension=0)
    with pytest.raises(ValueError):
        Settings(environment="production", embedding_key="k")
    Settings(environment="production", embedding_key="k", model_key="m")
    check_request("q")
    for bad in ({"query": ""}, {"query": "q", "top_n": 21}, {"query": "q", "top_k": 51}, {"query": "q", "rrf_k": 0}):
        with pytest.raises(ValueError):
            check_request(**bad)


def test_nearest_in_tiles_like_brute_force(spark, monkeypatch):
    r = np.random.default_rng(3)
    x = np.round(r.normal(size=(300, 8)), 1)
    x[::7] = x[0]
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(999, None)], "chunk_id long, embedding array<double>").repartition(3)
    asked = spark.createDataFrame([(i, x[i].tolist()) for i in range(0, 300, 50)] + [(7, None)], "query_id long, vector array<double>")
    monkeypatch.setattr(dense, "QUERIES_AT_ONCE", 4)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {}
    for i in range(0, 300, 50):
        cosine = np.round(unit @ unit[i], 6)
        want[i] = np.lexsort((np.arange(300), -cosine))[:9].tolist()
    got = {}
    for row in dense.nearest(vectors, asked, 9).orderBy("query_id", "rank").collect():
        got.setdefault(row["query_id"], []).append(row["chunk_id"])
    assert got == want
    assert dense.nearest(vectors, asked.filter("false"), 9).count() == 0 and dense.nearest(vectors, asked, 0).count() == 0


def test_blank_queries_get_nothing(spark):
    queries = spark.createDataFrame([(1, "a"), (2, " \t"), (3, None)], "query_id long, query string")
    assert [r[0] for r in fusion.asking(queries).collect()] == [1]
    side = spark.createDataFrame([(q, 7, 1, 0.5) for q in (1, 2, 3)], "query_id long, chunk_id long, rank int, score double")
    chunks = spark.createDataFrame([(7, "p", 1)], "chunk_id long, structural_path string, sequence long")
    assert [r["query_id"] for r in fusion.fuse(side, side, chunks, 5, queries=queries).collect()] == [1]


def test_chunks_are_validated_in_one_pass_as_in_two(spark):
    from lexloom.operators import chunk

    kind = "document_id long, sequence int, parent_sequence int, ancestors array<int>, node_type string, node_number string, title string, text string, page_start int, page_end int, path string"
    leaf = lambda d, n, text: (d, n, None, [n], "article" if n == 1 else "paragraph", str(n), None, text, 1, 1, f"p{n}")
    tree = spark.createDataFrame([leaf(1, 2, "one. two " * 300), leaf(1, 3, " \n"), leaf(1, 4, "x"), leaf(2, 2, ""), leaf(3, 1, "no leaf")], kind)
    about = tree.select("*", *[F.lit("s").alias(n) for n in ("source", "regulation_type", "regulation_number", "regulation_title")])
    two = chunk.validate(tree, chunk.chunks(about))
    one = chunk.validate_parts(chunk.parts_of_leaves(about)).select(*two.columns)
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect())) and two.count() >= 2
    assert [r["chunk_sequence"] for r in chunk.chunks(about).filter("document_id = 1").orderBy("ancestors", "part_index").collect()] == [1, 2, 3]
