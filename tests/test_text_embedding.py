"""Text embeddings bring near copies together, are the same everywhere, and have the rows of their texts."""

from __future__ import annotations

import random

from lexloom.operators import postings, text_embedding, vector_index


def corpus(seed=1, n=240):
    """Texts on topics of their own words, and an edited copy of every sixth."""
    r = random.Random(seed)
    topics = [[f"t{t}w{i}" for i in range(60)] for t in range(12)]
    common = [f"c{i}" for i in range(30)]
    texts = [r.choices(topics[i % 12], k=50) + r.choices(common, k=25) for i in range(n)]
    copies = []
    for i in range(0, n, 6):
        words = list(texts[i])
        for at in r.sample(range(len(words)), 8):
            words[at] = r.choice(common)
        copies.append((1000 + i, " ".join(words)))
    return [(i, " ".join(t)) for i, t in enumerate(texts)] + [(900, ""), (901, None)], copies


def test_near_copies_are_found_by_their_text(spark):
    rows, copies = corpus()
    kept = postings.build(spark.createDataFrame(rows, "chunk_id long, chunk_text string"))
    vectors = text_embedding.fit(kept, 32)
    chunks = text_embedding.embed_chunks(kept, vectors)
    asked = text_embedding.embed_queries(kept, vectors, spark.createDataFrame([*copies, (5000, "unknown words only"), (5001, "")], "query_id long, query string"))
    found = {}
    for r in vector_index.search(vector_index.build(chunks), asked, 10)[0].collect():
        found.setdefault(r["query_id"], []).append(r["chunk_id"])
    assert set(found) == {k for k, _ in copies}
    assert sum(k - 1000 in got for k, got in found.items()) >= 0.9 * len(copies)
    assert sum(c % 12 == (k - 1000) % 12 for k, got in found.items() for c in got) >= 0.9 * sum(map(len, found.values()))  # of the same topic


def test_vectors_do_not_hang_on_partitions(spark):
    rows, _ = corpus(2, 60)
    made = []
    for parts in (1, 5):
        kept = postings.build(spark.createDataFrame(rows, "chunk_id long, chunk_text string").repartition(parts))
        got = {r["chunk_id"]: r["embedding"] for r in text_embedding.embed_chunks(kept, text_embedding.fit(kept, 8)).collect()}
        assert set(got) == set(range(60)) and all(abs(sum(x * x for x in v) - 1) < 1e-9 and len(v) == 8 for v in got.values())
        made.append(got)
    assert all(abs(x - y) < 1e-6 for k in made[0] for x, y in zip(made[0][k], made[1][k]))


def test_small_and_empty_corpora(spark):
    one = postings.build(spark.createDataFrame([(1, "a b c")], "chunk_id long, chunk_text string"))
    vectors = text_embedding.fit(one)
    assert [abs(x) for x in text_embedding.embed_chunks(one, vectors).first()["embedding"]] == [1.0]
    none = postings.build(spark.createDataFrame([], "chunk_id long, chunk_text string"))
    vectors = text_embedding.fit(none)
    assert vectors.count() == 0 and text_embedding.embed_chunks(none, vectors).count() == 0
