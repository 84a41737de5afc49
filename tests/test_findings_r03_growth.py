"""What the third round's findings on growth asked for: the same rows with fewer bytes shuffled, less memory of a task, fewer passes."""

from __future__ import annotations

import random

import pyarrow as pa

from lexloom.operators import chunk, lexical, postings, propagate, structure
from lexloom.plans import ingestion
from lexloom.plans import structure as plans
from lexloom.sources import pages, snapshots, tables

SMALL = "/root/testdata/sf0.001"


def _corpus(spark):
    r = random.Random(5)
    words = [f"w{i}" for i in range(200)]
    texts = [" ".join(r.choices(words, [1 / (i + 1) for i in range(200)], k=r.choice([0, 4, 30]))) for _ in range(700)] + [None]
    texts[::11] = [texts[3]] * len(texts[::11])
    chunks = spark.createDataFrame([(i, t, f"p{i % 4}", i % 5) for i, t in enumerate(texts)], "chunk_id long, chunk_text string, structural_path string, sequence long").repartition(3)
    asked = [(i, " ".join(r.choices(words, k=12))) for i in range(20)] + [(90, "w0 w0"), (91, "none such"), (92, None)]
    return chunks, spark.createDataFrame(asked, "query_id long, query string")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_few_queries_are_scored_where_counts_are_read(spark, monkeypatch):
    """no postings are made or shuffled, and rows are those of all pairs; too many queries for a matrix give the same rows."""
    chunks, queries = _corpus(spark)
    rows = lambda df: sorted((r["query_id"], r["chunk_id"], r["rank"], round(r["score"], 3), r["matched_terms"]) for r in df.collect())
    monkeypatch.setattr(postings, "TILE", 64)
    for k in (1, 7, 1000):
        kept = postings.build(chunks)
        want = rows(lexical.search(chunks, queries, k))
        assert rows(postings.search(kept, chunks, queries, k)) == want and "blocks" not in vars(kept)
    monkeypatch.setattr(lexical, "TERMS_AT_ONCE", 3)
    assert rows(postings.search(kept, chunks, queries, 1000)) == want and "blocks" in vars(kept)


def test_matched_terms_are_counted_without_a_shuffle(spark, monkeypatch):
    """counts come from where texts are read; too many queries for a matrix give the same rows."""
    chunks, queries = _corpus(spark)
    found = lexical.matched(chunks.coalesce(3), queries)
    assert "HashAggregate" not in _plan(found) and "Join" not in _plan(found)
    own = sorted(map(tuple, found.collect()))
    monkeypatch.setattr(lexical, "TERMS_AT_ONCE", 3)
    assert own == sorted(map(tuple, lexical.matched(chunks, queries).collect())) and len(own) > 4000


def test_documents_are_sorted_a_few_times_in_pieces_of_the_input(spark, monkeypatch):
    """F16 to F19, F22 to F25: a task holds a piece of the input in each of few sorts, however large the input is; rows are the same."""
    of = lambda: sorted(map(tuple, plans.QUERIES["chunk_hash"](spark, SMALL).collect()))
    want = of()
    lines = spark.createDataFrame([(1, 1, 1, 1, "Pasal 1", 100, 110)], "document_id long, page_num long, block_num long, pos long, text string, y0 int, y1 int")
    assert tables.pieces(lines) is None
    monkeypatch.setattr(tables, "EACH", 20_000)
    parts = tables.pieces(plans.lines(spark, SMALL))
    assert parts > spark.sparkContext.defaultParallelism and tables.pieces(plans.lines(spark, SMALL), 10_000) >= 2 * parts - 1
    tree = structure.nodes(plans._norm(spark, SMALL))
    assert f", {parts}), REPARTITION_BY_NUM" in _plan(tree)
    # One sort for margins' lines, one by line, one depth-first, one by node; chunks take one more, depth-first.
    last = _plan(chunk.chunks(plans._leaves(spark, SMALL))).split("REPARTITION_BY_NUM")[0]
    assert last.count(" Sort [") <= 5
    assert of() == want


def test_terms_of_changed_chunks_stay_with_their_chunk(spark, tmp_path, monkeypatch):
    """a row of postings for each chunk; what is made of much input is not shuffled to its buckets; counts are those of a rebuild."""
    rows = [(d, 1, 10 * d + c, "alpha " * c + f"beta d{d}") for d in range(40) for c in range(3)] + [(50, 1, 500, None)]
    spark.createDataFrame(rows, "document_id long, version_id long, chunk_id long, chunk_text string").write.parquet(f"{tmp_path}/chunks")
    made = spark.read.parquet(f"{tmp_path}/chunks")
    some = lambda test: {"retrieval_chunks": made.filter(test), "document_nodes": made.filter(test).select("document_id", "version_id"), "chunk_embeddings": made.filter(test).select("document_id", "version_id")}
    for n, each in enumerate((1, tables.EACH)):
        monkeypatch.setattr(tables, "EACH", each)
        root = f"file://{tmp_path}/t{n}"
        propagate.replace_documents(spark, root, made, some("true"))
        propagate.replace_documents(spark, root, made.filter("document_id % 4 < 2"), some("document_id % 4 = 1"))
        kept = [r for r in rows if r[0] % 4]
        postings_rows = snapshots.read(spark, root, propagate.POSTINGS).collect()
        assert sorted(r["chunk_id"] for r in postings_rows) == sorted(r[2] for r in kept) and {r["length"] for r in postings_rows} == {0, 2, 3, 4}
        whole = spark.createDataFrame([(r[2], r[3]) for r in kept], "chunk_id long, chunk_text string")
        assert propagate.report(spark, root).collect() == lexical.report(whole).collect()
        df = lexical.document_frequencies(lexical.term_frequencies(lexical.index(whole)))
        assert sorted(map(tuple, snapshots.read(spark, root, propagate.TERMS).collect())) == sorted(map(tuple, df.collect()))


def test_pages_come_in_small_batches(spark):
    """a worker gets few pages at once, whatever the rows of its task, and tighter limits stay."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "10000")
        many = spark.range(1500).selectExpr("id page_id", "'https://x/' url", "concat('<a href=\"/p', id, '\">title ', id, '</a>') html").coalesce(1)
        found = pages.listing(many, ingestion.PORTAL, limit=2)
        assert int(spark.conf.get(name)) == pages.BATCH < 1500 and found.count() == 1500
        batches = many.mapInArrow(lambda parts: (pa.RecordBatch.from_pydict({"n": [p.num_rows]}) for p in parts), "n long").collect()
        assert max(r["n"] for r in batches) <= pages.BATCH
        spark.conf.set(name, "7")
        pages.listing(many, ingestion.PORTAL)
        assert spark.conf.get(name) == "7"
    finally:
        spark.conf.set(name, before)
