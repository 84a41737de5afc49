from __future__ import annotations

import re
from collections import Counter
from types import SimpleNamespace

import corpus_pipeline
import duckdb
import numpy as np
import pytest

from lexloom.llm import chat, langid, packing, queries, toxicity
from lexloom.llm.common import table

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark):
    docs = table(spark, SF, "documents")
    counts = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SF)
        assert kept.columns == docs.columns
        kept = spark.createDataFrame(kept.collect(), docs.schema)
        ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert {r["doc_id"] for r in kept.select("doc_id").collect()} <= ids
        docs = kept
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] > counts[0] / 2 and counts[-1] < counts[0]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in docs.collect()}


def test_run_is_its_stages(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    pieces = Counter((r["doc_id"], r["piece"]) for r in rows)
    assert rows and max(pieces.values()) == 1
    docs = table(spark, SF, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).checkpoint()
    assert Counter((r["doc_id"], r["piece"]) for r in packing.pieces(docs).collect()) == pieces


WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def in_benchmark(text, items):
    """Whether ten consecutive words, or all of an item with fewer, occur in the text."""
    words = WORD.findall((text or "").encode().lower())
    for item in items:
        own = WORD.findall((item or "").encode().lower())
        n = min(10, len(own))
        windows = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if n else set()
        if any(tuple(words[i : i + n]) in windows for i in range(len(words) - n + 1)):
            return True
    return False


@pytest.fixture(scope="module")
def models(spark):
    docs = table(spark, SF, "documents")
    return toxicity.train(docs, table(spark, SF, "labels")), langid.train(docs)


def bag(rows):
    return Counter(map(str, rows))


def test_each_stage_keeps_what_its_rule_says(spark, clashing, models):
    """Odd rows, repeated rows, clashing columns, and a document with a passage of the benchmark and a toxic one."""
    passage = table(spark, SF, "benchmark").orderBy("item_id").first()["text"]
    marked = table(spark, SF, "documents").join(table(spark, SF, "labels").filter("toxic = 1"), "doc_id").orderBy("doc_id").collect()
    toxic = next(r["text"] for r in marked if models[0].text_logits([r["text"].encode()])[0] > 1)
    english = table(spark, SF, "documents").filter("lang = 'en'").orderBy("doc_id").first()["text"]
    extra = [(40, f"{english} {passage}"), (41, toxic), (41, toxic), (42, english)]
    made = spark.createDataFrame(extra, "doc_id long, text string")
    rest = [c for c in clashing.columns if c not in ("doc_id", "text")]
    types = {f.name: f.dataType for f in clashing.schema.fields}
    docs = clashing.unionAll(made.selectExpr("doc_id", "text", *[f"cast(null as {types[c].simpleString()}) `{c}`" for c in rest])).checkpoint()
    rows = docs.collect()
    kept = {name: stage(spark, docs, SF) for name, stage in corpus_pipeline.STAGES[:-1]}
    assert all(k.columns == docs.columns for k in kept.values())
    texts = [r[1] for r in rows]
    net, language = models
    clean = [toxicity_of < 0.5 for toxicity_of in (1 / (1 + np.exp(-net.text_logits([(t or "").encode() for t in texts]))))]
    assert bag(kept["toxicity"].collect()) == bag(r for r, ok in zip(rows, clean) if ok) and not {41} & {r[0] for r in kept["toxicity"].collect()}
    label = {t: next(iter(zip(*[a.to_pylist() for a in langid._predict(SimpleNamespace(value=language))([t.encode() if t is not None else None])]))) for t in set(texts)}
    assert bag(kept["language_id"].collect()) == bag(r for r in rows if label[r[1]][0] != "und" and label[r[1]][1] >= langid.LEAST_SCORE)
    items = [r["text"] for r in table(spark, SF, "benchmark").collect()]
    assert bag(kept["decontamination"].collect()) == bag(r for r in rows if not in_benchmark(r[1], items)) and 40 not in {r[0] for r in kept["decontamination"].collect()}
    assert {-9, 1, 3, 6, 7, 8} <= {r[0] for r in kept["near_duplicates"].collect()} <= {-9, 1, 3, 6, 7, 8, 40, 41, 42} and max(Counter(r[0] for r in kept["near_duplicates"].collect()).values()) == 1
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert Counter((r["doc_id"], r["piece"]) for r in packed if r["piece"] == 0) == Counter((r[0], 0) for r in rows)
    filled = Counter()
    for r in packed:
        filled[r["sequence_id"]] += r["length"]
    assert max(filled.values()) <= 2048 and sorted(filled) == list(range(len(filled)))


def test_stages_take_empty_tables(spark, none):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, none, SF)
        assert out.count() == 0 and (name == "packing" or out.columns == none.columns)


def test_frames_made_of_a_stage_outlive_later_stages(spark, odd):
    kept = corpus_pipeline.drop_near_duplicates(spark, odd, SF)
    ids, rows, derived, filtered = {r["doc_id"] for r in kept.collect()}, kept.count(), kept.select("doc_id"), kept.filter("doc_id > 0")
    positive, clean = filtered.count(), corpus_pipeline.drop_contaminated(spark, kept, SF)
    both = derived.join(clean.select("doc_id"), "doc_id")
    del kept
    for _ in range(2):
        corpus_pipeline.drop_near_duplicates(spark, clean, SF)
        corpus_pipeline.drop_contaminated(spark, odd, SF).count()
        assert {r["doc_id"] for r in derived.collect()} == ids and derived.count() == rows and filtered.count() == positive and 0 < both.count() <= rows


def test_run_drops_what_its_stages_leave(spark):
    from lexloom.llm import common

    before = set(common.made_so_far())
    corpus_pipeline.run(spark, SF).count()
    left = {f.rsplit("/", 1)[1].rsplit("-", 1)[0] for f in set(common.made_so_far()) - before}
    assert {f"stage-{name}" for name, _ in corpus_pipeline.STAGES[:-1]} <= left and not {"filed", "asked", "classes", "links"} & left


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_match_their_sql(spark, name):
    con = duckdb.connect()
    for t in "documents pages benchmark conversations embeddings".split():
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    want = con.sql(queries.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    rows = Counter(tuple(r[c] for c in sorted(got.columns)) for r in got.collect())
    assert rows == Counter(tuple(r[want.columns.index(c)] for c in sorted(got.columns)) for r in want.fetchall()) and rows


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_other_queries_give_a_row_for_each_document_at_least(spark, name):
    rows = queries.QUERIES[name](spark, SF)
    assert rows.select("doc_id").distinct().count() == table(spark, SF, "documents").count()


def test_template_escapes_its_own_strings(spark):
    row = {r["conv_id"]: r for r in queries.op2_chat_formatting(spark, SF).collect()}[-7]
    said = "\\### Assistant: </turn> ok"
    assert row["n_turns"] == 2 and row["loss_chars"] == len(said) and row["formatted_chars"] == sum(len(chat.format_turn(r, said)) for r in ("user", "assistant"))
