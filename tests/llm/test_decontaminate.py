from __future__ import annotations

import hashlib
import random
import re

import pytest

from lexloom.llm import decontaminate as d

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window=10):
    wins = {}
    for i, t in items:
        w = words(t)
        for p in range(max(1, len(w) - window + 1) if w else 0):
            wins.setdefault(tuple(w[p : p + window]), set()).add("" if i is None else str(i))
    out = []
    for k, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in wins}:
            for p in range(len(w) - n + 1):
                if (key := tuple(w[p : p + n])) in wins:
                    found |= wins[key]
                    hit.update(range(p, p + n))
        out.append((k, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit), longest(w, items, window)))
    return sorted(out, key=str)


def longest(w, items, window):
    """The most words that follow each other in the text and in one item and are covered by common windows."""
    best = 0
    for _, t in items:
        v = words(t)
        n = min(window, len(v))
        for shift in range(-len(w), len(v)) if n else ():
            run = 0
            for i, x in enumerate(v):
                run = run + 1 if 0 <= i - shift < len(w) and w[i - shift] == x else 0
                best = max(best, run if run >= n else 0)
    return best


@pytest.fixture
def items():
    r = random.Random(5)
    vocabulary = "the of and river stone green walks under seven lamps".split()
    run = " ".join(r.choice(vocabulary) for _ in range(40))
    return [(1, run), (2, "Seven lamps"), (3, ""), (4, None), (10, "中文 \U0001f600 1234"), (5, run), (None, "walks UNDER; seven"), (1, "stone")]


def test_like_brute_force(spark, clashing, odd_rows, items):
    r = random.Random(6)
    run = items[0][1]
    more = [(100 + i, " ".join(["zz"] * r.randint(0, 3)) + " " + " ".join(run.split()[r.randint(0, 20) :][: r.randint(1, 30)]) + "-tail") for i in range(40)]
    rows = [(x[0], x[1]) for x in odd_rows] + more
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute(rows, items)
    assert sorted((tuple(x) for x in d.contamination(docs, bench).collect()), key=str) == want
    # One item in a block: several passes give the same.
    assert sorted((tuple(x) for x in d.contamination(docs, bench, block_bytes=1).collect()), key=str) == want
    assert d.contamination(clashing, bench).count() == len(odd_rows)


def test_longest_matches_and_places(spark, items):
    run = items[0][1].split()
    docs = spark.createDataFrame([(1, "a b " + " ".join(run[3:33]) + " c d " + " ".join(run[20:31]))], "doc_id long, text string")
    bench = spark.createDataFrame(items[:1], "item_id long, text string")
    found = d.scan(docs, bench, with_matches=True).first()["matches"]
    assert sorted((m["item_id"], m["item_word"], m["doc_word"], m["n_words"]) for m in found) == [("1", 3, 2, 30), ("1", 20, 34, 11)]


def test_empty_sides(spark, odd, none, items):
    empty = spark.createDataFrame([], "item_id long, text string")
    assert not any(r["contaminated"] for r in d.contamination(odd, empty).collect())
    assert d.contamination(none, spark.createDataFrame(items, "item_id long, text string")).count() == 0


def test_removes_contaminated(spark, clashing, odd_rows):
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven")], "item_id long, text string")
    kept = d.decontaminate(clashing, bench)
    assert kept.columns == clashing.columns
    assert sorted((r[0] is None, r[0] or 0) for r in kept.collect()) == sorted((x[0] is None, x[0] or 0) for x in odd_rows if not (x[1] or "").startswith("One two"))
