from __future__ import annotations

import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from lexloom.llm import spelling


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain(rows):
    n = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in spelling.variants(df).collect())


def edited(r, word, letters):
    i = r.randrange(len(word) + 1)
    kind = r.randrange(3)
    if kind == 0:
        return word[:i] + r.choice(letters) + word[i:]
    i = min(i, len(word) - 1)
    return word[:i] + (r.choice(letters) if kind == 1 else "") + word[i + 1 :]


def test_like_all_pairs_on_edited_words(spark):
    for seed, letters in ((1, "ab"), (2, "abcdeé"), (3, "abcdefghijklmnopqrstuvwxyzàÿ")):
        r = random.Random(seed)
        known = ["".join(r.choice(letters) for _ in range(r.randrange(4, 11))) for _ in range(40)]
        for w in list(known):
            v = w
            for _ in range(r.randrange(4)):
                v = edited(r, v, letters)
                if v:
                    known.append(v)
        weights = [r.choice([1, 2, 5, 20]) for _ in known]
        rows = [(i, " ".join(x.upper() if r.random() < 0.2 else x for x in r.choices(known, weights, k=120))) for i in range(25)]
        want = plain(rows)
        assert sum(w[4] for w in want) > 20
        assert got(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == want


def test_every_edit_of_a_word_is_near_it(spark):
    words = {"banana"} | {"banana"[:i] + c + "banana"[i + k :] for i in range(7) for k in (0, 1) for c in ("", "a", "b", "z")}
    words = sorted(w for w in words if len(w) >= 5)
    known = spark.createDataFrame([(w, 3) for w in words], "word string, n long")
    pairs = {tuple(p) for p in spelling.near_words(known).collect()}
    assert pairs == {(a, b) for a in words for b in words if a < b and one_edit(a, b)}


def test_chains_of_forms_lead_to_the_root(spark):
    chain = ["abcdefgh", "abcdefgx", "abcdefyx", "abcdezyx", "abcdwzyx", "abcvwzyx"]
    rows = [(1, " ".join(w for k, w in enumerate(chain) for _ in range(3 * 2**k)))]
    want = plain(rows)
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == want
    assert len({w[2] for w in want}) < len(want)


def test_odd_rows(spark, odd, odd_rows, clashing, none):
    extra = [(None, "alpha alphas alphas alphas alpha alpha"), (20, "ABCDE abcde ÀBCDE àbcde abcdé " * 3), (20, "ABCDE abcde ÀBCDE àbcde abcdé " * 3), (21, "ſtraße x÷y×zzzz ÿÿÿÿÿ ÿÿÿÿÿ ÿÿÿÿÿ ÿÿÿÿÿ"), (22, "long" * 40_000 + " " + "long" * 40_000 + " " + "long" * 40_000)]
    rows = [(k, t) for k, t, *_ in odd_rows] + extra
    more = spark.createDataFrame(extra, "doc_id long, text string")
    assert got(odd.select("doc_id", "text").unionByName(more)) == plain(rows)
    assert got(clashing.select("*", F.lit(1).alias("word"), F.lit(1).alias("run"), F.lit(2).alias("key"))) == plain([(k, t) for k, t, *_ in odd_rows])
    assert spelling.variants(none).columns == ["word", "form", "root", "n", "n_near", "form_n"] and got(none) == []
