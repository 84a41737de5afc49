from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexloom.llm import repeats
from lexloom.llm.suffixes import common_prefixes, suffix_array


def plain(rows, window=repeats.WINDOW):
    """Every window after another, in the order of the rows' keys, null ones last."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, hashlib.sha256((rows[i][1] or "").encode()).digest()[:3]))
    seen, out = set(), []
    for i in order:
        t = (rows[i][1] or "").encode()
        gone = bytearray(len(t))
        for p in range(len(t) - window + 1):
            w = t[p : p + window]
            if w in seen:
                gone[p : p + window] = b"\1" * window
            seen.add(w)
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = sum(1 for p, g in enumerate(gone) if g and (p == 0 or not gone[p - 1]))
        out.append((rows[i][0], len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in repeats.remove_repeats(df).collect()), key=str)


def text(r, n, letters="abcdefghij   éè中\n"):
    return "".join(r.choice(letters) for _ in range(n))


def corpus(seed, n=80):
    """Texts with copies, edited copies, a line that a third of all rows share, passages of just under, at and over the window, and repeats of their own."""
    r = random.Random(seed)
    line, exact, under = text(r, 130), "p" + text(r, 300, "abcdefgh")[:99], text(r, 99, "abcdefgh")
    whole = [text(r, r.choice([0, 50, 99, 100, 101, 400, 1500])) for _ in range(n)]
    rows = []
    for i, t in enumerate(whole):
        if i % 3 == 0:
            t = t[: len(t) // 2] + line + t[len(t) // 2 :]
        if i % 7 == 0:
            t = t + exact + text(r, 3) + under
        if i % 5 == 0:
            t = t + t[: len(t) // 2]
        rows.append(t)
        if i % 4 == 0:
            rows.append(t)
            at = r.randrange(len(t) + 1)
            rows.append(t[:at] + text(r, r.choice([1, 30])) + t[at + r.choice([0, 1]) :])
    rows += ["a" * 1000, "a" * 150, "ab" * 400, "ab" * 60 + "c"]
    keys = list(range(len(rows)))
    r.shuffle(keys)
    return list(zip(keys, rows))


@pytest.mark.parametrize("seed", [1, 2])
def test_like_every_window_after_another(spark, seed):
    rows = corpus(seed)
    want = plain(rows)
    assert sum(w[2] for w in want) > 10_000
    assert got(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)) == want


def test_same_rows_when_anchors_are_dealt_over_many_shards(spark, monkeypatch):
    rows = corpus(3)
    want = plain(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    monkeypatch.setattr(repeats, "SHARED", 2)
    assert got(df) == want
    monkeypatch.setattr(repeats, "SAMPLE", 1)
    monkeypatch.setattr(repeats, "FREQUENT", 3)
    assert got(df) == want


def test_small_pieces_slices_and_shards(monkeypatch):
    r = random.Random(4)
    t = np.frombuffer((text(r, 700) * 3 + "x" * 300).encode(), np.uint8)
    whole = repeats.anchors(t)
    assert whole[3].sum() == len(t) - repeats.WINDOW + 1 and (np.diff(whole[2]) == whole[3][:-1]).all()
    monkeypatch.setattr(repeats, "PIECE", 64)
    small = repeats.anchors(t)
    assert small[3].sum() == whole[3].sum()
    of = lambda made: np.repeat(made[0], made[3])
    assert (of(small) == of(whole)).all()  # a window's anchor hangs on its own bytes alone


def test_odd_rows(spark, odd, odd_rows, clashing, none):
    rows = [(k, t) for k, t, *_ in odd_rows]
    want = plain(rows)
    assert got(odd) == want
    assert got(clashing.select("*", F.lit(1).alias("row"), F.lit(1).alias("sha"), F.lit(2).alias("key"))) == want
    assert repeats.remove_repeats(none).columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] and got(none) == []


def test_rows_of_one_key_and_without_keys(spark):
    r = random.Random(6)
    a, b = text(r, 500), text(r, 400)
    rows = [(5, a + "1"), (5, "2" + a), (5, a + "1"), (None, b), (None, b), (None, b + "x"), (7, None), (7, ""), (2, b[:150])]
    assert got(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == plain(rows)


def test_suffix_arrays_and_prefixes_like_sorting(spark):
    r = random.Random(7)
    for _ in range(300):
        s = bytes(r.randrange(r.choice([1, 2, 3, 256])) for _ in range(r.choice([0, 1, 2, 3, 8, 60, 150]))) * r.choice([1, 1, 2, 5])
        sa = suffix_array(s)
        assert sa.tolist() == sorted(range(len(s)), key=lambda i: s[i:])
        if s:
            before, common = common_prefixes(np.frombuffer(s, np.uint8), sa)
            for k, i in enumerate(sa.tolist()):
                j = int(sa[k - 1]) if k else -1
                n = 0
                while j >= 0 and n < len(s) - max(i, j) and s[i + n] == s[j + n]:
                    n += 1
                assert before[i] == j and common[i] == n
