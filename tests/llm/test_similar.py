from __future__ import annotations

import random

import corpus_pipeline
import numpy as np

from lexloom.llm import similar


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def similarity(a, b):
    x, y = shingle_set(a), shingle_set(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def brute(rows, least=0.8):
    """Kept ids: the least of each group that pairs of at least the similarity connect."""
    parent = {k: k for k, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (a, t) in enumerate(rows):
        for b, u in rows[i + 1 :]:
            if similarity(t, u) >= least:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return sorted({root(k) for k in parent})


def edited_rows():
    """Texts, copies of them edited to similarities of 0.6 to 0.95, copies of copies, identical and short texts."""
    r, rows = random.Random(11), []
    for _ in range(25):
        base = [f"w{r.randrange(5000)}" for _ in range(r.choice([60, 200, 700]))]
        rows.append(" ".join(base))
        for share in (0.003, 0.01, 0.02, 0.025, 0.04):
            copy = list(base)
            for at in r.sample(range(len(copy)), max(1, round(share * len(copy)))):
                copy[at] = f"x{r.randrange(5000)}"
            rows.append(" ".join(copy))
            if share == 0.02:
                base = copy
        rows.append("  ".join(base).upper())
    rows += ["", None, " \n", "a b c", "A b  c", "a b d", "one two three four five", "one two three four six"]
    r.shuffle(rows)
    return list(enumerate(rows))


def test_near_duplicate_stage_like_brute_force_on_edited_copies(spark):
    rows = edited_rows()
    got = [similarity(a, b) for i, (_, a) in enumerate(rows) for _, b in rows[i + 1 :]]
    assert sum(0.8 <= s < 0.95 for s in got) > 50 and sum(0.6 <= s < 0.8 for s in got) > 20
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(r[0] for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()) == brute(rows)


def test_linked_like_brute_force():
    r = np.random.default_rng(5)
    for n in (2, 3, 40):
        base = np.arange(100, dtype=np.uint64)
        sets = [np.unique(np.concatenate([base[r.random(100) < 0.93], r.integers(1000, 9999, 3).astype(np.uint64)])) for _ in range(n)]
        sets += [s + np.uint64(20_000) for s in sets]
        near = {(i, j) for i in range(2 * n) for j in range(i) if 5 * (both := len(np.intersect1d(sets[i], sets[j]))) >= 4 * (len(sets[i]) + len(sets[j]) - both)}

        def groups(links, n=n):
            label = list(range(2 * n))
            for _ in label:
                for i, j in links:
                    label[i] = label[j] = min(label[i], label[j])
            return label

        links = similar.linked(sets)
        assert groups(links) == groups(near) and all((max(x), min(x)) in near for x in links)


def test_odd_rows_keep_one_of_each_group(spark, clashing, none):
    kept = similar.deduplicate(clashing)
    assert kept.columns == clashing.columns
    assert sorted(r[0] for r in kept.collect()) == [-9, 1, 3, 6, 7, 8]
    assert similar.deduplicate(none).count() == 0
    alone = spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (None, "z y x w v")], "doc_id long, text string")
    assert similar.deduplicate(alone).count() == 2


def test_large_groups_in_blocks_give_the_same(spark, monkeypatch):
    rows = edited_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(similar, "CELL_SHINGLES", 150)
    assert sorted(r[0] for r in similar.deduplicate(docs).collect()) == brute(rows)


def test_candidates_hold_all_pairs_that_share_a_key(spark):
    r = random.Random(2)
    bands = {n: sorted(r.sample(range(40), 3)) for n in range(60)}
    same = bytearray(8 * similar.LANES)
    classes = spark.createDataFrame([(n, n * 7, 900_000, b, same) for n, b in bands.items()], "node long, row long, size long, bands array<long>, print binary")
    cells = {}
    for row in similar.candidates(classes).collect():
        assert row["row"] == 7 * row["node"]
        cells.setdefault((row["group"], row["i"], row["j"]), set()).add(row["node"])
    together = {(a, b) for c in cells.values() for a in c for b in c if a < b}
    assert together == {(a, b) for a in bands for b in bands if a < b and set(bands[a]) & set(bands[b])}
    assert max(j for *_, j in cells) > 0


def test_prints_verify_what_shares_a_block(spark):
    """Members far from all others by Hamming distance go; similar texts are never that far."""
    rows = edited_rows()
    texts = [(t or "").encode() for _, t in rows]
    h, ptr = similar.shingles(texts)
    prints = similar.wide_prints(h, ptr, similar.LANES)
    apart = lambda i, j: int(np.bitwise_count(prints[i] ^ prints[j]).sum())
    close = [apart(i, j) for i in range(len(rows)) for j in range(i) if 0.8 <= similarity(rows[i][1], rows[j][1]) < 1]
    far = [apart(i, j) for i in range(len(rows)) for j in range(i) if similarity(rows[i][1], rows[j][1]) < 0.1 and len(texts[i]) > 200 < len(texts[j])]
    assert max(close) <= similar.FAR < min(far)
    want = [any(apart(i, j) <= similar.FAR for j in range(len(rows)) if j != i) for i in range(len(rows))]
    assert similar.have_close(prints, similar.FAR, at_once=7).tolist() == want and not all(want)
    classes = spark.createDataFrame([(i, i, 1, [5], bytearray(p.tobytes())) for i, p in enumerate(prints)], "node long, row long, size long, bands array<long>, print binary")
    assert sorted(r["node"] for r in similar.candidates(classes).collect()) == [i for i, w in enumerate(want) if w]


def test_a_lane_is_the_fingerprint_of_its_hashes():
    r = np.random.default_rng(1)
    h = r.integers(0, 1 << 63, 700, dtype=np.uint64)
    ptr = np.array([0, 0, 1, 300, 700])
    prints = similar.wide_prints(h, ptr, 2)
    from lexloom.llm import simhash

    for t in range(4):
        for lane in range(2):
            own = [x * int(simhash._LANES[lane]) % (1 << 64) for x in h[ptr[t] : ptr[t + 1]].tolist()]
            own = [x ^ x >> 32 for x in own]
            assert int(prints[t, lane]) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in own) > len(own))
