from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from lexloom.llm import packing, simhash
from lexloom.llm.components import components


def fingerprint(text: str | None) -> int:
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def reach(ids, prints, distance=2):
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= distance:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def test_near_duplicates_like_brute_force(spark, odd, odd_rows):
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(odd).collect())
    ids = [r[0] for r in odd_rows if r[0] is not None]
    least = reach(ids, {r[0]: fingerprint(r[1]) for r in odd_rows if r[0] is not None})
    want = []
    for k, t, *_ in odd_rows:
        fp = fingerprint(t)
        component = least[k] if k is not None else min((least[i] for i in ids if fingerprint(next(r[1] for r in odd_rows if r[0] == i)) == fp), default=None)
        want.append((k is None, k or 0, f"{fp:016x}", component))
    assert got == sorted(want)


def test_links_of_crowded_files(spark):
    """A center with all its one- and two-bit neighbours, and random fingerprints: as many components as by brute force."""
    r = random.Random(1)
    center = r.getrandbits(64)
    fps = {center} | {center ^ (1 << a) ^ (1 << b) for a in range(20) for b in range(20)} | {r.getrandbits(64) for _ in range(200)}
    fps = sorted(fps)
    rows = [(fp - (1 << 64) if fp >> 63 else fp, i) for i, fp in enumerate(fps)]
    found = {r["node"]: r["component"] for r in components(simhash.links(spark.createDataFrame(rows, "fp long, id long"))).collect()}
    want = reach(range(len(fps)), fps)
    assert {i: found.get(i, i) for i in range(len(fps))} == want


@pytest.mark.parametrize("n,most", [(5, 20_000), (simhash.PAIRWISE + 50, 20_000), (simhash.PAIRWISE + 50, 30)])
def test_forest_ways_agree(n, most, monkeypatch):
    monkeypatch.setattr(simhash, "MOST_NEIGHBOURS", most)
    if most == 30:
        monkeypatch.setattr(simhash, "PAIRWISE", 4)
    r = random.Random(n)
    base = r.getrandbits(64)
    fps = np.array(sorted({base ^ sum(1 << b for b in r.sample(range(20), r.randint(0, 4))) for _ in range(n * 3)})[:n], np.uint64)
    ids = np.arange(len(fps))
    links = simhash.forest(fps, ids, 2, list(range(20)))
    assert all((int(fps[a]) ^ int(fps[b])).bit_count() <= 2 for a, b in links)
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    assert {i: root(i) for i in range(len(fps))} == reach(range(len(fps)), [int(f) for f in fps])


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, k) for k in range(101, 160)] + [(7, 7)]
    got = {r[0]: r[1] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(51)} | {k: 100 for k in range(100, 160)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_deduplicate_keeps_one_of_each_group(spark, clashing, none):
    kept = simhash.deduplicate(clashing)
    assert kept.columns == clashing.columns
    # 1 stands for its copies, 3 for the empty texts; those without a key have near duplicates with one.
    assert sorted(r[0] for r in kept.collect()) == [-9, 1, 3, 6, 7, 8]
    assert simhash.deduplicate(none).count() == 0 and simhash.near_duplicates(none).count() == 0
    alone = spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (None, "z y x w v")], "doc_id long, text string")
    assert simhash.deduplicate(alone).count() == 2


def test_plan_fills_sequences():
    r = random.Random(2)
    for size in (1, 30, 3000):
        counts = Counter(min(2048, max(1, int(r.lognormvariate(5.5, 1.4)))) for _ in range(size))
        runs = packing.plan(counts)
        seats: dict[int, list[tuple[int, int]]] = {}
        for length, first, n, seq, offset in runs:
            for i in range(n):
                seats.setdefault(seq + i, []).append((offset, length))
        assert Counter(length for s in seats.values() for _, length in s) == counts
        for s in seats.values():
            at = 0
            for offset, length in sorted(s):
                assert offset == at
                at += length
            assert at <= 2048 and sum(3 * length > 2048 for _, length in s) <= 2
        total = sum(k * v for k, v in counts.items())
        large = sum(v for k, v in counts.items() if k > 1024)
        assert len(seats) <= max(large, -(-total // 2048)) * 1.1 + 1
    assert packing.plan({}) == []
    with pytest.raises(ValueError):
        packing.plan({0: 1})


def test_pack_equals_the_plain_tokenizer(spark, clashing, odd_rows, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = packing.pack(clashing, keep_ids=True).collect()
    want = Counter()
    for k, t, *_ in odd_rows:
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for p, (a, n) in enumerate(packing.cuts(len(ids), 2048)):
            want[(k, p, a, n, zlib.crc32(ids[a : a + n].tobytes()), ids[a : a + n].tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"], bytes(r["ids"])) for r in rows) == want
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sorted(by) == list(range(len(by)))
    for s in by.values():
        assert [o for o, _ in sorted(s)] == [sum(n for _, n in sorted(s)[:i]) for i in range(len(s))] and sum(n for _, n in s) <= 2048
    assert packing.pack(none).count() == 0


def test_ids_of_the_end_token_are_those_of_the_plain_tokenizer(spark):
    """The contract's tokenizer as it is loaded, without settings of its own."""
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["hello <|endoftext|> world", "<|endoftext|><|endoftext|>", "a<|endoftext|>\n\n b", "<|endoftext|", " <|ENDOFTEXT|> ", "é<|endoftext|>中", "x " * 3000 + "<|endoftext|>"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = [np.array([*plain.encode(t, add_special_tokens=False).ids, 0], "<u4") for t in texts]
    assert want[0].tolist() == [31373, 220, 50256, 995, 0]
    for vocabulary in (None, public_tokenizers.path("byte_bpe_50k.json")):
        got = {}
        for r in sorted(packing.pack(docs, vocabulary=vocabulary, keep_ids=True).collect(), key=lambda r: r["piece"]):
            got[r["doc_id"]] = got.get(r["doc_id"], b"") + bytes(r["ids"])
        assert got == {i: ids.tobytes() for i, ids in enumerate(want)}


def test_cuts():
    assert packing.cuts(1, 4) == [(0, 1)] and packing.cuts(4, 4) == [(0, 4)]
    assert packing.cuts(9, 4) == [(0, 1), (1, 4), (5, 4)] and packing.cuts(8, 4) == [(0, 4), (4, 4)]
