"""SimHash near duplicates: fingerprints, pigeonhole blocks, Hamming check, components.

Two fingerprints within `distance` bits agree on at least `blocks - distance` of `blocks` bit blocks. Each distinct
fingerprint is filed under every choice of that many blocks; files are sorted by key and streamed, and inside a file the
Hamming distance is verified. A file gives a spanning forest of its links, not all pairs, which keeps every component.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.llm.common import bounded_batches, by_place, free_name, map_text, pick, written
from lexloom.llm.components import components

SEED = 42
_LANES = np.random.default_rng(SEED).integers(0, 1 << 63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Fingerprints of a file that are compared pair by pair; a larger file goes through its one-bit neighbours instead, with the same links.
PAIRWISE = 96
#: A file of more fingerprints is dealt into smaller ones before neighbours are made, which take many times its memory; it has at most 2^22.
MOST_NEIGHBOURS = 20_000


def _fingerprints(shingle: int, most_hashes: int = 200_000):
    digest = xxhash.xxh64_intdigest

    def of(text: bytes | None) -> int:
        words = (text or b"").lower().split()
        if not words:
            return 0
        joined = b" ".join(words)
        if len(words) <= shingle:
            return digest(joined, SEED)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        n = len(words) - shingle + 1
        ones = np.zeros(64, np.int64)
        for a in range(0, n, most_hashes):
            b = min(n, a + most_hashes)
            h = np.fromiter([digest(joined[s:e], SEED) for s, e in zip(starts[a:b].tolist(), ends[a + shingle - 1 : b + shingle - 1].tolist())], np.uint64, b - a)
            ones += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        return int(sum(1 << i for i in np.flatnonzero(ones * 2 > n).tolist()))

    def work(texts):
        return [pa.array([np.uint64(of(t)).astype(np.int64).item() for t in texts], pa.int64())]

    return work


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, carry: bool = False, verdict: str = "_verdict") -> DataFrame:
    """The 64-bit SimHash of each text as a signed long `fp` (with `carry`: in the struct `verdict`).

    Words are what ASCII white space separates, after A-Z are lower-cased; a hash is XXH64 with seed 42 of `shingle` words
    joined by a space, repeats included. Fewer words: the whole sequence. Null, empty or blank texts: 0.
    """
    return map_text(docs, key, text, [T.StructField("fp", T.LongType())], _fingerprints(shingle), carry, verdict)


def wide_prints(hashes: np.ndarray, ptr: np.ndarray, lanes: int) -> np.ndarray:
    """Fingerprints of 64 bits in each of `lanes` columns, of texts whose shingles' hashes lie between the places of `ptr`.

    Each lane mixes the hashes anew; a bit is 1 if it is set in over half of them, as in the fingerprints of one lane. No hashes: 0.
    """
    out = np.zeros((len(ptr) - 1, lanes), np.uint64)
    for t in np.flatnonzero(np.diff(ptr)).tolist():
        ones = np.zeros(64 * lanes, np.int64)
        for a in range(int(ptr[t]), int(ptr[t + 1]), 255):
            h = hashes[a : min(a + 255, int(ptr[t + 1])), None] * _LANES[None, :lanes]
            h ^= h >> np.uint64(32)
            # At most 255 rows, so that counts fit a byte.
            ones += np.add.reduce(np.unpackbits(h.astype("<u8").view(np.uint8), axis=1, bitorder="little"), axis=0, dtype=np.uint8)
        out[t] = np.packbits(ones * 2 > ptr[t + 1] - ptr[t], bitorder="little").view("<u8")
    return out


def have_close(prints: np.ndarray, distance: int, at_once: int = 256) -> np.ndarray:
    """Which rows of fingerprints have another row within `distance` bits."""
    out = np.zeros(len(prints), bool)
    for a in range(0, len(prints), at_once):
        apart = np.bitwise_count(prints[a : a + at_once, None] ^ prints[None]).sum(axis=2, dtype=np.int32)
        out[a : a + at_once] = (apart <= distance).sum(axis=1) > 1  # itself is one
    return out


def block_masks(distance: int, blocks: int) -> list[int]:
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    masks = [sum(1 << b for b in range(edges[i], edges[i + 1])) for i in range(blocks)]
    return [sum(c) for c in combinations(masks, blocks - distance)]


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def forest(fps: np.ndarray, ids: np.ndarray, distance: int, free_bits: list[int]) -> list[tuple[int, int]]:
    """Links that connect all fingerprints of one file (distinct, equal on all bits but `free_bits`) within `distance`.

    Each link joins fingerprints that were verified to be within `distance`; linked fingerprints end up connected.
    """
    parent = list(range(len(fps)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    found: list[tuple[int, int]] = []

    def join(i: int, j: int) -> None:
        a, b = root(i), root(j)
        if a != b:
            parent[max(a, b)] = min(a, b)
            found.append((int(ids[i]), int(ids[j])))

    if len(fps) <= PAIRWISE or distance != 2:
        for i in range(len(fps) - 1):
            for j in (np.flatnonzero(_popcount(fps[i + 1 :] ^ fps[i]) <= distance) + i + 1).tolist():
                join(i, j)
        return found
    if len(fps) > MOST_NEIGHBOURS and len(free_bits) > 3:
        # Of three parts of the free bits two fingerprints within two bits agree on one: smaller files, each with the other parts free.
        for k in range(3):
            fixed = free_bits[k::3]
            part = fps & np.uint64(sum(1 << b for b in fixed))
            order = np.argsort(part, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
                if len(rows) > 1:
                    for a, b in forest(fps[rows], rows, distance, [f for f in free_bits if f not in fixed]):
                        join(a, b)
        return found
    # Within two bits: equal to each other's one-bit neighbours. Sorting all neighbours finds those without comparing pairs.
    flips = np.array([0, *(1 << b for b in free_bits)], np.uint64)
    near = (fps[:, None] ^ flips[None, :]).ravel()
    who = np.repeat(np.arange(len(fps)), len(flips))
    order = np.argsort(near, kind="stable")
    near, who = near[order], who[order]
    for k in np.flatnonzero(near[1:] == near[:-1]).tolist():
        join(int(who[k]), int(who[k + 1]))
    return found


def _linked(distance: int, masks: list[int]):
    free = [[b for b in range(64) if not m >> b & 1] for m in masks]
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def flush(rows: list[tuple[np.ndarray, ...]]) -> Iterator[tuple[int, int]]:
        if not rows:
            return
        file, key, fp, ident = (np.concatenate(c) for c in zip(*rows))
        same = (file[1:] == file[:-1]) & (key[1:] == key[:-1])
        if not same.any():
            return
        cuts = np.concatenate([[0], np.flatnonzero(~same) + 1, [len(key)]])
        sizes = np.diff(cuts)
        for a, n in zip(cuts[:-1][sizes == 2].tolist(), sizes[sizes == 2].tolist()):
            if int(fp[a] ^ fp[a + 1]).bit_count() <= distance:
                yield int(ident[a]), int(ident[a + 1])
        for a, n in zip(cuts[:-1][sizes > 2].tolist(), sizes[sizes > 2].tolist()):
            yield from forest(fp[a : a + n], ident[a : a + n], distance, free[int(file[a])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns)
            cols = (cols[0], cols[1], cols[2].astype(np.uint64), cols[3])
            last = np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]))
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut or (held and (held[-1][0][-1] != cols[0][0] or held[-1][1][-1] != cols[1][0])):
                links = list(flush([*held, tuple(c[:cut] for c in cols)] if cut else held))
                held = []
                if links:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*links)], schema=schema)
            held.append(tuple(c[cut:] for c in cols))
        links = list(flush(held))
        if links:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*links)], schema=schema)

    return run


def links(distinct: DataFrame, distance: int = 2, blocks: int = 6) -> DataFrame:
    """(a, b): ids of distinct fingerprints (columns fp, id) within `distance`, at least a spanning forest of all of them."""
    masks = block_masks(distance, blocks)
    filed = distinct.select(
        "fp", "id", F.explode(F.array(*[F.struct(F.lit(i).alias("file"), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)).alias("key")) for i, m in enumerate(masks)])).alias("f")
    ).select(F.col("f.file").alias("file"), F.col("f.key").alias("key"), "fp", "id")
    bounded_batches(distinct.sparkSession)
    # A file of a key is what shares about two thirds of all bits; its rows are distinct fingerprints only.
    return filed.repartition("file", "key").sortWithinPartitions("file", "key").mapInArrow(_linked(distance, masks), "a long, b long")


def labelled(prints: DataFrame, key: str, distance: int = 2, blocks: int = 6) -> DataFrame:
    """(fp, component_id) for each distinct fingerprint of the rows (key, fp)."""
    classes, _ = written(prints.groupBy("fp").agg(F.min(F.col(key)).alias("id")), "classes")
    found = components(links(classes.filter("id is not null").select("fp", F.col("id").cast("long").alias("id")), distance, blocks))
    return classes.join(found, classes["id"] == found["node"], "left").select("fp", F.coalesce("component", "id").alias("component_id"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, distance: int = 2, blocks: int = 6) -> DataFrame:
    """(key, fingerprint, component_id) for each row: its SimHash as 16 hex digits and the least key reachable over links.

    Equal fingerprints link, that of empty texts (zero) too. Repeated rows give repeated rows; a null key is no component's
    least and takes that of its fingerprint, null if all its keys are null. An empty table gives no rows.
    """
    prints, _ = written(fingerprints(docs, key, text, shingle), "fingerprints")
    out = prints.join(labelled(prints, key, distance, blocks), "fp")
    return out.select(F.col(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, distance: int = 2, blocks: int = 6) -> DataFrame:
    """One row of each group of near duplicates: that of the least key, with the columns of `docs`.

    Of several rows with that key one stays. Rows without a key stay only where no near duplicate has one, one for each
    fingerprint.
    """
    verdict = free_name(docs, "_verdict")
    whole, _ = written(fingerprints(docs, key, text, shingle, carry=True, verdict=verdict), "fingerprinted")
    prints = pick(whole, key, verdict).select(F.col(key), F.col(f"{verdict}.fp").alias("fp"))
    labels, _ = written(labelled(prints, key, distance, blocks), "labels")
    least = labels.filter("component_id is not null").select(F.col("component_id").alias("_keep")).distinct()
    plain = by_place(whole)
    k, fp = f"_c{whole.columns.index(key)}", f"_c{whole.columns.index(verdict)}.fp"
    # The window keeps the join's partitioning by key; keys repeat seldom, and its group limit keeps one row of each as it reads.
    kept = plain.join(least, plain[k] == least["_keep"], "left_semi")
    once = kept.withColumn("_n", F.row_number().over(Window.partitionBy(k).orderBy(F.col(fp)))).filter("_n = 1").drop("_n")
    alone = labels.filter("component_id is null").select(F.col("fp").alias("_fp"))
    keyless = plain.filter(F.col(k).isNull()).withColumn("_fp", F.col(fp)).join(alone, "_fp", "left_semi").dropDuplicates(["_fp"]).drop("_fp")
    rows = once.unionByName(keyless)
    return rows.drop(f"_c{whole.columns.index(verdict)}").toDF(*[c for c in whole.columns if c != verdict])
