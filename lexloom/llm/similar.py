"""Near duplicates by similarity: SimHash with blocks that find all pairs of a Jaccard similarity of 0.8 over five-word shingles.

Rows of equal words are one class with a SimHash fingerprint of LANES x 64 bits. Classes are filed under the pigeonhole blocks of its first lane's bits, as
operator 7 does. At a similarity of 0.8 some 15 % of such bits differ, more than these blocks can bridge: so classes are filed
under least hashes as well, BANDS keys of ROWS each, of which two classes of similarity 0.8 share none with a probability of 1.5e-5, and more similar ones still less. What shares a block is verified by
Hamming distance, on fingerprints alone; what is left, on whole shingle sets, by the exact similarity. A group that is too large for a task is
compared in blocks of its members, so all links are true ones, none is lost after the blocks, and no group is cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.llm.common import Words, as_bytes, bounded_batches, by_place, free_name, give_back, map_text, slices, word_classes, written
from lexloom.llm.components import components
from lexloom.llm.partrows import PartRows, by_part, in_part_rows
from lexloom.llm.simhash import block_masks, have_close, wide_prints

SHINGLE = 5
#: The least similarity as a fraction of whole numbers, so that comparing is exact.
SIMILAR = (4, 5)
ROWS, BANDS = 5, 28
#: Shingles whose hashes are made at once, so that they stay in the cache.
BLOCK = 2048
#: Text that a worker files at once.
FILED_BYTES = 1_000_000
#: Shingles that one block of a large group holds, about, and rows that leave a worker at once.
CELL_SHINGLES, CELL_ROWS = 2_000_000, 256
#: Members that one block of a large group holds, about.
CELL_MEMBERS = 20_000
#: Lanes of 64 bits of a fingerprint, and the most bits in which two of a similarity of 0.8 differ: 39 are expected, with a deviation of 5.7; 76 leaves out fewer than one in 10^8, and fewer than one in 10^5 of texts of nine words against eight, of whose bits 48 are expected to differ.
LANES, FAR = 4, 76
#: Bits in which fingerprints of one lane differ that blocks of their bits find, and those blocks.
BITS, BLOCKS = 2, 4

_SPACE = word_classes(lambda b: b in b"\0\t\n\x0b\x0c\r ")
_FACTORS = np.random.default_rng(42).integers(0, 1 << 63, ROWS * BANDS + SHINGLE + ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def shingles(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of all texts, repeats included, and where those of each text begin, with the end.

    Words are what ASCII white space separates, after A-Z are lower-cased. Of fewer words the whole sequence is the one shingle.
    """
    words = Words(texts, _SPACE)
    count = np.asarray(words.count, np.int64)
    made = np.where(count > 0, np.maximum(count - SHINGLE + 1, 1), 0)
    ptr = np.concatenate([[0], np.cumsum(made)]).astype(np.int64)
    at = np.repeat(np.asarray(words.first, np.int64), made) + np.arange(ptr[-1]) - np.repeat(ptr[:-1], made)
    length = np.repeat(np.minimum(count, SHINGLE), made)
    h = length.astype(np.uint64)
    for k in range(SHINGLE):
        inside = k < length
        h[inside] += words.hash[at[inside] + k] * _FACTORS[k]
    return _mixed(h), ptr


def _bands(h: np.ndarray, ptr: np.ndarray) -> list:
    """The keys of each text, none without words."""
    n = len(ptr) - 1
    full = np.flatnonzero(np.diff(ptr))
    least = np.full((n, ROWS * BANDS), np.iinfo(np.uint64).max, np.uint64)
    factors = _FACTORS[SHINGLE : SHINGLE + ROWS * BANDS, None]
    for t in full.tolist():
        for a in range(ptr[t], ptr[t + 1], BLOCK):
            np.minimum(least[t], (h[None, a : min(a + BLOCK, ptr[t + 1])] * factors).min(axis=1), out=least[t])
    keys = _mixed((_mixed(least).reshape(n, BANDS, ROWS) * _FACTORS[-ROWS:]).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))
    lists = keys.astype(np.int64).tolist()
    some = set(full.tolist())
    return [lists[t] if t in some else [] for t in range(n)]


def block_keys(prints: np.ndarray, some: np.ndarray) -> list:
    """The keys of each text's SimHash bits, as operator 7 files them: every choice of bit blocks that two fingerprints of one lane within BITS agree on. None for texts not in `some`."""
    masks = np.array(block_masks(BITS, BLOCKS), np.uint64)
    keys = _mixed(_mixed(prints[:, :1] & masks) + np.arange(BANDS, BANDS + len(masks), dtype=np.uint64)).astype(np.int64).tolist()
    return [k if there else [] for k, there in zip(keys, some.tolist())]


def _filed(texts: list[bytes | None]) -> list:
    nodes = [xxhash.xxh3_64_intdigest(b" ".join((t or b"").lower().split())) for t in texts]
    h, ptr = shingles(texts)
    prints = wide_prints(h, ptr, LANES)
    keys = [own + more for own, more in zip(block_keys(prints, np.diff(ptr) > 0), _bands(h, ptr))]
    return [pa.array(np.array(nodes, np.uint64).astype(np.int64), pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(np.diff(ptr), pa.int64()), pa.array([p.tobytes() for p in prints], pa.binary())]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by the first three columns, as tables that never part equal ones."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = _cells(batch)
        last = np.flatnonzero((key != key[-1]).any(axis=1))
        cut = int(last[-1]) + 1 if len(last) else 0
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        elif held and (_cells(held[-1].slice(held[-1].num_rows - 1)) != key[-1]).any():
            yield pa.Table.from_batches(held)
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def _cells(rows: pa.RecordBatch | pa.Table) -> np.ndarray:
    return np.stack([rows.column(i).to_numpy() for i in range(3)], axis=1)


def linked(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links (i, j) of a forest that connects what a chain of pairs with at least the similarity connects."""
    sizes = np.array([len(s) for s in sets], np.int64)
    _, number = np.unique(np.concatenate(sets), return_inverse=True)
    ptr = np.concatenate([[0], np.cumsum(sizes)])
    mark = np.zeros(int(number.max()) + 1 if len(number) else 0, np.int64)
    left, rest, begin = np.arange(1, len(sets)), number[ptr[1] :], ptr[1:-1] - ptr[1]
    found, queue, up = [], [0], SIMILAR
    while len(left):
        i = queue.pop()
        own = number[ptr[i] : ptr[i + 1]]
        mark[own] = 1
        both = np.add.reduceat(mark[rest], begin)
        mark[own] = 0
        near = up[1] * both >= up[0] * (sizes[i] + sizes[left] - both)
        found += [(i, j) for j in left[near].tolist()]
        queue += left[near].tolist()
        gone = near
        if not queue:
            gone = near.copy()
            gone[np.flatnonzero(~near)[:1]] = True  # none left to follow: the next one begins a new tree
            queue += left[gone & ~near].tolist()
        if gone.any():
            rest, left = rest[np.repeat(~gone, sizes[left])], left[~gone]
            begin = np.concatenate([[0], np.cumsum(sizes[left])[:-1]]).astype(np.int64)
    return found


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(group, i, j, node, row, print), sorted by cell -> the members that have another within FAR bits in their cell, without the print."""
    for table in _runs(batches):
        key = _cells(table)
        prints = np.frombuffer(b"".join(table.column(5).to_pylist()), "<u8").reshape(-1, LANES)
        cuts = np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1, [len(key)]]).tolist()
        keep = np.concatenate([have_close(prints[a:b], FAR) for a, b in zip(cuts, cuts[1:])])
        if keep.any():
            yield from table.select(range(5)).filter(pa.array(keep)).combine_chunks().to_batches()
    give_back()


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in _runs(batches):
        key, node = _cells(table), table.column(3).to_numpy()
        cuts = np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1, [len(key)]])
        links: list[tuple[int, int]] = []
        for a, n in zip(cuts[:-1].tolist(), np.diff(cuts).tolist()):
            if n > 1:
                sets = [np.frombuffer(s, np.uint64) for s in table.column(4).slice(a, n).to_pylist()]
                links += [(int(node[a + i]), int(node[a + j])) for i, j in linked(sets)]
        if links:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*links)], names=["a", "b"])
    give_back()


def _emitted(folder: str):
    """(row, text) -> (group, i, j, node, shingles) for each cell that asks for the row's text."""
    names = ["group", "i", "j", "node", "shingles"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = PartRows(folder)
        for batch in slices((b.filter(pa.array(asked.contains(b.column(0).to_numpy()))) for b in batches), 1, FILED_BYTES):
            h, ptr = shingles(as_bytes(batch.column(1)))
            sets = [np.unique(h[a:b]).tobytes() for a, b in zip(ptr[:-1].tolist(), ptr[1:].tolist())]
            for at, entries in asked.entries(batch.column(0).to_numpy()):
                for a in range(0, len(at), CELL_ROWS):
                    some = at[a : a + CELL_ROWS]
                    rows = entries.slice(a, CELL_ROWS)
                    yield pa.RecordBatch.from_arrays([*(rows.column(n).combine_chunks() for n in names[:4]), pa.array([sets[k] for k in some.tolist()], pa.binary())], names=names)
        give_back()

    return run


def candidates(classes: DataFrame) -> DataFrame:
    """(group, i, j, node, row): which text goes to which cell, if another there is close by its fingerprint; classes: (node, row, size, bands, print).

    A group is what shares a key; groups of the same members are one, told by their number and a sum of hashes. A group of
    more than CELL_SHINGLES or CELL_MEMBERS is dealt into blocks by a hash of the node, and each two blocks, equal ones too, are a cell: all pairs of
    the group meet in some cell, and no task holds more than two blocks. Sizes are partial sums, so a hot key is no one task.
    """
    filed = classes.select(F.explode("bands").alias("key"), "node", "row", "size")
    shared = filed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("members"), F.sum("size").alias("total")).filter("n > 1")
    blocks = F.greatest(F.ceil(F.col("g.total") / CELL_SHINGLES), F.ceil(F.col("n") / CELL_MEMBERS)).cast("long")
    groups = shared.groupBy("n", "members").agg(F.min(F.struct("key", "total")).alias("g")).select(F.col("g.key").alias("key"), blocks.alias("blocks"))
    members = filed.join(groups, "key").withColumn("own", F.pmod(F.xxhash64("node", F.lit("block")), "blocks"))
    # Only what shares a key takes its print along.
    cells = members.join(classes.select("node", "print"), "node").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    placed = cells.select(F.col("key").alias("group"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "row", "print")
    bounded_batches(classes.sparkSession)
    return placed.repartition("group", "i", "j").sortWithinPartitions("group", "i", "j").mapInArrow(_close, "group long, i long, j long, node long, row long")


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of near duplicates, that of the least key, with the columns of `docs`.

    Texts of equal words, empty ones too, and texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more are linked; a
    group is what links connect. A row without a key stays only where no other of its group has one. Texts are written once with a number
    for each row, and never shuffled: what later steps ask of them lies by the file of the row.
    """
    spark, verdict = docs.sparkSession, free_name(docs, "_verdict")
    fields = [T.StructField("node", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("size", T.LongType()), T.StructField("print", T.BinaryType())]
    marked = map_text(docs, key, text, fields, _filed, carry=True, verdict=verdict, limit=FILED_BYTES)
    at = len(docs.columns)
    # Numbers of the rows as written; a key may repeat or be missing.
    numbered = by_place(marked).withColumn(f"_c{at + 1}", F.monotonically_increasing_id())
    whole, _ = written(numbered, "filed")
    k, t, row = f"_c{docs.columns.index(key)}", f"_c{docs.columns.index(text)}", f"_c{at + 1}"
    first = F.struct(F.col(k).isNull().alias("n"), F.col(k).alias("k"), F.col(row).alias("row"))
    one = whole.select(F.col(f"_c{at}.node").alias("node"), first.alias("first"), F.col(f"_c{at}.bands").alias("bands"), F.col(f"_c{at}.size").alias("size"), F.col(f"_c{at}.print").alias("print"))
    # The shingles of a class are those of whichever row stands for it: all have the same words.
    classes, _ = written(one.groupBy("node").agg(F.min("first").alias("first"), F.first("bands").alias("bands"), F.first("size").alias("size"), F.first("print").alias("print")).withColumn("row", F.col("first.row")), "classes")
    asked = by_part(candidates(classes), "row", "asked")
    bounded_batches(spark)
    compared = whole.select(row, t).mapInArrow(_emitted(asked), "group long, i long, j long, node long, shingles binary")
    links, _ = written(compared.repartition("group", "i", "j").sortWithinPartitions("group", "i", "j").mapInArrow(_verified, "a long, b long"), "links")
    found = components(links).withColumnRenamed("node", "_node")
    named = classes.select("node", "first").join(found, F.col("node") == F.col("_node"), "left").select(F.coalesce("component", "node").alias("component"), "first")
    keep = by_part(named.groupBy("component").agg(F.min("first").alias("first")).select(F.col("first.row").alias("row")), "row", "kept")
    return in_part_rows(whole, row, keep).select(*[f"_c{i}" for i in range(at)]).toDF(*docs.columns)
