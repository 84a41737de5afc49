"""Passages that repeat, over all documents, by suffix arrays of shards.

Every window of 100 bytes has an anchor, the 32-byte string in it of the least hash, which its own bytes decide alone: equal windows have
equal anchors at equal places. The windows of one anchor form a context, of 134 bytes on average. Contexts whose anchors occur nowhere else hold
no repeated window. Contexts that are equal to the last byte are folded: the earliest stands for them. All other contexts of an anchor go to one shard, whose
suffix array (`suffixes`) brings equal windows together; common prefixes tell how far they agree, and all but the earliest are repeats.
Contexts of an anchor that occurs too often for one shard are dealt over many; windows that are left over there meet by their digests.

Texts are written once, with a number for each row, and never shuffled: anchors and contexts are, and what is found lies by the file of the row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.llm.common import as_bytes, bounded_batches, give_back, pick, slices, written
from lexloom.llm.partrows import PartRows, by_part, in_part_rows
from lexloom.llm.suffixes import common_prefixes, suffix_array

WINDOW, ANCHOR = 100, 32
#: Bytes that are searched for anchors at once; longer texts in pieces.
PIECE = 1 << 18
#: Text that a worker looks at at once, and bytes of one suffix array, about.
SLICE, SHARD = 4_000_000, 2_000_000
#: Contexts of one anchor that may share a shard.
SHARED = 8192
#: An anchor with so many contexts is dealt out by them beforehand. Texts are sampled to find such anchors, at one in SAMPLE; it only balances tasks.
FREQUENT, SAMPLE, MOST_FREQUENT = 16_384, 64, 50_000
#: Bits of a place: the order of texts with equal keys, the start of the first window, the number of windows.
_DIGEST_BITS, _START_BITS, _N_BITS = 24, 32, 7

_RANDOM = np.random.default_rng(42)
_BYTES = _RANDOM.integers(0, 1 << 63, 256, dtype=np.uint64)
_P = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_LENGTH = PIECE + 2 * WINDOW
with np.errstate(over="ignore"):
    _UP, _DOWN = (np.concatenate([np.ones(1, np.uint64), np.full(_LENGTH, x, np.uint64)]).cumprod(dtype=np.uint64) for x in (_P, _INVERSE))


def _mixed(h: np.ndarray, salt: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93 + 2 * salt)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def anchors(t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, context, start, n) of each run of windows that share an anchor, by start: hashes of the anchor and of the context, the first window and their number.

    Windows are those of one text. Of equal least hashes (to 40 bits) in a window the leftmost counts.
    """
    parts: list[tuple[np.ndarray, ...]] = []
    for a in range(0, len(t) - WINDOW + 1, PIECE):
        piece = t[a : a + PIECE + WINDOW - 1]
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(_BYTES[piece] * _UP[: len(piece)], dtype=np.uint64, out=sums[1:])
        h = _mixed((sums[ANCHOR:] - sums[:-ANCHOR]) * _DOWN[: len(piece) - ANCHOR + 1], 0)
        # The upper bits of the hash and the place below them; a window holds the least of `span` neighbours.
        span, have = WINDOW - ANCHOR + 1, 1
        least = (h & ~np.uint64((1 << 24) - 1)) | np.arange(len(h), dtype=np.uint64)
        while have < span:
            step = min(have, span - have)
            least = np.minimum(least[:-step], least[step:])
            have += step
        at = (least & np.uint64((1 << 24) - 1)).astype(np.int64)
        first = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1])
        n = np.diff(np.concatenate([first, [len(at)]]))
        whole = (sums[first + n - 1 + WINDOW] - sums[first]) * _DOWN[first]
        parts.append((h[at[first]], _mixed(whole ^ (n.astype(np.uint64) << np.uint64(57)), 1), first + a, n))
    if not parts:
        return tuple(np.zeros(0, k) for k in (np.uint64, np.uint64, np.int64, np.int64))
    return tuple(np.concatenate(c) for c in zip(*parts))


def _place(digest: int, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    return (np.int64(digest) << np.int64(_START_BITS + _N_BITS)) | (start.astype(np.int64) << np.int64(_N_BITS)) | n.astype(np.int64)


def start_of(place: np.ndarray) -> np.ndarray:
    return (place >> _N_BITS) & ((1 << _START_BITS) - 1)


def n_of(place: np.ndarray) -> np.ndarray:
    return place & ((1 << _N_BITS) - 1)


_ANCHORS = "anchor long, context long, repeat boolean, key long, row long, place long"


def _anchored(folder: str):
    """(row, key, digest, text) -> the contexts of the rows in the folder. `repeat`: equal to an earlier one in the same slice of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        standing = PartRows(folder)
        chosen = (b.filter(pa.array(standing.contains(b.column(0).to_numpy()))) for b in batches if b.num_rows)
        for batch in slices(chosen, 3, SLICE):
            rows, keys, digests = (batch.column(i).to_numpy() for i in range(3))
            made: list[list[np.ndarray]] = [[] for _ in range(5)]
            for i, text in enumerate(as_bytes(batch.column(3))):
                if text is None or len(text) < WINDOW:
                    continue
                anchor, context, start, n = anchors(np.frombuffer(text, np.uint8))
                for column, values in zip(made, (anchor.view(np.int64), context.view(np.int64), np.full(len(n), keys[i]), np.full(len(n), rows[i]), _place(int(digests[i]), start, n))):
                    column.append(values)
            if not made[0]:
                continue
            anchor, context, key, row, place = (np.concatenate(c) for c in made)
            order = np.lexsort((row, place, key, context, anchor))
            same = np.concatenate([[False], (anchor[order[1:]] == anchor[order[:-1]]) & (context[order[1:]] == context[order[:-1]])])
            repeat = np.zeros(len(order), bool)
            repeat[order] = same
            for a in range(0, len(order), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[a : a + 50_000]) for x in (anchor, context, repeat, key, row, place)], names=["anchor", "context", "repeat", "key", "row", "place"])
        give_back()

    return run


def _contexts(folder: str):
    """(row, text) -> (cell, dealt, key, row, place, bytes) of the contexts that the folder asks for."""
    names = ["cell", "dealt", "key", "row", "place"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = PartRows(folder)
        chosen = (b.filter(pa.array(asked.contains(b.column(0).to_numpy()))) for b in batches if b.num_rows)
        for batch in slices(chosen, 1, SLICE):
            texts = as_bytes(batch.column(1))
            for at, entries in asked.entries(batch.column(0).to_numpy()):
                place = entries.column("place").to_numpy()
                start, n = start_of(place), n_of(place)
                for a in range(0, len(at), 20_000):
                    z = slice(a, a + 20_000)
                    cut = [texts[k][s : s + m + WINDOW - 1] for k, s, m in zip(at[z].tolist(), start[z].tolist(), n[z].tolist())]
                    yield pa.RecordBatch.from_arrays([*(entries.column(c).slice(a, 20_000).combine_chunks() for c in names), pa.array(cut, pa.binary())], names=[*names, "bytes"])
        give_back()

    return run


_FOUND = "row long, place long, key long, digest binary"


def repeated_windows(contexts: list[bytes], rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By place in the joined contexts: which windows repeat one of a lower rank, and which are whole windows of a context.

    `rank` orders all places. A class of equal windows is a run of the suffix array whose neighbours have WINDOW bytes in common.
    """
    t = np.frombuffer(b"".join(contexts), np.uint8)
    size = np.fromiter(map(len, contexts), np.int64, len(contexts))
    rest = np.repeat(np.cumsum(size), size) - np.arange(len(t))
    whole = rest >= WINDOW
    sa = suffix_array(t)
    _, common = common_prefixes(t, sa)
    run = np.cumsum(common[sa] < WINDOW)
    ours = whole[sa]
    at, run = sa[ours], run[ours]
    repeated = np.zeros(len(t), bool)
    if len(at):
        order = np.lexsort((rank[at], run))
        later = np.concatenate([[False], run[order[1:]] == run[order[:-1]]])
        repeated[at[order[later]]] = True
    return repeated, whole


def _sharded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts sorted by cell -> the repeated windows of each, as places of runs; the first windows of dealt cells with their digests."""
    held: list[pa.RecordBatch] = []
    size = 0

    def judged(table: pa.Table) -> Iterator[pa.RecordBatch]:
        key, row, place = (table.column(c).to_numpy() for c in ("key", "row", "place"))
        texts = table.column("bytes").to_pylist()
        # Places of all windows by (key, order of the text, start, row), as the earliest counts.
        length = np.fromiter(map(len, texts), np.int64, len(texts))
        begin = np.cumsum(length) - length
        offset = np.arange(int(length.sum())) - np.repeat(begin, length)
        window = (np.repeat(place, length) >> _N_BITS) + offset
        owner = np.repeat(np.arange(len(texts)), length)
        rank = np.empty(len(window), np.int64)
        rank[np.lexsort((row[owner], window, key[owner]))] = np.arange(len(window))
        repeated, whole = repeated_windows(texts, rank)
        dealt = table.column("dealt").to_numpy()[owner]
        edge = np.flatnonzero(np.diff(np.concatenate([[False], repeated, [False]]).astype(np.int8)))
        first, last = edge[0::2], edge[1::2]
        # A run never goes from one context into the next: the last bytes of each begin no window.
        who = owner[first]
        digest, start = place[who] >> (_START_BITS + _N_BITS), start_of(place[who]) + offset[first]
        out = [row[who], (digest << (_START_BITS + _N_BITS)) | (start << _N_BITS) | (last - first), key[who], [None] * len(who)]
        alone = np.flatnonzero(whole & ~repeated & dealt)
        prints = [xxhash.xxh3_128_digest(texts[o][k : k + WINDOW]) for o, k in zip(owner[alone].tolist(), offset[alone].tolist())]
        for cols in (out, [row[owner[alone]], (window[alone] << _N_BITS) | 1, key[owner[alone]], prints]):
            if len(cols[0]):
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.binary())], names=["row", "place", "key", "digest"])

    for batch in batches:
        if not batch.num_rows:
            continue
        cell = batch.column("cell").to_numpy()
        cuts = (np.flatnonzero(cell[1:] != cell[:-1]) + 1).tolist()
        if held and held[-1].column("cell")[-1].as_py() != cell[0]:
            cuts = [0, *cuts]
        done = 0
        bytes_to = np.cumsum(np.asarray(pa.compute.binary_length(batch.column("bytes"))))
        for cut in cuts:
            so_far = size + (int(bytes_to[cut - 1]) if cut else 0) - (int(bytes_to[done - 1]) if done else 0)
            if so_far >= SHARD:
                yield from judged(pa.Table.from_batches([*held, batch.slice(done, cut - done)]))
                held, size, done = [], 0, cut
        if done < batch.num_rows:
            held.append(batch.slice(done))
            size += int(bytes_to[-1]) - (int(bytes_to[done - 1]) if done else 0)
    if held:
        yield from judged(pa.Table.from_batches(held))
    give_back()


def _removed(standing: str, found: str):
    """(row, key, text) -> the counts and the digest of what is kept. Rows that are not standing are copies of one that is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, marks = PartRows(standing), PartRows(found)
        for batch in slices((b for b in batches if b.num_rows), 2, SLICE):
            texts = [x or b"" for x in as_bytes(batch.column(2))]
            rows = batch.column(0).to_numpy()
            stands = own.contains(rows)
            places: dict[int, np.ndarray] = {}
            for at, entries in marks.entries(rows):
                place = entries.column("place").to_numpy()
                order = np.argsort(at, kind="stable")
                who, first = np.unique(at[order], return_index=True)
                places.update(zip(who.tolist(), np.split(place[order], first[1:])))
            out = []
            for i, text in enumerate(texts):
                if not stands[i] and len(text) >= WINDOW:
                    out.append((len(text), len(text), 1, hashlib.sha256(b"").hexdigest()))
                elif i not in places:
                    out.append((len(text), 0, 0, hashlib.sha256(text).hexdigest()))
                else:
                    start = start_of(places[i])
                    turn = np.zeros(len(text) + 1, np.int64)
                    np.add.at(turn, start, 1)
                    np.add.at(turn, start + n_of(places[i]) + WINDOW - 1, -1)
                    gone = np.cumsum(turn[:-1]) > 0
                    spans = int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(gone[0])
                    kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
                    out.append((len(text), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
            columns = [pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(1), *columns], names=["key", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
        give_back()

    return run


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256) for each row: what is left without bytes that a window covers which also starts earlier.

    Keys are whole numbers; windows of a lower key are earlier, then those with a lower start in the same text. Null keys come after all others.
    Rows that repeat a key are texts of one document: they follow each other by the first bits of their SHA-256; of rows with equal texts all but
    one are copies, removed if they have WINDOW bytes. Null texts count as empty. An empty table gives no rows.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    plain = pick(docs, key=key, text=text)
    digest = F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    whole, _ = written(plain.select("key", "text", digest.alias("sha"), F.monotonically_increasing_id().alias("row")), "numbered")
    order = F.coalesce(F.col("key").cast("long"), F.lit((1 << 63) - 1))
    stands = by_part(whole.groupBy("sha").agg(F.min(F.struct(F.col("key").isNull().alias("n"), "key", "row")).alias("first")).select(F.col("first.row").alias("row")), "row", "standing")
    bits = F.conv(F.hex(F.substring("sha", 1, _DIGEST_BITS // 8)), 16, 10).cast("long")
    numbered = whole.select("row", order.alias("key"), bits.alias("digest"), "text")

    sample = numbered.filter(F.col("digest") % SAMPLE == 0).mapInArrow(_anchored(stands), _ANCHORS).groupBy("anchor").agg((F.count(F.lit(1)) * SAMPLE).alias("about")).filter(F.col("about") >= FREQUENT)
    frequent, _ = written(sample.orderBy(F.desc("about"), "anchor").limit(MOST_FREQUENT), "frequent-anchors")
    # At most MOST_FREQUENT rows of two numbers, whatever the input.
    made = numbered.mapInArrow(_anchored(stands), _ANCHORS).join(F.broadcast(frequent), "anchor", "left")
    salt = F.when(F.col("repeat"), -1 - F.pmod("row", F.lit(61))).when(F.col("about").isNotNull(), F.pmod("context", F.ceil(F.col("about") / FREQUENT)))
    dealt = made.withColumn("salt", F.coalesce(salt, F.lit(0)).cast("int")).withColumn("often", F.col("about").isNotNull()).drop("about")
    by = Window.partitionBy("anchor", "salt").orderBy("context", "key", "place", "row")
    new = ~F.col("repeat") & (F.lag("context").over(by).isNull() | (F.lag("context").over(by) != F.col("context")))
    folded = dealt.withColumn("new", new).withColumn("nth", F.sum(F.col("new").cast("long")).over(by)).withColumn("of", F.max("nth").over(Window.partitionBy("anchor", "salt")))
    cell = F.xxhash64("anchor", "salt", F.floor((F.col("nth") - 1) / SHARED))
    judged = folded.filter(~F.col("new") | (F.col("of") > 1) | F.col("often")).select("row", "key", "place", "new", cell.alias("cell"), (F.col("often") | (F.col("of") > SHARED)).alias("dealt"))
    first, _ = written(judged, "folded-contexts")

    asked = by_part(first.filter("new").select("row", "cell", "dealt", "key", "place"), "row", "asked-contexts")
    contexts = whole.select("row", "text").mapInArrow(_contexts(asked), "cell long, dealt boolean, key long, row long, place long, bytes binary")
    found, _ = written(contexts.repartition("cell").sortWithinPartitions("cell").mapInArrow(_sharded, _FOUND), "repeated-windows")
    left = found.filter("digest is not null")
    earliest = Window.partitionBy("digest").orderBy("key", "place", "row")
    later = left.withColumn("_k", F.row_number().over(earliest)).filter("_k > 1").select("row", "place")
    marks = by_part(first.filter("not new").select("row", "place").unionByName(found.filter("digest is null").select("row", "place")).unionByName(later), "row", "removed")
    kind = docs.schema[docs.columns.index(key)].dataType
    out = whole.select("row", "key", "text").mapInArrow(_removed(stands, marks), f"key {kind.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return out.withColumnRenamed("key", key)
