"""Best-fit packing of tokenized documents into sequences, with large-item matching.

The plan needs only how many pieces there are of each length, at most `capacity` counts whatever the corpus. Pieces above
a third of the capacity are large: at most two share a sequence, matched greedily from the longest down, each with the
longest that fits. Smaller pieces, from the longest down, go to the least gap that holds them. A piece finds its place by its
rank among pieces of its length: ranks are partition offsets plus a place in the partition, so no task gathers a length.
"""

from __future__ import annotations

import base64
import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.llm.common import map_text, written

CAPACITY = 2048
#: The added token of byte_bpe_50k.json, which the ranks lack; a text that holds it gets its id.
SPECIAL = {"<|endoftext|>": 50256}

PIECE = T.StructType([T.StructField(n, T.LongType()) for n in ("piece", "start", "length", "ids_crc32")])

_ENCODERS: dict[str, object] = {}


def _encoder(vocabulary: str):
    """text -> uint32 ids. A .tiktoken file holds the same vocabulary as the .json one and gives the same ids faster."""
    if vocabulary not in _ENCODERS:
        if vocabulary.endswith(".tiktoken"):
            import public_tokenizers
            import tiktoken

            with open(vocabulary, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            made = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)
            _ENCODERS[vocabulary] = lambda text: made.encode_to_numpy(text, allowed_special="all")
        else:
            from tokenizers import Tokenizer

            plain = Tokenizer.from_file(vocabulary)
            _ENCODERS[vocabulary] = lambda text: np.array(plain.encode(text, add_special_tokens=False).ids, np.uint32)
    return _ENCODERS[vocabulary]


def default_vocabulary() -> str:
    """The byte_bpe_50k vocabulary as ranks: same ids as its .json form, which tests compare."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: whole if it fits, else the first takes what full pieces leave."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first)] + [(a, capacity) for a in range(first, n, capacity)]


def _pieces(vocabulary: str, end_id: int, capacity: int, keep_ids: bool):
    kind = [("piece", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())] + ([("ids", pa.binary())] if keep_ids else [])

    def work(texts):
        encode = _encoder(vocabulary)
        out = []
        for t in texts:
            ids = np.append(encode((t or b"").decode("utf-8", "replace")), np.uint32(end_id)).astype("<u4")
            raw = memoryview(ids.tobytes())
            out.append([{"piece": k, "start": a, "length": n, "ids_crc32": zlib.crc32(p := raw[4 * a : 4 * (a + n)])} | ({"ids": bytes(p)} if keep_ids else {}) for k, (a, n) in enumerate(cuts(len(ids), capacity))])
        return [pa.array(out, pa.list_(pa.struct(kind)))]

    return work


def pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None, end_id: int = 0, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """(key, piece, start, length, ids_crc32[, ids]) for each piece of each document: its ids, then `end_id`, cut if too long.

    Null texts count as empty and give one piece of the end id. Ids are unsigned 32-bit, little-endian.
    """
    kind = T.StructType([*PIECE.fields, *([T.StructField("ids", T.BinaryType())] if keep_ids else [])])
    found = map_text(docs, key, text, [T.StructField("pieces", T.ArrayType(kind))], _pieces(vocabulary or default_vocabulary(), end_id, capacity, keep_ids))
    return found.select(key, F.explode("pieces").alias("p")).select(key, "p.*")


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, rows, first sequence, offset): rank r of a length goes to sequence first + r - first rank."""
    left = {n: c for n, c in counts.items() if c > 0}
    if any(not 0 < n <= capacity for n in left):
        raise ValueError("a piece is empty or longer than a sequence")
    if capacity >= 1 << 19:
        raise ValueError("sequences of 2^19 ids or more are not supported")
    runs: list[tuple[int, int, int, int, int]] = []
    used = dict.fromkeys(left, 0)
    sequences = 0
    gaps: dict[int, list[tuple[int, int]]] = {}  # free room -> (first sequence, how many)

    def take(length: int, n: int, first: int, offset: int) -> None:
        runs.append((length, used[length], n, first, offset))
        used[length] += n
        left[length] -= n
        if not left[length]:
            del left[length]

    def leave(room: int, first: int, n: int) -> None:
        if room not in gaps:
            insort(rooms, room)
        gaps.setdefault(room, []).append((first, n))

    rooms: list[int] = []
    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        a = large[-1]
        k = bisect_left(large, capacity - a + 1) - 1
        b = large[k] if k >= 0 else 0
        n = left[a] if not b else left[a] // 2 if a == b else min(left[a], left[b])
        if b and not n:  # the last one of its length can't pair with itself
            k -= 1
            b = large[k] if k >= 0 else 0
            n = min(left[a], left[b]) if b else left[a]
        take(a, n, sequences, 0)
        if b:
            take(b, n, sequences, a)
        leave(capacity - a - b, sequences, n)
        sequences += n
        large = [x for x in large if x in left] if a not in left or b and b not in left else large
    for length in sorted(left, reverse=True):
        while length in left:
            k = bisect_left(rooms, length)
            if k == len(rooms):
                # No gap holds it: new sequences, as many as the rest needs with each filled by this length.
                n = -(-left[length] // (capacity // length))
                leave(capacity, sequences, n)
                sequences += n
                continue
            room = rooms[k]
            first, n = gaps[room].pop()
            if not gaps[room]:
                del gaps[room]
                rooms.pop(k)
            m = min(n, left[length])
            take(length, m, first, capacity - room)
            leave(room - length, first, m)
            if n > m:
                leave(room, first + m, n - m)
    return runs


def _placed(runs: list[tuple[int, int, int, int, int]]):
    table = np.array(sorted(runs), np.int64).reshape(-1, 5)
    edges = (table[:, 0] << 44) + table[:, 1]  # lengths are under 2^19, ranks under 2^44

    def run(batches):
        for batch in batches:
            names = batch.schema.names
            length, rank = (batch.column(names.index(n)).to_numpy(zero_copy_only=False) for n in ("length", "rank"))
            row = table[np.searchsorted(edges, (length << 44) + rank, side="right") - 1]
            kept = [n for n in names if n != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(names.index(n)) for n in kept), pa.array(row[:, 3] + rank - row[:, 1], pa.int64()), pa.array(row[:, 4], pa.int64())], names=[*kept, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None, end_id: int = 0, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """(key, piece, start, length, ids_crc32, sequence_id, offset[, ids]) for each piece, in few sequences of `capacity`.

    Every piece is in one sequence; pieces of a sequence follow each other from offset 0 without gaps. Repeated rows are
    packed each. An empty table gives no rows. Sequence numbers are 0, 1, ... without gaps.
    """
    found, _ = written(pieces(docs, key, text, vocabulary, end_id, capacity, keep_ids).withColumn("_part", F.spark_partition_id()), "pieces")
    counts, _ = written(found.groupBy("_part", "length").agg(F.count(F.lit(1)).alias("n")), "lengths")
    total = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}  # at most `capacity` rows
    before = counts.select("_part", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("_part")) - F.col("n")).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_part", "length").orderBy(key, "piece", "start"))
    ranked = found.withColumn("_place", place).join(before, ["_part", "length"]).withColumn("rank", F.col("_before") + F.col("_place") - 1)
    columns = [key, "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else [])]
    schema = T.StructType([*[found.schema[c] for c in columns], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked.select(*columns, "rank").mapInArrow(_placed(plan(total, capacity)), schema)
