"""Benchmark decontamination by suffix arrays of the training texts.

Each slice of documents becomes a shard: its words as numbers of the test vocabulary (0 for all others), and the sorted
array of those suffixes that can hold a whole window, that is, whose run of test words is long enough. Every test suffix,
cut at the window length, is binary-searched in it. Windows that continue each other on one diagonal are joined into
the longest verbatim matches with their places.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.llm.common import Words, by_place, free_name, keep_rows, map_text, pick, written
from lexloom.llm.partrows import PartRows, by_part

WINDOW = 10
#: Test text that one pass holds in each worker; a larger test set takes several readings of the documents.
BLOCK_BYTES = 16_000_000

#: Text that one suffix array covers, about; its words and keys take many times its size.
SHARD_BYTES = 3_000_000

MATCH = T.StructType([T.StructField("item_id", T.StringType()), T.StructField("item_word", T.IntegerType()), T.StructField("doc_word", T.IntegerType()), T.StructField("n_words", T.IntegerType())])
FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("spans", T.ArrayType(T.IntegerType())),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("matches", T.ArrayType(MATCH)),
]


class TestBlock:
    """The windows of some items: their words as numbers, the sorted keys of distinct windows, and the items and places each comes from."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        words = Words([text for _, text in items])
        self.window = window
        self.names = [name for name, _ in items]
        self.vocabulary, at, number = np.unique(words.hash, return_index=True, return_inverse=True)
        self.spelling = [words.word(i) for i in at.tolist()]
        if any(words.word(i) != self.spelling[n] for i, n in enumerate(number.tolist())):
            raise ValueError("two test words have one hash")
        count = np.asarray(words.count, np.int64)
        n = np.where(count > 0, np.maximum(count - window + 1, 1), 0)
        item = np.repeat(np.arange(len(items)), n)
        place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        length = np.minimum(count, window)[item]
        grid = np.zeros((len(item), window), np.uint32)
        for k in range(window):
            inside = np.flatnonzero(length > k)
            grid[inside, k] = number[words.first[item[inside]] + place[inside] + k] + 1
        self.low, first, which = np.unique(_keys(grid), return_index=True, return_inverse=True)
        self.lengths = length[first].astype(np.int64)
        self.shortest = int(self.lengths.min()) if len(first) else 0
        #: Windows of fewer words, and the highest key that begins with them.
        self.short = np.flatnonzero(self.lengths < window)
        grid = grid[first[self.short]]
        grid[np.arange(window)[None] >= self.lengths[self.short][:, None]] = 0xFFFFFFFF
        self.high = _keys(grid)
        order = np.argsort(which, kind="stable")
        self._from = np.searchsorted(which[order], np.arange(len(first) + 1))
        self._item, self._place = item[order].astype(np.int32), place[order].astype(np.int32)

    def places(self, q: int) -> list[tuple[int, int]]:
        """(item, word) of each occurrence of a window in the test set."""
        a, b = self._from[q], self._from[q + 1]
        return list(zip(self._item[a:b].tolist(), self._place[a:b].tolist()))

    def words_of(self, q: int) -> list[bytes]:
        raw = bytes(self.low[q]).ljust(4 * self.window, b"\0")
        return [self.spelling[w - 1] for w in np.frombuffer(raw, ">u4")[: self.lengths[q]].tolist()]

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.vocabulary, hashes)
        at[at == len(self.vocabulary)] = 0
        return np.where(self.vocabulary[at] == hashes, at + 1, 0) if len(self.vocabulary) else np.zeros(len(hashes), np.int64)


def _keys(grid: np.ndarray) -> np.ndarray:
    """Rows of big-endian numbers as byte strings, which sort like the rows."""
    grid = np.array(grid, ">u4", order="C")  # a copy: callers go on with theirs
    return grid.view(f"S{4 * grid.shape[1]}").ravel() if len(grid) else np.zeros(0, f"S{4 * grid.shape[1]}")


class Shard:
    """The suffix array of a slice of documents, as far as its suffixes can match a test window."""

    def __init__(self, texts: list[bytes | None], block: TestBlock):
        self.words = words = Words(texts)
        number = block.numbers(words.hash)
        # How far the run of test words goes from each place, within its document.
        n, ends = len(number), words.first + words.count
        stop = np.flatnonzero(number == 0)
        stops = np.union1d(stop, ends[words.count > 0]) if n else stop
        run = stops[np.searchsorted(stops, np.arange(n), side="left")] - np.arange(n) if n else np.zeros(0, np.int64)
        last = ends[words.owner] - np.arange(n) if n else run
        # A place that starts a document is an end of the one before: its own run goes to the next stop.
        at_end = (run == 0) & (number != 0)
        if at_end.any():
            places = np.flatnonzero(at_end)
            following = stops[np.minimum(np.searchsorted(stops, places, side="right"), len(stops) - 1)]
            run[places] = following - places
        run = np.minimum(run, last)
        able = np.flatnonzero(run >= block.shortest) if block.shortest else np.zeros(0, np.int64)
        grid = np.zeros((len(able), block.window), ">u4")
        for k in range(block.window):
            inside = run[able] > k
            grid[inside, k] = number[able[inside] + k]
        keys = _keys(grid) if len(able) else np.zeros(0, f"S{4 * block.window}")
        order = np.argsort(keys, kind="stable")
        self.suffixes, self.keys = able[order], keys[order]

    def hits(self, block: TestBlock) -> tuple[np.ndarray, np.ndarray]:
        """(word, window) for each occurrence of a window, verified on the words themselves."""
        if not len(self.suffixes) or not len(block.low):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        low, high = np.searchsorted(self.keys, block.low, side="left"), np.searchsorted(self.keys, block.low, side="right")
        high[block.short] = np.searchsorted(self.keys, block.high, side="right")
        counts = np.maximum(high - low, 0)
        window = np.repeat(np.arange(len(counts)), counts)
        at = self.suffixes[np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(low, counts)]
        words = self.words
        true = [all(words.word(p + k) == w for k, w in enumerate(block.words_of(q))) for p, q in zip(at.tolist(), window.tolist())]
        true = np.array(true, bool)
        return at[true], window[true]


def _longest(found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Windows (item, item word, document word, words) that go on where another ends, joined along their diagonal."""
    out: list[list[int]] = []
    for item, _, p, q, n in sorted((item, p - q, p, q, n) for item, q, p, n in found):
        if out and out[-1][0] == item and out[-1][2] - out[-1][1] == p - q and p <= out[-1][2] + out[-1][3]:
            out[-1][3] = max(out[-1][3], p + n - out[-1][2])
        else:
            out.append([item, q, p, n])
    return [tuple(x) for x in out]


def _scan(block: TestBlock, with_matches: bool):
    def work(texts):
        shard = Shard(texts, block)
        words = shard.words
        at, window = shard.hits(block)
        owner = words.owner[at] if len(at) else at
        spans: list[list[int]] = [[] for _ in texts]
        items: list[list[str]] = [[] for _ in texts]
        matches: list[list[dict]] = [[] for _ in texts]
        order = np.lexsort((at, owner))
        at, window, owner = at[order], window[order], owner[order]
        cuts = np.flatnonzero(np.diff(owner)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(at)]) if len(at) else []:
            k = int(owner[a])
            first = int(words.first[k])
            places, which = (at[a:b] - first).tolist(), window[a:b].tolist()
            merged: list[int] = []
            for p, q in zip(places, which):
                end = p + int(block.lengths[q])
                if merged and p <= merged[-1]:
                    merged[-1] = max(merged[-1], end)
                else:
                    merged += [p, end]
            spans[k] = merged
            own = sorted({i for q in set(which) for i, _ in block.places(q)})
            items[k] = [block.names[i] for i in own]
            if with_matches:
                found = [(i, q0, p, int(block.lengths[q])) for p, q in zip(places, which) for i, q0 in block.places(q)]
                matches[k] = [dict(item_id=block.names[i], item_word=q, doc_word=p, n_words=n) for i, q, p, n in _longest(found)]
        return [pa.array(words.count, pa.int64()), pa.array(spans, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string())), pa.array(matches, pa.list_(pa.struct([("item_id", pa.string()), ("item_word", pa.int32()), ("doc_word", pa.int32()), ("n_words", pa.int32())])))]

    return work


def test_blocks(benchmark: DataFrame, item: str, text: str, block_bytes: int, window: int) -> Iterator[TestBlock]:
    """The test set in blocks of about `block_bytes` of text, one at a time and at least one. An item with a null id is ''."""
    held: list[tuple[str, bytes]] = []
    size = made = 0
    for name, t in pick(benchmark, item=item, text=text).select(F.col("item").cast("string"), "text").toLocalIterator():
        raw = (t or "").encode()
        if size and size + len(raw) > block_bytes:
            yield TestBlock(held, window)
            held, size, made = [], 0, made + 1
        held.append((name or "", raw))
        size += len(raw)
    if held or not made:
        yield TestBlock(held, window)


def scan(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, carry: bool = False, with_matches: bool = False, block_bytes: int = BLOCK_BYTES, verdict: str = "_verdict") -> DataFrame:
    """What of each document occurs in the test set: n_words, spans, items, matches (with `carry`: in `verdict`).

    A window is `window` consecutive words of an item, or the whole of an item with fewer (but some). spans: start and end
    words of the merged stretches that any occurrence covers. items: ids of items with an occurring window. matches:
    the longest verbatim matches. Null or empty texts have no words; an empty test set matches nothing; items that repeat
    under one id count once. With more test text than a block the documents are written once, with numbers for rows; each further block reads
    them again and gives rows for documents that it hits alone, which are laid by file and not shuffled to the texts.
    """
    blocks = test_blocks(benchmark, item, item_text, block_bytes, window)
    first, second = next(blocks), next(blocks, None)
    out = map_text(docs, key, text, FIELDS, _scan(first, with_matches), carry or second is not None, verdict, SHARD_BYTES)
    if second is None:
        return out
    number, step = free_name(out, "_row"), free_name(out, "_step")
    whole, _ = written(out.withColumn(number, F.monotonically_increasing_id()), "scanned")
    hits = None
    for block in chain([second], blocks):
        found = map_text(pick(whole, number, _text=text), number, "_text", FIELDS, _scan(block, with_matches), limit=SHARD_BYTES).filter(F.size("spans") > 0)
        hits = found if hits is None else hits.unionByName(found)
    flat = lambda name: F.flatten(F.collect_list(name)).alias(name)
    folder = by_part(hits.groupBy(F.col(number).alias("row")).agg(flat("spans"), flat("items"), flat("matches")), "row", "hits")
    rest = [c for c in whole.columns if c not in (verdict, number)]
    plain = by_place(whole)
    at = {c: f"_c{i}" for i, c in enumerate(whole.columns)}
    known, more = at[verdict], step
    joined = plain.withColumn(more, _hits_of(folder)(F.col(at[number])))
    cat = lambda f: F.concat(F.col(f"{known}.{f}"), F.coalesce(F.col(f"{more}.{f}"), F.array().cast(next(x.dataType for x in FIELDS if x.name == f)))).alias(f)
    merged = F.struct(F.col(f"{known}.n_words").alias("n_words"), cat("spans"), F.array_distinct(cat("items")).alias("items"), cat("matches"))
    if carry:
        kept = [f"_c{i}" for i, c in enumerate(whole.columns) if c not in (verdict, number)]
        return joined.select(*kept, merged.alias(known)).toDF(*rest, verdict)
    return joined.select(F.col(at[key]).alias(key), merged.alias(known)).select(key, f"{known}.*")


def _hits_of(folder: str):
    """Row number -> what further blocks found in its text, null for nothing."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = T.StructType(FIELDS[1:])
    made = to_arrow_type(kind)

    @F.arrow_udf(kind)
    def of(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = PartRows(folder)
        for numbers in parts:
            rows: list[dict | None] = [None] * len(numbers)
            for at, entries in known.entries(numbers.to_numpy()):
                for k, entry in zip(at.tolist(), entries.select(made.names).to_pylist()):
                    rows[k] = entry
            yield pa.array(rows, made)

    return of


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Per document: key, n_words, n_hit (words in any occurrence), n_items, items_sha256, contaminated, longest_match.

    items_sha256: of the ids of items with occurring windows, sorted as strings, joined by commas; of the empty text if none. longest_match:
    the words of the longest verbatim match with one item, 0 if none.
    """
    pairs = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), (F.size("spans") / 2).cast("int") - 1)), lambda i: F.get("spans", i * 2 + 1) - F.get("spans", i * 2))
    found = scan(docs, benchmark, key, text, with_matches=True, **options)
    one_block = F.when(F.size("spans") == 0, 0).otherwise(F.aggregate(pairs, F.lit(0), lambda a, x: a + x)).cast("long")
    disjoint = found.withColumn("spans", _merged("spans"))
    return disjoint.select(key, "n_words", one_block.alias("n_hit"), F.size(F.array_distinct("items")).cast("long").alias("n_items"), F.sha2(F.concat_ws(",", F.array_sort(F.array_distinct("items"))), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"), F.coalesce(F.array_max(F.transform("matches", lambda m: m["n_words"])), F.lit(0)).cast("long").alias("longest_match"))


def _merged(spans: str):
    """Starts and ends of stretches, in any order and overlapping, as disjoint ones in order."""
    n = F.greatest(F.lit(0), (F.size(spans) / 2).cast("int") - 1)
    parts = F.array_sort(F.transform(F.sequence(F.lit(0), n), lambda i: F.struct(F.get(spans, i * 2).alias("a"), F.get(spans, i * 2 + 1).alias("b"))))
    step = lambda s, x: F.when((F.size(s) > 0) & (x["a"] <= F.element_at(s, -1)), F.concat(F.slice(s, 1, F.size(s) - 1), F.array(F.greatest(F.element_at(s, -1), x["b"])))).otherwise(F.concat(s, F.array(x["a"], x["b"])))
    return F.when(F.size(spans) == 0, F.array().cast("array<int>")).otherwise(F.aggregate(parts, F.array().cast("array<int>"), step))


def decontaminate(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents, with their columns, in which no window of the test set occurs."""
    verdict = free_name(docs, "_verdict")
    return keep_rows(scan(docs, benchmark, key, text, carry=True, verdict=verdict, **options), verdict, lambda v: F.size(v["spans"]) == 0)
