from __future__ import annotations

import base64
import hashlib
import io
import struct
import zlib
from collections import Counter

import pytest

from lexloom.llm import media, storage, warc
from lexloom.llm.common import new_folder


def payload(text):
    raw = (text or "").encode()
    return raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))


@pytest.mark.parametrize("n", [0, 1, 575, 576, 577, 5000])
def test_png_round_trip(n):
    data = media.padded(bytes(i * 7 % 256 for i in range(n)))
    assert len(data) % 576 == 0 and media.from_png(media.to_png(data)) == data
    broken = bytearray(media.to_png(data))
    broken[len(broken) // 2] ^= 1
    with pytest.raises((ValueError, zlib.error)):
        media.from_png(bytes(broken))


def test_media_like_brute_force(spark, clashing, odd_rows, none):
    got = Counter(tuple(r)[:5] for r in media.media_table(clashing).collect())
    want = Counter()
    for k, t, *_ in odd_rows:
        p = payload(t)
        want[(k, len((t or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))] += 1
    assert got == want
    assert media.media_table(none).count() == 0


def test_equal_texts_equal_values(spark):
    docs = spark.createDataFrame([(1, "same text"), (2, "same text"), (3, "other")], "doc_id long, text string").repartition(3)
    rows = {r["doc_id"]: tuple(r)[1:] for r in media.media_table(docs).collect()}
    assert rows[1] == rows[2] != rows[3] and len(rows[1][-1].split()) == 18


def test_ranges_and_archives_split_without_loss(spark):
    docs = spark.range(300).selectExpr("id doc_id", "repeat(concat(id, ' text '), 50) text").repartition(3)
    folder = new_folder(spark, "ranges")
    assert media.write_archives(docs, folder, archive_bytes=5000)[1] == 300
    assert len(storage.files(folder, media.SUFFIX)) > 5
    read = media.read_archives(spark, folder, range_bytes=700)
    assert read.rdd.getNumPartitions() > 30
    assert Counter(r["key"] for r in read.collect()) == Counter(range(300))


def test_missing_archives_are_an_error(spark, tmp_path):
    from lexloom.llm.common import new_folder

    docs = spark.range(40).selectExpr("id doc_id", "repeat(concat(id, ' text '), 50) text").repartition(2)
    folder = new_folder(spark, "short")
    archives, members, size = media.write_archives(docs, folder, archive_bytes=3000)
    assert members == 40 and media.read_archives(spark, folder, archives=archives, bytes=size).count() == 40
    for wrong in ({"archives": archives + 1, "bytes": size}, {"archives": archives, "bytes": size - 1}):
        with pytest.raises(Exception, match="were written"):
            media.read_archives(spark, folder, **wrong).count()


def test_file_systems_go_by_scheme(tmp_path):
    assert storage.opened(f"file://{tmp_path}/x")[1] == f"{tmp_path}/x"
    with pytest.raises(ValueError, match="nowhere"):
        storage.opened("nowhere://cluster/x")


def test_many_ranges_become_larger(spark, monkeypatch):
    docs = spark.range(60).selectExpr("id doc_id", "repeat(concat(id, ' text '), 90) text").repartition(3)
    folder = new_folder(spark, "steps")
    media.write_archives(docs, folder, archive_bytes=2000)
    monkeypatch.setattr(media, "RANGE_BYTES", 100)
    monkeypatch.setattr(media, "MOST_RANGES", 10)
    n = len(storage.files(folder, media.SUFFIX))
    assert n <= len(media.ArchiveReader({"folder": folder}).partitions()) <= n + 10


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from lexloom.llm import common

    session = lambda master: SimpleNamespace(conf=SimpleNamespace(get=lambda name, default: default), sparkContext=SimpleNamespace(master=master))
    for master in ("spark://host:7077", "yarn", "k8s://x", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            common.shared_root(session(master))


def test_a_damaged_read_is_repeated_for_its_member_alone(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(5)], "doc_id long, text string").coalesce(1)
    folder = new_folder(spark, "retry")
    media.write_archives(docs, folder)
    reader = media.ArchiveReader({"folder": folder, "retries": "2"})
    part = reader.partitions()[0]
    asked = []
    plain = media.ArchiveReader.member

    def flaky(self, path, offset, end, raw=None):
        asked.append((offset, raw is None))
        if len(asked) == 3 or len(asked) == 4:
            raise ValueError("damaged on the way")
        return plain(self, path, offset, end, raw)

    monkeypatch.setattr(media.ArchiveReader, "member", flaky)
    keys = [k for batch in reader.read(part) for k in batch.column(0).to_pylist()]
    assert sorted(keys) == list(range(5))
    again = [o for o, alone in asked if alone]
    assert len(again) == 2 and len(set(again)) == 1 and len(asked) == 7


def test_a_member_that_stays_damaged_fails(spark, tmp_path):
    docs = spark.createDataFrame([(1, "text")], "doc_id long, text string").coalesce(1)
    folder = new_folder(spark, "damaged")
    media.write_archives(docs, folder)
    path, _ = storage.files(folder, media.SUFFIX)[0]
    raw = bytearray(open(path, "rb").read())
    raw[60] ^= 255
    open(path, "wb").write(raw)
    reader = media.ArchiveReader({"folder": folder, "retries": "1"})
    with pytest.raises(ValueError):
        list(reader.read(reader.partitions()[0]))


PAGES = "page_id long, url string, html string"


def sha(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def test_warc_like_brute_force(spark):
    from pyspark.sql import functions as F

    big = "é<p>" * 200_000
    rows = [(1, "http://a/x y", "same"), (2, "http://é/\r\nX: y", "same"), (9, None, "same"), (3, "u", None), (4, "u", ""), (5, "u", "one"), (6, "u", big), (7, "u", big), (8, "u", "WARC/1.1\r\n\r\nWARC-Type: x\r\n\r\n"), (8, "u", "WARC/1.1\r\n\r\nWARC-Type: x\r\n\r\n"), (None, "u", "same"), (None, "u", "lone")]
    pages = spark.createDataFrame(rows, PAGES).select("*", F.lit(1).alias("HTML"), F.lit(2).alias("payload"), F.lit(3).alias("key")).repartition(3)
    largest = {}
    for k, _, t in rows:
        if k is not None:
            largest[t or ""] = max(largest.get(t or "", k), k)
    want = Counter()
    for k, _, t in rows:
        target = largest.get(t or "")
        own = target is None or target == k
        want[(k, len((t or "").encode()), sha(t), "response" if own else "revisit", None if own else target)] += 1
    assert Counter(tuple(r) for r in warc.archived(pages).collect()) == want
    assert Counter(tuple(r) for r in warc.archived(pages, broadcast_rows=0).collect()) == want
    assert warc.archived(pages.filter("false")).count() == 0


def test_a_page_with_a_huge_address_is_read_back(spark):
    pages = spark.createDataFrame([(1, "http://a.example/" + "x" * 3_000_000, "body"), (2, "u", "body")], PAGES)
    got = {r["page_id"]: (r["payload_bytes"], r["refers_to"]) for r in warc.archived(pages).collect()}
    assert got == {1: (4, 2), 2: (4, None)}


def test_smaller_payloads_do_not_revisit(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")], PAGES)
    got = {r["page_id"]: r["record_type"] for r in warc.archived(pages, least_bytes=3).collect()}
    assert got == {1: "response", 2: "response", 3: "revisit", 4: "response"}


def test_chunks_put_together_are_the_payload(spark):
    text = "".join(chr(65 + i % 50) for i in range(100_000))
    pages = spark.createDataFrame([(1, "u", text), (2, "u", "")], PAGES)
    folder = new_folder(spark, "chunks")
    index = warc.write_warcs(warc.revisits(pages, "page_id", "html"), folder)
    rows = sorted(warc.read_chunks(index, folder, chunk_bytes=1000).collect(), key=lambda r: (r["page_id"], r["chunk_no"]))
    mine = [r for r in rows if r["page_id"] == 1]
    assert [r["chunk_no"] for r in mine] == list(range(100)) and [r["last"] for r in mine] == [False] * 99 + [True]
    body = b"".join(r["data"] for r in mine)
    assert body == text.encode() and all(len(r["data"]) <= 1000 for r in mine)
    assert mine[3]["sha1_so_far"] == sha(text[:4000]) and mine[3]["bytes_so_far"] == 4000
    assert len(rows) == 101 and rows[-1]["data"] == b""


def test_cut_archive_is_an_error():
    head = warc.record_head(1, "u", "X", 10, None, b"HTTP/1.1 200 OK\r\n\r\n")
    source = warc._Inflated(io.BytesIO(zlib.compress(head + b"12345", wbits=31)))
    source.head(b"\r\n\r\n")
    source.head(b"\r\n\r\n")
    with pytest.raises(ValueError):
        list(source.body(10, 4))
    assert struct.calcsize("<Q") == 8
