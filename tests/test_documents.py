"""The document pipeline against small hand-made cases and a line-by-line reader written for the test."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest

from lexloom.operators import chunk, normalize, structure

LINE = "document_id long, page_num long, block_num long, pos long, text string, y0 int, y1 int"
NORMAL = "document_id long, line_num int, page_num int, text string"


def read_in_order(lines):
    """Nodes of one document, one line after the other; each is [type, number, title, text, first page, last page, path, parent]."""
    find = {n: re.compile(p, re.I) for n, p, _ in structure.MARKERS}
    nodes, roots, i = [], [], 0
    open_at = dict.fromkeys(("chapter", "part", "section", "article", "paragraph", "letter"))
    order = list(open_at)

    def close_below(name):
        for n in order[order.index(name) + 1 :]:
            open_at[n] = None

    def add(kind, number, title, text, page, piece, *parents):
        parent = next((open_at[p] for p in parents if open_at[p] is not None), None)
        nodes.append([kind, number, title, text, page, page, piece if parent is None else f"{nodes[parent][6]}/{piece}", parent])
        if parent is None:
            roots.append(len(nodes) - 1)
        return len(nodes) - 1

    ends = [find[n] for n in structure.ENDS_TITLE]
    while i < len(lines):
        text, page = lines[i]
        hit = {n: p.match(text) for n, p in find.items()}
        named = {"chapter": ("BAB", ()), "part": ("Bagian", ("chapter",)), "section": ("Paragraf", ("part", "chapter"))}
        kind = next((n for n in named if hit[n]), None)
        if kind:
            number = hit[kind][1].upper() if kind == "chapter" else hit[kind][1].strip()
            title = []
            while i + 1 < len(lines) and not any(p.match(lines[i + 1][0]) for p in ends):
                title.append(lines[i + 1][0])
                i += 1
            piece = f"{named[kind][0]} {number}"
            open_at[kind] = add(kind, number, " ".join(title) or piece, "", page, piece, *named[kind][1])
            close_below(kind)
        elif hit["article"]:
            number = hit["article"][1].upper()
            open_at["article"] = add("article", number, None, "", page, f"Pasal {number}", "section", "part", "chapter")
            close_below("article")
        elif hit["paragraph"] and open_at["article"] is not None:
            open_at["paragraph"] = add("paragraph", hit["paragraph"][1], None, hit["paragraph"][2].strip(), page, f"Ayat ({hit['paragraph'][1]})", "article")
            open_at["letter"] = None
        elif hit["letter"] and open_at["article"] is not None:
            code = hit["letter"][1].lower()
            open_at["letter"] = add("letter", code, None, hit["letter"][2].strip(), page, f"Huruf {code}", "paragraph", "article")
        elif hit["numbered_item"] and open_at["article"] is not None:
            add("numbered_item", hit["numbered_item"][1], None, hit["numbered_item"][2].strip(), page, f"{hit['numbered_item'][1]}.", "letter", "paragraph", "article")
        elif hit["consideration"]:
            add("consideration", None, "Menimbang", hit["consideration"][1].strip(), page, "Menimbang")
        elif hit["legal_basis"]:
            add("legal_basis", None, "Mengingat", hit["legal_basis"][1].strip(), page, "Mengingat")
        elif hit["decision"]:
            add("decision", None, "MEMUTUSKAN:", hit["decision"][2].strip(), page, "MEMUTUSKAN")
        elif hit["closing"]:
            add("closing", None, "KETENTUAN PENUTUP", text, page, "KETENTUAN PENUTUP")
        elif not nodes:
            add("preamble", None, text, text, page, "PREAMBLE")
        elif open_at["article"] is not None and open_at["paragraph"] is None and open_at["letter"] is None:
            open_at["paragraph"] = add("paragraph", None, None, text, page, "Ayat (1)", "article")
        else:
            at = next((open_at[n] for n in ("letter", "paragraph") if open_at[n] is not None), roots[-1])
            nodes[at][3] = f"{nodes[at][3]}\n{text}".strip()
            nodes[at][5] = page
        i += 1
    for k in reversed(range(len(nodes))):
        mine = [n for n in nodes if n[7] == k]
        if mine:
            nodes[k][4], nodes[k][5] = min(n[4] for n in mine), max(n[5] for n in mine)
    return [(k + 1, *n[:7], None if n[7] is None else n[7] + 1) for k, n in enumerate(nodes)]


BITS = ["BAB I", "bab ii KETENTUAN", "Bagian Kesatu", "Paragraf 3", "Pasal 1", "Pasal 12A ayat", "(1) satu", "(2)", "a. huruf", "b) lain", "1. angka", "12) dua", "Menimbang : bahwa", "Mengingat:", "MEMUTUSKAN: x", "Menetapkan : y", "Ditetapkan di Jakarta", "biasa saja", "teks lanjutan", "Pasal Penutup"]


def test_windows_read_like_a_reader(spark):
    r = random.Random(11)
    docs = {d: [(r.choice(BITS) if r.random() < 0.9 else "biasa", 1 + k // 5) for k in range(r.randint(1, 30))] for d in range(150)}
    rows = [(d, k + 1, p, t) for d, lines in docs.items() for k, (t, p) in enumerate(lines)]
    r.shuffle(rows)
    got = {}
    for n in structure.nodes(spark.createDataFrame(rows, NORMAL).repartition(5)).collect():
        got.setdefault(n["document_id"], []).append((n["sequence"], n["node_type"], n["node_number"], n["title"], n["text"], n["page_start"], n["page_end"], n["path"], n["parent_sequence"]))
        assert n["ancestors"][-1] == n["sequence"] and (n["ancestors"][-2:-1] or [None])[0] == n["parent_sequence"]
    for d, lines in docs.items():
        assert sorted(got[d]) == read_in_order(lines), lines


def blocks(spark, rows):
    return spark.createDataFrame([(1, p, 0, k, t, y, y + 10) for k, (p, t, y) in enumerate(rows)], LINE)


def test_margins(spark):
    rows = [(1, "Judul", 50), (1, "isi satu", 300), (2, "Judul", 50), (2, "isi dua", 300), (3, " Judul ", 50), (3, "isi tiga", 300), (3, "isi tiga", 300), (2, "  ", 50), (3, "x" * 130, 50)]
    got = [(r["line_num"], r["text"]) for r in normalize.without_margins(blocks(spark, rows)).orderBy("line_num").collect()]
    assert [t for _, t in got] == ["Judul", "isi satu", "isi dua", "isi tiga", "isi tiga", "x" * 130] and [n for n, _ in got] == list(range(1, 7))


@pytest.mark.parametrize(
    "lines,want",
    [
        (["pemba-", "ngunan"], ["pembangunan"]),
        (["a-", "Pasal 1"], ["a-", "Pasal 1"]),
        (["(1) a-", "b"], ["(1) a-", "b"]),
        (["-", "b"], ["-", "b"]),
        (["a-", "b-", "c"], ["ab-", "c"]),
        (["a-", "b-", "c-", "d"], ["ab-", "cd"]),
        (["a-"], ["a-"]),
    ],
)
def test_hyphens(spark, lines, want):
    got = normalize.normalize(blocks(spark, [(1, t, 300) for t in lines])).orderBy("line_num").collect()
    assert [r["text"] for r in got] == want


def cut_in_order(text, largest):
    """One part after the other: up to the end of the last match, in the next `largest` characters, of the first pattern that has any."""
    parts = []
    while len(text) > largest:
        ends = ([m.end() for m in re.finditer(p, text[:largest])] for p in chunk.CUTS)
        place = next((found[-1] for found in ends if found), largest)
        parts.append(text[:place])
        text = text[place:]
    return [*parts, text] if text else parts


@pytest.mark.parametrize("largest", [1, 2, 7, 20, 200])
def test_cut(spark, largest):
    r = random.Random(largest)
    pieces = ["word", "a", " ", "  ", ". ", "; ", ", ", ".", ";", "\n", ".\n", "\n\n\n", "\r\n", "\u00e9", "\u00a0", "\u2003", "\x1d", "\U0001f600", "\U0010ffff"]
    texts = ["".join(r.choices(r.sample(pieces, r.randint(1, len(pieces))), k=r.randint(0, 300))) for _ in range(600)] + ["a. " * 10, "x" * 25, "\U0001f600" * 401, " " * 401]
    got = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "i int, t string").select("i", chunk.split("t", largest).alias("parts")).collect()
    for i, parts in got:
        assert parts == (cut_in_order(texts[i], largest) if i < len(texts) else [])
        assert "".join(parts) == (texts[i] if i < len(texts) else "") and all(0 < len(p) <= largest for p in parts)


def test_cut_of_a_very_long_text(spark):
    whole = ("Kalimat panjang sekali. " * 60 + "\n") * 2000
    got = spark.createDataFrame([(whole,), ("y" * 1_000_000,)], "t string").select(chunk.split("t").alias("parts")).collect()
    assert [r["parts"] for r in got] == [cut_in_order(t, chunk.LARGEST) for t in (whole, "y" * 1_000_000)]


def about(tree, spark):
    from pyspark.sql import functions as F

    return tree.select("*", F.lit("BI").alias("source"), F.lit("PBI").alias("regulation_type"), F.lit("1").alias("regulation_number"), F.lit("T").alias("regulation_title"))


def test_chunks_cover_and_validate(spark):
    long = "Kalimat panjang sekali. " * 100
    lines = [("Pembukaan", 1), ("BAB I", 1), ("UMUM", 1), ("Pasal 1", 1), ("(1) " + long, 1), ("a. huruf", 2), ("1. angka", 2), ("(2) ", 2), ("Ditetapkan di Jakarta", 3), ("Pasal 2", 3), ("isi", 3)]
    tree = structure.nodes(spark.createDataFrame([(1, k + 1, p, t) for k, (t, p) in enumerate(lines)], NORMAL))
    made = chunk.chunks(about(tree, spark))
    rows = made.orderBy("chunk_sequence").collect()
    assert [r["chunk_sequence"] for r in rows] == list(range(1, len(rows) + 1))
    assert rows[0]["structural_path"] == "PREAMBLE" and rows[1]["structural_path"] == "BAB I/Pasal 1/Ayat (1) [Part 1/2]"
    assert "".join(r["chunk_text"] for r in rows[1:3]) == long.strip()
    by = {r["structural_path"]: r for r in rows}
    item = by["BAB I/Pasal 1/Ayat (1)/Huruf a/1."]
    assert (item["chapter_title"], item["article_number"], item["paragraph_number"], item["letter_code"], item["numbered_item"]) == ("UMUM", "1", "1", "a", "1")
    assert by["KETENTUAN PENUTUP"]["chapter_title"] is None
    assert "BAB I/Pasal 1/Ayat (2)" not in by  # no text, no chunk
    assert len({r["chunk_hash"] for r in rows}) == len(rows)
    assert chunk.validate(tree, made).first()["is_valid"]
    report = chunk.validate(tree, made.filter("chunk_sequence > 1")).first()
    assert not report["is_valid"] and report["coverage"] < 1
    nothing = chunk.validate(tree, made.filter("false")).first()
    assert nothing["coverage"] == 0.0 and not nothing["is_valid"]


def test_coverage(spark):
    lines = spark.createDataFrame([(1, 1, 1, "Pasal 1"), (1, 2, 1, "(1) " + "isi " * 100), (2, 1, 1, "BAB I"), (2, 2, 1, "judul yang panjang")], NORMAL)
    got = {r["document_id"]: (r["is_valid"], r["structured_chars"]) for r in structure.coverage(lines, structure.nodes(lines)).collect()}
    assert got == {1: (True, 399), 2: (False, 0)}


def test_order_of_partitions_does_not_matter(spark):
    lines = [("Pasal 1", 1), ("isi-", 1), ("sambung", 1), ("a. b", 2)] * 5
    rows = [(d, k + 1, p, t) for d in range(4) for k, (t, p) in enumerate(lines)]
    one = Counter(map(str, structure.nodes(spark.createDataFrame(rows, NORMAL).coalesce(1)).collect()))
    assert one == Counter(map(str, structure.nodes(spark.createDataFrame(rows[::-1], NORMAL).repartition(7)).collect()))
