from __future__ import annotations

import datetime as dt
import json
import math

import pytest
from pyspark.sql import functions as F

from lexloom.operators import evaluate, registry
from lexloom.sources import gold, pages

LOG = "document_id long, sha256 string, observed_at timestamp_ntz"


def at(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(hours=n)


def test_content_that_returns_is_not_current_again(spark):
    log = spark.createDataFrame([(1, "a", at(0)), (1, "b", at(1)), (1, "a", at(2)), (2, "c", at(0)), (2, "c", at(5))], LOG)
    got = {(r["document_id"], r["sha256"]): (r["first_seen_at"], r["last_seen_at"], r["is_current"]) for r in registry.versions(log).collect()}
    assert got == {(1, "a"): (at(0), at(2), False), (1, "b"): (at(1), at(1), True), (2, "c"): (at(0), at(5), True)}
    assert {r[0]: r[1] for r in registry.pointers(log).collect()} == {1: "a", 2: "c"}
    assert tuple(registry.current_check(registry.versions(log)).first()) == (2, 0)


def test_upsert_keeps_what_new_rows_leave_out(spark):
    kind = "source string, regulation_type string, regulation_number string, title string, detail_url string, status string, published_date date"
    old = spark.createDataFrame([("BI", "PBI", "1", "old", "u", "Berlaku", dt.date(2020, 1, 1)), ("BI", "PBI", "2", "kept", "u", None, None)], kind)
    new = spark.createDataFrame([("BI", "PBI", "1", "", "v", "", None), ("BI", "PBI", "3", "new", "w", "x", dt.date(2021, 1, 1))], kind)
    got = {r["regulation_number"]: tuple(r)[3:] for r in registry.upsert(old, new).collect()}
    assert got == {"1": ("", "v", "Berlaku", dt.date(2020, 1, 1)), "2": ("kept", "u", None, None), "3": ("new", "w", "x", dt.date(2021, 1, 1))}
    twice = registry.upsert(registry.upsert(old, new), new)
    assert sorted(map(str, twice.collect())) == sorted(map(str, registry.upsert(old, new).collect()))


def test_replace_and_versions_known(spark):
    old = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "document_id long, version_id long, x string")
    new = spark.createDataFrame([(1, 2, "c")], "document_id long, version_id long, x string")
    assert sorted(r["x"] for r in registry.replace(old, new, ["document_id"]).collect()) == ["b", "c"]
    registry.check_versions(new, spark.createDataFrame([(1, 2)], "document_id long, version_id long"))
    with pytest.raises(ValueError):
        registry.check_versions(new, old)


def test_downloads(spark):
    log = spark.createDataFrame([(200, bytearray(b"%PDF-1"), False), (200, bytearray(b"<html"), True), (503, None, False), (404, None, False), (None, None, False), (418, None, True)], "status int, content binary, known boolean")
    log = log.withColumn("parsed", F.col("status") != 404).withColumn("documents", F.lit(2))
    assert registry.ingestion_summary(log).first().asDict() == {"discovered": 6, "metadata_parsed": 4, "documents_found": 12, "downloaded": 1, "new_versions": 1, "skipped": 1, "retryable": 2, "failed": 2, "not_pdf": 1}
    delays = log.select(registry.retry_delay(F.lit(2), F.col("status")), registry.retry_delay(F.lit(4), F.col("status"))).collect()
    assert [tuple(r) for r in delays] == [(None, None), (None, None), (2.0, None), (None, None), (2.0, None), (None, None)]


def test_repeated_keys_are_folded(spark):
    kind = "source string, regulation_type string, regulation_number string, title string, detail_url string, status string, n int"
    old = spark.createDataFrame([("BI", "PBI", "1", "old", "u", "Berlaku", 0)], kind)
    new = spark.createDataFrame([("BI", "PBI", "1", "b", "v", "", 2), ("BI", "PBI", "1", "a", "w", "Dicabut", 1), ("BI", "PBI", "2", "x", "", None, 1), ("BI", "PBI", "2", "", "y", "z", 3)], kind)
    got = {r["regulation_number"]: tuple(r)[3:6] for r in registry.upsert(old, new, order="n").collect()}
    assert got == {"1": ("b", "v", "Dicabut"), "2": ("", "y", "z")}
    assert registry.upsert(old, new).count() == 2
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (2, "b")], "k int, x string")
    for order in ("x", None):
        assert sorted(r["k"] for r in registry.insert_if_absent(rows.filter("k = 1"), rows, ["k"], order).collect()) == [1, 2]
    assert sorted(map(tuple, registry.insert_if_absent(rows.filter("k = 1"), rows, ["k"], "x").collect())) == [(1, "a"), (2, "b")]


def test_metric_lines(spark):
    requests = spark.createDataFrame([("/a", 200, 0.5), ("/a", 200, 0.25), ("/b", 500, 1.0)], "endpoint string, code int, seconds double")
    lines = [r["line"] for r in registry.exposition(requests, ["endpoint", "code"], "seconds", "n_total", "took").orderBy("line_no").collect()]
    assert lines == ['n_total{endpoint="/a",code="200"} 2', 'n_total{endpoint="/b",code="500"} 1', 'took_sum{endpoint="/a",code="200"} 0.750000', 'took_count{endpoint="/a",code="200"} 2', 'took_sum{endpoint="/b",code="500"} 1.000000', 'took_count{endpoint="/b",code="500"} 1']


LISTING = """<table><tr><td><a href="/id/peraturan/Pages/PBI_1.aspx">Peraturan 23/6/PBI/2021 tentang X</a></td></tr>
<tr><td><a href='/id/peraturan/Pages/PBI_1.aspx'>again</a></td></tr><a class=x href="/id/peraturan/b.pdf">a pdf file</a>
<a href="https://other.example/peraturan/c.aspx"><b>No</b> number here</a><a href="/peraturan/default.aspx">Default page</a><a href="/peraturan/d">x</a><a href="/peraturan/d">long title</a></table>"""


def test_listing_by_portal(spark):
    rows = spark.createDataFrame([(1, "https://portal.example/id/list.aspx?p=1", LISTING), (2, "https://portal.example/", None)], "page_id long, url string, html string")
    got = [(r["detail_url"], r["title"], r["regulation_number"]) for r in pages.listing(rows, pages.CENTRAL_BANK).orderBy("position").collect()]
    assert got == [
        ("https://portal.example/id/peraturan/Pages/PBI_1.aspx", "Peraturan 23/6/PBI/2021 tentang X", "23/6/PBI/2021"),
        ("https://other.example/peraturan/c.aspx", "Nonumber here", "PBI-UNKNOWN"),
        ("https://portal.example/peraturan/d", "long title", "PBI-UNKNOWN"),
    ]
    assert pages.listing(rows, pages.CENTRAL_BANK, limit=1).count() == 1
    hidden = pages.Portal("X", "Y", "/peraturan/", ("/default.aspx",), marks_before_title=True)
    assert [r["title"] for r in pages.listing(rows, hidden).orderBy("position").collect()] == ["Peraturan 23/6/PBI/2021 tentang X", "Nonumber here"]


@pytest.mark.parametrize(
    "text,want",
    [("15 Desember 2021", dt.date(2021, 12, 15)), ("1 FEBRUARI 2020", dt.date(2020, 2, 1)), ("31 Februari 2021", None), ("3 Smarch 2021", dt.date(2021, 1, 3)), ("2021", None), ("a Mei 2021", None), ("1 Mei 2021 x", None), (None, None), ("", None)],
)
def test_dates(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(pages.local_date(F.col("t"))).first()[0] == want


def test_details_and_attachments(spark):
    html = '<h2 class="Main-Title">Judul <i>A</i></h2>Status : Dicabut\n<p>Tanggal Terbit: 5 Mei 2021</p>\nTanggal  Berlaku : 6 Juni 2021\n<div class="content">isi</div><a href="x.pdf">Salinan</a><a href="/y.pdf">Tanya jawab</a><a href="x.pdf">FAQ</a><a href="z.pdf">Penjelasan</a>'
    rows = spark.createDataFrame([(1, "https://p.example/a/b.aspx", html), (2, "https://p.example/a/", "<p>nothing</p>")], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in pages.detail(rows, pages.CENTRAL_BANK, default_title=F.lit("ref")).collect()}
    assert (got[1]["title"], got[1]["status"], got[1]["published_date"], got[1]["effective_date"], got[1]["summary"]) == ("JudulA", "Dicabut", dt.date(2021, 5, 5), dt.date(2021, 6, 6), "isi")
    assert (got[2]["title"], got[2]["status"], got[2]["published_date"], got[2]["summary"]) == ("ref", "Berlaku", None, None)
    kinds = [(r["document_url"], r["document_type"]) for r in pages.attachments(rows, pages.CENTRAL_BANK).orderBy("position").collect()]
    assert kinds == [("https://p.example/a/x.pdf", "regulation"), ("https://p.example/y.pdf", "faq"), ("https://p.example/a/z.pdf", "other")]


GOLD = "sample_id string, document_id string, structural_path string, page_start int, page_end int, relevance int"
RESULT = "sample_id string, rank int, document_id string, structural_path string, page_start int, page_end int"


def test_retrieval_metrics(spark):
    samples = spark.createDataFrame([("a", "in_domain"), ("b", "in_domain"), ("c", "out_of_domain"), ("d", "in_domain")], "sample_id string, query_type string")
    evidence = spark.createDataFrame([("a", "d", "Pasal 1", 1, 1, 3), ("a", "d", "Pasal 2", 1, 1, 1), ("b", "d", "Pasal 9", 1, 1, 2), ("c", "d", "Pasal 1", 1, 1, 3)], GOLD)
    results = spark.createDataFrame([("a", 1, "d", "Pasal 5", 1, 1), ("a", 2, "d", "Pasal 1 [Part 1/2]", 1, 1), ("a", 3, "d", "Pasal 1 [part 2/2]", 1, 1), ("a", 4, "d", "Pasal 2", 2, 2), ("c", 1, "d", "Pasal 1", 1, 1)], RESULT)
    got = {r["sample_id"]: r for r in evaluate.per_sample(samples, results, evidence).collect()}
    assert set(got) == {"a", "b"}  # out of domain, and without gold, do not count
    a = got["a"]
    assert (a["rr_1"], a["rr_5"], a["hit_1"], a["hit_5"], a["precision_5"], a["recall_5"]) == (0, 0.5, 0, 1, 0.4, 1.0)
    assert a["ndcg_5"] == pytest.approx(min(1.0, (7 / math.log2(3) + 7 / 2) / (7 + 1 / math.log2(3))))
    assert got["b"]["rr_10"] == got["b"]["ndcg_10"] == 0
    assert evaluate.stage_summary(evaluate.per_sample(samples, results, evidence), "x").first()["rr_5"] == 0.25
    nothing = evaluate.stage_summary(evaluate.per_sample(samples.filter("false"), results, evidence), "x").first()
    assert nothing["n_samples"] == 0 and nothing["ndcg_5"] == 0.0


def test_generation_metrics(spark):
    samples = spark.createDataFrame([(1, "One claim [C1]. Another claim. Again [C1].", False, None), (2, "declined", True, True), (3, "no tags at all", False, True)], "key long, answer string, abstained boolean, expected_abstain boolean")
    place = "document_id string, structural_path string, page_start int, page_end int"
    cited = spark.createDataFrame([(1, "C1", None, "Pasal 1 [Part 1/2]", 1, 2), (2, "C1", None, "Pasal 1", 1, 2)], f"key long, context_id string, {place}")
    evidence = spark.createDataFrame([(1, "d", "Pasal 1", 1, 2), (1, "d", "Pasal 2", 1, 2), (2, "d", "Pasal 1", 1, 2)], f"key long, {place}")
    claims = spark.createDataFrame([(1, "x", "d", "Pasal 1", 1, 2), (1, "y", "d", "Pasal 1", 1, 2), (1, "y", "d", "Pasal 2", 1, 2)], f"key long, claim_id string, {place}")
    r = evaluate.generation(samples, cited, evidence, claims).first()
    assert r.asDict() == {"total_samples": 3, "citation_validity": 0.5, "citation_precision": 1.0, "citation_recall": 0.5, "grounding_coverage": 0.5, "gold_claim_coverage": 0.5, "unsupported_claim_rate": 0.5, "abstention_accuracy": round(2 / 3, 4)}
    none = evaluate.generation(samples.filter("false"), cited, evidence, claims).first()
    assert none["total_samples"] == 0 and none["citation_validity"] == 0.0 and none["unsupported_claim_rate"] == 0.0
    empty = evaluate.generation(samples.filter("key = 2"), cited, evidence, claims).first()
    assert empty["citation_validity"] == 1.0 and empty["citation_recall"] == 1.0 and empty["abstention_accuracy"] == 1.0


def test_gold_files(spark, tmp_path):
    place = {"document_id": "d", "structural_path": "Pasal 1", "page_start": 1, "page_end": 1}
    data = {"dataset_version": "1", "corpus_scope": ["a"], "samples": [{"sample_id": "s", "query": "q", "query_type": "in_domain", "canonical_ground_truth": [place, {**place, "relevance": 1}], "gold_generation": {"expected_abstain": False, "expected_claims": [{"claim_id": "c", "claim_description": "x", "supporting_evidence": [place]}]}}]}
    (tmp_path / "gold.json").write_text(json.dumps(data))
    samples = gold.load(spark, str(tmp_path / "gold.json"))
    assert sorted(r["relevance"] for r in gold.gold(samples).collect()) == [1, 3] and gold.gold_claims(samples).first()["claim_id"] == "c"
    gold.save(samples, str(tmp_path / "again.json"), "1", ["a"])
    assert gold.load(spark, str(tmp_path / "again.json")).count() == 1
    with pytest.raises(FileNotFoundError):
        gold.load(spark, str(tmp_path / "missing.json"))
    for name, text in (("broken", "{"), ("none", json.dumps({**data, "samples": []})), ("grade", json.dumps({**data, "samples": [{**data["samples"][0], "canonical_ground_truth": [{**place, "relevance": 9}]}]}))):
        (tmp_path / f"{name}.json").write_text(text)
        with pytest.raises(ValueError):
            gold.load(spark, str(tmp_path / f"{name}.json"))


def test_reports(spark, tmp_path):
    names = [n for n, _ in gold.STAGE_TABLE]
    stages = spark.createDataFrame([("dense", 3, *[0.5] * len(names)), ("bm25", 3, *[0.25] * len(names))], "stage string, n_samples long, " + ", ".join(f"{n} double" for n in names))
    gold.export(stages, spark.createDataFrame([(3, 1.0, 0.255)], "total_samples long, citation_validity double, abstention_accuracy double"), str(tmp_path / "out"), "v1")
    report, text = json.loads((tmp_path / "out/report.json").read_text()), (tmp_path / "out/report.md").read_text()
    assert report["retrieval"][1]["rr_5"] == 0.25 and report["total_samples"] == 3 and report["dataset_version"] == "v1"
    assert "| bm25 |" + " 0.2500 |" * len(names) in text and "- Abstention accuracy: `25.50 %`" in text
    gold.export(stages, None, str(tmp_path / "out"))
    assert "None was measured" in (tmp_path / "out/report.md").read_text()


def test_files_are_written_and_unregistered_ones_removed(spark, tmp_path):
    from lexloom.sources import storage

    root = f"file://{tmp_path}/raw"
    rows = spark.createDataFrame([(f"{root}/BI/PBI/1/a.pdf", bytearray(b"%PDF-1")), (f"{root}/BI/PBI/2/b.pdf", None), (None, bytearray(b"x"))], "path string, content binary").repartition(2)
    for _ in range(2):  # once more does no harm
        assert sorted(r["bytes"] for r in storage.write_files(rows).collect()) == [0, 6]
    assert (tmp_path / "raw/BI/PBI/1/a.pdf").read_bytes() == b"%PDF-1" and sorted(p.name for p in (tmp_path / "raw").rglob("*.*")) == ["a.pdf", "b.pdf"]
    gone = storage.remove_unregistered(rows, rows.filter("path like '%a.pdf'")).collect()
    assert [tuple(r) for r in gone] == [(f"{root}/BI/PBI/2/b.pdf", True)] and not (tmp_path / "raw/BI/PBI/2/b.pdf").exists()
    about = spark.createDataFrame([(7, "bi", "PBI", None)], "id long, source string, kind string, title string")
    made = about.select(storage.metadata_path(f"{root}/meta", "source", "kind", "id").alias("path"), storage.metadata_json("id", ("source", "title")).alias("content"))
    storage.write_files(made).collect()
    assert json.loads((tmp_path / "raw/meta/BI/PBI/7.json").read_text()) == {"regulation_id": "7", "metadata": {"source": "bi", "title": None}, "extra_info": {}}


def test_portal_pages_like_a_browser_reads_them(spark):
    bank = """<div class="bi-row-item"><a href=/id/peraturan/Pages/A.aspx>Peraturan &quot;A&quot;</a></div><a href="../peraturan/B.aspx">Peraturan B</a><a href="?q=/peraturan/c">Peraturan C</a><a href="//cdn.example/peraturan/d">Peraturan D</a>"""
    rows = spark.createDataFrame([(1, "https://p.example/a/b/c.aspx", bank)], "page_id long, url string, html string")
    got = [(r["detail_url"], r["title"]) for r in pages.listing(rows, pages.CENTRAL_BANK).orderBy("position").collect()]
    assert got == [("https://p.example/id/peraturan/Pages/A.aspx", 'Peraturan "A"'), ("https://p.example/a/peraturan/B.aspx", "Peraturan B"), ("https://p.example/a/b/c.aspx?q=/peraturan/c", "Peraturan C"), ("https://cdn.example/peraturan/d", "Peraturan D")]
    authority = '<h1 id="title">Peraturan OJK</h1><p>Status : Dicabut</p>\n<p>Tanggal Terbit : 1 Mei 2020</p><p>Sektor : Perbankan</p>\n<div class="description">in <div>inner</div> tail</div><a href="d/">x.pdf</a><a href="POJK.pdf">Salinan</a>'
    rows = spark.createDataFrame([(1, "https://o.example/x/", authority)], "page_id long, url string, html string")
    r = pages.detail(rows, pages.SERVICES_AUTHORITY).first()
    assert (r["title"], r["status"], r["published_date"], r["summary"], r["sector"]) == ("Peraturan OJK", "Dicabut", None, "ininnertail", "Perbankan")
    assert [tuple(r)[2:5] for r in pages.attachments(rows, pages.SERVICES_AUTHORITY).collect()] == [("regulation", "https://o.example/x/POJK.pdf", "POJK.pdf")]
    assert pages.listing(rows, pages.SERVICES_AUTHORITY).count() == 0


def test_odd_pages_are_read():
    for html in ("", "<", "<a", "<a href", "</p></a>", "<a href=x><a href=y>t", "<!-- <a href=z> -->", "<script><a href=q></script><a href='w'>&nbsp;ok</a>", "<p" * 1000, "&#x110000; &bogus;"):
        page = pages.Page(html)
        assert all(0 <= e.first <= e.end <= len(page.pieces) for e in page.elements)


class _Site:
    """A site of its own: /flaky fails twice, /gone is refused, /moved leads on."""

    def __enter__(self):
        import http.server
        import threading

        seen = {}

        class Handler(http.server.BaseHTTPRequestHandler):
            def do_GET(self):
                seen[self.path] = seen.get(self.path, 0) + 1
                if self.path == "/moved":
                    self.send_response(302)
                    self.send_header("Location", "/page")
                    self.end_headers()
                    return
                status = 503 if self.path == "/down" or self.path == "/flaky" and seen[self.path] < 3 else 404 if self.path == "/gone" else 200
                self.send_response(status)
                self.send_header("Content-Type", "text/html")
                self.end_headers()
                self.wfile.write(b"<p>body</p>")

            def log_message(self, *args):
                pass

        self.server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        return f"http://127.0.0.1:{self.server.server_port}", seen

    def __exit__(self, *args):
        self.server.shutdown()
        self.server.server_close()


def test_fetching_tries_again_only_what_may_pass(spark):
    import hashlib

    from lexloom.sources import fetch

    with _Site() as (site, seen):
        asked = spark.createDataFrame([(f"{site}{p}",) for p in ("/page", "/page", "/flaky", "/gone", "/down", "/moved")] + [("http://127.0.0.1:9/none",), (None,)], "url string")
        rows = {r["url"].split("/")[-1]: r for r in fetch.fetch(asked, pause=0.01, first_wait=0.01).collect()}
    assert {k: (r["outcome"], r["status"], r["attempts"]) for k, r in rows.items()} == {"page": ("ok", 200, 1), "flaky": ("ok", 200, 3), "gone": ("refused", 404, 1), "down": ("exhausted", 503, 4), "moved": ("ok", 200, 1), "none": ("exhausted", None, 4)}
    assert rows["page"]["sha256"] == hashlib.sha256(b"<p>body</p>").hexdigest() and rows["moved"]["final_url"].endswith("/page") and rows["gone"]["content"] is None
    assert seen["/down"] == 4 and seen["/flaky"] == 3
    waits = []
    fetch.tried("x", lambda url: (_ for _ in ()).throw(TimeoutError()), sleep=waits.append)
    assert waits == [1.0, 2.0, 4.0]


def test_blocks_of_files_become_lines(spark):
    from lexloom.operators import normalize
    from lexloom.sources import blocks

    def reader():
        def read(content):
            for page in content.decode().split("\f"):
                yield [(0, 10 * i, 5, 10 * i + 9, part, i, int(part.startswith("<img"))) for i, part in enumerate(page.split("|"))]

        return read

    files = spark.createDataFrame([(1, bytearray(b"Pasal 1| one\n two \n\n|<img>|  \fnext")), (2, None)], "document_id long, content binary")
    found = blocks.blocks(files, reader)
    assert [(r["page_num"], r["block_num"], r["text"]) for r in found.orderBy("page_num", "block_num").collect()] == [(1, 0, "Pasal 1"), (1, 1, "one\n two"), (2, 0, "next")]
    made = normalize.normalize(blocks.lines(found)).orderBy("line_num").collect()
    assert [(r["page_num"], r["text"]) for r in made] == [(1, "Pasal 1"), (1, "one"), (1, "two"), (2, "next")]
    try:
        import fitz  # noqa: F401
    except ImportError:
        with pytest.raises(ImportError):
            blocks.pdf()
