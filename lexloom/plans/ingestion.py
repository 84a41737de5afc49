"""Ingestion and registry queries: listings from pages, versions from events, mutations on documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexloom.operators import propagate, registry
from lexloom.plans.retrieval import read
from lexloom.sources import pages as src
from lexloom.sources import snapshots, storage
from lexloom.sources.snapshots import Change
from lexloom.sources.tables import folder
from lexloom.streaming import versions

PORTAL = src.Portal("WEB", "PAGE", "/", ("/default.aspx",), number=r"([A-Z]\w{3})", unknown_number="PAGE-UNKNOWN", title_attribute=None, dated=False)
STRICT = src.Portal("WEB", "PAGE", "/", ("/default.aspx",), number=r"([A-Z]\w{3})", unknown_number="PAGE-UNKNOWN", marks_before_title=True, least_title=4)

#: Listing and detail pages made from the page's number, the same words for both engines.
_ROWS = """'<div class="bi-row-item"><a href="/id/peraturan/Pages/P' || page_id || '.aspx">Peraturan <b>No. ' || page_id || '/1/PBI/2021</b> A &amp; B</a> <a href="/id/other/x">zweiter</a></div><a href=../peraturan/Q' || page_id || '.aspx>PBI Q</a><a href="/id/peraturan/Q' || page_id || '.aspx">noch einmal</a><a href="/ID/PERATURAN/Z.aspx">not listed</a><table><tr><td><a href="/ID/PERATURAN/T.aspx">in a row ' || page_id || '</a></td></tr></table><a href="/id/peraturan/Default.aspx">Peraturan</a><a href="/id/peraturan/d.pdf">a file of its</a><a href="?peraturan=/peraturan/' || page_id || '#f">' || CASE page_id % 2 WHEN 0 THEN 'query link' ELSE 'tiny' END || '</a>'"""
_POJK = """'<ul><li><a href="/id/Pages/L' || page_id || '.aspx">x</a></li></ul><a href="/id/regulasi/Pages/L' || page_id || '.aspx">hidden by a short title</a><a href="/id/regulasi/Pages/POJK-' || page_id || '.aspx">Peraturan OJK Nomor 12/POJK.03/' || CAST(2000 + page_id % 20 AS INT) || '</a><a href="/id/Pages/plain.aspx">not listed</a><div class="x item"><p><a href="./Pages/I.aspx">Nomor <i>' || page_id || '</i>/POJK/2020</a></p></div>'"""
_DETAIL = """'<html><script>Status : no</script><h1 class="page-title">Peraturan &amp; ' || page_id || '</h1><div><p>Status : ' || CASE WHEN page_id % 3 = 0 THEN 'Dicabut' ELSE 'Berlaku ' END || '</p>' || CHR(10) || '<p>Tanggal Terbit : ' || CAST(1 + page_id % 31 AS INT) || ' ' || CASE page_id % 4 WHEN 0 THEN 'Desember' WHEN 1 THEN 'FEBRUARI' WHEN 2 THEN 'Smarch' ELSE 'Mei' END || ' 2021</p></div><div class="summary">  Ringkasan <div><b>' || page_id || '</b></div> tail</div><a href="/docs/' || page_id || '.pdf">' || CASE page_id % 5 WHEN 0 THEN 'FAQ dan tanya jawab' WHEN 1 THEN 'Abstrak' WHEN 2 THEN 'Lampiran I' WHEN 3 THEN 'Salinan Peraturan' ELSE 'Unduh' END || '</a><a href="/docs/' || page_id || '.pdf">FAQ lagi</a><a href=extra.PDF?x=1>Penjelasan</a></html>'"""
_OTHER = """'<h1 class="title">site</h1>' || CASE WHEN page_id % 4 = 0 THEN '' ELSE '<h2 id="PageTitle">POJK ' || page_id || '</h2>' END || '<p>Sektor : ' || CASE page_id % 3 WHEN 0 THEN 'Perbankan' ELSE 'Asuransi' END || CHR(10) || '</p><p>Tanggal Terbit : 3 Mei 2021</p><div class="summary">no</div><div class="page-description">Menetapkan &lt;' || page_id || '&gt;</div>'"""


def _made(s, d, html):
    return read(s, d, "pages").select("page_id", F.lit("https://portal.example/id/regulasi/list.aspx?p=1").alias("url"), F.expr(html).alias("html"))


def _details(s, d):
    return read(s, d, "pages").select("page_id", "url", F.expr(_DETAIL).alias("html"))


def _events(s, d):
    return read(s, d, "events").select(F.col("user_id").alias("document_id"), F.col("event_type").alias("sha256"), F.col("ts").alias("observed_at"))


def _versions(s, d):
    return registry.versions(_events(s, d))


def _regulations(s, d):
    return read(s, d, "documents").select("source", F.col("lang").alias("regulation_type"), F.col("doc_id").cast("string").alias("regulation_number"), F.concat(F.lit("Judul "), F.col("doc_id").cast("string")).alias("title"), F.concat(F.lit("/d/"), F.col("doc_id").cast("string")).alias("detail_url"), F.when(F.col("doc_id") % 2 == 0, F.lit("Berlaku")).alias("status"), F.concat(F.lit("r"), F.col("doc_id").cast("string")).alias("summary"))


def _changed(s, d):
    """Every third regulation again, some with empty values, and new ones; every sixth twice."""
    n = F.col("regulation_number").cast("long")
    rows = _regulations(s, d).filter(n % 3 == 0).withColumn("arrival", F.explode(F.sequence(F.lit(1), F.when(n % 6 == 0, 2).otherwise(1))))
    number = F.when(n % 9 == 0, F.concat("regulation_number", F.lit("x"))).otherwise(F.col("regulation_number"))
    return rows.select("source", "regulation_type", number.alias("regulation_number"), F.concat("title", F.lit(" baru "), F.col("arrival").cast("string")).alias("title"), "detail_url", F.when((n + F.col("arrival")) % 2 == 0, "Dicabut").otherwise("").alias("status"), F.when(F.col("arrival") == 2, "s2").alias("summary"), "arrival")


def _keyed(s, d, test, label):
    return read(s, d, "documents").filter(test).select(F.col("doc_id").alias("document_id"), (F.col("doc_id") % 7).alias("sequence"), F.lit(label).alias("label"))


def _current(s, d):
    """Chunks of the document id mod 150, at the version that their number picks."""
    types = F.array(*[F.lit(x) for x in ("click", "error", "purchase", "signup", "view")])
    chunks = read(s, d, "documents").select(F.col("doc_id").alias("chunk_id"), (F.col("doc_id") % 150).alias("document_id"), F.element_at(types, (F.col("doc_id") % 5 + 1).cast("int")).alias("sha256"), "source")
    return registry.current_chunks(chunks, _versions(s, d)).select("chunk_id", "document_id", "sha256", "source")


def _log(s, d):
    status = F.element_at(F.array(*[F.lit(x) for x in (200, 200, 200, 404, 503, 429, 500, 201, 403, 418)]), (F.col("event_id") % 10 + 1).cast("int"))
    content = F.concat(F.when(F.col("user_id") % 4 == 0, "<html>").otherwise("%PDF-1.7 "), "props").cast("binary")
    return read(s, d, "events").select((F.col("event_id") % 9 != 0).alias("parsed"), F.when(F.col("event_id") % 3 == 0, F.col("event_id") % 4).otherwise(0).alias("documents"), F.when(F.col("event_id") % 50 != 0, status).alias("status"), content.alias("content"), (F.col("user_id") % 3 == 0).alias("known"))


def _replaced(s, d):
    """Nodes of half the documents, then of others anew, through two commits, read back."""
    root = folder(s, "snapshots")
    snapshots.commit(s, root, {"document_nodes": Change(_keyed(s, d, "doc_id % 2 = 0", "old"))})
    snapshots.commit(s, root, {"document_nodes": Change(_keyed(s, d, "doc_id % 6 = 0 or doc_id % 5 = 0", "new"))})
    return snapshots.read(s, root, "document_nodes")


def _models(s, d, test, label):
    """Vectors of two models for each document."""
    rows = read(s, d, "embeddings").filter(test).select(F.col("vec_id").alias("document_id"), F.explode(F.array(F.lit("one"), F.lit("two"))).alias("embedding_model"), F.round(F.col("embedding")[0].cast("double"), 4).alias("first"))
    return rows.withColumn("label", F.lit(label))


def _replaced_models(s, d):
    """New vectors of one model leave those of the other; documents divisible by 7 lose those of model two."""
    root = folder(s, "snapshots")
    keys = ("document_id", "embedding_model")
    snapshots.commit(s, root, {"chunk_embeddings": Change(_models(s, d, "true", "old"), keys)})
    gone = _models(s, d, "vec_id % 7 = 0", "").filter("embedding_model = 'two'")
    snapshots.commit(s, root, {"chunk_embeddings": Change(_models(s, d, "vec_id % 3 = 0", "new").filter("embedding_model = 'one'"), keys, gone)})
    return snapshots.read(s, root, "chunk_embeddings")


def _streamed(s, d):
    """The events as files of a stream, in no order, so that each batch brings late ones."""
    root = folder(s, "stream")
    events = _events(s, d)
    events.repartition(3, F.xxhash64("observed_at")).write.parquet(f"{root}/in")
    arriving = s.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(f"{root}/in")
    versions.follow(arriving, f"{root}/out", f"{root}/state").awaitTermination()
    return versions.registry(s, f"{root}/out")


def _document_rows(s, d, text, version, test="true"):
    """Chunks of the documents id mod 150, with nodes and embeddings, at a version."""
    chunks = read(s, d, "documents").filter(test).select((F.col("doc_id") % 150).alias("document_id"), F.lit(version).alias("version_id"), F.col("doc_id").alias("chunk_id"), F.expr(text).alias("chunk_text"))
    return {"retrieval_chunks": chunks, "document_nodes": chunks.select("document_id", "version_id", F.col("chunk_id").alias("node_id")), "chunk_embeddings": chunks.select("document_id", "version_id", "chunk_id", F.length("chunk_text").alias("size"))}


def _after_delta(s, d):
    """An index of all documents; then every fifth has a new version with other texts and fewer chunks, and every seventh has none."""
    root = folder(s, "snapshots")
    first = _document_rows(s, d, "text", 1)
    propagate.replace_documents(s, root, first["retrieval_chunks"], first)
    changed = first["retrieval_chunks"].filter("document_id % 5 = 0 or document_id % 7 = 0")
    propagate.replace_documents(s, root, changed, _document_rows(s, d, "concat('baru versi', chr(10), substring(text, 1, 200))", 2, "doc_id % 150 % 5 = 0 and doc_id % 150 % 7 <> 0 and doc_id % 2 = 0"))
    return root


def _delta_counts(s, d):
    root = _after_delta(s, d)
    left = {t: snapshots.read(s, root, t).groupBy("version_id").agg(F.count(F.lit(1)).alias(t)) for t in propagate.CHILDREN}
    rows = left["document_nodes"].join(left["retrieval_chunks"], "version_id").join(left["chunk_embeddings"], "version_id")
    return rows.join(F.broadcast(propagate.report(s, root)))  # one row


_META = ("source", "regulation_type", "regulation_number", "title", "status", "detail_url", "summary")

QUERIES = {
    "listing_refs": lambda s, d: src.listing(read(s, d, "pages"), PORTAL).select("page_id", "detail_url", "title", "regulation_number"),
    "first_seen_links": lambda s, d: src.listing(read(s, d, "pages"), STRICT).select("page_id", "position", "detail_url", "title"),
    "listing_limited": lambda s, d: src.listing(read(s, d, "pages"), PORTAL, limit=2).select("page_id", "position", "detail_url"),
    "listing_central_bank": lambda s, d: src.listing(_made(s, d, _ROWS), src.CENTRAL_BANK).select("page_id", "position", "detail_url", "title", "regulation_number"),
    "listing_authority": lambda s, d: src.listing(_made(s, d, _POJK), src.SERVICES_AUTHORITY).select("page_id", "position", "detail_url", "title", "regulation_number"),
    "detail_metadata": lambda s, d: src.detail(_details(s, d), src.CENTRAL_BANK).select("page_id", "title", "status", "published_date", "effective_date", "summary", "sector"),
    "detail_authority": lambda s, d: src.detail(_made(s, d, _OTHER), src.SERVICES_AUTHORITY, default_title=F.lit("listed"), default_published=F.lit("2020-02-02").cast("date")).select("page_id", "title", "status", "published_date", "effective_date", "summary", "sector"),
    "page_details": lambda s, d: src.detail(read(s, d, "pages"), PORTAL, default_title=F.lit("-")).select("page_id", "title", "status", "summary"),
    "retry_plan": lambda s, d: _log(s, d).select(F.explode(F.sequence(F.lit(1), F.lit(4))).alias("attempt"), "status").withColumn("delay", registry.retry_delay(F.col("attempt"), F.col("status"))).groupBy("attempt", "status").agg(F.count("delay").alias("retried"), F.max("delay").alias("seconds")),
    "attachments": lambda s, d: src.attachments(_details(s, d), src.SERVICES_AUTHORITY).select("page_id", "position", "document_type", "document_url", "filename"),
    "upsert_registry": lambda s, d: registry.upsert(_regulations(s, d), _changed(s, d), order="arrival"),
    "insert_if_absent": lambda s, d: registry.insert_if_absent(_keyed(s, d, "doc_id % 3 = 0", "old"), _keyed(s, d, "doc_id % 2 = 0", "new").unionByName(_keyed(s, d, "doc_id % 4 = 0", "second")), ["document_id"], order="label"),
    "version_registry": lambda s, d: _versions(s, d),
    "version_pointers": lambda s, d: registry.pointers(_events(s, d)).join(_versions(s, d).filter("is_current").select("document_id", F.col("sha256").alias("current")), "document_id").select("document_id", "sha256", (F.col("sha256") != F.col("current")).alias("differs")),
    "single_current_check": lambda s, d: registry.current_check(_versions(s, d)),
    "replace_partition": lambda s, d: registry.replace(_keyed(s, d, "doc_id % 2 = 0", "old"), _keyed(s, d, "doc_id % 6 = 0 or doc_id % 5 = 0", "new"), ["document_id"]),
    "snapshot_replace": _replaced,
    "snapshot_models": _replaced_models,
    "version_stream": _streamed,
    "index_after_delta": _delta_counts,
    "terms_after_delta": lambda s, d: snapshots.read(s, _after_delta(s, d), propagate.TERMS),
    "cascade_orphans": lambda s, d: registry.cascade(_keyed(s, d, "true", "child"), _keyed(s, d, "doc_id % 4 <> 1", "parent"), ["document_id"]),
    "request_metrics": lambda s, d: registry.exposition(read(s, d, "events").withColumn("bucket", F.col("user_id") % 3), ["event_type", "bucket"], "value", "http_requests_total", "http_request_duration_seconds"),
    "current_chunks": _current,
    "storage_paths": lambda s, d: read(s, d, "documents").withColumn("sha", F.sha2("text", 256)).select("doc_id", registry.storage_path("raw", "source", "lang", "doc_id", "sha").alias("path")),
    "metadata_json": lambda s, d: _regulations(s, d).select("regulation_number", F.to_json(F.struct("source", "regulation_type", "regulation_number", "title"), {"ignoreNullFields": "false"}).alias("metadata")),
    "metadata_artifacts": lambda s, d: _regulations(s, d).select(storage.metadata_path("meta", "source", "regulation_type", "regulation_number").alias("path"), storage.metadata_json("regulation_number", _META).alias("artifact")),
    "ingestion_summary": lambda s, d: registry.ingestion_summary(_log(s, d)),
}

_EVENTS = "log AS (SELECT user_id AS document_id, event_type AS sha256, ts AS observed_at FROM events)"
_VERSIONS = f"{_EVENTS},\nversions AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY first_seen_at DESC, sha256 DESC) = 1 AS is_current FROM (SELECT document_id, sha256, min(observed_at) AS first_seen_at, max(observed_at) AS last_seen_at FROM log GROUP BY ALL))"
_LINKS = r"""anchors AS (SELECT page_id, url, a, i AS position FROM (SELECT page_id, url, unnest(x) AS a, unnest(range(0, len(x))) AS i FROM (SELECT page_id, url, regexp_extract_all(html, '(?is)<a\s[^>]*?href\s*=\s*["''][^"'']*["''][^>]*>.*?</a>') AS x FROM src))),
links AS (SELECT page_id, url, position, trim(regexp_extract(a, '(?is)href\s*=\s*["'']([^"'']*)["'']', 1)) AS href, trim(regexp_replace(regexp_extract(a, '(?is)^<a\s[^>]*>(.*?)</a>', 1), '<[^>]*>', '', 'g')) AS link_text FROM anchors),
targets AS (SELECT *, CASE WHEN regexp_matches(href, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN href WHEN starts_with(href, '/') THEN regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)', 1) || href ELSE CASE WHEN regexp_matches(url, '^[a-zA-Z]+://[^/]*$') THEN regexp_extract(url, '^([a-zA-Z]+://[^/?#]*)', 1) || '/' ELSE regexp_replace(regexp_replace(url, '[?#].*$', ''), '([^/:]/)[^/]*$', '\1') END || href END AS target FROM links)"""
_REGS = "regs AS (SELECT source, lang AS regulation_type, doc_id::VARCHAR AS regulation_number, 'Judul ' || doc_id AS title, '/d/' || doc_id AS detail_url, CASE WHEN doc_id % 2 = 0 THEN 'Berlaku' END AS status, 'r' || doc_id AS summary, doc_id FROM documents)"
_key = lambda test, label: f"SELECT doc_id AS document_id, doc_id % 7 AS sequence, '{label}' AS label FROM documents WHERE {test}"
_STATUS = "CASE WHEN event_id % 50 <> 0 THEN [200, 200, 200, 404, 503, 429, 500, 201, 403, 418][event_id % 10 + 1] END"

_DELTA = r"""now AS (SELECT doc_id % 150 AS document_id, doc_id, CASE WHEN doc_id % 150 % 5 = 0 THEN 2 ELSE 1 END AS version_id, CASE WHEN doc_id % 150 % 5 = 0 THEN 'baru versi' || chr(10) || substr(text, 1, 200) ELSE text END AS chunk_text FROM documents WHERE doc_id % 150 % 7 <> 0 AND (doc_id % 150 % 5 <> 0 OR doc_id % 2 = 0)),
toks AS (SELECT version_id, doc_id, coalesce(regexp_extract_all(lower(chunk_text), '[\p{L}\p{N}_]+'), []) AS terms FROM now),
counts AS (SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest(terms) AS term FROM toks) GROUP BY 1)"""

ORACLES = {
    "snapshot_models": """WITH m AS (SELECT vec_id AS document_id, unnest(['one', 'two']) AS embedding_model, round(embedding[1]::DOUBLE, 4) AS first FROM embeddings)
SELECT *, CASE WHEN embedding_model = 'one' AND document_id % 3 = 0 THEN 'new' ELSE 'old' END AS label FROM m WHERE embedding_model = 'one' OR document_id % 7 <> 0""",
    "index_after_delta": f"WITH {_DELTA}\nSELECT version_id, count(*) AS document_nodes, count(*) AS retrieval_chunks, count(*) AS chunk_embeddings, (SELECT count(*) FROM toks) AS total_chunks, (SELECT count(*) FROM counts) AS vocabulary_size, (SELECT round(avg(len(terms)), 2) FROM toks) AS avg_chunk_length FROM toks GROUP BY 1",
    "terms_after_delta": f"WITH {_DELTA}\nSELECT * FROM counts",
    "listing_refs": f"WITH src AS (SELECT * FROM pages),\n{_LINKS}\nSELECT page_id, target AS detail_url, link_text AS title, CASE WHEN regexp_extract(link_text, '(?i)([A-Z]\\w{{3}})', 1) = '' THEN 'PAGE-UNKNOWN' ELSE regexp_extract(link_text, '(?i)([A-Z]\\w{{3}})', 1) END AS regulation_number FROM (SELECT *, row_number() OVER (PARTITION BY page_id, target ORDER BY position) AS n FROM targets WHERE contains(href, '/') AND NOT suffix(href, '.pdf') AND NOT suffix(lower(href), '/default.aspx') AND length(link_text) >= 5) WHERE n = 1",
    "first_seen_links": f"WITH src AS (SELECT * FROM pages),\n{_LINKS}\nSELECT page_id, position, target AS detail_url, link_text AS title FROM (SELECT *, row_number() OVER (PARTITION BY page_id, target ORDER BY position) AS n FROM targets WHERE contains(href, '/') AND NOT suffix(href, '.pdf') AND NOT suffix(lower(href), '/default.aspx')) WHERE n = 1 AND length(link_text) >= 4",
    "listing_limited": f"WITH src AS (SELECT * FROM pages),\n{_LINKS},\nonce AS (SELECT page_id, position, target FROM (SELECT *, row_number() OVER (PARTITION BY page_id, target ORDER BY position) AS n FROM targets WHERE contains(href, '/') AND NOT suffix(href, '.pdf') AND NOT suffix(lower(href), '/default.aspx') AND length(link_text) >= 5) WHERE n = 1)\nSELECT page_id, position, target AS detail_url FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY position) AS n FROM once) WHERE n <= 2",
    # What the made pages list, written out.
    "listing_central_bank": "SELECT page_id, x.position, x.detail_url, x.title, x.number AS regulation_number FROM (SELECT page_id, unnest([{'position': 0, 'detail_url': 'https://portal.example/id/peraturan/Pages/P' || page_id || '.aspx', 'title': 'PeraturanNo. ' || page_id || '/1/PBI/2021A & B', 'number': page_id || '/1/PBI/2021'}, {'position': 2, 'detail_url': 'https://portal.example/id/peraturan/Q' || page_id || '.aspx', 'title': 'PBI Q', 'number': 'PBI-UNKNOWN'}, {'position': 4, 'detail_url': 'https://portal.example/ID/PERATURAN/T.aspx', 'title': 'in a row ' || page_id, 'number': 'PBI-UNKNOWN'}] || CASE WHEN page_id % 2 = 0 THEN [{'position': 7, 'detail_url': 'https://portal.example/id/regulasi/list.aspx?peraturan=/peraturan/' || page_id || '#f', 'title': 'query link', 'number': 'PBI-UNKNOWN'}] ELSE [] END) AS x FROM pages)",
    "listing_authority": "SELECT page_id, x.position, x.detail_url, x.title, x.number AS regulation_number FROM (SELECT page_id, unnest([{'position': 1, 'detail_url': 'https://portal.example/id/regulasi/Pages/L' || page_id || '.aspx', 'title': 'hidden by a short title', 'number': 'POJK-UNKNOWN'}, {'position': 2, 'detail_url': 'https://portal.example/id/regulasi/Pages/POJK-' || page_id || '.aspx', 'title': 'Peraturan OJK Nomor 12/POJK.03/' || (2000 + page_id % 20), 'number': '12/POJK.03/' || (2000 + page_id % 20)}, {'position': 3, 'detail_url': 'https://portal.example/id/regulasi/Pages/I.aspx', 'title': 'Nomor' || page_id || '/POJK/2020', 'number': page_id || '/POJK/2020'}]) AS x FROM pages)",
    "detail_metadata": "SELECT page_id, 'Peraturan & ' || page_id AS title, CASE WHEN page_id % 3 = 0 THEN 'Dicabut' ELSE 'Berlaku' END AS status, try_cast('2021-' || CASE page_id % 4 WHEN 0 THEN '12' WHEN 1 THEN '02' WHEN 2 THEN '01' ELSE '05' END || '-' || lpad((1 + page_id % 31)::VARCHAR, 2, '0') AS DATE) AS published_date, NULL::DATE AS effective_date, 'Ringkasan' || page_id || 'tail' AS summary, 'Moneter dan Sistem Pembayaran' AS sector FROM pages",
    "detail_authority": "SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'listed' ELSE 'POJK ' || page_id END AS title, 'Berlaku' AS status, DATE '2020-02-02' AS published_date, NULL::DATE AS effective_date, 'Menetapkan <' || page_id || '>' AS summary, CASE page_id % 3 WHEN 0 THEN 'Perbankan' ELSE 'Asuransi' END AS sector FROM pages",
    "page_details": "SELECT page_id, coalesce(nullif(trim(replace(replace(replace(replace(regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1), '&quot;', '\"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')), ''), '-') AS title, 'Berlaku' AS status, NULL::VARCHAR AS summary FROM pages",
    "retry_plan": f"SELECT attempt, status, count(*) FILTER (again) AS retried, max(CASE WHEN again THEN pow(2, attempt - 1)::DOUBLE END) AS seconds FROM (SELECT attempt, status, attempt <= 3 AND (status IS NULL OR status IN {registry.RETRIED}) AS again FROM (SELECT unnest([1, 2, 3, 4]) AS attempt, {_STATUS} AS status FROM events)) GROUP BY ALL",
    "attachments": f"WITH src AS (SELECT page_id, url, replace({_DETAIL}, '=extra.PDF?x=1', '=\"extra.PDF?x=1\"') AS html FROM pages),\n{_LINKS}\nSELECT page_id, position, CASE WHEN contains(lower(link_text), 'faq') OR contains(lower(link_text), 'tanya') THEN 'faq' WHEN contains(lower(link_text), 'abstrak') OR contains(lower(link_text), 'ringkasan') THEN 'abstract' WHEN contains(lower(link_text), 'salinan') OR contains(lower(link_text), 'pojk') OR contains(lower(link_text), 'peraturan') THEN 'regulation' WHEN contains(lower(link_text), 'lampiran') THEN 'other' ELSE 'regulation' END AS document_type, target AS document_url, string_split(target, '/')[-1] AS filename FROM (SELECT *, row_number() OVER (PARTITION BY page_id, target ORDER BY position) AS n FROM targets WHERE contains(lower(href), '.pdf')) WHERE n = 1",
    "upsert_registry": f"WITH {_REGS},\nchanged AS (SELECT *, CASE WHEN doc_id % 9 = 0 THEN regulation_number || 'x' ELSE regulation_number END AS number FROM (SELECT *, unnest(range(1, CASE WHEN doc_id % 6 = 0 THEN 3 ELSE 2 END)) AS arrival FROM regs WHERE doc_id % 3 = 0)),\nn AS (SELECT source, regulation_type, number AS regulation_number, arg_max(title || ' baru ' || arrival, arrival) AS title, arg_max(detail_url, arrival) AS detail_url, arg_max('Dicabut', arrival) FILTER ((doc_id + arrival) % 2 = 0) AS status, arg_max('s2', arrival) FILTER (arrival = 2) AS summary FROM changed GROUP BY ALL)\nSELECT coalesce(n.source, o.source) AS source, coalesce(n.regulation_type, o.regulation_type) AS regulation_type, coalesce(n.regulation_number, o.regulation_number) AS regulation_number, CASE WHEN n.source IS NOT NULL THEN n.title ELSE o.title END AS title, CASE WHEN n.source IS NOT NULL THEN n.detail_url ELSE o.detail_url END AS detail_url, coalesce(n.status, o.status) AS status, coalesce(n.summary, o.summary) AS summary FROM regs o FULL JOIN n ON o.source = n.source AND o.regulation_type = n.regulation_type AND o.regulation_number = n.regulation_number",
    "insert_if_absent": f"WITH o AS ({_key('doc_id % 3 = 0', 'old')}), n AS ({_key('doc_id % 2 = 0', 'new')})\nSELECT * FROM o UNION ALL SELECT * FROM n WHERE document_id NOT IN (SELECT document_id FROM o)",
    "version_registry": f"WITH {_VERSIONS}\nSELECT * FROM versions",
    "version_pointers": f"WITH {_VERSIONS},\nlatest AS (SELECT document_id, sha256 FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY observed_at DESC, sha256 DESC) AS n FROM log) WHERE n = 1)\nSELECT l.document_id, l.sha256, l.sha256 <> v.sha256 AS differs FROM latest l JOIN versions v ON v.document_id = l.document_id AND v.is_current",
    "single_current_check": f"WITH {_VERSIONS}\nSELECT count(*) AS documents, count(*) FILTER (n <> 1) AS violations FROM (SELECT document_id, sum(is_current::INT) AS n FROM versions GROUP BY 1)",
    "replace_partition": f"WITH o AS ({_key('doc_id % 2 = 0', 'old')}), n AS ({_key('doc_id % 6 = 0 OR doc_id % 5 = 0', 'new')})\nSELECT * FROM o WHERE document_id NOT IN (SELECT document_id FROM n) UNION ALL SELECT * FROM n",
    "cascade_orphans": _key("doc_id % 4 <> 1", "child"),
    "request_metrics": """WITH per AS (SELECT 'event_type="' || event_type || '",bucket="' || (user_id % 3) || '"' AS labels, count(*) AS n, sum(value::DECIMAL(18,6))::DECIMAL(28,6) AS total FROM events GROUP BY event_type, user_id % 3),
rows AS (SELECT labels, 1 AS part, 'http_requests_total{' || labels || '} ' || n AS line FROM per UNION ALL SELECT labels, 2, 'http_request_duration_seconds_sum{' || labels || '} ' || total FROM per UNION ALL SELECT labels, 3, 'http_request_duration_seconds_count{' || labels || '} ' || n FROM per)
SELECT row_number() OVER (ORDER BY CASE WHEN part = 1 THEN 1 ELSE 2 END, labels, part) AS line_no, line FROM rows""",
    "current_chunks": f"WITH {_VERSIONS}\nSELECT chunk_id, c.document_id, c.sha256, source FROM (SELECT doc_id AS chunk_id, doc_id % 150 AS document_id, ['click', 'error', 'purchase', 'signup', 'view'][doc_id % 5 + 1] AS sha256, source FROM documents) c JOIN versions v ON v.document_id = c.document_id AND v.sha256 = c.sha256 AND v.is_current",
    "storage_paths": "SELECT doc_id, 'raw/' || upper(source) || '/' || upper(lang) || '/' || doc_id || '/' || sha256(text) || '.pdf' AS path FROM documents",
    "metadata_json": f"WITH {_REGS}\nSELECT regulation_number, json_object('source', source, 'regulation_type', regulation_type, 'regulation_number', regulation_number, 'title', title)::VARCHAR AS metadata FROM regs",
    "metadata_artifacts": f"WITH {_REGS}\nSELECT 'meta/' || upper(source) || '/' || upper(regulation_type) || '/' || regulation_number || '.json' AS path, json_object('regulation_id', regulation_number, 'metadata', json_object({', '.join(f"'{c}', {c}" for c in _META)}), 'extra_info', json_object())::VARCHAR AS artifact FROM regs",
    "ingestion_summary": f"SELECT count(*) AS discovered, count(*) FILTER (event_id % 9 <> 0) AS metadata_parsed, sum(CASE WHEN event_id % 3 = 0 THEN event_id % 4 ELSE 0 END)::BIGINT AS documents_found, count(*) FILTER (status BETWEEN 200 AND 299 AND NOT known) AS downloaded, count(*) FILTER (status BETWEEN 200 AND 299 AND NOT known) AS new_versions, count(*) FILTER (status BETWEEN 200 AND 299 AND known) AS skipped, count(*) FILTER (status IS NULL OR status IN {registry.RETRIED}) AS retryable, count(*) FILTER (status IS NOT NULL AND status NOT BETWEEN 200 AND 299 AND status NOT IN {registry.RETRIED}) AS failed, count(*) FILTER (status BETWEEN 200 AND 299 AND user_id % 4 = 0) AS not_pdf FROM (SELECT {_STATUS} AS status, user_id % 3 = 0 AS known, user_id, event_id FROM events)",
}
ORACLES["snapshot_replace"] = ORACLES["replace_partition"]
ORACLES["version_stream"] = ORACLES["version_registry"]
