"""Document-pipeline queries on the lines of documents, decorated with structural markers by their position."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions import text as t
from lexloom.operators import chunk, normalize, structure
from lexloom.plans.retrieval import CHUNKS, chunks, read

#: The decoration, the same words for both engines.
_DECORATED = """CASE WHEN pos % 40 = 20 THEN 'PERATURAN NOMOR ' || doc_id
 WHEN pos % 40 = 0 AND pos > 0 THEN 'BAB ' || substr('IVXLCDM', CAST(1 + pos / 40 % 7 AS INT), 1)
 WHEN pos % 40 = 3 THEN 'Bagian Kesatu' WHEN pos % 40 = 5 THEN 'Paragraf ' || CAST(1 + FLOOR(pos / 40) AS INT) || ' x'
 WHEN pos % 10 = 7 THEN 'Pasal ' || CAST(1 + FLOOR(pos / 10) AS INT)
 WHEN pos % 20 = 8 THEN '(' || CAST(1 + pos % 3 AS INT) || ') ' || line
 WHEN pos % 5 = 1 AND pos > 5 THEN substr('abcdefghijklmnopqrstuvwxyz', CAST(1 + pos % 26 AS INT), 1) || '. ' || line
 WHEN pos % 10 = 2 THEN CAST(1 + pos % 9 AS INT) || ') ' || line
 WHEN pos = 1 AND doc_id % 3 = 0 THEN 'Menimbang : ' || line WHEN pos = 4 AND doc_id % 3 = 1 THEN 'MEMUTUSKAN: ' || line
 WHEN pos % 30 = 29 THEN 'Ditetapkan di ' || line WHEN pos % 7 = 4 OR pos % 50 = 25 THEN line || '-' ELSE line END"""


def lines(spark: SparkSession, d: str) -> DataFrame:
    raw = read(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return raw.select(F.col("doc_id").alias("document_id"), (F.floor(F.col("pos") / 20) + 1).alias("page_num"), F.floor(F.col("pos") / 5).alias("block_num"), "pos", F.expr(_DECORATED.replace("pos / 40 % 7", "FLOOR(pos / 40) % 7")).alias("text"), F.when(F.col("pos") % 20 == 0, 50).otherwise(100).alias("y0"), F.when(F.col("pos") % 20 == 0, 60).otherwise(110).alias("y1"))


def _norm(s, d):
    return normalize.normalize(lines(s, d))


def _tree(s, d):
    return structure.nodes(_norm(s, d))


def _leaves(s, d):
    about = read(s, d, "documents").select(F.col("doc_id").alias("document_id"), "source", F.col("lang").alias("regulation_type"), F.col("doc_id").cast("string").alias("regulation_number"), F.concat(F.lit("Judul "), F.col("doc_id").cast("string")).alias("regulation_title"))
    return _tree(s, d).join(about, "document_id")


def _chunks(s, d):
    return chunk.chunks(_leaves(s, d))


# ----------------------------------------------------------------------------------------------------------- SQL

LINES = f"""raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS pos FROM documents),
lines AS (SELECT doc_id AS document_id, pos // 20 + 1 AS page_num, pos // 5 AS block_num, pos, {_DECORATED.replace("pos / 40 % 7", "FLOOR(pos / 40) % 7")} AS text, CASE WHEN pos % 20 = 0 THEN 50 ELSE 100 END AS y0, CASE WHEN pos % 20 = 0 THEN 60 ELSE 110 END AS y1 FROM raw)"""
_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
MARGINS = f"""bare AS (SELECT * REPLACE ({_STRIP.format("text")} AS text) FROM lines),
margins AS (SELECT document_id, text, count(*) AS n FROM bare WHERE page_num > 1 AND length(text) < 120 AND (y0 < 80 OR y1 > 700) GROUP BY ALL HAVING count(*) >= 2)"""
KEPT = rf"""kept AS (SELECT document_id, page_num, row_number() OVER (PARTITION BY document_id ORDER BY page_num, block_num, pos) AS line_num, text, regexp_matches(text, '(?i){normalize.BOUNDARY}') AS is_boundary
  FROM bare WHERE text <> '' AND NOT (page_num > 1 AND EXISTS (SELECT 1 FROM margins m WHERE m.document_id = bare.document_id AND m.text = bare.text)))"""
HYPHENS = """able AS (SELECT *, lead(text) OVER w AS nxt, suffix(text, '-') AND length(text) > 1 AND NOT is_boundary AND NOT coalesce(lead(is_boundary) OVER w, true) AS able FROM kept WINDOW w AS (PARTITION BY document_id ORDER BY line_num)),
runs AS (SELECT *, sum(CASE WHEN able THEN 0 ELSE 1 END) OVER (PARTITION BY document_id ORDER BY line_num) AS run FROM able),
joins AS (SELECT *, able AND sum(able::INT) OVER (PARTITION BY document_id, run ORDER BY line_num) % 2 = 1 AS joins FROM runs),
norm AS (SELECT document_id, page_num, line_num, CASE WHEN joins THEN left(text, length(text) - 1) || nxt ELSE text END AS text, is_boundary FROM (SELECT *, coalesce(lag(joins) OVER (PARTITION BY document_id ORDER BY line_num), false) AS taken FROM joins) WHERE NOT taken)"""
_KIND = "CASE " + " ".join(f"WHEN regexp_matches(text, '(?i){p}') THEN '{n}'" for n, p, _ in structure.MARKERS) + " ELSE 'default' END"
_IN = lambda names: "(" + ", ".join(f"'{n}'" for n in names) + ")"
_UPTO = "OVER (PARTITION BY document_id ORDER BY line_num ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_BEFORE = "OVER (PARTITION BY document_id ORDER BY line_num ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_INSIDE = "OVER (PARTITION BY document_id, article ORDER BY line_num ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_last = lambda test, value, w=_UPTO: f"last_value(CASE WHEN {test} THEN {value} END IGNORE NULLS) {w}"
STATES = f"""k0 AS (SELECT *, {_KIND} AS kind FROM norm),
k1 AS (SELECT *, {_last(f"kind IN {_IN(structure.ENDS_TITLE)}", "kind", _BEFORE)} AS marker, row_number() OVER (PARTITION BY document_id ORDER BY line_num) = 1 AS first_line, {_last(f"kind IN {_IN(structure.TITLED)}", "line_num")} AS title_line,
  {_last("kind = 'chapter'", "line_num")} AS chapter, {_last("kind IN ('chapter', 'part')", "{'l': line_num, 'k': kind}")} AS p_top, {_last(f"kind IN {_IN(structure.TITLED)}", "{'l': line_num, 'k': kind}")} AS s_top, {_last(f"kind IN {_IN((*structure.TITLED, 'article'))}", "{'l': line_num, 'k': kind}")} AS a_top FROM k0),
k2 AS (SELECT * REPLACE (CASE WHEN kind IN ('paragraph', 'letter', 'numbered_item') AND (a_top IS NULL OR a_top.k <> 'article') THEN CASE WHEN first_line THEN 'preamble' ELSE 'default' END WHEN first_line AND kind = 'default' THEN 'preamble' ELSE kind END AS kind),
  kind NOT IN {_IN(structure.ENDS_TITLE)} AND coalesce(marker IN {_IN(structure.TITLED)}, false) AS swallowed, CASE WHEN p_top.k = 'part' THEN p_top.l END AS part, CASE WHEN s_top.k = 'section' THEN s_top.l END AS section, CASE WHEN a_top.k = 'article' THEN a_top.l END AS article FROM k1),
k3 AS (SELECT *, NOT swallowed AND article IS NOT NULL AS live, NOT swallowed AND article IS NOT NULL AND kind IN ('paragraph', 'letter', 'default') AS turn FROM k2),
k4 AS (SELECT *, turn AND kind = 'default' AND sum(turn::INT) {_INSIDE} = 1 AS implicit FROM k3),
k5 AS (SELECT *, CASE WHEN article IS NOT NULL THEN {_last("live AND (kind = 'paragraph' OR implicit)", "line_num", _INSIDE)} END AS paragraph, {_last("live AND kind IN ('paragraph', 'letter')", "{'l': line_num, 'k': kind}", _INSIDE)} AS low,
  NOT swallowed AND (kind IN ('chapter', 'consideration', 'legal_basis', 'decision', 'closing', 'preamble') OR kind = 'part' AND chapter IS NULL OR kind = 'section' AND part IS NULL AND chapter IS NULL OR kind = 'article' AND section IS NULL AND part IS NULL AND chapter IS NULL) AS is_root FROM k4),
k6 AS (SELECT *, CASE WHEN article IS NOT NULL AND low.k = 'letter' THEN low.l END AS letter, {_last("is_root", "line_num")} AS last_root, NOT swallowed AND (kind <> 'default' OR implicit) AS makes FROM k5),
st AS (SELECT *, CASE WHEN swallowed THEN title_line WHEN makes THEN line_num ELSE coalesce(letter, paragraph, last_root) END AS target FROM k6)"""
_G = {n: p for n, p, _ in structure.MARKERS}
_grp = lambda n, g: f"regexp_extract(text, '(?i){_G[n]}', {g})"
NODES = f"""num AS (SELECT *, CASE kind WHEN 'chapter' THEN upper({_grp("chapter", 1)}) WHEN 'part' THEN {_STRIP.format(_grp("part", 1))} WHEN 'section' THEN {_grp("section", 1)} WHEN 'article' THEN upper({_grp("article", 1)}) WHEN 'paragraph' THEN {_grp("paragraph", 1)} WHEN 'letter' THEN lower({_grp("letter", 1)}) WHEN 'numbered_item' THEN {_grp("numbered_item", 1)} END AS node_number,
  CASE WHEN kind IN ('chapter', 'part', 'section', 'article') THEN '' WHEN kind IN ('preamble', 'closing') OR implicit THEN text {" ".join(f"WHEN kind = '{n}' THEN {_STRIP.format(_grp(n, g))}" for n, _, g in structure.MARKERS if g)} ELSE '' END AS head FROM st),
rest AS (SELECT document_id, target AS line_num, string_agg(text, ' ' ORDER BY line_num) FILTER (swallowed) AS titles, list(text ORDER BY line_num) FILTER (NOT makes AND NOT swallowed) AS said, last(page_num ORDER BY line_num) FILTER (NOT swallowed) AS end_page FROM num GROUP BY ALL),
made AS (SELECT n.*, r.titles, r.said, r.end_page, row_number() OVER (PARTITION BY n.document_id ORDER BY n.line_num) AS sequence,
  CASE WHEN kind = 'chapter' THEN 'BAB ' || node_number WHEN kind = 'part' THEN 'Bagian ' || node_number WHEN kind = 'section' THEN 'Paragraf ' || node_number WHEN kind = 'article' THEN 'Pasal ' || node_number WHEN implicit THEN 'Ayat (1)' WHEN kind = 'paragraph' THEN 'Ayat (' || node_number || ')' WHEN kind = 'letter' THEN 'Huruf ' || node_number WHEN kind = 'numbered_item' THEN node_number || '.' WHEN kind = 'consideration' THEN 'Menimbang' WHEN kind = 'legal_basis' THEN 'Mengingat' WHEN kind = 'decision' THEN 'MEMUTUSKAN' WHEN kind = 'closing' THEN 'KETENTUAN PENUTUP' ELSE 'PREAMBLE' END AS piece,
  list_filter(CASE WHEN implicit OR kind = 'paragraph' THEN [chapter, part, section, article] WHEN kind = 'part' THEN [chapter] WHEN kind = 'section' THEN [chapter, part] WHEN kind = 'article' THEN [chapter, part, section] WHEN kind = 'letter' THEN [chapter, part, section, article, paragraph] WHEN kind = 'numbered_item' THEN [chapter, part, section, article, paragraph, letter] ELSE [] END, lambda x: x IS NOT NULL) AS above
  FROM num n JOIN rest r ON n.document_id = r.document_id AND n.line_num = r.line_num WHERE makes),
ups AS (SELECT document_id, line_num, list(sequence ORDER BY i) AS seqs, string_agg(piece, '/' ORDER BY i) AS up_path FROM (SELECT e.document_id, e.line_num, e.i, m.sequence, m.piece FROM (SELECT document_id, line_num, unnest(above) AS up, unnest(range(0, len(above))) AS i FROM made) e JOIN made m ON m.document_id = e.document_id AND m.line_num = e.up) GROUP BY ALL),
placed AS (SELECT m.*, list_append(coalesce(u.seqs, []), m.sequence) AS ancestors, CASE WHEN up_path IS NULL THEN piece ELSE up_path || '/' || piece END AS path FROM made m LEFT JOIN ups u ON m.document_id = u.document_id AND m.line_num = u.line_num),
spans AS (SELECT document_id, anc AS sequence, min(page_num) AS page_start, max(end_page) AS page_end FROM (SELECT document_id, page_num, end_page, unnest(ancestors) AS anc FROM placed p WHERE NOT EXISTS (SELECT 1 FROM placed q WHERE q.document_id = p.document_id AND q.ancestors[-2] = p.sequence)) GROUP BY ALL),
nodes AS (SELECT p.document_id, p.sequence, ancestors[-2] AS parent_sequence, ancestors, CASE WHEN implicit THEN 'paragraph' ELSE kind END AS node_type, node_number,
  CASE WHEN kind = 'chapter' THEN coalesce(titles, 'BAB ' || node_number) WHEN kind = 'part' THEN coalesce(titles, 'Bagian ' || node_number) WHEN kind = 'section' THEN coalesce(titles, 'Paragraf ' || node_number) WHEN kind = 'consideration' THEN 'Menimbang' WHEN kind = 'legal_basis' THEN 'Mengingat' WHEN kind = 'decision' THEN 'MEMUTUSKAN:' WHEN kind = 'closing' THEN 'KETENTUAN PENUTUP' WHEN kind = 'preamble' THEN text END AS title,
  array_to_string(list_filter(list_prepend(head, coalesce(said, [])), lambda x: x <> ''), chr(10)) AS text, s.page_start, s.page_end, path FROM placed p JOIN spans s ON p.document_id = s.document_id AND p.sequence = s.sequence)"""
TREE = ",\n".join([LINES, MARGINS, KEPT, HYPHENS, STATES, NODES])
_LEAF = _IN(structure.LEAVES)
_cut = lambda p: f"length(regexp_extract(left(rest, 1500), '(?s)^(.*{p})', 1))"
CUT = "CASE " + " ".join(f"WHEN {_cut(p)} > 0 THEN {_cut(p)}" for p in chunk.CUTS) + " ELSE 1500 END"


def parts_sql(source: str, keys: str) -> str:
    """Recursive splitting of `source` (keys, whole)."""
    return f"""RECURSIVE_PARTS cut AS (SELECT {keys}, 1 AS part_index, CASE WHEN length(rest) <= 1500 THEN rest ELSE left(rest, {CUT}) END AS chunk_text, CASE WHEN length(rest) <= 1500 THEN '' ELSE substr(rest, {CUT} + 1) END AS rest FROM (SELECT {keys}, whole AS rest FROM {source}) WHERE rest <> ''
  UNION ALL SELECT {keys}, part_index + 1, CASE WHEN length(rest) <= 1500 THEN rest ELSE left(rest, {CUT}) END, CASE WHEN length(rest) <= 1500 THEN '' ELSE substr(rest, {CUT} + 1) END FROM cut WHERE rest <> '')""".replace("RECURSIVE_PARTS ", "")


_WORDS = r"len(list_filter(regexp_split_to_array({0}, '[\s\x{{0085}}\x{{00A0}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{3000}}]+'), lambda w: w <> ''))"
CHUNKED = f"""leaves AS (SELECT document_id, sequence, {_STRIP.format("text")} AS whole FROM nodes WHERE node_type IN {_LEAF}),
{parts_sql("leaves", "document_id, sequence")},
made_chunks AS (SELECT *, CASE WHEN total_parts > 1 THEN path || ' [Part ' || part_index || '/' || total_parts || ']' ELSE path END AS structural_path, row_number() OVER (PARTITION BY document_id ORDER BY ancestors, part_index) AS chunk_sequence FROM (
  SELECT c.*, n.ancestors, n.path, n.page_start, n.page_end, n.node_type, count(*) OVER (PARTITION BY c.document_id, c.sequence) AS total_parts FROM cut c JOIN nodes n ON c.document_id = n.document_id AND c.sequence = n.sequence)),
hashed AS (SELECT *, length(chunk_text) AS character_count, sha256(document_id || ':' || sequence || ':' || structural_path || ':' || part_index || ':' || chunk_text) AS chunk_hash FROM made_chunks)"""
_CONTEXT = {"chapter": ("title", "chapter_title"), "part": ("title", "part_title"), "section": ("title", "section_title"), "article": ("node_number", "article_number"), "paragraph": ("node_number", "paragraph_number"), "letter": ("node_number", "letter_code"), "numbered_item": ("node_number", "numbered_item")}

QUERIES = {
    "repeated_lines": lambda s, d: normalize.repeated_margins(lines(s, d)),
    "lines_without_headers": lambda s, d: normalize.without_margins(lines(s, d)).select("document_id", "line_num", "page_num", F.sha2("text", 256).alias("digest")),
    "hyphen_repair": lambda s, d: _norm(s, d).select("document_id", "line_num", "page_num", "text"),
    "boundary_markers": lambda s, d: lines(s, d).filter(normalize.is_boundary("text")).select("document_id", "pos", structure.kind_of(t.strip("text")).alias("kind")),
    "structure_nodes": lambda s, d: _tree(s, d).select("document_id", "sequence", "parent_sequence", "node_type", "node_number", "title", "text", "path"),
    "page_spans": lambda s, d: _tree(s, d).select("document_id", "sequence", "page_start", "page_end"),
    "node_histogram": lambda s, d: _tree(s, d).groupBy("node_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars")),
    "parse_coverage": lambda s, d: structure.coverage(_norm(s, d), _tree(s, d)),
    "dfs_order": lambda s, d: _tree(s, d).select("document_id", "sequence", F.row_number().over(_dfs()).alias("position")),
    "context_columns": lambda s, d: chunk.with_context(_tree(s, d).filter(F.col("node_type").isin(*structure.LEAVES) | True)).filter(F.col("node_type").isin(*structure.LEAVES)).select("document_id", "sequence", *[n for _, n in _CONTEXT.values()]),
    "chunk_split": lambda s, d: read(s, d, "documents").select("doc_id", F.posexplode(chunk.split("text")).alias("part", "chunk_text")).select("doc_id", (F.col("part") + 1).alias("part_index"), "chunk_text"),
    "chunk_rows": lambda s, d: _chunks(s, d).select("document_id", "chunk_sequence", "sequence", "part_index", "total_parts", "structural_path", "character_count", "word_count", "page_start", "page_end"),
    "chunk_hash": lambda s, d: _chunks(s, d).select("document_id", "chunk_sequence", "chunk_hash", F.sha2("contextual_text", 256).alias("context_digest")),
    "chunk_validate": lambda s, d: chunk.validate_parts(chunk.parts_of_leaves(_leaves(s, d))),
    "chunk_path_histogram": lambda s, d: _chunks(s, d).groupBy(F.element_at(F.split("structural_path", "/"), -1).alias("last_segment")).agg(F.count(F.lit(1)).alias("n")),
}


def _dfs():
    from pyspark.sql import Window

    return Window.partitionBy("document_id").orderBy("ancestors")


_w = lambda parts, select, rec="": f"WITH {rec}{parts}\n{select}"

ORACLES = {
    "repeated_lines": _w(f"{LINES},\n{MARGINS}", "SELECT * FROM margins"),
    "lines_without_headers": _w(f"{LINES},\n{MARGINS},\n{KEPT}", "SELECT document_id, line_num, page_num, sha256(text) AS digest FROM kept"),
    "hyphen_repair": _w(f"{LINES},\n{MARGINS},\n{KEPT},\n{HYPHENS}", "SELECT document_id, line_num, page_num, text FROM norm"),
    "boundary_markers": _w(f"{LINES},\n{MARGINS}", f"SELECT document_id, pos, {_KIND} AS kind FROM bare WHERE regexp_matches(text, '(?i){normalize.BOUNDARY}')"),
    "structure_nodes": _w(TREE, "SELECT document_id, sequence, parent_sequence, node_type, node_number, title, text, path FROM nodes"),
    "page_spans": _w(TREE, "SELECT document_id, sequence, page_start, page_end FROM nodes"),
    "node_histogram": _w(TREE, "SELECT node_type, count(*) AS n, sum(length(text))::BIGINT AS chars FROM nodes GROUP BY node_type"),
    "parse_coverage": _w(TREE, f"SELECT document_id, extracted_chars, structured_chars, least(1.0, round(structured_chars / extracted_chars, 4))::DOUBLE AS coverage_ratio, greatest(0, extracted_chars - structured_chars) AS unparsed_chars, least(1.0, round(structured_chars / extracted_chars, 4)) >= {structure.LEAST_COVERAGE} AS is_valid FROM (SELECT document_id, e::BIGINT AS extracted_chars, coalesce(k, 0)::BIGINT AS structured_chars FROM (SELECT document_id, sum(length(text)) AS e FROM norm GROUP BY 1) LEFT JOIN (SELECT document_id, sum(length(text)) AS k FROM nodes WHERE node_type IN {_LEAF} GROUP BY 1) USING (document_id))"),
    "dfs_order": _w(TREE, "SELECT document_id, sequence, row_number() OVER (PARTITION BY document_id ORDER BY ancestors) AS position FROM nodes"),
    "context_columns": _w(TREE, "SELECT n.document_id, n.sequence, " + ", ".join(f"max(CASE WHEN a.node_type = '{k}' THEN a.{v} END) AS {name}" for k, (v, name) in _CONTEXT.items()) + f" FROM nodes n LEFT JOIN nodes a ON a.document_id = n.document_id AND list_contains(n.ancestors, a.sequence) WHERE n.node_type IN {_LEAF} GROUP BY ALL"),
    "chunk_split": _w(f"src AS (SELECT doc_id, text AS whole FROM documents),\n{parts_sql('src', 'doc_id')}", "SELECT doc_id, part_index, chunk_text FROM cut", "RECURSIVE "),
    "chunk_rows": _w(f"{TREE},\n{CHUNKED}", f"SELECT document_id, chunk_sequence, sequence, part_index, total_parts, structural_path, character_count, {_WORDS.format('chunk_text')} AS word_count, page_start, page_end FROM hashed", "RECURSIVE "),
    "chunk_hash": _w(f"{TREE},\n{CHUNKED}", "SELECT document_id, chunk_sequence, chunk_hash, sha256('[' || source || ' - ' || lang || ' No. ' || doc_id || '] Judul ' || doc_id || chr(10) || 'Hierarki: ' || structural_path || chr(10) || 'Halaman: ' || page_start || ' - ' || page_end || chr(10) || chr(10) || chunk_text) AS context_digest FROM hashed JOIN documents ON document_id = doc_id", "RECURSIVE "),
    "chunk_validate": _w(
        f"{TREE},\n{CHUNKED}",
        f"SELECT document_id, leaf_chars, total_chunks, chunked_chars, min_size, max_size, avg_size, blank_chunks, duplicate_hashes, missing_nodes, CASE WHEN leaf_chars = 0 AND coalesce(chunked_chars, 0) = 0 THEN 1.0::DOUBLE WHEN leaf_chars = 0 THEN 0.0::DOUBLE ELSE round(coalesce(chunked_chars, 0) / leaf_chars, 4)::DOUBLE END AS coverage, coalesce(coalesce(chunked_chars, 0) = leaf_chars AND coalesce(blank_chunks, 0) = 0 AND coalesce(duplicate_hashes, 0) = 0 AND coalesce(missing_nodes, 0) = 0 AND ordered, false) AS is_valid FROM (SELECT document_id, sum(length({_STRIP.format('text')}))::BIGINT AS leaf_chars FROM nodes WHERE node_type IN {_LEAF} GROUP BY 1) LEFT JOIN (SELECT document_id, count(*) AS total_chunks, sum(character_count)::BIGINT AS chunked_chars, min(character_count) AS min_size, max(character_count) AS max_size, round(avg(character_count), 2) AS avg_size, count(*) FILTER ({_STRIP.format('chunk_text')} = '') AS blank_chunks, count(*) - count(DISTINCT chunk_hash) AS duplicate_hashes, count(*) FILTER (sequence IS NULL) AS missing_nodes, min(chunk_sequence) = 1 AND max(chunk_sequence) = count(*) AS ordered FROM hashed GROUP BY 1) USING (document_id)",
        "RECURSIVE ",
    ),
    "chunk_path_histogram": _w(f"{TREE},\n{CHUNKED}", "SELECT string_split(structural_path, '/')[-1] AS last_segment, count(*) AS n FROM hashed GROUP BY 1", "RECURSIVE "),
}
