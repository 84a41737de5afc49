"""The operators' queries, opN_<name>: each over its whole table, with the columns of its contract."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm import chat, decontaminate, html, langid, licenses, media, packing, repeats, simhash, spelling, toxicity, vectors, warc
from lexloom.llm.common import in_fold, table


def op1_host_suffix_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7, whose texts hold the template's own control strings."""
    said = "\\### Assistant: </turn> ok"
    probe = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.round_trip(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe))


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_table(table(spark, sf_dir, "documents"))


def op4_suffix_array_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_bigru_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", in_fold(F.col("doc_id"), 5, 0).alias("held_out"), "score", "predicted")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: their directory is the first 1 + doc_id mod 3 parts of source, language and hundred of the id."""
    docs = table(spark, sf_dir, "documents")
    parts = F.array(F.coalesce("source", F.lit("-")), F.coalesce("lang", F.lit("-")), F.floor(F.col("doc_id") / 100).cast("string"))
    name = F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))
    path = F.concat_ws("/", F.concat(F.slice(parts, F.lit(1), (F.pmod("doc_id", F.lit(3)) + 1).cast("int")), F.array(name)))
    return licenses.scan(docs.select("doc_id", path.alias("path"), "text"))


def op9_byte_cnn_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.predict(docs, langid.train(docs))
    return found.select("doc_id", in_fold(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score")


def op10_warc_chunk_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages"))


def op11_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


def op12_vector_code_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.compress(table(spark, sf_dir, "embeddings"))


def op13_spelling_variant_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_host_suffix_html, op2_chat_formatting, op3_media_columns, op4_suffix_array_decontamination, op5_bigru_toxicity, op6_best_fit_packing, op7_simhash_near_dedup, op8_license_scan, op9_byte_cnn_language_id, op10_warc_chunk_table, op11_suffix_array_dedup, op12_vector_code_compression, op13_spelling_variant_grouping)}

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_GRID = "unnest(range(0, greatest(1, len(w) - 9)))"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

_REPEATS = """WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, strlen(coalesce(text, '')) AS n FROM documents), w AS (SELECT doc_id, p, md5(b[p + 1 : p + 100]) AS h FROM (SELECT doc_id, b, unnest(range(0, n - 99)) AS p FROM d)),
r AS (SELECT doc_id, p FROM w QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id, p) > 1),
e AS (SELECT doc_id, p, coalesce(p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) > 100, true) AS new FROM r), g AS (SELECT doc_id, p, count(*) FILTER (new) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM e),
s AS (SELECT doc_id, k, min(p) AS a, max(p) + 100 AS z FROM g GROUP BY ALL), sums AS (SELECT doc_id, sum(z - a)::BIGINT AS n_removed, count(*) AS n_spans FROM s GROUP BY 1),
c AS (SELECT doc_id, lag(z, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS x, a AS y FROM s UNION ALL SELECT doc_id, coalesce(z, 0), n FROM d LEFT JOIN (SELECT doc_id, max(z) AS z FROM s GROUP BY 1) USING (doc_id)),
kept AS (SELECT doc_id, sha256(unhex(string_agg(hex(b[x + 1 : y]), '' ORDER BY x))) AS kept_sha256 FROM c JOIN d USING (doc_id) GROUP BY 1)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, kept_sha256 FROM d LEFT JOIN sums USING (doc_id) JOIN kept USING (doc_id)"""


def _codes_sql(rounds: int = 4) -> str:
    """Codebooks and their rounds as one chain of tables; whole numbers stay exact in doubles here."""
    near = "SELECT vec_id, j, q, min_by(e, ({n2} - 2 * list_dot_product(q, c) + list_dot_product(c, c), e)) AS e, min({n2} - 2 * list_dot_product(q, c) + list_dot_product(c, c)) AS far FROM p JOIN c{i} USING (j) GROUP BY vec_id, j, q"
    chain = [
        "k AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        "p AS MATERIALIZED (SELECT vec_id, j, v[j * len(v) // 4 + 1 : (j + 1) * len(v) // 4] AS q FROM (SELECT vec_id, v, unnest(range(0, 4)) AS j FROM k))",
        "c0 AS MATERIALIZED (SELECT j, row_number() OVER (PARTITION BY j ORDER BY vec_id) - 1 AS e, q AS c FROM p QUALIFY e < 256)",
    ]
    for i in range(rounds + 1):
        chain.append(f"a{i} AS MATERIALIZED ({near.format(i=i, n2='list_dot_product(q, q)')})")
        if i < rounds:
            chain.append(f"m{i} AS (SELECT j, e, list(floor(s / n) ORDER BY d) AS c FROM (SELECT j, e, d, sum(x) AS s, count(*) AS n FROM (SELECT j, e, unnest(q) AS x, unnest(range(0, len(q))) AS d FROM a{i}) GROUP BY j, e, d) GROUP BY j, e)")
            chain.append(f"c{i + 1} AS MATERIALIZED (SELECT j, e, coalesce(m.c, o.c) AS c FROM c{i} AS o LEFT JOIN m{i} AS m USING (j, e))")
    chain.append(f"r AS (SELECT vec_id, string_agg(lower(lpad(to_hex(e), 2, '0')), '' ORDER BY j) AS code, sum(far)::BIGINT AS error FROM a{rounds} GROUP BY 1)")
    chain.append(f"h AS (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda x: x::BIGINT::VARCHAR), ','), ',' ORDER BY j, e)) AS codebooks_sha256 FROM c{rounds})")
    return f"WITH {', '.join(chain)} SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM r JOIN k USING (vec_id), h"


#: The checksum is the usual one of reflected polynomial 0xEDB88320, by a table that a rule makes; near words are those that share what a deletion leaves.
_SPELLINGS = r"""WITH t AS MATERIALIZED (SELECT list(c ORDER BY i) AS tbl FROM (SELECT i, list_reduce(list_prepend(i, range(0, 8)), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(0, 256) AS r(i))),
u AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents),
b AS (SELECT run, count(*) AS times, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM u GROUP BY doc_id, run),
h AS (SELECT run, times, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, len(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)), lambda c, v: xor(c >> 8, tbl[(xor(c, v) & 255) + 1])), 4294967295) AS h FROM b, t),
r AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, times FROM h),
k AS MATERIALIZED (SELECT word, sum(times)::BIGINT AS n FROM r WHERE length(word) >= 5 GROUP BY 1 HAVING sum(times) >= 3),
d AS MATERIALIZED (SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS less FROM (SELECT word, unnest(range(0, length(word))) AS i FROM k)),
p AS (SELECT x.word AS a, y.word AS b FROM d AS x JOIN d AS y USING (i, less) WHERE x.word <> y.word UNION SELECT d.word, k.word FROM d JOIN k ON less = k.word UNION SELECT k.word, d.word FROM d JOIN k ON less = k.word),
f AS (SELECT a, count(*) AS n_near, arg_min(b, (-m, b)) AS b, max(m) AS m FROM (SELECT a, b, n AS m FROM p JOIN k ON b = word) GROUP BY 1),
w AS MATERIALIZED (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * n THEN b END AS form, CASE WHEN m >= 2 * n THEN m END AS form_n FROM k LEFT JOIN f ON a = word),
up(word, root, onward) AS (WITH RECURSIVE g(word, root, onward) AS (SELECT word, word, form FROM w UNION ALL SELECT g.word, w.word, w.form FROM g JOIN w ON w.word = g.onward) SELECT * FROM g WHERE onward IS NULL)
SELECT word, form, root, n, n_near, form_n FROM w JOIN up USING (word)"""


#: Where SQL can express an operator. That of op1 reads the markup of the tables at hand, not any page.
ORACLES: dict[str, str] = {
    "op1_host_suffix_html": r"""WITH b AS (SELECT page_id, url, unnest(x) AS block, unnest(range(0, len(x))) AS i FROM (SELECT page_id, url, regexp_split_to_array(regexp_extract(html, '(?s)<article>(.*?)(?:</article>|$)', 1), '</?(?:p|h1)>') AS x FROM pages)),
t AS (SELECT page_id, url, i, trim(regexp_replace(replace(replace(replace(replace(regexp_replace(block, '<[^>]*>', '', 'g'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\s+', ' ', 'g')) AS block FROM b),
p AS (SELECT page_id, url, coalesce(string_agg(block, chr(10) ORDER BY i) FILTER (block <> ''), '') AS text FROM t GROUP BY ALL),
o AS (SELECT page_id, url, regexp_replace(regexp_replace(html, '(?s)<head>.*?</head>|<script>.*?</script>|<!--.*?-->|<article>.*?(</article>|$)|<[^>]*>', ' ', 'g'), '&quot;|&lt;|&gt;|&amp;|&copy;|&middot;', '.', 'g') AS rest FROM pages),
w AS (SELECT page_id, lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host, list_filter(regexp_split_to_array(translate(rest, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x20]+'), lambda x: x <> '') AS tokens FROM o),
g AS (SELECT page_id, host, len(tokens) AS n, unnest(range(0, greatest(1, len(tokens) - 9))) AS i, tokens FROM w WHERE len(tokens) > 0),
v AS (SELECT page_id, host, n, i, tokens[i + 1 : i + 10] AS win, hash(text, tokens) AS sign FROM g JOIN p USING (page_id)),
s AS (SELECT host, win FROM v GROUP BY ALL HAVING min(sign) <> max(sign)),
c AS (SELECT page_id, count(DISTINCT k) AS n_repeated FROM (SELECT page_id, unnest(range(i, least(i + 10, n))) AS k FROM v JOIN s USING (host, win)) GROUP BY 1)
SELECT page_id, url, text, length(text) AS n_chars, coalesce(n_repeated, 0) AS n_repeated FROM p LEFT JOIN c USING (page_id)""",
    "op2_chat_formatting": r"""WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256, coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
 sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(length('### ' || role || ':') + 1 + length(text) + len(regexp_extract_all(text, '### [A-Za-z0-9_.~%-]*:|</turn>')) + length('</turn>') + 2)::BIGINT AS formatted_chars FROM c GROUP BY conv_id""",
    "op4_suffix_array_decontamination": f"""WITH i AS (SELECT item_id, {_WORDS.format("text")} AS w FROM benchmark), o AS (SELECT item_id, p AS q, w[p + 1 : p + 10] AS win FROM (SELECT item_id, w, {_GRID} AS p FROM i WHERE len(w) > 0)), v AS (SELECT DISTINCT item_id, win FROM o),
lens AS (SELECT DISTINCT len(win) AS n FROM v), d AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents),
g AS (SELECT doc_id, n, p, w[p + 1 : p + n] AS win FROM (SELECT doc_id, w, n, unnest(range(0, len(w) - n + 1)) AS p FROM d, lens WHERE len(w) >= n)),
h AS (SELECT DISTINCT doc_id, p, n, item_id, win FROM g JOIN v USING (win)),
hit AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(p, p + n)) AS k FROM h) GROUP BY 1),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM h) GROUP BY 1),
l0 AS (SELECT DISTINCT doc_id, p, n, x.item_id, q FROM h JOIN o AS x ON x.item_id IS NOT DISTINCT FROM h.item_id AND x.win = h.win),
l1 AS (SELECT *, coalesce(p <= max(p + n) OVER (PARTITION BY doc_id, item_id, p - q ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS goes_on FROM l0),
l2 AS (SELECT *, count(*) FILTER (NOT goes_on) OVER (PARTITION BY doc_id, item_id, p - q ORDER BY p) AS run FROM l1),
longest AS (SELECT doc_id, max(words) AS longest_match FROM (SELECT doc_id, max(p + n) - min(p) AS words FROM l2 GROUP BY doc_id, item_id, p - q, run) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(longest_match, 0) AS longest_match FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id) LEFT JOIN longest USING (doc_id)""",
    "op10_warc_chunk_table": f"""WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages), h AS (SELECT page_id, strlen(body) AS payload_bytes, sha1(body) AS hex, max(page_id) OVER (PARTITION BY body) AS target FROM p)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda k: substr('{_BASE32}', ((('0x' || substr(hex, (k // 4 * 5 + 1)::INT, 5))::INT >> (15 - 5 * (k % 4))::INT) & 31) + 1, 1)), '') AS payload_digest,
 CASE WHEN target = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN target <> page_id THEN target END AS refers_to FROM h""",
    "op11_suffix_array_dedup": _REPEATS,
    "op12_vector_code_compression": _codes_sql(),
    "op13_spelling_variant_grouping": _SPELLINGS,
}
