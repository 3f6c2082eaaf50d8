"""Queries on documents, passages, pages and listings, with their DuckDB statements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.functions import text as T
from fathomline.operators import corpus as C
from fathomline.operators import maintenance as I
from fathomline.operators import passages as P
from fathomline.operators import retrieval as R
from fathomline.settings import DEFAULT, chunking, fingerprint
from fathomline.sources.tables import read


def document_tokens(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return read(spark, d, "documents").select("doc_id", T.heuristic_tokens(t).alias("heuristic"), T.prompt_tokens(t).alias("prompt"), T.weighted_length(t).alias("weighted"))


def paragraph_sections(spark: SparkSession, d: str) -> DataFrame:
    return P.paragraphs(read(spark, d, "documents"), boundary=r"\n").select("doc_id", F.col("ordinal").cast("long").alias("ordinal"), "section", F.char_length("text").cast("long").alias("n_chars"))


def chunk_ids(spark: SparkSession, d: str) -> DataFrame:
    return P.with_ids(P.line_passages(read(spark, d, "documents"))).select("filename", "ordinal", "page", "occurrence", "chunk_id", "point_id")


def excerpts(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", T.excerpt(F.col("text")).alias("excerpt"), T.contextual(F.col("source"), F.col("lang"), F.col("text")).alias("contextual"))


def chunks(spark: SparkSession, d: str) -> DataFrame:
    return P.chunks(read(spark, d, "documents"))


def csv_rows(spark: SparkSession, d: str) -> DataFrame:
    return P.rendered_rows(read(spark, d, "customer"), "c_custkey", ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"])


def html_parts(spark: SparkSession, d: str) -> DataFrame:
    h = F.col("html")
    return read(spark, d, "pages").select("page_id", F.regexp_extract(h, r"<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract(h, r"<html lang=\"([a-z]+)\"", 1).alias("lang"), F.regexp_count(h, F.lit(r"<a href=")).cast("long").alias("n_links"), F.regexp_count(h, F.lit(r"<p>")).cast("long").alias("n_paragraphs"))


def url_parts(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    return read(spark, d, "pages").select("page_id", T.host(u).alias("host"), T.without_query(u).alias("loggable"), T.page_name(u).alias("name"))


def sitemap_select(spark: SparkSession, d: str) -> DataFrame:
    """The first page of each distinct URL (fragments dropped) of the two largest top-level domains."""
    p = read(spark, d, "pages").select("page_id", F.regexp_replace("url", "#.*$", "").alias("url"))
    inside = p.filter(T.host(F.col("url")).rlike(r"\.example\.(com|net)$"))
    return C.latest(inside, ["url"], F.col("page_id")).select("page_id", "url")


def passages(spark: SparkSession, d: str) -> DataFrame:
    """Lines as stored passages, some with missing versions and hashes, as older layouts left them."""
    n = F.regexp_extract("filename", r"(\d+)", 1).cast("long")
    p = P.line_passages(read(spark, d, "documents")).withColumn("n", n)
    return p.select(
        "filename", "page", "ordinal", "n", "text", F.when(~((F.col("n") % 13 == 0) & (F.col("ordinal") == 1)), F.when(F.col("n") % 3 == 0, 8).otherwise(9)).cast("long").alias("chunker_version"),
        F.when(~((F.col("n") % 11 == 0) & (F.col("ordinal") == 2)), F.col("sha")).alias("content_sha256"), (F.col("total") + F.when(F.col("n") % 17 == 0, 1).otherwise(0)).cast("long").alias("document_chunks"), F.when(F.col("ordinal") % 2 == 0, F.col("lang")).otherwise(F.col("source")).alias("tag"),
    )


def catalogue(spark: SparkSession, d: str) -> DataFrame:
    return C.catalogue(passages(spark, d))


#: The model of made indexes.
MODEL = "model-a"


def fingerprints(spark: SparkSession, d: str) -> DataFrame:
    """Stored passages of documents chunked under settings by their number; older ones tell none."""
    p = passages(spark, d)
    settings = {k: F.lit(v) for k, v in chunking(DEFAULT, MODEL).items()} | {"chunk_size_tokens": F.when(F.col("n") % 4 == 1, 256).otherwise(DEFAULT.chunk_size), "dense_embedding_model": F.when((F.col("n") % 6 == 2) & (F.col("ordinal") % 2 == 0), "model-b").otherwise(MODEL)}
    return I.fingerprint_state(p.select("filename", F.when(F.col("n") % 5 != 3, I.fingerprint_column(settings)).alias("fingerprint")), fingerprint(chunking(DEFAULT, MODEL)))


def index_fits(spark: SparkSession, d: str) -> DataFrame:
    """Documents of a source and language as indexes with a model, dimension, language and prefix by their smallest id."""
    g = read(spark, d, "documents").groupBy("source", "lang").agg(F.min("doc_id").alias("k"), F.count(F.when(F.col("doc_id") % 3 > 0, 1)).alias("n"))
    rows = g.select(F.concat_ws("/", "source", "lang").alias("index_id"), F.when(F.col("k") % 2 == 0, F.col("n")).otherwise(0).alias("points"), F.when(F.col("k") % 5 > 0, MODEL).alias("model"), F.when(F.col("k") % 4 == 1, 32).otherwise(64).alias("dimension"), F.when(F.col("k") % 3 > 0, "en").alias("language"), F.when(F.col("k") % 7 == 0, "passage: ").alias("prefix"))
    return I.index_compatibility(rows, {"model": MODEL, "dimension": 64, "language": "en", "prefix": ""})


def tag_facet(spark: SparkSession, d: str) -> DataFrame:
    return passages(spark, d).groupBy("tag").agg(F.count_distinct("filename").alias("documents"), F.count(F.lit(1)).alias("chunks"))


def index_size(spark: SparkSession, d: str) -> DataFrame:
    """Vectors' bytes: four a component, one more where they are also kept quantised."""
    e = read(spark, d, "embeddings")
    return e.groupBy("label").agg(F.count(F.lit(1)).alias("points"), (F.sum(F.size("embedding").cast("long")) * 4).alias("bytes"), (F.sum(F.size("embedding").cast("long")) * 5).alias("quantised_bytes"))


def duplicates(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    return C.duplicates(docs, "doc_id", "digest")


def manifest(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = read(spark, d, "documents").select(F.format_string("doc-%d.txt", "doc_id").alias("name"), "doc_id", F.sha2("text", 256).alias("sha"))
    asked = docs.select("name", F.when(F.col("doc_id") % 5 == 0, F.sha2("name", 256)).otherwise(F.col("sha")).alias("sha"))
    return asked, docs.filter("doc_id % 7 <> 0").select("name", "sha")


def missing_documents(spark: SparkSession, d: str) -> DataFrame:
    return C.missing(*manifest(spark, d))


def consistency(spark: SparkSession, d: str) -> DataFrame:
    ids = lambda t, c: read(spark, d, t).select(F.col(c).alias("id"))
    return C.consistency(ids("documents", "doc_id"), ids("labels", "doc_id").union(ids("embeddings", "vec_id")), ids("events", "user_id"))


def listing_page(spark: SparkSession, d: str) -> DataFrame:
    names = read(spark, d, "documents").select(F.format_string("doc-%d.txt", "doc_id").alias("name"))
    return C.listing(names, "doc-1", "doc-12", 50)


def outline(spark: SparkSession, d: str) -> DataFrame:
    return C.outline(P.line_passages(read(spark, d, "documents")))


def around(spark: SparkSession, d: str) -> DataFrame:
    return C.around(P.line_passages(read(spark, d, "documents")), F.col("total") / 2, 2).select("filename", "ordinal")


def neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Every fifth passage kept, in ten questions; the passages beside them."""
    p = P.line_passages(read(spark, d, "documents"))
    n = F.regexp_extract("filename", r"(\d+)", 1).cast("long")
    kept = p.filter("ordinal % 5 = 2 or ordinal % 5 = 3").select((n % 10).alias("query_id"), "filename", "ordinal", F.col("ordinal").alias("kept_rank"))
    return R.neighbours(kept, p, 2).select("query_id", "filename", "ordinal", "neighbour", "kept_rank")


def passage_labels(spark: SparkSession, d: str) -> DataFrame:
    return C.label_passages(read(spark, d, "documents"), read(spark, d, "benchmark"))


def source_catalogue(spark: SparkSession, d: str) -> DataFrame:
    """Documents by source and language with subtotals."""
    docs = read(spark, d, "documents")
    return docs.groupingSets([["source", "lang"], ["source"], []], "source", "lang").agg(F.count(F.lit(1)).alias("documents"), F.sum("n_chars").alias("chars"), F.max("n_chars").alias("longest"))


def round_robin_sample(spark: SparkSession, d: str) -> DataFrame:
    """Two documents of each source, drawn by a hash, in turns."""
    docs = read(spark, d, "documents").select("doc_id", "source", F.md5(F.concat(F.lit("7:"), F.col("doc_id").cast("string"))).alias("draw"))
    return C.newest(docs, ["source"], 2, F.col("draw"), F.col("doc_id")).select("source", "doc_id")


def upserted(spark: SparkSession, d: str) -> DataFrame:
    """A new version of every tenth document put over the table; what then is stored."""
    docs = read(spark, d, "documents").select("doc_id", "source", "n_chars")
    return C.upserted(docs, docs.filter("doc_id % 10 = 0").withColumn("n_chars", F.col("n_chars") + 1), "doc_id")


def url_redaction(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "pages").groupBy(T.without_query(F.col("url")).alias("url")).agg(F.count(F.lit(1)).alias("pages"))


def sentence_stats(spark: SparkSession, d: str) -> DataFrame:
    s = T.sentences(F.col("text"))
    return read(spark, d, "documents").select("doc_id", F.size(s).cast("long").alias("sentences"), F.array_max(F.transform(s, lambda x: F.char_length(x))).cast("long").alias("longest"))


def overlaps(spark: SparkSession, d: str) -> DataFrame:
    """Each document's lines with the words of the line before put in front, whole, half, or glued to another word by the line's number."""
    line = F.posexplode_outer(F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != ""))
    rows = read(spark, d, "documents").select("doc_id", line.alias("ordinal", "body")).filter("body IS NOT NULL")
    before = rows.select("doc_id", (F.col("ordinal") + 1).alias("ordinal"), F.col("body").alias("before"))
    both = rows.join(before, ["doc_id", "ordinal"])
    half = F.regexp_replace(F.right("before", F.lit(60)), r"^\S*\s+", "")
    put = F.when(F.col("ordinal") % 4 == 0, F.concat("before", F.lit(" "))).when(F.col("ordinal") % 4 == 1, F.concat(half, F.lit(" "))).when(F.col("ordinal") % 4 == 2, F.concat(half, F.lit("x"))).otherwise("")
    new = T.without_overlap(F.col("before"), F.concat(put, F.lit("= "), "body"))
    return both.select("doc_id", F.col("ordinal").cast("long").alias("ordinal"), F.char_length(F.concat(put, F.lit("= "), "body")).cast("long").alias("n_chars"), F.char_length(new).cast("long").alias("new_chars"))


def name_problems(spark: SparkSession, d: str) -> DataFrame:
    """Document names with faults made by id."""
    i = F.col("doc_id")
    name = F.when(i % 7 == 0, F.concat(F.lit("."), i.cast("string"), F.lit(".md"))).when(i % 7 == 1, F.lit("a/../b.md")).when(i % 7 == 2, F.concat(F.rpad(F.lit("x"), 260, "x"), F.lit(".md"))).when(i % 7 == 3, F.lit("x.exe")).when(i % 7 == 4, F.lit(" ")).otherwise(F.concat("source", F.lit("/"), i.cast("string"), F.lit(".TXT")))
    return read(spark, d, "documents").groupBy(F.coalesce(T.name_problem(name, [".md", ".txt"]), F.lit("fine")).alias("problem")).agg(F.count(F.lit(1)).alias("names"))


def front_matter(spark: SparkSession, d: str) -> DataFrame:
    """Documents under front matter in one of three layouts; the tags it gives."""
    i, head = F.col("doc_id") % 3, F.concat(F.lit("---\ntitle: t\ntags:"))
    text = F.when(i == 0, F.concat(head, F.lit(" ["), "lang", F.lit(", '"), "source", F.lit("']\n---\n"), "text")).when(i == 1, F.concat(head, F.lit("\n  - "), "lang", F.lit("\n  - b c\n---\n"), "text")).otherwise(F.concat(head, F.lit(" [x]\n"), "text"))
    return read(spark, d, "documents").select("doc_id", F.array_join(T.front_matter_tags(text), "|").alias("tags"))


LINES = r"""
parts AS (SELECT doc_id, source, lang, text AS whole, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '\S')) AS l FROM documents),
lines AS (
  SELECT 'doc-' || doc_id || '.txt' AS filename, doc_id AS n, (ordinal - 1) // 20 + 1 AS page, left(source, 120) AS section, text, ordinal, lang, source, sha, total
  FROM (SELECT doc_id, source, lang, sha256(whole) AS sha, len(l)::BIGINT AS total, unnest(l) AS text, generate_subscripts(l, 1)::BIGINT AS ordinal FROM parts))"""

STORED = """
stored AS (
  SELECT filename, page, ordinal, n, CASE WHEN NOT (n % 13 = 0 AND ordinal = 1) THEN CASE WHEN n % 3 = 0 THEN 8 ELSE 9 END END::BIGINT AS chunker_version,
    CASE WHEN NOT (n % 11 = 0 AND ordinal = 2) THEN sha END AS content_sha256, total + CASE WHEN n % 17 = 0 THEN 1 ELSE 0 END AS document_chunks,
    CASE WHEN ordinal % 2 = 0 THEN lang ELSE source END AS tag FROM lines)"""

QUERIES = {
    f.__name__: f
    for f in (document_tokens, paragraph_sections, chunk_ids, excerpts, chunks, csv_rows, html_parts, url_parts, sitemap_select, catalogue, tag_facet, index_size, duplicates, missing_documents, consistency, listing_page, outline, around, neighbours, passage_labels, source_catalogue, fingerprints, index_fits, sentence_stats, overlaps, name_problems, front_matter, round_robin_sample, upserted, url_redaction)
}

CJK = T.CJK
ORACLE = {
    "document_tokens": rf"""
SELECT doc_id, ceil(round(list_sum(list_transform(list_filter(string_split_regex(text, '\s+'), lambda w: w <> ''),
    lambda w: greatest(1.6, len(regexp_extract_all(w, '{CJK}')) + len(regexp_extract_all(w, '[^\p{{L}}\p{{N}}_\s]')) + len(regexp_extract_all(w, '\p{{Nd}}')) / 2.0)::DOUBLE)), 6))::BIGINT AS heuristic,
  (len(regexp_extract_all(text, '{CJK}')) + ceil((length(text) - len(regexp_extract_all(text, '{CJK}'))) / 3.0))::BIGINT AS prompt,
  (length(text) + 2 * len(regexp_extract_all(text, '{CJK}')))::BIGINT AS weighted FROM documents""",
    "paragraph_sections": rf"WITH {LINES} SELECT n AS doc_id, ordinal, left(trim(regexp_replace(text, '\s+', ' ', 'g')), 120) AS section, length(text) AS n_chars FROM lines",
    "chunk_ids": f"""WITH {LINES}, numbered AS (SELECT *, row_number() OVER (PARTITION BY filename, page, section, text ORDER BY ordinal) - 1 AS occurrence FROM lines),
ids AS (SELECT *, left(sha256(concat_ws(chr(10), filename, page::VARCHAR, section, text, occurrence::VARCHAR)), 20) AS chunk_id FROM numbered),
hashed AS (SELECT *, sha1(unhex('{T.NAMESPACE_URL}') || ('passage:' || filename || ':' || page || ':' || section || ':' || chunk_id)::BLOB) AS h FROM ids)
SELECT filename, ordinal, page, occurrence, chunk_id, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || substr('89ab', (('0x' || h[17])::INT % 4) + 1, 1) || h[18:20] || '-' || h[21:32] AS point_id FROM hashed""",
    "excerpts": r"""WITH flat AS (SELECT doc_id, source, lang, text, trim(regexp_replace(text, '\s+', ' ', 'g')) AS f FROM documents)
SELECT doc_id, CASE WHEN length(f) > 200 THEN rtrim(left(f, 200)) || '...' ELSE f END AS excerpt, source || ' › ' || lang || chr(10) || text AS contextual FROM flat""",
    "csv_rows": """
SELECT floor((c_custkey - 1) / 50.0)::BIGINT AS section_no, 'Rows ' || min(c_custkey) || '-' || max(c_custkey) AS label, count(*) AS n_rows,
  string_agg('c_custkey: ' || c_custkey || '; c_name: ' || c_name || '; c_nationkey: ' || c_nationkey || '; c_mktsegment: ' || c_mktsegment, chr(10) ORDER BY c_custkey) AS text
FROM customer GROUP BY 1""",
    "html_parts": r"""SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang,
  len(regexp_extract_all(html, '<a href=')) AS n_links, len(regexp_extract_all(html, '<p>')) AS n_paragraphs FROM pages""",
    "url_parts": r"""WITH p AS (SELECT page_id, url, lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/:?#]*)', 1)) AS host, regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path FROM pages)
SELECT page_id, host, regexp_replace(url, '[?#].*$', '') AS loggable,
  regexp_replace(regexp_replace(host || replace(path, '/', '_'), '[^A-Za-z0-9_.\-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g') || '.html' AS name FROM p""",
    "sitemap_select": r"""SELECT min(page_id) AS page_id, regexp_replace(url, '#.*$', '') AS url FROM pages
WHERE regexp_matches(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/:?#]*)', 1)), '\.example\.(com|net)$') GROUP BY 2""",
    "catalogue": f"""WITH {LINES}, {STORED},
g AS (SELECT filename, count(*) AS chunk_count, max(page) AS page_count, CASE WHEN count(chunker_version) = count(*) THEN min(chunker_version) END AS chunker_version,
  CASE WHEN count(content_sha256) = count(*) AND min(content_sha256) = max(content_sha256) THEN min(content_sha256) END AS content_sha256,
  CASE WHEN count(document_chunks) = count(*) AND min(document_chunks) = max(document_chunks) THEN min(document_chunks) END AS document_chunks,
  array_to_string(list_sort(list(DISTINCT tag)), ',') AS tags,
  (count(DISTINCT content_sha256) + max((content_sha256 IS NULL)::INT) > 1) OR (count(DISTINCT document_chunks) + max((document_chunks IS NULL)::INT) > 1) AS mixed FROM stored GROUP BY filename)
SELECT filename, chunk_count, page_count, chunker_version, content_sha256, document_chunks, tags, mixed OR coalesce(document_chunks <> chunk_count, false) AS incomplete,
  chunker_version IS NULL OR chunker_version < 9 AS stale FROM g""",
    "tag_facet": f"WITH {LINES}, {STORED} SELECT tag, count(DISTINCT filename) AS documents, count(*) AS chunks FROM stored GROUP BY tag",
    "index_size": "SELECT label, count(*) AS points, (sum(len(embedding)) * 4)::BIGINT AS bytes, (sum(len(embedding)) * 5)::BIGINT AS quantised_bytes FROM embeddings GROUP BY label",
    "duplicates": """WITH h AS (SELECT doc_id, sha256(text) AS digest FROM documents), g AS (SELECT digest, count(*) AS copies, min(doc_id) AS first_name FROM h GROUP BY 1 HAVING count(*) > 1)
SELECT digest, doc_id, first_name, copies FROM h JOIN g USING (digest)""",
    "missing_documents": """WITH docs AS (SELECT 'doc-' || doc_id || '.txt' AS name, doc_id, sha256(text) AS sha FROM documents),
asked AS (SELECT name, CASE WHEN doc_id % 5 = 0 THEN sha256(name) ELSE sha END AS sha FROM docs), held AS (SELECT name, sha FROM docs WHERE doc_id % 7 <> 0)
SELECT name, sha FROM asked a WHERE NOT EXISTS (SELECT 1 FROM held h WHERE h.name = a.name AND h.sha = a.sha)""",
    "consistency": """WITH stored AS (SELECT DISTINCT doc_id AS id FROM documents), indexed AS (SELECT doc_id AS id FROM labels UNION SELECT vec_id FROM embeddings), versions AS (SELECT DISTINCT user_id AS id FROM events)
SELECT 'not_indexed' AS kind, id FROM (SELECT id FROM stored EXCEPT SELECT id FROM indexed) UNION ALL SELECT 'no_original', id FROM (SELECT id FROM indexed EXCEPT SELECT id FROM stored)
UNION ALL SELECT 'orphan_version', id FROM (SELECT id FROM versions EXCEPT SELECT id FROM indexed EXCEPT SELECT id FROM stored)""",
    "listing_page": """WITH f AS (SELECT 'doc-' || doc_id || '.txt' AS name FROM documents WHERE starts_with('doc-' || doc_id || '.txt', 'doc-1'))
SELECT name, (SELECT count(*) FROM f) AS total FROM f WHERE name > 'doc-12' ORDER BY name LIMIT 50""",
    "outline": f"""WITH {LINES}, w AS (SELECT *, lag(page) OVER o AS p, lag(section) OVER o AS s FROM lines WINDOW o AS (PARTITION BY filename ORDER BY ordinal))
SELECT filename, ordinal, page, section FROM w WHERE page IS DISTINCT FROM p OR section IS DISTINCT FROM s""",
    "around": f"WITH {LINES} SELECT filename, ordinal FROM lines WHERE ordinal BETWEEN total / 2.0 - 2 AND total / 2.0 + 2",
    "neighbours": f"""WITH {LINES}, kept AS (SELECT n % 10 AS query_id, filename, ordinal FROM lines WHERE ordinal % 5 IN (2, 3)),
near AS (SELECT k.query_id, k.filename, k.ordinal, l.ordinal AS neighbour, row_number() OVER (PARTITION BY k.query_id, k.filename, l.ordinal ORDER BY k.ordinal) AS r
  FROM kept k JOIN lines l ON l.filename = k.filename AND l.ordinal BETWEEN k.ordinal - 2 AND k.ordinal + 2 WHERE NOT EXISTS (SELECT 1 FROM kept o WHERE o.query_id = k.query_id AND o.filename = k.filename AND o.ordinal = l.ordinal))
SELECT query_id, filename, ordinal, neighbour, ordinal AS kept_rank FROM near WHERE r = 1""",
    "passage_labels": r"""WITH d AS (SELECT doc_id, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS t FROM documents), b AS (SELECT item_id, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS t FROM benchmark)
SELECT item_id, doc_id FROM b JOIN d ON contains(d.t, b.t)""",
    "source_catalogue": "SELECT source, lang, count(*) AS documents, sum(n_chars)::BIGINT AS chars, max(n_chars) AS longest FROM documents GROUP BY GROUPING SETS ((source, lang), (source), ())",
    "round_robin_sample": "SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY md5('7:' || doc_id), doc_id) AS r FROM documents) WHERE r <= 2",
    "sentence_stats": r"""WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '([.!?。！？])\s+', '\1' || chr(1), 'g'), '\n+', chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: regexp_matches(x, '\S')) AS l FROM documents)
SELECT doc_id, len(l) AS sentences, list_max(list_transform(l, lambda x: length(x))) AS longest FROM s""",
    "name_problems": """SELECT CASE doc_id % 7 WHEN 0 THEN 'hidden' WHEN 1 THEN 'dots' WHEN 2 THEN 'too long' WHEN 3 THEN 'unsupported' WHEN 4 THEN 'empty' ELSE 'fine' END AS problem, count(*) AS names FROM documents GROUP BY 1""",
    "front_matter": "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN lang || '|' || source WHEN 1 THEN lang || '|b c' ELSE '' END AS tags FROM documents",
    "upserted": "SELECT doc_id, source, n_chars + CASE WHEN doc_id % 10 = 0 THEN 1 ELSE 0 END AS n_chars FROM documents",
    "url_redaction": "SELECT regexp_replace(url, '[?#].*$', '') AS url, count(*) AS pages FROM pages GROUP BY 1",
    "overlaps": r"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') AS l FROM documents),
b AS (SELECT doc_id, i - 1 AS ordinal, l[i] AS body, l[i - 1] AS before, regexp_replace(right(l[i - 1], 60), '^\S*\s+', '') AS half FROM l, unnest(range(2, len(l) + 1)) AS u(i)),
p AS (SELECT *, CASE ordinal % 4 WHEN 0 THEN before || ' ' WHEN 1 THEN half || ' ' WHEN 2 THEN half || 'x' ELSE '' END || '= ' || body AS after FROM b),
f AS (SELECT *, list_filter(range(20, least(length(before), length(after), 1000) + 1), lambda n: right(before, n) = left(after, n) AND (n = length(after) OR regexp_matches(after[n + 1], '\s')) AND (n = length(before) OR regexp_matches(before[length(before) - n], '\s'))) AS c FROM p)
SELECT doc_id, ordinal, length(after) AS n_chars, CASE WHEN len(c) > 0 THEN length(ltrim(substr(after, c[1] + 1))) ELSE length(after) END AS new_chars FROM f""",
    "fingerprints": f"""WITH {LINES}, {STORED}, f AS (SELECT filename, CASE WHEN n % 5 <> 3 THEN left(sha256('{{"chunk_overlap_tokens": {DEFAULT.chunk_overlap}, "chunk_size_tokens": ' || CASE WHEN n % 4 = 1 THEN 256 ELSE {DEFAULT.chunk_size} END || ', "chunker_version": {DEFAULT.chunker_version}, "csv_rows_per_section": {DEFAULT.rows_per_section}, "dense_embedding_model": "' || CASE WHEN n % 6 = 2 AND ordinal % 2 = 0 THEN 'model-b' ELSE '{MODEL}' END || '", "min_section_words": {DEFAULT.min_section_words}}}'), 12) END AS f FROM stored)
SELECT filename, count(*) AS passages, count(*) FILTER (f IS DISTINCT FROM '{fingerprint(chunking(DEFAULT, MODEL))}') AS old, count(DISTINCT f) AS fingerprints, bool_or(f IS DISTINCT FROM '{fingerprint(chunking(DEFAULT, MODEL))}') AS stale FROM f GROUP BY 1""",
    "index_fits": f"""WITH g AS (SELECT source, lang, min(doc_id) AS k, count(*) FILTER (doc_id % 3 > 0) AS n FROM documents GROUP BY ALL),
x AS (SELECT concat_ws('/', source, lang) AS index_id, CASE WHEN k % 2 = 0 THEN n ELSE 0 END AS points, list_filter([CASE WHEN k % 5 = 0 THEN 'model' END, CASE WHEN k % 4 = 1 THEN 'dimension' END, NULL, CASE WHEN k % 7 = 0 THEN 'prefix' END], lambda v: v IS NOT NULL) AS d FROM g)
SELECT index_id, CASE WHEN len(d) = 0 THEN 'fits' WHEN points > 0 THEN 'refused' ELSE 'rebuilt' END AS verdict, coalesce(array_to_string(d, ','), '') AS differs FROM x""",
}
