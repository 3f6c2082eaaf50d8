"""Queries on names, tags, sections and prompts, with their DuckDB statements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathomline.functions import text as T
from fathomline.operators import corpus as C
from fathomline.operators import curation as U
from fathomline.operators import maintenance as M
from fathomline.operators import passages as P
from fathomline.operators import retrieval as R
from fathomline.plans.evaluation import JUDGED, judged
from fathomline.plans.search import bm25_sql, sparse_queries
from fathomline.sources.tables import read


def normalized_tags(spark: SparkSession, d: str) -> DataFrame:
    tags = F.array(F.upper("lang"), F.concat(F.lit("  "), "source", F.lit("  x ")), F.col("lang"), F.lit(""), F.rpad(F.lit("long"), 41, "g"), F.col("source"))
    return read(spark, d, "documents").select("doc_id", F.array_join(U.normalized_tags(tags), "|").alias("tags"))


def tag_variants(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents")
    stored = docs.select(F.upper("source").alias("tag")).filter("tag <> 'SRC3'").distinct()
    return U.stored_variants(docs.select(F.concat(F.lit(" "), "source").alias("wanted")).distinct(), stored)


def conflicting_names(spark: SparkSession, d: str) -> DataFrame:
    """Page names, those of even ids in capitals: which would collide where case does not count."""
    name = T.page_name(F.regexp_replace("url", r"/[0-9]+([?#].*)?$", "/x"))
    return U.conflicting_names(read(spark, d, "pages").select(F.when(F.col("page_id") % 2 == 0, F.upper(name)).otherwise(name).alias("name")))


def glob_names(spark: SparkSession, d: str) -> DataFrame:
    names = read(spark, d, "pages").select("page_id", F.regexp_replace(T.without_query(F.col("url")), "^[a-z]+://", "").alias("name"))
    return U.matching(names, ["*.example.com/**", "1?"], ["*/de/*", "*0"])


def distinct_lines(spark: SparkSession, d: str) -> DataFrame:
    return U.distinct_lines(read(spark, d, "documents"), "doc_id", "text", 5).select("doc_id", "place", F.char_length("line").cast("long").alias("n_chars"))


def merged_sections(spark: SparkSession, d: str) -> DataFrame:
    """Lines gathered into sections of at least forty words."""
    p = P.paragraphs(read(spark, d, "documents"), boundary=r"\n")
    s = p.select("doc_id", "ordinal", F.size(F.split(F.trim("text"), r"\s+")).cast("long").alias("words"))
    return U.merged_sections(s, "doc_id", "ordinal", "words", 40)


def fitted_prompts(spark: SparkSession, d: str) -> DataFrame:
    """The best six documents' excerpts of each benchmark text, as far as 150 tokens have room."""
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("id"), "source", T.excerpt(F.col("text")).alias("excerpt"))
    rows = R.bm25_top(read(spark, d, "documents"), sparse_queries(spark, d), 6).join(docs, "id").withColumn("tokens", T.prompt_tokens(F.col("excerpt")))
    return U.prompts(U.fitted(rows, "query_id", "rank", "tokens", 150), "query_id", "rank", "source", "excerpt")


def echoed_headers(spark: SparkSession, d: str) -> DataFrame:
    """Whole documents as answers after two repeated headers."""
    answer = F.concat(F.lit("[1] filename="), "source", F.lit("; page=2\n> [2] [3] filename=b\n"), "text")
    return read(spark, d, "documents").select("doc_id", U.without_echo(answer).alias("answer"))


def what_if(spark: SparkSession, d: str) -> DataFrame:
    top = judged(spark, d)[0].groupBy("query_id").agg(F.max("score").alias("score"))
    return U.what_if(top, "score", 0.4, 0.3)


def known_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages as a list with dates by id, against stored ones of every id not divisible by 4."""
    p = read(spark, d, "pages").groupBy("url").agg(F.min("page_id").alias("page_id"))
    listed = p.select("url", ((F.col("page_id") * 7919) % 1000).alias("modified"))
    stored = p.filter("page_id % 4 <> 0").select("url", ((F.col("page_id") * 104729) % 1000).alias("fetched"))
    return U.known_pages(listed, stored).groupBy("outcome").agg(F.count(F.lit(1)).alias("pages"))


def source_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Turns numbered over the conversations of a question, in order."""
    c = read(spark, d, "conversations").withColumn("question", F.floor(F.col("conv_id") / 5))
    return c.select("question", "conv_id", "turn", F.row_number().over(Window.partitionBy("question").orderBy("conv_id", "turn")).cast("long").alias("number"))


def vector_reuse(spark: SparkSession, d: str) -> DataFrame:
    """Points whose stored vector serves again: same point, fingerprint and dimension."""
    e = read(spark, d, "embeddings").select(F.col("vec_id").alias("point_id"), "label", F.col("embedding").alias("vector"))
    fresh = e.select("point_id", (F.col("label") % 3).alias("fingerprint"))
    stored = e.filter("point_id % 5 <> 0").select("point_id", F.when(F.col("label") == 4, 9).otherwise(F.col("label") % 3).alias("fingerprint"), "vector")
    return M.reusable_vectors(fresh, stored, 64).select("point_id", F.col("vector").isNotNull().alias("reused"))


def latest_ratings(spark: SparkSession, d: str) -> DataFrame:
    """Each question's last rating: events as ratings of a question by type and tens of users, case aside."""
    e = read(spark, d, "events").withColumn("question", F.lower(F.concat_ws(" ", "event_type", (F.col("user_id") / 10).cast("long").cast("string"))))
    return C.latest(e, ["question"], F.desc("ts"), F.desc("event_id")).select("question", "event_id", (F.col("value") >= 10).alias("up"))


LINES = r"SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents"

QUERIES = {f.__name__: f for f in (normalized_tags, tag_variants, conflicting_names, glob_names, distinct_lines, merged_sections, fitted_prompts, echoed_headers, what_if, known_pages, source_numbers, vector_reuse, latest_ratings)}

ORACLE = {
    "normalized_tags": "SELECT doc_id, upper(lang) || '|' || source || ' x|' || source AS tags FROM documents",
    "tag_variants": "SELECT DISTINCT ' ' || source AS wanted, CASE WHEN source = 'src3' THEN ' src3' ELSE upper(source) END AS tag FROM documents",
    "conflicting_names": r"""WITH p AS (SELECT page_id, regexp_replace(url, '/[0-9]+([?#].*)?$', '/x') AS url FROM pages),
q AS (SELECT page_id, lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/:?#]*)', 1)) || replace(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/', '_') AS stem FROM p),
n AS (SELECT DISTINCT CASE WHEN page_id % 2 = 0 THEN upper(s) ELSE s END AS name FROM (SELECT page_id, regexp_replace(regexp_replace(stem, '[^A-Za-z0-9_.\-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g') || '.html' AS s FROM q)),
f AS (SELECT lower(name) AS k, min(name) AS first_name FROM n GROUP BY 1 HAVING count(*) > 1) SELECT name, first_name FROM n JOIN f ON lower(name) = k WHERE name <> first_name""",
    "glob_names": r"""WITH n AS (SELECT page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://', '') AS name FROM pages), b AS (SELECT *, regexp_extract(name, '([^/]*)$', 1) AS last FROM n)
SELECT page_id, name FROM b WHERE (regexp_matches(name, '^[^/]*\.example\.com/.*$') OR regexp_matches(last, '^1[^/]$')) AND NOT regexp_matches(name, '^[^/]*/de/[^/]*$') AND NOT regexp_matches(last, '^[^/]*0$')""",
    "distinct_lines": f"""WITH l AS (SELECT doc_id, pos, trim(line) AS line FROM ({LINES}) WHERE trim(line) <> ''), f AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY doc_id, lower(line) ORDER BY pos) = 1)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS place, length(line) AS n_chars FROM f QUALIFY place <= 5""",
    "fitted_prompts": rf"""WITH {bm25_sql(limit=6)}, flat AS (SELECT doc_id, source, trim(regexp_replace(text, '\s+', ' ', 'g')) AS f FROM documents),
x AS (SELECT doc_id, source, CASE WHEN length(f) > 200 THEN rtrim(left(f, 200)) || '...' ELSE f END AS e FROM flat),
r AS (SELECT query_id, rank, source, e, sum(ceil(length(e) / 3.0)) OVER (PARTITION BY query_id ORDER BY rank) AS used, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM sparse JOIN x ON doc_id = id)
SELECT query_id, count(*) AS sources, string_agg('[' || rank || '] filename=' || source || chr(10) || e, chr(10) || chr(10) ORDER BY rank) AS prompt FROM r WHERE used <= 150 OR place = 1 GROUP BY query_id""",
    "echoed_headers": "SELECT doc_id, text AS answer FROM documents",
    "what_if": f"""WITH {JUDGED}, t AS (SELECT query_id, max(score) AS s FROM judged GROUP BY 1)
SELECT count(*) AS checked, count(*) FILTER (s >= 0.3) AS would_answer, count(*) FILTER (s >= 0.3 AND s < 0.4) AS newly_answered, 0::BIGINT AS newly_unanswered FROM t""",
    "known_pages": """WITH p AS (SELECT url, min(page_id) AS id FROM pages GROUP BY 1)
SELECT CASE WHEN id % 4 = 0 THEN 'new' WHEN id * 7919 % 1000 > id * 104729 % 1000 THEN 'newer' ELSE 'unchanged' END AS outcome, count(*) AS pages FROM p GROUP BY 1""",
    "source_numbers": "SELECT conv_id // 5 AS question, conv_id, turn, row_number() OVER (PARTITION BY conv_id // 5 ORDER BY conv_id, turn) AS number FROM conversations",
    "vector_reuse": "SELECT vec_id AS point_id, vec_id % 5 <> 0 AND label <> 4 AND len(embedding) = 64 AS reused FROM embeddings",
    "latest_ratings": "SELECT lower(event_type || ' ' || user_id // 10) AS question, event_id, value >= 10 AS up FROM events QUALIFY row_number() OVER (PARTITION BY lower(event_type || ' ' || user_id // 10) ORDER BY ts DESC, event_id DESC) = 1",
    "merged_sections": r"""WITH RECURSIVE l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\S')) AS l FROM documents),
s AS (SELECT doc_id, i, len(string_split(trim(regexp_replace(l[i], '\s+', ' ', 'g')), ' ')) AS words FROM l, unnest(range(1, len(l) + 1)) AS u(i)),
f AS (SELECT doc_id, i, 1::BIGINT AS section, words AS held FROM s WHERE i = 1
  UNION ALL SELECT s.doc_id, s.i, f.section + (f.held >= 40)::INT, CASE WHEN f.held >= 40 THEN s.words ELSE f.held + s.words END FROM f JOIN s ON s.doc_id = f.doc_id AND s.i = f.i + 1)
SELECT doc_id, i::INT AS ordinal, section FROM f""",
}
