"""Queries that cut texts of small formats into sections. The texts are made from table rows, so their size follows the data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathomline.operators import maintenance as M
from fathomline.sources import files, stores
from fathomline.sources.tables import read


def markdown_sections(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose every fifth line is made a heading; sections and their sizes."""
    marked = F.transform(F.split("text", "\n"), lambda x, k: F.when((k % 5 == 2) & x.rlike(r"\S"), F.concat(F.lit("## "), F.trim(x))).otherwise(x))
    texts = read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("name"), F.array_join(marked, "\n").alias("text"))
    return files.markdown(texts).select("name", "ordinal", F.char_length("text").cast("long").alias("n_chars"))


def setext_sections(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose every fifth line is underlined; one in three lines below is fenced and underlined in vain."""
    mark = lambda x, k: F.when((k % 5 == 2) & x.rlike(r"\S"), F.concat(F.trim(x), F.lit("\n==="))).when(k % 15 == 4, F.concat(F.lit("```\n"), F.trim(x), F.lit("\n===\n```"))).otherwise(x)
    texts = read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("name"), F.array_join(F.transform(F.split("text", "\n"), mark), "\n").alias("text"))
    return files.markdown(texts).select("name", "ordinal", "section", F.char_length("text").cast("long").alias("n_chars"))


def subtitle_minutes(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as subtitles, a turn every 25 seconds; words by minute."""
    c = read(spark, d, "conversations")
    at = F.col("turn") * 25
    cue = F.format_string("%d\n00:%02d:%02d,000 --> 00:59:59,000\n%s", F.col("turn") + 1, F.floor(at / 60), at % 60, F.regexp_replace("text", r"\s+", " "))
    texts = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", cue.alias("cue")))).alias("cues")).select(F.col("conv_id").cast("string").alias("name"), F.array_join(F.transform("cues", lambda x: x["cue"]), "\n\n").alias("text"))
    return files.subtitles(texts).select("name", "page", (F.size(F.split("text", "\n"))).cast("long").alias("cues"))


def json_records(spark: SparkSession, d: str) -> DataFrame:
    """Each user's event properties as JSON lines; records and their text."""
    e = read(spark, d, "events").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("event_id", "props"))).alias("r"))
    texts = e.select(F.col("user_id").cast("string").alias("name"), F.array_join(F.transform("r", lambda x: x["props"]), "\n").alias("text"))
    return files.json_lines(texts).groupBy("name", "text").agg(F.count(F.lit(1)).alias("records"))


def delimited_rows(spark: SparkSession, d: str) -> DataFrame:
    """Each nation's suppliers as a delimited file; its sections."""
    s = read(spark, d, "supplier")
    line = F.concat_ws(",", F.col("s_suppkey").cast("string"), F.concat(F.lit('"'), "s_name", F.lit(', Inc"')))
    texts = s.groupBy("s_nationkey").agg(F.sort_array(F.collect_list(F.struct("s_suppkey", line.alias("line")))).alias("r")).select(F.col("s_nationkey").cast("string").alias("name"), F.concat(F.lit("key,name\n"), F.array_join(F.transform("r", lambda x: x["line"]), "\n")).alias("text"))
    return files.delimited(texts, 3).select("name", "section", "text")


def mail_sections(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "conversations")
    text = F.format_string("From: %s@example.com\nX-Skip: 1\nSubject: turn %d\n\n%s", "role", "turn", "text")
    return files.mail(c.select(F.format_string("%d-%d", "conv_id", "turn").alias("name"), text.alias("text"))).select("name", "section", F.char_length("text").cast("long").alias("n_chars"))


def restore_outcomes(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("name"), "doc_id", F.sha2("text", 256).alias("sha"), "n_chars")
    backup = stores.manifest(docs, "name", "sha", "n_chars").withColumn("original", F.col("name").cast("long") % 9 != 0)
    return stores.restore_plan(backup, docs.filter("doc_id % 4 = 0"), 5000).groupBy("outcome").agg(F.count(F.lit(1)).alias("documents"))


def kept_versions(spark: SparkSession, d: str) -> DataFrame:
    """Events as versions of their user's file, their type as content."""
    v = read(spark, d, "events").select(F.col("user_id").alias("name"), F.col("event_id").alias("saved"), F.col("event_type").alias("sha"))
    return stores.kept_versions(v, 5)


def reindex_outcomes(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("name"), (F.col("n_chars") % 3 == 0).alias("stale"), (F.col("n_chars") % 5 == 0).alias("incomplete"))
    plan = M.reindex_plan(docs, read(spark, d, "labels").select(F.col("doc_id").alias("name")), docs.filter("name % 10 = 0").select("name"))
    return plan.groupBy("outcome").agg(F.count(F.lit(1)).alias("documents"))


def repair_outcomes(spark: SparkSession, d: str) -> DataFrame:
    ids = lambda t, c: read(spark, d, t).select(F.col(c).alias("id"))
    return M.repair_plan(ids("documents", "doc_id"), ids("labels", "doc_id"))


def sync_deletes(spark: SparkSession, d: str) -> DataFrame:
    names = lambda t, c: read(spark, d, t).select(F.col(c).alias("name")).distinct()
    return M.removed_files(names("documents", "doc_id"), names("embeddings", "vec_id"), F.lit(True))


def payload_patch(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select("doc_id", "lang", "source")
    changes = docs.filter("doc_id % 3 = 0").select("doc_id", F.when(F.col("doc_id") % 2 == 0, "xx").alias("lang"))
    return M.patched(docs, changes, "doc_id")


def stale_points(spark: SparkSession, d: str) -> DataFrame:
    """Documents' lines before and after an edit of every fourth document that drops its odd lines."""
    lines = read(spark, d, "documents").select(F.col("doc_id").alias("filename"), F.posexplode(F.split("text", "\n")).alias("pos", "line")).select("filename", F.sha1(F.concat_ws(":", "filename", "pos", "line")).alias("point_id"), "pos")
    after = lines.filter("filename % 4 = 0 and pos % 2 = 0")
    return M.stale_points(lines, after).groupBy("filename").agg(F.count(F.lit(1)).alias("points"))


def generation_changes(spark: SparkSession, d: str) -> DataFrame:
    """Names changed since each hundredth generation of the log (events as changes)."""
    log = read(spark, d, "events").select(F.col("event_id").alias("generation"), F.col("user_id").alias("name"))
    last = log.withColumn("last", F.max("generation").over(Window.partitionBy("name"))).select("name", "last").distinct()
    return last.groupBy((F.floor(F.col("last") / 100) * 100).alias("since")).agg(F.count(F.lit(1)).alias("names"))


LINES = r"SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents"

QUERIES = {f.__name__: f for f in (markdown_sections, setext_sections, subtitle_minutes, json_records, delimited_rows, mail_sections, restore_outcomes, kept_versions, reindex_outcomes, repair_outcomes, sync_deletes, payload_patch, stale_points, generation_changes)}

ORACLE = {
    "markdown_sections": rf"""WITH l AS ({LINES}), m AS (SELECT doc_id, pos, pos % 5 = 2 AND regexp_matches(line, '\S') AS head, CASE WHEN pos % 5 = 2 AND regexp_matches(line, '\S') THEN '## ' || trim(line) ELSE line END AS line FROM l),
s AS (SELECT *, sum(head::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS ordinal FROM m), j AS (SELECT doc_id, ordinal, string_agg(line, chr(10) ORDER BY pos) AS text FROM s GROUP BY ALL)
SELECT doc_id::VARCHAR AS name, ordinal::BIGINT AS ordinal, length(text) AS n_chars FROM j WHERE regexp_matches(text, '\S')""",
    "setext_sections": rf"""WITH l AS ({LINES}), m AS (SELECT doc_id, pos, pos % 5 = 2 AND regexp_matches(line, '\S') AS head, trim(line) AS t,
  CASE WHEN pos % 5 = 2 AND regexp_matches(line, '\S') THEN trim(line) || chr(10) || '===' WHEN pos % 15 = 4 THEN '```' || chr(10) || trim(line) || chr(10) || '===' || chr(10) || '```' ELSE line END AS line FROM l),
s AS (SELECT *, sum(head::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS ordinal FROM m), j AS (SELECT doc_id, ordinal, string_agg(line, chr(10) ORDER BY pos) AS text, max(CASE WHEN head THEN left(trim(regexp_replace(t, '\s+', ' ', 'g')), 120) END) AS section FROM s GROUP BY ALL)
SELECT doc_id::VARCHAR AS name, ordinal::BIGINT AS ordinal, coalesce(section, '') AS section, length(text) AS n_chars FROM j WHERE regexp_matches(text, '\S')""",
    "subtitle_minutes": r"SELECT conv_id::VARCHAR AS name, turn * 25 // 60 + 1 AS page, count(*) AS cues FROM conversations WHERE regexp_matches(text, '\S') GROUP BY 1, 2",
    "json_records": "SELECT user_id::VARCHAR AS name, 'k: ' || (props->>'$.k') AS text, count(*) AS records FROM events GROUP BY 1, 2",
    "delimited_rows": """WITH n AS (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS pos FROM supplier)
SELECT s_nationkey::VARCHAR AS name, 'Rows ' || min(pos) + 1 || '-' || max(pos) + 1 AS section, string_agg('key: ' || s_suppkey || '; name: ' || s_name || ', Inc', chr(10) ORDER BY pos) AS text FROM n GROUP BY s_nationkey, (pos - 1) // 3""",
    "mail_sections": r"""SELECT conv_id || '-' || turn AS name, 'Header' AS section, length('From: ' || role || '@example.com' || chr(10) || 'Subject: turn ' || turn) AS n_chars FROM conversations
UNION ALL SELECT conv_id || '-' || turn, 'turn ' || turn, length(regexp_replace(text, '^\s+|\s+$', '', 'g')) FROM conversations WHERE regexp_matches(text, '\S')""",
    "restore_outcomes": "SELECT CASE WHEN doc_id % 4 = 0 THEN 'skipped' WHEN doc_id % 9 = 0 THEN 'missing' WHEN n_chars > 5000 THEN 'rejected' ELSE 'queued' END AS outcome, count(*) AS documents FROM documents GROUP BY 1",
    "kept_versions": """WITH f AS (SELECT user_id AS name, event_id AS saved, event_type AS sha, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events)
SELECT name, saved, sha FROM f WHERE before IS NULL OR before <> sha QUALIFY row_number() OVER (PARTITION BY name ORDER BY saved DESC) <= 5""",
    "reindex_outcomes": """SELECT CASE WHEN doc_id % 10 = 0 THEN 'busy' WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'queued' ELSE 'no_original' END AS outcome, count(*) AS documents
FROM documents WHERE n_chars % 3 = 0 OR n_chars % 5 = 0 GROUP BY 1""",
    "repair_outcomes": """WITH o AS (SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels))
SELECT id, CASE WHEN (SELECT count(*) FROM o) >= 5 AND (SELECT count(*) FROM o) > 0.5 * (SELECT count(*) FROM documents) THEN 'index_lost' ELSE 'delete_original' END AS action FROM o""",
    "sync_deletes": "SELECT doc_id AS name FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)",
    "payload_patch": "SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 'xx' ELSE lang END AS lang, source FROM documents",
    "stale_points": f"WITH l AS ({LINES}) SELECT doc_id AS filename, count(*) AS points FROM l WHERE doc_id % 4 = 0 AND pos % 2 = 1 GROUP BY 1",
    "generation_changes": "WITH l AS (SELECT user_id, max(event_id) AS last FROM events GROUP BY 1) SELECT last // 100 * 100 AS since, count(*) AS names FROM l GROUP BY 1",
}
