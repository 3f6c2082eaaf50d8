"""Ratings and logs: question sets, unanswered questions searched again, rates of answers. Made from events and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.operators import retrieval as R
from fathomline.operators import review as V
from fathomline.plans.search import dense_sql
from fathomline.sources.tables import read

#: SQL that both engines read: an event as a rating.
RATED = """event_id AS rating_id, CASE WHEN event_id % 13 = 0 THEN 'Summarize ' WHEN event_id % 2 = 0 THEN ' What  IS ' ELSE 'what is ' END || CASE WHEN event_id % 17 = 0 THEN '' ELSE 'number ' || user_id END AS question,
CASE WHEN event_type = 'error' THEN 'down' WHEN event_type = 'view' THEN 'none' ELSE 'up' END AS rating, CASE WHEN event_id % 11 = 0 THEN CAST(1 AS INT) END AS citation_source_number,
CASE WHEN event_id % 19 = 0 THEN NULL ELSE floor(value) END AS created_at, CASE WHEN event_id % 7 = 0 THEN 'follow_up' WHEN event_id % 7 = 1 THEN 'question' END AS kind"""


def question_set(spark: SparkSession, d: str) -> DataFrame:
    """Events as ratings: the files of an up, and where each question goes."""
    e = spark.sql(f"SELECT event_id, user_id, {RATED} FROM {{e}}", e=read(spark, d, "events"))
    files = F.when(F.col("event_id") % 5 > 0, F.transform(F.sequence(F.lit(1), F.col("event_id") % 5), lambda k: F.concat(F.lit("f"), (F.col("user_id") + k) % 3)))
    found = V.question_set(e.withColumn("cited_filenames", files))
    return found.select("kind", "question", "destination", F.array_join("relevant_filenames", ",").alias("relevant"), F.array_join("cited_filenames", ",").alias("cited"))


#: SQL that both engines read: vectors as logged questions; ten log rows ask for one vector, in one of two scopes.
LOGGED = """vec_id AS log_id, CASE WHEN vec_id % 6 = 5 THEN NULL ELSE 'Q ' || (vec_id - vec_id % 20) END AS question, CASE WHEN vec_id % 4 = 1 THEN 'q  ' || (vec_id - vec_id % 20) END AS retrieval_query,
CASE WHEN label % 2 = 0 THEN 'low' END AS scope, CASE WHEN vec_id % 9 = 0 THEN 'summary' END AS kind, CASE WHEN vec_id % 5 = 0 THEN 'answered' ELSE 'no_context' END AS status,
CASE WHEN vec_id % 8 = 3 THEN NULL ELSE CAST(0.5 + vec_id % 50 * 0.01 AS DOUBLE) END AS top_score, 'file' || vec_id % 3 AS top_filename"""


def query_recheck(spark: SparkSession, d: str) -> DataFrame:
    """Logged questions that went unanswered, each query and scope searched again once over the vectors as they are now."""
    v = read(spark, d, "embeddings")
    asked = V.to_recheck(spark.sql(f"SELECT {LOGGED} FROM {{v}}", v=v)).withColumn("vec", F.regexp_extract("query", r"(\d+)", 1).cast("long"))
    found = None
    for scope, where in (("", None), ("low", F.col("label") <= 4)):
        wanted = asked.filter(F.col("scope") == scope).select("vec").distinct()
        queries = v.join(wanted, v.vec_id == wanted.vec).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
        part = R.dense_top(v, queries, 1, where).select(F.col("query_id").alias("vec"), F.lit(scope).alias("scope"), F.col("score").alias("now_score"), F.concat(F.lit("file"), F.col("id") % 3).alias("now_filename"), (F.col("score") < 0.6).alias("weak"))
        found = part if found is None else found.unionByName(part)
    best = asked.select("query", "scope", "vec").join(found, ["vec", "scope"]).drop("vec")
    return V.rechecked(asked.drop("vec"), best).select("query", "scope", "status", F.round("top_score", 6).alias("top_score"), "asks", "now_score", "now_filename", "covered_now")


#: SQL that both engines read: events as answers to labelled questions.
ANSWERED = """user_id % 4 = 0 AS expect_no_context, event_id % 3 = 0 AS has_facts, event_id % 5 = 0 AS has_excludes, CASE WHEN value < 5 THEN 'no_context' WHEN value < 10 THEN 'insufficient_context' WHEN value < 15 THEN 'uncited' ELSE 'answered' END AS status,
CASE WHEN event_id % 2 = 0 THEN value > 12 END AS fact_hit, value > 40 AS excluded_hit, CASE WHEN event_type = 'error' THEN 'timeout' END AS error, CASE WHEN event_id % 7 > 0 THEN event_id % 7 END AS unsupported_claims, user_id % 3 AS unsupported_numbers, event_id % 11 = 0 AS truncated, event_id % 13 = 0 AS prompt_cut"""


def answer_rates(spark: SparkSession, d: str) -> DataFrame:
    """Twelve rates of answers made from events."""
    some = lambda c, m, n: F.transform(F.sequence(F.lit(0), F.col(c) % n), lambda k: (F.col(c) + k) % m)
    e = spark.sql(f"SELECT event_id, user_id, {ANSWERED} FROM {{e}}", e=read(spark, d, "events"))
    relevant = F.when(F.col("user_id") % 4 != 0, some("user_id", 9, 3))
    rows = e.withColumn("relevant_filenames", relevant).withColumn("cited_filenames", some("event_id", 9, 4)).withColumn("relevant_ids", relevant).withColumn("cited_ids", F.when(F.col("event_id") % 6 > 0, some("event_id", 5, 6)).otherwise(F.array().cast("array<bigint>")))
    return V.answer_rates(rows)


QUERIES = {f.__name__: f for f in (question_set, query_recheck, answer_rates)}
_FOLD = lambda c: f"lower(trim(regexp_replace({c}, '\\s+', ' ', 'g')))"
ORACLE = {
    "question_set": f"""WITH r AS (SELECT {RATED}, CASE WHEN event_id % 5 > 0 THEN list_transform(range(1, event_id % 5 + 1), lambda k: 'f' || (user_id + k) % 3) ELSE [] END AS cited FROM events),
q AS (SELECT *, trim(regexp_replace(question, '\\s+', ' ', 'g')) AS q, coalesce(kind, CASE WHEN starts_with(trim(question), 'Summarize ') THEN 'summary' ELSE 'question' END) AS k FROM r WHERE rating <> 'none' AND citation_source_number IS NULL),
l AS (SELECT * FROM q WHERE q <> '' QUALIFY row_number() OVER (PARTITION BY k, lower(q) ORDER BY coalesce(created_at, 0) DESC, rating_id DESC) = 1),
o AS (SELECT k AS kind, q AS question, array_to_string(list_sort(list_distinct(cited)), ',') AS cited, CASE WHEN k <> 'question' THEN 'not_a_question' WHEN rating = 'down' THEN 'review' WHEN len(cited) = 0 THEN 'uncited' ELSE 'example' END AS destination FROM l)
SELECT *, CASE WHEN destination = 'example' THEN cited ELSE '' END AS relevant FROM o""",
    "query_recheck": f"""WITH {dense_sql()}, l AS (SELECT {LOGGED} FROM embeddings),
a AS (SELECT *, coalesce(retrieval_query, question, '') AS query, coalesce(scope, '') AS sc FROM l WHERE kind IS DISTINCT FROM 'summary' AND status <> 'answered'),
g AS (SELECT arg_min(query, log_id) AS query, sc AS scope, arg_min(status, log_id) AS status, min({{'i': log_id, 's': top_score, 'f': top_filename}}) AS m, count(*) AS asks FROM a WHERE query <> '' GROUP BY {_FOLD("query")}, sc),
p AS (SELECT q.query_id, e.vec_id, e.label, round(list_inner_product(q.v, e.embedding::DOUBLE[]), 6) + 0.0 AS score FROM q, embeddings e WHERE e.vec_id <> q.query_id),
n AS (SELECT g.query, g.scope, p.vec_id, p.score FROM g JOIN p ON p.query_id = regexp_extract(g.query, '\\d+')::BIGINT AND (g.scope = '' OR p.label <= 4) QUALIFY row_number() OVER (PARTITION BY g.query, g.scope ORDER BY p.score DESC, p.vec_id) = 1)
SELECT g.query, g.scope, g.status, round(m.s, 6)::DOUBLE AS top_score, g.asks, n.score AS now_score, 'file' || n.vec_id % 3 AS now_filename,
  coalesce(n.score >= 0.6 AND (m.s IS NULL OR n.score > m.s + 0.02 OR m.f <> 'file' || n.vec_id % 3), false) AS covered_now FROM g LEFT JOIN n ON n.query = g.query AND n.scope = g.scope""",
    "answer_rates": f"""WITH e AS (SELECT {ANSWERED}, CASE WHEN user_id % 4 <> 0 THEN list_transform(range(0, user_id % 3 + 1), lambda k: (user_id + k) % 9) END AS rel, list_transform(range(0, event_id % 4 + 1), lambda k: (event_id + k) % 9) AS cit, CASE WHEN event_id % 6 > 0 THEN list_distinct(list_transform(range(0, event_id % 6 + 1), lambda k: (event_id + k) % 5)) ELSE [] END AS ids FROM events),
m AS (SELECT avg(list_has_any(cit, rel)::INT) FILTER (rel IS NOT NULL) AS cited_relevant_rate, avg((status = 'answered')::INT) FILTER (rel IS NOT NULL) AS answered_rate, avg((status IN ('no_context', 'insufficient_context'))::INT) FILTER (expect_no_context) AS refused_unanswerable_rate,
  avg(coalesce(fact_hit, false)::INT) FILTER (has_facts) AS fact_hit_rate, avg(excluded_hit::INT) FILTER (has_excludes) AS excluded_rate, avg((status = 'uncited')::INT) AS uncited_rate, avg((error IS NOT NULL)::INT) AS error_rate, avg(coalesce(unsupported_claims, 0)) AS unsupported_claims_mean, avg(unsupported_numbers) AS unsupported_numbers_mean,
  avg(truncated::INT) AS truncated_rate, avg(prompt_cut::INT) AS prompt_cut_rate, avg(len(list_intersect(ids, rel)) / len(ids)) FILTER (rel IS NOT NULL AND len(ids) > 0) AS cited_chunk_precision FROM e)
SELECT metric, round(value, 9) AS value FROM (UNPIVOT m ON COLUMNS(*) INTO NAME metric VALUE value)""",
}
