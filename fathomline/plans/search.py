"""Search queries over the tables, with their DuckDB statements.

The tables hold no passage embeddings, so the dense leg searches ``embeddings`` and the sparse leg ``documents``; where
a query pairs both, row vec_id of one stands for doc_id of the other. Queries: the rows of ``embeddings`` whose vec_id
is divisible by 20, and the texts of ``benchmark``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.operators import retrieval as R
from fathomline.settings import Settings
from fathomline.sources.tables import read


def dense_queries(vectors: DataFrame) -> DataFrame:
    return vectors.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


def sparse_queries(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    v = read(spark, d, "embeddings")
    return R.dense_top(v, dense_queries(v)).select("query_id", F.col("id").alias("vec_id"), "score", "rank")


def dense_scoped_topk(spark: SparkSession, d: str) -> DataFrame:
    """The label as scope, and excluded ids: both narrow the corpus before the limit."""
    v = read(spark, d, "embeddings")
    inside = (F.col("label") <= 4) & ~F.col("vec_id").isin(1, 2, 3)
    return R.dense_top(v, dense_queries(v), 10, inside).select("query_id", F.col("id").alias("vec_id"), "score", "rank")


def more_like_this(spark: SparkSession, d: str) -> DataFrame:
    """A stored row as the query: its label's nearest rows, itself left out."""
    v = read(spark, d, "embeddings")
    near = R.dense_top(v, dense_queries(v), 8).join(v.select(F.col("vec_id").alias("id"), "label"), "id")
    return near.select("query_id", F.col("id").alias("vec_id"), "label", "score", "rank")


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return R.bm25_top(read(spark, d, "documents"), sparse_queries(spark, d)).select("query_id", F.col("id").alias("doc_id"), "score", "rank")


def bm25_scoped_topk(spark: SparkSession, d: str) -> DataFrame:
    """Only English documents are ranked; term statistics stay those of the whole table."""
    return R.bm25_top(read(spark, d, "documents"), sparse_queries(spark, d), 10, F.col("lang") == "en").select("query_id", F.col("id").alias("doc_id"), "score", "rank")


def legs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Both legs under one query numbering: the k-th dense query is paired with benchmark item k."""
    v = read(spark, d, "embeddings")
    dense = R.dense_top(v, dense_queries(v)).withColumn("query_id", (F.col("query_id") / 20).cast("long"))
    return dense, R.bm25_top(read(spark, d, "documents"), sparse_queries(spark, d))


def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    """Both legs fused, with each row's place in either leg."""
    dense, sparse = legs(spark, d)
    return R.leg_ranks(R.fuse([dense, sparse], 10), dense, sparse).select("query_id", "id", "score", "best_rank", "rank", "dense_rank", "sparse_rank")


def rrf_multi_query(spark: SparkSession, d: str) -> DataFrame:
    """Each benchmark text in two variants (all words; its first sentence), fused a second time over the fused lists."""
    docs, asked = read(spark, d, "documents"), sparse_queries(spark, d)
    first = asked.withColumn("text", F.regexp_extract("text", r"^([^.]*)", 1))
    lists = [R.fuse([R.bm25_top(docs, q)]) for q in (asked, first)]
    return R.fuse(lists, 10).select("query_id", F.col("id").alias("doc_id"), "score", "best_rank", "rank")


def reranked(spark: SparkSession, d: str) -> DataFrame:
    """Dense candidates with a stand-in logit (eight times the score, less two)."""
    v = read(spark, d, "embeddings")
    return R.rerank(R.dense_top(v, dense_queries(v)), F.col("score") * 8 - 2)


def score_floor_fallback(spark: SparkSession, d: str) -> DataFrame:
    kept = R.kept_above(reranked(spark, d), Settings(rerank_min_score=0.6))
    return kept.select("query_id", F.col("id").alias("vec_id"), "rerank", "rerank_rank", "weak")


def relative_cut(spark: SparkSession, d: str) -> DataFrame:
    scored = reranked(spark, d)
    kept = R.relative_cut(scored, R.kept_above(scored), 0.35)
    return kept.select("query_id", F.col("id").alias("vec_id"), "rerank", "rerank_rank")


def recency_boost(spark: SparkSession, d: str) -> DataFrame:
    """Kept rows dated by id: one day for each, every seventh undated."""
    kept = R.kept_above(reranked(spark, d)).withColumn("uploaded_at", F.when(F.col("id") % 7 != 0, F.col("id") * 86400.0))
    return R.recency_order(kept, 0.5).select("query_id", F.col("id").alias("vec_id"), "boosted", "recency_rank")


def diversity_select(spark: SparkSession, d: str) -> DataFrame:
    """BM25 candidates, read as passages of their source, without near repeats of better ones."""
    docs = read(spark, d, "documents")
    found = R.bm25_top(docs, sparse_queries(spark, d), 20)
    rows = R.rerank(found, F.col("score") / 10 - 1).join(docs.select(F.col("doc_id").alias("id"), F.col("source").alias("filename"), F.col("doc_id").alias("ordinal"), "text"), "id")
    return R.diverse(rows).select("query_id", F.col("id").alias("doc_id"), "rerank", "kept_rank")


def candidate_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Three-word Jaccard of each query's ten best documents with its best one."""
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("id"), R.shingles(F.col("text")).alias("s"))
    rows = R.bm25_top(read(spark, d, "documents"), sparse_queries(spark, d), 10).join(docs, "id")
    best = rows.filter("rank = 1").select("query_id", F.col("s").alias("best"))
    return rows.join(best, "query_id").select("query_id", F.col("id").alias("doc_id"), F.round(R.jaccard(F.col("s"), F.col("best")), 6).alias("jaccard"))


DENSE = """
q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 20 = 0),
dense AS (
  SELECT * FROM (
    SELECT query_id, vec_id AS id, label, round(list_inner_product(q.v, e.embedding::DOUBLE[]), 6) + 0.0 AS score,
      row_number() OVER (PARTITION BY query_id ORDER BY round(list_inner_product(q.v, e.embedding::DOUBLE[]), 6) DESC, vec_id) AS rank
    FROM q, embeddings e WHERE e.vec_id <> q.query_id {where}) WHERE rank <= {limit})"""


def dense_sql(limit: int = 50, where: str = "") -> str:
    return DENSE.format(limit=limit, where=where)


def bm25_sql(name: str = "sparse", queries: str = "benchmark", limit: int = 50, where: str = "TRUE") -> str:
    return rf"""
{name}_terms AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')) AS term FROM {queries}),
{name}_tokens AS (SELECT doc_id, lang, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}_]+') AS w FROM documents),
{name}_facts AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM {name}_tokens),
{name}_tf AS (SELECT doc_id, lang, len(w) AS length, term, count(*) AS tf FROM (SELECT doc_id, lang, w, unnest(w) AS term FROM {name}_tokens) GROUP BY ALL),
{name}_idf AS (SELECT term, ln(1 + ((SELECT n FROM {name}_facts) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM {name}_tf GROUP BY term),
{name}_scores AS (
  SELECT query_id, doc_id AS id, round(sum(idf * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * length / (SELECT mean FROM {name}_facts)))), 6) AS score
  FROM {name}_tf JOIN {name}_idf USING (term) JOIN {name}_terms USING (term) WHERE {where} GROUP BY ALL),
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM {name}_scores) WHERE rank <= {limit})"""


FUSED = """
fused AS (
  SELECT query_id, id, round(sum(1.0 / (60 + rank - 1)), 9) AS score, min(rank - 1) AS best_rank FROM ({legs}) GROUP BY ALL),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, best_rank, id) AS rank FROM fused) WHERE rank <= {limit})"""

RERANKED = """
scored AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank DESC, score DESC, id) AS rerank_rank
  FROM (SELECT *, round(1 / (1 + exp(-(score * 8 - 2))), 6) AS rerank FROM dense))"""

KEPT = """
flagged AS (SELECT *, max(rerank >= {floor}) OVER (PARTITION BY query_id) AS any_good FROM scored),
kept AS (SELECT *, NOT any_good AS weak FROM flagged WHERE CASE WHEN any_good THEN rerank >= {floor} AND rerank_rank <= 8 ELSE rerank_rank <= 3 END)"""

SHINGLES = r"""
w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM documents),
shingled AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(w) - 2, 1) + 1), lambda k: array_to_string(w[k:k + 2], ' '))) END AS s FROM w)"""

QUERIES = {f.__name__: f for f in (dense_topk, dense_scoped_topk, more_like_this, bm25_topk, bm25_scoped_topk, hybrid_search, rrf_multi_query, score_floor_fallback, relative_cut, recency_boost, diversity_select, candidate_similarity)}

ORACLE = {
    "dense_topk": f"WITH {dense_sql()} SELECT query_id, id AS vec_id, score, rank FROM dense",
    "dense_scoped_topk": f"WITH {dense_sql(10, 'AND label <= 4 AND vec_id NOT IN (1, 2, 3)')} SELECT query_id, id AS vec_id, score, rank FROM dense",
    "more_like_this": f"WITH {dense_sql(8)} SELECT query_id, id AS vec_id, label, score, rank FROM dense",
    "bm25_topk": f"WITH {bm25_sql()} SELECT query_id, id AS doc_id, score, rank FROM sparse",
    "bm25_scoped_topk": f"WITH {bm25_sql(limit=10, where=chr(39).join(('lang = ', 'en', '')))} SELECT query_id, id AS doc_id, score, rank FROM sparse",
    "hybrid_search": f"""WITH {dense_sql()}, numbered AS (SELECT query_id // 20 AS query_id, id, score, rank FROM dense), {bm25_sql()},
{FUSED.format(legs="SELECT query_id, id, rank FROM numbered UNION ALL SELECT query_id, id, rank FROM sparse", limit=10)}
SELECT t.query_id, t.id, t.score, t.best_rank, t.rank, n.rank AS dense_rank, s.rank AS sparse_rank
FROM top t LEFT JOIN numbered n ON n.query_id = t.query_id AND n.id = t.id LEFT JOIN sparse s ON s.query_id = t.query_id AND s.id = t.id""",
    "rrf_multi_query": f"""WITH firsts AS (SELECT item_id, regexp_extract(text, '^([^.]*)', 1) AS text FROM benchmark), {bm25_sql("a")}, {bm25_sql("b", "firsts")},
{FUSED.format(legs="SELECT query_id, id, rank FROM a UNION ALL SELECT query_id, id, rank FROM b", limit=10)}
SELECT query_id, id AS doc_id, score, best_rank, rank FROM top""",
    "score_floor_fallback": f"WITH {dense_sql()}, {RERANKED}, {KEPT.format(floor=0.6)} SELECT query_id, id AS vec_id, rerank, rerank_rank, weak FROM kept",
    "relative_cut": f"""WITH {dense_sql()}, {RERANKED}, {KEPT.format(floor=0.15)},
level AS (SELECT query_id, quantile_cont(rerank, 0.5) AS median, max(rerank) AS top FROM scored GROUP BY query_id),
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_rank) AS place, count(*) OVER (PARTITION BY query_id) AS n FROM kept JOIN level USING (query_id))
SELECT query_id, id AS vec_id, rerank, rerank_rank FROM placed WHERE place <= 2 OR n <= 2 OR top - median <= 1e-9 OR (rerank - median) / (top - median) >= 0.35""",
    "recency_boost": f"""WITH {dense_sql()}, {RERANKED}, {KEPT.format(floor=0.15)},
dated AS (SELECT *, CASE WHEN id % 7 <> 0 THEN id * 86400.0::DOUBLE END AS t FROM kept),
aged AS (SELECT *, (max(t) OVER (PARTITION BY query_id) - t) / (365 * 86400.0::DOUBLE) AS age, count(t) OVER (PARTITION BY query_id) AS n FROM dated),
lifted AS (SELECT *, round(rerank + CASE WHEN n >= 2 THEN coalesce(0.5::DOUBLE * greatest(0.0::DOUBLE, 1 - age), 0) ELSE 0 END, 6) AS boosted FROM aged)
SELECT query_id, id AS vec_id, boosted, row_number() OVER (PARTITION BY query_id ORDER BY boosted DESC, rerank_rank) AS recency_rank FROM lifted""",
    "candidate_similarity": f"""WITH {bm25_sql(limit=10)}, {SHINGLES},
rows AS (SELECT query_id, id, rank, s FROM sparse JOIN shingled ON doc_id = id),
best AS (SELECT query_id, s AS b FROM rows WHERE rank = 1)
SELECT query_id, id AS doc_id, CASE WHEN len(list_distinct(list_concat(s, b))) > 0 THEN round(len(list_intersect(s, b)) / len(list_distinct(list_concat(s, b)))::DOUBLE, 6) ELSE 0.0 END AS jaccard
FROM rows JOIN best USING (query_id)""",
}
