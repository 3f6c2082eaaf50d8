"""Queries on metrics, bars, runs and traces, with their DuckDB statements. A row is relevant if it has its query's label."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathomline.operators import evaluation as E
from fathomline.operators import retrieval as R
from fathomline.plans.search import RERANKED, dense_queries, dense_sql, reranked
from fathomline.settings import Settings
from fathomline.sources.tables import read

KS = (1, 3, 10)


def judged(spark: SparkSession, d: str, limit: int = 10) -> tuple[DataFrame, DataFrame]:
    """Dense rankings with relevance, and each query's number of relevant rows."""
    v = read(spark, d, "embeddings")
    label = v.select(F.col("vec_id").alias("id"), "label")
    own = v.select(F.col("vec_id").alias("query_id"), F.col("label").alias("own"))
    ranked = R.dense_top(v, dense_queries(v), limit).join(label, "id").join(own, "query_id").select("query_id", F.col("id").alias("item"), "rank", "score", "own", (F.col("label") == F.col("own")).alias("relevant"))
    sizes = v.groupBy("label").agg((F.count(F.lit(1)) - 1).alias("total"))
    return ranked, own.join(sizes.withColumnRenamed("label", "own"), "own").select("query_id", "total")


def ir_metrics(spark: SparkSession, d: str) -> DataFrame:
    return E.ranking_metrics(*judged(spark, d), KS)


def metrics_by_group(spark: SparkSession, d: str) -> DataFrame:
    """Means over all queries and by label: two grouping sets."""
    ranked, total = judged(spark, d)
    m = E.ranking_metrics(ranked, total, KS).join(ranked.select("query_id", "own").distinct(), "query_id")
    cols = ["reciprocal_rank", "hit_1", "hit_3", "recall_10", "ndcg_10"]
    return m.groupingSets([["own"], []], "own").agg(F.count(F.lit(1)).alias("queries"), *[F.round(F.avg(c), 6).alias(c) for c in cols])


def score_histogram(spark: SparkSession, d: str) -> DataFrame:
    return E.histogram(judged(spark, d)[0], "score", "relevant").select("relevant", "bin", "n")


def best_bar(spark: SparkSession, d: str) -> DataFrame:
    return E.best_bar(judged(spark, d)[0], "score", "relevant")


def calibrated_bar(spark: SparkSession, d: str) -> DataFrame:
    return E.calibrated_bar(judged(spark, d)[0], "score", "relevant").select(F.round("bar", 9).alias("bar"), "wrong")


def score_report(spark: SparkSession, d: str) -> DataFrame:
    """Sides by best score, a rating (every third query) over the label, and how many a bar of 0.4 instead of 0.3 would change."""
    ranked, _ = judged(spark, d)
    top = ranked.groupBy("query_id").agg(F.max("score").alias("score"), F.max(F.col("relevant").cast("int")).alias("model"))
    rated = top.withColumn("rating", F.when(F.col("query_id") % 3 == 0, (F.col("query_id") % 2 == 0).cast("int")))
    side = rated.withColumn("answered", F.coalesce("rating", "model") == 1)
    return side.groupBy("answered").agg(F.count(F.lit(1)).alias("questions"), F.round(F.avg("score"), 6).alias("mean_score"), F.sum(F.when((F.col("score") >= 0.3) & (F.col("score") < 0.4), 1).otherwise(0)).alias("would_change"), F.count("rating").alias("rated"))


def sweep_grid(spark: SparkSession, d: str) -> DataFrame:
    """Floors by kept rows, replayed over one retrieval: what each pair keeps, and how many queries it refuses."""
    grid = spark.range(1).select(F.explode(F.array(*map(F.lit, (0.3, 0.5, 0.7)))).alias("floor")).withColumn("top_k", F.explode(F.array(*map(F.lit, (1, 3, 8)))))
    each = reranked(spark, d).crossJoin(F.broadcast(grid))  # nine rows
    keep = (F.col("rerank") >= F.col("floor")) & (F.col("rerank_rank") <= F.col("top_k"))
    by_query = each.groupBy("floor", "top_k", "query_id").agg(F.sum(keep.cast("int")).alias("kept"))
    return by_query.groupBy("floor", "top_k").agg(F.sum("kept").alias("kept"), F.sum((F.col("kept") == 0).cast("int")).alias("refused"))


def run_diff(spark: SparkSession, d: str) -> DataFrame:
    """Recall at 10 of the whole corpus against one without every third row; some queries are in one run only."""
    v = read(spark, d, "embeddings")
    ranked, total = judged(spark, d)
    part = v.filter("vec_id % 3 <> 1")
    label = v.select(F.col("vec_id").alias("id"), "label")
    own = v.select(F.col("vec_id").alias("query_id"), F.col("label").alias("own"))
    other = R.dense_top(part, dense_queries(v), 10).join(label, "id").join(own, "query_id").select("query_id", F.col("id").alias("item"), "rank", (F.col("label") == F.col("own")).alias("relevant"))
    a = E.ranking_metrics(ranked.filter("query_id % 7 <> 1"), total, (10,))
    b = E.ranking_metrics(other.filter("query_id % 7 <> 2"), total, (10,))
    return E.run_diff(a, b, "query_id", "recall_10")


def metric_gate(spark: SparkSession, d: str) -> DataFrame:
    """Mean metrics of the run against those of the first rank only, lowered by a tolerance."""
    ranked, total = judged(spark, d)
    m = E.ranking_metrics(ranked, total, (1, 10)).agg(*[F.round(F.avg(c), 6).alias(c) for c in ("reciprocal_rank", "hit_1", "ndcg_10")])
    long = m.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in m.columns])).alias("x")).select("x.*")
    base = long.withColumn("value", F.round(F.col("value") + F.when(F.col("metric") == "hit_1", 0.2).otherwise(0.0), 6)).withColumn("higher_is_better", F.lit(True))
    return E.gate(long, base, 0.06)


def bootstrap(spark: SparkSession, d: str) -> DataFrame:
    ranked, _ = judged(spark, d)
    pairs = ranked.groupBy("query_id").agg((F.max(F.when(F.col("rank") == 1, F.col("score"))) - F.max(F.when(F.col("rank") == 2, F.col("score")))).alias("delta"))
    return E.bootstrap(pairs, "query_id", "delta", 400, 3)


def traces(spark: SparkSession, d: str, floor: float) -> DataFrame:
    v = read(spark, d, "embeddings")
    fused = R.dense_top(v, dense_queries(v))
    scored = R.rerank(fused, F.col("score") * 8 - 2, Settings(rerank_candidates=40))
    kept = R.kept_above(scored, Settings(rerank_min_score=floor)).filter("not weak").withColumn("kept_rank", F.col("rerank_rank"))
    return E.drop_reason(fused, scored, kept, floor, 6)


def trace_assembly(spark: SparkSession, d: str) -> DataFrame:
    return traces(spark, d, 0.3).select("query_id", F.col("id").alias("vec_id"), "rank", "rerank", "drop_reason")


def trace_diff(spark: SparkSession, d: str) -> DataFrame:
    return E.trace_diff(traces(spark, d, 0.3), traces(spark, d, 0.5)).select("query_id", F.col("id").alias("vec_id"), "drop_reason_a", "drop_reason_b")


#: Of the full trace: how many texts, a relative floor, passages in the prompt and its budget by stand-in sizes.
TEXTS, FLOOR, RELATIVE, CONTEXT, BUDGET = 12, 0.3, 0.35, 6, 1500


def full_trace(spark: SparkSession, d: str) -> DataFrame:
    """Dense candidates through rerank, diversity, the relative floor and a prompt's budget; texts are equal or unlike, by id.

    The candidates (some fifty rows a query) are read by every step, so they are kept.
    """
    v, keys = read(spark, d, "embeddings"), ["query_id", "id"]
    settings = Settings(rerank_candidates=40, rerank_min_score=FLOOR)
    fused = R.dense_top(v, dense_queries(v)).persist()
    scored = R.rerank(fused, F.col("score") * 8 - 2, settings)
    text = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(8)), lambda k: F.concat(F.lit("word"), F.col("id") % TEXTS * 10 + k)), " ")
    rich = scored.withColumn("text", text).withColumn("filename", F.lit("f")).withColumn("ordinal", F.lit(0))
    picked = R.diverse(rich, settings).select(*keys, "rerank", "rerank_rank", F.col("kept_rank").alias("pick"))
    ends = picked.groupBy("query_id").agg(F.max("rerank_rank").alias("last"), F.count("*").alias("n"))
    near = scored.filter(F.col("rerank") >= FLOOR).join(picked.select(*keys), keys, "left_anti").join(ends, "query_id").filter((F.col("n") < settings.rerank_top_k) | (F.col("rerank_rank") < F.col("last")))
    left = R.relative_cut(scored, picked, RELATIVE)
    kept = left.withColumn("kept_rank", F.row_number().over(Window.partitionBy("query_id").orderBy("pick")).cast("long"))
    size = F.sum((F.col("id") % 5 + 1) * 100).over(Window.partitionBy("query_id").orderBy("kept_rank"))
    over = kept.filter(F.col("kept_rank") <= CONTEXT).withColumn("used", size).filter(F.col("used") > BUDGET)
    return E.drop_reason(fused, scored, kept, FLOOR, CONTEXT, near, picked.join(left.select(*keys), keys, "left_anti"), over)


def trace_reasons(spark: SparkSession, d: str) -> DataFrame:
    return full_trace(spark, d).select("query_id", F.col("id").alias("vec_id"), "rank", "rerank", "kept_rank", "drop_reason")


def explained(spark: SparkSession, d: str) -> DataFrame:
    """What became of eight files in each query: files hold the vectors of one label or, without any candidate, none."""
    files = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.concat(F.lit("file"), F.col("vec_id") % 40).alias("filename"))
    queries = read(spark, d, "embeddings").filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"))
    asked = queries.select("query_id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.concat(F.lit("file"), k * 7))).alias("filename"))
    return E.explained(full_trace(spark, d), files, asked).withColumnRenamed("id", "vec_id")


def even_sample(spark: SparkSession, d: str) -> DataFrame:
    """Seven lines of each document, spread from its first to its last."""
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"\S"))
    docs = read(spark, d, "documents").select("doc_id", F.size(lines).cast("long").alias("n")).filter("n > 0")
    return docs.select("doc_id", F.explode(E.even_positions(F.col("n"), 7)).alias("position"))


JUDGED = f"""{dense_sql(10)},
own AS (SELECT vec_id AS query_id, label AS own FROM embeddings),
judged AS (SELECT d.query_id, d.id AS item, d.rank, d.score, o.own, d.label = o.own AS relevant FROM dense d JOIN own o USING (query_id)),
totals AS (SELECT query_id, total FROM own JOIN (SELECT label AS own, count(*) - 1 AS total FROM embeddings GROUP BY label) USING (own))"""


def metrics_sql(ks: tuple[int, ...] = KS, source: str = "judged") -> str:
    parts = []
    for k in ks:
        ideal = f"list_sum(list_transform(range(1, greatest(least(total, {k}), 1) + 1), lambda i: 1 / log2(i + 1)))"
        parts.append(f"max(CASE WHEN relevant AND rank <= {k} THEN 1.0 ELSE 0.0 END)::DOUBLE AS hit_{k}")
        parts.append(f"CASE WHEN any_value(total) > 0 THEN round(sum(CASE WHEN relevant AND rank <= {k} THEN 1 ELSE 0 END) / any_value(total)::DOUBLE, 6) ELSE 0.0 END AS recall_{k}")
        parts.append(f"CASE WHEN any_value(total) > 0 THEN round(sum(CASE WHEN relevant AND rank <= {k} THEN 1 / log2(rank + 1) ELSE 0 END) / any_value({ideal}), 6) ELSE 0.0 END AS ndcg_{k}")
    return f"SELECT query_id, any_value(total) AS total, coalesce(round(1 / min(CASE WHEN relevant THEN rank END)::DOUBLE, 6), 0.0) AS reciprocal_rank, {', '.join(parts)} FROM {source} JOIN totals USING (query_id) GROUP BY query_id"


BARS = """
counts AS (SELECT score AS s, sum(relevant::INT)::BIGINT AS a, sum((NOT relevant)::INT)::BIGINT AS u FROM judged GROUP BY 1),
bars AS (SELECT (s + lead(s) OVER w) / 2 AS bar, lead(s) OVER w - s AS gap, (sum(a) OVER w + coalesce(sum(u) OVER (ORDER BY s ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0))::BIGINT AS wrong FROM counts WINDOW w AS (ORDER BY s))"""


def trace_sql(name: str, floor: float) -> str:
    return f"""
{name} AS (
  SELECT d.query_id, d.id, d.rank, s.rerank, CASE WHEN s.rerank IS NULL THEN 'not_scored' WHEN s.rerank < {floor} THEN 'below_min_score' WHEN s.rerank_rank > 8 THEN 'top_k_cut' WHEN s.rerank_rank > 6 THEN 'context_limit' END AS drop_reason
  FROM dense d LEFT JOIN scored40 s ON s.query_id = d.query_id AND s.id = d.id)"""


SCORED40 = """
scored40 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank DESC, score DESC, id) AS rerank_rank FROM (SELECT *, round(1 / (1 + exp(-(score * 8 - 2))), 6) AS rerank FROM dense WHERE rank <= 40))"""

FULL = f"""
el AS (SELECT *, id % {TEXTS} AS t FROM scored40 WHERE rerank >= {FLOOR}),
pick AS (SELECT * FROM (SELECT query_id, id, rerank, rerank_rank, row_number() OVER (PARTITION BY query_id ORDER BY rerank_rank) AS pick FROM (SELECT *, row_number() OVER (PARTITION BY query_id, t ORDER BY rerank_rank) AS o FROM el) WHERE o = 1) WHERE pick <= 8),
fin AS (SELECT query_id, max(rerank_rank) AS last, count(*) AS n FROM pick GROUP BY 1),
lev AS (SELECT query_id, quantile_cont(rerank, 0.5) AS med, max(rerank) AS top FROM scored40 GROUP BY 1),
kept AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY pick) AS kept_rank FROM pick JOIN lev USING (query_id) JOIN fin USING (query_id) WHERE pick <= 2 OR n <= 2 OR top - med <= 1e-9 OR (rerank - med) / (top - med) >= {RELATIVE}),
used AS (SELECT *, sum((id % 5 + 1) * 100) OVER (PARTITION BY query_id ORDER BY kept_rank) AS used FROM kept),
trace AS (SELECT d.query_id, d.id, d.rank, s.rerank, s.rerank_rank, k.kept_rank, CASE WHEN k.kept_rank IS NOT NULL THEN CASE WHEN k.kept_rank <= {CONTEXT} AND k.used > {BUDGET} THEN 'context_budget' WHEN k.kept_rank > {CONTEXT} THEN 'context_limit' END
    WHEN s.rerank IS NULL THEN 'not_scored' WHEN s.rerank < {FLOOR} THEN 'below_min_score' WHEN p.pick IS NOT NULL THEN 'relative_cut' WHEN n < 8 OR s.rerank_rank < last THEN 'near_duplicate' ELSE 'top_k_cut' END AS drop_reason
  FROM dense d LEFT JOIN scored40 s USING (query_id, id) LEFT JOIN used k USING (query_id, id) LEFT JOIN pick p USING (query_id, id) LEFT JOIN fin USING (query_id))"""

STEPS = "0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183"

QUERIES = {f.__name__: f for f in (ir_metrics, metrics_by_group, score_histogram, best_bar, calibrated_bar, score_report, sweep_grid, run_diff, metric_gate, bootstrap, trace_assembly, trace_diff, trace_reasons, explained, even_sample)}

ORACLE = {
    "ir_metrics": f"WITH {JUDGED} {metrics_sql()}",
    "metrics_by_group": f"""WITH {JUDGED}, m AS ({metrics_sql()}), o AS (SELECT DISTINCT query_id, own FROM judged)
SELECT own, count(*) AS queries, {", ".join(f"round(avg({c}), 6) AS {c}" for c in ("reciprocal_rank", "hit_1", "hit_3", "recall_10", "ndcg_10"))} FROM m JOIN o USING (query_id) GROUP BY GROUPING SETS ((own), ())""",
    "score_histogram": f"""WITH {JUDGED}, b AS (SELECT relevant, least(greatest(floor(score * 20), 0), 19)::BIGINT AS bin, count(*) AS n FROM judged GROUP BY ALL),
spine AS (SELECT relevant, unnest(range(20)) AS bin FROM (SELECT DISTINCT relevant FROM b)) SELECT s.relevant, s.bin, coalesce(b.n, 0) AS n FROM spine s LEFT JOIN b ON b.relevant = s.relevant AND b.bin = s.bin""",
    "best_bar": f"""WITH {JUDGED}, {BARS} SELECT bar, wrong FROM (SELECT bar, wrong FROM bars WHERE bar IS NOT NULL
UNION ALL SELECT 0.0, count(*) FROM judged WHERE (NOT relevant AND score >= 0) OR (relevant AND score < 0) UNION ALL SELECT 1.0, count(*) FROM judged WHERE (NOT relevant AND score >= 1) OR (relevant AND score < 1)) ORDER BY wrong, bar LIMIT 1""",
    "calibrated_bar": f"""WITH {JUDGED}, {BARS} SELECT round(bar, 9) AS bar, wrong FROM (SELECT bar, gap, wrong FROM bars WHERE bar IS NOT NULL
UNION ALL SELECT min(score) - 1e-6, 1e-6, count(*) FILTER (NOT relevant) FROM judged UNION ALL SELECT max(score) + 1e-6, 1e-6, count(*) FILTER (relevant) FROM judged) ORDER BY wrong, gap DESC, bar LIMIT 1""",
    "score_report": f"""WITH {JUDGED}, top AS (SELECT query_id, max(score) AS score, max(relevant::INT) AS model FROM judged GROUP BY 1),
rated AS (SELECT *, CASE WHEN query_id % 3 = 0 THEN (query_id % 2 = 0)::INT END AS rating FROM top)
SELECT coalesce(rating, model) = 1 AS answered, count(*) AS questions, round(avg(score), 6) AS mean_score, count(*) FILTER (score >= 0.3 AND score < 0.4) AS would_change, count(rating) AS rated FROM rated GROUP BY 1""",
    "sweep_grid": f"""WITH {dense_sql()}, {RERANKED}, grid AS (SELECT unnest([0.3, 0.5, 0.7])::DOUBLE AS floor), ks AS (SELECT unnest([1, 3, 8]) AS top_k),
each AS (SELECT floor, top_k, query_id, sum((rerank >= floor AND rerank_rank <= top_k)::INT)::BIGINT AS kept FROM scored, grid, ks GROUP BY ALL)
SELECT floor, top_k, sum(kept)::BIGINT AS kept, count(*) FILTER (kept = 0) AS refused FROM each GROUP BY ALL""",
    "run_diff": f"""WITH {JUDGED}, part AS (SELECT * FROM (
    SELECT query_id, vec_id AS item, label, row_number() OVER (PARTITION BY query_id ORDER BY round(list_inner_product(q.v, e.embedding::DOUBLE[]), 6) DESC, vec_id) AS rank
    FROM q, embeddings e WHERE e.vec_id <> q.query_id AND e.vec_id % 3 <> 1) WHERE rank <= 10),
other AS (SELECT p.query_id, p.item, p.rank, p.label = o.own AS relevant FROM part p JOIN own o USING (query_id) WHERE p.query_id % 7 <> 2),
mine AS (SELECT * FROM judged WHERE query_id % 7 <> 1), a AS ({metrics_sql((10,), "mine")}), b AS ({metrics_sql((10,), "other")})
SELECT coalesce(a.query_id, b.query_id) AS query_id, a.recall_10 AS before, b.recall_10 AS after, CASE WHEN b.recall_10 IS NULL THEN 'only_before' WHEN a.recall_10 IS NULL THEN 'only_after'
  WHEN b.recall_10 > a.recall_10 THEN 'improved' WHEN b.recall_10 < a.recall_10 THEN 'regressed' ELSE 'same' END AS change FROM a FULL JOIN b ON a.query_id = b.query_id""",
    "metric_gate": f"""WITH {JUDGED}, m AS ({metrics_sql((1, 10))}), l AS (SELECT 'reciprocal_rank' AS metric, round(avg(reciprocal_rank), 6) AS value FROM m UNION ALL SELECT 'hit_1', round(avg(hit_1), 6) FROM m UNION ALL SELECT 'ndcg_10', round(avg(ndcg_10), 6) FROM m),
b AS (SELECT metric, value AS current, round(value + CASE WHEN metric = 'hit_1' THEN 0.2 ELSE 0 END, 6) AS baseline FROM l) SELECT metric, current, baseline, baseline - current > 0.06 + 1e-9 AS regressed FROM b""",
    "bootstrap": f"""WITH {JUDGED}, pairs AS (SELECT query_id, max(score) FILTER (rank = 1) - max(score) FILTER (rank = 2) AS delta FROM judged GROUP BY 1),
drawn AS (SELECT query_id, delta, r, ('0x' || left(md5(query_id || ':' || r || ':3'), 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM pairs, range(1, 401) t(r)),
times AS (SELECT *, list_sum(list_transform([{STEPS}]::DOUBLE[], lambda s: (u >= s)::INT)) AS t FROM drawn), means AS (SELECT r, sum(t * delta) / sum(t) AS m FROM times GROUP BY r)
SELECT (SELECT round(avg(delta), 9) FROM pairs) AS mean_delta, round(quantile_disc(m, 0.025), 9) AS low, round(quantile_disc(m, 0.975), 9) AS high FROM means""",
    "trace_assembly": f"WITH {dense_sql()}, {SCORED40}, {trace_sql('t', 0.3)} SELECT query_id, id AS vec_id, rank, rerank, drop_reason FROM t",
    "trace_diff": f"""WITH {dense_sql()}, {SCORED40}, {trace_sql("a", 0.3)}, {trace_sql("b", 0.5)}
SELECT a.query_id, a.id AS vec_id, a.drop_reason AS drop_reason_a, b.drop_reason AS drop_reason_b FROM a JOIN b ON a.query_id = b.query_id AND a.id = b.id WHERE a.drop_reason IS DISTINCT FROM b.drop_reason""",
    "trace_reasons": f"WITH {dense_sql()}, {SCORED40}, {FULL} SELECT query_id, id AS vec_id, rank, rerank, kept_rank, drop_reason FROM trace",
    "explained": f"""WITH {dense_sql()}, {SCORED40}, {FULL},
c AS (SELECT *, 'file' || id % 40 AS filename, CASE WHEN kept_rank IS NOT NULL THEN 'returned' WHEN drop_reason IN ('near_duplicate', 'below_min_score', 'not_scored') THEN drop_reason ELSE 'past_top_k' END AS outcome FROM trace),
b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY query_id, filename ORDER BY list_position(['returned', 'past_top_k', 'near_duplicate', 'below_min_score', 'not_scored'], outcome), coalesce(kept_rank, 0), coalesce(rerank, 0) DESC, rank) = 1),
a AS (SELECT vec_id AS query_id, 'file' || k * 7 AS filename FROM embeddings, range(8) t(k) WHERE vec_id % 20 = 0)
SELECT query_id, filename, coalesce(outcome, 'not_retrieved') AS outcome, id AS vec_id, rank, rerank_rank, kept_rank AS returned_rank FROM a LEFT JOIN b USING (query_id, filename)""",
    "even_sample": r"""WITH n AS (SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\S')))::BIGINT AS n FROM documents)
SELECT doc_id, unnest(CASE WHEN n <= 7 THEN range(n) ELSE list_distinct(list_transform(range(7), lambda p: round_even(p * (n - 1) / 6.0, 0)::BIGINT)) END) AS position FROM n WHERE n > 0""",
}
