"""Ranking metrics, relevance bars, reports and comparisons of runs. All questions of a run are one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Steps of score histograms; scores are told to six places, so distinct ones are a million at most.
BINS = 20


def ranking_metrics(ranked: DataFrame, relevant_total: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """One row a query: reciprocal rank, and hit, recall and nDCG at each k.

    ranked: query_id, rank from 1, item, relevant (boolean); relevant_total: query_id, total distinct relevant items.
    Recall counts distinct items, nDCG a repeated item once, at its first place; hit and reciprocal rank do not look.
    """
    first = F.row_number().over(Window.partitionBy("query_id", "item").orderBy("rank")) == 1
    each = ranked.withColumn("once", F.col("relevant") & first)
    aggs = [F.coalesce(F.round(1 / F.min(F.when(F.col("relevant"), F.col("rank"))), 6), F.lit(0.0)).alias("reciprocal_rank")]
    for k in ks:
        inside = F.col("rank") <= k
        aggs.append(F.max(F.when(F.col("relevant") & inside, 1.0).otherwise(0.0)).alias(f"hit_{k}"))
        aggs.append(F.sum(F.when(F.col("once") & inside, 1).otherwise(0)).alias(f"n_{k}"))
        aggs.append(F.sum(F.when(F.col("once") & inside, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias(f"g_{k}"))
    out = each.groupBy("query_id").agg(*aggs).join(relevant_total, "query_id")
    for k in ks:
        ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(F.col("total"), F.lit(k)), F.lit(1)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + F.lit(1)))
        out = out.withColumn(f"recall_{k}", F.when(F.col("total") > 0, F.round(F.col(f"n_{k}") / F.col("total"), 6)).otherwise(0.0))
        out = out.withColumn(f"ndcg_{k}", F.when(F.col("total") > 0, F.round(F.col(f"g_{k}") / ideal, 6)).otherwise(0.0)).drop(f"n_{k}", f"g_{k}")
    return out


def histogram(scored: DataFrame, score: str, side: str) -> DataFrame:
    """(side, bin, n) over all bins of [0, 1], empty ones included; scores beyond go to the outer bins."""
    at = F.least(F.greatest(F.floor(F.col(score) * BINS), F.lit(0)), F.lit(BINS - 1)).cast("long")
    counts = scored.groupBy(side, at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    spine = counts.select(side).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(BINS - 1).cast("long"))))
    return spine.join(counts, [side, "bin"], "left").select(side, "bin", F.coalesce("n", F.lit(0)).alias("n"))


def bars(scored: DataFrame, score: str, answered: str) -> DataFrame:
    """(bar, wrong, gap) of every bar midway between two neighbouring scores: answered below it, unanswered at or above.

    Works on counts by distinct score, so its windows see a million rows at most whatever the table holds.
    """
    counts = scored.groupBy(F.col(score).alias("s")).agg(F.sum(F.when(F.col(answered), 1).otherwise(0)).alias("a"), F.sum(F.when(F.col(answered), 0).otherwise(1)).alias("u"))
    up = Window.orderBy("s")
    return counts.select(
        ((F.col("s") + F.lead("s").over(up)) / 2).alias("bar"), (F.lead("s").over(up) - F.col("s")).alias("gap"),
        (F.sum("a").over(up) + F.sum("u").over(Window.orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, -1))).alias("wrong"),
    ).filter("bar is not null")


def best_bar(scored: DataFrame, score: str, answered: str) -> DataFrame:
    """(bar, wrong): the bar with the fewest on the wrong side; 0 and 1 are bars too; ties to the lower bar."""
    yes, s = F.col(answered), F.col(score)
    ends = scored.agg(F.sum(F.when(~yes & (s >= 0), 1).when(yes & (s < 0), 1).otherwise(0)).alias("w0"), F.sum(F.when(~yes & (s >= 1), 1).when(yes & (s < 1), 1).otherwise(0)).alias("w1"))
    ends = ends.select(F.explode(F.array(F.struct(F.lit(0.0).alias("bar"), F.col("w0").alias("wrong")), F.struct(F.lit(1.0).alias("bar"), F.col("w1").alias("wrong")))).alias("x")).select("x.*")
    return bars(scored, score, answered).select("bar", "wrong").unionByName(ends).orderBy("wrong", "bar").limit(1)


def calibrated_bar(scored: DataFrame, score: str, answered: str) -> DataFrame:
    """(bar, wrong, gap) as best_bar, but just outside the extremes instead of 0 and 1, and ties to the widest gap."""
    yes = F.col(answered)
    ends = scored.agg(F.min(score).alias("low"), F.max(score).alias("high"), F.sum(F.when(~yes, 1).otherwise(0)).alias("u"), F.sum(F.when(yes, 1).otherwise(0)).alias("a"))
    outer = F.array(F.struct((F.col("low") - 1e-6).alias("bar"), F.lit(1e-6).alias("gap"), F.col("u").alias("wrong")), F.struct((F.col("high") + 1e-6).alias("bar"), F.lit(1e-6).alias("gap"), F.col("a").alias("wrong")))
    return bars(scored, score, answered).unionByName(ends.select(F.explode(outer).alias("x")).select("x.*")).orderBy("wrong", F.desc("gap"), "bar").limit(1)


def run_diff(before: DataFrame, after: DataFrame, key: str, metric: str) -> DataFrame:
    """(key, before, after, change): improved, regressed, same, only_before or only_after."""
    both = before.select(key, F.col(metric).alias("before")).join(after.select(key, F.col(metric).alias("after")), key, "full")
    change = F.when(F.col("after").isNull(), "only_before").when(F.col("before").isNull(), "only_after").when(F.col("after") > F.col("before"), "improved").when(F.col("after") < F.col("before"), "regressed").otherwise("same")
    return both.withColumn("change", change)


def gate(current: DataFrame, baseline: DataFrame, tolerance: float) -> DataFrame:
    """(metric, current, baseline, regressed): below the baseline by more than tolerance; a missing metric is a regression.

    baseline: metric, value, higher_is_better.
    """
    both = baseline.select("metric", F.col("value").alias("baseline"), "higher_is_better").join(current.select("metric", F.col("value").alias("current")), "metric", "left")
    worse = F.when(F.col("higher_is_better"), F.col("baseline") - F.col("current")).otherwise(F.col("current") - F.col("baseline"))
    return both.select("metric", "current", "baseline", F.coalesce(worse > tolerance + 1e-9, F.lit(True)).alias("regressed"))


def bootstrap(pairs: DataFrame, key: str, delta: str, resamples: int, seed: int) -> DataFrame:
    """(mean_delta, low, high): the 2.5 and 97.5 percentiles of resampled mean deltas.

    Every row draws, for each resample, how often it is taken (a Poisson count from a hash), so a resample is a
    weighted sum and no row is copied or gathered.
    """
    digits = F.substring(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.col("r").cast("string"), F.lit(str(seed)))), 1, 8)
    u = F.conv(digits, 16, 10).cast("double") / 2.0**32
    steps = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183]
    times = sum((F.when(u >= s, 1).otherwise(0) for s in steps[1:]), F.when(u >= steps[0], 1).otherwise(0))
    drawn = pairs.withColumn("r", F.explode(F.sequence(F.lit(1), F.lit(resamples)))).withColumn("t", times)
    means = drawn.groupBy("r").agg((F.sum(F.col("t") * F.col(delta)) / F.sum("t")).alias("m"))
    bounds = means.agg(F.expr("percentile_disc(0.025) within group (order by m)").alias("low"), F.expr("percentile_disc(0.975) within group (order by m)").alias("high"))
    return pairs.agg(F.round(F.avg(delta), 9).alias("mean_delta")).crossJoin(bounds).select("mean_delta", F.round("low", 9).alias("low"), F.round("high", 9).alias("high"))  # one row each


#: What became of a candidate, from the one that got furthest.
PROGRESS = ("returned", "past_top_k", "near_duplicate", "below_min_score", "not_scored")


def drop_reason(fused: DataFrame, scored: DataFrame, kept: DataFrame, min_score: float, context: int, near: DataFrame | None = None, cut: DataFrame | None = None, over: DataFrame | None = None) -> DataFrame:
    """Each fused candidate with its scores and what dropped it; null where it reached the prompt.

    In this order: not_scored, below_min_score, near_duplicate, relative_cut, top_k_cut where it was not kept; context_budget,
    context_limit where it was. fused: query_id, id, rank; scored: rerank, rerank_rank; kept: kept_rank; near, cut, over:
    query_id and id of what diversity, the relative floor and the prompt's budget dropped, where such a step ran.
    """
    keys = ["query_id", "id"]
    out = fused.select(*keys, "rank").join(scored.select(*keys, "rerank", "rerank_rank"), keys, "left").join(kept.select(*keys, "kept_rank"), keys, "left")
    hit = {}
    for name, rows in (("near_duplicate", near), ("relative_cut", cut), ("context_budget", over)):
        hit[name] = F.lit(False)
        if rows is not None:
            out = out.join(rows.select(*keys).distinct().withColumn(name, F.lit(True)), keys, "left")
            hit[name] = F.coalesce(F.col(name), F.lit(False))
    lost = F.when(F.col("rerank").isNull(), "not_scored").when(F.col("rerank") < min_score, "below_min_score").when(hit["near_duplicate"], "near_duplicate").when(hit["relative_cut"], "relative_cut").otherwise("top_k_cut")
    reason = F.when(F.col("kept_rank").isNull(), lost).when(hit["context_budget"], "context_budget").when(F.col("kept_rank") > context, "context_limit")
    return out.select(*keys, "rank", "rerank", "rerank_rank", "kept_rank", reason.alias("drop_reason"))


def explained(trace: DataFrame, files: DataFrame, asked: DataFrame) -> DataFrame:
    """(query_id, filename, outcome, id, rank, rerank_rank, returned_rank) of the passage of each asked file that got furthest.

    trace: drop_reason's rows; files: id, filename; asked: query_id, filename. Then the better place in the result, score
    and fused rank; not_retrieved where a file has no candidate. A passage that the floor left to a weak result is not below it.
    """
    outcome = F.when(F.col("kept_rank").isNotNull(), "returned").when(F.col("drop_reason").isin(*PROGRESS[2:]), F.col("drop_reason")).otherwise("past_top_k")
    far = F.array_position(F.array(*map(F.lit, PROGRESS)), F.col("outcome"))
    rows = trace.join(files.select("id", "filename"), "id").withColumn("outcome", outcome)
    order = F.struct(far.alias("far"), F.coalesce("kept_rank", F.lit(0)).alias("place"), (-F.coalesce("rerank", F.lit(0.0))).alias("score"), F.col("rank").alias("fused"), "id", "outcome", "rerank_rank", F.col("kept_rank").alias("returned_rank"))
    best = rows.groupBy("query_id", "filename").agg(F.min(order).alias("b"))
    out = asked.select("query_id", "filename").distinct().join(best, ["query_id", "filename"], "left")
    return out.select("query_id", "filename", F.coalesce("b.outcome", F.lit("not_retrieved")).alias("outcome"), "b.id", F.col("b.fused").alias("rank"), "b.rerank_rank", "b.returned_rank")


def trace_diff(a: DataFrame, b: DataFrame, least: float = 0.01) -> DataFrame:
    """Candidates that two traces treat differently: other rank, other reason, or scores at least least apart."""
    keys = ["query_id", "id"]
    both = a.select(*keys, *[F.col(c).alias(f"{c}_a") for c in ("rank", "rerank", "drop_reason")]).join(b.select(*keys, *[F.col(c).alias(f"{c}_b") for c in ("rank", "rerank", "drop_reason")]), keys, "full")
    same = F.col("rank_a").eqNullSafe(F.col("rank_b")) & F.col("drop_reason_a").eqNullSafe(F.col("drop_reason_b")) & (F.col("rerank_a").eqNullSafe(F.col("rerank_b")) | F.coalesce(F.abs(F.col("rerank_a") - F.col("rerank_b")) < least, F.lit(False)))
    return both.filter(~same)


def even_positions(n: Column, count: int) -> Column:
    """The positions (from 0) of count items spread over n, first and last included; halves round to even."""
    last = n - 1
    spread = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda p: F.rint(p * last / (count - 1)).cast("long"))
    return F.when(n <= count, F.sequence(F.lit(0).cast("long"), last.cast("long"))).otherwise(F.array_distinct(spread))
