"""What users' ratings and logs teach: question sets from ratings, logged questions searched again, rates of answers.

Everything is an aggregate by question or a join; no question's rows are gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.functions import text as T

#: How the task of a summary begins, by which ratings from before kinds are told. A score must rise by more than GAIN.
TASKS, GAIN = r"^(?:Summarize|Compare) ", 0.02


def same_question(text: Column) -> Column:
    """What makes two questions one: spacing and case don't count."""
    return F.lower(T.collapse(F.coalesce(text, F.lit(""))))


def question_set(ratings: DataFrame) -> DataFrame:
    """(kind, question, destination, relevant_filenames, cited_filenames) from ratings: each question's latest decides.

    ratings: rating_id, question, rating (up or down), cited_filenames, citation_source_number, created_at, kind. An up with
    cited files is an example with them as relevant; without, uncited; a down is for review; so is what is no question (a
    summary, a follow-up). Ratings of single citations, of no question and of another mark don't count; a null time is the
    earliest, equal times go by rating_id; a null kind is told by the task's words.
    """
    question = T.collapse(F.coalesce("question", F.lit("")))
    kind = F.coalesce("kind", F.when(question.rlike(TASKS), "summary").otherwise("question"))
    rows = ratings.filter(F.col("rating").isin("up", "down") & F.col("citation_source_number").isNull()).select("rating_id", question.alias("question"), kind.alias("kind"), "rating", F.coalesce("created_at", F.lit(0.0)).cast("double").alias("at"), F.coalesce("cited_filenames", F.array().cast("array<string>")).alias("cited")).filter("question <> ''")
    last = rows.groupBy("kind", same_question(F.col("question")).alias("key")).agg(F.max(F.struct("at", "rating_id", "question", "rating", "cited")).alias("r"))
    cited = F.sort_array(F.array_distinct(F.filter("r.cited", lambda f: F.coalesce(f, F.lit("")) != "")))
    out = last.select("kind", "r.question", "r.rating", cited.alias("cited_filenames"))
    place = F.when(F.col("kind") != "question", "not_a_question").when(F.col("rating") == "down", "review").when(F.size("cited_filenames") == 0, "uncited").otherwise("example")
    relevant = F.when(place == "example", F.col("cited_filenames")).otherwise(F.array().cast("array<string>"))
    return out.select("kind", "question", place.alias("destination"), relevant.alias("relevant_filenames"), "cited_filenames")


def to_recheck(log: DataFrame) -> DataFrame:
    """(query, scope, question, status, top_score, top_filename, asks) of logged questions that went unanswered, once for each query and scope.

    log: log_id, question, retrieval_query, scope, kind, status, top_score, top_filename. What was searched counts (a
    follow-up's rewrite); the first row of a query and scope stands for it; summaries are left out, so are blank queries.
    """
    query = F.coalesce("retrieval_query", "question", F.lit(""))
    rows = log.filter(~F.coalesce("kind", F.lit("")).eqNullSafe("summary")).filter(query.rlike(r"\S")).filter(F.coalesce("status", F.lit("")) != "answered")
    first = F.min(F.struct("log_id", query.alias("query"), "question", "status", "top_score", "top_filename"))
    groups = rows.groupBy(same_question(query).alias("key"), F.coalesce("scope", F.lit("")).alias("scope")).agg(first.alias("r"), F.count("*").alias("asks"))
    return groups.select("r.query", "scope", "r.question", "r.status", "r.top_score", "r.top_filename", "asks")


def rechecked(asked: DataFrame, found: DataFrame) -> DataFrame:
    """asked with what a new search gives now, and covered_now: a passage clears the bar, and better than or other than before.

    asked: to_recheck's rows; found: query, scope, now_score, now_filename, weak: each search's best passage, once a query and
    scope. The same passage at the same score would be declined again. A search without a row found nothing.
    """
    both = asked.join(found, ["query", "scope"], "left")
    changed = F.col("top_score").isNull() | (F.col("now_score") > F.col("top_score") + GAIN) | F.coalesce(F.col("top_filename") != F.col("now_filename"), F.lit(False))
    return both.withColumn("covered_now", F.coalesce(F.col("now_score").isNotNull() & ~F.col("weak") & changed, F.lit(False)))


def answer_rates(rows: DataFrame) -> DataFrame:
    """(metric, value): how well answers were grounded, each rate over the questions that can say; without any there is no row.

    rows, one a question: relevant_filenames, expect_no_context, has_facts, has_excludes, relevant_ids (labels); cited_filenames,
    cited_ids, status, fact_hit, excluded_hit, error, unsupported_claims, unsupported_numbers, truncated, prompt_cut.
    """
    labeled, cites = F.size(F.coalesce("relevant_filenames", F.array())) > 0, F.arrays_overlap("cited_filenames", "relevant_filenames")
    ids = F.array_distinct("cited_ids")
    told = (F.size(F.coalesce("relevant_ids", F.array())) > 0) & (F.size(ids) > 0)
    rate = lambda ask, hit: F.avg(F.when(ask, F.coalesce(hit, F.lit(False)).cast("double")))
    every, number = F.lit(True), lambda c: F.avg(F.coalesce(F.col(c), F.lit(0)).cast("double"))
    rates = {
        "cited_relevant_rate": rate(labeled, cites), "answered_rate": rate(labeled, F.col("status") == "answered"),
        "refused_unanswerable_rate": rate(F.col("expect_no_context"), F.col("status").isin("no_context", "insufficient_context")),
        "fact_hit_rate": rate(F.col("has_facts"), F.col("fact_hit")), "excluded_rate": rate(F.col("has_excludes"), F.col("excluded_hit")),
        "uncited_rate": rate(every, F.col("status") == "uncited"), "error_rate": rate(every, F.col("error").isNotNull()),
        "unsupported_claims_mean": number("unsupported_claims"), "unsupported_numbers_mean": number("unsupported_numbers"),
        "truncated_rate": rate(every, F.col("truncated")), "prompt_cut_rate": rate(every, F.col("prompt_cut")),
        "cited_chunk_precision": F.avg(F.when(told, F.size(F.array_intersect(ids, "relevant_ids")) / F.size(ids))),
    }
    one = rows.agg(*[F.round(v, 9).alias(k) for k, v in rates.items()])
    long = F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k).alias("value")) for k in rates]))
    return one.select(long.alias("x")).select("x.metric", "x.value").filter("value IS NOT NULL")
