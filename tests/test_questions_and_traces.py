import random

import pytest
from pyspark.sql import functions as F

from fathomline.functions import questions as Q
from fathomline.operators import evaluation as E
from fathomline.operators import telemetry as L


@pytest.mark.parametrize(
    ("question", "needs"),
    [
        ("How many vacation days do engineers receive yearly?", False), ("Which laptop models may engineers order abroad", False), ("What about pricing for remote engineers abroad?", True), ("And part-time staff holiday allowance", True),
        ("Explain holiday allowance carry-over rules", True), ("Combien coûte-t-elle pour chaque salarié étranger", True), ("Wie lange dauert das Verfahren insgesamt ungefähr", True), ("它是什么意思请说明", True),
        ("請假規定細節說明文件", False), ("", True), (None, True), ("Part-time staff", True), ("List laptop models engineers order", True), ("What if laptops break down abroad", True),
    ],
)
def test_needs_condense(spark, question, needs):
    assert spark.createDataFrame([(question,)], "t string").select(Q.needs_condense(F.col("t"))).first()[0] is needs


@pytest.mark.parametrize(
    ("output", "query", "note"),
    [
        ("What is due?", "What is due?", None), ('"What is due?"', "What is due?", None), ("Standalone question: What is due?", "What is due?", "cleaned"), ("Sure, here it is:\n\n  **What is due?**\nIt is 5.", "What is due?", "cleaned"),
        ("Here's the rewritten question: the search query: `x`", "x", "cleaned"), (" \n\t\n", "", "empty"), (None, "", "empty"), ("y" * 401, "", "rejected: longer than a question"), ("y" * 400, "y" * 400, None), ("Question:\nwhat", "what", "cleaned"),
    ],
)
def test_condensed(spark, output, query, note):
    r = spark.createDataFrame([(output, "What?")], "o string, q string").select(Q.condensed(F.col("o"), F.col("q")).alias("c")).first().c
    assert tuple(r) == (query, note)


def test_long_questions_allow_long_rewrites(spark):
    r = spark.createDataFrame([("y" * 500, "q" * 125)], "o string, q string").select(Q.condensed(F.col("o"), F.col("q")).alias("c")).first().c
    assert r.note is None and len(r.query) == 500


def test_batch_shares_same_as_walk(spark):
    rng = random.Random(6)
    rows = [(q, d, rng.choice([None, 0, 1, 2, 3, 5, 9, 40])) for q in range(60) for d in range(rng.randint(1, 12))]
    most = 11
    want = set()
    for q in {r[0] for r in rows}:
        own, left = sorted((max(n or 1, 1), d) for k, d, n in rows if k == q), most
        for k, (n, d) in enumerate(own):
            share = max(1, min(n, left // (len(own) - k)))
            left -= share
            want.add((q, d, share))
    df = spark.createDataFrame(rows, "q long, d long, need long")
    assert set(map(tuple, L.batch_shares(df, "q", "d", "need", most).collect())) == want
    assert L.batch_shares(df.filter("q < 0"), "q", "d", "need", most).count() == 0


def test_all_drop_reasons_in_order(spark):
    fused = spark.createDataFrame([(1, k, k) for k in range(1, 10)], "query_id long, id long, rank long")
    scored = spark.createDataFrame([(1, k, s, k) for k, s in ((1, 0.9), (2, 0.8), (3, 0.7), (4, 0.6), (5, 0.5), (6, 0.4), (7, 0.3), (8, 0.1))], "query_id long, id long, rerank double, rerank_rank long")
    kept = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (1, 4, 3)], "query_id long, id long, kept_rank long")
    ids = lambda *x: spark.createDataFrame([(1, k) for k in x], "query_id long, id long")
    trace = E.drop_reason(fused, scored, kept, 0.2, 2, ids(3, 8, 3), ids(5, 3), ids(2))
    assert [(r.id, r.drop_reason) for r in trace.orderBy("id").collect()] == [(1, None), (2, "context_budget"), (3, "near_duplicate"), (4, "context_limit"), (5, "relative_cut"), (6, "top_k_cut"), (7, "top_k_cut"), (8, "below_min_score"), (9, "not_scored")]
    files = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (8, "b"), (5, "c"), (9, "d"), (7, "c")], "id long, filename string")
    asked = spark.createDataFrame([(1, x) for x in "abcdea"], "query_id long, filename string")
    got = [(r.filename, r.outcome, r.id, r.returned_rank) for r in E.explained(trace, files, asked).orderBy("filename").collect()]
    assert got == [("a", "returned", 1, 1), ("b", "near_duplicate", 3, None), ("c", "past_top_k", 5, None), ("d", "not_scored", 9, None), ("e", "not_retrieved", None, None)]
    assert [r.drop_reason for r in E.drop_reason(fused, scored, kept, 0.2, 9).orderBy("id").collect()] == [None, None, "top_k_cut", None, "top_k_cut", "top_k_cut", "top_k_cut", "below_min_score", "not_scored"]
