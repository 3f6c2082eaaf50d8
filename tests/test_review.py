from pyspark.sql import functions as F

from fathomline.operators import review as V
from fathomline.sources import files

RATING = "rating_id long, question string, rating string, cited_filenames array<string>, citation_source_number int, created_at double, kind string"


def test_latest_rating_decides(spark):
    rows = [
        (1, "What  is x", "down", ["a"], None, 1.0, None), (2, "what is X ", "up", ["b", "a", "b", None, ""], None, 2.0, "question"), (3, "What is x", "down", ["c"], 1, 9.0, None),
        (4, "y", "up", [], None, 1.0, None), (5, "z", "up", ["a"], None, 5.0, None), (6, "Z", "down", None, None, 5.0, None), (7, "Summarize it", "up", ["a"], None, None, None),
        (8, "w", "up", ["q"], None, 1.0, "follow_up"), (9, "w", "up", ["q"], None, 1.0, None), (10, None, "up", ["a"], None, 1.0, None), (11, "v", "meh", ["a"], None, 1.0, None), (12, "Summarize", "up", ["k"], None, None, None),
    ]
    got = {(r.kind, r.question): (r.destination, r.relevant_filenames, r.cited_filenames) for r in V.question_set(spark.createDataFrame(rows, RATING)).collect()}
    assert got == {
        ("question", "what is X"): ("example", ["a", "b"], ["a", "b"]), ("question", "y"): ("uncited", [], []), ("question", "Z"): ("review", [], []), ("summary", "Summarize it"): ("not_a_question", [], ["a"]),
        ("follow_up", "w"): ("not_a_question", [], ["q"]), ("question", "w"): ("example", ["q"], ["q"]), ("question", "Summarize"): ("example", ["k"], ["k"]),
    }


def test_each_query_and_scope_is_searched_once(spark):
    log = spark.createDataFrame(
        [(2, "q1", None, None, None, "no_context", 0.5, "a"), (1, "Q1 ", None, None, None, "uncited", 0.4, "b"), (3, "q1", None, "s", None, "no_context", None, None), (4, "x", "q1", "s", "question", None, 0.9, "c"), (5, "q1", None, None, "summary", "no_context", 0.1, "a"), (6, "q2", None, None, None, "answered", 0.1, "a"), (7, " ", None, None, None, "no_context", 0.1, "a"), (8, "q3", None, None, None, "no_context", 0.5, "a"), (9, "q4", None, None, None, "no_context", 0.5, "a"), (10, "q5", None, None, None, "no_context", 0.5, None)],
        "log_id long, question string, retrieval_query string, scope string, kind string, status string, top_score double, top_filename string",
    )
    asked = V.to_recheck(log)
    assert sorted((r.query, r.scope, r.status, r.asks) for r in asked.collect()) == [("Q1 ", "", "uncited", 2), ("q1", "s", "no_context", 2), ("q3", "", "no_context", 1), ("q4", "", "no_context", 1), ("q5", "", "no_context", 1)]
    found = spark.createDataFrame([("Q1 ", "", 0.41, "b", False), ("q1", "s", 0.2, "z", False), ("q3", "", 0.4, "other", False), ("q4", "", 0.9, "a", True)], "query string, scope string, now_score double, now_filename string, weak boolean")
    assert {(r.query, r.scope): r.covered_now for r in V.rechecked(asked, found).collect()} == {("Q1 ", ""): False, ("q1", "s"): True, ("q3", ""): True, ("q4", ""): False, ("q5", ""): False}


def test_rates_have_their_own_denominators(spark):
    schema = "relevant_filenames array<string>, expect_no_context boolean, has_facts boolean, has_excludes boolean, relevant_ids array<string>, cited_filenames array<string>, cited_ids array<string>, status string, fact_hit boolean, excluded_hit boolean, error string, unsupported_claims int, unsupported_numbers int, truncated boolean, prompt_cut boolean"
    rows = [
        (["a"], False, True, False, ["1", "2"], ["b", "a"], ["1", "3", "3"], "answered", True, None, None, 2, 1, False, True), (["a"], False, False, False, None, ["b"], ["1"], "uncited", None, None, "timeout", None, 0, True, False),
        (None, True, False, False, ["1"], [], [], "no_context", None, None, None, 0, 0, None, False),
    ]
    got = {r.metric: r.value for r in V.answer_rates(spark.createDataFrame(rows, schema)).collect()}
    third = round(1 / 3, 9)
    assert got == {"cited_relevant_rate": 0.5, "answered_rate": 0.5, "refused_unanswerable_rate": 1.0, "fact_hit_rate": 1.0, "uncited_rate": third, "error_rate": third, "unsupported_claims_mean": round(2 / 3, 9), "unsupported_numbers_mean": third, "truncated_rate": third, "prompt_cut_rate": third, "cited_chunk_precision": 0.5}
    assert V.answer_rates(spark.createDataFrame([], schema)).count() == 0


def test_delimiters_are_found(spark):
    texts = ["a,b\n1,2\n3,4", "a;b;c\n1,5;2;3\n4;5;6", 'a\tb\n"1\t9"\t2\n3\t4', "a|b\n1|2", "title\nalpha beta\ngamma delta", "", None, "a;b\n" + "1;2\n" * 2000, 'x,"a;b;c"\ny,"d;e;f"\n']
    got = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", files.sniffed(F.col("t")).alias("d")).orderBy("k").collect()
    assert [r.d for r in got] == [",", ";", "\t", "|", ",", ",", ",", ";", ","]


def test_rows_by_found_delimiter(spark):
    texts = spark.createDataFrame([("f", 'id|name||\n1|"x|y"|3|\n\n|| |4\n'), ("g", "only\nrow\n")], "name string, text string")
    got = {r["name"]: (r.section, r.text) for r in files.delimited(texts, delimiter=None).collect()}
    assert got == {"f": ("Rows 2-4", "id: 1; name: x|y; col3: 3\ncol4: 4"), "g": ("Rows 2-2", "only: row")}
