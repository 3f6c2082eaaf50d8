import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from fathomline.functions import numerals as N
from fathomline.functions import offsets as O
from fathomline.functions import refusals as R
from fathomline.operators import grounding as G
from fathomline.plans import grounding as plans


def column(spark, texts, *columns):
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    return [tuple(r)[1:] for r in rows.select("k", *columns).orderBy("k").collect()]


def spoken(n):
    units = N.UNITS
    small = lambda x: units[x] if x < 20 else N.TENS[x // 10 - 2] + (f"-{units[x % 10]}" if x % 10 else "")
    low = lambda x: small(x) if x < 100 else f"{units[x // 100]} hundred" + (f" and {small(x % 100)}" if x % 100 else "")
    return low(n) if n < 1000 else f"{low(n // 1000)} thousand" + (f" {low(n % 1000)}" if n % 1000 else "")


def test_numbers_in_words_round_trip(spark):
    rng = random.Random(2)
    values = [*range(0, 120), *(rng.randint(0, 999_999) for _ in range(200))]
    texts = [f"It is {spoken(n).upper() if n % 2 else spoken(n)} euros" for n in values]
    assert [r[0] for r in column(spark, texts, N.words(F.col("t")))] == [["it", "is", str(n), "euros"] for n in values]


@pytest.mark.parametrize(
    ("text", "words"),
    [
        ("five, six and seven", ["5", "6", "7"]), ("one two three", ["1", "2", "3"]), ("hundred days and thousand", ["hundred", "days", "and", "thousand"]), ("five and dogs", ["5", "dogs"]),
        ("nine hundred thousand and one", ["900001"]), ("twenty_one someone ones", ["twenty_one", "someone", "ones"]), ("ten\nfive", ["10", "5"]), ("two hundred two hundred", ["20200"]),
        ("", []), ("zero", ["0"]), ("one " + "thousand " * 9, [str(10**15)]), ("Größe FÜNF 日本 3", ["größe", "fünf", "日本", "3"]),
    ],
)
def test_runs_of_number_words(spark, text, words):
    assert column(spark, [text], N.words(F.col("t"))) == [(words,)]


def test_long_text_of_number_words_is_read_whole(spark):
    assert column(spark, ["one, " * 20_000, "seven " * 3000], F.size(N.words(F.col("t")))) == [(20_000,), (3000,)]


def test_stated_numbers(spark):
    texts = ["1,000 or 1'200.50 and forty‑five", "2. All three policies say 12 [4]", "• thirty cents", None]
    got = column(spark, texts, N.numbers(F.col("t")), N.claimed_numbers(F.col("t")), N.source_numbers(F.col("t"), F.lit("policy_2019_old.md")))
    assert got[0][0] == ["1000", "1200", "50", "45"]
    assert got[1][1] == ["12"]
    assert set(got[2][2]) == {"30", "2019", "0"}


def test_content_words(spark):
    assert column(spark, ["The 3 cats and a Dog of the house que x", ""], N.content_words(F.col("t"))) == [(["3", "cats", "dog", "house"],), ([],)]


def test_places_of_pieces(spark):
    text = "  First one here. Second?\n\n| a row\n| more [1] 日本。次の文。 ## Head Last  "
    rows = spark.createDataFrame([(text,), ("",), ("x" * 50 + ". A" * 2000,)], "t string")
    rows = rows.withColumn("p", O.measured(F.col("t"), R.SENTENCE)).withColumn("s", F.transform("p", lambda p: p["step"])).withColumn("e", O.running(F.col("s")))
    got = [[tuple(x) for x in r[0]] for r in rows.select(O.placed(F.col("p"), F.col("e"))).collect()]
    assert [x[2] for x in got[0]] == ["First one here.", "Second?", "| a row", "| more [1] 日本。", "次の文。", "## Head Last"]
    assert all(text[a:b] == body for a, b, body in got[0]) and got[1] == [] and len(got[2]) == 2001


SOURCE = "## Receipts Submit receipts within thirty days of travel. Meals cost 40 euros a day. Hotels cost 120 euros a night. Hotels cost 120 euros a night. Staff book trains."


@pytest.mark.parametrize(
    ("claim", "quote"),
    [
        ("Receipts are due in 30 days of travel", "Submit receipts within thirty days of travel."),  # past the heading
        ("hotels 120 euros night", "Hotels cost 120 euros a night."),  # a tie: the earliest
        ("meals 40 euros and hotels 120 a night cost", "Meals cost 40 euros a day. Hotels cost 120 euros a night."),  # neighbours that both bear on it
        ("trains only", None), ("euros hotels one two three four five six seven", None),  # one word; too little of the claim
    ],
)
def test_spans_of_claims(spark, claim, quote):
    answers = spark.createDataFrame([(1, f"{claim} [1].")], "answer_id long, answer string")
    sources = spark.createDataFrame([(1, 1, SOURCE, "Receipts"), (2, 1, SOURCE, "")], "answer_id long, source_number int, text string, section string")
    got = G.attached_spans(answers, sources).collect()
    assert [r.quote for r in got] == ([quote] if quote else [])
    assert all(SOURCE[r.start : r.end] == r.quote for r in got)
    assert [r.supported for r in G.claim_support(answers, sources).collect()] == [quote is not None]


def test_at_most_three_spans_that_do_not_overlap(spark):
    facts = [f"alpha{k} beta{k} gamma{k} delta{k}" for k in range(5)]
    answers = spark.createDataFrame([(1, ". ".join(f"{f} [1]" for f in facts[:4] + [facts[0] + " " + facts[1]]) + ". [1] tail"), (2, None)], "answer_id long, answer string")
    sources = spark.createDataFrame([(1, 1, "\n".join(facts)), (2, 1, None)], "answer_id long, source_number int, text string")
    got = G.attached_spans(answers, sources).orderBy("span_no").collect()
    assert [r.quote for r in got] == facts[:3] and [r.span_no for r in got] == [0, 1, 2]


def test_query_spans_take_later_of_equals(spark):
    q = spark.createDataFrame([(1, "hotels euros cost"), (2, "meals"), (3, "")], "query_id long, query string")
    p = spark.createDataFrame([(k, 9, SOURCE) for k in (1, 2, 3)], "query_id long, passage_id long, text string")
    got = G.query_spans(q, p).orderBy("query_id", "start").collect()
    assert [(r.query_id, r.quote) for r in got] == [(1, "Hotels cost 120 euros a night.")] * 2 + [(2, "Meals cost 40 euros a day.")]
    assert [r.start for r in got[:2]] == [m.start() for m in re.finditer("Hotels", SOURCE)]


def same_as_sql(spark, folder, name, **tables):
    """Rows of a query and of its statement on tables made for it."""
    con = duckdb.connect()
    for table, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    got = plans.QUERIES[name](spark, str(folder))
    return sorted(map(str, map(tuple, got.collect()))), sorted(map(str, con.sql(plans.ORACLE[name]).fetchall()))


def test_query_spans_of_documents_that_hold_a_text_as_it_is(spark, tmp_path):
    text = "Hotels cost 120 euros a night"
    docs = [(1, SOURCE, 0), (2, SOURCE.upper(), 0), (3, SOURCE.replace("cost 120", "cost  120"), 0), (4, None, 0), (5, "", 0), (1, SOURCE, 0), (6, f"ΟΔΟΣ {text}. ΟΔΟΣΑ", 0)]
    items = [(1, text), (1, text), (2, "no such text"), (3, None), (4, ""), (5, text.upper()), (6, f"{text}. ΟΔΟΣ")]
    got, sql = same_as_sql(spark, tmp_path, "query_spans", documents=(docs, "doc_id long, text string, n_chars long"), benchmark=(items, "item_id long, text string"))
    assert got == sql and len(got) == 6


def test_numbers_of_an_answer_never_stand_in_for_another(spark, tmp_path):
    turns = [(1991, 1), (1992, 2), (95, 3), (5, 101), (6, 1), (6, 1), (0, 0), (7, 6001), (90000, 3), (91995, 5), (2, 398), (-7, 2), (90001, 4999), (None, 1), (1, None)]
    rows = [(*x, "assistant", "a") for x in turns] + [(8, 1, "user", "a"), (8, 2, None, "a")]
    got, sql = same_as_sql(spark, tmp_path, "unsupported_numbers", conversations=(rows, "conv_id long, turn long, role string, text string"))
    assert got == sql and len(got) == len(turns)


def test_unsupported_numbers(spark):
    answers = spark.createDataFrame([(1, "It costs 45 euros [1]. Later 50 [1][2]. [2] 1. It was 0 in all two documents [1] and 7 [9].\nThe documents do not specify 99 [1]."), (2, "none"), (3, None)], "answer_id long, answer string")
    sources = spark.createDataFrame([(1, 1, "forty-five cents", "a_50.md"), (1, 2, "five hundred", "b.md")], "answer_id long, source_number int, text string, filename string")
    assert sorted(map(tuple, G.unsupported_numbers(answers, sources).collect())) == [(1, 1), (2, 0), (3, 0)]


@pytest.mark.parametrize(
    ("answer", "sources", "status", "retry"),
    [
        ("The documents do not mention fuel cards.", 5, "insufficient_context", True), ("The documents do not mention fuel cards. Mileage is 30 cents.", 5, "uncited", True),
        ("I can’t answer that.", 2, "insufficient_context", False), ("Las políticas no contienen eso [1].", 2, "answered", False), ("", 3, "uncited", True), (None, 3, "uncited", True), (None, 0, "no_context", False),
        ("Mileage is thirty cents, but the policy does not give details of the currency [1].", 2, "answered", False), ("However, the policy does not specify it [1].", 2, "insufficient_context", False),
        ("The documents do not contain it [1]. However, it is 5.", 2, "answered", False), ("The documents do not contain it [1]. [1] [2]", 2, "insufficient_context", False), ("The form does not contain a field", 2, "uncited", True),
    ],
)
def test_status_and_retry(spark, answer, sources, status, retry):
    assert column(spark, [answer], R.status(F.col("t"), F.lit(sources)), R.needs_retry(F.col("t"), F.lit(sources))) == [(status, retry)]


@pytest.mark.parametrize(
    ("before", "after", "new"),
    [
        ("One two three. Four five six seven eight.", "Four five six seven eight. Nine.", "Nine."), ("x Four five six seven eight", "Four five six seven eights. Nine.", "Four five six seven eights. Nine."),
        ("xFour five six seven eight", "Four five six seven eight Nine", "Four five six seven eight Nine"), ("four five six seven eight", "four five six seven eight", ""), ("short", "short", "short"), ("", "a", "a"),
        ("one row of the table one row of the table", "one row of the table one row of the table end", "one row of the table end"), ("w" * 3000 + " abc", "w" * 3000 + " abc d", "w" * 3000 + " abc d"),
    ],
)
def test_overlaps_are_cut_at_word_edges(spark, before, after, new):
    from fathomline.functions import text as T

    assert spark.createDataFrame([(before, after)], "b string, a string").select(T.without_overlap(F.col("b"), F.col("a"))).first()[0] == new
