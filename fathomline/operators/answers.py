"""Answers and conversations: citations, numbers, status, history, follow-up questions, fact checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.functions import numerals as N
from fathomline.functions import text as T

MARKER = N.MARKER


def history_tail(turns: DataFrame, keep: int, clip: int, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Each conversation's last keep messages from its first question on; earlier answers cut to clip characters."""
    w = Window.partitionBy(conv)
    begin = F.min(F.when(F.col("role") == "user", F.col(turn))).over(w)
    rows = turns.withColumn("begin", begin).filter(F.col(turn) >= F.col("begin")).withColumn("back", F.row_number().over(w.orderBy(F.desc(turn))))
    text = F.when(F.col("role") == "assistant", F.substring("text", 1, clip)).otherwise(F.col("text"))
    return rows.filter(F.col("back") <= keep).select(conv, turn, "role", text.alias("text"))


def exchanges(turns: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """(conv, turn, question, answer): each question with the answer that follows it."""
    w = Window.partitionBy(conv).orderBy(turn)
    out = turns.withColumn("answer", F.lead("text").over(w)).withColumn("next", F.lead("role").over(w))
    return out.filter("role = 'user' and next = 'assistant'").select(conv, turn, F.col("text").alias("question"), "answer")


def cited_sources(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """(answer_id, source_number, source columns): each answer's cited sources among those on offer."""
    marks = answers.select("answer_id", F.explode(T.cited_numbers(F.col("answer"), F.lit(1_000_000))).alias("source_number"))
    return marks.join(sources, ["answer_id", "source_number"])


def states_fact(answer: Column, any_of: list[str], groups: list[list[str]], none_of: list[str]) -> Column:
    """Whether an answer contains one of any_of and one of each group, and nothing of none_of; numbers as whole numbers."""
    low = F.lower(answer)
    out = F.lit(True)
    for options in ([any_of] if any_of else []) + groups:
        hit = F.lit(False)
        for x in options:
            hit = hit | low.contains(x.lower())
        out = out & hit
    for x in none_of:
        out = out & ~low.rlike(rf"(?<!\d){_escaped(x.lower())}(?!\d)")
    return out


def _escaped(x: str) -> str:
    return "".join(c if c.isalnum() or c == " " else f"\\{c}" for c in x)


def joined_continuation(before: Column, after: Column) -> Column:
    """An answer and its continuation: a tail of up to 40 characters that the continuation repeats is kept once."""
    cuts = F.filter(F.sequence(F.lit(40), F.lit(8), F.lit(-1)), lambda n: (F.char_length(before) >= n) & (F.right(before, n) == F.left(after, n)))
    n = F.coalesce(F.when(F.size(cuts) > 0, cuts[0]), F.lit(0))
    tail = F.expr("1") + n
    rest = F.substring(after, tail, F.lit(1 << 30))
    space = F.when((n > 0) | before.rlike(r"\s$") | after.rlike(r"^[\s.,;:!?)]"), "").otherwise(" ")
    return F.concat(before, space, rest)


def claims_by_source(answers: DataFrame, most: int = 1_000_000) -> DataFrame:
    """(answer_id, source_number, sentence_no): which sentences cite a source; markers that open a sentence belong to the one before.

    answers: answer_id, answer.
    """
    leading = rf"^(?:\s*{MARKER})+"
    each = answers.select("answer_id", F.posexplode(T.sentences(F.col("answer"))).alias("sentence_no", "s"))
    opening = F.when(F.col("sentence_no") > 0, F.regexp_extract("s", rf"({leading})", 1)).otherwise("")
    own = F.when(F.col("sentence_no") > 0, F.regexp_replace("s", leading, "")).otherwise(F.col("s"))
    parts = each.select("answer_id", F.explode(F.array(F.struct((F.col("sentence_no") - 1).alias("no"), opening.alias("t")), F.struct(F.col("sentence_no").alias("no"), own.alias("t")))).alias("p"))
    cited = parts.select("answer_id", F.col("p.no").cast("long").alias("sentence_no"), F.explode(T.cited_numbers(F.col("p.t"), F.lit(most))).alias("n"))
    return cited.select("answer_id", "sentence_no", F.col("n").cast("long").alias("source_number")).distinct()


def backfilled(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """(answer_id, sentence_no, source_number): the source that best covers each sentence without a marker.

    answers: answer_id, answer; sources: answer_id, source_number, text. Three shared words, half of the sentence's, one
    of four letters or more; then the highest coverage, the smallest number.
    """
    bare = answers.select("answer_id", F.posexplode(T.sentences(F.col("answer"))).alias("sentence_no", "s")).filter(~F.col("s").rlike(MARKER))
    claims = bare.select("answer_id", "sentence_no", N.content_words(F.col("s")).alias("c")).filter(F.size("c") >= 3)
    pairs = claims.join(sources.select("answer_id", "source_number", N.content_words(F.col("text")).alias("w")), "answer_id").withColumn("both", F.array_intersect("c", "w"))
    good = pairs.filter((F.size("both") >= 3) & (F.size("both") >= 0.5 * F.size("c")) & F.exists("both", lambda x: (F.char_length(x) >= 4) | x.rlike(r"\d")))
    best = good.groupBy("answer_id", "sentence_no").agg(F.max(F.struct((F.size("both") / F.size("c")).alias("v"), (-F.col("source_number")).alias("n"))).alias("b"))
    return best.select("answer_id", F.col("sentence_no").cast("long").alias("sentence_no"), (-F.col("b.n")).alias("source_number"))
