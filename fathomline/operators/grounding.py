"""Answers against their sources: the spans that claims rest on, claims and numbers without support, spans of search results.

A claim is a sentence of an answer with the sources it cites; markers that open a sentence belong to the one before. Claims
meet their sources by (answer_id, source_number), so a source is cut into sentences only where something cites it; words,
offsets and the choice of spans are column expressions on that row. (Arrays are exploded as outer ones: from a plain
explode Spark infers a filter on the array, which would compute all that again below the join.)

answers: answer_id, answer. sources: answer_id, source_number, text, and section where there is one (a heading's title).
Null texts are empty. Ranges of markers reach up to MOST_SOURCES. Repeated source rows count once each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.functions import numerals as N
from fathomline.functions import offsets as O
from fathomline.functions import refusals as R
from fathomline.functions import text as T

#: A span must share so many content words, and so much of the claim; spans a source, sentences a search result.
SHARED, COVERAGE, SPANS, QUERY_SPANS, MOST_SOURCES = 2, 0.3, 3, 2, 1000
HEADING, UNDERLINE = r"^#{1,6}\s+", r"^\s*[=-]{3,}\s+"
LEADING = rf"^(?:\s*{N.MARKER})+"


def claims(answers: DataFrame) -> DataFrame:
    """(answer_id, claim_no, claim, cited): each sentence of an answer without opening markers, and the sources it cites."""
    pieces = F.filter(F.split(F.coalesce("answer", F.lit("")), T.SENTENCE_END), lambda s: s.rlike(r"\S"))
    parts = F.transform(
        pieces,
        lambda s, i: F.struct(
            F.when(i > 0, F.regexp_extract(s, rf"({LEADING})", 1)).otherwise("").alias("opening"),
            F.when(i > 0, F.regexp_replace(s, LEADING, "")).otherwise(s).alias("claim"),
        ),
    )
    rows = answers.select("answer_id", parts.alias("parts"))
    cited = lambda t: T.cited_numbers(t, F.lit(MOST_SOURCES))
    none = F.array().cast("array<int>")
    told = F.zip_with("parts", F.slice("parts", F.lit(2), F.size("parts")), lambda p, q: F.struct(p["claim"].alias("claim"), F.array_union(cited(p["claim"]), F.coalesce(cited(q["opening"]), none)).alias("cited")))
    return rows.select("answer_id", F.posexplode_outer(told).alias("claim_no", "c")).filter("c IS NOT NULL").select("answer_id", F.col("claim_no").cast("long").alias("claim_no"), "c.claim", "c.cited")


def claim_words(claim: Column) -> Column:
    return N.content_words(F.regexp_replace(claim, N.MARKER, " "))


def indexed(rows: DataFrame) -> DataFrame:
    """rows with sents: the sentences of their text as {start, end, words, heading}."""
    out = rows.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("pieces", O.measured(F.col("text"), R.SENTENCE))
    out = out.withColumn("steps", F.transform("pieces", lambda p: p["step"])).withColumn("ends", O.running(F.col("steps")))
    sent = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), N.content_words(s["text"]).alias("words"), s["text"].rlike(HEADING).alias("heading"))
    return out.withColumn("sents", F.transform(O.placed(F.col("pieces"), F.col("ends")), sent)).drop("pieces", "steps", "ends")


def best_span(claim: Column, sents: Column) -> Column:
    """{coverage, tight, early, short, start, end} of the sentence, or two neighbours that both bear on it, that covers most of a claim; null if none does.

    Then the fewest words, then the earliest. Two sentences never reach across a heading.
    """
    shared = lambda w: F.size(F.array_intersect(claim, w))
    single = F.transform(sents, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["words"].alias("words")))
    following = F.slice(sents, F.lit(2), F.size(sents))
    both = F.zip_with(
        F.slice(sents, F.lit(1), F.greatest(F.size(sents) - 1, F.lit(0))), following,
        lambda a, b: F.when((shared(a["words"]) >= SHARED) & (shared(b["words"]) >= SHARED) & ~b["heading"], F.struct(a["start"].alias("start"), b["end"].alias("end"), F.array_union(a["words"], b["words"]).alias("words"))),
    )
    scored = F.transform(
        F.concat(single, F.filter(both, lambda x: x.isNotNull())),
        lambda s: F.struct((shared(s["words"]) / F.size(claim)).alias("coverage"), (-F.size(s["words"])).alias("tight"), (-s["start"]).alias("early"), (-s["end"]).alias("short"), s["start"].alias("start"), s["end"].alias("end")),
    )
    return F.array_max(F.filter(scored, lambda x: (x["coverage"] >= COVERAGE) & (F.round(x["coverage"] * F.size(claim)) >= SHARED)))


def apart(spans: Column, most: int) -> Column:
    """The best spans that don't overlap, most at most, in text order."""
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    clear = lambda kept, x: (F.size(kept) < most) & ~F.exists(kept, lambda k: (x["start"] < k["end"]) & (k["start"] < x["end"]))
    take = lambda kept, x: F.when(clear(kept, x), F.concat(kept, F.array(F.struct(x["start"].alias("start"), x["end"].alias("end"))))).otherwise(kept)
    return F.sort_array(F.aggregate(F.sort_array(spans, asc=False), none, take))


def past_heading(text: Column, section: Column, start: Column, end: Column) -> Column:
    """Where a quote begins: past a heading's mark, and past its title if that is the section's name; never past the claim."""
    at = lambda k: F.substring(text, (k + 1).cast("int"), F.lit(1 << 30))
    width = lambda k, p: F.char_length(F.regexp_extract(at(k), p, 0))
    mark = width(start, HEADING)
    moved, title = start + mark, F.trim(F.coalesce(section, F.lit("")))
    after = moved + F.char_length(title)
    under, gap = width(after, UNDERLINE), width(after, r"^\s+")
    named = F.when((title == "") | ~F.startswith(at(moved), title), moved).when(under > 0, after + under).when((mark > 0) & (after < end) & (gap > 0), F.least(after + gap, end)).otherwise(moved)
    left = F.substring(text, (named + 1).cast("int"), F.greatest(end - named, F.lit(0)).cast("int"))
    return F.when((named < end) & left.rlike(r"\S"), named).otherwise(start)


def quoted(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, span_no, start, end, quote) from rows with spans, text and section."""
    each = rows.select(*keys, "text", "section", F.posexplode_outer("spans").alias("span_no", "s")).filter("s IS NOT NULL")
    placed = each.select(*keys, F.col("span_no").cast("long").alias("span_no"), "text", past_heading(F.col("text"), F.col("section"), F.col("s.start"), F.col("s.end")).alias("start"), F.col("s.end").alias("end"))
    return placed.select(*keys, "span_no", "start", "end", F.substring("text", (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int")).alias("quote"))


def _texts(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, "text", F.col("section") if "section" in df.columns else F.lit("").alias("section"))


def attached_spans(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """(answer_id, source_number, span_no, start, end, quote): up to SPANS disjoint passages of a source that its claims rest on."""
    words = claims(answers).select("answer_id", F.explode_outer("cited").alias("source_number"), claim_words(F.col("claim")).alias("words")).filter("source_number IS NOT NULL AND size(words) > 0")
    asked = words.groupBy("answer_id", "source_number").agg(F.collect_set("words").alias("claims"))  # an answer's own sentences
    rows = indexed(asked.join(_texts(sources, "answer_id", "source_number"), ["answer_id", "source_number"]))
    best = F.filter(F.transform("claims", lambda c: best_span(c, F.col("sents"))), lambda x: x.isNotNull())
    return quoted(rows.withColumn("best", best).withColumn("spans", apart(F.col("best"), SPANS)), ["answer_id", "source_number"])


def query_spans(queries: DataFrame, passages: DataFrame) -> DataFrame:
    """(query_id, passage_id, span_no, start, end, quote): the QUERY_SPANS sentences of each passage that share most words with its query.

    queries: query_id, query; passages: query_id, passage_id, text, section. Then shorter ones, then later ones; two shared
    words are asked for, one of a query with fewer than three.
    """
    asked = queries.select("query_id", N.content_words(F.coalesce("query", F.lit(""))).alias("claim")).filter(F.size("claim") > 0)
    rows = indexed(asked.join(_texts(passages, "query_id", "passage_id"), "query_id"))
    scored = F.transform("sents", lambda s: F.struct(F.size(F.array_intersect("claim", s["words"])).alias("shared"), (s["start"] - s["end"]).alias("tight"), s["start"].alias("start"), s["end"].alias("end")))
    rows = rows.withColumn("scored", F.filter(scored, lambda x: x["shared"] >= F.when(F.size("claim") < 3, 1).otherwise(SHARED)))
    return quoted(rows.withColumn("spans", apart(F.col("scored"), QUERY_SPANS)), ["query_id", "passage_id"])


def claim_support(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """(answer_id, claim_no, supported): whether some cited source holds a span for each claim that cites a source on offer and has words enough."""
    asked = claims(answers).select("answer_id", "claim_no", F.explode_outer("cited").alias("source_number"), claim_words(F.col("claim")).alias("claim")).filter(F.col("source_number").isNotNull() & (F.size("claim") >= SHARED))
    groups = asked.groupBy("answer_id", "source_number").agg(F.collect_list(F.struct("claim_no", "claim")).alias("claims"))  # an answer's own sentences
    rows = indexed(groups.join(_texts(sources, "answer_id", "source_number"), ["answer_id", "source_number"]))
    each = rows.select("answer_id", "sents", F.explode_outer("claims").alias("c")).select("answer_id", "c.claim_no", best_span(F.col("c.claim"), F.col("sents")).isNotNull().alias("supported"))
    return each.groupBy("answer_id", "claim_no").agg(F.max("supported").alias("supported"))


def unsupported_numbers(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """(answer_id, unsupported): how many citing sentences state a number that none of their sources gives.

    A sentence that declines repeats the question's numbers: it states none. A source's name and section give numbers too
    (columns filename, section). Sources that aren't on offer give nothing and ask nothing.
    """
    bare = F.regexp_replace(F.regexp_replace("claim", N.MARKER, " "), N.LIST_MARK, "")
    stated = F.when(R.opens_with_refusal(R.folded(bare)), F.array().cast("array<string>")).otherwise(N.claimed_numbers(F.col("claim")))
    told = claims(answers).select("answer_id", "claim_no", stated.alias("stated"), F.explode_outer("cited").alias("source_number")).filter("source_number IS NOT NULL AND size(stated) > 0")
    name = F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in ("filename", "section") if c in sources.columns], F.lit(""))
    given = sources.select("answer_id", "source_number", N.source_numbers(F.coalesce("text", F.lit("")), F.lower(name)).alias("given"))
    claim = told.join(given, ["answer_id", "source_number"]).groupBy("answer_id", "claim_no").agg(F.first("stated").alias("stated"), F.flatten(F.collect_list("given")).alias("given"))
    bad = claim.groupBy("answer_id").agg(F.count(F.when(F.size(F.array_except("stated", "given")) > 0, 1)).alias("unsupported"))
    return answers.select("answer_id").join(bad, "answer_id", "left").select("answer_id", F.coalesce("unsupported", F.lit(0)).cast("long").alias("unsupported"))
