"""Names, tags, sections and prompts: what is normalised, numbered, merged or fitted before it is stored or sent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.functions import text as T
from fathomline.operators.telemetry import folded

#: Characters of a tag, tags of a document.
TAG, TAGS = 40, 20

#: A source number as prompts() writes it.
NUMBER = r"\[\d+\]"


def normalized_tags(tags: Column) -> Column:
    """Tags collapsed, of 1 to TAG printable characters, the first of those that differ in case only, TAGS at most."""
    fit = F.filter(F.transform(F.coalesce(tags, F.array().cast("array<string>")), lambda t: T.collapse(t)), lambda t: (F.char_length(t) >= 1) & (F.char_length(t) <= TAG) & ~t.rlike(r"\p{Cntrl}"))
    once = F.aggregate(fit, F.array().cast("array<string>"), lambda kept, t: F.when(F.exists(kept, lambda k: F.lower(k) == F.lower(t)), kept).otherwise(F.array_append(kept, t)))
    return F.slice(once, 1, TAGS)


def stored_variants(wanted: DataFrame, stored: DataFrame) -> DataFrame:
    """(wanted, tag): stored tags that equal a wanted one but for case and spaces; where none does, the wanted one itself."""
    key = lambda c: F.lower(T.collapse(F.col(c)))
    found = wanted.select("wanted", key("wanted").alias("k")).join(stored.select("tag", key("tag").alias("k")).distinct(), "k", "left")
    return found.select("wanted", F.coalesce("tag", "wanted").alias("tag"))


def conflicting_names(names: DataFrame) -> DataFrame:
    """(name, first_name) of names that differ from a smaller one in case only."""
    first = names.groupBy(F.lower("name").alias("k")).agg(F.min("name").alias("first_name"), F.count_distinct("name").alias("n")).filter("n > 1")
    return names.select("name", F.lower("name").alias("k")).distinct().join(first, "k").filter("name <> first_name").select("name", "first_name")


def glob(pattern: str) -> str:
    """A glob as a regular expression: * and ? stop at slashes, ** does not."""
    out, k = "", 0
    while k < len(pattern):
        c = pattern[k]
        if pattern.startswith("**", k):
            out, k = out + ".*", k + 1
        else:
            out += "[^/]*" if c == "*" else "[^/]" if c == "?" else c if c.isalnum() or c in "_/" else f"\\{c}"
        k += 1
    return f"^{out}$"


def matching(names: DataFrame, include: list[str], exclude: list[str], col: str = "name") -> DataFrame:
    """Names that an include glob fits and no exclude glob; a glob without a slash is for the last part of a name."""

    def fits(patterns: list[str]) -> Column:
        out = F.lit(False)
        for p in patterns:
            out = out | (F.col(col) if "/" in p else F.element_at(F.split(F.col(col), "/"), -1)).rlike(glob(p))
        return out

    return names.filter((fits(include) if include else F.lit(True)) & ~fits(exclude))


def distinct_lines(docs: DataFrame, id_col: str, text_col: str, limit: int) -> DataFrame:
    """(id, place, line): a text's first lines, of those that differ in case or outer spaces only the first."""
    lines = docs.select(F.col(id_col), F.posexplode(F.split(text_col, "\n")).alias("pos", "line")).select(id_col, "pos", F.trim("line").alias("line")).filter("line <> ''")
    first = lines.groupBy(id_col, F.lower("line").alias("k")).agg(F.min(F.struct("pos", "line")).alias("f")).select(id_col, "f.*")
    return first.withColumn("place", F.row_number().over(Window.partitionBy(id_col).orderBy("pos")).cast("long")).filter(F.col("place") <= limit).select(id_col, "place", "line")


def merged_sections(sections: DataFrame, doc: str, ordinal: str, words: str, least: int) -> DataFrame:
    """(doc, ordinal, section): consecutive small sections gathered until they hold at least so many words."""

    def step(state: tuple[int, int], row: dict) -> tuple[tuple[int, int], int]:
        number, held = state
        held += row[words]
        return ((number + 1, 0) if held >= least else (number, held)), number

    return folded(sections, doc, [ordinal], [words], "section long", lambda: (1, 0), step).select(doc, ordinal, "section")


def fitted(passages: DataFrame, query: str, rank: str, tokens: str, budget: int) -> DataFrame:
    """passages that a prompt has room for: best first, as long as their tokens fit; the best one always stays."""
    w = Window.partitionBy(query).orderBy(rank)
    placed = passages.withColumn("used", F.sum(tokens).over(w)).withColumn("place", F.row_number().over(w))
    return placed.filter((F.col("used") <= budget) | (F.col("place") == 1)).drop("place")


def prompts(passages: DataFrame, query: str, rank: str, filename: str, text: str) -> DataFrame:
    """(query, sources, prompt): passages as numbered blocks in the order of rank; a question has few."""
    block = F.concat(F.lit("["), F.col(rank).cast("string"), F.lit("] filename="), F.col(filename), F.lit("\n"), F.col(text))
    out = passages.groupBy(query).agg(F.sort_array(F.collect_list(F.struct(F.col(rank).alias("r"), block.alias("b")))).alias("bs"))
    return out.select(query, F.size("bs").cast("long").alias("sources"), F.array_join(F.transform("bs", lambda x: x["b"]), "\n\n").alias("prompt"))


def without_echo(answer: Column) -> Column:
    """An answer without the lines that repeat a source header as prompts() writes it: numbers in brackets, then filename=.

    Quote and list signs may stand before it; all other lines stay as they are.
    """
    header = rf"^[^\w\[]*(?:{NUMBER}[^\w\[]*)+filename="
    return F.array_join(F.filter(F.split(answer, "\n"), lambda line: ~line.rlike(header)), "\n")


def what_if(scored: DataFrame, score: str, before: float, after: float) -> DataFrame:
    """(checked, would_answer, newly_answered, newly_unanswered) under another bar."""
    was, now = F.col(score) >= before, F.col(score) >= after
    total = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return scored.agg(F.count(F.lit(1)).alias("checked"), total(now).alias("would_answer"), total(now & ~was).alias("newly_answered"), total(was & ~now).alias("newly_unanswered"))


def known_pages(listed: DataFrame, stored: DataFrame) -> DataFrame:
    """(url, outcome) of listed pages against stored sources: new, newer or unchanged."""
    both = listed.join(stored.select("url", "fetched"), "url", "left")
    outcome = F.when(F.col("fetched").isNull(), "new").when(F.col("modified") > F.col("fetched"), "newer").otherwise("unchanged")
    return both.select("url", outcome.alias("outcome"))
