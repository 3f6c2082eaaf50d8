"""Pages of documents put right: running heads and feet removed, words broken over line ends made whole.

pages: doc_id, page_no (from 1), text. Null texts are empty. Rules look at a document's own pages only: counts and its
vocabulary are aggregates by (doc_id, line) and (doc_id, word), so a document of any length is many small groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.functions import text as T

#: Lines at either edge that are looked at; pages a document must have; the share of them a running line is on.
EDGE, LEAST, SHARE = 2, 3, 0.6
#: A page number once digits are "#": a whole line, or one end set off by a separator or a word for page.
_PAGE, _SEP = r"(?:page|pg\.?|p\.|seite|página|pagina)", r"[-–—|•·:]"
_NUMBER = rf"(?:{_PAGE}\s*)?#(?:\s*(?:of|/|von|de|di|sur)\s*#)?"
PAGE_NUMBER = rf"^(?:{_SEP}\s*)*{_NUMBER}(?:\s*{_SEP})*$|(?:{_SEP}|\s{_PAGE})\s*{_NUMBER}(?:\s*{_SEP})*$|^(?:{_SEP}\s*)*{_NUMBER}\s*{_SEP}|^{_PAGE}\s*#"
LEADING, TRAILING = r"^(\d{1,4})\s+(?=\S)", r"(?<=\S)\s+(\d{1,4})$"
#: A word broken over a line end; words and compounds.
BREAK, WORDS = r"(?<!\p{L})(\p{L}++)-\n(\p{L}++)", r"\p{L}++(?:-\p{L}++)*+"


# --- running lines --------------------------------------------------------------------------------------------------


def _two_words(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w.rlike(r"\p{L}"))) >= 2


def _without(line: Column, pattern: str) -> Column:
    return F.trim(F.regexp_replace(line, pattern, ""))


def _keys(exact: Column, outer: Column, page: Column) -> Column:
    """What an edge line is matched by: its text; at the very edge also with digits ignored, or by a number that goes with the page."""
    masked = F.regexp_replace(exact, r"\d+", "#")
    numbered = F.when(outer & exact.rlike(r"\d") & masked.rlike(PAGE_NUMBER), F.concat(F.lit("#digits:"), masked))

    def tracked(pattern: str, put) -> Column:
        rest = put(F.regexp_replace(exact, pattern, ""))
        offset = F.regexp_extract(exact, pattern, 1).cast("int") - page
        return F.when(_two_words(rest), F.concat_ws(":", F.lit("#page"), (page % 2).cast("string"), offset.cast("string"), rest))

    tracking = F.when(exact.rlike(LEADING), tracked(LEADING, lambda r: F.concat(F.lit("#"), r))).when(exact.rlike(TRAILING), tracked(TRAILING, lambda r: F.concat(r, F.lit("#"))))
    return F.array_compact(F.array(exact, numbered, F.when(outer, tracking)))


def edge_lines(pages: DataFrame) -> DataFrame:
    """(doc_id, page_no, line, outer, exact, keys): the first and last EDGE lines of each page that aren't blank."""
    rows = pages.select("doc_id", "page_no", F.split(F.coalesce("text", F.lit("")), "\n").alias("lines"))
    rows = rows.withColumn("told", F.filter(F.transform("lines", lambda x, i: F.struct(i.alias("i"), F.lower(T.collapse(x)).alias("x"))), lambda s: s["x"] != ""))
    ends = F.array_distinct(F.concat(F.slice("told", 1, EDGE), F.slice("told", F.greatest(F.size("told") - EDGE, F.lit(0)) + 1, F.lit(EDGE))))
    outer = (F.col("e.i") == F.get("told", F.lit(0))["i"]) | (F.col("e.i") == F.get("told", F.size("told") - 1)["i"])
    each = rows.select("doc_id", "page_no", "told", F.explode_outer(ends).alias("e")).filter("e IS NOT NULL").select("doc_id", "page_no", F.col("e.i").alias("line"), outer.alias("outer"), F.col("e.x").alias("exact"))
    return each.withColumn("keys", _keys(F.col("exact"), F.col("outer"), F.col("page_no")))


def running_keys(edges: DataFrame) -> DataFrame:
    """(doc_id, key): what is on SHARE of a document's pages (LEAST at least); heads that track the page: of the pages on that side."""
    counts = edges.select("doc_id", "page_no", F.explode("keys").alias("key")).groupBy("doc_id", "key").agg(F.count_distinct("page_no").alias("n"))
    page = edges.select("doc_id", "page_no").distinct().groupBy("doc_id").agg(F.count("*").alias("pages"), F.count_if(F.col("page_no") % 2 == 0).alias("even"), F.count_if(F.col("page_no") % 2 == 1).alias("odd"))
    side = F.when(F.col("key").startswith("#page:0"), F.col("even")).otherwise(F.col("odd"))
    enough = F.when(F.col("key").startswith("#page:"), F.col("n") >= F.greatest(F.lit(2), F.ceil(side * SHARE))).otherwise(F.col("n") >= F.greatest(F.lit(LEAST), F.floor(F.col("pages") * SHARE + 0.999)))
    return counts.join(page.filter(F.col("pages") >= LEAST), "doc_id").filter(enough).select("doc_id", "key")


def without_running_lines(pages: DataFrame) -> DataFrame:
    """pages (doc_id, page_no, text) without running heads and feet.

    The outermost line goes from every page. A repeat one line in may be content: its first copy in the document stays. A
    head on one side of the pages proves where their numbers stand; the other side's line then loses its number only.
    """
    edges = edge_lines(pages)
    running = running_keys(edges)
    hit = edges.select("doc_id", "page_no", "line", "outer", "exact", F.explode("keys").alias("key")).join(running, ["doc_id", "key"]).groupBy("doc_id", "page_no", "line").agg(F.first("outer").alias("outer"), F.first("exact").alias("exact"))
    again = F.row_number().over(Window.partitionBy("doc_id", "outer", "exact").orderBy("page_no", "line")) > 1
    drops = hit.withColumn("again", again).filter("outer OR again").groupBy("doc_id", "page_no").agg(F.collect_set("line").alias("drops"))
    offset = F.regexp_extract("key", r"^#page:\d:(-?\d+):", 1)
    of_doc = running.groupBy("doc_id").agg(F.collect_set(F.when(offset != "", offset.cast("int"))).alias("offsets"))  # one or two a document
    rows = pages.select("doc_id", "page_no", F.coalesce("text", F.lit("")).alias("text")).join(of_doc, "doc_id", "left").join(drops, ["doc_id", "page_no"], "left")

    def cleaned(line: Column) -> Column:
        out, flat = line, F.trim(line)
        for p in (TRAILING, LEADING):
            number = F.regexp_extract(flat, p, 1)
            fits = flat.rlike(p) & F.array_contains("offsets", (F.when(number != "", number).cast("int") - F.col("page_no")).cast("int")) & _two_words(_without(flat, p))
            out = F.when(fits, _without(flat, p)).otherwise(out)
        return out

    lines = F.filter(F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda s: ~F.array_contains(F.coalesce("drops", F.array().cast("array<int>")), s["i"]))
    rows = rows.withColumn("told", F.filter(F.transform(F.split("text", "\n"), lambda x, i: F.when(x.rlike(r"\S"), i)), lambda i: i.isNotNull())).withColumn("lines", lines)
    edge = lambda i: (i == F.get("told", F.lit(0))) | (i == F.get("told", F.size("told") - 1))
    kept = F.transform("lines", lambda s: F.when((F.size("offsets") > 0) & edge(s["i"]), cleaned(s["x"])).otherwise(s["x"]))
    return rows.select("doc_id", "page_no", F.when(F.col("offsets").isNull(), F.col("text")).otherwise(T.normalize(F.array_join(kept, "\n"))).alias("text"))


# --- broken words ---------------------------------------------------------------------------------------------------


def rejoined(pages: DataFrame) -> DataFrame:
    """pages with words that break over a line end made whole, as the document's own words decide.

    A compound seen elsewhere keeps its hyphen; a whole word seen elsewhere is joined; before a capital the hyphen stays, and
    between two words that the document uses; else the halves are joined.
    """
    rows = pages.select("doc_id", "page_no", F.coalesce("text", F.lit("")).alias("text"))
    pair = F.zip_with(F.regexp_extract_all("text", F.lit(BREAK), F.lit(1)), F.regexp_extract_all("text", F.lit(BREAK), F.lit(2)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    broken = rows.select("doc_id", "page_no", F.posexplode_outer(pair).alias("k", "p")).filter("p IS NOT NULL").select("doc_id", "page_no", "k", "p.a", "p.b")

    asked = broken.select("doc_id", "a", "b").distinct()
    low = lambda *x: F.lower(F.concat(*x))
    forms = F.array(*[F.struct(F.lit(role).alias("role"), form.alias("form")) for role, form in (("compound", low("a", F.lit("-"), "b")), ("joined", low("a", "b")), ("first", low("a")), ("second", low("b")))])
    asked = asked.select("doc_id", "a", "b", F.explode(forms).alias("f")).select("doc_id", "a", "b", "f.role", "f.form")
    told = F.array_distinct(F.transform(F.regexp_extract_all(F.regexp_replace("text", BREAK, " "), F.lit(WORDS), F.lit(0)), lambda w: F.lower(w)))
    halves = F.flatten(F.transform(told, lambda w: F.when(w.contains("-"), F.concat(F.array(w), F.split(w, "-"))).otherwise(F.array(w))))
    vocabulary = rows.join(broken.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", F.explode(F.array_distinct(halves)).alias("form")).distinct().withColumn("known", F.lit(True))
    known = asked.join(vocabulary, ["doc_id", "form"], "left").groupBy("doc_id", "a", "b").agg(*[F.coalesce(F.max(F.when(F.col("role") == r, F.col("known"))), F.lit(False)).alias(r) for r in ("compound", "joined", "first", "second")])
    hyphen = F.col("compound") | (~F.col("joined") & (F.substring("b", 1, 1).rlike(r"\p{Lu}") | (F.col("first") & F.col("second"))))
    whole = known.select("doc_id", "a", "b", F.when(hyphen, F.concat("a", F.lit("-"), "b")).otherwise(F.concat("a", "b")).alias("whole"))

    put = broken.join(whole, ["doc_id", "a", "b"]).groupBy("doc_id", "page_no").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "whole"))), lambda x: x["whole"]).alias("wholes"))  # a page's own
    parts = F.zip_with(F.split("text", BREAK, -1), "wholes", lambda t, w: F.concat(t, F.coalesce(w, F.lit(""))))
    return rows.join(put, ["doc_id", "page_no"], "left").select("doc_id", "page_no", F.coalesce(F.array_join(parts, ""), "text").alias("text"))
