"""Text scalars as Columns: cleaning, tokens, labels, ids, excerpts. All stay in generated JVM code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a word is, CJK characters, ligatures and characters without width.
WORD = r"[\p{L}\p{N}_]+"
CJK = "[぀-ヿ㐀-䶿一-鿿가-힯豈-﫿ｦ-ﾟ]"
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
WIDTHLESS = "­​⁠﻿"
#: Characters for a token in prompt estimates, tokens around a message, tokens of an ordinary word.
CHARS_PER_TOKEN, MESSAGE_TOKENS, WORD_TOKENS = 3, 4, 1.6
#: Characters of a section label and of an excerpt.
LABEL, EXCERPT = 120, 200
#: Fixed value: a citation marker: numbers and ranges, separated by commas, in brackets.
MARKER = r"\[(\d{1,6}(?:\s*[-–]\s*\d{1,6})?(?:\s*,\s*\d{1,6}(?:\s*[-–]\s*\d{1,6})?)*)\]"
#: Fixed value: the URL namespace of name-based ids.
NAMESPACE_URL = "6ba7b8119dad11d180b400c04fd430c8"


def words(text: Column) -> Column:
    """The lower-cased words of a text, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"))


def clean(text: Column) -> Column:
    """Ligatures spelled out and characters without width removed."""
    out = F.translate(text, WIDTHLESS, "")
    for sign, letters in LIGATURES.items():
        out = F.replace(out, F.lit(sign), F.lit(letters))
    return out


def normalize(text: Column) -> Column:
    """Line ends as line feeds, outer white space removed."""
    return F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), r"^\s+|\s+$", "")


def collapse(text: Column) -> Column:
    """Runs of white space as one space, outer white space removed."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def label(text: Column) -> Column:
    """A section label: collapsed, at most LABEL characters."""
    return F.substring(collapse(text), 1, LABEL)


def excerpt(text: Column) -> Column:
    """A collapsed text, cut after EXCERPT characters with an ellipsis of three points."""
    flat = collapse(text)
    return F.when(F.char_length(flat) > EXCERPT, F.concat(F.rtrim(F.substring(flat, 1, EXCERPT)), F.lit("..."))).otherwise(flat)


def contextual(filename: Column, section: Column, text: Column) -> Column:
    """A passage under its document's and section's name, as it is embedded and reranked."""
    return F.concat(filename, F.lit(" › "), section, F.lit("\n"), text)


def cjk_count(text: Column) -> Column:
    """How many characters are CJK."""
    return F.regexp_count(text, F.lit(CJK))


def heuristic_tokens(text: Column) -> Column:
    """Tokens estimated by word: 1.6 for an ordinary one; CJK, punctuation and half of the digits where these are more."""
    parts = F.filter(F.split(text, r"\s+"), lambda w: F.char_length(w) > 0)
    pieces = F.transform(parts, lambda w: F.greatest(F.lit(WORD_TOKENS), (cjk_count(w) + F.regexp_count(w, F.lit(r"[^\p{L}\p{N}_\s]")) + F.regexp_count(w, F.lit(r"\p{Nd}")) / 2.0).cast("double")))
    return F.ceil(F.round(F.aggregate(pieces, F.lit(0.0), lambda a, x: a + x), 6)).cast("long")


def prompt_tokens(text: Column) -> Column:
    """A deliberately high estimate: one token a CJK character, one for each three others, rounded up."""
    cjk = cjk_count(text)
    return (cjk + F.ceil((F.char_length(text) - cjk) / CHARS_PER_TOKEN)).cast("long")


def weighted_length(text: Column) -> Column:
    """Characters, a CJK character counting as three."""
    return (F.char_length(text) + (CHARS_PER_TOKEN - 1) * cjk_count(text)).cast("long")


def chunk_id(filename: Column, page: Column, section: Column, text: Column, occurrence: Column) -> Column:
    """A passage's id: it depends on where it stands and what it says, not on its position."""
    return F.substring(F.sha2(F.concat_ws("\n", filename, page.cast("string"), section, text, occurrence.cast("string")), 256), 1, 20)


def name_uuid(name: Column) -> Column:
    """The version-5 UUID of a name in the URL namespace."""
    h = F.sha1(F.concat(F.unhex(F.lit(NAMESPACE_URL)), name.cast("binary")))
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1), F.lit(1))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def cited_numbers(text: Column, most: Column) -> Column:
    """The distinct source numbers of [n], [n, m] and [n-m] markers, ascending; ranges are cut at most, backward ones ignored."""
    inner = F.regexp_extract_all(text, F.lit(MARKER))
    parts = F.flatten(F.transform(inner, lambda m: F.split(m, ",")))

    def expand(part: Column) -> Column:
        bounds = F.split(F.trim(part), r"\s*[-–]\s*")
        a, b = bounds[0].cast("int"), F.element_at(bounds, -1).cast("int")
        low, high = F.greatest(a, F.lit(1)), F.least(b, most.cast("int"))
        return F.when((a <= b) & (low <= high), F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

    return F.sort_array(F.array_distinct(F.flatten(F.transform(parts, expand))))


def backoff(base: Column, doublings: Column, cap: Column) -> Column:
    """base doubled so often (30 times at most), up to cap."""
    return F.least(base * F.pow(F.lit(2.0), F.least(doublings, F.lit(30))), cap)


def asks_about_the_past(text: Column) -> Column:
    """Whether a question names a year or asks for an earlier state."""
    return F.lower(text).rlike(r"\b(19|20)\d\d\b|\b(previous|previously|former|formerly|old|older|earlier|original|originally|used to|back then|last year|in the past)\b")


def sigmoid(x: Column) -> Column:
    """The logistic function, without overflow on either side."""
    e = F.exp(-F.abs(x))
    return F.when(x >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def host(url: Column) -> Column:
    """A URL's host, lower-cased, without port; empty where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/:?#]*)", 1))


def without_query(url: Column) -> Column:
    """A URL as it may be logged: no query, no fragment."""
    return F.regexp_replace(url, r"[?#].*$", "")


def page_name(url: Column) -> Column:
    """A document name from a URL's host and path."""
    path = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    stem = F.concat(host(url), F.regexp_replace(path, "/", "_"))
    return F.concat(F.regexp_replace(F.regexp_replace(stem, r"[^A-Za-z0-9_.\-]+", "_"), r"^[._]+|[._]+$", ""), F.lit(".html"))


#: Fixed value: where answers and passages are cut into sentences for quoting.
SENTENCE_END = r"(?<=[.!?。！？])\s+|\n+"


def sentences(text: Column) -> Column:
    """A text's sentences, outer white space removed, blank ones dropped."""
    return F.filter(F.transform(F.split(text, SENTENCE_END), lambda s: F.trim(s)), lambda s: s.rlike(r"\S"))


#: Characters that an overlap has at least, and a token of it at most.
LEAST_OVERLAP, TOKEN_CHARS = 20, 10


def without_overlap(before: Column, after: Column, tokens: int = 100, least: int = LEAST_OVERLAP) -> Column:
    """after without its beginning where before ends with it: the shortest such overlap of whole words, least characters up.

    Both edges of the overlap are word edges. It has at most TOKEN_CHARS for each of the tokens that passages may share, so
    the work for a pair is bounded however long its texts are; in repetitive text a short overlap cuts too little, not too much.
    """
    limit = F.least(F.char_length(before), F.char_length(after), F.lit(tokens * TOKEN_CHARS))
    ends = F.struct(F.right(F.concat(F.lit(" "), before), limit + 1).alias("tail"), F.substring(F.concat(after, F.lit(" ")), F.lit(1), limit + 1).alias("head"), limit.alias("limit"), F.left(after, F.lit(least)).alias("begin"))

    def sizes(e: Column) -> Column:
        m = e["limit"] + 1

        def overlaps(n: Column) -> Column:
            edges = F.substring(e["tail"], m - n, F.lit(1)).rlike(r"\s") & F.substring(e["head"], n + 1, F.lit(1)).rlike(r"\s")
            return (n < m) & (F.substring(e["tail"], m - n + 1, F.lit(least)) == e["begin"]) & edges & (F.right(e["tail"], n) == F.left(e["head"], n))

        return F.filter(F.sequence(F.lit(least), F.greatest(F.lit(least), e["limit"])), overlaps)

    # bound as a variable, or each size would cut both texts again
    cut = F.coalesce(F.get(F.transform(F.array(ends), sizes)[0], F.lit(0)), F.lit(0))
    return F.when(cut > 0, F.ltrim(F.substring(after, cut + 1, F.lit(1 << 30)))).otherwise(after)


def name_problem(name: Column, suffixes: list[str]) -> Column:
    """What is wrong with a document name; null if nothing is."""
    suffix = F.lower(F.regexp_extract(name, r"(\.[^./]*)$", 1))
    return (
        F.when(F.coalesce(F.trim(name), F.lit("")) == "", "empty").when(name.rlike(r"\p{Cntrl}"), "control character").when(name.rlike(r"(^|/)\.\.?(/|$)"), "dots")
        .when(name.rlike(r"(^|/)\."), "hidden").when(name.rlike(r"//|^/|/$"), "empty part").when(F.octet_length(name) > 255, "too long").when(~suffix.isin(suffixes), "unsupported")
    )


def front_matter_tags(text: Column) -> Column:
    """Tags of a Markdown text's front matter: an inline list or lines of dashes; none where it is not closed."""
    head = F.regexp_extract(text, r"(?s)^---\n(.*?)\n---(?:\n|$)", 1)
    inline = F.regexp_extract(head, r"(?m)^tags:[ \t]*\[([^\]\n]*)\]", 1)
    block = F.regexp_extract(head, r"(?m)^tags:[ \t]*\n((?:[ \t]*-[ \t]+[^\n]*(?:\n|$))+)", 1)
    raw = F.when(inline != "", F.split(inline, ",")).otherwise(F.split(F.regexp_replace(block, r"(?m)^[ \t]*-[ \t]+", ""), "\n"))
    return F.filter(F.transform(raw, lambda t: F.regexp_replace(F.trim(t), "^[\"']|[\"']$", "")), lambda t: t != "")
