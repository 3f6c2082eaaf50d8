"""Files as tables: folders, charsets, and small text formats cut into sections by DataFrame operations.

Every parser takes (name, text) and gives (name, page, ordinal, section, text). A file that cannot be read is a row of
unreadable(), never a failed job. Formats that need a binary library (office files, PDF, images) are not read here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathomline.functions import text as T

#: Share of control characters above which bytes are no text.
BINARY_SHARE = 0.1


def folder(spark: SparkSession, path: str, include: str = "*", max_bytes: int = 50 << 20, exclude: str | None = None) -> DataFrame:
    """(name, path, modified, size, content) of a folder's files, subfolders included.

    include is a glob on names; exclude a regular expression on paths, and beats it. Larger files are left out before
    their bytes are read. Of equal names, the first path is taken.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", include).load(path).filter(F.col("length") <= max_bytes)
    if exclude:
        files = files.filter(~F.col("path").rlike(exclude))
    named = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"), "content")
    first = named.groupBy("name").agg(F.min("path").alias("path"))
    return named.join(first, ["name", "path"], "left_semi")


def decoded(files: DataFrame) -> DataFrame:
    """(name, text): bytes by their byte order mark, as UTF-8, else as Latin-1; null text where too much is control characters."""
    c = F.col("content")
    head = F.hex(F.substring(c, 1, 3))
    utf8 = F.expr("is_valid_utf8(cast(content as string))")
    text = F.when(head == "EFBBBF", F.expr("cast(substring(content, 4) as string)")).when(head.startswith("FFFE"), F.decode(F.expr("substring(content, 3)"), "UTF-16LE")).when(head.startswith("FEFF"), F.decode(F.expr("substring(content, 3)"), "UTF-16BE"))
    text = text.when(utf8, c.cast("string")).otherwise(F.decode(c, "ISO-8859-1"))
    control = F.regexp_count("t", F.lit(r"[\x00-\x08\x0E-\x1F]"))
    return files.select("name", text.alias("t")).select("name", F.when(control <= BINARY_SHARE * F.greatest(F.char_length("t"), F.lit(1)), T.clean(F.col("t"))).alias("text"))


def unreadable(texts: DataFrame) -> DataFrame:
    """(name, status): binary or empty files."""
    blank = F.col("text").isNull() | ~F.col("text").rlike(r"\S")
    return texts.filter(blank).select("name", F.when(F.col("text").isNull(), "binary").otherwise("empty").alias("status"))


def _lines(texts: DataFrame) -> DataFrame:
    return texts.select("name", F.posexplode(F.split(T.normalize(F.coalesce("text", F.lit(""))), "\n")).alias("pos", "line"))


def _joined(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Lines of a section in order; a section is a part of one file."""
    out = rows.groupBy("name", *keys).agg(F.sort_array(F.collect_list(F.struct("pos", "line"))).alias("ls"))
    return out.withColumn("text", F.array_join(F.transform("ls", lambda x: x["line"]), "\n")).drop("ls")


def markdown(texts: DataFrame) -> DataFrame:
    """Sections begin at headings outside fences; the heading line stays in its section and is its label.

    A heading begins with #, or is a line over a line of equals signs. A line of dashes makes none: it may be a rule.
    """
    w = Window.partitionBy("name").orderBy("pos")
    fence = F.sum(F.col("line").rlike(r"^\s*(```|~~~)").cast("int")).over(w)
    lines = _lines(texts).withColumn("open", fence % 2 == 1)
    under = r"^\s{0,3}=+\s*$"
    above, below = F.coalesce(F.lag("line").over(w), F.lit("")), F.coalesce(F.lead("line").over(w), F.lit(""))
    titled = F.col("line").rlike(r"\S") & below.rlike(under) & ~(F.col("line").rlike(under) & above.rlike(r"\S"))
    lines = lines.withColumn("titled", titled)
    starts = ~F.col("open") & (F.col("line").rlike(r"^\s{0,3}#{1,6}\s+\S") | F.col("titled"))
    lines = lines.withColumn("ordinal", F.sum(starts.cast("int")).over(w)).withColumn("head", F.when(starts, T.label(F.regexp_replace("line", r"^\s*#+\s+|\s+#*\s*$", ""))))
    labels = lines.groupBy("name", "ordinal").agg(F.max("head").alias("section"))
    out = _joined(lines, ["ordinal"]).join(labels, ["name", "ordinal"]).filter(F.col("text").rlike(r"\S"))
    return out.select("name", F.lit(1).cast("long").alias("page"), "ordinal", F.coalesce("section", F.lit("")).alias("section"), "text")


def subtitles(texts: DataFrame) -> DataFrame:
    """Cues (SRT or VTT) gathered by the minute they begin in; a page for each minute."""
    blocks = texts.select("name", F.posexplode(F.split(T.normalize(F.col("text")), r"\n\s*\n")).alias("pos", "block"))
    time = r"(?:(\d+):)?(\d{1,2}):(\d{2})[.,]\d{3}\s*-->"
    part = lambda k: F.coalesce(F.nullif(F.regexp_extract("block", time, k), F.lit("")).cast("long"), F.lit(0))
    cues = blocks.filter(F.col("block").rlike(time)).select("name", "pos", (part(1) * 60 + part(2)).alias("minute"), T.collapse(F.regexp_replace("block", r"(?s)^.*?-->[^\n]*\n?", "")).alias("line"))
    out = _joined(cues.filter("line <> ''"), ["minute"])
    return out.select("name", (F.col("minute") + 1).alias("page"), F.col("minute").alias("ordinal"), F.format_string("minute %d", "minute").alias("section"), "text")


#: What may stand between cells. Characters that are looked at; the share of lines that must agree.
DELIMITERS, LOOKED_AT, AGREE = (",", ";", "\t", "|"), 2048, 0.7


def sniffed(text: Column) -> Column:
    """The delimiter of a text of rows: the one of which most lines hold the same number, above none, outside quotes; else a comma.

    Of equals the one with more cells, then the order of DELIMITERS. A line that the look cuts short doesn't count.
    """
    t = F.coalesce(text, F.lit(""))
    head = F.when(F.char_length(t) > LOOKED_AT, F.regexp_replace(F.substring(t, 1, LOOKED_AT), r"\n[^\n]*$", "")).otherwise(t)
    lines = F.filter(F.split(F.regexp_replace(head, r'"(?:[^"]|"")*+"', ""), r"\r?\n"), lambda x: x.rlike(r"\S"))

    def score(d: str, place: int) -> Column:
        counts = F.transform(lines, lambda x: F.char_length(x) - F.char_length(F.replace(x, F.lit(d), F.lit(""))))
        return F.transform(F.filter(F.array_distinct(counts), lambda n: n > 0), lambda n: F.struct((F.size(F.filter(counts, lambda c: c == n)) / F.size(counts)).alias("share"), n.alias("n"), F.lit(-place).alias("place"), F.lit(d).alias("d")))

    best = F.array_max(F.filter(F.concat(*[score(d, k) for k, d in enumerate(DELIMITERS)]), lambda s: s["share"] >= AGREE))
    return F.coalesce(best["d"], F.lit(","))


def fields(line: Column, delimiter: str = ",") -> Column:
    """The cells of a delimited line; quoted ones may hold the delimiter and doubled quotes."""
    d = f"[{delimiter}]"
    raw = F.regexp_extract_all(F.concat(line, F.lit(delimiter)), F.lit(rf'("(?:[^"]|"")*"|[^{delimiter}]*){d}'))
    return F.transform(raw, lambda c: F.when(c.startswith('"'), F.replace(F.regexp_replace(c, '^"|"$', ""), F.lit('""'), F.lit('"'))).otherwise(F.trim(c)))


def delimited(texts: DataFrame, rows_per_section: int = 50, delimiter: str | None = ",") -> DataFrame:
    """Rows as "column: value; …" lines under the first line that isn't blank, by spreadsheet row numbers; blank rows count.

    delimiter None: each file's own is found. A cell without a column is named by its place; empty cells are left out.
    """
    own = texts.select("name", "text", (sniffed(F.col("text")) if delimiter is None else F.lit(delimiter)).alias("delimiter"))
    lines = _lines(texts).filter(F.col("line").rlike(r"\S")).join(own.select("name", "delimiter"), "name")
    heads = lines.groupBy("name").agg(F.min_by("line", "pos").alias("head"), F.min("pos").alias("first"))
    kinds = DELIMITERS if delimiter is None else (delimiter,)

    def cells(c: str) -> Column:
        out = fields(F.col(c), kinds[0])
        for d in kinds[1:]:
            out = F.when(F.col("delimiter") == d, fields(F.col(c), d)).otherwise(out)
        return out

    rows = lines.join(heads, "name").filter("pos > first").select("name", "pos", F.zip_with(cells("line"), cells("head"), lambda v, h: F.struct(v.alias("v"), h.alias("h"))).alias("cells"))
    named = F.transform("cells", lambda c, i: F.struct(c["v"].alias("v"), F.when(F.coalesce(c["h"], F.lit("")) == "", F.concat(F.lit("col"), i + 1)).otherwise(c["h"]).alias("h")))
    shown = F.array_join(F.transform(F.filter(named, lambda c: F.coalesce(c["v"], F.lit("")) != ""), lambda c: F.concat(c["h"], F.lit(": "), c["v"])), "; ")
    rows = rows.select("name", "pos", shown.alias("line"), F.floor((F.col("pos") - 1) / rows_per_section).alias("ordinal")).filter("line <> ''")
    edges = rows.groupBy("name", "ordinal").agg(F.min("pos").alias("a"), F.max("pos").alias("b"))
    return _joined(rows, ["ordinal"]).join(edges, ["name", "ordinal"]).select("name", F.lit(1).cast("long").alias("page"), "ordinal", F.format_string("Rows %d-%d", F.col("a") + 1, F.col("b") + 1).alias("section"), "text")


def json_lines(texts: DataFrame) -> DataFrame:
    """A section for each record: its fields as "key: value" lines in the order of keys; broken records are left out."""
    records = _lines(texts).filter(F.col("line").rlike(r"\S")).withColumn("m", F.from_json("line", "map<string,string>")).filter("m is not null")
    shown = F.transform(F.array_sort(F.map_keys("m")), lambda k: F.concat(k, F.lit(": "), F.coalesce(F.element_at("m", k), F.lit(""))))
    return records.select("name", F.lit(1).cast("long").alias("page"), F.col("pos").cast("long").alias("ordinal"), F.format_string("Record %d", F.col("pos") + 1).alias("section"), F.array_join(shown, "\n").alias("text"))


def mail(texts: DataFrame) -> DataFrame:
    """A message's header lines that matter as one section, its body as another."""
    t = T.normalize(F.col("text"))
    parts = texts.select("name", F.split(t, r"\n\s*\n", 2).alias("p"))
    head = F.array_join(F.regexp_extract_all(F.concat(F.lit("\n"), F.col("p")[0]), F.lit(r"\n((?:From|To|Date|Subject): [^\n]*)")), "\n")
    both = F.array(F.struct(F.lit(0).cast("long").alias("ordinal"), F.lit("Header").alias("section"), head.alias("text")), F.struct(F.lit(1).cast("long").alias("ordinal"), F.regexp_extract(F.col("p")[0], r"(?m)^Subject: ([^\n]*)", 1).alias("section"), F.coalesce(F.get("p", 1), F.lit("")).alias("text")))
    return parts.select("name", F.explode(both).alias("s")).select("name", F.lit(1).cast("long").alias("page"), "s.ordinal", "s.section", "s.text").filter(F.col("text").rlike(r"\S"))


def listed_pages(xml: DataFrame) -> DataFrame:
    """(name, url, modified) of sitemap and feed entries; a date alone means the end of that day (UTC)."""
    entry = F.explode(F.regexp_extract_all("text", F.lit(r"(?s)<(?:url|item|entry|sitemap)>(.*?)</(?:url|item|entry|sitemap)>")))
    rows = xml.select("name", entry.alias("e"))
    url = F.trim(F.coalesce(F.nullif(F.regexp_extract("e", r"(?s)<(?:loc|link)>(.*?)</(?:loc|link)>", 1), F.lit("")), F.regexp_extract("e", r'<link[^>]*href="([^"]*)"', 1)))
    raw = F.trim(F.regexp_extract("e", r"(?s)<(?:lastmod|pubDate|updated)>(.*?)</", 1))
    at = F.when(raw.rlike(r"^\d{4}-\d\d-\d\d$"), F.try_to_timestamp(F.concat(raw, F.lit(" 23:59:59")))).otherwise(F.coalesce(F.try_to_timestamp(raw), F.try_to_timestamp(F.regexp_replace(raw, r"^[A-Za-z]+, | (GMT|UTC|[+-]0000)$", ""), F.lit("d MMM yyyy HH:mm:ss"))))
    return rows.select("name", url.alias("url"), at.alias("modified")).filter("url <> ''")
