"""Pages that a site lists: sitemaps, sitemap indexes (one level), RSS and Atom feeds, robots.txt, as joins over fetched files.

files: url, text (what a fetch gave; null is empty). A document type is refused. Any namespace prefix is allowed; comments
and marked sections are read as XML means them. Links may be relative to the file they stand in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.functions import text as T
from fathomline.operators import structured as S

#: Sitemaps of an index that are read; pages of a site.
CHILDREN, PAGES = 50, 10_000
_NAME = r"(?:[A-Za-z_][\w.-]*:)?"
_INSIDE = r"""(?:[^>"']|"[^"]*+"|'[^']*+')*+"""


def _tag(name: str) -> str:
    """An element's inner text, first group."""
    return rf"(?s)<{_NAME}{name}(?:\s{_INSIDE})?+(?<!/)>(.*?)</{_NAME}{name}\s*>"


def _first(text: Column, name: str) -> Column:
    return F.get(F.regexp_extract_all(text, F.lit(_tag(name)), F.lit(1)), F.lit(0))


def _value(inner: Column) -> Column:
    """What an element without children says."""
    marked = r"(?s)<!\[CDATA\[(.*?)\]\]>"
    return F.trim(F.when(inner.rlike(marked), F.regexp_replace(inner, marked, "$1")).otherwise(S.unescaped(inner)))


def moment(raw: Column) -> Column:
    """A date as feeds and sitemaps write it, UTC where no zone is told; a date alone is the end of its day; null if unreadable."""
    text = F.trim(raw)
    plain = F.regexp_replace(F.regexp_replace(text, r"^[A-Za-z]{3},\s+", ""), r"\s+(?:GMT|UTC|UT|Z)$", " +0000")
    return F.when(text.rlike(r"^\d{4}-\d\d-\d\d$"), F.try_to_timestamp(F.concat(text, F.lit("T23:59:59Z")))).otherwise(
        F.coalesce(F.when(text.rlike(r"^\d{4}-"), F.try_to_timestamp(text)), F.try_to_timestamp(plain, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(plain, F.lit("d MMM yyyy HH:mm:ss")))
    )


def resolved(link: Column, base: Column) -> Column:
    """A link as an address: as it stands, under the base's scheme, host or folder."""
    scheme, origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1), F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    path = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    folder = F.when(path == "", "/").otherwise(F.regexp_replace(path, r"[^/]*$", ""))
    return F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), link).when(link.startswith("//"), F.concat(scheme, link)).when(link.startswith("/"), F.concat(origin, link)).otherwise(F.concat(origin, folder, link))


def listed(files: DataFrame) -> DataFrame:
    """(file, place, kind, url, modified): what each file lists in order; kind is page or sitemap. Other files list nothing."""
    body = F.regexp_replace(F.coalesce("text", F.lit("")), r"(?s)<!--.*?-->", "")
    rows = files.select(F.col("url").alias("file"), body.alias("body")).withColumn("robots", F.lower(F.regexp_extract("file", r"^[^?#]*", 0)).endswith("/robots.txt"))
    rows = rows.withColumn("root", F.when(F.col("body").rlike(S.DECLARES), "").otherwise(F.lower(F.regexp_extract("body", rf"^\s*(?:<\?[^>]*\?>\s*)*<{_NAME}(urlset|sitemapindex|rss|feed)[\s>]", 1))))
    entry = lambda kind, url, at: F.struct(F.lit(kind).alias("kind"), url.alias("url"), at.alias("at"))
    none = F.lit(None).cast("string")
    each = lambda name, make: F.transform(F.regexp_extract_all("body", F.lit(_tag(name)), F.lit(1)), make)
    href = r"""href\s*=\s*["']([^"']*)["']"""
    links = lambda e: F.filter(F.regexp_extract_all(e, F.lit(rf"<{_NAME}link\s{_INSIDE}>"), F.lit(0)), lambda x: ~x.rlike(r"\srel\s*=") | x.rlike(r"""\srel\s*=\s*["']alternate["']"""))
    lines = F.filter(F.split("body", r"\r?\n"), lambda x: x.rlike(r"(?i)^\s*sitemap\s*:\s*\S"))
    found = (
        F.when(F.col("robots"), F.array_distinct(F.transform(lines, lambda x: entry("sitemap", F.trim(F.regexp_replace(x, r"^[^:]*:", "")), none))))
        .when(F.col("root") == "urlset", each("url", lambda e: entry("page", _value(_first(e, "loc")), _first(e, "lastmod"))))
        .when(F.col("root") == "sitemapindex", each("sitemap", lambda e: entry("sitemap", _value(_first(e, "loc")), none)))
        .when(F.col("root") == "rss", F.flatten(each("item", lambda e: F.transform(F.regexp_extract_all(e, F.lit(_tag("link")), F.lit(1)), lambda u: entry("page", _value(u), _first(e, "pubDate"))))))
        .when(F.col("root") == "feed", each("entry", lambda e: entry("page", S.unescaped(F.trim(F.regexp_extract(F.get(links(e), F.lit(0)), href, 1))), _first(e, "updated"))))
    )
    out = rows.select("file", F.posexplode_outer(found).alias("place", "e")).filter("e IS NOT NULL")
    return out.select("file", F.col("place").cast("long").alias("place"), "e.kind", F.coalesce("e.url", F.lit("")).alias("link"), moment(_value(F.col("e.at"))).alias("modified")).filter("link <> ''").withColumn("url", resolved(F.col("link"), F.col("file"))).drop("link")


def site_pages(sites: DataFrame, files: DataFrame, same_host: bool = True, most: int = PAGES) -> DataFrame:
    """(site, rank, url, modified): the pages that each site lists, once each, in the order they are listed, most at most.

    sites: site, the address of a listing, a robots.txt, or a site's root (then its robots.txt counts where it lists nothing).
    A listing's own pages come first, then those of the sitemaps it names, one level down.
    """
    host = T.host(F.col("site"))
    entries = listed(files.dropDuplicates(["url"]))
    direct = sites.select("site").distinct().join(entries, F.col("site") == F.col("file"))
    bare = sites.select("site").distinct().filter(F.col("site").rlike(r"^[a-zA-Z]+://[^/?#]+/?$")).join(entries.select("file").distinct(), F.col("site") == F.col("file"), "left_anti")
    robots = bare.withColumn("at", resolved(F.lit("/robots.txt"), F.col("site"))).join(entries, F.col("at") == F.col("file")).drop("at")
    top = direct.unionByName(robots).filter(F.lit(not same_host) | (F.col("kind") == "page") | (T.host(F.col("url")) == host))
    order = F.row_number().over(Window.partitionBy("site").orderBy("place"))
    children = top.filter("kind = 'sitemap'").withColumn("child", order).filter(F.col("child") <= CHILDREN).select("site", "child", F.col("url").alias("at"))
    below = children.join(entries.filter("kind = 'page'"), F.col("at") == F.col("file")).select("site", "child", "place", "url", "modified")
    pages = top.filter("kind = 'page'").select("site", F.lit(0).alias("child"), "place", "url", "modified").unionByName(below)
    kept = pages.filter(F.lower("url").rlike("^https?://") & (F.lit(not same_host) | (T.host(F.col("url")) == host)))
    once = kept.groupBy("site", "url").agg(F.min(F.struct("child", "place")).alias("o"), F.max_by("modified", F.when(F.col("modified").isNotNull(), F.col("child") * F.lit(1 << 40) + F.col("place"))).alias("modified"))
    rank = F.row_number().over(Window.partitionBy("site").orderBy("o"))
    return once.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= most).select("site", "rank", "url", "modified")
