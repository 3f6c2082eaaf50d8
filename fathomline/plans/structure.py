"""Structured files and pages, made from the tables: JSON paths, XML, notebooks, running lines, broken words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.operators import pages as P
from fathomline.operators import sites
from fathomline.operators import structured as S
from fathomline.sources import files
from fathomline.sources.tables import read

#: SQL that both engines read: events as nested objects, arrays, scalars and broken texts, by id.
JSON = """CASE event_id % 5
WHEN 0 THEN '{"id": ' || event_id || ', "user": {"name": "u › ' || user_id || '", "tags": ["x", "y' || user_id || '", null, true], "deep": {"props": ' || props || ', "none": {}, "list": []}}, "text": "{\\"not\\": [1]}  two\\n lines", "a": 1}'
WHEN 1 THEN '[' || event_id || ', "' || event_type || '", {"z": [1, {"k": ' || user_id || '}, [2, 3]], "b": false}, [], [[7], [8, 9]]]'
WHEN 2 THEN props
WHEN 3 THEN '"' || event_type || ' {' || user_id || '}"'
ELSE '{"open": [' || event_id END"""


def json_paths(spark: SparkSession, d: str) -> DataFrame:
    return S.json_lines(read(spark, d, "events").select(F.col("event_id").alias("doc_id"), F.expr(JSON.replace("\\", "\\\\")).alias("text")))


def xml_text(spark: SparkSession, d: str) -> DataFrame:
    """Whole documents as escaped text and as a marked section of an XML file; some declare a document type."""
    escaped = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", "&", "&amp;"), "<", "&lt;"), "\\|", "&#124;")
    begin = F.when(F.col("doc_id") % 11 == 3, '<?xml version="1.0"?><!DOCTYPE doc [<!ENTITY a "b">]>').otherwise('<?xml version="1.0"?>')
    xml = F.concat(begin, F.lit('<doc a="1>2"><id>'), "doc_id", F.lit("</id><body>"), escaped, F.lit("</body><!-- left <out> --><raw><![CDATA["), F.left("source", F.lit(3)), F.lit(" < &amp;]]></raw><e/>&#x65E5;</doc>"))
    return S.xml_lines(read(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", xml.alias("text")))


def notebook_cells(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as notebooks: questions are Markdown cells, answers code cells in lines, some with backticks."""
    c = read(spark, d, "conversations").withColumn("ticks", F.repeat(F.lit("`"), F.col("turn").cast("int")))
    source = F.when(F.col("role") == "user", F.to_json(F.struct(F.col("text").alias("source")))).otherwise(F.to_json(F.struct(F.array(F.concat("text", F.lit("\n")), "ticks").alias("source"))))
    cell = F.concat(F.lit('{"cell_type": "'), F.when(F.col("role") == "user", "markdown").when(F.col("turn") % 5 == 0, "raw").otherwise("code"), F.lit('", "outputs": [{"text": "left out"}], '), F.substring(source, F.lit(2), F.lit(1 << 30)))
    books = c.select("conv_id", "turn", cell.alias("cell")).groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "cell"))), lambda x: x["cell"]), ", ").alias("cells"))
    text = F.concat(F.lit('{"cells": ['), "cells", F.lit('], "metadata": {"kernelspec": {"name": "'), F.when(F.col("conv_id") % 2 == 0, "python3").otherwise("not a name"), F.lit('"}, "language_info": {"name": "R"}}}'))
    return S.notebook_markdown(books.select(F.col("conv_id").alias("doc_id"), text.alias("text")))


#: Lines of a made page.
PAGE = 6


def numbered_lines(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, n, page_no, body): documents in pages of PAGE lines; each line bears its number in the document."""
    docs = read(spark, d, "documents").select("doc_id", F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "").alias("lines"))
    docs = docs.withColumn("lines", F.transform("lines", lambda x, i: F.concat(x, F.lit(" (line "), (i + 1).cast("string"), F.lit(")")))).withColumn("n", F.ceil(F.size("lines") / PAGE).cast("int"))
    each = docs.filter("n > 0").select("doc_id", "n", "lines", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("page_no"))
    return each.select("doc_id", "n", "page_no", F.array_join(F.slice("lines", (F.col("page_no") - 1) * PAGE + 1, F.lit(PAGE)), "\n").alias("body"))


def running_lines(spark: SparkSession, d: str) -> DataFrame:
    """Documents as pages under a running head, a heading that each page repeats, and a foot; odd documents' heads alternate."""
    odd = F.when(F.col("page_no") % 2 == 1, F.concat(F.col("page_no") + 20, F.lit(" Chapter Of Words"))).otherwise(F.concat(F.lit("Section About Them "), F.col("page_no") + 20))
    head = F.when(F.col("doc_id") % 2 == 1, odd).otherwise(F.concat(F.lit("Manual  of "), F.col("doc_id") % 7))
    text = F.concat(head, F.lit("\nName | Days\n"), "body", F.lit("\nPage "), "page_no", F.lit(" of "), "n")
    return P.without_running_lines(numbered_lines(spark, d).select("doc_id", "page_no", text.alias("text")))


#: What is put into a document by its id, and what must come out.
BROKEN = [
    ("Zpurchase. Zpur-\nchase here", "Zpurchase. Zpurchase here"), ("Zwell-known. Zwell-\nknown", "Zwell-known. Zwell-known"), ("Znorth-\nWest", "Znorth-West"),
    ("Zcost zeffective. zcost-\nzeffective", "Zcost zeffective. zcost-zeffective"), ("zcom-\npliant", "zcompliant"), ("ZA zab. za-\nb-\nc", "ZA zab. zab-\nc"), ("none 3-\nz", "none 3-\nz"),
]


def rejoined_words(spark: SparkSession, d: str) -> DataFrame:
    """Documents' own pages, hyphens at line ends taken out, each with a broken word at its end."""
    put = F.get(F.array(*[F.lit(a) for a, _ in BROKEN]), (F.col("doc_id") % len(BROKEN)).cast("int"))
    rows = numbered_lines(spark, d).withColumn("text", F.when(F.col("page_no") == F.col("n"), F.concat("body", F.lit(" "), put)).otherwise(F.col("body")))
    return P.rejoined(rows.select("doc_id", "page_no", "text"))


#: SQL that both engines read: a page's site (of 100 pages), its address there, its listing's last change, its entry by the site's kind.
SITE = "floor(page_id / 100)"
OWN = f"CASE WHEN page_id % 9 = 4 THEN url ELSE 'https://s' || CAST({SITE} AS INT) || '.example' || CASE WHEN page_id % 7 = 3 THEN '/same' ELSE '/p?a=' || page_id || '&b=<1>' END END"
ENTRY = """CASE CAST(floor(page_id / 100) AS INT) % 4
WHEN 2 THEN '<item><title>t</title><link>' || link || '</link><pubDate>Tue, 05 Mar 2024 0' || (page_id % 10) || ':00:00 GMT</pubDate></item>'
WHEN 3 THEN '<a:entry><a:link rel="self" href="/no"/><a:link href="' || link || '"/><a:updated>2024-03-05T0' || (page_id % 10) || ':00:00Z</a:updated></a:entry>'
ELSE '<url><loc>' || link || '</loc><!-- <url><loc>/no</loc></url> --><lastmod>2024-03-0' || (page_id % 9 + 1) || '</lastmod></url>' END"""


def sitemap_pages(spark: SparkSession, d: str) -> DataFrame:
    """Sites of a hundred pages each: a sitemap, an index of two behind robots.txt, an RSS feed or an Atom feed; some links are relative."""
    pages = read(spark, d, "pages").select("page_id", F.expr(OWN).alias("own"), F.expr(f"CAST({SITE} AS INT)").alias("k"))
    escaped = F.regexp_replace(F.regexp_replace("own", "&", "&amp;"), "<", "&lt;")
    link = F.when(F.col("page_id") % 5 == 1, F.regexp_replace(escaped, r"^https://s\d+\.example", "")).otherwise(escaped)
    part = F.when(F.col("k") % 4 == 1, F.floor(F.col("page_id") % 100 / 50)).otherwise(0)
    texts = pages.withColumn("link", link).select("k", part.alias("part"), "page_id", F.expr(ENTRY).alias("entry")).groupBy("k", "part")
    bodies = texts.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page_id", "entry"))), lambda x: x["entry"]), "\n").alias("body"))  # a hundred at most
    root = F.concat(F.lit("https://s"), "k", F.lit(".example"))
    wrap = F.when(F.col("k") % 4 == 2, F.concat(F.lit("<rss><channel><link>/no</link>"), "body", F.lit("</channel></rss>"))).when(F.col("k") % 4 == 3, F.concat(F.lit('<a:feed xmlns:a="x">'), "body", F.lit("</a:feed>"))).otherwise(F.concat(F.lit('<?xml version="1.0"?><urlset xmlns="x">'), "body", F.lit("</urlset>")))
    files = bodies.select(F.concat(root, F.when(F.col("k") % 4 == 1, F.concat(F.lit("/map"), F.col("part"), F.lit(".xml"))).otherwise("/listing.xml")).alias("url"), wrap.alias("text"))
    ks = pages.select("k").distinct()
    index = ks.filter("k % 4 = 1").select(F.concat(root, F.lit("/index.xml")).alias("url"), F.concat(F.lit("<sitemapindex><sitemap><loc>map0.xml</loc></sitemap><sitemap><loc>"), root, F.lit("/map1.xml</loc></sitemap></sitemapindex>")).alias("text"))
    robots = ks.filter("k % 4 = 1").select(F.concat(root, F.lit("/robots.txt")).alias("url"), F.concat(F.lit("User-agent: *\nSitemap: /map0.xml\nsitemap:"), root, F.lit("/map1.xml\nSitemap: https://else.example/x.xml")).alias("text"))
    starts = ks.select(F.concat(root, F.when(F.col("k") % 4 == 1, F.when(F.col("k") % 8 == 1, "/").otherwise("/index.xml")).otherwise("/listing.xml")).alias("site"))
    found = sites.site_pages(starts, files.unionByName(index).unionByName(robots))
    return found.select("site", "rank", "url", F.unix_seconds("modified").alias("modified"))


def sniffed_rows(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers in files of twenty, each with its own delimiter; quoted cells hold all of them, one row has a cell too many."""
    s = read(spark, d, "supplier").withColumn("k", F.floor(F.col("s_suppkey") / 20).cast("int"))
    mark = F.get(F.array(*[F.lit(x) for x in files.DELIMITERS]), F.col("k") % 4)
    cells = F.array(F.col("s_suppkey").cast("string"), F.concat(F.lit('"'), "s_name", F.lit(', ""a"";|b"')), F.when(F.col("s_suppkey") % 3 > 0, F.col("s_nationkey").cast("string")).otherwise(""), F.when(F.col("s_suppkey") % 20 == 7, "over"))
    rows = s.select("k", mark.alias("mark"), "s_suppkey", F.array_compact(cells).alias("cells")).select("k", "mark", "s_suppkey", F.expr("array_join(cells, mark)").alias("line")).groupBy("k", "mark")
    body = rows.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("s_suppkey", "line"))), lambda x: x["line"]), "\n\n").alias("body"))  # twenty at most
    texts = body.select(F.concat(F.lit("file"), "k").alias("name"), F.concat(F.lit("id"), "mark", F.lit("name"), "mark", F.lit("nation\n"), "body").alias("text"))
    return files.delimited(texts, delimiter=None).select("name", "section", "text")


_WALK = """
root AS (SELECT event_id AS doc_id, TRY_CAST(text AS JSON) AS j FROM (SELECT event_id, {JSON} AS text FROM events)),
top AS (SELECT doc_id, CASE json_type(j) WHEN 'OBJECT' THEN e.key WHEN 'ARRAY' THEN 'Item ' || (e.key::INT + 1) ELSE 'Value' END AS section, CASE WHEN json_type(j) IN ('OBJECT', 'ARRAY') THEN e.value ELSE j END AS v, [coalesce(e.id, 0)::BIGINT] AS ord
  FROM root LEFT JOIN LATERAL (SELECT * FROM json_each(CASE WHEN json_type(j) IN ('OBJECT', 'ARRAY') THEN j ELSE '[0]' END)) e ON true WHERE j IS NOT NULL),
walk AS (SELECT doc_id, section, section AS path, v, ord, json_type(v) AS t FROM top
  UNION ALL SELECT w.doc_id, w.section, w.path || CASE w.t WHEN 'OBJECT' THEN ' › ' || e.key ELSE ' [' || (e.key::INT + 1) || ']' END, e.value, list_append(w.ord, e.id::BIGINT), json_type(e.value)
  FROM walk w, LATERAL (SELECT * FROM json_each(w.v)) e WHERE w.t = 'OBJECT' OR w.t = 'ARRAY' AND len(list_filter(w.v::JSON[], lambda x: json_type(x) IN ('OBJECT', 'ARRAY'))) > 0),
leaf AS (SELECT *, CASE t WHEN 'ARRAY' THEN array_to_string(list_transform(v::JSON[], lambda x: CASE WHEN x IS NULL OR json_type(x) = 'NULL' THEN 'null' ELSE x->>'$' END), ', ') WHEN 'NULL' THEN 'null' ELSE v->>'$' END AS told FROM walk
  WHERE t NOT IN ('OBJECT', 'ARRAY') OR t = 'ARRAY' AND json_array_length(v) > 0 AND len(list_filter(v::JSON[], lambda x: json_type(x) IN ('OBJECT', 'ARRAY'))) = 0)"""
_LINES = f"""
lines AS (SELECT doc_id, list_transform(list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> ''), lambda x, i: x || ' (line ' || i || ')') AS l FROM documents),
page AS (SELECT doc_id, ceil(len(l) / {PAGE})::INT AS n, p::INT AS page_no, array_to_string(l[(p - 1) * {PAGE} + 1:p * {PAGE}], chr(10)) AS body FROM lines, unnest(range(1, ceil(len(l) / {PAGE})::INT + 1)) AS u(p))"""
_Q = lambda s: s.replace("'", "''").replace("\n", "' || chr(10) || '")

QUERIES = {f.__name__: f for f in (json_paths, xml_text, notebook_cells, running_lines, rejoined_words, sitemap_pages, sniffed_rows)}
ORACLE = {
    "json_paths": f"WITH RECURSIVE {_WALK.replace('{JSON}', JSON)} SELECT doc_id, section, row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1 AS line_no, trim(regexp_replace(path || ': ' || told, '\\s+', ' ', 'g')) AS line FROM leaf",
    "xml_text": r"""WITH t AS (SELECT doc_id, [doc_id::VARCHAR] || list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))) || [left(source, 3) || ' < &amp;', '日'] AS l FROM documents WHERE text IS NOT NULL AND doc_id % 11 <> 3),
k AS (SELECT doc_id, list_filter(l, lambda x: x <> '') AS l FROM t) SELECT doc_id, (i - 1)::BIGINT AS line_no, l[i] AS line FROM k, unnest(range(1, len(l) + 1)) AS u(i)""",
    "notebook_cells": r"""WITH b AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN regexp_replace(text, '^\s+|\s+$', '', 'g') WHEN turn % 5 <> 0 THEN
  repeat('`', greatest(3, longest + 1)) || CASE WHEN conv_id % 2 = 0 THEN 'python3' ELSE 'R' END || chr(10) || regexp_replace(text || chr(10) || repeat('`', turn::INT), '\s+$', '') || chr(10) || repeat('`', greatest(3, longest + 1)) END AS t
FROM (SELECT *, list_max(list_transform(regexp_extract_all(text || chr(10) || repeat('`', turn::INT), '`+'), lambda x: length(x))) AS longest FROM conversations) WHERE regexp_matches(text, '\S'))
SELECT conv_id AS doc_id, string_agg(t, chr(10) || chr(10) ORDER BY turn) AS text FROM b WHERE t IS NOT NULL GROUP BY 1""",
    "running_lines": f"""WITH {_LINES}
SELECT doc_id, page_no, CASE WHEN n < 3 THEN CASE WHEN doc_id % 2 = 0 THEN 'Manual  of ' || doc_id % 7 WHEN page_no % 2 = 1 THEN (page_no + 20) || ' Chapter Of Words' ELSE 'Section About Them ' || (page_no + 20) END || chr(10) || 'Name | Days' || chr(10) || body || chr(10) || 'Page ' || page_no || ' of ' || n
  ELSE CASE WHEN n = 3 AND page_no = 2 AND doc_id % 2 = 1 THEN 'Section About Them' || chr(10) ELSE '' END || CASE WHEN page_no = 1 THEN 'Name | Days' || chr(10) ELSE '' END || body END AS text FROM page""",
    "rejoined_words": f"""WITH {_LINES}
SELECT doc_id, page_no, CASE WHEN page_no = n THEN body || ' ' || ([{", ".join(f"'{_Q(b)}'" for _, b in BROKEN)}])[doc_id % {len(BROKEN)} + 1] ELSE body END AS text FROM page""",
    "sitemap_pages": f"""WITH p AS (SELECT page_id, CAST({SITE} AS INT) AS k, {OWN} AS url FROM pages),
t AS (SELECT *, epoch(CASE WHEN k % 4 >= 2 THEN TIMESTAMP '2024-03-05' + to_hours((page_id % 10)::INT) ELSE TIMESTAMP '2024-03-01 23:59:59' + to_days((page_id % 9)::INT) END)::BIGINT AS changed FROM p WHERE starts_with(url, 'https://s' || k || '.example')),
u AS (SELECT k, url, min(page_id) AS first, arg_max(changed, page_id) AS modified FROM t GROUP BY ALL)
SELECT 'https://s' || k || '.example' || CASE WHEN k % 8 = 1 THEN '/' WHEN k % 4 = 1 THEN '/index.xml' ELSE '/listing.xml' END AS site, row_number() OVER (PARTITION BY k ORDER BY first) AS rank, url, modified FROM u""",
    "sniffed_rows": """WITH r AS (SELECT floor(s_suppkey / 20)::INT AS k, s_suppkey, row_number() OVER (PARTITION BY floor(s_suppkey / 20) ORDER BY s_suppkey) AS i,
  'id: ' || s_suppkey || '; name: ' || s_name || ', "a";|b' || CASE WHEN s_suppkey % 3 > 0 THEN '; nation: ' || s_nationkey ELSE '' END || CASE WHEN s_suppkey % 20 = 7 THEN '; col4: over' ELSE '' END AS line FROM supplier)
SELECT 'file' || k AS name, 'Rows ' || min(i * 2) || '-' || max(i * 2) AS section, string_agg(line, chr(10) ORDER BY i) AS text FROM r GROUP BY k""",
}
