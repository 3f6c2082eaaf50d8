from datetime import datetime, timezone

from fathomline.operators import sites as S

FILES = {
    "https://a.org/map.xml": '<?xml version="1.0"?><!-- <url> --><urlset xmlns="x"><url><loc> https://a.org/1?x=1&amp;y=2 </loc><lastmod>2024-03-05</lastmod></url><url><loc>/2</loc></url><url><loc><![CDATA[sub/3]]></loc></url><url><loc>https://b.org/4</loc></url><url><loc>/2</loc><lastmod>2024-01-01T10:00:00+02:00</lastmod></url><url><loc>ftp://a.org/5</loc></url><url/><url></url></urlset>',
    "https://a.org/robots.txt": "User-agent: *\nDisallow: /x\nSitemap: /map.xml\r\nSITEMAP : https://b.org/m.xml\nSitemap: /map.xml\n",
    "https://b.org/index.xml": "<sitemapindex><sitemap><loc>m.xml</loc></sitemap><sitemap><loc>https://a.org/map.xml</loc></sitemap><sitemap><loc>/gone.xml</loc></sitemap></sitemapindex>",
    "https://b.org/m.xml": '<x:feed xmlns:x="y"><x:entry><x:link rel="self" href="/no"/><x:link title="a > b" href=\'/e1\'/><x:updated>2024-03-05T06:07:08Z</x:updated></x:entry><x:entry><x:link rel="alternate" href="/e2&amp;"/></x:entry><x:entry/></x:feed>',
    "https://c.org/rss": "<rss><channel><link>/no</link><item><link>/r1</link><link>/r2</link><pubDate>Tue, 05 Mar 2024 06:07:08 +0100</pubDate></item><item><title>x</title></item></channel></rss>",
    "https://d.org/": "<html><body>No listing</body></html>",
    "https://d.org/robots.txt": "sitemap: /index.xml",
    "https://d.org/index.xml": '<!DOCTYPE urlset><urlset><url><loc>/no</loc></url></urlset>',
    "https://e.org/x": None,
}


def made(spark, sites, **more):
    files = spark.createDataFrame(list(FILES.items()), "url string, text string")
    found = S.site_pages(spark.createDataFrame([(s,) for s in sites], "site string"), files, **more).orderBy("site", "rank").collect()
    out = {}
    for r in found:
        assert r.rank == len(out.setdefault(r.site, [])) + 1
        out[r.site].append((r.url, r.modified))
    return out


def test_listings(spark):
    got = {k: [u for u, _ in v] for k, v in made(spark, ["https://a.org/map.xml", "https://a.org", "https://b.org/index.xml", "https://c.org/rss", "https://d.org/", "https://e.org/x", "https://none.org/"]).items()}
    a = ["https://a.org/1?x=1&y=2", "https://a.org/2", "https://a.org/sub/3"]
    assert got == {"https://a.org/map.xml": a, "https://a.org": a, "https://b.org/index.xml": ["https://b.org/e1", "https://b.org/e2&"], "https://c.org/rss": ["https://c.org/r1", "https://c.org/r2"]}


def test_other_hosts_and_limit(spark):
    got = made(spark, ["https://b.org/index.xml"], same_host=False)["https://b.org/index.xml"]
    assert [u for u, _ in got] == ["https://b.org/e1", "https://b.org/e2&", "https://a.org/1?x=1&y=2", "https://a.org/2", "https://a.org/sub/3", "https://b.org/4"]
    assert [u for u, _ in made(spark, ["https://b.org/index.xml"], same_host=False, most=2)["https://b.org/index.xml"]] == ["https://b.org/e1", "https://b.org/e2&"]


def test_dates(spark):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    texts = ["2024-03-05", "2024-03-05T06:07:08Z", "2024-03-05T06:07:08+02:00", "Tue, 05 Mar 2024 06:07:08 GMT", "5 Mar 2024 06:07:08 -0100", "2024-03-05T06:07:08", "soon", "", None]
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", F.unix_seconds(S.moment(F.col("t"))).alias("s")).orderBy("k").collect()
    at = lambda *x: int(datetime(2024, 3, 5, *x, tzinfo=timezone.utc).timestamp())
    assert [r.s for r in rows] == [at(23, 59, 59), at(6, 7, 8), at(4, 7, 8), at(6, 7, 8), at(7, 7, 8), at(6, 7, 8), None, None, None]
