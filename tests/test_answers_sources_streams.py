import pandas as pd
from pyspark.sql import functions as F

from fathomline.functions import questions as Q
from fathomline.operators import answers as A
from fathomline.operators import maintenance as M
from fathomline.operators import telemetry as L
from fathomline.sources import files, stores
from fathomline.streaming import events as S


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


def test_facts(spark):
    a = lambda t: F.lit(t)
    r = one(spark, f=A.states_fact(a("Costs 30 days"), ["cost"], [["30", "40"]], ["3"]), g=A.states_fact(a("Costs 3 days"), ["cost"], [], ["3"]))
    assert tuple(r) == (True, False)


def test_continuation_keeps_a_repeated_tail_once(spark):
    r = one(spark, a=A.joined_continuation(F.lit("It ends on the fifth day"), F.lit("on the fifth day of May.")), b=A.joined_continuation(F.lit("Short"), F.lit("tail")), c=A.joined_continuation(F.lit("End"), F.lit(". New")))
    assert tuple(r) == ("It ends on the fifth day of May.", "Short tail", "End. New")


def test_condense_and_history(spark):
    r = one(spark, a=Q.needs_condense(F.lit("What about it?")), b=Q.needs_condense(F.lit("How many vacation days do engineers receive yearly")))
    assert tuple(r) == (True, False)
    t = spark.createDataFrame([(1, 0, "assistant", "hi"), (1, 1, "user", "q"), (1, 2, "assistant", "x" * 50)], "conv_id long, turn long, role string, text string")
    assert [(x.turn, len(x.text)) for x in A.history_tail(t, 5, 10).orderBy("turn").collect()] == [(1, 1), (2, 10)]


def test_folds(spark):
    e = spark.createDataFrame([(k, 1, t * 1_000_000) for k, t in enumerate([0, 1, 2, 70, 71, 200])] + [(10, 2, 0)], "event_id long, user_id long, us long")
    got = {r.event_id: r for r in L.token_bucket(e, "user_id", "us", 2).collect()}
    assert [got[k].wait > 0 for k in range(6)] == [False, False, True, False, False, False] and abs(got[2].wait - 28.0) < 0.1
    assert [r.told for r in L.throttled(e, "user_id", "us", 60).filter("user_id = 1").orderBy("event_id").collect()] == [1, 0, 0, 3, 0, 2]
    assert [r.hit for r in L.cache_hits(e, "user_id", "us", 70).filter("user_id = 1").orderBy("event_id").collect()] == [False, True, True, True, False, False]


def test_shares_and_parts(spark):
    n = spark.createDataFrame([(1, 1, 1), (1, 2, 9), (1, 3, 9)], "q long, d long, need long")
    assert sorted((r.d, r.share) for r in L.batch_shares(n, "q", "d", "need", 8).collect()) == [(1, 1), (2, 3), (3, 4)]
    p = spark.createDataFrame([(1, k, s) for k, s in enumerate([40, 40, 40, 500, 10])], "d long, o long, size long")
    assert [r.part for r in L.packed_parts(p, "d", "o", "size", 100).orderBy("o").collect()] == [1, 1, 2, 3, 4]


def test_refresh_due(spark):
    df = spark.createDataFrame([(1, 100.0, 60.0, 0), (2, 100.0, 60.0, 40), (3, 100.0, None, 0), (4, 100.0, 0.0, 1), (5, 0.0, 200_000.0, 3)], "k int, last double, i double, f int")
    assert [r[0] for r in df.orderBy("k").select(L.refresh_due(F.col("last"), F.col("i"), F.col("f"))).collect()] == [160.0, 86500.0, None, None, 200_000.0]


def texts(spark, *rows):
    return spark.createDataFrame(rows, "name string, text string")


def test_markdown_ignores_headings_in_fences(spark):
    got = files.markdown(texts(spark, ("m", "intro\n# One\na\n```\n# no\n```\n## Two ##\nb"), ("e", ""), ("n", None))).orderBy("ordinal").collect()
    assert [(r.section, r.text) for r in got] == [("", "intro"), ("One", "# One\na\n```\n# no\n```"), ("Two", "## Two ##\nb")]


def test_delimited_counts_blank_rows(spark):
    got = files.delimited(texts(spark, ("c", '\nname,note\nA,"x, ""y"""\n\nB,\n')), 50).collect()
    assert [(r.section, r.text) for r in got] == [("Rows 2-4", 'name: A; note: x, "y"\nname: B')]


def test_subtitles_json_mail_and_feeds(spark):
    srt = "1\n00:00:05,000 --> 00:00:07,000\nHello\nthere\n\n2\n00:01:10,000 --> 00:01:12,000\nBye"
    assert [(r.page, r.text) for r in files.subtitles(texts(spark, ("s", srt))).orderBy("page").collect()] == [(1, "Hello there"), (2, "Bye")]
    assert [r.text for r in files.json_lines(texts(spark, ("j", '{"b": 1, "a": "x"}\nnot json\n'))).collect()] == ["a: x\nb: 1"]
    assert [(r.section, r.text) for r in files.mail(texts(spark, ("m", "From: a\r\nSubject: Hi\r\nX: y\r\n\r\nBody\r\n\r\nmore"))).orderBy("ordinal").collect()] == [("Header", "From: a\nSubject: Hi"), ("Hi", "Body\n\nmore")]
    xml = "<urlset><url><loc> http://a/1 </loc><lastmod>2024-05-06</lastmod></url><item><link>http://a/2</link><pubDate>Mon, 06 May 2024 10:00:00 GMT</pubDate></item></urlset>"
    got = {r.url: str(r.m) for r in files.listed_pages(texts(spark, ("x", xml))).select("url", F.date_format("modified", "yyyy-MM-dd HH:mm:ss").alias("m")).collect()}
    assert got == {"http://a/1": "2024-05-06 23:59:59", "http://a/2": "2024-05-06 10:00:00"}


def test_folder_and_charsets(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, raw in (("a.txt", b"\xef\xbb\xbfbom"), ("sub/a.txt", b"second"), ("b.txt", "é".encode("latin-1")), ("c.txt", "hé".encode("utf-16")), ("d.txt", b"\x00\x01\x02\x03"), ("skip.bin", b"x")):
        (tmp_path / name).write_bytes(raw)
    found = files.folder(spark, str(tmp_path), "*.txt")
    got = {r.name: r.text for r in files.decoded(found).collect()}
    assert got == {"a.txt": "bom", "b.txt": "é", "c.txt": "hé", "d.txt": None}
    assert [(r.name, r.status) for r in files.unreadable(files.decoded(found)).collect()] == [("d.txt", "binary")]


def test_stores(spark, tmp_path):
    q = tmp_path / "q.jsonl"
    q.write_text('{"question": "a"}\n{"question": " "}\n{"question": "b", "expect_no_context": true, "relevant_filenames": ["x"]}\n{"question": "c", "task": "sing"}\n')
    good, bad = stores.read_questions(spark, str(q))
    assert [r.question for r in good.collect()] == ["a"] and bad.count() == 3
    chunks = spark.createDataFrame([("f", 1, "a"), ("f", 2, "b"), ("g", 1, "c")], "filename string, ordinal long, text string")
    stores.write_passages(chunks, str(tmp_path / "p"))
    part = spark.read.parquet(str(tmp_path / "p")).filter("filename = 'f'").select("part").distinct().collect()[0][0]
    others = spark.read.parquet(str(tmp_path / "p")).filter(f"part = {part} and filename <> 'f'").select("filename", "ordinal", "text")
    stores.write_passages(spark.createDataFrame([("f", 1, "new")], chunks.schema).unionByName(others), str(tmp_path / "p"))
    assert sorted((r.filename, r.text) for r in spark.read.parquet(str(tmp_path / "p")).collect()) == [("f", "new"), ("g", "c")]
    stores.write_log(chunks, str(tmp_path / "log"), "filename", "ordinal")
    assert spark.read.json(str(tmp_path / "log")).count() == 3


def test_maintenance(spark):
    cat = spark.createDataFrame([("a", "1", False, False), ("b", "2", True, False), ("c", "3", False, True)], "name string, sha string, incomplete boolean, stale boolean")
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("a", "9")], "name string, sha string")
    assert [tuple(r) for r in M.unchanged(new, cat).select("name", "sha").collect()] == [("a", "1")]
    fresh = spark.createDataFrame([("p", "f"), ("q", "f")], "point_id string, fingerprint string")
    stored = spark.createDataFrame([("p", "f", [1.0, 2.0]), ("q", "old", [1.0, 2.0])], "point_id string, fingerprint string, vector array<double>")
    assert {r.point_id: r.vector for r in M.reusable_vectors(fresh, stored, 2).collect()} == {"p": [1.0, 2.0], "q": None}
    gone = M.removed_files(cat.select("name"), spark.createDataFrame([], "name string"), F.lit(True))
    assert gone.count() == 0
    rules = [("low", "warn", F.col("x") < 3), ("high", "error", F.col("x") > 9)]
    assert [tuple(r) for r in M.findings(spark.createDataFrame([(1,)], "x int"), rules).collect()] == [("low", "warn")]


def drained(spark, df, name, mode="append"):
    df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


def event_folder(spark, sf, tmp_path):
    e = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).orderBy("ts").toPandas()
    for k in range(3):
        part = e.iloc[k * len(e) // 3 : (k + 1) * len(e) // 3]
        spark.createDataFrame(part, S.EVENT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return e, S.event_files(spark, str(tmp_path / "in"), 1)


def test_streamed_windows_equal_batches(spark, sf, tmp_path):
    e, stream = event_folder(spark, sf, tmp_path)
    got = {(r.start, r.event_type): r.events for r in drained(spark, S.tumbling(stream), "tumbling_t").collect()}
    want = e.groupby([e.ts.dt.floor("h"), "event_type"]).size()
    closed = e.ts.max() - pd.Timedelta("10min")
    want = {(k[0].to_pydatetime(), k[1]): n for k, n in want.items() if k[0] + pd.Timedelta("1h") <= closed}
    assert {(a.replace(tzinfo=None), b): n for (a, b), n in got.items()} == {(a.replace(tzinfo=None), b): n for (a, b), n in want.items()}
    states = {r.user_id: r.state for r in drained(spark, S.newest_state(stream), "states_t", "complete").collect()}
    assert states == e.sort_values("event_id").groupby("user_id").event_type.last().to_dict()


def test_streamed_quota_sessions_and_sinks(spark, sf, tmp_path):
    e, stream = event_folder(spark, sf, tmp_path)
    got = {r.event_id: r.wait for r in drained(spark, S.token_bucket(stream, 1), "bucket_t").collect()}
    batch = spark.createDataFrame(e, S.EVENT).select("event_id", "user_id", L.seconds().alias("us"))
    want = {r.event_id: r.wait for r in L.token_bucket(batch, "user_id", "us", 1).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-3 for k in want)
    assert drained(spark, S.sessions(stream), "sessions_t").count() > 0
    assert drained(spark, S.first_seen(stream, ["user_id", "event_type"], "1 hour"), "first_t").count() <= len(e)
    q = S.fan_out(stream, {k: str(tmp_path / k) for k in ("error", "click")}, str(tmp_path / "cp"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "error")).count() == int((e.event_type == "error").sum())


def test_small_sections_gather(spark):
    from fathomline.operators import curation as U

    s = spark.createDataFrame([(1, k, w) for k, w in enumerate([10, 35, 5, 50, 3])] + [(2, 0, 1)], "d long, o long, words long")
    assert sorted((r.d, r.o, r.section) for r in U.merged_sections(s, "d", "o", "words", 40).collect()) == [(1, 0, 1), (1, 1, 1), (1, 2, 2), (1, 3, 2), (1, 4, 3), (2, 0, 1)]


def test_globs_tags_and_echoes(spark):
    from fathomline.operators import curation as U

    names = spark.createDataFrame([("a/b.md",), ("a/c/d.md",), ("e.txt",)], "name string")
    assert sorted(r.name for r in U.matching(names, ["*.md"], []).collect()) == ["a/b.md", "a/c/d.md"]
    assert [r.name for r in U.matching(names, ["a/*"], []).collect()] == ["a/b.md"]
    assert [r.name for r in U.matching(names, [], ["**/c/**", "*.txt"]).collect()] == ["a/b.md"]
    r = one(spark, tags=U.normalized_tags(F.array(F.lit(" A  b "), F.lit("a B"), F.lit(""), F.lit("x" * 41), F.lit("c"))), echo=U.without_echo(F.lit("> [1] filename=x; page=1\nReal [1].")))
    assert r.tags == ["A b", "c"] and r.echo == "Real [1]."


def test_markers_that_open_a_sentence_belong_to_the_one_before(spark):
    a = spark.createDataFrame([(1, "First claim. [2] Second one [1, 3]. Third."), (2, "[4] Alone.")], "answer_id long, answer string")
    got = sorted((r.answer_id, r.sentence_no, r.source_number) for r in A.claims_by_source(a).collect())
    assert got == [(1, 0, 2), (1, 1, 1), (1, 1, 3), (2, 0, 4)]
    src = spark.createDataFrame([(1, 7, "the third claim mentions nothing"), (1, 8, "zebras")], "answer_id long, source_number long, text string")
    bare = spark.createDataFrame([(1, "The third claim mentions zoos. Cited [1].")], "answer_id long, answer string")
    assert [tuple(r) for r in A.backfilled(bare, src).collect()] == [(1, 0, 7)]


def test_names_overlaps_and_front_matter(spark):
    from fathomline.functions import text as T

    r = one(spark, a=T.without_overlap(F.lit("One two three. Four five six seven eight."), F.lit("Four five six seven eight. Nine.")), b=T.without_overlap(F.lit("abc"), F.lit("abc def")), c=T.front_matter_tags(F.lit("---\ntags: [a, 'b']\n---\nx")), d=T.front_matter_tags(F.lit("---\ntags: [a]\nx")), e=T.name_problem(F.lit("ok/fine.md"), [".md"]))
    assert r.a == "Nine." and r.b == "abc def" and r.c == ["a", "b"] and r.d == [] and r.e is None
