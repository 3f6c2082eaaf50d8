import html
import os
import re
import time
from collections import Counter

import numpy as np
import pyarrow as pa

import corpus_pipeline
from fathomline.llm import common, near_copies, permutation_index, wrappers
from fathomline.llm.common import table
from tests.llm.helpers import ODD, docs, prose

VECTORS = "vec_id long, embedding array<float>, label int, id long, v string, shard int, block int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, "x", 2, 3) for i, v in rows], VECTORS)


def test_recall_on_a_table(spark, sf):
    v = table(spark, sf.replace("sf0.001", "sf0.1"), "embeddings")
    found = permutation_index.neighbours(v)
    assert permutation_index.recall(found, v) >= 0.9
    per = found.groupBy("query_id").count().collect()
    assert len(per) == v.filter("vec_id % 20 = 0").count() and all(r["count"] == 20 for r in per)


def test_exact_where_few(spark):
    """Ties, copies, unusable vectors, repeated ids, lengths of their own."""
    rng = np.random.default_rng(0)
    rows = [(k, [float(x) for x in rng.normal(size=6) * (1 + k % 5)]) for k in range(60)]
    rows += [(100 + k, rows[3][1]) for k in range(30)]
    rows += [(200, None), (220, [0.0] * 6), (240, [float("nan")] * 6), (260, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (280, [float("inf")] + [1.0] * 5), (300, [1.0]), (20, rows[5][1])]
    got: dict = {}
    for r in permutation_index.neighbours(vectors(spark, rows)).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    usable = [(i, np.array(v, dtype=np.float32).astype(float)) for i, v in rows if i not in (200, 220, 240, 260, 280, 300)]
    for q in {i for i, _ in usable if i % 20 == 0 and i != 20}:
        mine = next(v for i, v in usable if i == q)
        want = sorted(((-float((v * mine).sum()), i) for i, v in usable if i != q))[:20]
        assert [i for i, _ in got[q]] == [i for _, i in want]
        assert np.allclose([s for _, s in got[q]], [-s for s, _ in want])
    assert not {200, 220, 240, 260, 280, 300} & got.keys()
    assert permutation_index.neighbours(vectors(spark, [])).count() == 0
    few = permutation_index.neighbours(vectors(spark, [(0, [1.0, 0.0]), (1, [0.5, 0.5])])).collect()
    assert [(r.query_id, r.vec_id) for r in few] == [(0, 1)]


def brute_matching(a, b, x=0, y=0):
    """The size of the largest top-down matching under two nodes of (signs, parents)."""
    if a[0][x] != b[0][y]:
        return 0
    xs, ys = ([k for k, p in enumerate(t[1]) if p == n] for t, n in ((a, x), (b, y)))
    best = [[0] * (len(ys) + 1) for _ in range(len(xs) + 1)]
    for i, c in enumerate(xs):
        for j, d in enumerate(ys):
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + brute_matching(a, b, c, d))
    return 1 + best[-1][-1]


def test_alignment_is_a_largest_matching():
    a = ["root", "body", "nav", "div.a", "div.a", "footer"]
    b = ["root", "body", "div.x", "nav", "div.a", "footer"]
    got = wrappers.align(a, [-1, 0, 1, 1, 1, 1], b, [-1, 0, 1, 1, 1, 1])
    assert got[0] == 0 and got[1] == 1 and got[2] == 3 and got[5] == 5 and len(got) == 5
    wide = ["root"] + ["div"] * 200
    assert len(wrappers.align(wide, [-1] + [0] * 200, wide, [-1] + [0] * 200)) == 201
    assert wrappers.align([], [], wide, [-1] + [0] * 200) == {}
    rng = np.random.default_rng(3)

    def tree(n):
        parents = [-1] + [int(rng.integers(k)) for k in range(1, n)]
        return ["root"] + [str(rng.choice(["p", "div", "ul"])) for _ in range(n - 1)], parents

    for _ in range(150):
        x, y = tree(int(rng.integers(1, 16))), tree(int(rng.integers(1, 16)))
        got = wrappers.align(*x, *y)
        assert len(got) == brute_matching(x, y)
        assert all(x[0][k] == y[0][v] and (k == 0 or got[x[1][k]] == y[1][v]) for k, v in got.items())
        order = sorted(got, key=lambda k: (x[1][k], k))
        assert all(got[k] < got[q] for k, q in zip(order, order[1:]) if x[1][k] == x[1][q])


def test_hostile_pages_take_linear_time():
    for bad in ("<div>" * 30_000 + "x", "<b>" * 50_000 + "x<p>y", '<a "' * 50_000 + ">", "<p>x<b>" * 20_000, "<label>" * 20_000 + "</label></p>" * 20_000, "<noscript>" * 20_000, "<div><p></div>" * 20_000, "<" * 100_000, "<ul>" + "<li>x" * 20_000):
        begin = time.time()
        page = wrappers.read(bad)
        fit = wrappers.align(page.signs, page.parents, page.signs, page.parents)
        wrappers.main_text(page, fit)
        assert time.time() - begin < 20 and len(fit) == len(page.signs)


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", 1, "y") for i, u, h in rows], "page_id long, url string, html string, host string, key long, text string")


def test_templates_and_slots(spark):
    def plain(k):
        return f"<html><body><div><div><a href=/>Home</a> <a href=/b>About us</a></div><div>All rights of the house reserved here.</div></div><div><p>Story {k} begins &amp; goes on.<p>It has  a second\n part {k}.</div><form>Search</form><div class='comment-list'>I agree {k}</div></body></html>"

    def article(k):
        return f"<title>t</title><nav>menu {k}</nav><div class=ad>Buy {k}</div><article><h1>Head {k}</h1><p>One&nbsp;two<br>three <b>four</b>.<p>Five.<script>var x='<p>no</p>'</script></p><aside>side</aside></article><footer>(c) {k}</footer>"

    rows = [(k, f"http://a.example/{k}", plain(k)) for k in range(8)] + [(20 + k, f"https://B.example:80/{k}?q", article(k)) for k in range(5)]
    rows += [(50, None, article(9)), (51, "http://c/", None), (52, "http://c/", ""), (53, "nonsense", "<p>only <i>this</i>"), (53, "nonsense", "<p>only <i>this</i>"), (54, "http://d/", "no markup at all"), (None, "http://e/", "<!-- c --><p>a<p>b")]
    got = wrappers.articles(pages(spark, rows)).collect()
    text = {r.page_id: r.text for r in got}
    assert len(got) == len(rows) and Counter(r.page_id for r in got)[53] == 2
    for k in range(8):
        assert text[k] == f"Story {k} begins & goes on.\n\nIt has a second part {k}."
    for k in range(5):
        assert text[20 + k] == f"Head {k}\n\nOne two three four.\n\nFive."
    assert text[51] == text[52] == "" and text[53] == "only this" and text[54] == "no markup at all" and text[None] == "a\n\nb"
    assert all(r.n_chars == len(r.text) for r in got)
    assert wrappers.articles(pages(spark, [])).count() == 0


def test_an_article_keeps_its_own_header():
    page = wrappers.read("<div class=site-header>Site</div><article><header class=entry-header><div class='post-header'><h1>Title</h1></div></header><p class=notice>Note</p><p>Body</p><ul><li>One<li>Two</ul><section class=comments><p>Me too</section></article>")
    assert wrappers.main_text(page, set()) == "Title\n\nBody\n\nOne\n\nTwo"


def article_of(source):
    """The text of a test page's article element, read by patterns."""
    inner = re.search(r"<article>(.*)</article>", source, re.S)[1]
    want = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
    return "\n\n".join(x for x in want if x)


def test_real_pages_give_their_articles(spark, sf):
    rows = table(spark, sf, "pages").collect()
    got = {r.page_id: r.text for r in wrappers.articles(table(spark, sf, "pages")).collect()}
    assert all(got[r.page_id] == article_of(r.html) for r in rows)


def test_alignment_decides_where_tags_tell_nothing(spark, sf):
    """All semantic tags become div and classes go: the wrapper finds the articles, and without it no page is right."""
    rows = table(spark, sf.replace("sf0.001", "sf0.01"), "pages").collect()
    bare = [re.sub(r' (?:class|id|role)="[^"]*"', "", re.sub(r"(</?)(nav|header|footer|aside|article|main)\b", r"\1div", r.html)) for r in rows]
    got = {r.page_id: r.text for r in wrappers.articles(pages(spark, [(r.page_id, r.url, h) for r, h in zip(rows, bare, strict=True)])).collect()}
    sizes = Counter(r.url.split("/")[2] for r in rows)
    mine = [(got[r.page_id], wrappers.main_text(wrappers.read(h)), article_of(r.html)) for r, h in zip(rows, bare, strict=True) if sizes[r.url.split("/")[2]] >= 5]
    assert len(mine) > 100
    assert all(x == want for x, _, want in mine) and not any(y == want for _, y, want in mine)


def test_copies_of_one_article_keep_it(spark):
    body = "".join(f"<p>Part {k} of the one story.</p>" for k in range(5))
    rows = [(k, f"http://one.example/?utm={k}", f"<body><div>menu</div><article><h1>Story</h1>{body}</article></body>") for k in range(6)]
    rows += [(10 + k, f"http://two.example/?utm={k}", f"<body><div>{'Buy now. ' * k}</div><div><h1>Story</h1>{body}</div></body>") for k in range(1, 6)]
    rows += [(20 + k, f"http://three.example/{k}", f"<body><div><h1>Story {k}</h1><p>Begin {k * 7} here.<p>Subscribe to our letter.<p>And so on {k * 5}.</div></body>") for k in range(12)]
    text = {r.page_id: r.text for r in wrappers.articles(pages(spark, rows)).collect()}
    story = "\n\n".join(["Story", *(f"Part {k} of the one story." for k in range(5))])
    assert all(text[k] == story for k in range(6))
    assert all(text[10 + k].endswith(story) for k in range(1, 6))
    assert all(text[20 + k] == f"Story {k}\n\nBegin {k * 7} here.\n\nAnd so on {k * 5}." for k in range(12))


def test_near_copies_link_at_the_bound(spark, monkeypatch):
    """Five-word shingles, similarity 0.8: against brute force, with pairs on both sides and a crowd that shares them."""
    monkeypatch.setattr(near_copies, "SMALL", 3)  # groups of four take the ways of large ones
    rng = np.random.default_rng(4)
    rows, at = [], 0

    def put(words):
        nonlocal at
        at += 1
        rows.append((at, " ".join(words), "en", "a"))

    for base in range(30):
        own = [f"w{base}x{k}" for k in range(120)]
        put(own)
        for changed in (1, 2, 3, 4, 5):  # about 0.92, 0.84, 0.77, 0.71, 0.65
            words = list(own)
            for k in range(changed):
                words[12 + 20 * k] = f"new{at}y{k}"
            put(words)
    crowd = [f"c{k}" for k in range(60)]
    for _ in range(60):
        put([w if rng.random() > 0.04 else f"z{rng.integers(1000)}" for w in crowd])
    rows += [(900, "", "en", "a"), (901, None, "en", "a"), (902, "two words", "en", "a"), (903, "TWO  words", "en", "a"), (904, rows[0][1], "en", "a"), (904, rows[30][1], "en", "a"), (None, rows[0][1], "en", "a")]
    known = [(i, (t or "").lower().split()) for i, t, *_ in rows if i is not None]
    made = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for _, w in known]
    linked = np.array([[x == y or known[a][0] == known[b][0] or 5 * len(x & y) >= 4 * len(x | y) > 0 for b, y in enumerate(made)] for a, x in enumerate(made)])
    similar = [len(x & y) / len(x | y) for a, x in enumerate(made) for y in made[:a] if x | y]
    assert any(0.8 <= s < 0.86 for s in similar) and any(0.74 < s < 0.8 for s in similar)
    label = np.arange(len(known))
    while (new := np.array([label[row].min() for row in linked])).tolist() != label.tolist():
        label = new
    want = {i: known[k][0] for (i, _), k in zip(known, label, strict=True)}
    docs_ = docs(spark, rows)
    got = {r.doc_id: r.component_id for r in near_copies.classes(docs_).collect()}
    assert got == want
    kept = corpus_pipeline.near_duplicate_stage(spark, docs_, "")
    assert Counter(r.doc_id for r in kept.collect()) == Counter(i for i, *_ in rows if i is None or want[i] == i)


def test_sketches_tell_large_sets_apart_and_lose_none():
    """Sets of any size: half-shared ones are told apart, and no pair at the bound is."""
    rng = np.random.default_rng(5)
    for size in (1, 7, 100, 1500, 20000):
        x = rng.integers(-(2**62), 2**62, 2 * size)
        for less in (0, size // 9, size // 5):  # similarities 1, 0.8 and more, and 0.8 of sets of unlike size
            a, b = x[:size], x[less : size + less] if less < size // 5 else x[: size - less]
            sketches = [np.array([near_copies.sketch(y)], dtype=object) for y in (a, b)]
            assert 5 * len(np.intersect1d(a, b)) >= 4 * len(np.union1d(a, b))
            assert near_copies.room(*sketches, np.array([len(a) + len(b)])).all()
            assert near_copies.room(*sketches[::-1], np.array([len(a) + len(b)])).all()
        if size >= 1500:
            a, b = (np.array([near_copies.sketch(y)], dtype=object) for y in (x[:size], x[size // 2 : size + size // 2]))
            assert not near_copies.room(a, b, np.array([2 * size])).any()


def test_pairs_without_room_are_left_in_their_group(spark):
    """Texts that share a common opening and else nothing: their group gives no row to compare."""
    nodes, large = [], []
    rng = np.random.default_rng(6)
    for k in range(60):
        x = np.append(rng.integers(-(2**62), 2**62, 299), 5)
        nodes.append((k, bytearray(near_copies.sketch(x))))
        large.append((5, k, 300, 10))
    label = spark.createDataFrame([], "node long, component long")
    found = near_copies.apart(spark.createDataFrame(large, "key long, node long, size long, at long"), label, spark.createDataFrame(nodes, "node long, sketch binary"))
    assert found.count() == 0


def test_a_pair_is_told_in_the_first_group_it_shares(spark):
    sketch = bytearray(near_copies.sketch(np.arange(300) * 1009))
    large = [(key, node, 300, key - 5) for key in (5, 6, 7) for node in range(10)] + [(8, node, 300, 0) for node in (0, 1)]
    label = spark.createDataFrame([], "node long, component long")
    nodes = spark.createDataFrame([(node, sketch) for node in range(10)], "node long, sketch binary")
    found = near_copies.apart(spark.createDataFrame(large, "key long, node long, size long, at long"), label, nodes).collect()
    # groups 5 and 8 are both first ones of nodes 0 and 1
    assert len(found) <= 46 and {(r.a, r.b) for r in found} == {(a, b) for b in range(10) for a in range(b)}


def test_near_copies_leave_one_table_and_lean_workers(spark):
    """The stage's steps are deleted when it ends; workers give back what they free."""
    folder = common.shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    rows = [(k, prose(k // 2, 60), "en", "a") for k in range(20)]
    kept = corpus_pipeline.near_duplicate_stage(spark, docs(spark, rows), "")
    assert len(set(os.listdir(folder)) - before) == 1
    assert [r.doc_id for r in kept.orderBy("doc_id").collect()] == list(range(0, 20, 2))
    seen = spark.range(1).mapInArrow(lambda batches: ((lambda b: b)(pa.RecordBatch.from_arrays([pa.array([os.environ.get("MALLOC_MMAP_THRESHOLD_")])], names=["v"])) for _ in batches), "v string").first().v
    assert seen == common.LEAN["MALLOC_MMAP_THRESHOLD_"]


def test_pipeline_stages(spark, sf):
    d = table(spark, sf, "documents")
    n = d.count()
    docs_ = d
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs_ = stage(spark, docs_, sf).cache()
        assert docs_.columns == d.columns, name
        assert docs_.count() > 0.6 * n
    last = corpus_pipeline.STAGES[-1][1](spark, docs_, sf)
    assert last.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and last.count() == docs_.count()
    assert corpus_pipeline.run(spark, sf).count() == last.count()


def test_stages_take_odd_and_empty_tables(spark, sf):
    for rows in (ODD, []):
        d = docs(spark, rows)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, d, sf)
            assert out.count() <= 3 * len(rows), name
            if name != "bpe":
                assert out.columns == d.columns
