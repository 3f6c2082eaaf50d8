import math
import random
import re
from collections import Counter

import duckdb
import numpy as np

from fathomline.llm import fp_tree as S
from tests.llm.helpers import ODD, docs, prose

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
words = lambda t: re.findall(S.TERM, (t or "").translate(FOLD))


def plain(documents, items):
    """Every score, document by document."""
    bags = [(i, Counter(words(t))) for i, t in documents]
    sizes = [sum(b.values()) for _, b in bags]
    n, total = sum(x > 0 for x in sizes), sum(sizes)
    df = Counter(t for _, b in bags for t in b)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(words(t))
    out = []
    for i, ts in asked.items():
        found = []
        for (doc, bag), size in zip(bags, sizes, strict=True):
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * bag[t]) // (1000 * bag[t] + 8 * (100 - 90 + (90 * size * n) // total))) for t in ts & bag.keys())
            if score > 0:
                found.append((-score, doc is None, doc or 0))
        out += [(i, k + 1, None if none else doc, -score) for k, (score, none, doc) in enumerate(sorted(found)[:10])]
    return sorted(out, key=str)


def benchmark(spark, rows):
    return spark.createDataFrame([(*r, 0.5, "d") for r in rows], "item_id long, text string, score double, doc_id string")


def got(df):
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def test_same_as_every_score(spark, monkeypatch):
    rng = random.Random(3)
    rows = ODD + [(1000 - k, prose(rng.randint(0, 9), rng.randint(1, 90)), "en", "a") for k in range(150)] + [(2000 + k, "Copy of ONE fox ümlaut", "en", "a") for k in range(60)] + [(2000, "Copy of ONE fox ümlaut", "en", "a")] * 3
    items = [(1, "fox of one"), (2, prose(3, 40)), (3, None), (4, "  "), (5, "nowhere"), (1, "ÜMLAUT ümlaut x"), (None, "text 日本語"), (6, "a" * 500), (7, "the the fox0 dog12 owls")]
    want = plain([(r[0], r[1]) for r in rows], items)
    assert {r[0] for r in want} == {1, 2, 6, 7, None} and want
    assert got(S.ranked(docs(spark, rows), benchmark(spark, items))) == want
    monkeypatch.setattr(S, "TREE", 16), monkeypatch.setattr(S, "ROWS", 50), monkeypatch.setattr(S, "BLOCK", 2)
    assert got(S.ranked(docs(spark, rows), benchmark(spark, items))) == want


def test_empty_tables(spark):
    assert S.ranked(docs(spark, []), benchmark(spark, [(1, "fox")])).count() == 0
    assert S.ranked(docs(spark, ODD), benchmark(spark, [])).count() == 0
    assert S.ranked(docs(spark, [(1, None, "en", "a")]), benchmark(spark, [(1, "fox")])).count() == 0


def made(rng, n):
    """Documents around 60 topics, as paths over 400 terms."""
    paths, counts = [], []
    for k in range(n):
        topic = rng.choice(400, 12, replace=False) if k % 40 == 0 else topic  # noqa: F821
        path = np.unique(np.concatenate([rng.choice(40, 8), topic[rng.random(12) < 0.8]]))
        paths.append(path), counts.append(rng.integers(1, 5, len(path)))
    return paths, counts


def test_bounds_hold_and_spare_work():
    rng = np.random.default_rng(5)
    paths, counts = made(rng, 2400)
    weight, m = rng.integers(1, 9000, 400), rng.integers(20, 300, 2400)
    ids = rng.permutation(2400)
    tree = S.Tree(ids, np.ones(2400, bool), m, paths, counts, 400)
    sets = [np.unique(np.concatenate([rng.choice(40, 3), rng.choice(400, 6)])) for _ in range(30)]
    items = S.Items(sets, weight)
    exact = np.zeros((2400, 30), np.int64)
    for k in range(2400):
        for j, s in enumerate(sets):
            both, a, _ = np.intersect1d(paths[k], s, return_indices=True)
            exact[ids[k], j] = S.part(weight[both], counts[k][a], m[k]).sum()
    for node in range(len(tree.first)):
        run = tree.doc[tree.first[node] : tree.last[node]]
        assert (tree.bound(node, items, np.arange(30)) >= exact[run].max(axis=0)).all()
        if tree.children[node]:
            assert sorted((tree.first[c], tree.last[c]) for c in tree.children[node])[0][0] == tree.first[node]
            assert sum(tree.last[c] - tree.first[c] for c in tree.children[node]) == tree.last[node] - tree.first[node]
        else:
            assert len(run) <= S.BUCKET
    tree.search(items)
    for j in range(30):
        order = sorted(range(2400), key=lambda d, j=j: (-exact[d, j], d))[:10]
        assert [(d, exact[d, j]) for d in order if exact[d, j]] == [(d, s) for d, s in zip(items.doc[j].tolist(), items.score[j].tolist(), strict=True) if s]
    assert items.scored < 0.75 * 2400 * 30  # the bounds spare a good part of all scores


def test_equal_documents_are_visited_once():
    n = 4000
    tree = S.Tree(np.arange(n)[::-1].copy(), np.ones(n, bool), np.full(n, 50), [np.array([0, 3])] * n, [np.array([1, 2])] * n, 5)
    items = S.Items([np.array([0, 3])], np.full(5, 100))
    tree.search(items)
    assert items.doc[0].tolist() == list(range(10)) and items.scored <= 2 * S.BUCKET


def test_same_as_duckdb(spark, sf):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = S.ranked(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet"))
    assert got(df) == sorted(con.sql(S.ORACLE).fetchall(), key=str)
