import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np

from fathomline.llm import prefix_trie as P

SCHEMA = "conv_id long, turn long, role string, text string, key string, words string, range string, id long"


def table(spark, rows):
    return spark.createDataFrame([(*r, "k", "w", "r", 1) for r in rows], SCHEMA)


def plain(rows):
    """The nodes by dictionaries of whole prefixes."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, hashlib.md5(f"{role}\0{text}".encode()).hexdigest(), role, text))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        donor = c - (abs(c) % 20 if c >= 0 else -(abs(c) % 20))
        built[c] = tuple(own.get(donor, [])[:h]) + tuple(v[h:])
    members = defaultdict(list)
    for c, s in built.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)

    def below(p):
        leaves, saved = 0, (len(members[p]) - 1) * (len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0)
        for k in kids[p]:
            a, b = below(k)
            leaves, saved = leaves + a, saved + b
        return leaves or 1, saved

    out = []
    for p, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if built[c] == p)))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), *below(p), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted(map(tuple, df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()), key=str)


def test_same_as_dictionaries(spark):
    rng = random.Random(4)
    rows = []
    for c in range(-45, 160):
        if c % 20 == 0 and c % 40:
            continue
        hot = c % 3 == 0
        for t in range(0 if c == 7 else rng.randint(1, 6)):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", "a common turn" if hot or rng.random() < 0.6 else f"own words {rng.randint(0, 2)}"))
    rows += [(None, 0, "user", "nobody's"), (500, None, None, None), (500, 1, "user", ""), (500, 1, "user", "tie"), (500, 1, "user", "tie"), (501, 0, "u", "long " * 20_000), (521, 0, "", ""), (41, 3, "user", "日本 😀\x0b語")]
    rows += rows[:5]
    for per_range in (9, 200, P.RANGE):
        assert got(P.nodes_of(table(spark, rows), per_range)) == plain(rows)


def test_turnless_and_equal_conversations_across_ranges(spark):
    # h of 1 is 3 (its donor 0 is absent), so its one turn goes and nothing comes
    rows = [(c, 0, "u", "same") for c in range(1, 80) if c % 20] + [(300 + c, t, "u", f"same {t}") for c in range(1, 19) for t in range(9)]
    assert got(P.nodes_of(table(spark, rows), 12)) == plain(rows)
    assert any(r[1] == 0 and r[-1] != hashlib.sha256(b"").hexdigest() for r in plain(rows))


def test_empty_table(spark):
    assert P.nodes_of(table(spark, [])).count() == 0


def test_extents_are_the_longest():
    rng = np.random.default_rng(1)
    lcp = rng.integers(0, 5, 70)
    table_ = P.least_of_runs(lcp)
    for i in range(70):
        for d in range(6):
            left, right = i, i
            while left >= 1 and lcp[left] >= d:
                left -= 1
            while right + 1 < 70 and lcp[right + 1] >= d:
                right += 1
            at, depth = np.array([i]), np.array([d])
            assert (P.left_extents(table_, at, depth)[0], P.right_extents(table_, at, depth)[0]) == (left, right)
            assert P.least_between(table_, np.array([left]), np.array([right]))[0] == lcp[left : right + 1].min()


def test_same_as_duckdb(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    df = P.nodes_of(spark.read.parquet(f"{sf}/conversations.parquet"), 40)
    assert got(df) == sorted(con.sql(P.ORACLE).fetchall(), key=str)
