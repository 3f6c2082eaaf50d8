"""The prefix trie of conversations from a sorted table of their turn sequences.

Each conversation is a key: 16 bytes a turn (the digest of role and text), so keys in order are sequences in order. The
sorted table is cut into ranges; neighbouring rows give a longest common prefix (LCP) in turns. In a range, a sparse table
holds the least LCP of every run of 2^k rows. Each candidate prefix (a turn of a row) searches its left extent by halving
steps over that table; the row that is its own left end speaks for the node and searches the right extent alike. So each
node is a member interval, found on its own, without a stack; sums over intervals are differences of running sums.

An interval that reaches the edge of its range is open: its parts meet by the digest of the prefix, one part a range. The
last key before and the first after a range come along, so that every node is introduced once in all ranges and parts add
up. A range holds about RANGE turns whatever conversations or first turns are common: equal keys are cut apart by conv_id.

Turns of a conversation are ordered by turn (null first), ties by digest. Null roles and texts are empty. Rows without a
conv_id belong to no conversation. An empty table has no nodes. Further columns are not read. A conversation's turns must
fit in one row (20 bytes each).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathomline.llm.common import small_batches, written

#: Bytes of a turn in a key. Turns of a range.
TURN, RANGE = 16, 100_000
#: Conversations that borrow from one donor, most turns borrowed plus one.
GROUP, HEADS = 20, 4
WORD = r"[^\x20\x09-\x0D]+"
#: What parts of a node add up to.
SUMS = ("n_convs", "n_children", "n_leaves", "saved_tokens")
PART = "id binary, parent binary, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string, open boolean, asks boolean, range int"


def sequences(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): each conversation's turns in order as {mark, words}; mark is the digest in hex."""
    told = turns.filter("conv_id IS NOT NULL").select(
        "conv_id", "turn",
        F.md5(F.concat(F.coalesce("role", F.lit("")), F.lit("\0"), F.coalesce("text", F.lit("")))).alias("mark"),
        F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("int").alias("words"),
    )
    ordered = F.sort_array(F.collect_list(F.struct("turn", "mark", "words")))
    return told.groupBy("conv_id").agg(F.transform(ordered, lambda x: F.struct(x["mark"].alias("mark"), x["words"].alias("words"))).alias("turns"))


def rebuilt(own: DataFrame) -> DataFrame:
    """Each conversation with its first crc32(conv_id) % 4 turns taken from the first one of its twenty."""
    heads = own.filter(F.col("conv_id") % GROUP == 0).select(F.col("conv_id").alias("donor"), F.slice("turns", 1, HEADS - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int")
    rows = own.withColumn("donor", F.col("conv_id") - F.col("conv_id") % GROUP).withColumn("h", h).join(heads, "donor", "left")
    none = F.slice("turns", 1, 0)
    return rows.select("conv_id", F.concat(F.coalesce(F.slice("head", F.lit(1), F.col("h")), none), F.slice("turns", F.col("h") + 1, F.size("turns"))).alias("turns"))


def ranges(seqs: DataFrame, per_range: int = RANGE) -> tuple[DataFrame, DataFrame]:
    """(rows, edges): rows (range, key, conv_id, words) cut by key and conv_id; edges (range, before, after): the keys beside each range."""
    keyed = written(seqs.select("conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: t["mark"]), "")).alias("key"), F.transform("turns", lambda t: t["words"]).alias("words")))
    total = keyed.agg(F.count("*").alias("n"), F.sum(F.size("words")).alias("t")).first()
    n = max(1, -(-((total.t or 0) + total.n) // per_range))
    rows = written(keyed.repartitionByRange(n, "key", "conv_id").withColumn("range", F.spark_partition_id()))
    ends = rows.groupBy("range").agg(F.min("key").alias("low"), F.max("key").alias("high"))
    w = Window.orderBy("range")  # one row a range
    return rows, ends.select("range", F.lag("high").over(w).alias("before"), F.lead("low").over(w).alias("after"))


# --- one range ------------------------------------------------------------------------------------------------------


def least_of_runs(values: np.ndarray) -> list[np.ndarray]:
    """Sparse table: in level k, the least of each 2^k neighbours."""
    out = [values]
    while (step := 1 << (len(out) - 1)) * 2 <= len(values):
        out.append(np.minimum(out[-1][:-step], out[-1][step:]))
    return out


def left_extents(table: list[np.ndarray], at: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """For each row at: the first row from which all LCPs up to it are depth or more. LCP i lies between rows i - 1 and i."""
    at = at.copy()
    for k in reversed(range(len(table))):
        start = at - (1 << k) + 1
        ok = (start >= 1) & (table[k][np.clip(start, 0, len(table[k]) - 1)] >= depth)
        at[ok] -= 1 << k
    return at


def right_extents(table: list[np.ndarray], at: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """For each row at: the last row down to which all LCPs after it are depth or more."""
    at, n = at.copy(), len(table[0])
    for k in reversed(range(len(table))):
        ok = (at + (1 << k) < n) & (table[k][np.clip(at + 1, 0, len(table[k]) - 1)] >= depth)
        at[ok] += 1 << k
    return at


def least_between(table: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The least value from left to right, both included."""
    level = np.log2(right - left + 1).astype(np.int64)
    out = np.empty(len(left), table[0].dtype)
    for k in np.unique(level):
        m = level == k
        out[m] = np.minimum(table[k][left[m]], table[k][right[m] - (1 << k) + 1])
    return out


def _common(a: bytes, b: bytes) -> int:
    """Turns that two keys share from the beginning on."""
    n = min(len(a), len(b)) // TURN
    x, y = np.frombuffer(a, "V16", n), np.frombuffer(b, "V16", n)
    differs = np.flatnonzero(x != y)
    return int(differs[0]) if len(differs) else n


def _sums(values: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(values, dtype=np.int64)])


def nodes(rows: pd.DataFrame, before: bytes | None, after: bytes | None) -> dict[str, np.ndarray | list]:
    """The parts of nodes that one range bears; rows: key, conv_id, words."""
    rows = rows.sort_values(["key", "conv_id"], ignore_index=True)
    keys, ids, number = rows["key"].tolist(), rows["conv_id"].to_numpy(np.int64), int(rows["range"].iloc[0])
    n, length = len(keys), np.array([len(k) // TURN for k in keys], np.int64)
    first = -1 if before is None else _common(before, keys[0])
    last = -1 if after is None else _common(keys[-1], after)
    lcp = np.array([first, *map(_common, keys[:-1], keys[1:])], np.int64)
    following = np.append(lcp[1:], last)
    table, least_id = least_of_runs(lcp), least_of_runs(ids)

    # words: told[at[i] + d] are those of row i's first d turns; fresh[i]: of the turns that row i introduces
    at = _sums(length)
    told = _sums(np.concatenate([np.asarray(w, np.int64) for w in rows["words"]]) if at[-1] else np.zeros(0, np.int64))
    prefix = lambda i, d: told[at[i] + d] - told[at[i]]
    row = np.arange(n)
    whole, fresh = _sums(prefix(row, length)), _sums(prefix(row, length) - prefix(row, np.maximum(lcp, 0)))
    leaf, run = _sums(following < length), np.flatnonzero(np.append(True, (lcp[1:] < length[1:]) | (length[1:] != length[:-1])))
    same = np.diff(np.append(run, n))[np.searchsorted(run, row, "right") - 1] - (row - run[np.searchsorted(run, row, "right") - 1])
    forks = np.sort(lcp[length > lcp] * (n + 1) + row[length > lcp])  # rows that begin a child of a node of depth lcp

    # candidates: each row's every prefix; the row that is its own left end speaks
    i, d = np.repeat(row, length + 1), np.concatenate([np.arange(x + 1) for x in length])
    own = left_extents(table, i, d) == i
    i, d = i[own], d[own]
    r = right_extents(table, i, d)
    begun = np.maximum(d, lcp[i] + 1)  # the depths of the node's subtree that its first row introduces
    words = (whole[r + 1] - whole[i]) - (r - i + 1) * np.where(d > 0, prefix(i, np.maximum(d - 1, 0)), 0)
    distinct = fresh[r + 1] - fresh[i + 1] + prefix(i, length[i]) - prefix(i, np.minimum(np.maximum(begun - 1, 0), length[i]))
    children = np.searchsorted(forks, d * (n + 1) + r, "right") - np.searchsorted(forks, d * (n + 1) + i, "right")
    children += (length[i] > d) & (lcp[i] <= d)
    open_ = ((i == 0) & (d <= first)) | ((r == n - 1) & (d <= last))
    parent = left_extents(table, i, d - 1)
    parent_end = right_extents(table, i, d - 1)
    asks = (d > 0) & (((parent == 0) & (d - 1 <= first)) | ((parent_end == n - 1) & (d - 1 <= last)))
    smallest = least_between(least_id, parent, parent_end)
    mark = lambda k, x: hashlib.md5(keys[k][: x * TURN]).digest()
    ended = np.where(length[i] == d, np.minimum(same[i], r - i + 1), 0)
    return {
        "id": [mark(k, x) if o else None for k, x, o in zip(i, d, open_, strict=True)],
        "parent": [mark(k, x - 1) if a else None for k, x, a in zip(i, d, asks, strict=True)],
        "depth": d, "conv_id": least_between(least_id, i, r), "parent_conv_id": pd.array(np.where(d > 0, smallest, 0), "Int64"),
        "n_convs": r - i + 1, "n_children": children, "n_leaves": leaf[r + 1] - leaf[i], "saved_tokens": words - distinct,
        "ends": [_ends(ids[k : k + e], o) for k, e, o in zip(i, ended, open_, strict=True)],
        "open": open_, "asks": asks, "range": np.full(len(i), number, np.int32),
    }


def _ends(ids: np.ndarray, open_: bool) -> str:
    """The ids that end at a node, joined: as such where more may follow, else their digest."""
    text = ",".join(map(str, ids.tolist()))
    return text if open_ else hashlib.sha256(text.encode()).hexdigest()


def _ranged(key: tuple, rows: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
    if not len(rows):
        return pd.DataFrame(columns=[c.split()[0] for c in PART.split(", ")])
    value = lambda x: None if x is None or x is pd.NA or isinstance(x, float) else bytes(x)
    out = pd.DataFrame(nodes(rows, value(edges["before"].iloc[0]), value(edges["after"].iloc[0])))
    out.loc[out["depth"] == 0, "parent_conv_id"] = pd.NA
    return out


def _digested(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (id, ends) by id, then range: one digest an id over the joined parts, read as they come."""
    current, state, began = None, hashlib.sha256(), False
    for batch in batches:
        done = []
        for key, text in zip(batch["id"], batch["ends"], strict=True):
            if key != current:
                if current is not None:
                    done.append((current, state.hexdigest()))
                current, state, began = key, hashlib.sha256(), False
            if text:
                state.update((("," if began else "") + text).encode())
                began = True
        yield pd.DataFrame(done, columns=["id", "ends"])
    if current is not None:
        yield pd.DataFrame([(current, state.hexdigest())], columns=["id", "ends"])


# --- all ranges -----------------------------------------------------------------------------------------------------


def trie(seqs: DataFrame, per_range: int = RANGE) -> DataFrame:
    """The nodes of the trie of sequences (conv_id, turns as {mark, words}): one row each, with the columns of op12."""
    rows, edges = ranges(seqs, per_range)
    parts = written(rows.groupBy("range").cogroup(edges.groupBy("range")).applyInPandas(_ranged, PART))
    opened = parts.filter("open")
    digests = small_batches(opened.select("id", "range", "ends").repartition("id").sortWithinPartitions("id", "range").select("id", "ends")).mapInPandas(_digested, "id binary, ends string")
    # a row a range and depth of its edge keys
    met = opened.groupBy("id").agg(F.first("parent", True).alias("parent"), F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.min("parent_conv_id").alias("parent_conv_id"), F.max("asks").alias("asks"), *[F.sum(c).alias(c) for c in SUMS])
    met = written(met.join(digests, "id"))
    columns = ["parent", "depth", "conv_id", "parent_conv_id", "asks", *SUMS, "ends"]
    every = parts.filter("NOT open").select(columns).unionByName(met.select(columns))
    parents = met.select(F.col("id").alias("parent"), F.col("conv_id").alias("above"))
    asking = every.filter("asks").join(parents, "parent", "left").withColumn("parent_conv_id", F.coalesce("above", "parent_conv_id"))
    out = ["conv_id", "depth", "parent_conv_id", *SUMS, F.col("ends").alias("ends_sha256")]
    return every.filter("NOT asks").select(out).unionByName(asking.select(out))


def nodes_of(conversations: DataFrame, per_range: int = RANGE) -> DataFrame:
    """op12: the trie of the rebuilt conversations."""
    return trie(rebuilt(written(sequences(conversations))), per_range)


#: CRC-32 (its reflected polynomial) over the bytes of a decimal number, by the bit.
_CRC = "list_reduce(list_transform(range(1, length(c::VARCHAR) + 1), lambda k: ascii(substr(c::VARCHAR, k, 1))::BIGINT), lambda s, b: list_reduce([xor(s, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: xor(a >> 1, (a & 1) * 3988292384)), 4294967295::BIGINT)"
ORACLE = rf"""
WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, turn FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT c, list({{'r': role, 't': text}} ORDER BY turn NULLS FIRST, md5(role || chr(0) || text)) AS s FROM t GROUP BY c),
heads AS (SELECT own.c, own.s, (xor({_CRC.replace("c::", "own.c::")}, 4294967295) % 4)::INT AS h, donor.s AS d FROM own LEFT JOIN own AS donor ON donor.c = own.c - own.c % 20),
built AS (SELECT c, list_concat(coalesce(d[1:h], []), coalesce(s[h + 1:], [])) AS s FROM heads),
each AS (SELECT c, s[1:depth] AS p, depth, len(s) = depth AS ended FROM built, unnest(range(0, len(s) + 1)) AS u(depth)),
node AS (SELECT p, depth, min(c) AS conv_id, count(*) AS n_convs, coalesce(string_agg(c, ',' ORDER BY c) FILTER (ended), '') AS ends FROM each GROUP BY p, depth),
cost AS (SELECT *, (n_convs - 1) * CASE WHEN depth = 0 THEN 0 ELSE len(regexp_extract_all(p[depth].t, '{WORD}')) END AS own FROM node),
kids AS (SELECT a.p, a.depth, any_value(b.conv_id) AS parent_conv_id FROM node a JOIN node b ON b.depth = a.depth - 1 AND b.p = a.p[1:a.depth - 1] GROUP BY a.p, a.depth),
childs AS (SELECT p[1:depth - 1] AS p, depth - 1 AS depth, count(*) AS n_children FROM node WHERE depth > 0 GROUP BY ALL),
below AS (SELECT c.p[1:d] AS p, d AS depth, sum(own) AS saved, sum((k.n_children IS NULL)::INT) AS leaves FROM cost c LEFT JOIN childs k USING (p, depth), unnest(range(0, c.depth + 1)) AS u(d) GROUP BY ALL)
SELECT n.conv_id, n.depth::BIGINT AS depth, kids.parent_conv_id, n.n_convs, coalesce(childs.n_children, 0)::BIGINT AS n_children, below.leaves::BIGINT AS n_leaves, below.saved::BIGINT AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM node n LEFT JOIN kids USING (p, depth) LEFT JOIN childs USING (p, depth) JOIN below USING (p, depth)
"""
