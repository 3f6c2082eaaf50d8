"""Ranked lexical search over document FP-trees.

A document is the vector of its terms that some item asks for, most frequent term first, with their counts. Sorted
vectors share beginnings, so a tree of paths holds them: a node is a run of documents with a common path. It keeps for
each term in its subtree the largest count, and the least m (document length) and id. A term's part of a score grows with
the count and falls with m, so a node's maxima and minimum bound every score below it. Items descend depth first, best
child first, and leave a child that can't better their own tenth best. Small children of a node stand in buckets that are
scored exactly. Scores and order are exact.

The range partitions of the vectors hold like vectors together; a group of equal documents is cut apart by id. A task
builds trees of TREE documents one after the other and carries each item's best on, so memory doesn't grow with its rows.
Tasks give LIMIT rows an item; a window ranks them. Items go to the tasks in blocks of about BLOCK_BYTES of text and BLOCK
items, one pass over the documents each.

Null texts are empty; documents without terms count nowhere. Rows are documents: a repeated row is one more. Rows of one
item_id are one item with all their terms (null ids alike). A document without an id ranks last among equal scores.
Items without a term, and an empty table on either side, give no rows. Only doc_id, item_id and text are read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathomline.llm.common import small_batches, written

#: Results an item; documents of a tree, of a bucket; rows of a range.
LIMIT, TREE, BUCKET, ROWS = 10, 8192, 16, 16384
#: A block of items: bytes of text and items on average.
BLOCK_BYTES, BLOCK = 16 << 20, 4096
#: Scoring (fixed values): weights in thousandths; m of a document of mean length is 10 + 90.
SCALE, TF, BASE, SLOPE, SHARE = 1000, 1_000_000_000, 10, 90, 8
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes of UTF-8: capital letters to small ones, what is no part of a term to a space.
BYTES = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256)).lower()
LAST = np.iinfo(np.int64).max


def terms(text: bytes) -> list[bytes]:
    """A text's terms in order."""
    return text.translate(BYTES).split()


# --- one tree -------------------------------------------------------------------------------------------------------


def _segments(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions of several runs, one after the other."""
    total = np.cumsum(sizes)
    return np.arange(total[-1] if len(total) else 0) + np.repeat(starts - (total - sizes), sizes)


def part(weight: np.ndarray, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What terms add to a score."""
    return weight * ((TF * tf) // (SCALE * tf + SHARE * m))


class Items:
    """Items as sets of term numbers, and the best documents each has met."""

    def __init__(self, sets: list[np.ndarray], weight: np.ndarray):
        self.weight = weight
        self.size = np.array([len(s) for s in sets], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.concatenate(sets) if sets else np.zeros(0, np.int64)
        self.score = np.zeros((len(sets), LIMIT), np.int64)  # 0: free
        self.doc = np.full((len(sets), LIMIT), LAST, np.int64)
        self.named = np.ones((len(sets), LIMIT), bool)
        self.scored = 0

    def sums(self, which: np.ndarray, values: np.ndarray) -> np.ndarray:
        """The sum of each item's terms' values (last axis)."""
        at = self.flat[_segments(self.start[which], self.size[which])]
        size = self.size[which]
        return np.add.reduceat(values[..., at], np.cumsum(size) - size, axis=-1)

    def open(self, which: np.ndarray, bound: np.ndarray, least_id: int) -> np.ndarray:
        """Whether documents of that bound could be among an item's best."""
        worst, last = self.score[which, -1], self.doc[which, -1]
        return (bound > worst) | ((bound == worst) & (bound > 0) & (least_id <= last))

    def offer(self, which: np.ndarray, scores: np.ndarray, doc: np.ndarray, named: np.ndarray) -> None:
        """Take documents (rows of scores) into the best of items (its columns)."""
        self.scored += scores.size
        for k in np.flatnonzero(self.open(which, scores.max(axis=0), doc.min())):
            i, s = which[k], scores[:, k]
            hit = s > 0
            s, d, n = (np.concatenate(x) for x in ((self.score[i], s[hit]), (self.doc[i], doc[hit]), (self.named[i], named[hit])))
            order = np.lexsort((~n, d, -s))[:LIMIT]
            self.score[i], self.doc[i], self.named[i] = s[order], d[order], n[order]


class Tree:
    """An FP-tree of documents given by doc (id), m, paths (sorted term numbers each) and counts."""

    def __init__(self, doc: np.ndarray, named: np.ndarray, m: np.ndarray, paths: list[np.ndarray], counts: list[np.ndarray], terms_: int):
        order = sorted(range(len(doc)), key=lambda k: (paths[k].astype(">u4").tobytes(), m[k], doc[k]))
        self.doc, self.named, self.m = doc[order], named[order], m[order]
        self.size = np.array([len(paths[k]) for k in order], np.int64)
        self.at = np.append(0, np.cumsum(self.size))
        self.term = np.concatenate([paths[k] for k in order]).astype(np.int64)
        self.tf = np.concatenate([counts[k] for k in order]).astype(np.int64)
        self.row = np.zeros((BUCKET, terms_), np.int64)
        self.first, self.last, self.children = self._nodes(self._shared())
        self.bounds = self._bounds()

    def _shared(self) -> np.ndarray:
        """How many first terms each document shares with the one before it."""
        out, n = np.zeros(len(self.doc), np.int64), np.minimum(self.size[1:], self.size[:-1])
        alive, depth = np.arange(1, len(self.doc)), 0
        while len(alive):
            alive = alive[n[alive - 1] > depth]
            alive = alive[self.term[self.at[alive] + depth] == self.term[self.at[alive - 1] + depth]]
            depth += 1
            out[alive] = depth
        return out

    def _nodes(self, shared: np.ndarray) -> tuple[list[int], list[int], list[list[int]]]:
        """Runs of documents: parents before children. A node's documents share a path and fork after it."""
        first, last, children, todo = [0], [len(self.doc)], [[]], [0]

        def grown(parent: int, a: int, b: int) -> int:
            children[parent].append(len(first))
            first.append(a), last.append(b), children.append([])
            return len(first) - 1

        while todo:
            node = todo.pop()
            lo, hi = first[node], last[node]
            if hi - lo <= BUCKET:
                continue
            inner = shared[lo + 1 : hi]
            forks = [lo, *(lo + 1 + np.flatnonzero(inner == inner.min())).tolist(), hi]
            begin = lo  # of the bucket that fills with small neighbours
            for a, b in zip(forks, forks[1:], strict=False):
                large = b - a > BUCKET
                if a > begin and (large or b - begin > BUCKET):
                    grown(node, begin, a)
                    begin = a
                if large:
                    todo.append(grown(node, a, b))
                    begin = b
            if hi > begin:
                grown(node, begin, hi)
        return first, last, children

    def _bounds(self) -> list[tuple[np.ndarray, np.ndarray, int, int]]:
        """(terms, largest counts, least m, least id) of each node, children first."""
        out: list = [None] * len(self.first)
        for k in reversed(range(len(self.first))):
            lo, hi = self.first[k], self.last[k]
            if self.children[k]:
                t, c = (np.concatenate([out[x][j] for x in self.children[k]]) for j in (0, 1))
            else:
                t, c = self.term[self.at[lo] : self.at[hi]], self.tf[self.at[lo] : self.at[hi]]
            order = np.argsort(t, kind="stable")
            t, c = t[order], c[order]
            new = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
            out[k] = (t[new], np.maximum.reduceat(c, new), int(self.m[lo:hi].min()), int(self.doc[lo:hi].min()))
        return out

    def bound(self, node: int, items: Items, which: np.ndarray) -> np.ndarray:
        """No document below the node scores more for these items."""
        t, c, m, _ = self.bounds[node]
        self.row[0, t] = part(items.weight[t], c, np.int64(m))
        out = items.sums(which, self.row[0])
        self.row[0, t] = 0
        return out

    def search(self, items: Items) -> None:
        """Every item's best among these documents and those met before."""
        which = np.arange(len(items.size))
        todo = [(0, which, self.bound(0, items, which))] if len(which) else []
        while todo:
            node, which, bound = todo.pop()
            live = items.open(which, bound, self.bounds[node][3])
            which = which[live]
            if not len(which):
                continue
            if not self.children[node]:
                self._score(node, items, which)
                continue
            below = []
            for child in self.children[node]:
                b = self.bound(child, items, which)
                live = items.open(which, b, self.bounds[child][3])
                if live.any():
                    below.append((child, which[live], b[live]))
            todo += sorted(below, key=lambda x: (int(x[2].max()), -self.bounds[x[0]][3]))

    def _score(self, node: int, items: Items, which: np.ndarray) -> None:
        lo, hi = self.first[node], self.last[node]
        a, b = self.at[lo], self.at[hi]
        doc, t = np.repeat(np.arange(hi - lo), self.size[lo:hi]), self.term[a:b]
        self.row[doc, t] = part(items.weight[t], self.tf[a:b], self.m[lo:hi][doc])
        items.offer(which, items.sums(which, self.row[: hi - lo]), self.doc[lo:hi], self.named[lo:hi])
        self.row[doc, t] = 0


# --- Spark ----------------------------------------------------------------------------------------------------------


def _counted(vocabulary: dict[bytes, int]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Documents (doc_id, body) to their length and the counts of the vocabulary's terms."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n, found, tf = [], [], []
            for body in batch["body"]:
                words = terms(bytes(body))
                held = np.fromiter((k for k in map(vocabulary.get, words) if k is not None), np.int32)
                k, c = np.unique(held, return_counts=True)
                n.append(len(words)), found.append(k), tf.append(c.astype(np.int32))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "named": batch["named"], "n": np.array(n, np.int64), "terms": found, "tf": tf})

    return run


def _pathed(rank: np.ndarray) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Counts by term to paths: frequency ranks ascending, as four bytes each; terms without weight (rank -1) go."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            paths, counts = [], []
            for t, c in zip(batch["terms"], batch["tf"], strict=True):
                r = rank[np.asarray(t, np.int64)]
                c, r = np.asarray(c)[r >= 0], r[r >= 0]
                order = np.argsort(r)
                paths.append(r[order].astype(">u4").tobytes()), counts.append(c[order].astype(">u4").tobytes())
            yield pd.DataFrame({"doc_id": batch["doc_id"], "named": batch["named"], "m": batch["m"], "path": paths, "tf": counts})

    return run


def _searched(sets: list[np.ndarray], weight: np.ndarray, ids: list) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Documents as paths to every item's best of this task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        items = Items(sets, weight)
        held: list[pd.DataFrame] = []

        def grow() -> None:
            rows = pd.concat(held)
            read = lambda c: [np.frombuffer(x, ">u4").astype(np.int64) for x in rows[c]]
            Tree(rows["doc_id"].to_numpy(np.int64), rows["named"].to_numpy(bool), rows["m"].to_numpy(np.int64), read("path"), read("tf"), len(weight)).search(items)
            held.clear()

        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) >= TREE:
                grow()
        if sum(map(len, held)):
            grow()
        i, k = np.nonzero(items.score)
        doc = pd.array(items.doc[i, k], "Int64")
        doc[~items.named[i, k]] = pd.NA
        yield pd.DataFrame({"item_id": pd.array([ids[x] for x in i], "Int64"), "doc_id": doc, "score": items.score[i, k]})

    return run


def _best(docs: DataFrame, items: list) -> DataFrame:
    """(item_id, doc_id, score): candidates for a block of items, each item's best a task."""
    vocabulary = {t: k for k, t in enumerate(sorted({bytes(t) for x in items for t in x.terms}))}
    body = docs.select(F.coalesce("doc_id", F.lit(LAST)).alias("doc_id"), F.col("doc_id").isNotNull().alias("named"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("body"))
    vectors = written(small_batches(body).mapInPandas(_counted(vocabulary), "doc_id long, named boolean, n long, terms array<int>, tf array<int>"))
    total = vectors.filter("n > 0").agg(F.count("*").alias("n"), F.sum("n").alias("l"), F.count(F.when(F.size("terms") > 0, 1)).alias("met")).first()
    df = np.zeros(len(vocabulary), np.int64)
    for term, n in vectors.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # as many rows as the block has terms
        df[term] = n
    weight = np.array([math.floor(SCALE * math.log((2 * total.n + 2) / (2 * x + 1))) if x else 0 for x in df.tolist()], np.int64)
    order = np.lexsort((np.arange(len(df)), -df))
    order = order[weight[order] > 0]
    rank = np.full(len(df), -1, np.int64)
    rank[order] = np.arange(len(order))
    sets = [(x.item_id, np.sort(r[r >= 0])) for x in items for r in [rank[[vocabulary[bytes(t)] for t in x.terms]]]]
    sets = [x for x in sets if len(x[1])]

    m = F.lit(BASE) + F.expr(f"CAST(CAST({SLOPE} AS DECIMAL(38, 0)) * n * CAST({total.n} AS DECIMAL(20, 0)) DIV CAST({total.l or 1} AS DECIMAL(20, 0)) AS BIGINT)")
    paths = vectors.filter(F.size("terms") > 0).select("doc_id", "named", m.alias("m"), "terms", "tf").mapInPandas(_pathed(rank), "doc_id long, named boolean, m long, path binary, tf binary").filter("octet_length(path) > 0")
    near = paths.withColumn("begin", F.expr("substring(path, 1, 64)")).repartitionByRange(max(1, -(-total.met // ROWS)), "begin", "m", "doc_id").sortWithinPartitions("begin", "m", "doc_id").drop("begin")
    return near.mapInPandas(_searched([s for _, s in sets], weight[order], [i for i, _ in sets]), "item_id long, doc_id long, score long")


def ranked(docs: DataFrame, items: DataFrame) -> DataFrame:
    """op13: each item's LIMIT best documents with a score above 0, highest first, ties by doc_id."""
    asked = items.select("item_id", F.split(F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+").alias("t"))
    asked = asked.groupBy("item_id").agg(F.transform(F.filter(F.array_distinct(F.flatten(F.collect_list("t"))), lambda t: t != ""), lambda t: t.cast("binary")).alias("terms"))
    asked = written(asked.filter(F.size("terms") > 0))
    size = asked.agg(F.count("*").alias("n"), F.sum(F.aggregate("terms", F.lit(0).cast("bigint"), lambda a, t: a + F.octet_length(t))).alias("bytes")).first()
    blocks = max(-(-size.n // BLOCK), -(-(size.bytes or 0) // BLOCK_BYTES))
    best = docs.sparkSession.createDataFrame([], "item_id long, doc_id long, score long")
    for block in range(blocks):
        best = best.unionByName(_best(docs, asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect()))
    w = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= LIMIT).select("item_id", "rank", "doc_id", "score")


_SQL_TERMS = f"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}')"
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, {_SQL_TERMS} AS terms FROM documents),
s AS (SELECT count(*) AS nn, sum(len(terms))::BIGINT AS ll FROM d WHERE len(terms) > 0),
q AS (SELECT DISTINCT item_id, unnest({_SQL_TERMS}) AS term FROM benchmark),
tf AS (SELECT row, doc_id, n, term, count(*) AS tf FROM (SELECT row, doc_id, len(terms) AS n, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, floor({SCALE} * ln((2 * nn + 2) / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), s),
found AS (SELECT item_id, row, doc_id, sum(w * (({TF} * tf) // ({SCALE} * tf + {SHARE} * ({BASE} + ({SLOPE} * n * nn) // ll))))::BIGINT AS score FROM q JOIN w USING (term) JOIN tf USING (term), s GROUP BY ALL)
SELECT item_id, rank::INT AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM found WHERE score > 0) WHERE rank <= {LIMIT}
"""
