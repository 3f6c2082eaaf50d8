"""SimHash near-duplicates at a bound of similarity: every pair of texts at or above it, and none below it.

A text is the set of the hashes of its word shingles; equal sets are one node. SimHash proposes: fingerprints of the
same shingles, in several families, are linked by the Gray-order index of module simhash, and an exact comparison of
the sets decides each proposal. Fingerprints of 64 bits miss part of the pairs near the bound, so what SimHash left
apart is completed by exact means: all sets are kept in one order of the hashes, common ones last; two sets that are
similar enough share a hash among the first of each (prefix filter), and the first one that they share stands early
enough in both (position filter), so no similar pair is missed; the same exact comparison decides. Among the many
nodes of one hash, neighbours in a few orders are compared first, and then only pairs that are not connected by that;
connected groups are what counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm.common import settled, small_batches, written
from fathomline.llm.simhash import FAN, SEED, components, edges, from_hashes

#: Words of a shingle; the least similarity of a link is ABOVE / BELOW.
WORDS, ABOVE, BELOW = 5, 4, 5
#: Families of fingerprints, and the bits in which proposed ones may differ; both bear on how much is left to complete.
FAMILIES, LIMIT = 2, 4
#: Nodes of one hash that are all compared at once; orders in which the nodes of larger groups are linked first.
SMALL, ORDERS = 8, 3
#: Buckets of hashes whose sizes bound what two sets share: so many at least, one to two hashes in each; sizes are told
#: up to FULL, two to a byte.
BUCKETS, FULL = 64, 15
#: Bytes of unpacked sketches, and pairs, that a task holds at once.
SKETCHES, PAIRS = 4 << 20, 1 << 14
#: A pair is told in the first large group that it shares, if that is among so many first ones of each; else again.
FIRST = 32
#: Documents whose hashes are counted to tell common ones, and how many of these are kept. Both bear on speed alone.
SAMPLE, COMMON = 10_000, 1 << 16
#: Rows whose groups are paired in one go, at least; a group is never cut.
AT_ONCE = 1 << 18


def every_shingle(text: str, words: int = WORDS) -> np.ndarray:
    """The hashes of a text's word shingles, repeats included; words as for SimHash. Fewer words: one shingle of all."""
    parts = text.encode().lower().split()
    if not parts:
        return np.empty(0, dtype=np.uint64)
    known = {x: xxhash.xxh64_intdigest(x, SEED) for x in set(parts)}
    w = np.fromiter(map(known.__getitem__, parts), dtype=np.uint64, count=len(parts))
    width = min(words, len(parts))
    n = len(parts) - width + 1
    h = np.full(n, width, dtype=np.uint64)
    for k in range(width):
        h = (h ^ w[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return h


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """The distinct hashes of a text's word shingles, sorted."""
    return np.unique(every_shingle(text, words).view(np.int64))


def fits(size_a: np.ndarray, at_a: np.ndarray, size_b: np.ndarray, at_b: np.ndarray) -> np.ndarray:
    """Whether sets whose first shared hash stands at these places can be similar."""
    return np.minimum(size_a - at_a, size_b - at_b) * (ABOVE + BELOW) >= ABOVE * (size_a + size_b)


def common(rows: DataFrame, words: int) -> np.ndarray:
    """Hashes that several documents of a sample have, the most common last."""
    every = max(1, rows.count() // SAMPLE)
    some = rows.filter(F.pmod(F.xxhash64("id"), F.lit(every)) == 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shingles(t, words) for t in b.column(1).to_pylist()]
            token, n = np.unique(np.concatenate(found) if found else np.empty(0, np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(n, pa.int64())], names=["token", "n"])

    often = some.mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).filter("n > 2").orderBy(F.desc("n"), "token").limit(COMMON)
    return np.array([r.token for r in often.collect()][::-1], dtype=np.int64)


def with_id(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text) of the rows with an id; a null text is empty."""
    return small_batches(docs).filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def name(x: np.ndarray) -> int:
    """A hash of a whole set, signed."""
    return int(np.uint64(xxhash.xxh64_intdigest(x.tobytes(), SEED)).view(np.int64))


def sketch(x: np.ndarray) -> bytes:
    """How many of a set's hashes are in each bucket. Buckets grow with the set, else large sets all look alike."""
    buckets = max(BUCKETS, 1 << max(0, len(x).bit_length() - 1))
    count = np.minimum(np.bincount(x & (buckets - 1), minlength=buckets), FULL).astype(np.uint8)
    return (count[::2] | count[1::2] << np.uint8(4)).tobytes()


def counts(sketches: np.ndarray) -> np.ndarray:
    """The bucket sizes of sketches of one length, a row for each."""
    packed = np.frombuffer(b"".join(sketches), np.uint8).reshape(len(sketches), -1)
    return np.stack((packed & FULL, packed >> 4), axis=2).reshape(len(packed), -1)


def room(a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether two sets of these sketches and this sum of sizes can be similar: they share no more of a bucket than the smaller has there."""
    out = np.zeros(len(a), dtype=bool)
    if not len(a):
        return out
    lengths = np.stack([np.fromiter(map(len, x), dtype=np.int64, count=len(x)) for x in (a, b)])
    shapes, of = np.unique(lengths, axis=1, return_inverse=True)
    for k in range(shapes.shape[1]):
        which = np.flatnonzero(of.ravel() == k)
        step = max(1, SKETCHES // int(shapes[:, k].max()) // 2)
        for at in (which[n : n + step] for n in range(0, len(which), step)):
            x, y = counts(a[at]), counts(b[at])
            if x.shape[1] < y.shape[1]:
                x, y = y, x
            while x.shape[1] > y.shape[1]:  # fewer buckets: each takes in two
                x = np.minimum(x[:, : x.shape[1] // 2] + x[:, x.shape[1] // 2 :], FULL).astype(np.uint8)
            least = np.minimum(x, y)
            out[at] = (least.sum(axis=1, dtype=np.int64) * (ABOVE + BELOW) >= ABOVE * size[at]) | (least == FULL).any(axis=1)
    return out


def starts(rows: DataFrame, words: int) -> DataFrame:
    """(uid, id, node, size, sketch binary, tokens array<long>, fp array<long>) of each row of (id, text).

    node: the set's name; sketch: its hashes by bucket; tokens: its first hashes; fp: a fingerprint for each family. The order of hashes is one for all sets. A similar set shares one of the first size - ceil(size * ABOVE / BELOW) + 1.
    """
    last = common(rows, words)
    by = np.argsort(last)
    known, rank = last[by], by + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 40
        for b in batches:
            node, size, sketches, tokens, fp = [], [], [], [], []
            for t in b.column(1).to_pylist():
                h = every_shingle(t, words)
                x = np.unique(h.view(np.int64))
                node.append(name(x))
                size.append(len(x))
                sketches.append(sketch(x))
                fp.append(np.array(from_hashes(h, FAMILIES), dtype=np.uint64).view(np.int64))
                if len(known):
                    k = np.minimum(np.searchsorted(known, x), len(known) - 1)
                    x = x[np.lexsort((x, np.where(known[k] == x, rank[k], 0)))]
                tokens.append(x[: len(x) + (-len(x) * ABOVE // BELOW) + 1])
            yield pa.RecordBatch.from_arrays([
                pa.array(np.arange(uid, uid + len(node))), b.column(0), pa.array(node, pa.int64()), pa.array(size, pa.int64()), pa.array(sketches, pa.binary()), pa.array(tokens, pa.list_(pa.int64())), pa.array(fp, pa.list_(pa.int64())),
            ], names=["uid", "id", "node", "size", "sketch", "tokens", "fp"])
            uid += len(node)

    return written(rows.mapInArrow(run, "uid long, id long, node long, size long, sketch binary, tokens array<long>, fp array<long>"))


def whole(rows: DataFrame, asked: DataFrame, words: int) -> DataFrame:
    """(node, size, tokens): the whole sets of the asked (id, node), made from the texts of (id, text) again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(n, x) for n, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if name(x := shingles(t, words)) == n]
            yield pa.RecordBatch.from_arrays([
                pa.array([n for n, _ in found], pa.int64()), pa.array([len(x) for _, x in found], pa.int64()), pa.array([x for _, x in found], pa.list_(pa.int64())),
            ], names=["node", "size", "tokens"])

    made = rows.join(asked, "id").select("node", "text").mapInArrow(run, "node long, size long, tokens array<long>")
    return made.groupBy("node").agg(F.first("size").alias("size"), F.first("tokens").alias("tokens"))


def proposed(nodes: DataFrame) -> DataFrame:
    """(a, b): pairs of nodes that SimHash holds to be near: a spanning forest of its links in each family.

    Nodes of one fingerprint are linked with the smallest of them, and that one with other fingerprints'.
    """
    each = nodes.select("node", F.posexplode("fp").alias("family", "fp"))
    heads = written(each.groupBy("family", "fp").agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("n")))
    alike = each.join(heads.filter("n > 1"), ["family", "fp"]).filter("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b"))
    return written(alike.union(edges(heads.select("family", "fp", F.col("head").alias("node")), LIMIT)).distinct())


def grouped(batches: Iterator[pa.RecordBatch], columns: int, at_once: int = AT_ONCE) -> Iterator[list[np.ndarray]]:
    """The columns of rows that come in the order of the first, whole groups of it at a time."""
    held: list[list[np.ndarray]] = []
    waiting = 0
    for b in batches:
        cols = [b.column(k).to_numpy(zero_copy_only=False) for k in range(columns)]
        if not len(cols[0]):
            continue
        cut = int(np.searchsorted(cols[0], cols[0][-1], side="left"))
        if cut and waiting + cut >= at_once:
            yield [np.concatenate(x) for x in zip(*held, [c[:cut] for c in cols], strict=True)]
            held, waiting, cols = [], 0, [c[cut:] for c in cols]
        held.append(cols)
        waiting += len(cols[0])
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def neighbours(key: np.ndarray, node: np.ndarray, size: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of rows of one group that stand side by side in some orders and may be similar; most copies meet so."""
    left, right = [], []
    for turn in range(1, ORDERS + 1):
        mixed = (node.view(np.uint64) + np.uint64(turn)) * np.uint64(0x9E3779B97F4A7C15)
        order = np.lexsort((mixed ^ (mixed >> np.uint64(29)), key))
        i, j = order[:-1], order[1:]
        near = (key[i] == key[j]) & fits(size[i], at[i], size[j], at[j])
        left.append(i[near])
        right.append(j[near])
    return np.concatenate(left), np.concatenate(right)


def met(nodes: DataFrame) -> DataFrame:
    """(key, a, b, size, at): pairs of nodes that may be similar (key null), and the rows of the groups above SMALL.
    Groups up to SMALL give all their pairs, larger ones those of neighbours by size and in ORDERS other orders. A group's rows: node a, b null.
    """
    rows = nodes.select("node", "size", F.posexplode("tokens").alias("at", "key"))
    rows = rows.select("key", "node", "size", F.col("at").cast("long").alias("at")).repartition("key").sortWithinPartitions("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, node, size, at in grouped(batches, 4):
            same = key[1:] == key[:-1]
            some = np.concatenate((same, [False])) | np.concatenate(([False], same))
            key, node, size, at = key[some], node[some], size[some], at[some]
            order = np.lexsort((node, size, key))
            key, node, size, at = key[order], node[order], size[order], at[order]
            heads = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))[: len(key)])
            members = np.diff(np.append(heads, len(key)))
            large = np.repeat(members, members) > SMALL
            left, right = [], []
            for d in range(1, SMALL):
                i = np.flatnonzero((key[d:] == key[:-d]) & (~large[d:] | (d == 1)))
                i = i[fits(size[i], at[i], size[i + d], at[i + d])]
                left.append(node[i])
                right.append(node[i + d])
            key, held, size, at = key[large], node[large], size[large], at[large]
            i, j = neighbours(key, held, size, at)
            a, b = np.concatenate((*left, held[i])), np.concatenate((*right, held[j]))
            pairs = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b))), axis=1)
            n, m = pairs.shape[1], len(held)
            yield pa.RecordBatch.from_arrays([
                pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(key)]), pa.array(np.concatenate((pairs[0], held))), pa.concat_arrays([pa.array(pairs[1]), pa.nulls(m, pa.int64())]),
                pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(size)]), pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(at)]),
            ], names=["key", "a", "b", "size", "at"])

    return written(rows.mapInArrow(run, "key long, a long, b long, size long, at long"))


def apart(large: DataFrame, label: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b): the pairs of a group that are not connected yet and whose sketches leave room for a similarity.

    Sketches and the groups in which a node stands earlier come with the rows, so that pairs without room, and pairs
    that another group tells (earlier places fit all the more), are left where they are met.
    """
    first = large.groupBy("node").agg(F.slice(F.sort_array(F.collect_list(F.struct("at", "key"))), 1, FIRST).alias("first"))
    rows = large.join(label.withColumnRenamed("component", "label"), "node", "left").join(nodes.select("node", "sketch"), "node").join(first, "node")
    earlier = F.transform(F.filter("first", lambda x: x["at"] < F.col("at")), lambda x: x["key"]).alias("earlier")
    rows = rows.select("key", "node", "size", "at", F.coalesce("label", "node").alias("label"), "sketch", earlier).repartition("key").sortWithinPartitions("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def told() -> pa.RecordBatch:
            pairs = np.unique(np.concatenate(held, axis=1), axis=1)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])

        for key, node, size, at, label, sketches, earlier in grouped(batches, 7, AT_ONCE >> 4):
            cut = np.append(np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))), len(key))
            for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                names, of, count = np.unique(label[lo:hi], return_inverse=True, return_counts=True)
                if len(names) == 1:
                    continue
                # of two nodes that are apart, one at least is outside the largest connected part
                outside = of != count.argmax()
                for i in (np.flatnonzero(outside) + lo).tolist():
                    # a pair of two such nodes is met at the first of them
                    j = np.flatnonzero((label[lo:hi] != label[i]) & (~outside | (np.arange(lo, hi) > i)) & fits(size[i], at[i], size[lo:hi], at[lo:hi])) + lo
                    j = j[room(np.repeat(sketches[i : i + 1], len(j)), sketches[j], size[i] + size[j])]
                    if len(j) and len(earlier[i]):
                        whose = np.repeat(np.arange(len(j)), list(map(len, earlier[j])))
                        j = np.delete(j, whose[np.isin(np.concatenate(earlier[j]), earlier[i])])
                    if len(j):
                        held.append(np.stack((np.minimum(node[i], node[j]), np.maximum(node[i], node[j]))))
                        if sum(x.shape[1] for x in held) >= PAIRS:
                            yield told()
        if held:
            yield told()

    return rows.mapInArrow(run, "a long, b long")


def named(links: DataFrame, label: DataFrame) -> DataFrame:
    """The distinct links (a, b) with both ends replaced by their labels, where these differ."""
    for end in ("a", "b"):
        links = links.join(label.select(F.col("node").alias(end), F.col("component").alias(f"new_{end}")), end, "left").withColumn(end, F.coalesce(f"new_{end}", end)).drop(f"new_{end}")
    return links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def possible(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sketches leave room for a similarity at the bound."""
    for end in ("a", "b"):
        pairs = pairs.join(nodes.select(F.col("node").alias(end), F.col("size").alias(f"size_{end}"), F.col("sketch").alias(f"sketch_{end}")), end)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (b.column(k).to_numpy(zero_copy_only=False) for k in (4, 5))
            can = pa.array(room(x, y, b.column(2).to_numpy() + b.column(3).to_numpy()))
            yield pa.RecordBatch.from_arrays([b.column(k).filter(can) for k in (0, 1)], names=["a", "b"])

    return pairs.select("a", "b", "size_a", "size_b", "sketch_a", "sketch_b").mapInArrow(run, "a long, b long")


def similar(pairs: DataFrame, nodes: DataFrame, rows: DataFrame, words: int) -> DataFrame:
    """The distinct pairs (a, b) of nodes whose sets are similar, by exact comparison of whole sets."""

    def compared() -> DataFrame:
        asked = written(pairs.distinct())
        ends = asked.select(F.col("a").alias("node")).union(asked.select("b")).distinct()
        held = whole(rows, written(nodes.select("id", "node").join(ends, "node")), words)
        a = held.select(F.col("node").alias("a"), F.col("size").alias("size_a"), F.col("tokens").alias("tokens_a"))
        b = held.select(F.col("node").alias("b"), F.col("size").alias("size_b"), F.col("tokens").alias("tokens_b"))
        both = F.size(F.array_intersect("tokens_a", "tokens_b"))
        return asked.join(a, "a").join(b, "b").filter(both * (ABOVE + BELOW) >= ABOVE * (F.col("size_a") + F.col("size_b"))).select("a", "b")

    return settled(rows.sparkSession, compared)


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """(id, component_id) of each row with an id: the smallest id reachable by links of similar texts.

    Texts without words are like each other; a repeated id is one document. Sets with the same 64-bit hash are equal.
    """
    rows = with_id(docs, id_col, text_col)
    made = starts(rows, words)
    repeated = made.join(made.groupBy("node").agg(F.min("uid").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "node").filter("uid <> first").select("uid")
    nodes = made.join(written(repeated), "uid", "left_anti")
    found = met(nodes)
    slim = written(nodes.select("id", "node", "size", "sketch"))
    near = proposed(nodes).union(found.filter("b is not null").select("a", "b")).distinct()
    links = similar(possible(near, slim), slim, rows, words)
    large = found.filter("key is not null").select("key", F.col("a").alias("node"), "size", "at")
    own = made.select("id", "node").distinct()
    own = own.join(own.groupBy("id").agg(F.min("node").alias("b")), "id").select(F.col("node").alias("a"), "b").filter("a <> b")
    links = written(links.union(own).distinct())
    label = components(links)
    if not large.isEmpty():
        # what the other pairs of large groups add joins whole parts, so only parts are labelled anew
        over = named(similar(apart(large, label, slim), slim, rows, words), label)
        further = components(over).select(F.col("node").alias("part"), F.col("component").alias("whole"))
    else:
        further = None
    joined = made.select("id", "node").join(label, "node", "left").select("id", F.coalesce("component", "node").alias("part"))
    # a part's documents are dealt into FAN shares, so a large group is looked up in no single task
    dealt = joined.withColumn("share", F.pmod(F.xxhash64("id"), F.lit(FAN)))
    shares = dealt.groupBy("part", "share").agg(F.min("id").alias("low"))
    parts = shares.groupBy("part").agg(F.min("low").alias("component_id"))
    if further is not None:
        parts = parts.join(further, "part", "left").select("part", F.coalesce("whole", "part").alias("whole"), "component_id")
        parts = parts.join(parts.groupBy("whole").agg(F.min("component_id").alias("least")), "whole").select("part", F.col("least").alias("component_id"))
    named_ = shares.select("part", "share").join(parts, "part")
    return dealt.join(named_, ["part", "share"]).select("id", "component_id").distinct().withColumnRenamed("id", id_col)


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """The rows of docs whose id is the smallest of its class, and those without an id.

    Rows that share an id stay or go together.
    """
    dropped = settled(docs.sparkSession, lambda: classes(docs, id_col, text_col, words).filter(F.col("component_id") != F.col(id_col)).select(F.col(id_col).alias("gone")))
    return docs.alias("d").join(dropped.alias("x"), F.col(f"d.{id_col}") == F.col("x.gone"), "left_anti")
