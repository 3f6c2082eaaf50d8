"""SimHash near-duplicates over a Gray-order hierarchical index.

Fingerprints that differ in few bits agree in some blocks of their bits (pigeonholes), so each is routed to one group
for every choice of blocks. Within a group, fingerprints are sorted by the rank of their Gray code; runs of them form
the leaves of a tree whose nodes hold the bits that all members share, less those that the parent already holds. A
search goes down from the root adding up differences, and leaves a node with all its members once they exceed the
limit. Groups that are too large are split by further blocks of the bits still free. Groups return a spanning forest,
not pairs; the forests are joined by label propagation with pointer jumping.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathomline.llm.common import small_batches, written

#: Words of a shingle, hash seed, and greatest number of differing bits unless given.
WORDS, SEED, LIMIT = 3, 42, 2
#: Members of a tree node.
FANOUT = 8
#: Members beyond which a group is split by further blocks; how often.
LARGE, SPLITS = 4096, 3
#: Fingerprints whose groups are searched in one go, at least; a group is never cut.
AT_ONCE = 1 << 16
#: Into how many parts the links of a node are dealt, and the label that many nodes have.
FAN = 64
#: (query, node) pairs that a search holds at once; queries between two looks at which nodes are one label by now.
FRONT, CROWD = 1 << 18, 1 << 13


def mixed(x: np.ndarray, family: int) -> np.ndarray:
    """Further hashes of hashes, one for each family; family 0: the hashes themselves."""
    if not family:
        return x
    x = (x + np.uint64(family * 0x9E3779B97F4A7C15 % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def fingerprint(text: str, words: int = WORDS, families: int = 1) -> list[int]:
    """The SimHash of a text's word shingles, repeats included: a bit is set if it is in over half of the hashes.

    A-Z are lower-cased; words are what stands between ASCII white space. Fewer words than a shingle has: one shingle
    of all of them. No words: 0. Further families give further fingerprints of the same shingles.
    """
    parts = text.encode().lower().split()
    if not parts:
        return [0] * families
    joined = b" ".join(parts)
    n = max(1, len(parts) - words + 1)
    ends = np.cumsum(np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[min(words, len(parts)) - 1 :].tolist(), strict=True)), dtype=np.uint64, count=n)
    return from_hashes(hashes, families)


def from_hashes(hashes: np.ndarray, families: int = 1) -> list[int]:
    """The fingerprints of a text's shingle hashes, repeats included; 0 where there are none."""
    n, out = len(hashes), []
    for family in range(families):
        counts = np.zeros(64, dtype=np.int64)
        for k in range(0, n, 255):  # counts of so many bits fit a byte
            part = mixed(hashes[k : k + 255], family)
            counts += np.add.reduce(np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), axis=0, dtype=np.uint8)
        out.append(int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0]))
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, families: int = 1) -> DataFrame:
    """(id, fp array<long>): a fingerprint for each family, as signed 64-bit integers. Null texts are empty: 0."""
    rows = small_batches(docs).select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [np.array(fingerprint(t, words, families), dtype=np.uint64).view(np.int64) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.int64()))], names=["id", "fp"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, fp array<long>")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The position of each 64-bit pattern in the Gray code order."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


def rising(group: np.ndarray, fp: np.ndarray, limit: int, label: np.ndarray | None = None, at_once: int = FRONT // 4) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i < j) of rows of one group whose fingerprints differ in at most limit bits, some queries at a time.

    Rows must be sorted by group and Gray rank. One tree for each group, all of the same height, built bottom up. With
    label, nodes whose members all bear the query's own label are left too; the caller may change it between yields.
    """
    n = len(fp)
    bound = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    sizes = np.diff(np.append(bound, n))
    ones, zeros, owner = fp, ~fp, np.repeat(np.arange(len(bound)), sizes)
    shared, spans = [(ones | zeros, ones)], []
    while len(owner) > len(bound):
        first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        within = np.arange(len(owner)) - np.repeat(first, np.diff(np.append(first, len(owner))))
        cut = np.flatnonzero(within % FANOUT == 0)
        spans.append(np.append(cut, len(owner)))
        ones, zeros, owner = np.bitwise_and.reduceat(ones, cut), np.bitwise_and.reduceat(zeros, cut), owner[cut]
        shared.append((ones | zeros, ones))
    # a node's own bits: those its members share, less those that its parent holds
    held = [(mask & ~(np.repeat(shared[k + 1][0], np.diff(spans[k])) if k < len(spans) else np.uint64(0)), pattern) for k, (mask, pattern) in enumerate(shared)]
    ends = [np.arange(n)]  # the last row under each node, to leave nodes that lie wholly before the query
    for cut in spans:
        ends.append(ends[-1][cut[1:] - 1])
    root = np.repeat(np.arange(len(bound)), sizes)
    for q0 in range(0, n, at_once):
        if label is not None:
            lows, highs = [label], [label]
            for cut in spans:
                lows.append(np.minimum.reduceat(lows[-1], cut[:-1]))
                highs.append(np.maximum.reduceat(highs[-1], cut[:-1]))
        query = np.arange(q0, min(n, q0 + at_once))
        stack = [(len(shared) - 1, query, root[query], np.zeros(len(query), dtype=np.uint8))]
        left, right = [], []
        while stack:
            k, q, v, seen = stack.pop()
            if len(q) > FRONT:
                half = len(q) // 2
                stack += [(k, q[:half], v[:half], seen[:half]), (k, q[half:], v[half:], seen[half:])]
                continue
            own, pattern = held[k]
            seen = seen + np.bitwise_count((fp[q] ^ pattern[v]) & own[v])
            go = (seen <= limit) & (ends[k][v] > q)
            if label is not None:
                go &= (lows[k][v] != label[q]) | (highs[k][v] != label[q])
            q, v, seen = q[go], v[go], seen[go]
            if not len(q):
                continue
            if k == 0:
                left.append(q)
                right.append(v)
                continue
            low, size = spans[k - 1][v], spans[k - 1][v + 1] - spans[k - 1][v]
            at = np.repeat(np.arange(len(q)), size)
            step = np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size)
            stack.append((k - 1, q[at], low[at] + step, seen[at]))
        if left:
            yield np.concatenate(left), np.concatenate(right)


def links(group: np.ndarray, fp: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs that rising finds."""
    found = list(rising(group, fp, limit))
    none = np.empty(0, dtype=np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (none, none)


def connected(group: np.ndarray, fp: np.ndarray, limit: int) -> np.ndarray:
    """A label for each row that rows linked within their group share; rows sorted by group and Gray rank.

    Neighbours in the Gray order of turned fingerprints are linked first, so that crowds of like fingerprints are one
    label before the search, which then leaves whole nodes of that label.
    """
    i, j = [], []
    for turn in (0, 16, 32, 48):
        turned = fp if not turn else fp << np.uint64(turn) | fp >> np.uint64(64 - turn)
        order = np.lexsort((gray_rank(turned), group))
        a, b = order[:-1], order[1:]
        near = (group[a] == group[b]) & (np.bitwise_count(fp[a] ^ fp[b]) <= limit)
        i.append(a[near])
        j.append(b[near])
    label = forest(len(fp), np.concatenate(i), np.concatenate(j))
    for q, v in rising(group, fp, limit, label, CROWD):
        label[:] = forest(len(fp), label[q], label[v])[label]
    return label


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest row that each of n rows is connected with."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def blocks_of(bits: tuple[int, ...], count: int) -> list[tuple[int, ...]]:
    """bits in count runs of nearly equal length."""
    cut = np.linspace(0, len(bits), count + 1).astype(int)
    return [bits[a:b] for a, b in zip(cut, cut[1:], strict=False)]


def mask_of(bits: tuple[int, ...]) -> int:
    """The bits as a signed 64-bit mask."""
    m = sum(1 << b for b in bits)
    return m - (1 << 64) if m >= 1 << 63 else m


def choices(free: tuple[int, ...], limit: int, keep: int) -> list[tuple[int, ...]]:
    """The bits that some pair within the limit surely agrees on: keep of limit + keep blocks, in every choice."""
    parts = blocks_of(free, limit + keep)
    return [tuple(b for part in c for b in part) for c in combinations(parts, keep)]


def routed(nodes: DataFrame, limit: int, keep: int) -> DataFrame:
    """(key, fp, node): a row for every group a node belongs to; key is a hash of the family, the choice and its bits.

    Groups larger than LARGE are split by blocks of their free bits, up to SPLITS times: a pair that agrees on a
    group's bits and differs in at most limit others agrees on one of the finer choices as well.
    """
    ready, fixed = None, [()]
    here = nodes.select("family", "fp", "node", F.lit(0).alias("way"))
    for depth in range(SPLITS):
        spread, finer = [], []
        for w, bits in enumerate(fixed):
            free = tuple(b for b in range(64) if b not in bits)
            for more in choices(free, limit, keep if depth == 0 else 1):
                spread.append((w, len(finer), mask_of((*bits, *more))))
                finer.append((*bits, *more))
        fixed = finer
        steps = F.array(*[F.struct(F.lit(w).alias("from"), F.lit(k).alias("to"), F.lit(m).cast("long").alias("mask")) for w, k, m in spread])
        own = steps if depth == 0 else F.filter(steps, lambda x: x["from"] == F.col("way"))
        here = here.withColumn("s", F.explode(own)).select("family", "fp", "node", F.col("s.to").alias("way"), F.xxhash64("family", "s.to", F.col("fp").bitwiseAND(F.col("s.mask"))).alias("key"))
        large = None
        if depth < SPLITS - 1:
            large = written(here.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > LARGE).select("key"))
            if large.isEmpty():
                large = None
        done = (here if large is None else here.join(large, "key", "left_anti")).select("key", "fp", "node")
        ready = done if ready is None else ready.unionByName(done)
        if large is None:
            return ready
        here = here.join(large, "key", "left_semi").drop("key")
    return ready


def edges(nodes: DataFrame, limit: int = LIMIT, keep: int = 1) -> DataFrame:
    """(a, b): a spanning forest of the links between nodes; a links to the smallest node of its group's component.

    nodes: family, fp (distinct in a family), node. Links hold within a family. keep: blocks that a group agrees on.
    """
    # groups of one task lie side by side; a key shared by two groups of a family costs time, no result
    rows = routed(nodes, limit, keep).repartition("key").sortWithinPartitions("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        waiting = 0

        def solve(parts: list[list[np.ndarray]]) -> pa.RecordBatch:
            key, fp, node = (np.concatenate(x) for x in zip(*parts, strict=True))
            same = key[1:] == key[:-1]
            some = np.concatenate((same, [False])) | np.concatenate(([False], same))
            key, fp, node = key[some], fp[some].view(np.uint64), node[some]
            order = np.lexsort((gray_rank(fp), key))
            key, fp, node = key[order], fp[order], node[order]
            label = connected(key, fp, limit) if len(fp) else np.empty(0, dtype=np.int64)
            least = np.full(len(node), np.iinfo(np.int64).max)
            np.minimum.at(least, label, node)
            far = least[label] != node
            return pa.RecordBatch.from_arrays([pa.array(node[far]), pa.array(least[label][far])], names=["a", "b"])

        for b in batches:
            cols = [b.column(k).to_numpy(zero_copy_only=False) for k in range(3)]
            if not len(cols[0]):
                continue
            cut = int(np.searchsorted(cols[0], cols[0][-1], side="left"))
            if cut and waiting + cut >= AT_ONCE:
                yield solve([*held, [c[:cut] for c in cols]])
                held, waiting, cols = [], 0, [c[cut:] for c in cols]
            held.append(cols)
            waiting += len(cols[0])
        if held:
            yield solve(held)

    found = rows.mapInArrow(run, "a long, b long").distinct()
    return drawn_in(drawn_in(found))


def drawn_in(links_: DataFrame) -> DataFrame:
    """Fewer links (a > b) that connect the same: a keeps its smallest b, to which its other ends are linked instead.

    A node has as many links as it has groups at most, so no window grows with the data.
    """
    seen = links_.withColumn("m", F.min("b").over(Window.partitionBy("a")))
    return seen.select("a", F.col("m").alias("b")).union(seen.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")).distinct()


def fanned_out(links_: DataFrame) -> DataFrame:
    """Links (a, b) that connect the same, with FAN links to a node for each that had many: its others hang on those.

    The ends a of each b are dealt into FAN parts by a hash; the smallest of a part stands for it.
    """
    dealt = links_.withColumn("part", F.pmod(F.xxhash64("a", F.lit(1)), F.lit(FAN)))
    head = dealt.groupBy("b", "part").agg(F.min("a").alias("head"))
    hung = dealt.join(head, ["b", "part"]).filter("a <> head").select("a", F.col("head").alias("b"))
    return hung.union(head.select(F.col("head").alias("a"), "b"))


def components(links_: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of the edges (a, b).

    Each round links every node to the smallest label among its neighbours and jumps to that label's own label; the
    number of rounds grows with the logarithm of the longest path. Each round is a written table. The centre of a star
    hands its label on by way of FAN others, and a label that many nodes have is looked up in FAN parts, so
    neither lies in one task.
    """
    links_ = fanned_out(links_.select("a", "b"))
    both = written(links_.union(links_.select(F.col("b"), F.col("a"))).distinct())
    label = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label"))
    label = written(label)
    parts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(FAN - 1).cast("long"))).alias("part")
    while True:
        near = both.join(label.select(F.col("node").alias("b"), F.col("label").alias("l")), "b").groupBy(F.col("a").alias("node")).agg(F.min("l").alias("l"))
        low = label.join(near, "node").select("node", "label", F.least("label", "l").alias("new"))
        # the old label hears of it too, so that whole trees move at once
        told = low.groupBy(F.col("label").alias("node")).agg(F.min("new").alias("t"))
        low = low.join(told, "node", "left").select("node", "label", F.least("new", F.coalesce("t", "new")).alias("new"))
        # labels that have moved themselves; most have not
        far = low.select("new").distinct().join(low.filter("new <> node").select(F.col("node").alias("new"), F.col("new").alias("far")), "new").select("new", "far", parts)
        jumped = low.withColumn("part", F.pmod(F.xxhash64("node"), F.lit(FAN)).cast("long")).join(far, ["new", "part"], "left")
        moved = written(jumped.select("node", F.least("new", F.coalesce("far", "new")).alias("label"), (F.least("new", F.coalesce("far", "new")) < F.col("label")).alias("moved")))
        label = moved.select("node", "label")
        if moved.filter("moved").isEmpty():
            return label.select("node", F.col("label").alias("component"))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, families: int = 1, limit: int = LIMIT, keep: int = 1) -> DataFrame:
    """(id, fingerprint, component): one row for each document; component is the smallest id reachable by links.

    Documents link if the fingerprints of any one family differ in at most limit bits. fingerprint: 16 hex digits of the
    first family's. Null and empty texts have fingerprint 0 and link like others. Equal fingerprints are one node, so
    copies cost no pairs. Rows with a null id get no component; repeated ids count as one document.
    """
    made = written(fingerprints(docs, id_col, text_col, words, families))
    each = made.filter("id is not null").select(F.col("id").cast("long").alias("id"), F.posexplode("fp").alias("family", "fp"))
    nodes = written(each.groupBy("family", "fp").agg(F.min("id").alias("node")))
    found = edges(nodes, limit, keep)
    if families > 1:
        # a document ties its fingerprints of different families together
        own = each.join(nodes, ["family", "fp"]).select(F.col("id").alias("a"), F.col("node").alias("b")).filter("a <> b").distinct()
        found = found.union(own)
    joined = components(found)
    first = made.select("id", F.element_at("fp", 1).alias("fp")).join(nodes.filter("family = 0").select("fp", "node"), "fp", "left")
    out = first.join(joined, "node", "left").select("id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(F.col("id").isNotNull(), F.coalesce("component", "node")).alias("component_id"))
    return out.withColumnRenamed("id", id_col)


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of docs whose id is the smallest of its class, and those without an id. how: as for classes.

    Rows that share an id stay or go together.
    """
    dropped = classes(docs, id_col, text_col, **how).filter(F.col("component_id") != F.col(id_col)).select(F.col(id_col).alias("gone")).distinct()
    return docs.alias("d").join(written(dropped).alias("x"), F.col(f"d.{id_col}") == F.col("x.gone"), "left_anti")
