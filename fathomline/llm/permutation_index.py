"""Approximate nearest neighbours by largest inner product, over a permutation index.

Each vector is represented by its nearest pivots in order. It is posted in the inverted files of the first few of
them; a query visits the files of more of its own. In a file, vectors are ranked by the footrule distance of their order
to the query's, and the nearest DEPTH are reranked by the exact inner product; the best of all visited files are the
result. The number of pivots grows with the square root of the number of vectors, so files grow no faster than that,
what a row costs to post is the same at every size, and a query reranks some hundred rows whatever the table's size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathomline.llm.common import written

#: Pivots: so many times the square root of the number of vectors, and the least number. They are drawn by a hash of the
#: vector (the only sample taken) and go to tasks with their code: a hundred million vectors have 20,000 pivots.
ROOTS, LEAST_PIVOTS = 2.0, 256
#: Pivots whose order represents a vector, at most; at most half of all where that are enough to visit.
NEAREST = 128
#: Files that a vector is posted in, files that a query visits, rows that it reranks in each.
POSTED, VISITED, DEPTH = 6, 48, 128
#: Vectors of a file; a longer file is split, and queries visit all its parts.
FILE = 1 << 15
#: Results of a query.
K = 20


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v array<double>) of the vectors that take part: no null, none null or non-finite inside, not zero, of the commonest length."""
    v = F.col("v")
    fine = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).filter(
        F.col("id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    )
    length = fine.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1)
    return fine.join(F.broadcast(length.select("n")), F.size("v") == F.col("n")).select("id", "v")


def augmented(x: np.ndarray, norm: float) -> np.ndarray:
    """Vectors with one more component that gives all of them the greatest norm, so that near means a large product."""
    rest = np.sqrt(np.maximum(0.0, norm * norm - np.einsum("ij,ij->i", x, x)))
    return np.hstack([x, rest[:, None]])


def orders(x: np.ndarray, pivots: np.ndarray, nearest: int) -> np.ndarray:
    """The nearest pivots of each vector, nearest first; ties by pivot number. Some vectors at a time."""
    step = max(1, (1 << 22) // max(1, len(pivots)))
    parts = [np.argsort(-(x[k : k + step] @ pivots.T), axis=1, kind="stable")[:, :nearest].astype("<u2") for k in range(0, len(x), step)]
    return np.concatenate(parts) if parts else np.empty((0, nearest), "<u2")


def exact(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products, each summed in the same order, so that equal vectors get equal scores."""
    return (x * q).sum(axis=1)


def places(own: np.ndarray, pivots: int, width: int) -> np.ndarray:
    """The place of each pivot in an order; width for those that are not in it."""
    out = np.full(pivots, width, dtype=np.int32)
    out[own] = np.arange(len(own))
    return out


def footrule(order: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The footrule distance of each order to a query's places, up to a constant and by halves.

    A pivot in both orders, at i and j, brings them nearer by width - max(i, j) than one that is in neither.
    """
    width = order.shape[1]
    return np.maximum(place[order], np.arange(width, dtype=np.int32)).sum(axis=1, dtype=np.int64)


def best_of(ids: np.ndarray, x: np.ndarray, order: np.ndarray, q: np.ndarray, own: np.ndarray, pivots: int, k: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, scores) of the k best of a file's rows for one query: by footrule, then by inner product, ties to smaller ids."""
    n = len(ids)
    cut = np.argpartition(footrule(order, places(own, pivots, order.shape[1])), depth - 1)[:depth] if depth < n else np.arange(n)
    score = exact(x[cut], q)
    best = np.lexsort((ids[cut], -score))[:k]
    return ids[cut][best], score[best]


def build(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K) -> tuple[DataFrame, dict]:
    """(pivot, part, id, vector, order) postings, and the index's facts: pivots, width, parts of each file.

    Of equal vectors the k + 1 smallest ids are posted: no result can hold others. All distinct vectors are in it.
    """
    among = Window.partitionBy("v").orderBy("id")
    rows = written(usable(df, id_col, vector_col).withColumn("copy", F.row_number().over(among)).filter(F.col("copy") <= k + 1))
    apart = rows.filter("copy = 1")
    facts = apart.agg(F.count(F.lit(1)).alias("n"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).alias("norm"), F.max(F.size("v")).alias("dim")).first()
    n, norm = facts["n"], facts["norm"] or 1.0
    drawn = apart.orderBy(F.xxhash64("v", F.lit(5)), "id").limit(max(LEAST_PIVOTS, math.ceil(ROOTS * math.sqrt(n)))).collect() if n else []
    chosen = augmented(np.array([r["v"] for r in drawn], dtype=float), norm) if drawn else np.zeros((0, 1))
    width = min(NEAREST, max(VISITED, len(chosen) // 2), max(1, len(chosen)))  # few pivots: a query visits all files
    single = isinstance(df.schema[vector_col].dataType.elementType, T.FloatType)
    facts = {"n": n, "pivots": chosen, "width": width, "dim": facts["dim"] or 0, "kind": "<f4" if single else "<f8"}

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, x = b.column(0).to_numpy(), rows_of(b.column(1), facts["dim"])
            order = orders(augmented(x, norm), chosen, width)
            first = order[:, :POSTED]
            at = np.repeat(np.arange(len(ids)), first.shape[1])
            packed = pa.array([v.tobytes() for v in x.astype(facts["kind"])], pa.binary()), pa.array([o.tobytes() for o in order], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(first.ravel().astype(np.int32)), pa.array(ids[at]), *(c.take(pa.array(at)) for c in packed)], names=["pivot", "id", "vector", "order"])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            order = orders(augmented(rows_of(b.column(0), facts["dim"]), norm), chosen, POSTED)
            yield pa.RecordBatch.from_arrays([pa.array(order.ravel().astype(np.int32))], names=["pivot"])

    sizes = rows.select("v").mapInArrow(first, "pivot int").groupBy("pivot").count().collect() if n else []
    facts["parts"] = {r["pivot"]: -(-r["count"] // FILE) for r in sizes}
    split = [F.lit(x) for kv in facts["parts"].items() if kv[1] > 1 for x in kv]
    part = F.pmod(F.xxhash64("id"), F.coalesce(F.create_map(*split)[F.col("pivot")], F.lit(1))).cast("int") if split else F.lit(0)
    posted = rows.select("id", "v").mapInArrow(post, "pivot int, id long, vector binary, order binary")
    return posted.select("pivot", part.alias("part"), "id", "vector", "order"), facts


def rows_of(column: pa.Array, dim: int) -> np.ndarray:
    """A column of lists of one length as a matrix."""
    return column.flatten().to_numpy().astype(float).reshape(-1, dim)


def search(index: DataFrame, facts: dict, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, depth: int = DEPTH) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest found, its own row left out; ties to the smaller id.

    Equal query vectors are searched once. Unusable queries, those of another length, and an empty index give no rows;
    repeated ids with other vectors are separate rows, all left out for a query of that id, and separate queries; equal
    rows are one. A query and a file give k + 1 rows at most.
    """
    width, dim, chosen, parts = facts["width"], facts["dim"], facts["pivots"], facts["parts"]
    asked = written(usable(queries, id_col, vector_col).filter(F.size("v") == dim).distinct())
    apart = asked.groupBy("v").agg(F.min("id").alias("q"))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, x = b.column(0).to_numpy(), rows_of(b.column(1), dim)
            order = orders(np.hstack([x, np.zeros((len(x), 1))]), chosen, width)
            goal = [(k, int(p), s) for k in range(len(ids)) for p in order[k, :VISITED] for s in range(parts.get(int(p), 0))]
            at = pa.array([k for k, *_ in goal], pa.int64())
            packed = pa.array([v.tobytes() for v in x], pa.binary()), pa.array([o.tobytes() for o in order], pa.binary())
            cols = [pa.array([p for _, p, _ in goal], pa.int32()), pa.array([s for *_, s in goal], pa.int32()), b.column(0).take(at), *(c.take(at) for c in packed)]
            yield pa.RecordBatch.from_arrays(cols, names=["pivot", "part", "id", "vector", "order"])

    visits = apart.select("q", "v").mapInArrow(visit, "pivot int, part int, id long, vector binary, order binary")
    both = index.withColumn("asks", F.lit(False)).unionByName(visits.withColumn("asks", F.lit(True)))
    # a file's rows come before the queries that visit it
    both = both.repartition("pivot", "part").sortWithinPartitions("pivot", "part", "asks").select("pivot", "part", "asks", "id", "vector", "order")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held, packed = None, [], None
        for b in batches:
            found: list[tuple] = []
            for pivot, part, asks, id_, vector, order in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (pivot, part) != here:
                    here, held, packed = (pivot, part), [], None
                if not asks:
                    held.append((id_, vector, order))
                elif held:
                    if packed is None:
                        ids, xs, os_ = zip(*held, strict=True)
                        packed = np.array(ids), np.frombuffer(b"".join(xs), facts["kind"]).astype(float).reshape(-1, dim), np.frombuffer(b"".join(os_), "<u2").reshape(-1, width)
                    ids, score = best_of(*packed, np.frombuffer(vector, "<f8"), np.frombuffer(order, "<u2"), len(chosen), k + 1, depth)
                    found.append((np.full(len(ids), id_), ids, score))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], names=["q", "vec_id", "score"])

    near = both.mapInArrow(run, "q long, vec_id long, score double").distinct()
    by_rank = Window.orderBy(F.desc("score"), "vec_id")
    found = near.withColumn("r", F.row_number().over(by_rank.partitionBy("q"))).filter(F.col("r") <= k + 1)
    of = asked.join(apart.withColumnRenamed("v", "w"), F.col("v") == F.col("w")).select(F.col("id").alias("query_id"), "q")
    out = of.join(found, "q").filter("vec_id <> query_id")
    return out.withColumn("rank", F.row_number().over(by_rank.partitionBy("query_id", "q"))).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def neighbours(vectors: DataFrame) -> DataFrame:
    """The nearest rows of every row whose id is divisible by 20."""
    index, facts = build(vectors)
    return search(index, facts, vectors.filter(F.col("vec_id") % 20 == 0))


def recall(found: DataFrame, vectors: DataFrame, k: int = K) -> float:
    """The share of brute force's results that found holds; for tests and tuning on tables that fit a driver."""
    rows = usable(vectors, "vec_id", "embedding").orderBy("id").collect()
    ids, x = np.array([r["id"] for r in rows]), np.array([r["v"] for r in rows])
    truth = {}
    for q in np.flatnonzero(ids % 20 == 0):
        score = exact(x, x[q])
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != ids[q]][:k]
        truth[int(ids[q])] = {int(ids[j]) for j in order}
    hit = sum(r["vec_id"] in truth[r["query_id"]] for r in found.collect())
    return hit / max(1, sum(map(len, truth.values())))
