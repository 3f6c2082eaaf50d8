"""Search over a passage table: dense and BM25 legs, fusion, reranking, selection, neighbours.

All take a table of queries, so any number of questions is one job. Filters are applied inside each leg, before its
limit. Every ranking is a total order: score, then id.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.functions import text as T
from fathomline.settings import DEFAULT, Settings

#: Queries of one block, which travel to the tasks in a closure (512 x 64 doubles are 256 KB); more blocks, more passes.
QUERY_BLOCK = 512


def ranked(df: DataFrame, by: str, score: str, id_col: str, limit: int, rank: str = "rank") -> DataFrame:
    """The best rows of each query by score, then id, numbered from 1."""
    order = Window.partitionBy(by).orderBy(F.desc(score), id_col)
    return df.withColumn(rank, F.row_number().over(order).cast("long")).filter(F.col(rank) <= limit)


def dense_top(vectors: DataFrame, queries: DataFrame, limit: int = DEFAULT.leg_limit, where: Column | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, id, score, rank): each query's nearest rows by cosine of unit vectors, its own row left out.

    queries: query_id, vector. Each task multiplies its vectors with a block of queries and keeps the best of each, so
    the shuffle carries limit rows for a query and task. where narrows the corpus before the limit. Scores are rounded
    to six places, and the rounded score ranks. Vectors meet those of their own length; null ones, and ones with a null or
    NaN component, take no part on either side.
    """
    told = lambda c: F.coalesce(~F.exists(F.col(c), lambda x: x.isNull() | F.isnan(x)), F.lit(False))
    corpus = (vectors if where is None else vectors.filter(where)).select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).filter(told("v"))
    queries = queries.select("query_id", F.col("vector").cast("array<double>").alias("vector")).filter(told("vector") & (F.size("vector") > 0))
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    found = None
    for k in range(blocks):
        rows = queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == k).collect()
        for width in sorted({len(r["vector"]) for r in rows}):
            part = _dense_block(corpus, [r for r in rows if len(r["vector"]) == width], width, limit)
            found = part if found is None else found.unionByName(part)
    if found is None:
        found = corpus.sparkSession.createDataFrame([], "query_id long, id long, score double")
    return ranked(found, "query_id", "score", "id", limit)


def _dense_block(corpus: DataFrame, rows: list, width: int, limit: int) -> DataFrame:
    """(query_id, id, score): each task's best rows for a block of queries of one length."""
    q_ids, q = np.array([r["query_id"] for r in rows]), np.array([r["vector"] for r in rows], dtype=float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best_ids, best = np.empty((len(q), 0), dtype=np.int64), np.empty((len(q), 0))
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            v = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
            score = np.round(q @ v.T, 6) + 0.0
            score[q_ids[:, None] == ids[None, :]] = -np.inf
            all_ids, every = np.hstack([best_ids, np.broadcast_to(ids, score.shape)]), np.hstack([best, score])
            order = np.lexsort((all_ids, -every), axis=1)[:, :limit]
            best_ids, best = np.take_along_axis(all_ids, order, 1), np.take_along_axis(every, order, 1)
        keep = np.isfinite(best)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q_ids, keep.sum(1)).astype(np.int64)), pa.array(best_ids[keep]), pa.array(best[keep])], names=["query_id", "id", "score"])

    return corpus.filter(F.size("v") == width).mapInArrow(run, "query_id long, id long, score double")


def term_statistics(docs: DataFrame, terms: set[str]) -> tuple[int, float, dict[str, int]]:
    """The number of documents, their mean length in words, and how many hold each of the given terms.

    docs: w, a document's words. Tasks count for themselves, so the shuffle carries a row for each term and task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        n = length = 0
        for b in batches:
            for at in range(0, b.num_rows, 256):
                for w in b.column(0).slice(at, 256).to_pylist():
                    n, length = n + 1, length + len(w)
                    seen.update(terms.intersection(w))
        rows = [("d", t, k) for t, k in seen.items()] + [("n", "", n), ("l", "", length)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["kind", "term", "n"])

    found = {(r["kind"], r["term"]): r["n"] for r in docs.select("w").mapInArrow(run, "kind string, term string, n long").groupBy("kind", "term").agg(F.sum("n").alias("n")).collect()}
    n = found.get(("n", ""), 0)
    return n, found.get(("l", ""), 0) / max(n, 1) or 1.0, {t: k for (kind, t), k in found.items() if kind == "d"}


def bm25_top(docs: DataFrame, queries: DataFrame, limit: int = DEFAULT.leg_limit, where: Column | None = None, id_col: str = "doc_id", text_col: str = "text", settings: Settings = DEFAULT) -> DataFrame:
    """(query_id, id, score, rank): each query's best documents by BM25 over its distinct terms, each of weight 1.

    queries: query_id, text. Each task scores its documents against a block of queries and keeps the best of each, so
    no row is made for a pair of query and document, and the shuffle carries limit rows for a query and task. where
    narrows what is ranked; term statistics are those of the whole table.
    """
    k1, b1 = settings.bm25_k1, settings.bm25_b
    tokens = docs.select(F.col(id_col).cast("long").alias("id"), T.words(F.coalesce(F.col(text_col), F.lit(""))).alias("w"), (F.lit(True) if where is None else F.coalesce(where, F.lit(False))).alias("fits"))
    asked = queries.select("query_id", F.array_distinct(T.words(F.col("text"))).alias("terms"))
    blocks, found = max(1, -(-queries.count() // QUERY_BLOCK)), None
    for k in range(blocks):
        rows = asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == k).collect()
        number = {t: j for j, t in enumerate(sorted({t for r in rows for t in r["terms"]}))}
        if not number:
            continue
        n, mean, df = term_statistics(tokens, set(number))
        idf = np.array([np.log(1 + (n - df.get(t, 0) + 0.5) / (df.get(t, 0) + 0.5)) for t in number])
        q_ids = np.array([r["query_id"] for r in rows], dtype=np.int64)
        pairs = np.array(sorted((number[t], q) for q, r in enumerate(rows) for t in r["terms"]), dtype=np.int64)
        begin, of_query = np.searchsorted(pairs[:, 0], np.arange(len(number) + 1)), pairs[:, 1]

        def run(batches: Iterator[pa.RecordBatch], number: dict = number, idf: np.ndarray = idf, begin: np.ndarray = begin, of_query: np.ndarray = of_query, q_ids: np.ndarray = q_ids, mean: float = mean) -> Iterator[pa.RecordBatch]:
            best_ids, best = np.empty((len(q_ids), 0), dtype=np.int64), np.empty((len(q_ids), 0))
            for b in batches:
                every_id = b.column(0).to_numpy(zero_copy_only=False)
                for at in range(0, b.num_rows, 256):
                    ids, words = every_id[at : at + 256], b.column(1).slice(at, 256).to_pylist()
                    counts = [Counter(x for x in map(number.get, w) if x is not None) for w in words]
                    doc = np.repeat(np.arange(len(ids)), [len(c) for c in counts])
                    term = np.array([t for c in counts for t in c], dtype=np.int64)
                    tf = np.array([f for c in counts for f in c.values()], dtype=float)
                    length = np.array([len(w) for w in words], dtype=float)
                    weight = idf[term] * tf * (k1 + 1) / (tf + k1 * (1 - b1 + b1 * length[doc] / mean))
                    each = begin[term + 1] - begin[term]
                    place = np.repeat(begin[term], each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
                    cell = of_query[place] * len(ids) + np.repeat(doc, each)
                    score = np.round(np.bincount(cell, np.repeat(weight, each), len(q_ids) * len(ids)).reshape(len(q_ids), len(ids)), 6)
                    score[score <= 0] = -np.inf
                    both_ids, both = np.hstack([best_ids, np.broadcast_to(ids, score.shape)]), np.hstack([best, score])
                    order = np.lexsort((both_ids, -both), axis=1)[:, :limit]
                    best_ids, best = np.take_along_axis(both_ids, order, 1), np.take_along_axis(both, order, 1)
            keep = np.isfinite(best)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q_ids, keep.sum(1)).astype(np.int64)), pa.array(best_ids[keep]), pa.array(best[keep])], names=["query_id", "id", "score"])

        part = tokens.filter("fits").select("id", "w").mapInArrow(run, "query_id long, id long, score double")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = docs.sparkSession.createDataFrame([], "query_id long, id long, score double")
    return ranked(found, "query_id", "score", "id", limit)


def fuse(legs: list[DataFrame], limit: int = DEFAULT.fused_limit, k: int = DEFAULT.rrf_k) -> DataFrame:
    """(query_id, id, score, best_rank, rank): reciprocal rank fusion, ranks counted from 0 in the sum.

    legs: query_id, id, rank from 1. Order: score, best rank, id.
    """
    every = None
    for leg in legs:
        part = leg.select("query_id", "id", (F.col("rank") - 1).alias("r"))
        every = part if every is None else every.unionByName(part)
    fused = every.groupBy("query_id", "id").agg(F.round(F.sum(1.0 / (k + F.col("r"))), 9).alias("score"), F.min("r").cast("long").alias("best_rank"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "best_rank", "id")
    return fused.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= limit)


def leg_ranks(fused: DataFrame, dense: DataFrame, sparse: DataFrame) -> DataFrame:
    """fused with dense_rank and sparse_rank (from 1; null where a leg did not find the row)."""
    for name, leg in (("dense_rank", dense), ("sparse_rank", sparse)):
        fused = fused.join(leg.groupBy("query_id", "id").agg(F.min("rank").alias(name)), ["query_id", "id"], "left")
    return fused


def rerank(candidates: DataFrame, logit: Column, settings: Settings = DEFAULT) -> DataFrame:
    """candidates (query_id, id, score, rank) that may be reranked, with rerank score and rerank_rank.

    logit: an injected scorer's Column. Order: rerank score, retrieval score, id.
    """
    scored = candidates.filter(F.col("rank") <= settings.rerank_limit).withColumn("rerank", F.round(T.sigmoid(logit), 6))
    order = Window.partitionBy("query_id").orderBy(F.desc("rerank"), F.desc("score"), "id")
    return scored.withColumn("rerank_rank", F.row_number().over(order).cast("long"))


def kept_above(scored: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """The first rerank_top_k rows of each query at or above the floor; weak is false.

    Where none is, the best fallback rows, flagged weak.
    """
    w = Window.partitionBy("query_id")
    good = F.col("rerank") >= settings.rerank_min_score
    flagged = scored.withColumn("any_good", F.max(good).over(w)).withColumn("place", F.row_number().over(w.orderBy(F.col("rerank_rank"))))
    keep = F.when(F.col("any_good"), good & (F.col("place") <= settings.rerank_top_k)).otherwise(F.col("place") <= settings.fallback)
    return flagged.filter(keep).withColumn("weak", ~F.col("any_good")).drop("any_good", "place")


def relative_cut(scored: DataFrame, kept: DataFrame, floor: float) -> DataFrame:
    """kept without rows that stand too little above the median of all scored rows, relative to the best.

    The first two of a query stay; nothing is cut where two or fewer are kept or best and median (nearly) coincide.
    """
    if floor <= 0:
        return kept
    level = scored.groupBy("query_id").agg(F.percentile("rerank", F.lit(0.5)).alias("median"), F.max("rerank").alias("top"))
    w = Window.partitionBy("query_id")
    placed = kept.join(level, "query_id").withColumn("place", F.row_number().over(w.orderBy("rerank_rank"))).withColumn("n", F.count(F.lit(1)).over(w))
    spread = F.col("top") - F.col("median")
    fine = (F.col("place") <= 2) | (F.col("n") <= 2) | (spread <= 1e-9) | ((F.col("rerank") - F.col("median")) / spread >= floor)
    return placed.filter(fine).drop("median", "top", "place", "n")


def recency_order(kept: DataFrame, weight: float, dated: str = "uploaded_at", days: int = DEFAULT.recency_days) -> DataFrame:
    """kept with recency_rank: scores lifted by age against the newest kept row; undated rows by nothing.

    Fewer than two dated rows in a query leave its order as it is.
    """
    w = Window.partitionBy("query_id")
    age = (F.max(dated).over(w) - F.col(dated)) / (days * 86400.0)
    boost = F.when(F.count(dated).over(w) >= 2, F.coalesce(weight * F.greatest(F.lit(0.0), 1 - age), F.lit(0.0))).otherwise(F.lit(0.0))
    return kept.withColumn("boosted", F.round(F.col("rerank") + boost, 6)).withColumn("recency_rank", F.row_number().over(w.orderBy(F.desc("boosted"), "rerank_rank")).cast("long"))


def shingles(text: Column, n: int = 3) -> Column:
    """The distinct word n-grams of a text; a shorter text is one shingle, an empty one has none."""

    def of(w: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (n - 1), F.lit(1))), lambda k: F.concat_ws(" ", F.slice(w, k, n)))
        return F.when(F.size(w) > 0, F.array_distinct(cut)).otherwise(F.array().cast("array<string>"))

    # bound as a variable, or each shingle would cut the text into words again
    return F.transform(F.array(T.words(text)), of)[0]


def jaccard(a: Column, b: Column) -> Column:
    """The share of common elements of two arrays; two empty ones: 0."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def diverse(scored: DataFrame, settings: Settings = DEFAULT, drop_neighbours: bool = False) -> DataFrame:
    """The first rerank_top_k eligible rows of each query of which none nearly repeats one kept before.

    scored: query_id, id, filename, ordinal, rerank, rerank_rank, text. At most rerank_limit rows a query, so the walk
    runs as one fold over a query's array; a drop is refilled from below.
    """
    s = scored.filter(F.col("rerank") >= settings.rerank_min_score).withColumn("shingles", shingles(F.col("text")))
    row = F.struct("rerank_rank", "id", "filename", F.col("ordinal").cast("long").alias("ordinal"), "shingles")
    lists = s.groupBy("query_id").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    kind = lists.schema["rows"].dataType.simpleString()

    def step(kept: Column, r: Column) -> Column:
        def close(k: Column) -> Column:
            alike = jaccard(k["shingles"], r["shingles"]) >= settings.diversity
            if not drop_neighbours:
                return alike
            return alike | ((k["filename"] == r["filename"]) & (F.abs(k["ordinal"] - r["ordinal"]) <= settings.neighbour_radius))

        return F.when((F.size(kept) >= settings.rerank_top_k) | F.exists(kept, close), kept).otherwise(F.array_append(kept, r))

    kept = lists.select("query_id", F.aggregate("rows", F.array().cast(kind), step).alias("kept"))
    picked = kept.select("query_id", F.posexplode("kept").alias("place", "k")).select("query_id", F.col("k.id").alias("id"), (F.col("place") + 1).alias("kept_rank"))
    return picked.join(scored, ["query_id", "id"])


def neighbours(kept: DataFrame, chunks: DataFrame, radius: int = DEFAULT.neighbour_radius) -> DataFrame:
    """(query_id, filename, ordinal, neighbour, kept_rank): passages beside kept ones, each given to the best-ranked.

    The range join is an equi-join on every ordinal within the radius. Kept passages are nobody's neighbours.
    """
    near = kept.withColumn("neighbour", F.explode(F.sequence(F.col("ordinal") - radius, F.col("ordinal") + radius))).filter("neighbour >= 1 and neighbour <> ordinal")
    own = kept.select("query_id", "filename", F.col("ordinal").alias("neighbour"))
    free = near.join(own, ["query_id", "filename", "neighbour"], "left_anti")
    there = free.join(chunks.select("filename", F.col("ordinal").alias("neighbour"), F.col("text").alias("neighbour_text")), ["filename", "neighbour"])
    first = F.row_number().over(Window.partitionBy("query_id", "filename", "neighbour").orderBy("kept_rank"))
    return there.withColumn("n", first).filter("n = 1").drop("n")


def scope(filenames: list[str] | None = None, tags: list[str] | None = None, page_min: int | None = None, page_max: int | None = None, section: str | None = None, chunk_ids: list[str] | None = None, exclude_filenames: list[str] | None = None, exclude_chunk_ids: list[str] | None = None, uploaded_after: float | None = None, uploaded_before: float | None = None) -> Column:
    """A passage filter. Bounds are inclusive; a missing value fails a demand and passes an exclusion."""
    if page_min is not None and page_max is not None and page_min > page_max:
        raise ValueError("page_min exceeds page_max")
    c, tests = F.col, [F.lit(True)]
    if filenames is not None:
        tests.append(c("filename").isin(filenames))
    if tags is not None:
        tests.append(F.arrays_overlap("tags", F.array(*map(F.lit, tags))))
    if page_max is not None:
        tests.append(c("page") <= page_max)
    if page_min is not None:
        tests.append((c("page") >= page_min) | F.coalesce(c("page_end") >= page_min, F.lit(False)))
    if uploaded_after is not None:
        tests.append(c("uploaded_at") >= uploaded_after)
    if uploaded_before is not None:
        tests.append(c("uploaded_at") <= uploaded_before)
    if section is not None:
        tests.append(c("section") == section)
    if chunk_ids is not None:
        tests.append(c("chunk_id").isin(chunk_ids))
    if exclude_filenames:
        tests.append(F.coalesce(~c("filename").isin(exclude_filenames), F.lit(True)))
    if exclude_chunk_ids:
        tests.append(F.coalesce(~c("chunk_id").isin(exclude_chunk_ids), F.lit(True)))
    out = tests[0]
    for t in tests[1:]:
        out = out & F.coalesce(t, F.lit(False))
    return out
