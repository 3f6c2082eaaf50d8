"""The document catalogue and what is asked of it: duplicates, missing and orphaned documents, listings, label passages."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.functions import text as T
from fathomline.settings import DEFAULT, Settings

#: Characters of label passages up to which they travel in a closure; beyond that, more passes.
LABEL_CHARS = 8 << 20


def single(col: str) -> Column:
    """The one value that all rows of a group have, null included as a value; else null."""
    return F.when((F.count(col) == F.count(F.lit(1))) & (F.min(col) == F.max(col)), F.min(col))


def unless_missing(col: str) -> Column:
    """The least value of a group; null if any row lacks it."""
    return F.when(F.count(col) == F.count(F.lit(1)), F.min(col))


def catalogue(chunks: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """One row a document: counts, version, hash and total where all passages agree, tags, incomplete and stale flags.

    chunks: filename, page, chunker_version, content_sha256, document_chunks, tag. Aggregates combine before the shuffle.
    """
    several = lambda c: (F.min(c) != F.max(c)) | ((F.count(c) > 0) & (F.count(c) < F.count(F.lit(1))))
    out = chunks.groupBy("filename").agg(
        F.count(F.lit(1)).alias("chunk_count"), F.max("page").alias("page_count"), unless_missing("chunker_version").alias("chunker_version"),
        single("content_sha256").alias("content_sha256"), single("document_chunks").alias("document_chunks"), F.array_join(F.array_sort(F.collect_set("tag")), ",").alias("tags"),
        F.coalesce(several("content_sha256") | several("document_chunks"), F.lit(False)).alias("mixed"),
    )
    incomplete = F.col("mixed") | F.coalesce(F.col("document_chunks") != F.col("chunk_count"), F.lit(False))
    stale = F.col("chunker_version").isNull() | (F.col("chunker_version") < settings.chunker_version)
    return out.select("filename", "chunk_count", "page_count", "chunker_version", "content_sha256", "document_chunks", "tags", incomplete.alias("incomplete"), stale.alias("stale"))


def duplicates(docs: DataFrame, name: str, digest: str) -> DataFrame:
    """(digest, name, first_name, copies) of every document whose content another has too. No group is collected."""
    groups = docs.groupBy(digest).agg(F.count(F.lit(1)).alias("copies"), F.min(name).alias("first_name")).filter("copies > 1")
    return docs.join(groups, digest).select(digest, name, "first_name", "copies")


def missing(manifest: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows of a client's manifest (name, sha) that the catalogue lacks or holds with other content."""
    return manifest.join(stored, ["name", "sha"], "left_anti")


def consistency(stored: DataFrame, indexed: DataFrame, versions: DataFrame) -> DataFrame:
    """(kind, id): originals without passages, passages without originals, versions of neither. All by id."""
    only = lambda a, *rest: _anti(a, rest)
    found = [("not_indexed", only(stored, indexed)), ("no_original", only(indexed, stored)), ("orphan_version", only(versions, indexed, stored))]
    out = None
    for kind, rows in found:
        part = rows.select(F.lit(kind).alias("kind"), "id")
        out = part if out is None else out.unionByName(part)
    return out


def _anti(a: DataFrame, rest: tuple[DataFrame, ...]) -> DataFrame:
    for b in rest:
        a = a.join(b, "id", "left_anti")
    return a.distinct()


def listing(names: DataFrame, prefix: str, after: str, limit: int) -> DataFrame:
    """The next page of names with a prefix, and how many such names there are in all."""
    fits = names.filter(F.col("name").startswith(prefix))
    page = fits.filter(F.col("name") > after).orderBy("name").limit(limit)
    return page.crossJoin(F.broadcast(fits.agg(F.count(F.lit(1)).alias("total"))))  # one row


def outline(chunks: DataFrame) -> DataFrame:
    """The passages at which a document's page or section changes."""
    w = Window.partitionBy("filename").orderBy("ordinal")
    changed = ~(F.col("page").eqNullSafe(F.lag("page").over(w)) & F.col("section").eqNullSafe(F.lag("section").over(w)))
    return chunks.withColumn("starts", changed).filter("starts").select("filename", "ordinal", "page", "section")


def around(chunks: DataFrame, centre: Column, radius: int) -> DataFrame:
    """Each document's passages within radius of its centre ordinal."""
    return chunks.filter(F.col("ordinal").between(centre - radius, centre + radius))


def label_passages(docs: DataFrame, labels: DataFrame, exact: bool = False) -> DataFrame:
    """(item_id, doc_id): documents that contain a label's text, both lower-cased with white space collapsed, or exact as they are.

    docs: doc_id, text; labels: item_id, text. One scan of the documents finds all labels at once in an automaton;
    labels beyond a checked size take further scans.
    """
    whole = lambda c: F.coalesce(F.col(c), F.lit(""))
    flat = whole if exact else lambda c: F.lower(T.collapse(whole(c)))
    wanted = labels.select("item_id", flat("text").alias("t")).filter("t <> ''")
    size = wanted.agg(F.sum(F.char_length("t"))).first()[0] or 0
    passes = max(1, -(-size // LABEL_CHARS))
    rows = docs.select("doc_id", flat("text").alias("t"))
    out = None
    for k in range(passes):
        items: dict[str, list[int]] = {}
        for r in wanted.filter(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == k).collect():
            items.setdefault(r["t"], []).append(r["item_id"])

        def run(batches: Iterator[pa.RecordBatch], items: dict = items) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            machine = ahocorasick.Automaton()
            for t, ids in items.items():
                machine.add_word(t, tuple(ids))
            machine.make_automaton()
            for b in batches:
                pairs = []
                for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    pairs += [(item, i) for item in sorted({x for _, ids in machine.iter(t) for x in ids})] if items else []
                cols = list(zip(*pairs, strict=True)) or [[], []]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["item_id", "doc_id"])

        part = rows.mapInArrow(run, "item_id long, doc_id long")
        out = part if out is None else out.unionByName(part)
    return out


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def newest(df: DataFrame, keys: list[str], keep: int, *order: Column) -> DataFrame:
    """The first keep rows of each key; for retention."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_n") <= keep).drop("_n")


def upserted(stored: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """stored with all rows of incoming's keys replaced."""
    return stored.join(incoming.select(key).distinct(), key, "left_anti").unionByName(incoming, allowMissingColumns=True)
