"""Passage tables: paragraphs, lines and rows as passages, their ids, and windows of sentences under a token budget."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathomline.functions import text as T
from fathomline.settings import DEFAULT, Settings


def paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", boundary: str = r"\n\s*\n") -> DataFrame:
    """(id, ordinal, section, text): a text's blocks between boundaries, blank ones dropped; the first line is the label."""
    parts = F.filter(F.split(T.normalize(F.coalesce(F.col(text_col), F.lit(""))), boundary), lambda p: p.rlike(r"\S"))
    out = docs.select(F.col(id_col), F.posexplode(parts).alias("pos", "body"))
    return out.select(id_col, (F.col("pos") + 1).alias("ordinal"), T.label(F.regexp_extract("body", r"^\s*([^\n]*)", 1)).alias("section"), "body").withColumnRenamed("body", text_col)


def line_passages(docs: DataFrame, page_lines: int = 20) -> DataFrame:
    """filename, page, section, text, ordinal of every line that isn't blank; a page has page_lines lines."""
    parts = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda p: p.rlike(r"\S"))
    out = docs.select(F.format_string("doc-%d.txt", "doc_id").alias("filename"), "source", "lang", F.sha2("text", 256).alias("sha"), F.size(parts).alias("total"), F.posexplode(parts).alias("pos", "text"))
    ordinal = F.col("pos") + 1
    return out.select("filename", F.floor(F.col("pos") / page_lines + 1).cast("long").alias("page"), T.label(F.col("source")).alias("section"), "text", ordinal.cast("long").alias("ordinal"), "lang", "source", "sha", F.col("total").cast("long").alias("total"))


def with_ids(chunks: DataFrame) -> DataFrame:
    """chunks with occurrence (identical passages of a page, from 0), chunk_id and point_id."""
    w = Window.partitionBy("filename", "page", "section", "text").orderBy("ordinal")
    out = chunks.withColumn("occurrence", (F.row_number().over(w) - 1).cast("long"))
    out = out.withColumn("chunk_id", T.chunk_id(F.col("filename"), F.col("page"), F.col("section"), F.col("text"), F.col("occurrence")))
    return out.withColumn("point_id", T.name_uuid(F.concat_ws(":", F.lit("passage"), "filename", F.col("page").cast("string"), "section", "chunk_id")))


def rendered_rows(df: DataFrame, key: str, columns: list[str], per_section: int = DEFAULT.rows_per_section) -> DataFrame:
    """(section_no, label, n_rows, text): rows as "name: value; …" lines, per_section rows a section, by a row number."""
    line = F.concat_ws("; ", *[F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}: "), F.col(c).cast("string"))) for c in columns])
    each = df.select(F.col(key).alias("row"), F.floor((F.col(key) - 1) / per_section).cast("long").alias("section_no"), line.alias("line"))
    rows = each.groupBy("section_no").agg(F.min("row").alias("first"), F.max("row").alias("last"), F.count(F.lit(1)).alias("n_rows"), F.sort_array(F.collect_list(F.struct("row", "line"))).alias("rows"))
    return rows.select("section_no", F.concat(F.lit("Rows "), F.col("first").cast("string"), F.lit("-"), F.col("last").cast("string")).alias("label"), "n_rows", F.array_join(F.transform("rows", lambda r: r["line"]), "\n").alias("text"))


#: Fixed value: where a text is cut into sentences (ends before a capital or digit, CJK ends, blank lines, table rows).
SENTENCE = re.compile(r"(?<=[.!?])\s+(?=[\"'(\[]?[A-Z0-9])|(?<=[。！？])\s*|\n{2,}|\n(?=\|)")
_CJK, _MARK = re.compile(T.CJK), re.compile(r"[^\w\s]")


def word_tokens(word: str) -> float:
    """A word's estimated tokens."""
    return max(T.WORD_TOKENS, len(_CJK.findall(word)) + len(_MARK.findall(word)) + sum(c.isdigit() for c in word) / 2)


def tokens(text: str) -> int:
    """A text's estimated tokens: what functions.text.heuristic_tokens tells of a column."""
    return -int(-round(sum(map(word_tokens, text.split())), 6) // 1)


def windows(units: list[tuple[str, int]], budget: int, overlap: int) -> Iterator[tuple[int, int]]:
    """(first, end) of each window: as many units as fit, at least one; the next goes back by at most overlap tokens.

    On running sums, a window's end and the next one's start are two binary searches.
    """
    sums = [0, *accumulate(n for _, n in units)]
    start, last = 0, len(units)
    while start < last:
        end = max(start + 1, bisect_right(sums, sums[start] + budget, start + 1) - 1)
        yield start, end
        start = last if end == last else bisect_left(sums, sums[end] - overlap, start + 1, end)


def pieces(sentence: str, budget: int) -> list[tuple[str, int]]:
    """A sentence within budget as it is; a longer one by words, words beyond the budget by characters."""
    n = tokens(sentence)
    if n <= budget:
        return [(sentence, n)]
    short = max(1, budget // 2)
    words = [x for w in sentence.split() for x in ([w] if tokens(w) <= budget else [w[k : k + short] for k in range(0, len(w), short)])]
    sized = [(w, tokens(w)) for w in words]
    return [(" ".join(words[a:e]), sum(n for _, n in sized[a:e])) for a, e in windows(sized, budget, 0)]


def chunks(docs: DataFrame, settings: Settings = DEFAULT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ordinal, n_tokens, text): windows of whole sentences under the token budget, with overlap.

    The walk over a document's sentences is sequential; documents are independent, so nothing is shuffled.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    prefix = 8
    budget = max(settings.chunk_size - prefix - 2, settings.chunk_size // 4)
    overlap = min(settings.chunk_overlap, budget // 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                units = [p for s in SENTENCE.split(text) if s and s.strip() for p in pieces(" ".join(s.split()), budget)]
                for n, (a, e) in enumerate(windows(units, budget, overlap), 1):
                    out.append((i, n, sum(t for _, t in units[a:e]), " ".join(u for u, _ in units[a:e])))
            cols = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["id", "ordinal", "n_tokens", "text"])

    return rows.mapInArrow(run, "id long, ordinal long, n_tokens long, text string").withColumnRenamed("id", id_col)
