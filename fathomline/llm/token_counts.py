"""Token counts: the exact histogram of encoded lengths, and what its suffix sums answer for every context limit."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathomline.llm.common import small_batches, written

#: Lengths of one block of the suffix sums: sums run inside blocks and over block totals, never over all lengths at once.
BLOCK = 1024


@lru_cache(maxsize=2)
def encoder(path: str):
    """A byte-level BPE encoder from a file of base64 tokens and ranks; special tokens' strings are ordinary text."""
    import base64

    import tiktoken
    from public_tokenizers import PATTERN

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def histogram(df: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """(n_tokens long, n_docs long): how many documents encode to each length.

    Every whole text counts; null or empty texts have length 0; an empty table gives no rows. Tasks count their own
    documents first, so the shuffle carries a row for each length and task.
    """
    rows = small_batches(df).select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[int] = Counter()
        for b in batches:
            encode = encoder(path).encode_ordinary
            seen.update(len(encode(x)) for x in b.column(0).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], names=["n_tokens", "n_docs"])

    return rows.mapInArrow(run, "n_tokens long, n_docs long").groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """Each length of a histogram as a context limit, with what the documents hold from it on and under it.

    n_tokens, n_docs, docs_at_least, tokens_at_least (of documents of this length or more), truncated_tokens (all
    documents cut to this many tokens), total_tokens, share_at_most (of the documents; the quantile of this length).
    """
    blocks = hist.withColumn("block", F.floor(F.col("n_tokens") / BLOCK))
    per_block = blocks.groupBy("block").agg(F.sum("n_docs").alias("bd"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("bt"))
    later = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0)
    per_block = per_block.select("block", F.coalesce(F.sum("bd").over(later), zero).alias("ld"), F.coalesce(F.sum("bt").over(later), zero).alias("lt"), F.sum("bd").over(whole).alias("docs"), F.sum("bt").over(whole).alias("total_tokens"))
    inside = Window.partitionBy("block").orderBy(F.desc("n_tokens"))
    out = blocks.join(per_block, "block").select(
        "n_tokens", "n_docs", "docs", "total_tokens",
        (F.col("ld") + F.sum("n_docs").over(inside)).alias("docs_at_least"),
        (F.col("lt") + F.sum(F.col("n_docs") * F.col("n_tokens")).over(inside)).alias("tokens_at_least"),
    )
    truncated = F.col("total_tokens") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least")
    share = (F.col("docs") - F.col("docs_at_least") + F.col("n_docs")) / F.col("docs")
    return out.select("n_tokens", "n_docs", "docs_at_least", "tokens_at_least", truncated.alias("truncated_tokens"), "total_tokens", share.alias("share_at_most"))


def at_limits(hist: DataFrame, limits: list[int]) -> DataFrame:
    """(context_limit, whole_docs, truncated_tokens, lost_tokens) for each given context limit."""
    asked = hist.sparkSession.createDataFrame([(int(x),) for x in limits], "context_limit long")
    cut = F.least("n_tokens", "context_limit") * F.col("n_docs")
    fits = F.when(F.col("n_tokens") <= F.col("context_limit"), F.col("n_docs")).otherwise(0)
    each = hist.withColumn("context_limit", F.explode(F.array(*[F.lit(int(x)).cast("long") for x in limits])))
    found = each.groupBy("context_limit").agg(F.sum(fits).alias("whole_docs"), F.sum(cut).alias("truncated_tokens"), F.sum(F.col("n_tokens") * F.col("n_docs") - cut).alias("lost_tokens"))
    return asked.join(found, "context_limit", "left").na.fill(0)


def quantiles(hist: DataFrame, shares: list[float]) -> DataFrame:
    """(share, n_tokens): the least length that at least this share of the documents does not exceed."""
    lengths = suffix_sums(hist).select("n_tokens", "share_at_most")
    return lengths.agg(*[F.min(F.when(F.col("share_at_most") >= s, F.col("n_tokens"))).alias(f"q{k}") for k, s in enumerate(shares)]).select(
        F.explode(F.array(*[F.struct(F.lit(float(s)).alias("share"), F.col(f"q{k}").alias("n_tokens")) for k, s in enumerate(shares)])).alias("x")
    ).select("x.*")


def report(docs: DataFrame, path: str) -> DataFrame:
    """The suffix sums of every length that a document of the table has."""
    return suffix_sums(written(histogram(docs, path)))
