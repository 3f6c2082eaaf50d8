"""Quality by an interpolated modified Kneser-Ney model over byte n-grams, trained on trusted text.

Tasks count the n-grams of their trusted documents; counts of one language meet in shards by the two bytes before the
last, so every context and every shorter n-gram of three bytes or more lies in one shard with its extensions. Documents
travel in compressed batches; a batch asks each shard once for each distinct n-gram it holds, the shards join
requests with counts and answer with log probabilities, and the batch adds them up. Perplexities above a quantile of
the language's held-out trusted documents are rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathomline.llm.common import bucketed, small_batches, written
from fathomline.llm.suffix_dedup import expand, mixed, squeeze

#: Bytes of an n-gram; what stands before and after a text.
ORDER, BEFORE, AFTER = 5, b"\x02", b"\x03"
#: Shards of a language's counts: one for so many bytes of all texts, and the least and greatest number.
PER_SHARD, SHARDS, MOST_SHARDS = 64 << 20, 64, 1 << 14
#: Bytes of text of a batch, symbols worked on at once.
BATCH, AT_ONCE = 16 << 20, 1 << 20
#: Trusted ids up to which they are broadcast (16 bytes each); beyond that a shuffle joins them.
BROADCAST_IDS = 2_000_000
#: Documents above this quantile of held-out trusted perplexities are rejected.
QUANTILE = 0.99
#: Steps of log perplexity in which quantiles are told.
STEP = 0.001
FLOOR = 1.0 / 256


def grams(text: bytes) -> np.ndarray:
    """The n-gram that ends at each byte of a text and at its end, as 40-bit numbers."""
    x = np.frombuffer(BEFORE * (ORDER - 1) + text + AFTER, dtype=np.uint8).astype(np.uint64)
    n = len(x) - ORDER + 1
    key = np.zeros(n, dtype=np.uint64)
    for k in range(ORDER):
        key = key << np.uint64(8) | x[k : k + n]
    return key


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each n-gram, by its two bytes before the last."""
    return (mixed((keys >> np.uint64(8)) & np.uint64(0xFFFF)) % np.uint64(shards)).astype(np.int64)


def parts_by_shard(keys: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, places in keys, ascending) for each shard that has keys."""
    shard = shard_of(keys, shards)
    order = np.argsort(shard, kind="stable")
    cut = np.searchsorted(shard[order], np.arange(shards + 1))
    for s in range(shards):
        if cut[s] < cut[s + 1]:
            yield s, order[cut[s] : cut[s + 1]]


class Tally:
    """Distinct n-grams and their counts, gathered in bounded pieces."""

    def __init__(self) -> None:
        self.keys, self.counts = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.waiting: list[np.ndarray] = []
        self.size = 0

    def add(self, keys: np.ndarray) -> None:
        self.waiting.append(keys)
        self.size += len(keys)
        if self.size >= AT_ONCE:
            self.settle()

    def settle(self) -> None:
        if self.waiting:
            keys, counts = np.unique(np.concatenate(self.waiting), return_counts=True)
            self.keys, self.counts = merged([self.keys, keys], [self.counts, counts])
            self.waiting, self.size = [], 0


def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sums of counts by key."""
    distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
    return distinct, np.bincount(place, weights=np.concatenate(counts), minlength=len(distinct)).astype(np.int64)


def deltas(keys: np.ndarray) -> bytes:
    """Ascending keys, compressed as differences."""
    return squeeze(np.diff(keys, prepend=np.uint64(0)).astype("<u8").tobytes())


def undeltas(raw: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(expand(raw), "<u8"), dtype=np.uint64)


def trusted_ids(labels: DataFrame, id_col: str = "doc_id", quality_col: str = "quality") -> DataFrame:
    """(id, held): ids all of whose labels say quality 1; held: kept out of training, to set thresholds."""
    fine = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(F.coalesce(F.col(quality_col), F.lit(0))).alias("q")).filter("q = 1")
    return fine.select("id", (F.crc32(F.col("id").cast("string").cast("binary")) % 4 == 2).alias("held"))


def model(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, lang_col: str, shards: int = SHARDS) -> tuple[DataFrame, dict]:
    """The sharded counts (lang, shard, keys, counts), and each language's discounts and probabilities of one and two bytes.

    Those are at most 65536 numbers a language. All trusted documents that are not held out are counted.
    """
    ids = trusted_ids(labels, id_col).filter("not held").select("id")
    rows = small_batches(docs).select(F.col(id_col).alias("id"), F.coalesce(F.col(lang_col), F.lit("")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    ids = written(ids)
    rows = rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "id", "left_semi").select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tallies: dict[str, Tally] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                tallies.setdefault(lang, Tally()).add(grams(text))
        for lang, t in tallies.items():
            t.settle()
            out = [(lang, s, deltas(t.keys[at]), squeeze(t.counts[at].astype("<i8").tobytes())) for s, at in parts_by_shard(t.keys, shards)]
            cols = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["lang", "shard", "keys", "counts"])

    def gather(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        keys, counts = merged([undeltas(x) for x in pdf["keys"]], [np.frombuffer(expand(x), "<i8") for x in pdf["counts"]])
        return pd.DataFrame({"lang": [key[0]], "shard": [key[1]], "keys": [deltas(keys)], "counts": [squeeze(counts.astype("<i8").tobytes())]})

    schema = "lang string, shard int, keys binary, counts binary"
    table = written(rows.mapInArrow(count, schema).groupBy("lang", "shard").applyInPandas(gather, schema))

    def facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Numbers of n-grams with counts 1 to 4 by order, and of distinct bytes before each pair of bytes."""
        for b in batches:
            for r in b.to_pylist():
                orders = levels(undeltas(r["keys"]), np.frombuffer(expand(r["counts"]), "<i8"))
                found = [(r["lang"], 10 * n + c, int((counts == c).sum())) for n, (_, counts) in orders.items() for c in (1, 2, 3, 4)]
                pairs, before = np.unique(orders[3][0] & np.uint64(0xFFFF), return_counts=True)
                found += [(r["lang"], 1000 + int(p), int(c)) for p, c in zip(pairs, before, strict=True)]
                cols = list(zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0]), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64())], names=["lang", "what", "n"])

    languages: dict[str, dict] = {}
    for r in table.mapInArrow(facts, "lang string, what int, n long").groupBy("lang", "what").agg(F.sum("n").alias("n")).collect():
        languages.setdefault(r["lang"], {})[r["what"]] = r["n"]
    return table, {lang: low_orders(x) for lang, x in languages.items()}


def levels(keys: np.ndarray, counts: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """The n-grams of ORDER bytes with counts, and those of fewer bytes, down to three, with their distinct left extensions."""
    out = {ORDER: (keys, counts)}
    for n in range(ORDER - 1, 2, -1):
        out[n] = np.unique(out[n + 1][0] & np.uint64((1 << 8 * n) - 1), return_counts=True)
    return out


def discounts(n: list[int]) -> tuple[float, float, float]:
    """What counts of one, two, and three or more lose, from how many n-grams occur one to four times."""
    n1, n2, n3, n4 = n
    if not (n1 and n2 and n3):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    raw = 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3
    return tuple(min(max(d, 0.05), top) for d, top in zip(raw, (1.0, 2.0, 3.0), strict=True))


def low_orders(found: dict[int, int]) -> dict:
    """Discounts by order, and the probabilities of a byte alone and after one byte."""
    pairs = np.zeros(1 << 16)
    for what, n in found.items():
        if what >= 1000:
            pairs[what - 1000] = n
    table = pairs.reshape(256, 256)
    out = {"d": {n: discounts([found.get(10 * n + c, 0) for c in (1, 2, 3, 4)]) for n in range(3, ORDER + 1)}}
    single = (table > 0).sum(axis=0)
    rest = single.sum()
    d = discounts([int((single == c).sum()) for c in (1, 2, 3, 4)])
    lose = np.choose(np.minimum(single, 3), (0, *d))
    one = (single - lose) / rest + lose.sum() / rest * FLOOR if rest else np.full(256, FLOOR)
    d = discounts([int((table == c).sum()) for c in (1, 2, 3, 4)])
    lose = np.choose(np.minimum(table, 3).astype(int), (0, *d))
    total = table.sum(axis=1, keepdims=True)
    out["two"] = np.where(total > 0, (table - lose) / np.maximum(total, 1) + lose.sum(axis=1, keepdims=True) / np.maximum(total, 1) * one, one).ravel()
    return out


def found_in(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each key stands in an ascending table, and whether it does."""
    if not len(table):
        return np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


def log_probabilities(asked: np.ndarray, keys: np.ndarray, counts: np.ndarray, low: dict | None) -> np.ndarray:
    """The natural log probability of each asked n-gram's last byte; low: the language's low orders, none if it has no text."""
    if low is None:
        return np.full(len(asked), np.log(FLOOR))
    p = low["two"][(asked & np.uint64(0xFFFF)).astype(np.int64)]
    orders = levels(keys, counts)
    for n in range(3, ORDER + 1):
        table, c = orders[n]
        if not len(table):
            continue
        lose = np.choose(np.minimum(c, 3), (0.0, *low["d"][n]))
        context = table >> np.uint64(8)
        head = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1])))
        total, lost, context = np.add.reduceat(c, head), np.add.reduceat(lose, head), context[head]
        own = asked & np.uint64((1 << 8 * n) - 1)
        at, there = found_in(context, own >> np.uint64(8))
        place, seen = found_in(table, own)
        share = np.where(seen, c[place] - lose[place], 0.0)
        p = np.where(there, (share + lost[at] * p) / total[at], p)
    return np.log(p)


def packed(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """(batch, bytes, ids, lengths, langs, text): documents packed together in the order they are read."""
    rows = small_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(lang_col), F.lit("")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    names = ["batch", "bytes", "ids", "lengths", "langs", "text"]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, count, base = 0, 0, TaskContext.get().partitionId() << 32

        def pack() -> pa.RecordBatch:
            nonlocal held, size, count
            ids, langs, texts = zip(*held, strict=True)
            held, size, count = [], 0, count + 1
            lengths = np.array(list(map(len, texts)), "<i8").tobytes()
            return pa.RecordBatch.from_arrays([pa.array([base + count]), pa.array([sum(map(len, texts))], pa.int64()), pa.array([list(ids)], pa.list_(pa.int64())), pa.array([lengths]), pa.array([list(langs)]), pa.array([squeeze(b"".join(texts))])], names=names)

        for b in parts:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and size + len(row[2]) > BATCH:
                    yield pack()
                held.append(row)
                size += len(row[2])
        if held:
            yield pack()

    return bucketed(rows.mapInArrow(run, "batch long, bytes long, ids array<long>, lengths binary, langs array<string>, text binary"), "batch")


def each_text(r: dict) -> Iterator[tuple[int | None, str, bytes]]:
    """The documents of a batch."""
    raw, at = expand(r["text"]), 0
    for i, lang, n in zip(r["ids"], r["langs"], np.frombuffer(r["lengths"], "<i8").tolist(), strict=True):
        yield i, lang, raw[at : at + n]
        at += n


def perplexities(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, lang, n_symbols, perplexity) of every document under its language's model.

    Symbols are the text's bytes and its end; a null text is empty; a null language is one of its own (""), and a
    language without trusted text gives every byte the same probability. Repeated rows give repeated rows.
    """
    batches = packed(docs, id_col, text_col, lang_col)
    total = batches.agg(F.sum("bytes")).first()[0] or 0
    # requests and counts of a shard stay of one size as the corpus grows
    shards = min(MOST_SHARDS, max(SHARDS, -(-total // PER_SHARD)))
    table, low = model(docs, labels, id_col, text_col, lang_col, shards)
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")  # rows are whole batches of documents

    def ask(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            for r in b.to_pylist():
                tallies: dict[str, Tally] = {}
                for _, lang, text in each_text(r):
                    tallies.setdefault(lang, Tally()).add(grams(text))
                out = []
                for lang, t in tallies.items():
                    t.settle()
                    out += [(r["batch"], lang, s, deltas(t.keys[at])) for s, at in parts_by_shard(t.keys, shards)]
                cols = list(zip(*out, strict=True)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.string(), pa.int32(), pa.binary()), strict=True)], names=["batch", "lang", "shard", "asked"])

    def answer(key: tuple, asked: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
        parts = [undeltas(x) for x in asked["asked"]]
        keys = undeltas(counts["keys"].iloc[0]) if len(counts) else np.empty(0, np.uint64)
        n = np.frombuffer(expand(counts["counts"].iloc[0]), "<i8") if len(counts) else np.empty(0, np.int64)
        if not parts:
            return pd.DataFrame({"batch": [], "lang": [], "asked": [], "told": []})
        every = np.unique(np.concatenate(parts))
        told = log_probabilities(every, keys, n, low.get(key[0])).astype("<f4")
        return pd.DataFrame({"batch": asked["batch"], "lang": key[0], "asked": asked["asked"], "told": [squeeze(told[np.searchsorted(every, p)].tobytes()) for p in parts]})

    asked = batches.mapInArrow(ask, "batch long, lang string, shard int, asked binary")
    told = asked.groupBy("lang", "shard").cogroup(table.groupBy("lang", "shard")).applyInPandas(answer, "batch long, lang string, asked binary, told binary")
    told = told.groupBy("batch").agg(F.collect_list(F.struct("lang", "asked", "told")).alias("answers"))

    def finish(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            for r in b.to_pylist():
                by_lang: dict[str, list] = {}
                for a in r["answers"]:
                    by_lang.setdefault(a["lang"], []).append((undeltas(a["asked"]), np.frombuffer(expand(a["told"]), "<f4")))
                known = {}
                for lang, x in by_lang.items():
                    keys, p = np.concatenate([k for k, _ in x]), np.concatenate([v for _, v in x])
                    order = np.argsort(keys)
                    known[lang] = keys[order], p[order]
                out = []
                for i, lang, text in each_text(r):
                    own, (keys, p) = grams(text), known[lang]
                    total = sum(float(p[np.searchsorted(keys, own[k : k + AT_ONCE])].sum(dtype=np.float64)) for k in range(0, len(own), AT_ONCE))
                    out.append((i, lang, len(own), float(np.exp(-total / len(own)))))
                for k in range(0, len(out), 4096):
                    cols = zip(*out[k : k + 4096], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.float64()), strict=True)], names=["id", "lang", "n_symbols", "perplexity"])

    out = batches.join(told, "batch").select("batch", "ids", "lengths", "langs", "text", "answers").mapInArrow(finish, "id long, lang string, n_symbols long, perplexity double")
    return written(out)


def thresholds(scored: DataFrame, held: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """(lang, threshold): the perplexity quantile of the held-out trusted documents; no row for a language without any.

    Told from counts by steps of log perplexity, so it is exact to a step and the same on every run.
    """
    step = F.ceil(F.ln("perplexity") / STEP)
    hist = scored.join(held.select("id"), "id", "left_semi").groupBy("lang", step.alias("step")).agg(F.count(F.lit(1)).alias("n"))
    whole, upto = Window.partitionBy("lang"), Window.partitionBy("lang").orderBy("step")
    share = F.sum("n").over(upto) / F.sum("n").over(whole)
    return hist.withColumn("share", share).filter(F.col("share") >= quantile).groupBy("lang").agg(F.exp(F.min("step") * STEP).alias("threshold"))


def quality(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """doc_id, lang, n_symbols, perplexity, threshold, keep (1 or 0) of every document.

    A language without held-out trusted documents has no threshold (null), and all its documents stay.
    """
    scored = perplexities(docs, labels)
    held = trusted_ids(labels).filter("held")
    bars = thresholds(scored, held, quantile)
    keep = F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True)).cast("int")
    # one row a language
    return scored.join(F.broadcast(bars), "lang", "left").select(F.col("id").alias("doc_id"), "lang", "n_symbols", "perplexity", "threshold", keep.alias("keep"))
