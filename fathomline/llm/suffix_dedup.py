"""Suffix-array de-duplication: bytes that a long string of an earlier document covers.

Strings of LENGTH bytes are dealt out by their least inner hash (the minimum over the hashes of their GRAM-byte parts),
which equal strings share and neighbours mostly share too, so a run of strings travels as one piece of text. Hashes
that a single document has are dropped first; the strings of a hash that very many pieces have (a line in most
documents, each time in other surroundings) are dealt out one by one, by a hash of all their bytes, so that no shard
grows with a line's copies. Each shard then orders the suffixes of its pieces by external induced
sorting (module induced); a common prefix of LENGTH or more joins neighbours, and the smallest document id of a joined
run is what its strings are judged by. Documents travel in compressed batches; shards get each piece of text once per
batch, whatever the number of its copies there.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm import induced
from fathomline.llm.common import bucketed, small_batches, written

#: Bytes of a judged string, and of the parts whose least hash deals it out.
LENGTH, GRAM = 50, 20
WINDOW = LENGTH - GRAM + 1
#: Bytes of text of a batch (more only for a single longer text) and of text for each shard.
BATCH, PER_SHARD = 4 << 20, 8 << 20
#: Batches of a corpus from which they grow with it instead, up to so many bytes: each batch has a message for each shard.
BATCHES, LARGEST = 256, 16 << 20
#: Bytes of an Arrow batch: of messages, or a single batch of documents.
MESSAGES = 2 << 20
#: Strings whose hashes are made, and that are told to batches, at once.
AT_ONCE = 1 << 18
#: Pieces of one hash beyond which its strings, each 50 bytes then, are dealt out one by one: about 1 MB, a small part of a shard.
CROWD = 16384
#: Stands for a null id, which comes last; a document of that id is taken for one without.
NO_ID = np.iinfo(np.int64).max


@functools.cache
def _codec() -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    return zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()


def squeeze(raw: bytes) -> bytes:
    return _codec()[0].compress(raw)


def expand(raw: bytes) -> bytes:
    return _codec()[1].decompress(raw)


def sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over every run of width values."""
    size = 1
    while size * 2 <= width:
        x = pick(x[:-size], x[size:])
        size *= 2
    return pick(x[: len(x) - (width - size)], x[width - size :]) if width > size else x


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective hash of 64-bit integers."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def least_hashes(text: np.ndarray) -> np.ndarray:
    """For each string of LENGTH bytes of text, the least hash of its parts of GRAM bytes."""
    n = len(text) - GRAM + 1
    word = np.empty(n + GRAM - 8, dtype=np.uint64)
    for k in range(min(8, len(word))):
        word[k::8] = text[k : k + len(word[k::8]) * 8].view("<u8")
    # parts are words of eight bytes; GRAM is no multiple of eight, so the last two overlap
    h = word[:n] * np.uint64(0x9E3779B97F4A7C15)
    for o in (8, GRAM - 8):
        h ^= h >> np.uint64(29)
        h = (h ^ word[o : o + n]) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return sliding(h, WINDOW, np.minimum)


def pieces(text: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of strings with the same least hash: first string's position, number of strings, the hash, the document.

    text: documents end to end; ends: where each ends. Strings never cross documents.
    """
    none = np.empty(0, dtype=np.int64)
    if len(text) < LENGTH:
        return none, none, np.empty(0, dtype=np.uint64), none
    least = np.empty(len(text) - LENGTH + 1, dtype=np.uint64)
    for k in range(0, len(least), AT_ONCE):
        part = least_hashes(text[k : k + AT_ONCE + LENGTH - 1])
        least[k : k + len(part)] = part
    starts = np.concatenate(([0], ends[:-1]))
    room = np.maximum(0, ends - starts - LENGTH + 1)
    fresh = np.concatenate(([True], least[1:] != least[:-1]))
    inside = np.zeros(len(least) + 1, dtype=np.int8)
    some = room > 0
    np.add.at(inside, starts[some], 1)
    np.add.at(inside, starts[some] + room[some], -1)
    inside = np.cumsum(inside[:-1], dtype=np.int8) > 0
    fresh[starts[some]] = True
    fresh &= inside
    at = np.flatnonzero(fresh)
    doc = np.searchsorted(ends, at, side="right")
    stop = np.minimum(np.append(at[1:], len(least)), starts[doc] + room[doc])
    return at, stop - at, mixed(least[at]), doc


class Batch:
    """Documents of one batch and their pieces, in the order of shard and hash."""

    def __init__(self, ids: bytes, lengths: bytes, text: bytes, shards: int):
        self.ids, self.shards = np.frombuffer(ids, "<i8"), shards
        self.lengths = np.frombuffer(lengths, "<i8")
        self.raw = expand(text)
        self.ends = np.cumsum(self.lengths)
        at, count, key, doc = pieces(np.frombuffer(self.raw, np.uint8), self.ends)
        shard = (key % np.uint64(shards)).astype(np.int64)
        value = (key >> np.uint64(32)).astype(np.uint32)
        order = np.lexsort((value, shard))
        self.at, self.count, self.doc, self.shard, self.value = at[order], count[order], doc[order], shard[order], value[order]
        first = np.concatenate(([True], (self.value[1:] != self.value[:-1]) | (self.shard[1:] != self.shard[:-1]))) if len(at) else np.empty(0, dtype=bool)
        self.heads = np.flatnonzero(first)
        self.group = np.cumsum(first) - 1

    def hashes(self) -> Iterator[tuple[int, bytes, bytes, bytes]]:
        """(shard, distinct values, which of them several documents have, places and pieces of those with several pieces)."""
        if not len(self.heads):
            return
        id_ = self.ids[self.doc]
        several = np.minimum.reduceat(id_, self.heads) != np.maximum.reduceat(id_, self.heads)
        shard, value, size = self.shard[self.heads], self.value[self.heads], np.diff(np.append(self.heads, len(self.at)))
        cut = np.concatenate(([0], np.flatnonzero(shard[1:] != shard[:-1]) + 1, [len(shard)]))
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            many = np.flatnonzero(size[a:b] > 1)
            yield int(shard[a]), value[a:b].tobytes(), np.packbits(several[a:b]).tobytes(), np.stack((many, size[a:b][many])).astype("<i4").tobytes()

    def shared(self, flags: list[tuple[int, bytes, bytes]]) -> None:
        """Keep the pieces whose hashes are shared, and number their distinct texts.

        Pieces of crowded hashes become single strings, each in the shard that all its bytes tell.
        """
        shard = self.shard[self.heads] if len(self.heads) else np.empty(0, np.int64)
        keep, crowded = np.zeros(len(self.heads), dtype=bool), np.zeros(len(self.heads), dtype=bool)
        for s, bits, crowds in flags:
            a, b = np.searchsorted(shard, [s, s + 1])
            keep[a:b] = np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a).astype(bool)
            crowded[a + np.frombuffer(crowds, "<i4")] = True
        kept = np.flatnonzero(keep[self.group]) if len(self.heads) else np.empty(0, np.int64)
        single = crowded[self.group[kept]] if len(kept) else np.empty(0, dtype=bool)
        at, count, doc, shard = (x[kept] for x in (self.at, self.count, self.doc, self.shard))
        label, first = self.labels(at[~single], count[~single], shard[~single])
        if single.any():
            each = count[single]
            lone = np.repeat(at[single] - np.cumsum(each) + each, each) + np.arange(each.sum())
            own, same, begun = self.strings(lone)
            label, first = np.concatenate((label, same + len(first))), np.concatenate((first, begun + len(label)))
            doc = np.concatenate((doc[~single], np.repeat(doc[single], each)))
            shard = np.concatenate((shard[~single], (own % np.uint64(self.shards)).astype(np.int64)))
            at, count = np.concatenate((at[~single], lone)), np.concatenate((count[~single], np.ones(len(lone), dtype=np.int64)))
        # numbers run on through the shards: first has the first piece of each distinct text, begin where a shard's texts begin
        by = np.argsort(shard[first], kind="stable")
        number = np.empty(len(first), dtype=np.int64)
        number[by] = np.arange(len(first))
        self.at, self.count, self.doc, self.number, self.first = at, count, doc, number[label], first[by]
        self.shards_here, begin = np.unique(shard[self.first], return_index=True)
        self.begin = np.append(begin, len(first))

    def labels(self, at: np.ndarray, count: np.ndarray, shard: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which distinct text each piece has, and the first piece of each. Equal texts are of one shard, and pieces in the order of shards."""
        label, first = [], []
        raw, seen, last = self.raw, {}, -1
        for k, (a, c, s) in enumerate(zip(at.tolist(), count.tolist(), shard.tolist(), strict=True)):
            if s != last:
                seen, last = {}, s
            n = seen.setdefault(raw[a : a + c + LENGTH - 1], len(first))
            if n == len(first):
                first.append(k)
            label.append(n)
        return np.array(label, dtype=np.int64), np.array(first, dtype=np.int64)

    def strings(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A hash of all bytes of the string at each place, which distinct string it is, and the first place of each."""
        eight = np.lib.stride_tricks.sliding_window_view(np.frombuffer(self.raw, np.uint8), 8)
        word = lambda k, o: eight[k + o].view("<u8")[:, 0]
        offsets = (*range(0, LENGTH - 8, 8), LENGTH - 8)
        own = np.zeros(len(at), dtype=np.uint64)
        for k in range(0, len(at), AT_ONCE):
            for o in offsets:
                own[k : k + AT_ONCE] = mixed(own[k : k + AT_ONCE] ^ word(at[k : k + AT_ONCE], o))
        by = np.argsort(own, kind="stable")
        fresh = np.concatenate(([True], own[by[1:]] != own[by[:-1]]))
        again = np.flatnonzero(~fresh)
        for k in range(0, len(again), AT_ONCE):
            x, y = at[by[again[k : k + AT_ONCE]]], at[by[again[k : k + AT_ONCE] - 1]]
            if not all(np.array_equal(word(x, o), word(y, o)) for o in offsets):  # different strings of one hash
                return own, *self.labels(at, np.ones_like(at), np.zeros_like(at))
        label = np.empty(len(at), dtype=np.int64)
        label[by] = np.cumsum(fresh) - 1
        return own, label, by[fresh]

    def of_shards(self) -> Iterator[tuple[int, int, int, list[bytes]]]:
        """(shard, its first number, the number after its last, its distinct texts)."""
        at, stop = self.at[self.first], self.at[self.first] + self.count[self.first] + LENGTH - 1
        for s, a, b in zip(self.shards_here.tolist(), self.begin[:-1].tolist(), self.begin[1:].tolist(), strict=True):
            yield s, a, b, [self.raw[x:y] for x, y in zip(at[a:b].tolist(), stop[a:b].tolist(), strict=True)]

    @property
    def texts(self) -> dict[int, list[bytes]]:
        """The distinct texts of each shard."""
        return {s: texts for s, _, _, texts in self.of_shards()}

    def outgoing(self) -> Iterator[tuple[int, bytes, bytes, bytes, bytes]]:
        """(shard, texts, their lengths, their smallest and largest document ids) for each shard."""
        id_ = self.ids[self.doc]
        low, high = np.full(len(self.first), NO_ID), np.full(len(self.first), np.iinfo(np.int64).min)
        np.minimum.at(low, self.number, id_)
        np.maximum.at(high, self.number, id_)
        sizes = (self.count[self.first] + LENGTH - 1).astype("<i4")
        for s, a, b, texts in self.of_shards():
            yield s, squeeze(b"".join(texts)), sizes[a:b].tobytes(), low[a:b].tobytes(), high[a:b].tobytes()

    def covered(self, replies: list[tuple[int, bytes]]) -> np.ndarray:
        """Which bytes a string of an earlier document covers."""
        change = np.zeros(len(self.raw) + 1, dtype=np.int32)
        if not replies:
            return np.zeros(len(self.raw), dtype=bool)
        begin = dict(zip(self.shards_here.tolist(), self.begin.tolist(), strict=False))
        told = [np.frombuffer(expand(packed), "<i8").reshape(4, -1) for _, packed in replies]
        text_no, offset, count, low = np.concatenate(told, axis=1)
        text_no = text_no + np.repeat([begin[s] for s, _ in replies], [x.shape[1] for x in told])
        del told
        id_ = self.ids[self.doc]
        by = np.argsort(self.number, kind="stable")
        own = self.number[by]
        lo = np.searchsorted(own, text_no)
        each = np.searchsorted(own, text_no, side="right") - lo
        cut = np.searchsorted(np.cumsum(each), np.arange(AT_ONCE, each.sum(), AT_ONCE))
        for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(text_no)], strict=True):
            some = each[a:b]
            which = np.repeat(np.arange(a, b), some)
            place = by[np.repeat(lo[a:b], some) + np.arange(len(which)) - np.repeat(np.cumsum(some) - some, some)]
            later = id_[place] > low[which]
            start = self.at[place[later]] + offset[which[later]]
            np.add.at(change, start, 1)
            np.add.at(change, start + count[which[later]] + LENGTH - 1, -1)
        return np.cumsum(change[:-1]) > 0

    def results(self, covered: np.ndarray) -> Iterator[tuple[int, list[dict], bytes]]:
        """(id, removed spans, kept bytes) of each document."""
        raw = np.frombuffer(self.raw, np.uint8)
        begin = 0
        for id_, end in zip(self.ids.tolist(), self.ends.tolist(), strict=True):
            here = covered[begin:end]
            if not here.any():
                yield id_, [], self.raw[begin:end]
            else:
                inner = np.diff(np.concatenate(([False], here, [False])).astype(np.int8))
                starts, stops = np.flatnonzero(inner == 1), np.flatnonzero(inner == -1)
                yield id_, [{"start": int(x), "end": int(y)} for x, y in zip(starts, stops, strict=True)], raw[begin:end][~here].tobytes()
            begin = end


def batches(docs: DataFrame, id_col: str, text_col: str, carry: list[str], limit: int) -> DataFrame:
    """(batch, ids, lengths, text, rows): documents packed together in the order they are read. Nothing is shuffled.

    rows: the carried columns, as an Arrow stream.
    """
    carried = F.struct(*carry) if carry else F.struct(F.lit(True).alias("none"))
    rows = small_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"), carried.alias("row"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, held, size, count = [], [], [], 0, 0
        base = TaskContext.get().partitionId() << 32

        def pack() -> pa.RecordBatch:
            nonlocal ids, texts, held, size, count
            sink = pa.BufferOutputStream()
            whole = pa.RecordBatch.from_arrays([pa.concat_arrays(held)], names=["row"])
            with pa.ipc.new_stream(sink, whole.schema) as stream:
                stream.write_batch(whole)
            out = pa.RecordBatch.from_arrays([
                pa.array([base + count], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([size], pa.int64()), pa.array([np.array(ids, "<i8").tobytes()], pa.binary()),
                pa.array([np.array(list(map(len, texts)), "<i8").tobytes()], pa.binary()), pa.array([squeeze(b"".join(texts))], pa.binary()),
                pa.array([squeeze(sink.getvalue().to_pybytes())], pa.binary()),
            ], names=["batch", "n", "bytes", "ids", "lengths", "text", "rows"])
            ids, texts, held, size, count = [], [], [], 0, count + 1
            return out

        for b in parts:
            for k, (i, t) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                if size + len(t) > limit and ids:
                    yield pack()
                held.append(b.column(2).slice(k, 1))
                ids.append(NO_ID if i is None else i)
                texts.append(t)
                size += len(t)
        if ids:
            yield pack()

    return bucketed(rows.mapInArrow(run, "batch long, n long, bytes long, ids binary, lengths binary, text binary, rows binary"), "batch")


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), batch_bytes: int | None = None) -> DataFrame:
    """(id, n_bytes, spans array<start, end>, kept binary, row) of every row: the removed byte spans and what is left.

    row: a struct of the columns named in carry.

    A null text is empty; a null id counts as larger than all others; rows of the same id never remove from each
    other. Texts shorter than LENGTH bytes stay whole. Columns not carried are left out.
    """
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    shards = max(1, -(-total // PER_SHARD))
    packed = batches(docs, id_col, text_col, list(carry), batch_bytes or min(LARGEST, max(BATCH, total // BATCHES)))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(MESSAGES))  # rows are whole batches of documents, or messages

    def hashes(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            for r in b.to_pylist():
                found = list(Batch(r["ids"], r["lengths"], r["text"], shards).hashes())
                cols = list(zip(*found, strict=True)) or [[]] * 4
                types = (pa.int32(), *[pa.binary()] * 3)
                yield pa.RecordBatch.from_arrays([pa.array([r["batch"]] * len(found), pa.int64()), *map(pa.array, cols, types)], names=["batch", "shard", "values", "several", "many"])

    def shared(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        values = [np.frombuffer(v, "<u4") for v in pdf["values"]]
        several = [np.unpackbits(np.frombuffer(s, np.uint8), count=len(v)).astype(bool) for s, v in zip(pdf["several"], values, strict=True)]
        every = np.concatenate(values)
        distinct, place, count = np.unique(every, return_inverse=True, return_counts=True)
        flag = count > 1
        flag[place[np.concatenate(several)]] = True
        begin = np.cumsum([0, *map(len, values[:-1])])
        for a, m in zip(begin.tolist(), pdf["many"], strict=True):
            many, size = np.frombuffer(m, "<i4").reshape(2, -1)
            np.add.at(count, place[a + many], size - 1)
        bits, crowds = [], []
        for a, v in zip(begin.tolist(), values, strict=True):
            here = place[a : a + len(v)]
            bits.append(np.packbits(flag[here]).tobytes())
            crowds.append(np.flatnonzero(count[here] > CROWD).astype("<i4").tobytes())
        return pd.DataFrame({"batch": pdf["batch"], "shard": key[0], "bits": bits, "crowds": crowds})

    flags = packed.select("batch", "ids", "lengths", "text").mapInArrow(hashes, "batch long, shard int, values binary, several binary, many binary")
    flags = flags.groupBy("shard").applyInPandas(shared, "batch long, shard int, bits binary, crowds binary").groupBy("batch").agg(F.collect_list(F.struct("shard", "bits", "crowds")).alias("flags"))
    flagged = written(packed.select("batch").join(flags, "batch", "left"))

    def outgoing(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            for r in b.to_pylist():
                batch = Batch(r["ids"], r["lengths"], r["text"], shards)
                batch.shared([(f["shard"], f["bits"], f["crowds"]) for f in r["flags"] or ()])
                found = list(batch.outgoing())
                cols = list(zip(*found, strict=True)) or [[]] * 5
                types = (pa.int32(), *[pa.binary()] * 4)
                yield pa.RecordBatch.from_arrays([pa.array([r["batch"]] * len(found), pa.int64()), *map(pa.array, cols, types)], names=["batch", "shard", "texts", "sizes", "low", "high"])

    sent = packed.select("batch", "ids", "lengths", "text").join(flagged, "batch").mapInArrow(outgoing, "batch long, shard int, texts binary, sizes binary, low binary, high binary")
    judged = sent.groupBy("shard").applyInPandas(judge, "batch long, shard int, told binary")
    replies = written(judged.groupBy("batch").agg(F.collect_list(F.struct("shard", "told")).alias("replies")))

    def finish(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for b in parts:
            for r in b.to_pylist():
                batch = Batch(r["ids"], r["lengths"], r["text"], shards)
                batch.shared([(f["shard"], f["bits"], f["crowds"]) for f in r["flags"] or ()])
                found = list(batch.results(batch.covered([(f["shard"], f["told"]) for f in r["replies"] or ()])))
                with pa.ipc.open_stream(expand(r["rows"])) as stream:
                    rows = stream.read_next_batch().column(0)
                for k in range(0, len(found), 256):
                    ids, spans, kept = zip(*found[k : k + 256], strict=True)
                    ids = [None if i == NO_ID else i for i in ids]
                    sizes = batch.lengths[k : k + 256]
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary()), rows.slice(k, 256)], names=["id", "n_bytes", "spans", "kept", "row"])

    row = docs.select(F.struct(*carry) if carry else F.struct(F.lit(True).alias("none"))).schema[0].dataType
    both = packed.select("batch", "ids", "lengths", "text", "rows").join(flagged.join(replies, "batch", "left"), "batch")
    out = both.mapInArrow(finish, f"id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary, row {row.simpleString()}")
    return out.withColumnRenamed("id", id_col)


def together(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Ranges of neighbours whose sizes add up to AT_ONCE at most, or of single larger ones."""
    begin, held = 0, 0
    for k, n in enumerate(sizes):
        if held + n > AT_ONCE and k > begin:
            yield begin, k
            begin, held = k, 0
        held += n
    if sizes:
        yield begin, len(sizes)


def judge(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """For each batch of a shard: which strings of its texts an earlier document has, and the smallest id that has them."""
    numbers: dict[bytes, int] = {}
    own, lows = [], []
    for texts, sizes in zip(pdf["texts"], pdf["sizes"], strict=True):
        raw, at, mine = expand(texts), 0, []
        for n in np.frombuffer(sizes, "<i4").tolist():
            mine.append(numbers.setdefault(raw[at : at + n], len(numbers)))
            at += n
        own.append(np.array(mine, dtype=np.int64))
    low = np.full(len(numbers), NO_ID)
    for mine, raw in zip(own, pdf["low"], strict=True):
        np.minimum.at(low, mine, np.frombuffer(raw, "<i8"))
    size = np.fromiter(map(len, numbers), dtype=np.int64, count=len(numbers))
    # 0xFF is no byte of UTF-8, so adding one leaves 0 for the ends of texts
    text = np.frombuffer(b"\xff".join(numbers) + b"\xff", dtype=np.uint8) + np.uint8(1)
    del numbers
    begin = np.cumsum(size + 1) - size - 1
    pos, lcp = induced.suffix_order(text)
    strings = size - LENGTH + 1
    # a task's memory is what these arrays take, so each is narrow and goes when it has served
    valid = np.zeros(len(text) + 1, dtype=np.int8)
    valid[begin] += 1
    np.add.at(valid, begin + strings, -1)
    valid = np.cumsum(valid[:-1], dtype=np.int8) > 0
    mine = np.flatnonzero(valid[pos])
    del valid
    # suffixes after the last string are none of its business
    since = np.zeros_like(mine)
    np.add(mine[:-1], 1, out=since[1:])
    least = np.minimum.reduceat(lcp[: mine[-1] + 1], since)
    pos = pos[mine]
    del lcp, mine, since
    head = np.flatnonzero(np.concatenate(([True], least[1:] < LENGTH)))
    del least
    ids, rank = np.unique(low, return_inverse=True)
    of_text = np.repeat(rank.astype(np.int32), size + 1)
    smallest = np.minimum.reduceat(of_text[pos], head)
    del of_text
    best = np.full(len(text), len(ids), dtype=np.int32)
    best[pos] = np.repeat(smallest, np.diff(np.append(head, len(pos))))
    ids = np.append(ids, NO_ID)
    del pos, head, smallest
    told: list[bytes] = []
    for a, b in together([int(strings[no].sum()) for no in own]):
        no, high = np.concatenate(own[a:b]), np.frombuffer(b"".join(pdf["high"].iloc[a:b]), "<i8")
        count = strings[no]
        which = np.repeat(np.arange(len(no)), count)
        offset = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
        found = ids[best[begin[no[which]] + offset]]
        use = np.flatnonzero(found < high[which])
        which, offset, found = which[use], offset[use], found[use]
        fresh = np.concatenate(([True], (which[1:] != which[:-1]) | (offset[1:] != offset[:-1] + 1) | (found[1:] != found[:-1])))[: len(which)]
        at = np.flatnonzero(fresh)
        length = np.diff(np.append(at, len(which)))
        runs = np.stack((which[at], offset[at], length, found[at])).astype("<i8")
        # numbers count on through the messages; each is told its own
        first = np.cumsum([0, *map(len, own[a:b])])
        cut = np.searchsorted(runs[0], first)
        for x, y, n in zip(cut[:-1].tolist(), cut[1:].tolist(), first.tolist(), strict=False):
            told.append(squeeze((runs[:, x:y] - np.array([[n], [0], [0], [0]])).tobytes()))
    return pd.DataFrame({"batch": pdf["batch"], "shard": key[0], "told": told})


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the removed spans cut out of the texts; a character of which a part was removed goes whole.

    All rows and columns stay; nulls and repeats are as for removals.
    """
    out = removals(docs, id_col, text_col, tuple(c for c in docs.columns if c not in (id_col, text_col)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [x.decode("utf-8", "ignore") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), b.column(2)], names=["id", "text", "row"])

    cut = out.select(id_col, "kept", "row").mapInArrow(run, f"id long, text string, row {out.schema['row'].dataType.simpleString()}")
    return cut.select(*[F.col("id").alias(c) if c == id_col else F.col("text").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns])


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the SHA-256 of the remaining bytes."""
    out = removals(docs)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
