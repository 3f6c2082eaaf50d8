"""Byte-level BPE by speculation and verification.

A text is cut into words by the vocabulary's word pattern. For each distinct word of a batch the longest
vocabulary entries, taken greedily from the left, are proposed as its tokens. A sequence of tokens is the BPE
encoding exactly if every token encodes to itself and every adjacent pair encodes to itself, so one vectorised
check of all distinct adjacent pairs accepts most words; only the others are merged exactly.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm.common import small_batches

#: Fixed value: the word pattern of the vocabulary's pre-tokeniser.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words remembered by a task before it forgets them all; bounds memory, not results.
REMEMBER = 400_000
#: Bytes up to which scanning beats the heap in exact merging.
SHORT = 40


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary: itself, or the next from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """A byte-level BPE vocabulary with ranked merges, read from a tokenizer's JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        vocab = spec["model"]["vocab"]
        raw = {name: bytes(letters[c] for c in name) for name in vocab}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = 1 + max(max(vocab.values()), *self.special.values(), 0)
        self.bytes_of: list[bytes] = [b""] * size
        for name, i in vocab.items():
            self.bytes_of[i] = raw[name]
        for name, i in self.special.items():
            self.bytes_of[i] = name.encode()
        self.id_of = {raw[name]: i for name, i in vocab.items()}
        self.longest = max(map(len, self.id_of))
        self.rank = np.full(size, -1, dtype=np.int64)
        self.left = np.arange(size, dtype=np.int64)
        self.right = np.arange(size, dtype=np.int64)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for r, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            self.merges[x, y] = r, z
            self.rank[z], self.left[z], self.right[z] = r, x, y
        keys = np.array([(x << 32) | y for x, y in self.merges], dtype=np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], np.array([r for r, _ in self.merges.values()], dtype=np.int64)[order]
        self.no_merge = (len(self.merges), -1)
        self._seen: set[tuple[int, int]] = set()
        self._apart: set[tuple[int, int]] = set()  # pairs seen that do not stand
        self._own: dict[int, bool] = {}
        self._loose: set[int] = set()  # tokens seen that do not stand
        self.word = regex.compile(WORDS)
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None

    def propose(self, word: bytes) -> list[int]:
        """Longest vocabulary entries from the left."""
        found, at, n, id_of = [], 0, len(word), self.id_of
        while at < n:
            to = min(n, at + self.longest)
            while (piece := word[at:to]) not in id_of:
                to -= 1
            found.append(id_of[piece])
            at = to
        return found

    def merge(self, word: bytes) -> list[int]:
        """Exact BPE: always the lowest-ranked adjacent pair, leftmost first; a heap over a linked list for long words."""
        if len(word) <= SHORT:
            return self.merge_short(word)
        ids = [self.id_of[word[k : k + 1]] for k in range(len(word))]
        n = len(ids)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(m[0], k, ids[k], ids[k + 1]) for k in range(n - 1) if (m := self.merges.get((ids[k], ids[k + 1])))]
        heapq.heapify(heap)
        while heap:
            _, k, x, y = heapq.heappop(heap)
            j = after[k] if alive[k] else n
            if j >= n or ids[k] != x or ids[j] != y:
                continue
            ids[k], alive[j], after[k] = self.merges[x, y][1], False, after[j]
            if after[j] < n:
                before[after[j]] = k
            for s, t in ((before[k], k), (k, after[k])):
                if s >= 0 and t < n and (m := self.merges.get((ids[s], ids[t]))):
                    heapq.heappush(heap, (m[0], s, ids[s], ids[t]))
        return [i for i, a in zip(ids, alive, strict=True) if a]

    def merge_short(self, word: bytes) -> list[int]:
        """Exact BPE of a word of few bytes, scanning for the lowest rank."""
        ids = [self.id_of[word[k : k + 1]] for k in range(len(word))]
        get, no = self.merges.get, self.no_merge
        todo = [get(p, no) for p in zip(ids, ids[1:], strict=False)]
        while todo and (best := min(todo)) is not no:
            k = todo.index(best)
            ids[k : k + 2] = [best[1]]
            del todo[k]
            if k:
                todo[k - 1] = get((ids[k - 1], ids[k]), no)
            if k < len(todo):
                todo[k] = get((ids[k], ids[k + 1]), no)
        return ids

    def stands(self, token: int) -> bool:
        """Whether a token's bytes encode to that token."""
        if token not in self._own:
            self._own[token] = self.merge(self.bytes_of[token]) == [token]
            if not self._own[token]:
                self._loose.add(token)
        return self._own[token]

    def pairs_stand(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether each pair of tokens, both standing alone, stays apart when their bytes are encoded together.

        Merges are undone from the latest on. A merge across the border that ranks before the merge just undone
        would have come first; of equal ranks the left one comes first.
        """
        a, b = a.astype(np.int64), b.astype(np.int64)
        good, at = np.ones(len(a), dtype=bool), np.arange(len(a))
        limit = np.full(len(a), np.iinfo(np.int64).max)
        while len(at):
            key = (a << 32) | b
            pos = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            bad = (self.pair_keys[pos] == key) & (self.pair_ranks[pos] < limit)
            good[at[bad]] = False
            ra, rb = self.rank[a], self.rank[b]
            go = ~bad & ((ra >= 0) | (rb >= 0))
            at, a, b, ra, rb = at[go], a[go], b[go], ra[go], rb[go]
            from_left = ra > rb
            limit = np.where(from_left, ra, rb + 1)
            a, b = np.where(from_left, self.right[a], a), np.where(from_left, b, self.left[b])
        return good

    def encode_words(self, words: list[str]) -> list[bytes]:
        """The ids of each word as little-endian unsigned 32-bit integers."""
        raw = [w.encode() for w in words]
        proposed = [self.propose(w) for w in raw]
        fresh = {p for ids in proposed if len(ids) > 1 for p in zip(ids, ids[1:], strict=False)} - self._seen
        if fresh:
            pairs = np.array(list(fresh), dtype=np.int64)
            self._apart.update(tuple(p) for p in pairs[~self.pairs_stand(pairs[:, 0], pairs[:, 1])].tolist())
            self._seen |= fresh
        for t in set().union(*proposed) - self._own.keys():
            self.stands(t)
        apart, loose, out = self._apart, self._loose, []
        for w, ids in zip(raw, proposed, strict=True):
            if not (apart.isdisjoint(zip(ids, ids[1:], strict=False)) and loose.isdisjoint(ids)):
                ids = self.merge(w)
            out.append(pack(f"<{len(ids)}I", *ids))
        if len(self._seen) > 4 * REMEMBER:
            self._seen.clear()
            apart.clear()
        return out

    def words(self, text: str) -> list[str]:
        """The words of a text; special tokens stand alone and keep their own ids."""
        if self.cut is None or not any(s in text for s in self.special):
            return self.word.findall(text)
        return [w for k, part in enumerate(self.cut.split(text)) for w in ([part] if k % 2 else self.word.findall(part))]

    def encode(self, texts: list[str], known: dict[str, bytes]) -> list[bytes]:
        """The ids of each text; known carries words over from one batch to the next."""
        if not known or len(known) > REMEMBER:
            known.clear()
            known.update({s: np.array([i], dtype="<u4").tobytes() for s, i in self.special.items()})
        split = [self.words(t) for t in texts]
        fresh = list(set().union(*split) - known.keys())
        known.update(zip(fresh, self.encode_words(fresh), strict=True))
        return [b"".join(map(known.__getitem__, ws)) for ws in split]

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that aren't UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, dtype="<u4").tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """One vocabulary for each Python worker."""
    return Vocabulary(path)


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids binary): the BPE ids of every whole text, as little-endian unsigned 32-bit integers.

    A null or empty text has no ids; a null id is kept. path: a byte-level BPE tokenizer's JSON file, present on
    every executor. Other columns are left out, so their names cannot clash. Rows are independent: no shuffle.
    """
    rows = small_batches(df).select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, bytes] = {}
        for b in batches:
            ids = vocabulary(path).encode(b.column(1).to_pylist(), known)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary())], names=["id", "ids"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, ids binary").withColumnRenamed("id", id_col)


def decode(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, ids, decoded string): the text that each row's ids stand for; null ids give an empty text."""
    rows = small_batches(df).select(F.col(id_col).alias("id"), F.coalesce(F.col(ids_col), F.lit(b"")).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [vocabulary(path).decode(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], names=["id", "ids", "decoded"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, ids binary, decoded string").withColumnRenamed("id", id_col)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    both = decode(encode(docs, path), path)
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
