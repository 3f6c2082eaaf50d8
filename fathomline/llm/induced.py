"""Suffix order and common prefixes of one shard by induced sorting through disk-backed priority queues.

Suffixes are L or S by whether they are larger or smaller than their successor. Only the leftmost S of every run (the
seeds) are sorted directly, and only to the depth that matters. All others are induced: scanning in order, a suffix
puts its predecessor into a queue by the predecessor's first symbol, first all L upwards, then all S downwards. An
entry carries the common prefix with the entry before it: one more than the least common prefix passed since then.
Queues are monotone, so a queue is a bucket for each symbol, taken once; what exceeds memory goes to disk.
"""

from __future__ import annotations

import tempfile

import numpy as np

#: Bytes that a task's queues hold in memory; the rest is in unlinked files of the task.
IN_MEMORY = 256 << 20
#: No common prefix is told beyond this; seeds are sorted by this many symbols.
DEPTH = 56


class Queue:
    """A priority queue of (position, common prefix) arrays by symbol, first in first out within a symbol."""

    def __init__(self, limit: int = IN_MEMORY):
        self.parts: list[list] = [[] for _ in range(256)]
        self.held = [0] * 256
        self.total = 0
        self.limit = limit

    def put(self, symbol: int, pos: np.ndarray, lcp: np.ndarray) -> None:
        self.parts[symbol].append((pos, lcp))
        self.held[symbol] += pos.nbytes + lcp.nbytes
        self.total += pos.nbytes + lcp.nbytes
        while self.total > self.limit:
            self.spill(int(np.argmax(self.held)))

    def spill(self, symbol: int) -> None:
        """Move a symbol's entries in memory to a file."""
        kept = [p for p in self.parts[symbol] if not isinstance(p, tuple)]
        pos, lcp = (np.concatenate(x) for x in zip(*(p for p in self.parts[symbol] if isinstance(p, tuple)), strict=True))
        f = tempfile.TemporaryFile()
        np.save(f, pos)
        np.save(f, lcp)
        self.parts[symbol] = [*kept, f]
        self.total -= self.held[symbol]
        self.held[symbol] = 0

    def take(self, symbol: int) -> tuple[np.ndarray, np.ndarray]:
        """All entries of a symbol, in the order they were put in."""
        out = []
        for p in self.parts[symbol]:
            if not isinstance(p, tuple):
                p.seek(0)
                out.append((np.load(p), np.load(p)))
                p.close()
            else:
                out.append(p)
        self.total -= self.held[symbol]
        self.parts[symbol], self.held[symbol] = [], 0
        if not out:
            return np.empty(0, np.int32), np.empty(0, np.int16)
        return np.concatenate([p for p, _ in out]), np.concatenate([c for _, c in out])


def common(text: np.ndarray, i: int, j: int) -> int:
    """The common prefix of two suffixes, up to DEPTH."""
    n = min(DEPTH, len(text) - max(i, j))
    differ = np.flatnonzero(text[i : i + n] != text[j : j + n])
    return int(differ[0]) if len(differ) else n


def seeds_sorted(text: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """pos in the order of their suffixes' first DEPTH symbols, with common prefixes; text has DEPTH symbols of padding.

    Words of eight symbols are compared one after the other, each only where the words before leave a tie.
    """
    order = np.arange(len(pos))
    lcp = np.zeros(len(pos), dtype=np.int16)
    group = np.zeros(len(pos), dtype=np.int64)
    open_ = np.arange(len(pos))  # places in the order that are still tied with a neighbour
    eight = np.lib.stride_tricks.sliding_window_view(text, 8)
    for t in range(0, DEPTH, 8):
        word = eight[pos[order[open_]] + np.int32(t)].view(">u8")[:, 0].astype(np.uint64)
        by = np.lexsort((word, group[open_])) if t else np.argsort(word, kind="stable")
        order[open_] = order[open_][by]
        word = word[by]
        # places of a tie are neighbours, so sorting inside ties keeps open_ aligned
        same_group = np.concatenate(([False], (group[open_][1:] == group[open_][:-1])))
        x = np.concatenate((word[:1], word[1:] ^ word[:-1]))
        differs = same_group & (x != 0)
        lead = np.zeros(len(x), dtype=np.int16)
        left = x.copy()
        zero_bytes = np.zeros(len(x), dtype=bool) | True
        for k in range(8):
            top = (left >> np.uint64(56 - 8 * k)) & np.uint64(255)
            zero_bytes &= top == 0
            lead += zero_bytes
        lcp[open_[differs]] = t + lead[differs]
        lcp[open_[same_group & ~differs]] = t + 8
        fresh = ~same_group | differs
        number = np.cumsum(fresh)
        group[open_] = number
        tied = np.concatenate((~fresh[1:], [False])) | ~fresh
        open_ = open_[tied]
        if not len(open_):
            break
    return pos[order], lcp


def classify(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than its successor; the last one counts as smaller."""
    start = np.concatenate(([0], np.flatnonzero(text[1:] != text[:-1]) + 1))
    char = text[start]
    rising = np.concatenate((char[:-1] < char[1:], [True]))
    return np.repeat(rising, np.diff(np.append(start, len(text))))


class Passed:
    """For each symbol, the least common prefix passed since its last entry."""

    def __init__(self) -> None:
        self.least = np.zeros(256, dtype=np.int16)

    def send(self, queue: Queue, pos: np.ndarray, lcp: np.ndarray, chosen: np.ndarray, symbol: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
        """Predecessors of the chosen entries into the queue by symbol; those of symbol keep are returned instead.

        lcp[k] is the common prefix of entry k with the one scanned before it.
        """
        mine = (np.empty(0, np.int32), np.empty(0, np.int16))
        if not len(pos):
            return mine
        least_all = int(lcp.min())
        seen = np.flatnonzero(chosen)
        before = self.least
        self.least = np.minimum(before, np.int16(least_all))
        if not len(seen):
            return mine
        own = symbol[seen]
        by = np.argsort(own, kind="stable")
        seen, own = seen[by], own[by]
        cut = np.concatenate(([0], np.flatnonzero(own[1:] != own[:-1]) + 1, [len(own)]))
        padded = np.append(lcp, np.int16(DEPTH))
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            s, d = seen[a:b], int(own[a])
            bounds = np.empty(len(s) + 1, dtype=np.int64)
            bounds[0] = 0
            bounds[1:] = s + 1
            least = np.minimum.reduceat(padded, bounds)
            first = min(int(before[d]), int(least[0]))
            self.least[d] = least[-1] if s[-1] + 1 < len(lcp) else DEPTH
            carried = least[:-1].copy()
            carried[0] = first
            entry = (pos[s] - 1).astype(np.int32), np.minimum(carried + 1, DEPTH).astype(np.int16)
            if d == keep:
                mine = entry
            else:
                queue.put(d, *entry)
        return mine


def suffix_order(text: np.ndarray, limit: int = IN_MEMORY) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all suffixes but the last in order, to DEPTH symbols, and the common prefix of each with the one before.

    text: symbols 0-255; the last is 0 and the one before it is not. Suffixes that share DEPTH symbols stand side by side in any order.
    """
    n = len(text)
    padded = np.concatenate((text, np.zeros(DEPTH + 8, dtype=np.uint8)))
    small = classify(text)
    lms = np.flatnonzero(small[1:] & ~small[:-1]).astype(np.int32) + 1
    seeds, seed_lcp = seeds_sorted(padded, lms)
    first = text[seeds]
    seed_from = np.searchsorted(first, np.arange(257))
    large: list[tuple[np.ndarray, np.ndarray]] = []
    queue, passed = Queue(limit), Passed()
    for c in range(256):
        passed.least[:] = 0
        cur, lcp = queue.take(c)
        if len(lcp):
            lcp[0] = 0
        gens = []
        while len(cur):
            gens.append((cur, lcp))
            ok = cur > 0
            d = text[np.maximum(cur - 1, 0)]
            nxt, nxt_lcp = passed.send(queue, cur, lcp, ok & (d >= c), d, c)
            cur, lcp = nxt, nxt_lcp
        pos = np.concatenate([g for g, _ in gens]) if gens else np.empty(0, np.int32)
        pre = np.concatenate([g for _, g in gens]) if gens else np.empty(0, np.int16)
        large.append((pos, pre))
        s = seeds[seed_from[c] : seed_from[c + 1]]
        if len(s):
            pre = seed_lcp[seed_from[c] : seed_from[c + 1]].copy()
            pre[0] = common(padded, int(pos[-1]), int(s[0])) if len(pos) else 0
            d = text[np.maximum(s - 1, 0)]
            passed.send(queue, s, pre, (s > 0) & (d > c), d, -1)
    out_pos: list[np.ndarray] = []
    out_lcp: list[np.ndarray] = []
    queue, passed = Queue(limit), Passed()
    for c in range(255, -1, -1):
        passed.least[:] = 0
        cur, lcp = queue.take(c)
        if len(lcp):
            lcp[0] = 0
        gens = []
        while len(cur):
            gens.append((cur, lcp))
            ok = cur > 0
            d = text[np.maximum(cur - 1, 0)]
            cur, lcp = passed.send(queue, cur, lcp, ok & (d <= c), d, c)
        pos = np.concatenate([g for g, _ in gens]) if gens else np.empty(0, np.int32)
        pre = np.concatenate([g for _, g in gens]) if gens else np.empty(0, np.int16)
        l_pos, l_pre = large[c]
        seam = common(padded, int(pos[-1]), int(l_pos[-1])) if len(pos) and len(l_pos) else 0
        if len(l_pos):
            down = l_pos[::-1]
            # going down, an entry's common prefix with the one scanned before it is that entry's own with it
            down_lcp = np.concatenate(([np.int16(seam)], l_pre[:0:-1]))
            d = text[np.maximum(down - 1, 0)]
            passed.send(queue, down, down_lcp, (down > 0) & (d < c), d, -1)
        # upwards again: L, then S
        up_pos, up_lcp = pos[::-1], np.concatenate((np.array([seam], dtype=np.int16), pre[:0:-1])) if len(pos) else pre
        out_pos.append(np.concatenate((l_pos, up_pos)))
        out_lcp.append(np.concatenate((l_pre, up_lcp)).astype(np.int16))
    assert n < 1 << 31
    return np.concatenate(out_pos[::-1]), np.concatenate(out_lcp[::-1])
