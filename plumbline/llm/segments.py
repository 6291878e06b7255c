"""Texts as sequences of segments that recur: each distinct segment is encoded once per worker.

A segment is a span of the text that the tokenizer encodes on its own, whatever stands around it.
The store keeps, per Python worker, the ids of the segments seen lately; it is emptied when it holds
more than ``most`` segments, so its memory is bounded and results never depend on it. The hash only
finds a segment; its bytes decide whether it is the same one.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from plumbline.llm.word_arrays import _BASE, _BASE_INV, _power_table, mix

MOST = 2_000_000


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span."""
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power_table(_BASE, max(1, len(data)))[: len(data)], out=sums[1:])
    inverse = _power_table(_BASE_INV, len(data) + 1)
    return mix((sums[end] - sums[start]) * inverse[start], 3)


def gather(pool: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The slices of ``pool`` on end."""
    total = int(length.sum())
    if not total:
        return pool[:0]
    at = np.ones(total, np.int64)
    used = np.flatnonzero(length > 0)
    s, n = start[used], length[used]
    opens = np.cumsum(n) - n
    at[0] = s[0]
    at[opens[1:]] = s[1:] - (s[:-1] + n[:-1] - 1)
    return pool[np.cumsum(at)]


class SegmentStore:
    """Segment hash -> ids. ``encode`` gets the bytes of new segments and returns ids and their counts."""

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], most: int = MOST):
        self.encode, self.most = encode, most
        self.slots = 1 << (2 * most - 1).bit_length()
        self.table = None  # until the first segment

    def clear(self) -> None:
        self.size = 0
        self.keys = np.zeros(1 << 16, np.uint64)
        self.start = np.zeros(1 << 16, np.int64)
        self.length = np.zeros(1 << 16, np.int64)
        self.used = 0
        self.pool = np.zeros(1 << 18, np.int32)
        self.from_, self.bytes = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.texts, self.filled = np.zeros(1 << 18, np.uint8), 0
        self.table = np.full(self.slots, -1, np.int32)  # open addressing: number of the segment

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key's segment; -1 if it is new."""
        found = np.full(len(keys), -1, np.int64)
        open_, slot = np.arange(len(keys)), (keys & np.uint64(self.slots - 1)).astype(np.int64)
        while len(open_):
            at = self.table[slot].astype(np.int64)
            hit = (at >= 0) & (self.keys[at] == keys[open_])
            found[open_[hit]] = at[hit]
            on = (at >= 0) & ~hit
            open_, slot = open_[on], (slot[on] + 1) & (self.slots - 1)
        return found

    def _add(self, keys: np.ndarray, segments: list[bytes], findable: bool = True) -> np.ndarray:
        """Numbers of the new segments; ``findable`` enters them in the table, each key once."""
        ids, counts = self.encode(segments)
        sizes = np.fromiter(map(len, segments), np.int64, len(segments))
        text = np.frombuffer(b"".join(segments), np.uint8)
        n, m, filled = self.size + len(keys), self.used + len(ids), self.filled + len(text)
        while len(self.keys) < n:
            self.keys, self.start, self.length, self.from_, self.bytes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.keys, self.start, self.length, self.from_, self.bytes))
        while len(self.pool) < m:
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while len(self.texts) < filled:
            self.texts = np.concatenate([self.texts, np.zeros_like(self.texts)])
        self.pool[self.used : m] = ids
        self.texts[self.filled : filled] = text
        self.keys[self.size : n] = keys
        self.start[self.size : n] = self.used + np.cumsum(counts) - counts
        self.length[self.size : n] = counts
        self.from_[self.size : n] = self.filled + np.cumsum(sizes) - sizes
        self.bytes[self.size : n] = sizes
        new = np.arange(self.size, n, dtype=np.int32)
        number = new if findable else new[:0]
        slot = (keys[: len(number)] & np.uint64(self.slots - 1)).astype(np.int64)
        while len(number):
            free = self.table[slot] < 0
            self.table[slot[free]] = number[free]
            on = self.table[slot] != number
            number, slot = number[on], (slot[on] + 1) & (self.slots - 1)
        self.size, self.used, self.filled = n, m, filled
        return new

    def _others(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The spans whose bytes are not those of the segments ``at``, of equal hash."""
        size = end - start
        wrong = self.bytes[at] != size
        alike = np.flatnonzero(~wrong & (size > 0))
        differs = gather(data, start[alike], size[alike]) != gather(self.texts, self.from_[at[alike]], size[alike])
        if differs.any():
            ends = np.cumsum(size[alike])
            wrong[alike[np.unique(np.searchsorted(ends, np.flatnonzero(differs), "right"))]] = True
        return np.flatnonzero(wrong)

    def spans(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each span of ``data``: where its ids stand in the pool, and how many they are."""
        keys = span_hashes(data, start, end)
        if self.table is None or self.size + len(keys) > self.most:
            self.clear()
        at = self._find(keys)
        missing = np.flatnonzero(at < 0)
        if len(missing):
            new, first = np.unique(keys[missing], return_index=True)
            first = missing[first]
            buffer = data.tobytes()
            self._add(new, [buffer[a:b] for a, b in zip(start[first].tolist(), end[first].tolist())])
            at[missing] = self._find(keys[missing])
        other = self._others(data, start, end, at)
        if len(other):  # encoded on their own
            buffer = data.tobytes()
            at[other] = self._add(keys[other], [buffer[a:b] for a, b in zip(start[other].tolist(), end[other].tolist())], findable=False)
        return self.start[at], self.length[at]
