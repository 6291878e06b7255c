"""Numpy arrays over the words of a batch of texts, read straight from Arrow's buffers.

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D of the UTF-8 text. Nothing is cut:
a batch is only sliced between documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2_000_000
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[int, np.ndarray] = {}


def _power_table(base: np.uint64, n: int) -> np.ndarray:
    table = _powers.get(int(base))
    if table is None or len(table) < n:
        table = np.full(max(n, 1 << 16), base, np.uint64)
        table[0] = 1
        np.multiply.accumulate(table, out=table)
        _powers[int(base)] = table
    return table[:n]


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser; another salt gives an independent function."""
    z = x + np.uint64((0xD1342543DE82EF95 * (2 * salt + 1)) & (2**64 - 1))
    z ^= z >> np.uint64(30)
    z *= np.uint64(0xBF58476D1CE4E5B9)
    z ^= z >> np.uint64(27)
    z *= np.uint64(0x94D049BB133111EB)
    z ^= z >> np.uint64(31)
    return z


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes; a longer text gets a range of its own."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), np.int64)
    ends, start = np.cumsum(sizes), 0
    while start < len(sizes):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield start, stop
        start = stop


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts on end, and the n + 1 offsets of the texts in them; null is empty."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if data is None or not len(texts):
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


@dataclass
class Words:
    """Words of all texts in order: 64-bit hash, text number, place in the text, and byte span."""

    hash: np.ndarray
    doc: np.ndarray
    place: np.ndarray
    per_doc: np.ndarray
    start: np.ndarray
    end: np.ndarray

    def windows(self, k: int, salt: int = 0) -> np.ndarray:
        """The hash of the ``k`` words from each word on; see ``whole``."""
        step = np.uint64((0xA0761D6478BD642F + 2 * 0x632BE59BD9B4E019 * salt) & (2**64 - 1) | 1)
        if len(self.hash) < k:
            return np.zeros(0, np.uint64)
        n = len(self.hash) - k + 1
        out = self.hash[:n].copy()
        for j in range(1, k):
            out *= step
            out += self.hash[j : j + n]
        return mix(out, salt)

    def whole(self, k: int) -> np.ndarray:
        """Which of ``windows(k)`` lie in one text."""
        if len(self.hash) < k:
            return np.zeros(0, bool)
        return self.doc[: len(self.hash) - k + 1] == self.doc[k - 1 :]


def words(texts: pa.Array) -> Words:
    data, at = text_bytes(texts)
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(none.astype(np.uint64), none, none, np.zeros(len(texts), np.int64), none, none)
    space = _SPACE[data]
    before = np.empty(n, bool)
    before[0], before[1:] = True, space[:-1]
    edges = at[:-1][at[:-1] < n]
    before[edges] = True
    start = np.flatnonzero(before & ~space)
    after = np.empty(n, bool)
    after[-1], after[:-1] = True, space[1:]
    last = at[1:][at[1:] > 0] - 1
    after[last] = True
    end = np.flatnonzero(after & ~space) + 1
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power_table(_BASE, n), out=sums[1:])
    hashes = mix((sums[end] - sums[start]) * _power_table(_BASE_INV, n)[start])
    doc = np.searchsorted(at, start, "right") - 1
    per_doc = np.bincount(doc, minlength=len(texts))
    first = np.cumsum(per_doc) - per_doc
    return Words(hashes, doc, np.arange(len(start)) - first[doc], per_doc, start, end)
