"""SentencePiece encoding and decoding (operator 10) as a max-plus parallel scan.

The vocabulary's pieces and scores define the best segmentation of a text: the one with the largest
sum of scores (unigram Viterbi). Cut anywhere, a text's part has a *transfer matrix* T over boundary
states: T[i, j] is the best score of its own pieces if the piece that crosses into it covers its
first i bytes and its own last piece covers j bytes beyond it. The matrix of two parts on end is the
max-plus product of theirs, which is associative. Hence

* documents of more than ``CHUNK_BYTES`` are dealt out as chunks, cut between characters in one pass
  over the bytes; each chunk's matrix is computed on its own. The matrices are combined as an
  associative scan: ``FAN`` neighbours at a time are multiplied pair by pair to the matrix of their
  block, the blocks' matrices again, until one block is left (up), and the states with which blocks are
  entered go down the same tree to the chunks. Every chunk is then backtraced on its own from each
  state in which it can be left, and a pass over these small tables picks the states, and so the pieces;
* where no piece that occurs crosses a place, the only state is 0 and the matrix a single number:
  between two such places the best pieces depend on nothing else, and each distinct segment is solved
  once per worker (``SegmentStore``). No piece crosses from a character into a space; in long spans
  without spaces (Chinese, Japanese, Thai) such places are found by looking up all their substrings at
  once. Whole documents up to ``CHUNK_BYTES`` are sums of such segments.

Scores are exact integers. Ties go to the longer last piece, as in the library's own unigram search.
A character outside the vocabulary costs the lowest score less 10 and becomes byte pieces.

The one SentencePiece file at hand holds a BPE model, whose greedy merges have no max-plus form; its
pieces and scores are used here as a unigram model (see the README).

Defined results: a null or empty text has no pieces and decodes to an empty text; the character
U+2581 counts as a space, as in the library; repeated rows are each encoded; other columns are
ignored; an empty table gives no rows. A row of the table is a row of the result, so a text's ids come
together in one row, as its bytes did: a document is bounded by what a row may hold (2 GB).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.segments import SegmentStore, gather
from plumbline.llm.word_arrays import _power_table, slices, text_bytes
from plumbline.session import written

CHUNK_BYTES = 32_768
FAN = 64
SLICE_BYTES = 1_000_000
STORED = 1_000_000  # distinct segments a worker keeps
LOOK_BYTES = 256  # no piece is longer
NEVER = -(1 << 62)
SHORT = 64
_B = 0x9E3779B97F4A7C15
_INV = pow(_B, -1, 1 << 64)
_SLOT_BITS = 20
_SPREAD = 0xD1342543DE82EF95

ENCODED = "doc_id long, text_crc32 long, n_pieces long, score long, ids binary"


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def maxplus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The max-plus product; ``NEVER`` absorbs."""
    out = (a[..., :, :, None] + b[..., None, :, :]).max(axis=-2)
    return np.where(out < NEVER // 2, NEVER, out)


class Pieces:
    """The vocabulary, and the best segmentation by it."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.byte_id = np.zeros(256, np.int64)
        self.score = np.zeros(n, np.int64)
        self.bytes: list[bytes] = [b""] * n
        self.id: dict[bytes, int] = {}
        for i in range(n):
            if model.is_byte(i):
                value = int(model.id_to_piece(i)[1:-1], 16)
                self.byte_id[value], self.bytes[i] = i, bytes([value])
            elif not (model.is_unknown(i) or model.is_control(i) or model.is_unused(i)):
                self.bytes[i] = model.id_to_piece(i).replace("▁", " ").encode()
                self.id[self.bytes[i]] = i
                self.score[i] = round(model.get_score(i))
        self.unknown = int(min(self.score[list(self.id.values())])) - 10
        # an unknown character's cost stands on its first byte
        for value in range(256):
            self.score[self.byte_id[value]] = 0 if value & 0xC0 == 0x80 else self.unknown
        self.longest = max(map(len, self.id))
        self.by_first = np.zeros(256, np.int64)
        for piece in self.id:
            self.by_first[piece[0]] = max(self.by_first[piece[0]], len(piece))
        self.power = [pow(_B, k, 1 << 64) for k in range(SHORT + 1)]
        self.inverse = [pow(_INV, k, 1 << 64) for k in range(SHORT + 1)]
        self.keys = np.zeros(1 << _SLOT_BITS, np.uint64)
        self.slots = np.full(1 << _SLOT_BITS, -1, np.int32)
        for piece, i in self.id.items():
            if len(piece) <= SHORT:
                key = sum((b + 1) * self.power[k] for k, b in enumerate(piece)) & (2**64 - 1)
                slot = ((key * _SPREAD) & (2**64 - 1)) >> (64 - _SLOT_BITS)
                while self.slots[slot] >= 0:
                    slot = (slot + 1) & ((1 << _SLOT_BITS) - 1)
                self.keys[slot], self.slots[slot] = key, i
        self.store = SegmentStore(self.encode_segments, STORED)
        self.pool = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.width = np.array([len(b) for b in self.bytes], np.int64)
        self.at = np.cumsum(self.width) - self.width

    def _lookup(self, keys: np.ndarray) -> np.ndarray:
        slot = ((keys * np.uint64(_SPREAD)) >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)
        ids = np.where(self.keys[slot] == keys, self.slots[slot], -1)
        on = np.flatnonzero((ids < 0) & (self.slots[slot] >= 0))
        while len(on):
            slot[on] = (slot[on] + 1) & ((1 << _SLOT_BITS) - 1)
            ids[on] = np.where(self.keys[slot[on]] == keys[on], self.slots[slot[on]], -1)
            on = on[(ids[on] < 0) & (self.slots[slot[on]] >= 0)]
        return ids

    def encode_segments(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the best segmentation of each segment, on end, and their counts."""
        sizes = np.array([len(p) for p in pieces], np.int64)
        lanes, place, ids = [], [], []
        for low, high in ((0, 4), (4, 8), (8, 12), (12, 18), (18, 32), (32, SHORT)):
            own = np.flatnonzero((sizes > low) & (sizes <= high))
            for a in range(0, len(own), 20_000):
                part = own[a : a + 20_000]
                lane, at, i = self._lanes([pieces[k] for k in part], sizes[part], high)
                lanes.append(part[lane])
                place.append(at)
                ids.append(i)
        for k in np.flatnonzero(sizes > SHORT):
            own, _ = self.path(pieces[k], {0: 0}, len(pieces[k]))[0]
            lanes.append(np.full(len(own), k))
            place.append(np.arange(len(own)))
            ids.append(np.array(own, np.int64))
        if not lanes:
            return np.zeros(0, np.int32), np.zeros(len(pieces), np.int64)
        lanes, place, ids = np.concatenate(lanes), np.concatenate(place), np.concatenate(ids)
        order = np.lexsort((place, lanes))
        return ids[order].astype(np.int32), np.bincount(lanes, minlength=len(pieces))

    def _lanes(self, pieces: list[bytes], sizes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All segments step by step at once: (segment, end of piece, id) of the best paths."""
        n = len(pieces)
        data = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)
        columns = np.ascontiguousarray(data.T)
        sums = np.zeros((width + 1, n), np.uint64)
        for k in range(width):
            sums[k + 1] = sums[k] + (columns[k].astype(np.uint64) + np.uint64(1)) * np.uint64(self.power[k])
        best = np.full((width + 1, n), NEVER, np.int64)
        best[0] = 0
        step = np.zeros((width + 1, n), np.int8)
        last = np.full((width + 1, n), -1, np.int32)
        lead = np.where(columns < 0x80, 1, np.where(columns >= 0xF0, 4, np.where(columns >= 0xE0, 3, np.where(columns >= 0xC0, 2, 0))))
        reach = self.by_first[columns]
        for p in range(width):
            live = np.flatnonzero((best[p] > NEVER) & (sizes > p))
            single = np.zeros(n, bool)
            for k in range(1, min(self.longest, width - p) + 1):
                live = live[(reach[p][live] >= k) & (sizes[live] >= p + k)]
                if not len(live):
                    break
                ids = self._lookup((sums[p + k][live] - sums[p][live]) * np.uint64(self.inverse[p]))
                hit = ids >= 0
                at, ids = live[hit], ids[hit]
                single[at[lead[p][at] == k]] = True
                value = best[p][at] + self.score[ids]
                up = value > best[p + k][at]
                at = at[up]
                best[p + k][at], step[p + k][at], last[p + k][at] = value[up], k, ids[up]
            at = np.flatnonzero((best[p] > NEVER) & (sizes > p) & ~single & (lead[p] > 0))
            for k in range(1, 5):
                own = at[(lead[p][at] == k) & (sizes[at] >= p + k)]
                if len(own):
                    value = best[p][own] + self.unknown
                    up = value > best[p + k][own]
                    own = own[up]
                    best[p + k][own], step[p + k][own], last[p + k][own] = value[up], k, -1
        lanes, place, found = [], [], []
        lane, at = np.arange(n), sizes.copy()
        while len(lane):
            i, k = last[at, lane], step[at, lane].astype(np.int64)
            known = i >= 0
            lanes.append(lane[known])
            place.append(at[known])
            found.append(i[known].astype(np.int64))
            for j in range(4):
                odd = np.flatnonzero(~known & (k > j))
                if len(odd):
                    lanes.append(lane[odd])
                    place.append(at[odd] - j)
                    found.append(self.byte_id[columns[at[odd] - j - 1, lane[odd]]])
            at = at - k
            lane, at = lane[at > 0], at[at > 0]
        return np.concatenate(lanes), np.concatenate(place), np.concatenate(found)

    def lattice(self, data: bytes, entry: dict[int, int], own: int) -> tuple[list[int], list[tuple[int, int] | None]]:
        """Best scores of all places of ``data`` from the scores of the entry states; only pieces
        that begin within the first ``own`` bytes are set."""
        best: list[int] = [NEVER] * (own + self.longest + 4)
        last: list[tuple[int, int] | None] = [None] * len(best)
        for i, v in entry.items():
            best[i] = v
        get, score, reach, unknown = self.id.get, self.score, self.by_first, self.unknown
        for p in range(own):
            here = best[p]
            if here == NEVER:
                continue
            b = data[p]
            size = 1 if b < 0x80 else 4 if b >= 0xF0 else 3 if b >= 0xE0 else 2
            single = False
            for k in range(1, min(int(reach[b]), len(data) - p) + 1):
                i = get(data[p : p + k])
                if i is not None:
                    single |= k == size
                    v = here + int(score[i])
                    if v > best[p + k]:
                        best[p + k], last[p + k] = v, (p, i)
            if not single and here + unknown > best[p + size]:
                best[p + size], last[p + size] = here + unknown, (p, -1)
        return best, last

    def path(self, data: bytes, entry: dict[int, int], own: int) -> dict[int, tuple[list[int], int]]:
        """For each state in which ``own`` bytes can be left: the ids set within, and the entry state."""
        best, last = self.lattice(data, entry, own)
        out = {}
        for j in range(len(best) - own):
            if best[own + j] == NEVER:
                continue
            ids, at = [], own + j
            while last[at] is not None:
                p, i = last[at]
                ids += [i] if i >= 0 else self.byte_id[np.frombuffer(data[p:at], np.uint8)[::-1]].tolist()
                at = p
            out[j] = (ids[::-1], at)
        return out

    def free_places(self, data: np.ndarray) -> np.ndarray:
        """Which of the places 0 to n of ``data`` begin a character and are crossed by no piece that stands
        in it: all substrings that may be pieces are looked up at once, one length after another."""
        n = len(data)
        change = np.zeros(n + self.longest + 1, np.int32)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power_table(np.uint64(_B), n), out=sums[1:])
        inverse = _power_table(np.uint64(_INV), n + 1)
        live = np.flatnonzero(self.by_first[data] >= 2)
        for k in range(2, min(self.longest, n) + 1):
            live = live[(self.by_first[data[live]] >= k) & (live + k <= n)]
            if not len(live):
                break
            if k > SHORT:  # not in the table: a piece may start at any of these
                at = live
            else:
                at = live[self._lookup((sums[live + k] - sums[live]) * inverse[live]) >= 0]
            np.add.at(change, at + 1, 1)
            np.add.at(change, at + k, -1)
        out = np.cumsum(change[: n + 1]) == 0
        out[:n] &= (data & 0xC0) != 0x80
        return out

    def spans(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Segments: cut before a space that follows another character, at the given offsets, and in long
        spans wherever no piece crosses."""
        n = len(data)
        edge = np.zeros(n + 1, bool)
        edge[1:n] = (data[1:] == 32) & (data[:-1] != 32)
        edge[offsets] = True
        edge[n] = False
        start = np.flatnonzero(edge)
        end = np.append(start[1:], n)[: len(start)]
        for a, b in ((a, b) for a, b in zip(start[end - start > SHORT].tolist(), end[end - start > SHORT].tolist())):
            edge[a:b] |= self.free_places(data[a:b])[:-1]
        start = np.flatnonzero(edge)
        return start, np.append(start[1:], n)[: len(start)]

    def encode_bytes(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts (with their leading space) on end, and how many each has."""
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(offsets) - 1, np.int64)
        start, end = self.spans(data, offsets)
        where, length = self.store.spans(data, start, end)
        total = np.concatenate([[0], np.cumsum(length)])
        return gather(self.store.pool, where, length), total[np.searchsorted(start, offsets[1:])] - total[np.searchsorted(start, offsets[:-1])]

    def _parts(self, chunk: bytes, before: bytes, look: bytes) -> tuple[int, int]:
        """The first and the last place of a chunk that no piece crosses; (-1, -1) if there is none."""
        data = np.frombuffer(chunk, np.uint8)
        at = np.flatnonzero((data[1:] == 32) & (data[:-1] != 32)) + 1
        if chunk[:1] == b" " and before != b" ":
            at = np.concatenate([[0], at])
        if not len(at):
            # a piece that crosses a place this far in starts in this chunk
            at = np.flatnonzero(self.free_places(np.frombuffer(chunk + look, np.uint8))[: len(chunk)])
            at = at[at >= self.longest]
        return (int(at[0]), int(at[-1])) if len(at) else (-1, -1)

    def middles(self, chunks: list[bytes], parts: list[tuple[int, int]]) -> list[np.ndarray]:
        """The ids between the first and the last place of each chunk that no piece crosses, all at once."""
        own = [c[a:b] if a >= 0 else b"" for c, (a, b) in zip(chunks, parts)]
        flat, counts = self.encode_bytes(np.frombuffer(b"".join(own), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in own])]))
        return np.split(flat, np.cumsum(counts)[:-1])

    def transfer(self, chunk: bytes, look: bytes, before: bytes, inner: np.ndarray | None = None, part: tuple[int, int] | None = None) -> np.ndarray:
        """The transfer matrix of a chunk; ``look`` is what follows, ``before`` the byte that precedes."""
        n = self.longest + 4
        out = np.full((n, n), NEVER, np.int64)
        first, last = part or self._parts(chunk, before, look)
        if first < 0:
            for i in range(min(n, len(chunk))):
                if chunk[i] & 0xC0 != 0x80:
                    best = self.lattice(chunk + look, {i: 0}, len(chunk))[0][len(chunk) :]
                    out[i, : len(best)] = best[:n]
            for i in range(len(chunk), n):
                out[i, i - len(chunk)] = 0
            return out
        middle = int(self.score[self.middles([chunk], [(first, last)])[0] if inner is None else inner].sum())
        right = self.lattice(chunk[last:] + look, {0: 0}, len(chunk) - last)[0][len(chunk) - last :]
        for i in range(min(n, first + 1)):
            if i == first or chunk[i] & 0xC0 != 0x80:
                left = 0 if i == first else self.lattice(chunk[:first], {i: 0}, first)[0][first]
                if left > NEVER:
                    for j in range(n):
                        if j < len(right) and right[j] > NEVER:
                            out[i, j] = left + middle + right[j]
        return out

    def backtrace(self, chunk: bytes, look: bytes, before: bytes, entry: dict[int, int], inner: np.ndarray | None = None, part: tuple[int, int] | None = None) -> dict[int, tuple[list[int], int]]:
        """For each state in which the chunk can be left: its ids, and the state in which it is entered."""
        first, last = part or self._parts(chunk, before, look)
        if first < 0:
            return self.path(chunk + look, entry, len(chunk))
        left = self.path(chunk[:first], {i: v for i, v in entry.items() if i <= first}, first)[0] if first else ([], 0)
        middle = (self.middles([chunk], [(first, last)])[0] if inner is None else inner).tolist()
        return {j: (left[0] + middle + ids, left[1]) for j, (ids, _) in self.path(chunk[last:] + look, {0: 0}, len(chunk) - last).items()}

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
        """The texts of id sequences on end; the leading space goes."""
        width = self.width[ids]
        data = gather(self.pool, self.at[ids], width)
        total = np.concatenate([[0], np.cumsum(width)])
        ends = np.cumsum(counts)
        at = total[np.concatenate([[0], ends])]
        keep = np.ones(len(data), bool)
        opens = at[:-1][counts > 0]
        keep[opens[data[opens] == 32]] = False
        kept = np.concatenate([[0], np.cumsum(keep)])
        return pa.Array.from_buffers(pa.large_string(), len(counts), [None, pa.py_buffer(kept[at].astype(np.int64).tobytes()), pa.py_buffer(data[keep].tobytes())])


_loaded: dict[str, Pieces] = {}


def vocabulary(path: str) -> Pieces:
    """One per Python worker."""
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


def normalised(text: Column) -> Column:
    """The text as the model sees it: U+2581 is a space, one space before any text."""
    spaced = F.replace(F.coalesce(text, F.lit("")), F.lit("▁"), F.lit(" "))
    return F.when(F.length(spaced) > 0, F.concat(F.lit(" "), spaced)).otherwise(F.lit(""))


_OUT = ["doc_id", "text_crc32", "n_pieces", "score", "ids"]


def _batch(doc_ids, crcs, flat: np.ndarray, counts: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
    ends = np.cumsum(counts)
    offsets = np.concatenate([[0], ends * 4]).astype(np.int32)
    ids = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(flat.astype("<u4").tobytes())])
    total = np.concatenate([[0], np.cumsum(score[flat])])
    return pa.RecordBatch.from_arrays([doc_ids, crcs, pa.array(counts, pa.int64()), pa.array(total[ends] - total[ends - counts], pa.int64()), ids], names=_OUT)


def _encode_small(docs: DataFrame, model: str) -> DataFrame:
    def run(batches):
        v = vocabulary(model)
        for batch in batches:
            texts = batch.column("text")
            for a, b in slices(texts, SLICE_BYTES):
                data, at = text_bytes(texts.slice(a, b - a))
                flat, counts = v.encode_bytes(data, at)
                yield _batch(batch.column("doc_id").slice(a, b - a), batch.column("text_crc32").slice(a, b - a), flat, counts, v.score)

    return docs.mapInArrow(run, ENCODED)


def cut_bytes(data: np.ndarray, size: int) -> np.ndarray:
    """Ends of chunks of about ``size`` bytes, none inside a character, in one pass."""
    ends = np.arange(size, len(data) + size, size)
    ends[-1] = len(data)
    for _ in range(3):  # a character has at most three further bytes
        inside = ends < len(data)
        inside[inside] = (data[ends[inside]] & 0xC0) == 0x80
        ends[inside] += 1
    return np.unique(ends)


CHUNKS = "row long, seq int, doc_id long, text_crc32 long, n_chunks int, chunk binary, look binary, before binary"
_CHUNK_NAMES = [c.split(" ")[0] for c in CHUNKS.split(", ")]


def text_chunks(docs: DataFrame, chunk_bytes: int) -> DataFrame:
    """The chunks of every text, each with the bytes that follow and the byte that precedes it."""

    def cut(batches):
        for batch in batches:
            texts = batch.column("text")
            for k in range(batch.num_rows):  # a long text at a time
                data, _ = text_bytes(texts.slice(k, 1))
                raw, ends = memoryview(data).cast("B"), cut_bytes(data, chunk_bytes)
                starts = np.concatenate([[0], ends[:-1]])
                for a in range(0, len(ends), FAN):
                    own = [(int(x), int(y)) for x, y in zip(starts[a : a + FAN], ends[a : a + FAN])]
                    same = {name: batch.column(name).slice(k, 1).take(pa.array([0] * len(own))) for name in ("row", "doc_id", "text_crc32")}
                    yield pa.RecordBatch.from_arrays(
                        [
                            same["row"], pa.array(range(a, a + len(own)), pa.int32()), same["doc_id"], same["text_crc32"], pa.array([len(ends)] * len(own), pa.int32()),
                            pa.array([raw[x:y].tobytes() for x, y in own], pa.binary()), pa.array([raw[y : y + LOOK_BYTES].tobytes() for _, y in own], pa.binary()), pa.array([raw[max(0, x - 1) : x].tobytes() for x, _ in own], pa.binary()),
                        ],
                        names=_CHUNK_NAMES,
                    )

    return docs.mapInArrow(cut, CHUNKS)


def _few(rows: list[dict], most: int = 64) -> Iterator[list[dict]]:
    for a in range(0, len(rows), most):
        yield rows[a : a + most]


MATRIX = "row long, seq int, cells binary, scores binary"


def packed(matrix: np.ndarray) -> tuple[bytes, bytes]:
    """The finite cells of a matrix and their scores."""
    finite = np.flatnonzero(matrix.ravel() > NEVER)
    return finite.astype(np.int32).tobytes(), matrix.ravel()[finite].tobytes()


def unpacked(cells: bytes, scores: bytes, n: int) -> np.ndarray:
    m = np.full(n * n, NEVER, np.int64)
    m[np.frombuffer(cells, np.int32)] = np.frombuffer(scores, np.int64)
    return m.reshape(n, n)


def product(matrices: list[np.ndarray]) -> np.ndarray:
    """The max-plus product of neighbours, pair by pair in rounds."""
    while len(matrices) > 1:
        pairs = [maxplus(a, b) for a, b in zip(matrices[::2], matrices[1::2])]
        matrices = pairs + matrices[len(pairs) * 2 :]
    return matrices[0]


def entry_states(made: DataFrame, n_states: int, longest: int, fan: int = FAN) -> DataFrame:
    """(row, seq, entry): the scores of the states in which each chunk is entered, by an associative scan
    over the chunks' matrices. ``longest``: the most chunks of a document. A task holds ``fan`` matrices."""

    def up(key, table):
        table = table.sort_by("seq")
        whole = product([unpacked(c, s, n_states) for c, s in zip(table.column("cells").to_pylist(), table.column("scores").to_pylist())])
        cells, scores = packed(whole)
        return pa.table({"row": pa.array([key[0].as_py()], pa.int64()), "seq": pa.array([key[1].as_py()], pa.int32()), "cells": pa.array([cells], pa.binary()), "scores": pa.array([scores], pa.binary())})

    def down(key, table, above):
        now = np.frombuffer(above.column("entry")[0].as_py(), np.int64).reshape(1, -1)
        table = table.sort_by("seq")
        entries = []
        for c, s in zip(table.column("cells").to_pylist(), table.column("scores").to_pylist()):
            entries.append(now.tobytes())
            now = maxplus(now, unpacked(c, s, n_states))
        return pa.table({"row": table.column("row").combine_chunks(), "seq": table.column("seq").combine_chunks(), "entry": pa.array(entries, pa.binary())})

    block = F.floor(F.col("seq") / fan).cast("int").alias("block")
    if longest <= 1:
        first = np.full(n_states, NEVER, np.int64)
        first[0] = 0
        return made.select("row", "seq", F.lit(first.tobytes()).alias("entry"))
    blocks = written(made.groupBy("row", block).applyInArrow(up, MATRIX), "blocks")
    above = entry_states(blocks, n_states, -(-longest // fan), fan)
    return made.groupBy("row", block).cogroup(above.groupBy("row", "seq")).applyInArrow(down, "row long, seq int, entry binary")


def _encode_giant(docs: DataFrame, model: str, chunk_bytes: int, fan: int) -> DataFrame:
    """Chunk matrices, their scan, and independent backtraces."""
    keyed = docs.withColumn("row", F.monotonically_increasing_id())
    chunks = written(text_chunks(keyed.select("row", "doc_id", "text_crc32", "text"), chunk_bytes).repartition("row", "seq"), "chunks")
    longest = chunks.agg(F.max("n_chunks")).first()[0] or 0

    def prepared(v: Pieces, rows: list[dict]) -> Iterator[tuple[dict, np.ndarray, tuple[int, int]]]:
        parts = [v._parts(r["chunk"], r["before"], r["look"]) for r in rows]
        return zip(rows, v.middles([r["chunk"] for r in rows], parts), parts)

    def matrices(batches):
        v = vocabulary(model)
        for batch in batches:
            made = []
            for rows in _few(batch.select(["chunk", "look", "before"]).to_pylist()):
                made += [packed(v.transfer(r["chunk"], r["look"], r["before"], ids, part)) for r, ids, part in prepared(v, rows)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("seq"), pa.array([c for c, _ in made], pa.binary()), pa.array([s for _, s in made], pa.binary())], names=["row", "seq", "cells", "scores"])

    def backtraces(batches):
        v = vocabulary(model)
        kinds = {"row": pa.int64(), "doc_id": pa.int64(), "text_crc32": pa.int64(), "seq": pa.int32(), "leave": pa.int32(), "enter": pa.int32(), "ids": pa.binary()}
        for batch in batches:
            for rows in _few(batch.to_pylist()):
                out: dict[str, list] = {c: [] for c in kinds}
                for r, middle, part in prepared(v, rows):
                    entry = {i: int(s) for i, s in enumerate(np.frombuffer(r["entry"], np.int64)) if s > NEVER}
                    for leave, (ids, enter) in v.backtrace(r["chunk"], r["look"], r["before"], entry, middle, part).items():
                        for c in ("row", "doc_id", "text_crc32", "seq"):
                            out[c].append(r[c])
                        out["leave"].append(leave)
                        out["enter"].append(enter)
                        out["ids"].append(np.array(ids, "<u4").tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(out[c], kind) for c, kind in kinds.items()], names=list(kinds))

    def resolve(key, table):
        """From the last chunk back: each is left in the state in which the next one is entered."""
        v = vocabulary(model)
        at = {(s, leave): (enter, k) for k, (s, leave, enter) in enumerate(zip(table.column("seq").to_pylist(), table.column("leave").to_pylist(), table.column("enter").to_pylist()))}
        ids, state, chosen = table.column("ids"), 0, []
        for seq in range(max(s for s, _ in at), -1, -1):
            state, k = at[seq, state]
            chosen.append(ids[k].as_py())
        flat = np.frombuffer(b"".join(chosen[::-1]), "<u4").astype(np.int64)
        return pa.Table.from_batches([_batch(table.column("doc_id")[:1].combine_chunks(), table.column("text_crc32")[:1].combine_chunks(), flat, np.array([len(flat)]), v.score)])

    made = written(chunks.mapInArrow(matrices, MATRIX), "matrices")
    entries = entry_states(made, vocabulary(model).longest + 4, longest, fan)
    traced = chunks.join(entries, ["row", "seq"]).mapInArrow(backtraces, "row long, doc_id long, text_crc32 long, seq int, leave int, enter int, ids binary")
    return traced.groupBy("row").applyInArrow(resolve, ENCODED)


def encode(docs: DataFrame, model: str | None = None, chunk_bytes: int = CHUNK_BYTES, fan: int = FAN) -> DataFrame:
    """doc_id, checksum of the normalised text, number of pieces, score, and ids (little-endian
    unsigned 32-bit) of every document."""
    model = model or default_model()
    ready = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised(F.col("text")).alias("text"))
    ready = ready.withColumn("text_crc32", F.crc32(F.expr("substring(text, 2)").cast("binary")))
    small = _encode_small(ready.filter(F.octet_length("text") <= chunk_bytes).select("doc_id", "text", "text_crc32"), model)
    return small.unionByName(_encode_giant(ready.filter(F.octet_length("text") > chunk_bytes), model, chunk_bytes, fan))


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """Adds ``decoded``, the text of the ids, to what ``encode`` returns."""
    model = model or default_model()

    def run(batches):
        v = vocabulary(model)
        for batch in batches:
            sizes = batch.column("n_pieces").to_numpy()
            ends, start = np.cumsum(sizes), 0
            while start < len(sizes):  # some hundred thousand ids at a time
                stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + 400_000, "right")))
                part = batch.slice(start, stop - start)
                flat = np.frombuffer(b"".join(part.column("ids").to_pylist()), "<u4").astype(np.int64)
                yield pa.RecordBatch.from_arrays([*part.columns, v.decode(flat, sizes[start:stop]).cast(pa.string())], names=[*part.schema.names, "decoded"])
                start = stop

    return encoded.mapInArrow(run, ENCODED + ", decoded string")


def digest(docs: DataFrame) -> DataFrame:
    """The encoding of every document, and whether decoding gives the text back."""
    out = decode(encode(docs))
    return out.select("doc_id", "n_pieces", "score", F.crc32("ids").alias("ids_crc32"), (F.crc32(F.col("decoded").cast("binary")) == F.col("text_crc32")).alias("round_trip"))


def op10_piece_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op10_piece_scan": op10_piece_scan}
ORACLE_SQL: dict[str, str] = {}
