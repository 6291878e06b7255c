"""Token files (operator 9): one wavelet matrix per shard, written and read through Spark.

Documents are range-partitioned by doc_id and sorted; each partition cuts its token stream into
shards of about ``SHARD_TOKENS`` tokens (never inside a document). A shard is one row of a Parquet
folder (zstd): its documents' ids and lengths, and the wavelet matrix of its tokens: for each bit of
the token id, from the highest on, one plane of packed bits, the tokens being sorted stably by that
bit before the next plane; plus a rank directory. ``WaveletMatrix`` answers access, rank, select and
count from the planes alone: rank goes down the planes, select goes back up them, each by the directory.

The files go through Spark's own writer and reader, so any store that Spark knows can hold them.
``read_token_files`` gives the documents back, ``token_counts`` and ``occurrences`` search the planes of
every shard without decoding it.

Defined results: a null or empty text is the end id alone; rows with one doc_id follow one another by
the hash of their texts, nulls first; a null doc_id stands first; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.segments import SegmentStore, gather
from plumbline.llm.word_arrays import slices, text_bytes
from plumbline.session import new_path, written

SHARD_TOKENS = 2_000_000
END_ID = 0
BLOCK_BITS = 512
JOINED = 4096

FILE_SCHEMA = "part int, seq int, bits int, n_tokens long, doc_ids array<long>, lengths array<int>, planes array<binary>, ranks array<binary>, zeros array<int>"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class WaveletMatrix:
    """A sequence of token ids as bit planes with rank directories."""

    def __init__(self, n: int, bits: int, planes: list[bytes], ranks: list[bytes], zeros: list[int]):
        self.n, self.bits, self.zeros = n, bits, zeros
        self.planes = [np.frombuffer(p, np.uint8) for p in planes]
        self.ranks = [np.frombuffer(r, np.uint32) for r in ranks]

    @classmethod
    def build(cls, tokens: np.ndarray, bits: int) -> WaveletMatrix:
        planes, ranks, zeros = [], [], []
        now = tokens.astype(np.uint16 if bits <= 16 else np.uint32)
        for b in range(bits - 1, -1, -1):
            one = (now & now.dtype.type(1 << b)) != 0
            packed = np.packbits(one, bitorder="little")
            per_block = np.add.reduceat(np.bitwise_count(packed).astype(np.uint32), np.arange(0, max(1, len(packed)), BLOCK_BITS // 8)) if len(packed) else np.zeros(0, np.uint32)
            planes.append(packed.tobytes())
            ranks.append(np.concatenate([[0], np.cumsum(per_block)]).astype(np.uint32).tobytes())
            low = np.compress(~one, now)
            zeros.append(len(low))
            now = np.concatenate([low, np.compress(one, now)])
        return cls(len(tokens), bits, planes, ranks, zeros)

    def _ones(self, level: int, i: int) -> int:
        """Set bits of a plane before place ``i``."""
        block = i // BLOCK_BITS
        count = int(self.ranks[level][block])
        rest = np.unpackbits(self.planes[level][block * (BLOCK_BITS // 8) : (i + 7) // 8], bitorder="little")
        return count + int(rest[: i - block * BLOCK_BITS].sum())

    def access(self, i: int) -> int:
        value = 0
        for level in range(self.bits):
            bit = (self.planes[level][i >> 3] >> (i & 7)) & 1
            ones = self._ones(level, i)
            i = self.zeros[level] + ones if bit else i - ones
            value = value << 1 | int(bit)
        return value

    def rank(self, token: int, i: int) -> int:
        """Occurrences of ``token`` before place ``i``."""
        if token >> self.bits:
            return 0
        a = 0
        for level in range(self.bits):
            ones_a, ones_i = self._ones(level, a), self._ones(level, i)
            if token >> (self.bits - 1 - level) & 1:
                a, i = self.zeros[level] + ones_a, self.zeros[level] + ones_i
            else:
                a, i = a - ones_a, i - ones_i
        return i - a

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def _place(self, level: int, bit: int, k: int) -> int:
        """The place of the k-th bit of a plane that is ``bit``: its block by the directory, then within."""
        before = self.ranks[level].astype(np.int64)
        if not bit:
            before = np.minimum(np.arange(len(before)) * BLOCK_BITS, self.n) - before
        block = int(np.searchsorted(before, k, "right")) - 1
        rest = np.unpackbits(self.planes[level][block * (BLOCK_BITS // 8) : (block + 1) * (BLOCK_BITS // 8)], bitorder="little")
        return block * BLOCK_BITS + int(np.flatnonzero(rest == bit)[k - int(before[block])])

    def select(self, token: int, k: int) -> int:
        """The place of the k-th occurrence (from 0); -1 if there are fewer."""
        if token >> self.bits:
            return -1
        a, i = 0, self.n
        for level in range(self.bits):
            ones_a, ones_i = self._ones(level, a), self._ones(level, i)
            if token >> (self.bits - 1 - level) & 1:
                a, i = self.zeros[level] + ones_a, self.zeros[level] + ones_i
            else:
                a, i = a - ones_a, i - ones_i
        if not 0 <= k < i - a:
            return -1
        at = a + k
        for level in range(self.bits - 1, -1, -1):
            bit = token >> (self.bits - 1 - level) & 1
            at = self._place(level, bit, at - self.zeros[level] if bit else at)
        return at

    def tokens(self) -> np.ndarray:
        """The whole sequence, rebuilt from the last plane up."""
        now = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for level in range(self.bits - 1, -1, -1):
            one = np.unpackbits(self.planes[level], count=self.n, bitorder="little").view(bool)
            out = np.empty_like(now)
            z = self.zeros[level]
            out[np.flatnonzero(~one)] = now[:z]
            out[np.flatnonzero(one)] = now[z:] | now.dtype.type(1 << (self.bits - 1 - level))
            now = out
        return now


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E), *range(0x1C, 0x20)]] = True
_SPACES = frozenset(np.flatnonzero(_SPACE).tolist())
_WIDE = {(0xE1, 0x9A), (0xE2, 0x80), (0xE2, 0x81), (0xE3, 0x80)}


def cuts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans that the byte-level pre-tokenizer never joins: cut before a single space that stands
    between characters of which neither is (or might be) white space, and at the texts' ends."""
    n = len(data)
    space = _SPACE[data]
    odd = space.copy()  # bytes next to which nothing is cut
    lead = np.flatnonzero(data >= 0xC2)
    lead = lead[lead + 1 < n]
    a, b = data[lead], data[lead + 1]
    two = lead[(a == 0xC2) & ((b == 0x85) | (b == 0xA0))]
    odd[two] = odd[two + 1] = True
    for x, y in _WIDE:
        three = lead[(a == x) & (b == y)]
        odd[three] = True
        odd[np.minimum(three + 2, n - 1)] = True
    at = np.flatnonzero(data == 0x20)
    at = at[(at > 0) & (at < n - 1)]
    at = at[~odd[at - 1] & ~odd[at + 1]]
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    edge[offsets] = True
    edge[n] = False
    start = np.flatnonzero(edge)
    return start, np.append(start[1:], n)[: len(start)]


class Encoder:
    """The tokenizers library over distinct segments, many to a call."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.bits = max(1, max(vocabulary.values()).bit_length())
        self.width = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for piece, i in vocabulary.items():
            self.width[i] = len(piece)  # a character of a byte-level piece is a byte
        self.store = SegmentStore(self.encode)

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ids = [np.zeros(0, np.int32)]
        counts = np.zeros(len(pieces), np.int64)
        # a segment " x..." may follow any other that ends in a character; the rest is encoded alone
        plain, alone = [], []
        for k, p in enumerate(pieces):
            whole = len(p) > 1 and p[0] == 32 and p[1] not in _SPACES and p[-1] not in _SPACES
            if whole and not p.isascii():
                text = p.decode()
                whole = not (text[1].isspace() or text[-1].isspace())
            (plain if whole else alone).append(k)
        order = plain + alone
        for a in range(0, len(plain), JOINED):
            own = plain[a : a + JOINED]
            got = np.array(self.tokenizer.encode_batch_fast([b"".join(pieces[k] for k in own).decode()], add_special_tokens=False)[0].ids, np.int32)
            ends = np.searchsorted(np.cumsum(self.width[got]), np.cumsum([len(pieces[k]) for k in own])) + 1
            counts[a : a + len(own)] = np.diff(np.concatenate([[0], ends]))
            ids.append(got)
        if alone:
            for k, e in enumerate(self.tokenizer.encode_batch_fast([pieces[k].decode() for k in alone], add_special_tokens=False)):
                counts[len(plain) + k] = len(e.ids)
                ids.append(np.array(e.ids, np.int32))
        flat = np.concatenate(ids)
        opens = np.cumsum(counts) - counts
        back = np.argsort(np.array(order, np.int64), kind="stable")
        return gather(flat, opens[back], counts[back]), counts[back]

    def encode_texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts on end, without end ids, and how many each text has."""
        data, at = text_bytes(texts)
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        start, end = cuts(data, at)
        where, length = self.store.spans(data, start, end)
        total = np.concatenate([[0], np.cumsum(length)])
        return gather(self.store.pool, where, length), total[np.searchsorted(start, at[1:])] - total[np.searchsorted(start, at[:-1])]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per Python worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _shard_row(part, seq, bits, ids, doc_ids, lengths) -> dict:
    tokens = np.concatenate(ids) if ids else np.zeros(0, np.int32)
    m = WaveletMatrix.build(tokens, bits)
    return {"part": part, "seq": seq, "bits": bits, "n_tokens": len(tokens), "doc_ids": doc_ids, "lengths": lengths, "planes": [p.tobytes() for p in m.planes], "ranks": [r.tobytes() for r in m.ranks], "zeros": m.zeros}


_FILE = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("bits", pa.int32()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("planes", pa.list_(pa.binary())), ("ranks", pa.list_(pa.binary())), ("zeros", pa.list_(pa.int32()))])


def write_token_files(docs: DataFrame, path: str, tokenizer: str | None = None, shard_tokens: int = SHARD_TOKENS) -> None:
    """Encodes every text, appends the end id, and writes the shards in ascending doc_id order."""
    tokenizer = tokenizer or default_tokenizer()

    def build(batches):
        enc, seq, held, ids, doc_ids, lengths, part = encoder(tokenizer), 0, 0, [], [], [], None
        for batch in batches:
            texts = batch.column("text")
            numbers = batch.column("doc_id").to_pylist()
            if len(numbers):
                part = batch.column("part")[0].as_py()
            for a, b in slices(texts):
                flat, counts = enc.encode_texts(texts.slice(a, b - a))
                # the end id after each text
                flat = np.insert(flat, np.cumsum(counts), END_ID)
                sizes = counts + 1
                ends, first = np.cumsum(sizes), 0
                while first < len(sizes):
                    done = ends[first] - sizes[first]
                    last = min(len(sizes), int(np.searchsorted(ends, done + shard_tokens - held)) + 1)
                    ids.append(flat[done : ends[last - 1]])
                    lengths += sizes[first:last].tolist()
                    doc_ids += numbers[a + first : a + last]
                    held += len(ids[-1])
                    if held >= shard_tokens:
                        yield pa.RecordBatch.from_pylist([_shard_row(part, seq, enc.bits, ids, doc_ids, lengths)], _FILE)
                        seq, held, ids, doc_ids, lengths = seq + 1, 0, [], [], []
                    first = last
        if doc_ids:
            yield pa.RecordBatch.from_pylist([_shard_row(part, seq, enc.bits, ids, doc_ids, lengths)], _FILE)

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"), F.col("text").isNotNull(), F.crc32(F.col("text").cast("binary")))
    ordered.withColumn("part", F.spark_partition_id()).mapInArrow(build, FILE_SCHEMA).write.option("compression", "zstd").parquet(path)


def shard_starts(spark: SparkSession, path: str) -> DataFrame:
    """(part, seq, shard_start): the ids before each shard, written to the shared folder. One row per shard
    of millions of tokens, whose written size Spark knows when it chooses how to join them."""
    heads = spark.read.schema(FILE_SCHEMA).parquet(path).select("part", "seq", "n_tokens")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # a row per write task
    parts = heads.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    within = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    starts = heads.withColumn("before", F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).join(parts, "part")
    return written(starts.select("part", "seq", (F.col("part_start") + F.col("before")).alias("shard_start")), "starts")


def _shards(batches):
    """(row, wavelet matrix) of one shard after another."""
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1).to_pylist()[0]
            yield row, WaveletMatrix(row["n_tokens"], row["bits"], row["planes"], row["ranks"], row["zeros"])


def read_token_files(spark: SparkSession, path: str, digests: bool = False) -> DataFrame:
    """doc_id, start, n_tokens of every document in the files, and its ids (little-endian unsigned
    32-bit) or, with ``digests``, only their checksum ``ids_crc32``."""

    def decode(batches):
        for row, m in _shards(batches):
            tokens = m.tokens().astype("<u4")
            lengths = np.array(row["lengths"], np.int64)
            ends = np.cumsum(lengths)
            offsets = np.concatenate([[0], ends * 4])
            if digests:
                raw = memoryview(tokens).cast("B")
                last = pa.array([zlib.crc32(raw[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())], pa.int64())
            else:
                last = pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(tokens.tobytes())])
            yield pa.RecordBatch.from_arrays(
                [pa.array(row["doc_ids"], pa.int64()), pa.array(row["shard_start"] + ends - lengths, pa.int64()), pa.array(lengths, pa.int64()), last],
                names=["doc_id", "start", "n_tokens", "ids_crc32" if digests else "ids"],
            )

    files = spark.read.schema(FILE_SCHEMA).parquet(path).join(shard_starts(spark, path), ["part", "seq"])
    return files.mapInArrow(decode, "doc_id long, start long, n_tokens long, " + ("ids_crc32 long" if digests else "ids binary"))


def token_counts(spark: SparkSession, path: str, tokens: list[int]) -> DataFrame:
    """(token, n): how often each of the tokens stands in the files, counted on the planes."""

    def count(batches):
        for _, m in _shards(batches):
            yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.int64()), pa.array([m.count(t) for t in tokens], pa.int64())], names=["token", "n"])

    found = spark.read.schema(FILE_SCHEMA).parquet(path).mapInArrow(count, "token long, n long")
    return found.groupBy("token").agg(F.sum("n").alias("n"))


def occurrences(spark: SparkSession, path: str, token: int) -> DataFrame:
    """(doc_id, place): every occurrence of a token, as a place in its document, by select."""

    def find(batches):
        for row, m in _shards(batches):
            at = np.array([m.select(token, k) for k in range(m.count(token))], np.int64)
            ends = np.cumsum(np.array(row["lengths"], np.int64))
            doc = np.searchsorted(ends, at, "right")
            ids = pa.array(row["doc_ids"], pa.int64()).take(pa.array(doc))
            yield pa.RecordBatch.from_arrays([ids, pa.array(at - np.concatenate([[0], ends])[doc], pa.int64())], names=["doc_id", "place"])

    return spark.read.schema(FILE_SCHEMA).parquet(path).mapInArrow(find, "doc_id long, place long")


def op9_wavelet_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens")
    write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return read_token_files(spark, path, digests=True).select("doc_id", "start", "n_tokens", "ids_crc32")


QUERIES = {"op9_wavelet_token_files": op9_wavelet_token_files}
ORACLE_SQL: dict[str, str] = {}
