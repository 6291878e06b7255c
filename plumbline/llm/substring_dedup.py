"""Exact repeats of 13 words (operator 5) by fixed-block anchors.

Every document gives non-overlapping blocks of 7 words, at places 0, 7, 14 and so on: the index. Any
window of 13 words contains at least one whole block, so a window that stands in two documents has,
at the place of the other document's block, a rolling 7-word window equal to that block. All rolling
windows are probed against the index; hits are extended to 13-word windows, which are compared by
hash over both sides, and runs of equal windows merge to maximal repeats.

Work is dealt by *chunks* (documents by hash of doc_id, about ``CHUNK_BYTES`` of text each) and by
*buckets* (ranges of the hash). A chunk sends each bucket its distinct hashes only, so a passage that
a third of all documents share counts once per chunk; the reply carries the smallest doc_id, never
the documents that share a hash, and no pairs are formed. The chunked texts are shuffled once and
that exchange is read by all three passes.

A 13-word window is identified by 64 bits inside its bucket; the bucket number comes from a second,
independent hash, so the number of identifying bits grows with the data.

Defined results: a null text has no words and stays empty; texts under 13 words are kept; equal rows
with one doc_id do not remove each other; a null doc_id counts as larger than all others; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.word_arrays import Words, mix, text_bytes, words

WINDOW = 13
BLOCK = (WINDOW + 1) // 2
CHUNK_BYTES = 4_000_000
CHUNKS_PER_BUCKET = 4
MOST_BUCKETS = 1 << 30  # a code has 32 bits beside the bucket and the flag; reached at 16 PB
_LAST = np.iinfo(np.int64).max

SENT = "bucket long, chunk long, keys binary, blocks binary, doc_ids binary"
REPLY = "chunk long, bucket long, keys binary, doc_ids binary"
OUT = "doc_id long, n_words long, n_removed long, kept_text string, removed array<struct<start:int,stop:int>>"


def _doc_ids(table: pa.Table) -> np.ndarray:
    return pc.fill_null(table.column("doc_id").combine_chunks(), _LAST).to_numpy(zero_copy_only=False).astype(np.int64)


def _text(table: pa.Table) -> pa.Array:
    column = table.column("text").cast(pa.large_string()).combine_chunks()
    return column.chunk(0) if isinstance(column, pa.ChunkedArray) else column


def _anchors(w: Words, n_buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each rolling 7-word window: is it whole, its bucket, its 32-bit key."""
    h = w.windows(BLOCK)
    return w.whole(BLOCK), ((h >> np.uint64(32)) % np.uint64(n_buckets)).astype(np.int64), h.astype(np.uint32)


def _windows(w: Words, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """For each 13-word window: its bucket, and its 64-bit key from an independent hash."""
    return (w.windows(WINDOW, 1) % np.uint64(n_buckets)).astype(np.int64), w.windows(WINDOW, 2)


def _planes(x: np.ndarray) -> bytes:
    """Byte planes of 64-bit numbers, which the shuffle's codec shrinks well."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _from_planes(b: bytes, kind: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(8, -1).T).reshape(-1).view("<u8").astype(kind)


def _rows(columns: dict[str, list], schema: list[tuple[str, pa.DataType]]) -> pa.Table:
    return pa.table({name: pa.array(columns[name], kind) for name, kind in schema})


_SENT = [("bucket", pa.int64()), ("chunk", pa.int64()), ("keys", pa.binary()), ("blocks", pa.binary()), ("doc_ids", pa.binary())]
_REPLY = [("chunk", pa.int64()), ("bucket", pa.int64()), ("keys", pa.binary()), ("doc_ids", pa.binary())]


def _runs(sorted_values: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values, and the length at the end."""
    if not len(sorted_values):
        return np.zeros(1, np.int64)
    return np.concatenate([[0], np.flatnonzero(sorted_values[1:] != sorted_values[:-1]) + 1, [len(sorted_values)]])


def _send_anchors(n_buckets: int):
    def send(key, table):
        w = words(_text(table))
        whole, bucket, small = _anchors(w, n_buckets)
        code = (bucket.astype(np.uint64) << np.uint64(32) | small)[whole]
        block = (w.place[: len(whole)] % BLOCK == 0)[whole]
        # the block flag in the lowest place: of equal codes the last one tells whether any is a block
        tagged = np.unique(code << np.uint64(1) | block)
        code = tagged >> np.uint64(1)
        last = np.ones(len(code), bool)
        last[:-1] = code[1:] != code[:-1]
        code, block = code[last], (tagged & np.uint64(1)).astype(bool)[last]
        out = {name: [] for name, _ in _SENT}
        of = (code >> np.uint64(32)).astype(np.int64)
        small = code.astype(np.uint32)
        cuts = _runs(of)
        for a, b in zip(cuts[:-1], cuts[1:]):
            own, flags = small[a:b], block[a:b]
            out["bucket"].append(int(of[a]))
            out["chunk"].append(key[0].as_py())
            out["keys"].append(own[~flags].tobytes())
            out["blocks"].append(own[flags].tobytes())
            out["doc_ids"].append(None)
        return _rows(out, _SENT)

    return send


def _match_anchors(key, table):
    """Keys that two or more chunks sent and that are a block of at least one."""
    chunks = table.column("chunk").to_pylist()
    keys, sender, block = [], [], []
    for k, (probes, blocks) in enumerate(zip(table.column("keys").to_pylist(), table.column("blocks").to_pylist())):
        for raw, flag in ((probes, False), (blocks, True)):
            part = np.frombuffer(raw, np.uint32)
            keys.append(part)
            sender.append(np.full(len(part), k, np.int32))
            block.append(np.full(len(part), flag))
    keys, sender, block = np.concatenate(keys), np.concatenate(sender), np.concatenate(block)
    order = np.argsort(keys, kind="stable")
    keys, sender, block = keys[order], sender[order], block[order]
    cuts = _runs(keys)
    shared = (np.diff(cuts) > 1) & (np.add.reduceat(block.astype(np.int32), cuts[:-1]) > 0 if len(keys) else np.zeros(0, bool))
    hit = np.repeat(shared, np.diff(cuts))
    keys, sender = keys[hit], sender[hit]
    order = np.argsort(sender, kind="stable")
    keys, sender = keys[order], sender[order]
    cuts = _runs(sender)
    out = {name: [] for name, _ in _REPLY}
    for a, b in zip(cuts[:-1], cuts[1:]):
        out["chunk"].append(chunks[sender[a]])
        out["bucket"].append(key[0].as_py())
        out["keys"].append(keys[a:b].tobytes())
        out["doc_ids"].append(None)
    return _rows(out, _REPLY)


def _send_windows(n_buckets: int):
    def send(key, texts, reply):
        """13-word windows around anchor hits, with the smallest doc_id of the chunk."""
        ids, w = _doc_ids(texts), words(_text(texts))
        whole, bucket, small = _anchors(w, n_buckets)
        code = bucket.astype(np.uint64) << np.uint64(32) | small
        hit = np.zeros(len(code), bool)
        known = [np.uint64(b) << np.uint64(32) | np.frombuffer(k, np.uint32) for b, k in zip(reply.column("bucket").to_pylist(), reply.column("keys").to_pylist())]
        if known:
            known = np.sort(np.concatenate(known))
            hit = known[np.minimum(np.searchsorted(known, code), len(known) - 1)] == code
        # windows that several documents of this very chunk hold
        order = np.argsort(code, kind="stable")
        cuts = _runs(code[order])
        if len(code):
            owner = ids[w.doc[: len(code)]][order]
            several = np.minimum.reduceat(owner, cuts[:-1]) != np.maximum.reduceat(owner, cuts[:-1])
            hit[order[np.repeat(several, np.diff(cuts))]] = True
        hit &= whole
        n = max(0, len(w.hash) - WINDOW + 1)
        sums = np.concatenate([[0], np.cumsum(hit)])
        near = w.whole(WINDOW) & (sums[WINDOW - BLOCK + 1 :][:n] > sums[:n]) if n else np.zeros(0, bool)
        out = {name: [] for name, _ in _SENT}
        if near.any():
            of, long = _windows(w, n_buckets)
            of, long, owner = of[near], long[near], ids[w.doc[:n][near]]
            order = np.lexsort((owner, long, of))
            of, long, owner = of[order], long[order], owner[order]
            first = np.ones(len(of), bool)
            first[1:] = (of[1:] != of[:-1]) | (long[1:] != long[:-1])
            of, long, owner = of[first], long[first], owner[first]
            cuts = _runs(of)
            for a, b in zip(cuts[:-1], cuts[1:]):
                out["bucket"].append(int(of[a]))
                out["chunk"].append(key[0].as_py())
                out["keys"].append(long[a:b].tobytes())
                out["blocks"].append(None)
                out["doc_ids"].append(_planes(owner[a:b]))
        return _rows(out, _SENT)

    return send


def _match_windows(key, table):
    """For each chunk the windows of which another chunk has a smaller doc_id."""
    chunks = table.column("chunk").to_pylist()
    raw = [np.frombuffer(k, np.uint64) for k in table.column("keys").to_pylist()]
    keys = np.concatenate(raw)
    ids = np.concatenate([_from_planes(b, np.int64) for b in table.column("doc_ids").to_pylist()])
    sender = np.repeat(np.arange(len(raw)), [len(k) for k in raw])
    order = np.argsort(keys, kind="stable")
    keys, ids, sender = keys[order], ids[order], sender[order]
    cuts = _runs(keys)
    least = np.repeat(np.minimum.reduceat(ids, cuts[:-1]), np.diff(cuts)) if len(ids) else ids
    later = ids > least
    keys, least, sender = keys[later], least[later], sender[later]
    order = np.argsort(sender, kind="stable")
    keys, least, sender = keys[order], least[order], sender[order]
    cuts = _runs(sender)
    out = {name: [] for name, _ in _REPLY}
    for a, b in zip(cuts[:-1], cuts[1:]):
        out["chunk"].append(chunks[sender[a]])
        out["bucket"].append(key[0].as_py())
        out["keys"].append(keys[a:b].tobytes())
        out["doc_ids"].append(_planes(least[a:b]))
    return _rows(out, _REPLY)


def _remove(n_buckets: int):
    def remove(key, texts, reply):
        ids, column = _doc_ids(texts), _text(texts)
        w = words(column)
        n = max(0, len(w.hash) - WINDOW + 1)
        gone = np.zeros(len(w.hash), bool)
        if n:
            (of, long), whole = _windows(w, n_buckets), w.whole(WINDOW)
            owner = ids[w.doc[:n]]
            # the smallest doc_id that a window has in this chunk or by the replies
            told = [(np.full(len(k) // 8, b), np.frombuffer(k, np.uint64), _from_planes(d, np.int64)) for b, k, d in zip(*(reply.column(c).to_pylist() for c in ("bucket", "keys", "doc_ids")))]
            of = np.concatenate([of[whole], *(t[0] for t in told)])
            long = np.concatenate([long[whole], *(t[1] for t in told)])
            holder = np.concatenate([owner[whole], *(t[2] for t in told)])
            order = np.lexsort((of, long))
            of, long, holder = of[order], long[order], holder[order]
            cuts = np.concatenate([[0], np.flatnonzero((of[1:] != of[:-1]) | (long[1:] != long[:-1])) + 1, [len(of)]]) if len(of) else np.zeros(1, np.int64)
            if len(of):
                least = np.empty(len(of), np.int64)
                least[order] = np.repeat(np.minimum.reduceat(holder, cuts[:-1]), np.diff(cuts))
                repeated = np.zeros(n, bool)
                repeated[whole] = least[: int(whole.sum())] < owner[whole]
                edge = np.zeros(len(w.hash) + 1, np.int32)
                at = np.flatnonzero(repeated)
                np.add.at(edge, at, 1)
                np.add.at(edge, at + WINDOW, -1)
                gone = np.cumsum(edge[:-1]) > 0
        data, at = text_bytes(column)
        buffer = data.tobytes()
        stop = np.cumsum(w.per_doc)
        start = stop - w.per_doc
        lost = np.concatenate([[0], np.cumsum(gone)])
        n_removed = lost[stop] - lost[start]
        kept, spans = [], []
        for k in range(len(ids)):
            own = buffer[at[k] : at[k + 1]].split()
            if n_removed[k]:
                flags = gone[start[k] : stop[k]]
                own = list(compress(own, ~flags))
                turn = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
                spans.append([{"start": int(a), "stop": int(b)} for a, b in zip(turn[::2], turn[1::2])])
            else:
                spans.append([])
            kept.append(b" ".join(own).decode())
        span = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
        return pa.table({"doc_id": texts.column("doc_id").combine_chunks().cast(pa.int64()), "n_words": pa.array(w.per_doc, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_text": pa.array(kept, pa.string()), "removed": pa.array(spans, span)})

    return remove


def remove_repeats(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Per document: its words, how many lie in windows that start in a document with a smaller
    doc_id, the text without them, and the removed spans as word places. Rows are dealt to chunks by id and
    text, so those without an id are spread like all others."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_chunks = max(1, -(-size // chunk_bytes))
    n_buckets = min(MOST_BUCKETS, max(1, -(-n_chunks // CHUNKS_PER_BUCKET)))
    texts = docs.select("doc_id", "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_chunks)).alias("chunk")).repartition("chunk")
    anchors = texts.groupBy("chunk").applyInArrow(_send_anchors(n_buckets), SENT)
    hits = anchors.groupBy("bucket").applyInArrow(_match_anchors, REPLY)
    windows = texts.groupBy("chunk").cogroup(hits.groupBy("chunk")).applyInArrow(_send_windows(n_buckets), SENT)
    repeats = windows.groupBy("bucket").applyInArrow(_match_windows, REPLY)
    return texts.groupBy("chunk").cogroup(repeats.groupBy("chunk")).applyInArrow(_remove(n_buckets), OUT)


def op5_fixed_block_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


QUERIES = {"op5_fixed_block_repeats": op5_fixed_block_repeats}
ORACLE_SQL = {
    "op5_fixed_block_repeats": f"""
WITH w AS (
  SELECT doc_id, coalesce(list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda x: length(x) > 0), []) AS words FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(words[i:i+{WINDOW - 1}], ' ') AS s
  FROM (SELECT doc_id, words, unnest(generate_series(1, len(words) - {WINDOW - 1})) AS i FROM w WHERE len(words) >= {WINDOW})),
first AS (SELECT s, min(doc_id) AS first_id FROM win GROUP BY s),
gone AS (
  SELECT DISTINCT doc_id, i + k AS i FROM win JOIN first USING (s), (SELECT unnest(generate_series(0, {WINDOW - 1})) AS k)
  WHERE first_id < doc_id),
per_word AS (
  SELECT w.doc_id, p.i, words[p.i] AS word, g.i IS NOT NULL AS lost
  FROM (SELECT doc_id, words, unnest(generate_series(1, len(words))) AS i FROM w) p
  JOIN w USING (doc_id) LEFT JOIN gone g ON g.doc_id = p.doc_id AND g.i = p.i),
kept AS (
  SELECT doc_id, count(*) FILTER (WHERE lost) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT lost) AS text
  FROM per_word GROUP BY doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM w LEFT JOIN kept k ON w.doc_id = k.doc_id""".replace("words[p.i] AS word", "p.words[p.i] AS word"),
}
