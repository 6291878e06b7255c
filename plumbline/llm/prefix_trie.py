"""Conversation prefix trie (operator 12) from padded turn-id matrices.

A turn is known by 128 bits of the SHA-256 of its role and text, a conversation by the row of its turns'
ids. Equal conversations become one row with their number first, so that copies, however many, weigh
no more than one. Rows are dealt to range shards by their bytes, in which every prefix is a
run of neighbours. A shard pads its rows to a matrix of turn ids, sorts it by numpy's lexsort and goes
through the columns: where a row differs from the one before in this column or an earlier one (masks
accumulated by OR) a node starts, and ``reduceat`` adds up what lies in each. Columns come in blocks of
``COLUMNS``, each over the rows that reach it, so one long conversation does not widen the matrix of all.
From the last column back, children are added to their parents.

Only the nodes on the paths of a shard's first and last row can go on in another shard. They are handed
on as partial sums and recombine 64 neighbouring shards at a time, in as many rounds as it takes: inside such
a group they become whole, but for the paths at its own ends. Nothing grows with the data but the
number of shards; a first turn that a third of all conversations share is one partial row in each of its
shards. Nodes whose parent was a boundary node get its smallest member by ``join_by_key``.

The hash over a node's ending members needs them in order: ids are sorted in range partitions, packed to
texts of up to ``PACK`` ids, and a conversation's texts go one after the other through one SHA-256.

Defined results: rows without conv_id are left out; turns of equal number go by role and text; a null
role or text is empty; a null turn goes first; a repeated row is a turn of its own; a conversation without
turns ends at the root; an empty table gives no rows, no root either; other columns are ignored. A task
holds at least one whole conversation, 24 bytes a turn.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.hilbert_shards import _crc_sql
from plumbline.llm.hot_keys import join_by_key
from plumbline.session import written

WORD = r"[^\x20\x09-\x0D]+"
SHARED = 20  # conversations that take their first turns from one
ID_BYTES = 16
SHARD_TURNS = 200_000
COLUMNS = 16
GROUP = 64
PACK = 4096
NO_MEMBERS = hashlib.sha256(b"").hexdigest()


# --- sequences --------------------------------------------------------------------------------------


def turn_sequences(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): each conversation's turns in order, as (id in hexadecimal, number of words)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    turn = F.struct(F.col("turn"), role.alias("role"), F.sha2(text.cast("binary"), 256).alias("order"), F.substring(F.sha2(whole.cast("binary"), 256), 1, 2 * ID_BYTES).alias("id"), F.regexp_count(text, F.lit(WORD)).alias("words"))
    known = conversations.filter(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t"))
    lists = known.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    return lists.select("conv_id", F.transform("t", lambda x: F.struct(x["id"].alias("id"), x["words"].alias("words"))).alias("turns"))


def rebuilt(sequences: DataFrame) -> DataFrame:
    """Every conversation with its first turns taken from the one that its number's twenty begins with."""
    first = sequences.filter(F.col("conv_id") % SHARED == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, 3).alias("first"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4).cast("int")
    own = sequences.withColumns({"base": F.col("conv_id") - F.col("conv_id") % SHARED, "h": h})
    none = F.array().cast("array<struct<id:string,words:int>>")
    taken = F.slice(F.coalesce("first", none), F.lit(1), F.col("h"))
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    return own.join(first, "base", "left").select("conv_id", F.concat(taken, rest).alias("turns"))


PACKED = "key binary, first long, n long, ids binary"
ENDS = "key binary, n long, conv_id long, ends_sha256 string"


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, np.ndarray]]:
    """Runs of equal keys within a batch of rows sorted by key and conv_id."""
    for batch in batches:
        if not len(batch):
            continue
        keys = np.array(batch.column("key").to_pylist(), dtype=object)
        ids = batch.column("conv_id").to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for a, b in zip(cuts, cuts[1:]):
            yield keys[a], ids[a:b]


def ending_members(members: DataFrame) -> DataFrame:
    """For each key of ``members(key, conv_id)``: how many members, the smallest, and the hash of all."""

    def pack(batches):
        for key, ids in _runs(batches):
            parts = [ids[a : a + PACK] for a in range(0, len(ids), PACK)]
            texts = [",".join(map(str, p.tolist())).encode() for p in parts]
            yield pa.RecordBatch.from_arrays([pa.array([key] * len(parts), pa.binary()), pa.array([int(p[0]) for p in parts], pa.int64()), pa.array([len(p) for p in parts], pa.int64()), pa.array(texts, pa.binary())], names=["key", "first", "n", "ids"])

    def digest(batches):
        key, state, n, least = None, None, 0, 0
        for batch in batches:
            done = []
            for k, first, count, text in zip(*(batch.column(c) for c in ("key", "first", "n", "ids"))):
                if k.as_py() != key:
                    if key is not None:
                        done.append((key, n, least, state.hexdigest()))
                    key, state, n, least = k.as_py(), hashlib.sha256(), 0, first.as_py()
                else:
                    state.update(b",")
                state.update(text.as_py())
                n += count.as_py()
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names=["key", "n", "conv_id", "ends_sha256"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (key, n, least, state.hexdigest())], names=["key", "n", "conv_id", "ends_sha256"])

    ordered = members.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    packed = ordered.mapInArrow(pack, PACKED).repartition("key").sortWithinPartitions("key", "first")
    return packed.mapInArrow(digest, ENDS)


def distinct_paths(conversations: DataFrame) -> DataFrame:
    """(path, words, n, conv_id, ends_sha256): each distinct sequence of turns once."""
    path = F.unhex(F.array_join(F.transform("turns", lambda t: t["id"]), ""))
    rows = conversations.select("conv_id", path.alias("path"), F.transform("turns", lambda t: t["words"]).alias("words"))
    rows = written(rows.withColumn("key", F.unhex(F.sha2("path", 256))), "paths")
    once = rows.groupBy("key").agg(F.first("path").alias("path"), F.first("words").alias("words"))
    return once.join(ending_members(rows.select("key", "conv_id")), "key").select("path", "words", "n", "conv_id", "ends_sha256")


# --- shards -----------------------------------------------------------------------------------------

NODES = (
    "whole boolean, shard int, key binary, parent_key binary, conv_id long, depth int, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
    "ends_sha256 string, words long, is_first boolean, is_last boolean"
)
NODE_SCHEMA = pa.schema([
    ("whole", pa.bool_()), ("shard", pa.int32()), ("key", pa.binary()), ("parent_key", pa.binary()), ("conv_id", pa.int64()), ("depth", pa.int32()), ("parent_conv_id", pa.int64()),
    *((c, pa.int64()) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")), ("ends_sha256", pa.string()), ("words", pa.int64()), ("is_first", pa.bool_()), ("is_last", pa.bool_()),
])


def sorted_rows(ids: np.ndarray, at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The order of rows ``ids[at[i] : at[i] + length[i]]`` (two numbers an id), a prefix before what goes on.

    A block of columns at a time: the rows that reach it are padded to a matrix and sorted by lexsort
    within the runs that were equal so far.
    """
    order, group = np.argsort(length > 0, kind="stable"), np.zeros(len(at), np.int64)
    alive, column = np.flatnonzero(length[order] > 0), 0
    # places of ``order`` that rows going on hold, and the run of equal rows that each is in
    while len(alive):
        rows = order[alive]
        place = at[rows][:, None] + column + np.arange(COLUMNS)
        inside = column + np.arange(COLUMNS) < length[rows][:, None]
        matrix = np.where(inside[:, :, None], ids[np.where(inside, place, 0)], 0).reshape(len(rows), -1)
        longer = length[rows] > column + COLUMNS  # what ends with the block goes before what goes on
        by = np.lexsort((longer, *matrix.T[::-1], group[alive]))
        order[alive], matrix, run = rows[by], matrix[by], group[alive]
        new = np.ones(len(rows), bool)
        new[1:] = (matrix[1:] != matrix[:-1]).any(1) | (run[1:] != run[:-1])
        group[alive] = np.cumsum(new)
        column += COLUMNS
        alive = alive[length[order[alive]] > column]
    return order


def trie_nodes(path: list[bytes], words: list[np.ndarray], n: np.ndarray, conv: np.ndarray, ends: list[str]) -> list[dict]:
    """A shard's nodes by depth, from the root: arrays of n, conv, words, parent (its number at the
    depth above), first (the sorted row that opens it), ends; and ``rows``, the sorted rows."""
    length = np.array([len(p) // ID_BYTES for p in path], np.int64)
    at = np.cumsum(length) - length
    # the last bit marks what is no padding
    ids = np.frombuffer(b"".join(path), ">u8").astype(np.uint64).reshape(-1, 2) | np.array([0, 1], np.uint64)
    if not len(ids):
        ids = np.zeros((1, 2), np.uint64)
    order = sorted_rows(ids, at, length)
    length, at, n, conv = length[order], at[order], n[order], conv[order]
    flat = np.concatenate([np.zeros(0, np.int64), *words]).astype(np.int64)
    row = np.arange(len(order))
    changed = np.zeros(len(row), bool)
    changed[0] = True
    node = np.zeros(len(row), np.int64)
    depths = [{"n": np.array([n.sum()]), "conv": np.array([conv.min()]), "words": np.zeros(1, np.int64), "parent": np.full(1, -1), "first": np.zeros(1, np.int64), "ends": length[:1] == 0}]
    while True:
        depth = len(depths)
        keep = np.flatnonzero(length[row] >= depth)
        if not len(keep):
            return [{"rows": order, "length": length}, *depths]
        # what is left out hands its difference on to the next row
        seen = np.cumsum(changed)[keep]
        changed = np.append(True, seen[1:] > seen[:-1])
        row, node = row[keep], node[keep]
        own = ids[at[row] + depth - 1]
        changed[1:] |= (own[1:] != own[:-1]).any(1)
        opens = np.flatnonzero(changed)
        depths.append({
            "n": np.add.reduceat(n[row], opens), "conv": np.minimum.reduceat(conv[row], opens), "words": flat[at[row[opens]] + depth - 1],
            "parent": node[opens], "first": row[opens], "ends": length[row[opens]] == depth,
        })
        node = np.cumsum(changed) - 1


def shard_nodes(shard: int, path: list[bytes], words: list[np.ndarray], n: np.ndarray, conv: np.ndarray, ends: list[str]) -> Iterator[pa.RecordBatch]:
    """The nodes of one shard: whole ones, and partial sums of those on the paths of its first and last row."""
    head, *depths = trie_nodes(path, words, n, conv, ends)
    order, length = head["rows"], head["length"]
    lasts = {}
    for name, k in (("first", 0), ("last", -1)):
        chain, keys = hashlib.sha256(), []
        own = path[order[k]]
        for d in range(length[k] + 1):
            keys.append(chain.digest())
            chain.update(own[d * ID_BYTES : (d + 1) * ID_BYTES])
        lasts[name] = keys
    below: dict | None = None
    for depth in range(len(depths) - 1, -1, -1):
        x = depths[depth]
        size = len(x["n"])
        x["children"], x["leaves"], x["saved"] = (np.zeros(size, np.int64) for _ in range(3))
        if below is not None:
            done = below["whole"]
            np.add.at(x["children"], below["parent"][done], 1)
            np.add.at(x["leaves"], below["parent"][done], below["leaves"][done])
            np.add.at(x["saved"], below["parent"][done], below["saved"][done])
        x["is_first"], x["is_last"] = np.zeros(size, bool), np.zeros(size, bool)
        x["is_first"][0] = depth < len(lasts["first"])
        x["is_last"][-1] = depth < len(lasts["last"])
        x["whole"] = ~(x["is_first"] | x["is_last"])
        w = x["whole"]
        x["leaves"][w & (x["children"] == 0)] = 1
        x["saved"][w] += (x["n"][w] - 1) * x["words"][w]
        below = x
    for depth, x in enumerate(depths):
        size = len(x["n"])
        key = np.full(size, None, object)
        for name in ("first", "last"):
            for k in np.flatnonzero(x[f"is_{name}"]):
                key[k] = lasts[name][depth]
        x["key"] = key
        above = depths[depth - 1] if depth else None
        parent_key = above["key"][x["parent"]] if depth else np.full(size, None, object)
        parent_conv = pa.array(above["conv"][x["parent"]], mask=np.array([k is not None for k in parent_key])) if depth else pa.nulls(size, pa.int64())
        sha = [ends[order[f]] if e else None for f, e in zip(x["first"], x["ends"])]
        yield pa.RecordBatch.from_arrays([
            pa.array(x["whole"]), pa.array(np.full(size, shard, np.int32)), pa.array(key, pa.binary()), pa.array(parent_key, pa.binary()), pa.array(x["conv"]), pa.array(np.full(size, depth, np.int32)), parent_conv,
            pa.array(x["n"]), pa.array(x["children"]), pa.array(x["leaves"]), pa.array(x["saved"]), pa.array(sha, pa.string()), pa.array(x["words"]), pa.array(x["is_first"]), pa.array(x["is_last"]),
        ], schema=NODE_SCHEMA)


def in_shards(paths: DataFrame, shard_turns: int = SHARD_TURNS) -> tuple[DataFrame, int]:
    """(nodes and partial sums of all range shards, number of shards)."""
    turns = paths.agg(F.sum(F.octet_length("path") / ID_BYTES + 1)).first()[0] or 0
    n_shards = max(1, -(-int(turns) // shard_turns))
    spread = paths.repartitionByRange(n_shards, "path").withColumn("shard", F.spark_partition_id())

    def run(batches):
        held = [b for b in batches if len(b)]
        if held:
            t = pa.Table.from_batches(held).combine_chunks()
            words = [np.asarray(w, np.int64) for w in t.column("words").to_pylist()]
            yield from shard_nodes(t.column("shard")[0].as_py(), t.column("path").to_pylist(), words, t.column("n").to_numpy(), t.column("conv_id").to_numpy(), t.column("ends_sha256").to_pylist())

    found = written(spread.mapInArrow(run, NODES), "nodes")
    return found, 1 + (found.agg(F.max("shard")).first()[0] or 0)


def recombined(rows: list[dict], last: bool, group: int = GROUP) -> list[dict]:
    """The partial nodes of neighbouring shards, put together: whole ones, and those on the paths at
    both ends, which are partial still unless these are all shards (``last``)."""
    low, high = min(r["shard"] for r in rows), max(r["shard"] for r in rows)
    nodes: dict[bytes, dict] = {}
    for r in rows:
        x = nodes.setdefault(r["key"], r | {"n_convs": 0, "n_children": 0, "n_leaves": 0, "saved_tokens": 0, "is_first": False, "is_last": False})
        for c in ("n_convs", "n_children", "n_leaves", "saved_tokens"):
            x[c] += r[c]
        x["conv_id"], x["ends_sha256"] = min(x["conv_id"], r["conv_id"]), x["ends_sha256"] or r["ends_sha256"]
        x["is_first"] |= r["is_first"] and r["shard"] == low
        x["is_last"] |= r["is_last"] and r["shard"] == high
    for x in sorted(nodes.values(), key=lambda x: -x["depth"]):
        x["whole"] = last or not (x["is_first"] or x["is_last"])
        x["shard"] //= group
        above = nodes.get(x["parent_key"])
        if x["whole"]:
            if not x["n_children"]:
                x["n_leaves"] = 1
            x["saved_tokens"] += (x["n_convs"] - 1) * x["words"]
            if above is not None:
                above["n_children"] += 1
                above["n_leaves"] += x["n_leaves"]
                above["saved_tokens"] += x["saved_tokens"]
                # whole parents know their smallest member now
                x["parent_conv_id"] = above["conv_id"]
    for x in nodes.values():
        above = nodes.get(x["parent_key"])
        if above is not None and not above["whole"]:
            x["parent_conv_id"] = None
    return list(nodes.values())


def merged_shards(partial: DataFrame, last: bool, group: int) -> DataFrame:
    def merge(table: pa.Table) -> pa.Table:
        return pa.Table.from_pylist(recombined(table.to_pylist(), last, group), NODE_SCHEMA)

    return partial.groupBy(F.expr(f"shard div {group}")).applyInArrow(merge, NODES)


def trie(conversations: DataFrame, shard_turns: int = SHARD_TURNS, group: int = GROUP) -> DataFrame:
    """One row per node of the prefix trie of ``conversations(conv_id, turns)``."""
    found, groups = in_shards(written(distinct_paths(conversations), "sequences"), shard_turns)
    whole, partial = [found.filter("whole")], found.filter("NOT whole")
    while True:
        groups = -(-groups // group)

        merged = written(merged_shards(partial, groups == 1, group), "merged")
        whole.append(merged.filter("whole"))
        partial = merged.filter("NOT whole")
        if groups == 1:
            break
    ends = whole[1]
    for more in whole[2:]:
        ends = ends.unionByName(more)
    nodes = whole[0].unionByName(ends)
    shown = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    asked = F.col("parent_conv_id").isNull() & (F.col("depth") > 0)
    keys = written(ends.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("least"), F.col("n_children").alias("weight")), "boundary")
    told = join_by_key(nodes.filter(asked).drop("parent_conv_id"), keys, ["parent_key"], "weight").withColumnRenamed("least", "parent_conv_id")
    out = nodes.filter(~asked).select(*shown).unionByName(told.select(*shown))
    return out.withColumns({"depth": F.col("depth").cast("long"), "ends_sha256": F.coalesce("ends_sha256", F.lit(NO_MEMBERS))})


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(rebuilt(turn_sequences(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))


QUERIES = {"op12_prefix_trie": op12_prefix_trie}
ORACLE_SQL = {
    "op12_prefix_trie": f"""
WITH own AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) AS i FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % {SHARED} AS base, {_crc_sql("CAST(conv_id AS VARCHAR)")} % 4 AS h FROM (SELECT DISTINCT conv_id FROM own)),
r AS (SELECT c.conv_id, i, role, text FROM c JOIN own ON own.conv_id = c.base AND i <= h UNION ALL SELECT c.conv_id, i, role, text FROM c JOIN own ON own.conv_id = c.conv_id AND i > h),
s AS (SELECT conv_id, row_number() OVER w AS d, string_agg(sha256(strlen(role) || ':' || role || text), '') OVER w AS path, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS words FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY i)),
p AS (SELECT conv_id, 0 AS d, '' AS path, 0 AS words FROM c UNION ALL SELECT * FROM s),
q AS (SELECT *, max(d) OVER (PARTITION BY conv_id) AS last, lag(path) OVER (PARTITION BY conv_id ORDER BY d) AS above FROM p),
node AS (SELECT path, any_value(above) AS above, any_value(d) AS depth, min(conv_id) AS conv_id, count(*) AS n, any_value(words) AS words,
                sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE d = last), '')) AS ends FROM q GROUP BY path),
kids AS (SELECT above, count(*) AS k FROM node WHERE above IS NOT NULL GROUP BY above),
sums AS (
  SELECT a.path, sum((n - 1) * node.words) AS saved, count(*) FILTER (WHERE k IS NULL) AS leaves
  FROM node LEFT JOIN kids ON kids.above = node.path JOIN p a ON a.conv_id = node.conv_id AND a.d <= node.depth GROUP BY a.path)
SELECT node.conv_id, CAST(depth AS BIGINT) AS depth, parent.conv_id AS parent_conv_id, node.n AS n_convs, coalesce(k, 0) AS n_children, leaves AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, node.ends AS ends_sha256
FROM node JOIN sums ON sums.path = node.path LEFT JOIN kids ON kids.above = node.path LEFT JOIN (SELECT path, conv_id FROM node) parent ON parent.path = node.above""",
}
