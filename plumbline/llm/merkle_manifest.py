"""Merkle dataset manifest (operator 13) in van Emde Boas layout.

Every document is a leaf; a source's leaves, by doc_id, form a tree of fan-out 16, and the sources' roots
form another one. A tree is cut into aligned blocks of 4096 leaves (three levels of nodes above them),
which Spark builds one by one in parallel; the blocks' roots are the leaves of the next round, cut into
blocks again, until each tree has one block. So three rounds do for 6e10 documents, no task holds more than
a block, and a source with a third of all rows is many blocks.

A block is one row of the manifest. Its digests lie in one binary in van Emde Boas order: the levels
are split at half height, the upper part comes first, then each lower subtree on end, and every part is
laid out alike. The address of a node follows from level, position and number of leaves by arithmetic
(``addresses``), with the last, incomplete subtree packed, so nothing is stored but digests. Children of a
node lie together, so a leaf's siblings are read from one subtree, those of its parent from
neighbouring ones.

A proof is read from its block and extended by what the block's root has above it; that is handed down
from the last round to the first, one row per block.

Defined results: fields that are null count as ``-``; a null doc_id stands before all others and is never
tampered with; a null source is a tree of its own before all others; rows of one doc_id stand by their
leaf digest, and repeated rows are leaves of their own; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.hilbert_shards import _crc_sql, ranked
from plumbline.llm.hot_keys import join_by_key
from plumbline.session import written

FAN_OUT = 16
HEIGHT = 3  # levels above the leaves of a whole block
BLOCK = FAN_OUT**HEIGHT
DIGEST = 32
ALL_SOURCES = b"\x02"  # the tree over the sources' roots; a source's key begins with 0 or 1


def tree_height(n: int) -> int:
    """The levels above n leaves."""
    height = 0
    while FAN_OUT**height < n:
        height += 1
    return height


@lru_cache(maxsize=256)
def addresses(n: int, height: int) -> tuple[np.ndarray, ...]:
    """For each level from the leaves up the addresses of its nodes, in a tree of ``n`` leaves with
    ``height`` levels above them, whose digests are packed in van Emde Boas order."""
    if height == 0:
        return (np.zeros(1, np.int64),)
    low = (height + 1) // 2  # levels of the lower subtrees
    width = FAN_OUT ** (low - 1)  # leaves of a whole one
    upper = addresses(-(-n // FAN_OUT**low), height - low)
    start, count = sum(map(len, upper)), -(-n // width)
    whole, last = addresses(width, low - 1), addresses(n - (count - 1) * width, low - 1)
    size = sum(map(len, whole))
    starts = start + size * np.arange(count)
    lower = [np.concatenate([(starts[:-1, None] + w).ravel(), starts[-1] + e]) for w, e in zip(whole, last)]
    return (*lower, *upper)


def parents(level: bytes) -> bytes:
    """The digests above a level: each of 16 neighbours' digests as hexadecimal text."""
    step = FAN_OUT * DIGEST
    return b"".join(hashlib.sha256(level[a : a + step].hex().encode()).digest() for a in range(0, len(level), step))


def build(leaves: bytes, height: int) -> tuple[bytes, bytes]:
    """(root, nodes in van Emde Boas order) of a block over its leaves' digests."""
    at = addresses(len(leaves) // DIGEST, height)
    nodes, level = np.empty((sum(map(len, at)), DIGEST), np.uint8), leaves
    for places in at:
        nodes[places] = np.frombuffer(level, np.uint8).reshape(-1, DIGEST)
        root, level = level, parents(level)
    return root, nodes.tobytes()


def siblings(nodes: bytes, n: int, height: int) -> list[list[tuple[str, str]]]:
    """For each leaf of a block, from the leaves up, the digests before and after its ancestor in its run,
    as hexadecimal text."""
    at, table = addresses(n, height), np.frombuffer(nodes, np.uint8).reshape(-1, DIGEST)
    out: list[list[tuple[str, str]]] = [[] for _ in range(n)]
    for level in range(height):
        text, size = table[at[level]].tobytes().hex(), len(at[level])
        for k in range(size):
            opens, ends = k - k % FAN_OUT, min(k - k % FAN_OUT + FAN_OUT, size)
            pair = text[opens * 64 : k * 64], text[k * 64 + 64 : ends * 64]
            for leaf in range(k * FAN_OUT**level, min(n, (k + 1) * FAN_OUT**level)):
                out[leaf].append(pair)
    return out


def folded(leaf: str, path: list[tuple[str, str]]) -> str:
    """The root that a leaf and its siblings lead to."""
    for before, after in path:
        leaf = hashlib.sha256(f"{before}{leaf}{after}".encode()).hexdigest()
    return leaf


def proof_digest(path: list[tuple[str, str]]) -> str:
    return hashlib.sha256("".join(before + after for before, after in path).encode()).hexdigest()


# --- the jobs ---------------------------------------------------------------------------------------


def one_by_one(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows as objects, one at a time: a row is a whole block."""
    for batch in batches:
        for k in range(len(batch)):
            yield batch.slice(k, 1).to_pylist()[0]


def leaf_digest(text: Column) -> Column:
    """The leaf of a document with this text, as hexadecimal text."""
    field = lambda c: F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
    return F.sha2(F.concat(*[field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")], field(text)).cast("binary"), 256)


def source_key(source: Column) -> Column:
    """A key whose bytes sort as sources do, null first."""
    return F.coalesce(F.concat(F.unhex(F.lit("01")), source.cast("string").cast("binary")), F.unhex(F.lit("00")))


BLOCKS = "tree binary, block long, n int, height int, root binary, nodes binary, ids array<long>, trees array<binary>, others array<binary>"


def blocks(leaves: DataFrame) -> DataFrame:
    """The blocks of ``leaves(tree, place, digest, id, below, other)``: the leaf's place in its tree, and what
    stands below it (a document's id or a block's number, and a tree)."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("place").combine_chunks()
        n, block = len(table), table.column("block")[0].as_py()
        # a first block that is not full is the whole tree
        height = tree_height(n) if block == 0 else HEIGHT
        root, nodes = build(b"".join(table.column("digest").to_pylist()), height)
        lists = [pa.array([table.column(c).to_pylist()], pa.list_(kind)) for c, kind in (("id", pa.int64()), ("below", pa.binary()), ("other", pa.binary()))]
        fixed = [pa.array([table.column("tree")[0].as_py()], pa.binary()), pa.array([block], pa.int64()), pa.array([n], pa.int32()), pa.array([height], pa.int32()), pa.array([root], pa.binary()), pa.array([nodes], pa.binary())]
        return pa.table([*fixed, *lists], names=["tree", "block", "n", "height", "root", "nodes", "ids", "trees", "others"])

    return leaves.withColumn("block", F.expr(f"place div {BLOCK}")).groupBy("tree", "block").applyInArrow(run, BLOCKS)


def rounds(leaves: DataFrame, name: str) -> list[DataFrame]:
    """The written blocks of all trees, round after round until every tree has one block."""
    out = [written(blocks(leaves), f"{name}0")]
    while not out[-1].filter("block > 0").isEmpty():
        above = out[-1].select("tree", F.col("block").alias("place"), F.col("root").alias("digest"), F.col("block").alias("id"), F.lit(None).cast("binary").alias("below"), F.lit(None).cast("binary").alias("other"))
        out.append(written(blocks(above), f"{name}{len(out)}"))
    return out


def manifest(docs: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """(rounds of the sources' trees, rounds of the tree over their roots)."""
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    hashed = docs.select(
        source_key(F.col("source")).alias("tree"), F.col("doc_id").cast("long").alias("id"), F.unhex(leaf_digest(F.col("text"))).alias("digest"), F.when(tampered, F.unhex(leaf_digest(lower))).alias("other")
    )
    order = written(ranked(hashed, ["tree", "id", "digest"], "pos", "rows"), "leaves")
    starts = written(order.groupBy("tree").agg(F.min("pos").alias("first"), F.count("*").alias("n")), "starts")
    # a source may hold a third of all rows
    leaves = join_by_key(order, starts, ["tree"], "n").select("tree", (F.col("pos") - F.col("first")).alias("place"), "digest", "id", F.lit(None).cast("binary").alias("below"), "other")
    own = rounds(leaves, "blocks")
    roots = own[-1].select("tree", F.col("root").alias("digest"))
    top = ranked(roots, ["tree"], "pos", "rows").select(
        F.lit(bytearray(ALL_SOURCES)).alias("tree"), F.col("pos").alias("place"), "digest", F.lit(0).cast("long").alias("id"), F.col("tree").alias("below"), F.lit(None).cast("binary").alias("other")
    )
    return own, rounds(top, "sources")


ABOVE = "tree binary, block long, subroot string, above array<struct<before:string,after:string>>"
PROVED = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string"


def handed_down(round_: DataFrame, above: DataFrame | None) -> DataFrame:
    """What stands above each leaf of a round's blocks, for the blocks of the round below."""
    joined = round_.select("*", F.lit(None).cast("string").alias("subroot"), F.array().cast("array<struct<before:string,after:string>>").alias("above")) if above is None else round_.join(above, ["tree", "block"])
    kind = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))

    def run(batches):
        for row in one_by_one(batches):
            rest = [(x["before"], x["after"]) for x in row["above"]]
            paths = siblings(row["nodes"], row["n"], row["height"])
            leaf = np.frombuffer(row["nodes"], np.uint8).reshape(-1, DIGEST)[addresses(row["n"], row["height"])[0]]
            over = row["tree"] == ALL_SOURCES
            trees = row["trees"] if over else [row["tree"]] * row["n"]
            subroots = [x.tobytes().hex() for x in leaf] if over else [row["subroot"]] * row["n"]
            above = [[{"before": a, "after": b} for a, b in path + rest] for path in paths]
            yield pa.RecordBatch.from_arrays([pa.array(trees, pa.binary()), pa.array(row["ids"], pa.int64()), pa.array(subroots, pa.string()), pa.array(above, kind)], names=["tree", "block", "subroot", "above"])

    return joined.select("tree", "n", "height", "nodes", "ids", "trees", "subroot", "above").mapInArrow(run, ABOVE)


def proved(docs: DataFrame) -> DataFrame:
    """Every document's leaf, proof, and the root that its text as it may have become leads to."""
    own, over = manifest(docs)
    last = over[-1].select("root").first()
    if last is None:
        return docs.sparkSession.createDataFrame([], PROVED + ", verified boolean")
    root, above = bytes(last.root).hex(), None
    for round_ in (*reversed(over), *reversed(own[1:])):
        above = written(handed_down(round_, above), "above")

    def run(batches):
        for row in one_by_one(batches):
            rest = [(x["before"], x["after"]) for x in row["above"]]
            leaf = np.frombuffer(row["nodes"], np.uint8).reshape(-1, DIGEST)[addresses(row["n"], row["height"])[0]]
            out = []
            for i, x, other, path in zip(row["ids"], leaf, row["others"], siblings(row["nodes"], row["n"], row["height"])):
                own, path = x.tobytes().hex(), path + rest
                out.append((i, own, row["subroot"], root, proof_digest(path), folded(own if other is None else other.hex(), path)))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k else pa.int64()) for k, c in enumerate(zip(*out))], names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root"])

    joined = own[0].join(above, ["tree", "block"]).select("n", "height", "nodes", "ids", "others", "subroot", "above")
    return joined.mapInArrow(run, PROVED).withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return proved(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _field_sql(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN '-' ELSE strlen(CAST({x} AS VARCHAR)) || ':' || {x} END"


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(_field_sql(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


_LOWER_SQL = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
QUERIES = {"op13_merkle_manifest": op13_merkle_manifest}
ORACLE_SQL = {
    "op13_merkle_manifest": f"""
WITH RECURSIVE d AS (SELECT doc_id, source, {_leaf_sql("text")} AS leaf, CASE WHEN {_crc_sql("CAST(doc_id AS VARCHAR)")} % 5 = 0 THEN {_leaf_sql(_LOWER_SQL)} END AS other FROM documents),
p AS (SELECT *, row_number() OVER () AS rid, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM d),
t AS (
  SELECT source, 0 AS lvl, pos, leaf AS h, n FROM p
  UNION ALL
  SELECT source, lvl + 1, pos // 16, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 15) // 16 FROM t WHERE n > 1 GROUP BY source, lvl, pos // 16),
s AS (SELECT source, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS spot, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (
  SELECT 0 AS lvl, spot AS pos, subroot AS h, n FROM s
  UNION ALL
  SELECT lvl + 1, pos // 16, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 15) // 16 FROM u WHERE n > 1 GROUP BY lvl, pos // 16),
tr AS (SELECT source, lvl, pos // 16 AS run, list(h ORDER BY pos) AS hs FROM t WHERE n > 1 GROUP BY ALL),
ur AS (SELECT lvl, pos // 16 AS run, list(h ORDER BY pos) AS hs FROM u WHERE n > 1 GROUP BY ALL),
steps AS (
  SELECT rid, lvl, hs, (pos // CAST(16 ** lvl AS BIGINT)) % 16 AS k FROM p JOIN tr ON p.source IS NOT DISTINCT FROM tr.source AND tr.run = pos // CAST(16 ** (lvl + 1) AS BIGINT)
  UNION ALL
  SELECT rid, 100 + lvl, hs, (spot // CAST(16 ** lvl AS BIGINT)) % 16 FROM p JOIN s ON p.source IS NOT DISTINCT FROM s.source JOIN ur ON ur.run = spot // CAST(16 ** (lvl + 1) AS BIGINT)),
path AS (SELECT rid, row_number() OVER (PARTITION BY rid ORDER BY lvl) AS step, array_to_string(hs[1:k], '') AS before, array_to_string(hs[k + 2:], '') AS after FROM steps),
proof AS (SELECT rid, sha256(string_agg(before || after, '' ORDER BY step)) AS proof, max(step) AS last FROM path GROUP BY rid),
f AS (
  SELECT rid, 0::BIGINT AS step, coalesce(other, leaf) AS h FROM p
  UNION ALL
  SELECT f.rid, path.step, sha256(before || h || after) FROM f JOIN path ON path.rid = f.rid AND path.step = f.step + 1)
SELECT doc_id, leaf, subroot, (SELECT h FROM u WHERE n = 1) AS root, coalesce(proof, sha256('')) AS proof_sha256, f.h AS folded_root, f.h = (SELECT h FROM u WHERE n = 1) AS verified
FROM p JOIN s ON p.source IS NOT DISTINCT FROM s.source LEFT JOIN proof ON proof.rid = p.rid JOIN f ON f.rid = p.rid AND f.step = coalesce(last, 0)""",
}
