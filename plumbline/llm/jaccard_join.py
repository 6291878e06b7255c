"""N-gram Jaccard self-join (operator 3) by chosen paths.

Documents are sets of 5-word shingles; documents with equal sets form one *text class*, and classes
are joined: two are linked if their Jaccard similarity is at least ``THRESHOLD``.

Each run splits the classes recursively: at every level a set picks each of its shingles
with probability 1 / (THRESHOLD * size), by a hash that all sets share, and goes to one child node per
picked shingle. Two linked sets share an expected picked shingle or more per level, unlinked sets soon
part. A node of at most ``LIMIT`` sets is compared by brute force (one matrix product), a larger one is
split again, up to ``LEVELS`` times. One run finds a link of similarity 0.8 in a node of depth d with
probability of about 0.63**d or more; runs repeat until the links of depth ``DEPTH`` are found with
``TARGET_RECALL`` (``runs_for``): 16 runs, which miss a link with 1e-7 at depth 1, 3e-4 at depth 2, 1e-2
at depth 3.

Before sets are fetched, nodes are thinned by sketches (``SKETCH`` MinHash bytes per class): a set that
agrees with no other set of its node in ``AGREE`` bytes or more leaves the node. A linked pair agrees
in 25.6 of 32 on average, in fewer than 12 with a probability under 1e-7.

What shares ``LEVELS`` shingles and is still more than ``LIMIT`` sets is a family of near copies. Its
sets are dealt to blocks, and every pair of blocks is a *tile*, compared as a bucket of its own, so all
pairs of a node meet, each in one tile. The work on a family grows with the square of its size, spread
over its tiles.

No pairs leave the task: a tile returns a spanning forest of its links, for the classes, and for each
set its number of links that no earlier node of the two sets has counted.

Defined results: a text of 1 to 4 words is one shingle of all its words; a text without words is
linked to nothing; a null doc_id belongs to no class (class_id null); rows with one doc_id and one text
have one class; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.columns import free_names
from plumbline.llm.components import components
from plumbline.llm.hot_keys import join_by_key
from plumbline.llm.word_arrays import mix, slices, words
from plumbline.session import written

SHINGLE = 5
THRESHOLD = 0.8
TARGET_RECALL = 0.9997
DEPTH = 2
LEVELS = 3
LIMIT = 200
SKETCH = 32
AGREE = 12
SET_BLOCK = 4  # times the limit: sets to a block
SKETCH_BLOCK = 10

PROFILE = "doc_id long, s1 long, s2 long, n int"
PICKED = PROFILE + ", sketch binary, picked array<array<long>>"
SETS = "rep long, s1 long, s2 long, n int, shingles binary"
FOUND = "a long, b long, links int"


def runs_for(target_recall: float, depth: int = DEPTH) -> int:
    """The runs that find a link at the threshold in nodes of ``depth`` with the target probability."""
    return max(1, math.ceil(math.log(1 - target_recall) / math.log(1 - (1 - math.exp(-1)) ** depth)))


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of all texts, sorted within each, and their number per text."""
    w = words(texts)
    h, keep = w.windows(SHINGLE), w.whole(SHINGLE)
    doc, h = w.doc[: len(h)][keep], h[keep]
    if (short := (w.per_doc > 0) & (w.per_doc < SHINGLE)).any():
        parts_doc, parts = [doc], [h]
        for k in range(1, SHINGLE):
            first = np.flatnonzero((w.place == 0) & (w.per_doc[w.doc] == k))
            parts_doc.append(w.doc[first])
            parts.append(w.windows(k, k)[first])
        doc, h = np.concatenate(parts_doc), np.concatenate(parts)
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[first], np.bincount(doc[first], minlength=len(texts))


def _identity(h: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each set: two sums of independent hashes."""
    ends = np.concatenate([[0], np.cumsum(counts)])
    sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h, salt))]) for salt in (21, 22)]
    return tuple((s[ends[1:]] - s[ends[:-1]]).view(np.int64) for s in sums)


def _steps(runs: int, levels: int) -> np.ndarray:
    return np.random.default_rng(3).integers(1, 2**63, runs * levels, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_SKETCH_STEPS = np.random.default_rng(33).integers(1, 2**63, SKETCH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def sketches(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A byte of each MinHash minimum of each set; zeros for empty sets."""
    out = np.zeros((len(counts), SKETCH), np.uint8)
    there = np.flatnonzero(counts)
    if len(there):
        opens = (np.cumsum(counts) - counts)[there]
        for f, step in enumerate(_SKETCH_STEPS):
            out[there, f] = (np.minimum.reduceat(h * step, opens) >> np.uint64(20)).astype(np.uint8)
    return out


def _nested(lengths: np.ndarray, values: np.ndarray, per_row: int) -> pa.Array:
    inner = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(values, pa.int64()))
    return pa.ListArray.from_arrays(pa.array(np.arange(0, len(lengths) + 1, per_row), pa.int32()), inner)


def profiles(docs: DataFrame) -> DataFrame:
    """Each document's set identity and size: a few bytes a document."""

    def run(batches):
        for batch in batches:
            texts = batch.column("text")
            for a, b in slices(texts):
                h, counts = shingle_sets(texts.slice(a, b - a))
                s1, s2 = _identity(h, counts)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(s1), pa.array(s2), pa.array(counts, pa.int32())], names=["doc_id", "s1", "s2", "n"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PROFILE)


def picks(docs: DataFrame, threshold: float, runs: int, levels: int) -> DataFrame:
    """The profile with the set's sketch and its picked shingles by level and run.

    Computed from the text for the classes alone instead of being kept with every document: hashing a
    text twice costs less than writing what it picks.
    """
    steps = _steps(runs, levels)

    def run(batches):
        for batch in batches:
            texts = batch.column("text")
            for a, b in slices(texts):
                h, counts = shingle_sets(texts.slice(a, b - a))
                s1, s2 = _identity(h, counts)
                least = np.minimum(2.0**64 / (threshold * np.maximum(1, counts)), 2.0**64 - 4096).astype(np.uint64)
                doc = np.repeat(np.arange(b - a), counts)
                bound = least[doc]
                at, which = [], []
                for f, step in enumerate(steps):
                    hit = np.flatnonzero(h * step < bound)
                    at.append(hit)
                    which.append(np.full(len(hit), f))
                at, which = np.concatenate(at), np.concatenate(which)
                slot = doc[at] * len(steps) + which
                order = np.argsort(slot, kind="stable")
                picked = _nested(np.bincount(slot, minlength=(b - a) * len(steps)), h[at[order]].view(np.int64), len(steps))
                sketch = pa.array([k.tobytes() for k in sketches(h, counts)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(s1), pa.array(s2), pa.array(counts, pa.int32()), sketch, picked], names=["doc_id", "s1", "s2", "n", "sketch", "picked"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PICKED)


def buckets(classes: DataFrame, runs: int, levels: int, limit: int) -> DataFrame:
    """(node, count, rep): the nodes that chosen paths end in, of two sets or more."""
    nodes = (
        classes.select("rep", F.posexplode(F.slice("picked", 1, runs)).alias("run", "tokens"))
        .select("rep", "run", F.explode("tokens").alias("token"))
        .select("rep", "run", F.xxhash64("run", "token").alias("node"))
    )
    small, large = [], None
    for level in range(1, levels + 1):
        nodes = written(nodes, f"nodes{level}")
        sizes = written(nodes.groupBy("node").count().filter(F.col("count") > 1), "sizes")
        nodes = written(join_by_key(nodes, sizes, ["node"], "count").select("rep", "run", "node", "count"), f"level{level}")
        fits = nodes.filter(F.col("count") <= limit)
        small.append(fits.select("rep", "node"))
        large = nodes.filter(F.col("count") > limit)
        if level < levels:
            tokens = classes.select("rep", F.slice("picked", level * runs + 1, runs).alias("next"))
            nodes = (
                large.join(tokens, "rep")
                .select("rep", "run", "node", F.explode(F.element_at("next", F.col("run") + 1)).alias("token"))
                .select("rep", "run", F.xxhash64("node", "token").alias("node"))
            )
    whole = small[0]
    for more in small[1:]:
        whole = whole.unionByName(more)
    # runs that end in the same sets need one comparison; a node here has at most ``limit`` sets
    same = whole.groupBy("node").agg(F.sort_array(F.collect_set("rep")).alias("sets"))
    once = same.groupBy("sets").agg(F.min("node").alias("node")).select("node", F.size("sets").cast("long").alias("count"), F.explode("sets").alias("rep"))
    return once.unionByName(large.select("node", "count", "rep"))


def tiles(rows: DataFrame, block: int) -> DataFrame:
    """Every row once for each pair of its own block with a block of its node: (i, j), i <= j, and
    ``sub``, its own."""
    subs = F.ceil(F.col("count") / block).cast("int")
    dealt = rows.withColumn("subs", subs).withColumn("sub", F.pmod(F.xxhash64("rep", "node"), F.col("subs")).cast("int"))
    spread = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("subs") - 1)))
    return spread.withColumns({"i": F.least("sub", "other"), "j": F.greatest("sub", "other")}).drop("subs", "other", "count")


def _links(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    """Which sets of ``left`` are linked to which of ``right``."""
    n = np.array([len(s) for s in sets])
    values, column = np.unique(np.concatenate(sets), return_inverse=True)
    often = np.bincount(column, minlength=len(values)) > 1
    place = np.cumsum(often) - 1
    row = np.repeat(np.arange(len(sets)), n)
    used = often[column]
    row, column = row[used], place[column[used]]
    width, inter = int(often.sum()), np.zeros((len(left), len(right)), np.float32)
    for a in range(0, width, 8192):  # bounded memory, whatever the sets' sizes
        part = (column >= a) & (column < a + 8192)
        x = np.zeros((len(sets), min(8192, width - a)), np.float32)
        x[row[part], column[part] - a] = 1
        inter += x[left] @ x[right].T
    return inter >= threshold * (n[left][:, None] + n[right][None] - inter) - 1e-6


def _forest(linked: np.ndarray) -> Iterator[tuple[int, int]]:
    """The links of a spanning forest of a symmetric matrix of links."""
    fresh = linked.any(1)
    while fresh.any():
        frontier = [int(np.argmax(fresh))]
        fresh[frontier] = False
        while frontier:
            at = frontier.pop()
            found = np.flatnonzero(linked[at] & fresh)
            fresh[found] = False
            frontier += found.tolist()
            yield from ((at, int(k)) for k in found)


def _tile_links(ids, sets, nodes, own, node: int, i: int, j: int, threshold: float) -> list[tuple[int, int | None, int]]:
    """Forest links (a, b, 0) and counts (a, None, links) of one tile. All pairs of a node's sets meet in
    one of its tiles, so what two sets share an earlier node with is found there."""
    own = np.array(own)
    left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
    earlier = {m: k for k, m in enumerate(sorted({m for those in nodes for m in those if m < node}))}
    member = np.zeros((len(sets), len(earlier)), np.float32)
    for k, those in enumerate(nodes):
        member[k, [earlier[m] for m in those if m < node]] = 1
    new = member[left] @ member[right].T == 0
    if i == j:
        np.fill_diagonal(new, False)
    rows, columns = new.any(1), new.any(0)
    if not rows.any():
        return []
    left, right, new = left[rows], right[columns], new[np.ix_(rows, columns)]
    linked = np.zeros((len(sets), len(sets)), bool)
    linked[np.ix_(left, right)] = _links(sets, left, right, threshold) & new
    if i != j:
        linked |= linked.T
    out = [(int(ids[a]), int(ids[b]), 0) for a, b in _forest(linked)]
    return out + [(int(ids[a]), None, int(c)) for a, c in enumerate(linked.sum(1)) if c]


def _by_tile(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Rows of one tile at a time from batches sorted by tile."""
    tile = lambda r: (r["node"], r["i"], r["j"])
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and tile(held[0]) != tile(row):
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _in_tiles(rows: DataFrame, run, schema: str) -> DataFrame:
    return rows.repartition("node", "i", "j").sortWithinPartitions("node", "i", "j").mapInArrow(run, schema)


def compare(rows: DataFrame, threshold: float) -> DataFrame:
    """Brute force in every tile: forest links and counts."""

    def run(batches):
        for held in _by_tile(batches):
            first = held[0]
            found = _tile_links(
                [r["rep"] for r in held],
                [np.frombuffer(r["shingles"], np.uint64) for r in held],
                [r["nodes"] for r in held],
                [r["sub"] for r in held],
                first["node"],
                first["i"],
                first["j"],
                threshold,
            )
            if found:
                a, b, c = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int32())], names=["a", "b", "links"])

    return _in_tiles(rows, run, FOUND)


def thinned(rows: DataFrame, classes: DataFrame, limit: int) -> DataFrame:
    """(node, count, rep): the rows whose set may have a link in the node, by the classes' sketches; of
    nodes that then have the same sets, one."""

    def run(batches):
        for held in _by_tile(batches):
            x = np.frombuffer(b"".join(r["sketch"] for r in held), np.uint8).reshape(-1, SKETCH)
            near = np.zeros(len(x), bool)
            for a in range(0, len(x), 64):
                agree = (x[a : a + 64, None, :] == x[None]).sum(2) >= AGREE
                near[a : a + 64] = agree.sum(1) > 1  # one is the set itself
            kept = [r for r, k in zip(held, near) if k]
            if kept:
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in kept], pa.int64()) for c in ("node", "rep")], names=["node", "rep"])

    joined = tiles(rows.join(classes.select("rep", "sketch"), "rep"), SKETCH_BLOCK * limit)
    kept = written(_in_tiles(joined, run, "node long, rep long").distinct(), "near")
    sums = [F.bit_xor(F.xxhash64("rep", F.lit(k))).alias(f"x{k}") for k in (1, 2)]
    once = kept.groupBy("node").agg(F.count("*").alias("count"), *sums).groupBy("count", "x1", "x2").agg(F.min("node").alias("node"))
    return join_by_key(kept, written(once.select("node", "count"), "once"), ["node"], "count")


def sets_of(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """The shingle sets of the classes' first documents."""

    def run(batches):
        for batch in batches:
            texts = batch.column("text")
            for a, b in slices(texts):
                h, counts = shingle_sets(texts.slice(a, b - a))
                s1, s2 = _identity(h, counts)
                ends = np.cumsum(counts)
                own = pa.array([h[e - c : e].tobytes() for e, c in zip(ends, counts)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("rep").slice(a, b - a), pa.array(s1), pa.array(s2), pa.array(counts, pa.int32()), own], names=["rep", "s1", "s2", "n", "shingles"])

    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").join(reps, "rep", "left_semi")
    return texts.mapInArrow(run, SETS).join(reps, ["rep", "s1", "s2", "n"], "left_semi").select("rep", "shingles").dropDuplicates(["rep"])


def jaccard_classes(docs: DataFrame, threshold: float = THRESHOLD, target_recall: float = TARGET_RECALL, levels: int = LEVELS, limit: int = LIMIT) -> DataFrame:
    """doc_id, class_id (the smallest doc_id that links lead to), n_links (distinct other texts linked
    to this one), n_shingles."""
    runs = runs_for(target_recall)
    profile = written(profiles(docs), "profiles")
    known = picks(docs, threshold, runs, levels).filter(F.col("doc_id").isNotNull() & (F.col("n") > 0))
    classes = written(known.groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("size"), F.first("sketch").alias("sketch"), F.first("picked").alias("picked")), "classes")
    rows = written(thinned(buckets(classes, runs, levels, limit), classes, limit), "buckets")
    # a set stands in at most a few nodes per run
    stays = rows.groupBy("rep").agg(F.collect_list("node").alias("nodes"))
    reps = classes.join(stays.select("rep"), "rep", "left_semi").select("rep", "s1", "s2", "n")
    full = sets_of(docs, reps).join(stays, "rep")
    found = written(compare(tiles(rows, SET_BLOCK * limit).join(full, "rep"), threshold), "found")
    label = components(found.filter(F.col("b").isNotNull()))
    links = found.filter(F.col("b").isNull()).groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("n_links"))
    named = classes.select("s1", "s2", "n", "size", "rep").join(label.withColumnRenamed("node", "rep"), "rep", "left").join(links, "rep", "left")
    named = written(named.select("s1", "s2", "n", "size", F.coalesce("label", "rep").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")), "named")
    # a class of copies may hold a third of all rows
    has_class = F.col("doc_id").isNotNull() & (F.col("n") > 0)
    shown = ["doc_id", "class_id", "n_links", F.col("n").alias("n_shingles")]
    found = join_by_key(profile.filter(has_class), named, ["s1", "s2", "n"], "size").select(*shown)
    alone = profile.filter(~has_class).withColumns({"class_id": F.col("doc_id"), "n_links": F.lit(0).cast("long")})
    return found.unionByName(alone.select(*shown))


def one_of_each_class(docs: DataFrame) -> DataFrame:
    """The documents without those whose class has a smaller doc_id; rows of one doc_id stand together."""
    (name,) = free_names(docs.columns, "later")
    later = jaccard_classes(docs).filter(F.col("class_id") < F.col("doc_id")).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(later, F.col("doc_id") == F.col(name), "left_anti")


def op3_chosen_path_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op3_chosen_path_join": op3_chosen_path_join}
ORACLE_SQL = {
    "op3_chosen_path_join": f"""
WITH RECURSIVE w AS (
  SELECT doc_id, coalesce(list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda x: length(x) > 0), []) AS w FROM documents),
shingle AS (
  SELECT doc_id, array_to_string(w[i:i+{SHINGLE - 1}], ' ') AS s
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - {SHINGLE - 1}))) AS i FROM w WHERE len(w) > 0)
  GROUP BY ALL),
sets AS (SELECT doc_id, count(*) AS n, md5(string_agg(s, chr(10) ORDER BY s)) AS k FROM shingle GROUP BY doc_id),
rep AS (SELECT k, min(doc_id) AS rep, any_value(n) AS n FROM sets GROUP BY k),
rs AS (SELECT rep, n, s FROM rep JOIN shingle ON rep = doc_id),
pair AS (
  SELECT a.rep AS a, b.rep AS b FROM rs a JOIN rs b ON a.s = b.s AND a.rep <> b.rep GROUP BY a.rep, b.rep, a.n, b.n
  HAVING count(*) >= {THRESHOLD} * (a.n + b.n - count(*)) - 1e-6),
reach AS (
  SELECT rep AS a, rep AS b FROM rep
  UNION
  SELECT r.a, p.b FROM reach r JOIN pair p ON r.b = p.a),
class AS (SELECT a AS rep, min(b) AS class_id FROM reach GROUP BY a),
links AS (SELECT a AS rep, count(*) AS n_links FROM pair GROUP BY a)
SELECT w.doc_id, coalesce(c.class_id, w.doc_id) AS class_id, CAST(coalesce(l.n_links, 0) AS BIGINT) AS n_links, CAST(coalesce(s.n, 0) AS INTEGER) AS n_shingles
FROM w LEFT JOIN sets s ON s.doc_id = w.doc_id LEFT JOIN rep r ON r.k = s.k LEFT JOIN class c ON c.rep = r.rep LEFT JOIN links l ON l.rep = r.rep""",
}
