"""Exact top-k inner products (operator 7) by dual-tree search over cover trees.

Components become the integers floor(64 * x). Queries and data meet in a grid: data rows are dealt to
slices, queries to blocks, by hash, and each (query block, slice) is one task that builds a cover tree
over its queries and one over every ``BLOCK`` rows of its slice. A node pair (Q, X) is pruned if

    <cQ, cX> + |cQ| rX + |cX| rQ + rQ rX  <  the worst kth score of the queries under Q,

with centres c (points themselves) and covering radii r, and queries under Q by their own kth score.
What is left is evaluated by matrix products; per-query results of the slices merge by a window. The
search is exact: nothing is sampled, and a tie is never pruned.

Where a set has no structure (its points lie at nearly equal distances, as random vectors of many
dimensions do) its node stays one leaf: a ball around any two points then reaches every query's best
scores, no bound can prune, and the search is one product. ``DualTree.evaluated`` of ``offered`` tells.

Defined results: null vectors, vectors with null or non-finite components and rows without vec_id
take no part; rows with one vec_id are each a candidate and a query, and only a row itself is left out
of its own result (equal rows are interchangeable); shorter vectors are padded with 0; other columns
are ignored; an empty table gives no rows. Scores must fit a long.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TOP = 20
QUERY_STEP = 20
QUERY_BLOCK = 8192
SLICE = 65_536
BLOCK = 8192
LEAF = 64
GROUP = 256
QUERY_LEAF = 64

FOUND = "query_id long, query_row long, vec_id long, score long"


class CoverTree:
    """A cover tree over points: every centre is a point, a node's first child has the node's own centre
    (nesting), children's centres lie more than half of the node's radius apart (separation) and all
    points within that half of one of them (covering)."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points = points.astype(np.float64)
        self.squares = (self.points * self.points).sum(1)
        self.centre: list[int] = []
        self.radius: list[float] = []
        self.children: list[list[int]] = []
        self.rows: list[np.ndarray] = []
        if len(points):
            rows = np.arange(len(points))
            first = int(self._squared(rows, self.points.mean(0)).argmin())
            self._node(rows, first, self._squared(rows, self.points[first]), leaf)
        self.centres = self.points[self.centre]
        self.radii = np.array(self.radius)
        self.norms = np.linalg.norm(self.centres, axis=1)

    def _squared(self, rows: np.ndarray, point: np.ndarray) -> np.ndarray:
        return np.maximum(0, self.squares[rows] - 2 * (self.points[rows] @ point) + point @ point)

    def _node(self, rows: np.ndarray, centre: int, away: np.ndarray, leaf: int) -> int:
        """Adds the node of ``rows``, whose squared distances from ``centre`` are ``away``."""
        me = len(self.centre)
        # the product form of a distance is off by rounding: widen the radius by more than that
        slack = 1e-7 * float(np.sqrt(self.squares[rows].max()))
        self.centre.append(centre)
        self.radius.append(float(np.sqrt(away.max())) * (1 + 1e-9) + slack)
        self.children.append([])
        self.rows.append(rows)
        if len(rows) <= leaf or away.max() <= slack * slack:
            return me
        cover = self._cover(rows, centre, away)
        if cover is not None:
            centres, part, near = cover
            self.children[me] = [self._node(rows[part == k], c, near[part == k], leaf) for k, c in enumerate(centres)]
            self.rows[me] = rows[:0]
        return me

    def _cover(self, rows: np.ndarray, centre: int, away: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray] | None:
        """Centres, each row's nearest of them and its squared distance: the farthest row becomes the next
        centre until all lie within half of the radius. None if that takes too many to be of use."""
        centres, part, near = [centre], np.zeros(len(rows), np.int64), away.copy()
        bound, most = away.max() / 4, max(64, len(rows) // 16)
        while near.max() > bound:
            if len(centres) == most or (len(centres) == 64 and (near <= bound).sum() < 4 * 64):
                return None  # a centre covers hardly more than itself: no structure to split by
            centres.append(int(rows[near.argmax()]))
            distance = self._squared(rows, self.points[centres[-1]])
            closer = distance < near
            near[closer], part[closer] = distance[closer], len(centres) - 1
        return centres, part, near

    def beneath(self, node: int) -> np.ndarray:
        if not self.children[node]:
            return self.rows[node]
        return np.concatenate([self.beneath(c) for c in self.children[node]])


class TopK:
    """The best ``k`` (score, id) of each query so far, ties to the smaller id."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score = np.full((n, k), np.iinfo(np.int64).min, np.int64)
        self.id = np.full((n, k), np.iinfo(np.int64).max, np.int64)

    def worst(self, rows: np.ndarray) -> int:
        return int(self.score[rows, -1].min())

    def add(self, rows: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Columns ``ids`` (ascending) with their scores; the least long stands for no candidate."""
        n, m = score.shape
        if m > self.k:
            low, high = int(score.min(initial=0, where=score > np.iinfo(np.int64).min)), int(score.max())
            if max(-low, high) < 2**62 // m:
                key = np.where(score > np.iinfo(np.int64).min, score * m - np.arange(m), np.iinfo(np.int64).min)
                pick = np.argpartition(key, m - self.k, axis=1)[:, m - self.k :]
            else:
                pick = np.argsort(-score.astype(object), axis=1, kind="stable")[:, : self.k]
            score, ids = np.take_along_axis(score, pick, 1), ids[pick]
        else:
            ids = np.broadcast_to(ids, score.shape)
        all_score, all_id = np.concatenate([self.score[rows], score], 1), np.concatenate([self.id[rows], ids], 1)
        all_id = np.where(all_score == np.iinfo(np.int64).min, np.iinfo(np.int64).max, all_id)
        # stable sorts: by id, then by falling score
        order = np.argsort(all_id, axis=1, kind="stable")
        all_score, all_id = np.take_along_axis(all_score, order, 1), np.take_along_axis(all_id, order, 1)
        order = np.argsort(~all_score, axis=1, kind="stable")[:, : self.k]
        self.score[rows], self.id[rows] = np.take_along_axis(all_score, order, 1), np.take_along_axis(all_id, order, 1)


class DualTree:
    """Queries under their own cover tree against one block of data after another."""

    def __init__(self, query_ids: np.ndarray, queries: np.ndarray, k: int = TOP, copies: np.ndarray | None = None):
        self.ids, self.queries, self.k = query_ids, queries, k
        self.copies = np.zeros(len(query_ids), np.int64) if copies is None else copies
        self.norms = np.linalg.norm(queries.astype(np.float64), axis=1)
        self.tree = CoverTree(queries, QUERY_LEAF)
        self.under = [self.tree.beneath(i) for i in range(len(self.tree.centre))]
        self.best = TopK(len(query_ids), k)
        self.evaluated = self.offered = 0  # pairs scored, of all pairs

    def search(self, ids: np.ndarray, data: np.ndarray, copies: np.ndarray | None = None) -> None:
        order = np.argsort(ids, kind="stable")
        self.data_ids, self.data = ids[order], data[order]
        self.data_copies = np.zeros(len(ids), np.int64) if copies is None else copies[order]
        self.offered += len(ids) * len(self.ids)
        limit = float(np.abs(self.queries).max(initial=0)) * float(np.abs(self.data).max(initial=0)) * max(1, self.data.shape[1])
        self.kind = np.float64 if limit < 2**53 else np.int64  # products are exact in either
        self.over = CoverTree(self.data)
        if self.over.centre and self.tree.centre:
            self._pair(0, np.array([0]))

    def _bound(self, q: int, nodes: np.ndarray) -> np.ndarray:
        t, o = self.tree, self.over
        bound = o.centres[nodes] @ t.centres[q] + t.norms[q] * o.radii[nodes] + o.norms[nodes] * t.radii[q] + t.radii[q] * o.radii[nodes]
        return bound + 1e-9 * (1 + np.abs(bound))

    def _alive(self, q: int, nodes: np.ndarray) -> np.ndarray:
        bound = self._bound(q, nodes)
        keep = bound >= self.best.worst(self.under[q])
        return nodes[keep][np.argsort(-bound[keep], kind="stable")]

    def _pair(self, q: int, nodes: np.ndarray) -> None:
        """Searches the data under ``nodes`` for the queries under ``q``."""
        nodes = self._alive(q, nodes)
        inner = [n for n in nodes.tolist() if self.over.children[n]]
        if self.tree.children[q]:
            wider = np.array([n for n in nodes.tolist() if not self.over.children[n]] + [c for n in inner for c in self.over.children[n]], np.int64)
            for child in self.tree.children[q]:
                self._pair(child, wider)
            return
        while inner:
            nodes = self._alive(q, np.array([n for n in nodes.tolist() if not self.over.children[n]] + [c for n in inner for c in self.over.children[n]], np.int64))
            inner = [n for n in nodes.tolist() if self.over.children[n]]
        # most promising leaves first, some at a time, so that the worst kth score prunes the rest
        batch, size = [], 0
        for i, n in enumerate(nodes.tolist()):
            batch.append(n)
            size += len(self.over.rows[n])
            if size >= 1024 or i == len(nodes) - 1:
                kept = self._alive(q, np.array(batch))
                if len(kept):
                    self._leaves(self.under[q], kept)
                batch, size = [], 0

    def _leaves(self, rows: np.ndarray, leaves: np.ndarray) -> None:
        """Scores the leaves' points for the queries that their own kth score leaves open."""
        bound = self.queries[rows].astype(np.float64) @ self.over.centres[leaves].T + self.norms[rows, None] * self.over.radii[leaves]
        open_ = bound + 1e-9 * (1 + np.abs(bound)) >= self.best.score[rows, -1][:, None]
        rows, leaves = rows[open_.any(1)], leaves[open_.any(0)]
        if len(rows):
            self._evaluate(rows, np.sort(np.concatenate([self.over.rows[k] for k in leaves.tolist()])))

    def _evaluate(self, rows: np.ndarray, points: np.ndarray) -> None:
        data = self.data[points].astype(self.kind)
        for a in range(0, len(rows), GROUP):
            part = rows[a : a + GROUP]
            score = (self.queries[part].astype(self.kind) @ data.T).astype(np.int64)
            i, j = np.nonzero((self.ids[part][:, None] == self.data_ids[points][None]) & (self.copies[part][:, None] == self.data_copies[points][None]))
            own = (self.queries[part[i]] == self.data[points[j]]).all(1)
            score[i[own], j[own]] = np.iinfo(np.int64).min
            self.evaluated += score.size
            self.best.add(part, score, self.data_ids[points])


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    flat = column.combine_chunks()
    flat = flat if isinstance(flat, pa.Array) else flat.chunk(0)
    sizes = np.diff(flat.offsets.to_numpy())
    out = np.zeros((len(sizes), width), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat.flatten().to_numpy()
    return out


def integer_vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id, v, copy): floor(64 * x) of every vector that takes part; ``copy`` numbers rows that agree
    in both, so that these three name a row whatever the partitioning."""
    x = F.col("embedding")
    sound = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    kept = embeddings.filter(F.col("vec_id").isNotNull() & x.isNotNull() & sound)
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c.cast("double") * 64)).alias("v")).groupBy("vec_id", "v").agg(F.count("*").alias("n")).select("vec_id", "v", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("copy"))


def top_inner_products(embeddings: DataFrame, k: int = TOP, step: int = QUERY_STEP) -> DataFrame:
    """query_id, rank, vec_id, score: for each query the ``k`` best other vectors."""
    vectors = integer_vectors(embeddings)
    is_query = F.col("vec_id") % step == 0
    n, nq, width = vectors.agg(F.count("*"), F.count_if(is_query), F.max(F.size("v"))).first()
    slices, blocks = max(1, -(-n // SLICE)), max(1, -(-nq // QUERY_BLOCK))
    # small tables: as many slices as there are tasks to share the search
    slices = max(slices, min(vectors.sparkSession.sparkContext.defaultParallelism, -(-n // 1024)))
    spread = F.pmod(F.xxhash64("vec_id", "copy"), F.lit(slices))
    data = vectors.select("vec_id", "v", "copy", spread.alias("slice"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    block = F.pmod(F.xxhash64("vec_id", "copy", F.lit(7)), F.lit(blocks)).cast("int")
    queries = vectors.filter(is_query).select("vec_id", "v", "copy", block.alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long"))).alias("slice"))
    dims = int(width or 0)

    def search(key, own, rows):
        if not own.num_rows or not rows.num_rows:
            return pa.table({name: pa.array([], pa.int64()) for name in ("query_id", "query_row", "vec_id", "score")})
        owners, own_copies, own_points = own.column("vec_id").to_numpy(), own.column("copy").to_numpy(), _matrix(own.column("v"), dims)
        dual = DualTree(owners, own_points, k, own_copies)
        ids, copies, points = rows.column("vec_id").to_numpy(), rows.column("copy").to_numpy(), _matrix(rows.column("v"), dims)
        for a in range(0, len(ids), BLOCK):
            dual.search(ids[a : a + BLOCK], points[a : a + BLOCK], copies[a : a + BLOCK])
        got = dual.best.score > np.iinfo(np.int64).min
        each = lambda x: np.repeat(x, k).reshape(got.shape)[got]
        return pa.table({"query_id": each(owners), "query_row": each(own.column("row").to_numpy()), "vec_id": dual.best.id[got], "score": dual.best.score[got]})

    queries = queries.withColumn("row", F.xxhash64("vec_id", "v", "copy"))
    found = queries.groupBy("block", "slice").cogroup(data.groupBy("block", "slice")).applyInArrow(search, FOUND)
    best = Window.partitionBy("query_id", "query_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_cover_tree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_inner_products(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {"op7_cover_tree_topk": op7_cover_tree_topk}
ORACLE_SQL = {
    "op7_cover_tree_topk": f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, d.vec_id, CAST(list_inner_product(q.v, d.v) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % {QUERY_STEP} = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= {TOP}""",
}
