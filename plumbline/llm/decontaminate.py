"""Benchmark decontamination (operator 4): size-partitioned MinHash containment search.

An item is *contained* in a document if at least ``THRESHOLD`` of its distinct shingles (5 words)
stand in the document. A short item has a tiny Jaccard similarity with a long document, so documents
are searched by windows whose size fits the item:

* items are partitioned by size: class c holds items of up to 2 * 2**c shingles, and of more than half of that;
* for each class a document is covered by windows of twice that size at half-window steps, so that
  any run of 2 * 2**c shingles lies in one window, and its MinHash minima are pairwise minima of the
  next smaller class's blocks;
* a contained item of the class then has a Jaccard similarity of 0.19 at least with some window, and
  one of ``FUNCTIONS`` minima agrees with a probability of 1 - (1 - J)**FUNCTIONS;
* every candidate (document, item) is verified by exact shingle containment.

The item index goes to the executors by broadcast in blocks of at most ``BLOCK_SHINGLES`` item
shingles, a fixed bound; a larger benchmark is searched block after block against all documents.

Defined results: null, empty and shorter texts (under 5 words) have no shingles; such an item is
contained nowhere, such a document contains nothing. Repeated rows give repeated matches. An empty
table on either side gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.columns import free_names
from plumbline.llm.word_arrays import Words, mix, slices, words

SHINGLE = 5
THRESHOLD = 0.8
FUNCTIONS = 64
SMALLEST = 2
BLOCK_SHINGLES = 1_000_000
_SALTS = np.random.default_rng(4).integers(1, 2**63, FUNCTIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def size_class(n: np.ndarray) -> np.ndarray:
    return np.maximum(0, np.ceil(np.log2(np.maximum(n, 1) / SMALLEST))).astype(np.int64)


def _ranks(shingles: np.ndarray, f: int) -> np.ndarray:
    """The rank of each shingle under MinHash function ``f``: the high half of a product."""
    return ((shingles * _SALTS[f]) >> np.uint64(32)).astype(np.uint32)


class ItemIndex:
    """A block of items: their shingle sets, and per size class and function the sorted minima."""

    def __init__(self, ids: list[int | None], texts: pa.Array):
        w = words(texts)
        keep, h = w.whole(SHINGLE), w.windows(SHINGLE)
        doc = w.doc[: len(h)][keep]
        h = h[keep]
        sets = [(i, np.unique(h[a:b])) for i, a, b in zip(ids, np.searchsorted(doc, np.arange(len(ids))), np.searchsorted(doc, np.arange(len(ids)), "right"))]
        self.items = [(i, s) for i, s in sets if len(s)]
        self.classes: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        sizes = np.array([len(s) for _, s in self.items], np.int64)
        for c in np.unique(size_class(sizes)).tolist():
            own = np.flatnonzero(size_class(sizes) == c)
            table = []
            for f in range(FUNCTIONS):
                minima = np.array([_ranks(self.items[k][1], f).min() for k in own], np.uint32)
                order = np.argsort(minima, kind="stable")
                table.append((minima[order], own[order]))
            self.classes[c] = table

    def candidates(self, h: np.ndarray, doc: np.ndarray) -> list[tuple[int, int]]:
        """(document number, item number) pairs with an agreeing minimum in some window."""
        if not len(h) or not self.classes:
            return []
        # blocks of half the smallest class's size that do not cross documents
        first = np.searchsorted(doc, doc, "left")
        place = np.arange(len(h)) - first
        least, most = min(self.classes), max(self.classes)
        half = SMALLEST * 2**least // 2
        opens = np.flatnonzero((place % half) == 0)
        owner = doc[opens]
        found: set[tuple[int, int]] = set()
        for f in range(FUNCTIONS):
            level = np.minimum.reduceat(_ranks(h, f), opens)
            for c in range(least, most + 1):
                # level: minima over half of the class size; a window is four such blocks on end
                if c in self.classes:
                    minima, own = self.classes[c][f]
                    spot = np.searchsorted(minima, level, "left")
                    hit = np.flatnonzero(minima[np.minimum(spot, len(minima) - 1)] == level)
                    # an item agrees with a window only through the least of the window's four blocks
                    for k in hit[self._least_of_window(level, owner, hit)].tolist():
                        a = spot[k]
                        while a < len(minima) and minima[a] == level[k]:
                            found.add((int(owner[k]), int(own[a])))
                            a += 1
                if c < most:
                    level, owner = self._halved(level, owner)
            owner = doc[opens]
        return sorted(found)

    @staticmethod
    def _least_of_window(level: np.ndarray, owner: np.ndarray, hit: np.ndarray) -> np.ndarray:
        """Of the blocks ``hit``, which are the least of at least one window of four blocks of the document."""
        out = np.zeros(len(hit), bool)
        n = len(level)
        for shift in range(-3, 1):
            ok = np.ones(len(hit), bool)
            for j in range(4):
                at = hit + shift + j
                inside = (at >= 0) & (at < n)
                at = np.clip(at, 0, n - 1)
                same = inside & (owner[at] == owner[hit])
                ok &= ~same | (level[at] >= level[hit])
            out |= ok
        return out

    @staticmethod
    def _halved(level: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Minima of pairs of neighbouring blocks, counted from each document's first."""
        first = np.searchsorted(owner, owner, "left")
        opens = np.flatnonzero(((np.arange(len(level)) - first) % 2) == 0)
        return np.minimum.reduceat(level, opens), owner[opens]

    def matches(self, w: Words, threshold: float) -> list[tuple[int, int | None, int, int]]:
        """(document number, item id, item shingles, shared shingles) of verified containments."""
        h, keep = w.windows(SHINGLE), w.whole(SHINGLE)
        doc = w.doc[: len(h)][keep]
        h = h[keep]
        out, cached, own = [], -1, None
        for d, k in self.candidates(h, doc):
            if d != cached:
                a, b = np.searchsorted(doc, d), np.searchsorted(doc, d, "right")
                cached, own = d, np.sort(h[a:b])
            item, s = self.items[k]
            at = np.minimum(np.searchsorted(own, s), len(own) - 1)
            shared = int((own[at] == s).sum())
            if shared >= threshold * len(s) - 1e-9:
                out.append((d, item, len(s), shared))
        return out


def item_blocks(items: DataFrame, limit: int = BLOCK_SHINGLES) -> Iterator[tuple[list[int | None], pa.Array]]:
    """The benchmark in blocks of at most ``limit`` words (one item at least), fetched one by one."""
    ids, texts, size = [], [], 0
    for row in items.select("item_id", "text").toLocalIterator():
        n = len((row.text or "").split())
        if ids and size + n > limit:
            yield ids, pa.array(texts, pa.string())
            ids, texts, size = [], [], 0
        ids.append(row.item_id)
        texts.append(row.text)
        size += n
    if ids:
        yield ids, pa.array(texts, pa.string())


SCHEMA = "doc_id bigint, item_id bigint, n_item_shingles int, n_shared int"


def contained_items(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each (document, item) such that the document contains the item."""
    spark = docs.sparkSession
    out = spark.createDataFrame([], SCHEMA)
    for ids, texts in item_blocks(items):
        index = spark.sparkContext.broadcast(ItemIndex(ids, texts))

        def search(batches, index=index):
            for batch in batches:
                doc_ids, texts = batch.column("doc_id"), batch.column("text")
                rows = []
                for a, b in slices(texts):
                    rows += [(doc_ids[a + d].as_py(), *rest) for d, *rest in index.value.matches(words(texts.slice(a, b - a)), threshold)]
                if rows:
                    cols = list(zip(*rows))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int32())],
                        names=["doc_id", "item_id", "n_item_shingles", "n_shared"],
                    )

        out = out.unionByName(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(search, SCHEMA))
    return out


def clean_documents(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that contain no benchmark item."""
    (name,) = free_names(docs.columns, "dirty")
    dirty = contained_items(docs, items, threshold).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(dirty, F.col("doc_id").eqNullSafe(F.col(name)), "left_anti")


def op4_benchmark_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = contained_items(docs, items)
    return found.withColumn("containment", F.round(F.col("n_shared") / F.col("n_item_shingles"), 6))


QUERIES = {"op4_benchmark_containment": op4_benchmark_containment}
_SHINGLES = """
  SELECT DISTINCT {id}, array_to_string(w[i:i+4], ' ') AS s
  FROM (SELECT {id}, w, unnest(generate_series(1, len(w) - 4)) AS i
        FROM (SELECT {id}, list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda x: length(x) > 0) AS w FROM {table}) WHERE len(w) >= 5)"""
ORACLE_SQL = {
    "op4_benchmark_containment": f"""
WITH item AS ({_SHINGLES.format(id="item_id", table="benchmark")}),
doc AS ({_SHINGLES.format(id="doc_id", table="documents")}),
size AS (SELECT item_id, count(*) AS n FROM item GROUP BY item_id),
shared AS (SELECT doc_id, item_id, count(*) AS n_shared FROM doc JOIN item USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, CAST(n AS INTEGER) AS n_item_shingles, CAST(n_shared AS INTEGER) AS n_shared, round(n_shared / n, 6) AS containment
FROM shared JOIN size USING (item_id) WHERE n_shared >= {THRESHOLD} * n - 1e-9""",
}
