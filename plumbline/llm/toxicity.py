"""Toxicity (operator 6): subword-bag embeddings averaged into a linear softmax.

A text is the bag of its words and of the 4- and 5-byte grams of each word with its boundaries, in
lower case (ASCII), hashed into ``BUCKETS`` rows. The mean of the rows' embeddings goes through a
softmax over the two classes; embeddings and softmax are trained jointly in numpy by Adagrad on at
most ``TRAIN_ROWS`` labelled documents of the training folds, taken in hash order of their id. A
misspelling that was never seen shares grams with the words that were.

To score, the embeddings are folded with the softmax into one weight per bucket, a table of fixed
size, and every whole text is summed over its grams.

Defined results: a null or empty text has an empty bag and gets the score of the bias; a label null
is not learned from; of rows that share a doc_id the least text and the largest label are learned
from; repeated rows are each scored; without labels of both classes every score is
the share of positive labels (0 if there are none); an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.folds import held_out
from plumbline.llm.segments import span_hashes
from plumbline.llm.word_arrays import slices, text_bytes

TRAIN_ROWS = 5000
BUCKETS = 1 << 17
GRAMS = (4, 5)
DIM = 8
EPOCHS = 16
BATCH = 64
RATE = 0.3
SCALE = 40.0

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[9, 10, 11, 12, 13]] = 32
_STEPS = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1)]


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every feature of all texts, and the text it belongs to (in no order of places)."""
    padded = pc.binary_join_element_wise(" ", pc.fill_null(texts, ""), " ", "")
    data, at = text_bytes(padded)
    data = _FOLD[data]
    blank = data == 32
    shift = np.uint32(32 - BUCKETS.bit_length() + 1)
    found, place = [], []
    wide = data.astype(np.uint32) + np.uint32(1)
    inner = np.concatenate([[0], np.cumsum(blank)])
    for n in GRAMS:
        size = len(data) - n + 1
        if size <= 0:
            continue
        h = np.full(size, n, np.uint32)
        for k in range(n):
            h ^= h >> np.uint32(15)
            h += wide[k : k + size] * _STEPS[k]
            h *= _STEPS[0]
        # no blank within, and not both ends blank in a gram of blanks
        fit = np.flatnonzero(inner[n - 1 : n - 1 + size] == inner[1 : 1 + size])
        found.append((h[fit] >> shift).astype(np.int32))
        place.append(fit)
    start = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]])) if len(data) else np.zeros(0, np.int64)
    end = np.flatnonzero(~blank & np.concatenate([blank[1:], [True]])) + 1 if len(data) else start
    found.append((span_hashes(data, start, end) >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int32))
    place.append(start)
    bounds = at[1:]
    return np.concatenate(found), np.concatenate([np.searchsorted(bounds, p, "right") for p in place])


class Bags:
    """Documents as sparse rows: buckets with their share of the document's features."""

    def __init__(self, buckets: list[np.ndarray], shares: list[np.ndarray]):
        self.buckets, self.shares = buckets, shares

    def batch(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        b = np.concatenate([self.buckets[r] for r in rows])
        return b, np.concatenate([self.shares[r] for r in rows]), np.repeat(np.arange(len(rows)), [len(self.buckets[r]) for r in rows])


class Model:
    """The trained parameters: an embedding per bucket, the softmax of the two classes, and its bias."""

    def __init__(self, table: np.ndarray, out: np.ndarray, bias: np.ndarray):
        self.table, self.out, self.bias = table, out, bias

    def forward(self, buckets: np.ndarray) -> float:
        """The probability of the toxic class for one text's features, layer by layer."""
        mean = self.table[buckets].mean(0) if len(buckets) else np.zeros(DIM)
        logits = self.out.astype(float) @ (SCALE * mean) + self.bias
        e = np.exp(logits - logits.max())
        return float(e[1] / e.sum())

    def folded(self) -> tuple[np.ndarray, float]:
        """One weight per bucket and one bias with the same result: the mean and the softmax's logit are
        linear in the embeddings."""
        return (SCALE * (self.table @ (self.out[1] - self.out[0]))).astype(np.float32), float(self.bias[1] - self.bias[0])


def train(bags: Bags, labels: np.ndarray, epochs: int = EPOCHS, seed: int = 6) -> Model:
    """Embeddings and softmax, trained jointly by Adagrad."""
    rng = np.random.default_rng(seed)
    n, positive = len(labels), int(labels.sum())
    if not 0 < positive < n:
        share = positive / n if n else 0.0
        bias = np.log(np.array([max(1 - share, 1e-9), max(share, 1e-9)]))
        return Model(np.zeros((BUCKETS, DIM), np.float32), np.zeros((2, DIM), np.float32), bias)
    table = rng.normal(0, 0.05, (BUCKETS, DIM)).astype(np.float32)
    out = rng.normal(0, 0.3, (2, DIM)).astype(np.float32)
    bias = np.log(np.array([1 - positive / n, positive / n], np.float32))
    seen, seen_out, seen_bias = np.full((BUCKETS, DIM), 1e-6, np.float32), np.full((2, DIM), 1e-6, np.float32), np.full(2, 1e-6, np.float32)
    for _ in range(epochs):
        order = rng.permutation(n)
        for a in range(0, n, BATCH):
            rows = order[a : a + BATCH]
            b, share, doc = bags.batch(rows)
            own, local = np.unique(b, return_inverse=True)
            dense = np.zeros((len(rows), len(own)), np.float32)
            dense[doc, local] = share
            vectors = table[own]
            h = SCALE * (dense @ vectors)
            logits = h @ out.T + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(rows)), labels[rows]] -= 1
            p /= len(rows)
            g_out, g_bias, g = p.T @ h, p.sum(0), SCALE * (dense.T @ (p @ out))
            seen[own] += g * g
            table[own] -= RATE * g / np.sqrt(seen[own])
            seen_out += g_out * g_out
            out -= RATE * g_out / np.sqrt(seen_out)
            seen_bias += g_bias * g_bias
            bias -= RATE * g_bias / np.sqrt(seen_bias)
    return Model(table, out, bias)


def training_bags(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> tuple[Bags, np.ndarray]:
    """The bags of at most ``rows`` labelled documents of the training folds, made on the executors."""
    known = labels.filter(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)

    def bag(batches):
        for batch in batches:
            texts = batch.column("text")
            for a, b in slices(texts):
                part = texts.slice(a, b - a)
                bucket, doc = features(part)
                code, count = np.unique(doc.astype(np.int64) * BUCKETS + bucket, return_counts=True)
                cut = np.searchsorted(code, np.arange(len(part) + 1) * BUCKETS)
                bucket = (code % BUCKETS).astype(np.int32)
                size = np.bincount(doc, minlength=len(part))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(a, b - a),
                        batch.column("toxic").slice(a, b - a),
                        pa.array([bucket[x:y].tobytes() for x, y in zip(cut[:-1], cut[1:])], pa.binary()),
                        pa.array([(count[x:y] / max(1, n)).astype(np.float32).tobytes() for x, y, n in zip(cut[:-1], cut[1:], size)], pa.binary()),
                    ],
                    names=["doc_id", "toxic", "buckets", "shares"],
                )

    # ``chosen`` has at most ``rows`` rows
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))), "doc_id")
    found = picked.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("doc_id", "toxic", "text").mapInArrow(bag, "doc_id long, toxic int, buckets binary, shares binary").collect()
    found.sort(key=lambda r: r.doc_id)
    bags = Bags([np.frombuffer(r.buckets, np.int32) for r in found], [np.frombuffer(r.shares, np.float32) for r in found])
    return bags, np.array([int(r.toxic > 0) for r in found], np.int64)


def score(docs: DataFrame, weights: np.ndarray, bias: float) -> DataFrame:
    """doc_id and score of every whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)  # BUCKETS numbers, whatever the data

    def run(batches):
        for batch in batches:
            texts = batch.column("text")
            for a, b in slices(texts):
                bucket, doc = features(texts.slice(a, b - a))
                total = np.bincount(doc, sent.value[bucket], minlength=b - a)
                size = np.bincount(doc, minlength=b - a)
                logit = np.clip(total / np.maximum(1, size) + bias, -60, 60)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(1 / (1 + np.exp(-logit)), pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """Trains on the training folds and scores every document."""
    out = score(docs, *train(*training_bags(docs, labels, rows)).folded())
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_subword_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES = {"op6_subword_toxicity": op6_subword_toxicity}
ORACLE_SQL: dict[str, str] = {}
