"""Language identification (operator 8): a byte convolutional network.

Bytes are embedded, filters of widths 2, 3 and 4 run over windows of ``WINDOW`` bytes, each filter's
largest response goes through a rectifier into a softmax over the languages. Trained in numpy by Adam
on all windows of the whole texts of at most ``TRAIN_ROWS`` documents of the training folds, in hash
order of their id: the one bound on what is learned from.

Every whole text is tiled by windows; a text's score is the mean of its windows' probabilities,
weighted by their bytes. Filters are evaluated from tables of byte pairs, which are the embeddings
multiplied out: fixed size, sent by broadcast.

Defined results: a null text, or one without any letter, is ``und`` with score 0; without training
rows every text is ``und``; a null language is not learned from; of rows that share a doc_id the least
language and the least text are learned from; repeated rows are each judged; an empty table gives no
rows; other columns pass through whatever their names, but columns named ``lang_pred`` and ``score``
make way for the results of ``predict``. ``identified`` returns the columns that it was given.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.folds import held_out
from plumbline.llm.word_arrays import slices, text_bytes

WINDOW = 128
WIDTHS = (2, 3, 4)
FILTERS = 8
DIM = 8
TRAIN_ROWS = 2000
EPOCHS = 4
BATCH = 128
UNKNOWN = "und"
MIN_SCORE = 0.4
SURE = 0.9


def tiles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows (padded with 0), the text of each, and its bytes."""
    data, at = text_bytes(texts)
    sizes = np.diff(at)
    per = -(-sizes // WINDOW)
    owner = np.repeat(np.arange(len(sizes)), per)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)
    start = at[:-1][owner] + number * WINDOW
    length = np.minimum(WINDOW, at[1:][owner] - start)
    place = start[:, None] + np.arange(WINDOW)
    out = np.append(data, np.zeros(WINDOW, np.uint8))[place] if len(data) else np.zeros((0, WINDOW), np.uint8)
    out[np.arange(WINDOW) >= length[:, None]] = 0
    return out, owner, length


class ByteNet:
    """The network's parameters, its training and its evaluation."""

    def __init__(self, languages: list[str], seed: int = 8):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.p = {"embed": rng.normal(0, 0.3, (256, DIM)), "out": rng.normal(0, 0.2, (len(WIDTHS) * FILTERS, len(languages))), "out_bias": np.zeros(len(languages))}
        for w in WIDTHS:
            self.p[f"f{w}"] = rng.normal(0, (w * DIM) ** -0.5, (w * DIM, FILTERS))
            self.p[f"b{w}"] = np.zeros(FILTERS)
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, n = self.p, len(x)
        e = p["embed"][x]
        pooled, saved = [], []
        for w in WIDTHS:
            cols = np.concatenate([e[:, k : WINDOW - w + 1 + k] for k in range(w)], axis=2)
            r = cols @ p[f"f{w}"] + p[f"b{w}"]
            top = r.argmax(1)
            pooled.append(np.take_along_axis(r, top[:, None, :], 1)[:, 0])
            saved.append((cols, top))
        h = np.concatenate(pooled, 1)
        active = h > 0
        h = h * active
        logits = h @ p["out"] + p["out_bias"]
        q = np.exp(logits - logits.max(1, keepdims=True))
        q /= q.sum(1, keepdims=True)
        q[np.arange(n), y] -= 1
        q /= n
        g = {"out": h.T @ q, "out_bias": q.sum(0), "embed": np.zeros_like(p["embed"])}
        gh = (q @ p["out"].T) * active
        row = np.arange(n)[:, None]
        for i, (w, (cols, top)) in enumerate(zip(WIDTHS, saved)):
            part = gh[:, i * FILTERS : (i + 1) * FILTERS]
            best = cols[row, top]  # (window, filter, w * DIM): the input at each filter's best place
            g[f"f{w}"] = np.einsum("nf,nfd->df", part, best)
            g[f"b{w}"] = part.sum(0)
            back = part[:, :, None] * p[f"f{w}"].T[None]
            for k in range(w):
                np.add.at(g["embed"], x[row, top + k], back[:, :, k * DIM : (k + 1) * DIM])
        return g

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, rate: float = 0.01, seed: int = 8) -> ByteNet:
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        t = 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for a in range(0, len(x), BATCH):
                rows = order[a : a + BATCH]
                t += 1
                for k, g in self._gradients(x[rows], y[rows]).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    s[k] = 0.999 * s[k] + 0.001 * g * g
                    self.p[k] -= (rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
        return self

    def tables(self) -> dict[str, np.ndarray]:
        """Responses of each filter to a byte pair at its even places (and to a single last byte)."""
        out = {}
        for w in WIDTHS:
            f = self.p[f"f{w}"].reshape(w, DIM, FILTERS)
            single = [(self.p["embed"] @ f[k]).astype(np.float32) for k in range(w)]
            for k in range(0, w - 1, 2):
                out[f"{w},{k}"] = (single[k][:, None] + single[k + 1][None]).reshape(65536, FILTERS)
            if w % 2:
                out[f"{w},{w - 1}"] = single[w - 1]
        return out

    def probabilities(self, x: np.ndarray, tables: dict[str, np.ndarray]) -> np.ndarray:
        out = np.empty((len(x), len(self.languages)), np.float32)
        for a in range(0, len(x), 256):
            part = x[a : a + 256].astype(np.int32)
            pair = part[:, :-1] * 256 + part[:, 1:]
            pooled = []
            for w in WIDTHS:
                n = WINDOW - w + 1
                r = tables[f"{w},0"][pair[:, :n]]
                for k in range(2, w - 1, 2):
                    r += tables[f"{w},{k}"][pair[:, k : k + n]]
                if w % 2:
                    r += tables[f"{w},{w - 1}"][part[:, w - 1 : w - 1 + n]]
                pooled.append(r.max(1) + self.p[f"b{w}"])
            logits = np.maximum(np.concatenate(pooled, 1), 0) @ self.p["out"] + self.p["out_bias"]
            q = np.exp(logits - logits.max(1, keepdims=True))
            out[a : a + 256] = q / q.sum(1, keepdims=True)
        return out


def training_windows(docs: DataFrame, rows: int = TRAIN_ROWS) -> tuple[np.ndarray, list[str]]:
    """Windows and languages of at most ``rows`` documents of the training folds."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = known.groupBy("doc_id").agg(F.min("lang").alias("lang")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)

    def cut(batches):
        for batch in batches:
            for a, b in slices(batch.column("text")):
                x, owner, _ = tiles(batch.column("text").slice(a, b - a))
                who = pa.array(owner + a)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(who), batch.column("lang").take(who), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "lang", "bytes"])

    # ``chosen`` has at most ``rows`` rows
    picked = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    ready = picked.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text")
    found = ready.mapInArrow(cut, "doc_id long, lang string, bytes binary").toArrow()
    # a document's windows stay in order: it is cut by one task
    order = np.argsort(found.column("doc_id").to_numpy(), kind="stable")
    windows = np.frombuffer(b"".join(found.column("bytes").to_pylist()), np.uint8).reshape(-1, WINDOW)[order]
    return windows, found.column("lang").take(pa.array(order)).to_pylist()


def learn(docs: DataFrame, rows: int = TRAIN_ROWS) -> ByteNet:
    x, labels = training_windows(docs, rows)
    languages = sorted(set(labels))
    net = ByteNet(languages or [UNKNOWN])
    return net.fit(x, np.searchsorted(np.array(languages), labels)) if languages else net


def predict(docs: DataFrame, net: ByteNet) -> DataFrame:
    """The documents' columns with ``lang_pred`` and ``score``."""
    sent = docs.sparkSession.sparkContext.broadcast((net, net.tables()))  # fixed size

    def run(batches):
        net, tables = sent.value
        names = np.array(net.languages, object)
        for batch in batches:
            for a, b in slices(batch.column(at)):
                part = batch.slice(a, b - a)
                x, owner, length = tiles(part.column(at))
                weighted = net.probabilities(x, tables) * length[:, None]
                total = np.stack([np.bincount(owner, weighted[:, k], minlength=b - a) for k in range(len(names))], 1)
                share = total / np.maximum(1, np.bincount(owner, length, minlength=b - a))[:, None]
                letters = np.array(part.column(part.num_columns - 1))
                best = share.argmax(1)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array(np.where(letters, names[best], UNKNOWN).tolist(), pa.string()), pa.array(np.where(letters & (names[best] != UNKNOWN), np.clip(share.max(1), 0, 1), 0.0), pa.float64())],
                    names=[*part.schema.names[:-1], "lang_pred", "score"],
                )

    names = [c for c in docs.columns if c not in ("lang_pred", "score")]
    at = names.index("text")
    kept = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])  # any name will do, with dots as well
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema)
    has = F.coalesce(F.col(f"c{at}").rlike(r"\p{L}"), F.lit(False))
    return kept.withColumn("letters", has).mapInArrow(run, f"{fields}, lang_pred string, score double").toDF(*names, "lang_pred", "score")


def identified(docs: DataFrame, rows: int = TRAIN_ROWS, min_score: float = MIN_SCORE, sure: float = SURE, languages: list[str] | None = None) -> DataFrame:
    """The documents whose language is told, with that language in ``lang``.

    Rejected are documents without letters, those whose best language scores under ``min_score``, those
    whose ``lang`` the network contradicts with a score under ``sure`` (then neither is known), and with
    ``languages`` those in other languages. From ``sure`` on the prediction replaces a ``lang`` that it
    contradicts; a null ``lang`` is filled.
    """
    net = learn(docs, rows)
    own = [c if c == "text" else f"c{i}" for i, c in enumerate(docs.columns)]
    mine = docs.select(*[F.col(f"`{c}`").alias(name) for c, name in zip(docs.columns, own)])
    lang = F.col(own[docs.columns.index("lang")])
    contradicted = F.coalesce(lang != F.col("lang_pred"), F.lit(False))
    known = (F.col("lang_pred") != UNKNOWN) & (F.col("score") >= min_score) & ~(contradicted & (F.col("score") < sure))
    out = predict(mine, net).filter(known)
    if languages is not None:
        out = out.filter(F.col("lang_pred").isin(languages))
    return out.select(*[(F.col("lang_pred") if c == "lang" else F.col(name)).alias(c) for c, name in zip(docs.columns, own)])


def op8_byte_convolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = predict(docs.select("doc_id", "text"), learn(docs.select("doc_id", "text", "lang")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


QUERIES = {"op8_byte_convolution": op8_byte_convolution}
ORACLE_SQL: dict[str, str] = {}
