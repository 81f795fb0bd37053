"""Operator 2, quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE bytes, over its whole text. Each passage is encoded (byte and byte-pair histograms and
word repetition, through a learned layer), gated attention weighs the passages, and the weighted sum is scored:

    h_p = tanh(W x_p + b);  a = softmax_p(w . (tanh(V h_p) * sigmoid(U h_p)));  score = sigmoid(o . sum_p a_p h_p + c)

All of W, V, U, w, o are learned together from document labels alone, by Adam with fixed seeds. Training takes at most
TRAIN_PER_CLASS documents and TRAIN_BYTES bytes of text of each label, those of the smallest hash of their id, among the rows that are not
held out; the intercept is then shifted back to the labels' true shares. Only the text enters a score.

Cases: a null or empty text is one empty passage and gets a score; labels that are null or of unknown documents are left out; a document with several
labels takes their mean, 0.5 and over as 1; without any label of one class every score is the share of
label 1 (0.5 with no labels at all); repeated rows score alike; a labelled text of more than TRAIN_BYTES bytes is not learned from, and scored
like any other; scored() keeps columns of docs that are named score or predicted, and its own then end in an underscore.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import by_bytes, private, table
from .words import word_hashes

PASSAGE, TRAIN_PER_CLASS, THRESHOLD = 400, 1500, 0.3
#: Of the texts that one task learns from, for each label; their features take about 3.3 times as much, twice.
TRAIN_BYTES = 24 << 20
PAIRS, EXTRA = 192, 6
FEATURES = 128 + PAIRS + EXTRA
HIDDEN, GATE, EPOCHS = 24, 12, 24


def passages(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages and the first passage of each text."""
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    counts = np.maximum(1, -(-lengths // PASSAGE))
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64)
    n = int(counts.sum())
    raw = np.frombuffer(b"".join(texts), dtype=np.uint8)
    offsets = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    doc = np.repeat(np.arange(len(texts)), lengths)
    at = (starts[doc] + (np.arange(len(raw)) - offsets[doc]) // PASSAGE).astype(np.int64)
    size = np.bincount(at, minlength=n).astype(np.float32)
    ones = np.bincount(at * 128 + np.minimum(raw, 127), minlength=n * 128).reshape(n, 128)
    pair = ((raw[:-1].astype(np.int64) * 31 + raw[1:]) * 2654435761 >> 7) % PAIRS
    inside = doc[1:] == doc[:-1]  # a pair of bytes of two texts counts for neither
    pairs = np.bincount((at[1:] * PAIRS + pair)[inside], minlength=n * PAIRS).reshape(n, PAIRS)
    word, place = word_hashes(raw, np.concatenate([offsets, [len(raw)]]).astype(np.int64))
    mine = at[place] if len(word) else np.zeros(0, dtype=np.int64)
    words = np.bincount(mine, minlength=n).astype(np.float32)
    again = np.zeros(len(word), dtype=bool)
    again[1:] = (word[1:] == word[:-1]) & (mine[1:] == mine[:-1])
    repeat = np.bincount(mine[again], minlength=n)
    order = np.lexsort((word, mine))
    w, m = word[order], mine[order]
    fresh = np.ones(len(w), dtype=bool)
    fresh[1:] = (w[1:] != w[:-1]) | (m[1:] != m[:-1])
    distinct = np.bincount(m[fresh], minlength=n)
    most = np.maximum(words, 1)
    extra = np.stack([np.log1p(size), words / np.maximum(size, 1) * 5, repeat / most, distinct / most, np.log1p(words), np.log1p(lengths[np.repeat(np.arange(len(texts)), counts)])], axis=1)
    scale = 1 / np.sqrt(np.maximum(size, 1))[:, None]
    return np.concatenate([np.sqrt(ones) * scale, np.sqrt(pairs) * scale, extra], axis=1).astype(np.float32), starts


def in_parts(texts: list[bytes], limit: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """passages() of many texts, made a part at a time, as its intermediate arrays take some hundred bytes a byte."""
    xs, starts, i, n = [], [], 0, 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) <= limit):
            size += len(texts[j])
            j += 1
        x, s = passages(texts[i:j])
        xs.append(x)
        starts.append(s + n)
        i, n = j, n + len(x)
    return np.concatenate(xs), np.concatenate(starts)


class GatedAttention:
    """The model. Passages of all documents lie one after the other; starts marks each document's first."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        draw = lambda *shape: (r.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.mean, self.spread, self.shift = np.zeros(FEATURES, np.float32), np.ones(FEATURES, np.float32), 0.0
        self.p = {"W": draw(FEATURES, HIDDEN), "b": np.zeros(HIDDEN, np.float32), "V": draw(HIDDEN, GATE), "U": draw(HIDDEN, GATE), "w": draw(GATE), "o": draw(HIDDEN), "c": np.zeros(1, np.float32)}

    def forward(self, x, starts):
        p = self.p
        h = np.tanh(x @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (t * g) @ p["w"]
        owner = np.repeat(np.arange(len(starts)), np.diff([*starts, len(x)]))
        e = np.exp(e - np.maximum.reduceat(e, starts)[owner])
        a = e / np.add.reduceat(e, starts)[owner]
        z = np.add.reduceat(a[:, None] * h, starts, axis=0)
        return h, t, g, a, z, owner, z @ p["o"] + p["c"][0]

    def step(self, x, starts, y):
        """The gradient of the mean log loss."""
        p = self.p
        h, t, g, a, z, owner, s = self.forward(x, starts)
        ds = ((1 / (1 + np.exp(-s)) - y) / len(y)).astype(np.float32)
        dz = ds[:, None] * p["o"]
        da = (dz[owner] * h).sum(axis=1)
        de = a * (da - np.add.reduceat(a * da, starts)[owner])
        dt, dg = de[:, None] * p["w"] * g * (1 - t * t), de[:, None] * p["w"] * t * g * (1 - g)
        dh = (a[:, None] * dz[owner] + dt @ p["V"].T + dg @ p["U"].T) * (1 - h * h)
        return {"W": x.T @ dh, "b": dh.sum(axis=0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ de, "o": z.T @ ds, "c": ds.sum(keepdims=True)}

    def fit(self, texts: list[bytes], labels: np.ndarray, share: float, epochs: int = EPOCHS, bag: int = 32, rate: float = 3e-3):
        """share: of label 1 among all labelled rows, to which the intercept is shifted."""
        x, starts = in_parts(texts)
        self.mean = x.mean(axis=0)
        x -= self.mean
        self.spread = np.sqrt(np.einsum("ij,ij->j", x, x) / len(x)) + np.float32(1e-3)
        x /= self.spread
        ends = np.append(starts[1:], len(x))
        r, y = np.random.default_rng(11), labels.astype(np.float32)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(u) for k, u in self.p.items()}
        n = 0
        for epoch in range(epochs):
            order = r.permutation(len(y))
            for i in range(0, len(y), bag):
                own = order[i : i + bag]
                rows = np.concatenate([np.arange(starts[d], ends[d]) for d in own])
                first = np.concatenate([[0], np.cumsum(ends[own] - starts[own])[:-1]]).astype(np.int64)
                n += 1
                for k, grad in self.step(x[rows], first, y[own]).items():
                    grad = grad + 1e-4 * self.p[k]
                    m[k] = 0.9 * m[k] + 0.1 * grad
                    v[k] = 0.999 * v[k] + 0.001 * grad * grad
                    now = rate * (1 - epoch / epochs)
                    self.p[k] = (self.p[k] - now * (m[k] / (1 - 0.9**n)) / (np.sqrt(v[k] / (1 - 0.999**n)) + 1e-8)).astype(np.float32)
        here = float(y.mean())
        self.shift = float(np.log(share / (1 - share)) - np.log(here / (1 - here)))
        return self

    def score(self, texts: list[bytes]) -> np.ndarray:
        x, starts = passages(texts)
        s = self.forward((x - self.mean) / self.spread, starts)[-1].astype(np.float64)
        return np.round(1 / (1 + np.exp(-(s + self.shift))), 6)  # beyond, sums depend on what else is in the batch


class Constant:
    def __init__(self, value: float):
        self.value = value

    def score(self, texts):
        return np.full(len(texts), self.value)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, per_class: int = TRAIN_PER_CLASS, use: Column | None = None, most_bytes: int = TRAIN_BYTES):
    """The model from at most per_class documents and most_bytes bytes of text of each label. use: which rows of labels may be learned from."""
    rows = labels.where("doc_id is not null and quality is not null")
    rows = rows.where(~held_out(F.col("doc_id")) if use is None else use)
    rows = rows.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg("quality") >= 0.5).cast("int").alias("y"))
    shares = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    total = sum(shares.values())
    if len(shares) < 2:
        return Constant(shares.get(1, 0) / total if total else 0.5)
    picked = rows.where("y = 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class).unionByName(rows.where("y = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class))
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).where(F.octet_length("text") <= most_bytes)
    got = texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y"))  # at most 2 * per_class rows
    so_far = F.sum(F.octet_length("text")).over(Window.partitionBy("y").orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    got = got.withColumn("bytes", so_far).where(F.col("bytes") <= most_bytes)
    share = shares[1] / total

    def train(batches):
        if not (rows := sorted(r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))):
            return
        y = np.array([r[2] for r in rows], dtype=np.float32)
        model = GatedAttention().fit([r[1].encode() for r in rows], y, share) if 0 < y.sum() < len(y) else Constant(share)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    # One task learns, as its rows are bounded; the driver gets the model alone.
    learned = got.select("doc_id", "text", "y").repartition(1).mapInArrow(train, "model binary").first()
    return pickle.loads(learned["model"]) if learned else Constant(share)


def scored(docs: DataFrame, model, threshold: float = THRESHOLD) -> DataFrame:
    """All columns of docs, with score and predicted (under the names of private(), where docs has them)."""
    at, score, predicted = docs.columns.index("text"), private("score", docs), private("predicted", docs)

    def run(batches):
        for batch in batches:
            for b in by_bytes(batch, at, 1 << 20):
                s = model.score([t or b"" for t in b.column(at).cast(pa.binary()).to_pylist()])
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32), pa.int32())], names=[*b.schema.names, score, predicted])

    from pyspark.sql import types as T

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(score, T.DoubleType()), T.StructField(predicted, T.IntegerType())]))


def op2_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = learn(docs, table(spark, sf_dir, "labels"))
    # Only the id goes along with the text, as it names the row; the score is of the text alone.
    return scored(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
