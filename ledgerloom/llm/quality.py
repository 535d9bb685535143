"""Quality by attention-based multiple-instance learning, trained in numpy.

A document is a bag of passages. Every passage is encoded (hashed byte pairs and byte classes, a tanh layer), gated
attention weighs the passages, and a logistic layer scores the weighted sum. Only documents carry labels; encoder,
attention and scorer learn from them together.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytewindows import windows
from .common import held_out, sampled, table, utf8, whole

PASSAGE = 512
BUCKETS = 512
HIDDEN = 24
GATE = 12
#: Passages whose features are held at a time when scoring.
BLOCK = 2048
#: Bounds of the training sample: labelled documents, and bytes of their whole texts.
TRAIN_DOCS, TRAIN_BYTES = 3000, 16 << 20
EPOCHS = 25


@dataclass
class Model:
    encode: np.ndarray  # (BUCKETS, HIDDEN)
    bias: np.ndarray
    tanh: np.ndarray  # (HIDDEN, GATE)
    sigm: np.ndarray  # (HIDDEN, GATE)
    attend: np.ndarray  # (GATE,)
    out: np.ndarray  # (HIDDEN,)
    out_bias: np.ndarray  # (1,)


def features(cut: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Unit-length square roots of hashed byte-pair counts of each passage; a passage without bytes is zero."""
    pair = (cut[:, :-1].astype(np.uint32) * 257 + cut[:, 1:]) * np.uint32(0x9E3779B1) >> np.uint32(23)
    row = np.arange(len(cut), dtype=np.uint32)[:, None] * np.uint32(BUCKETS)
    inside = np.arange(cut.shape[1] - 1) < (own - 1)[:, None]
    counts = np.bincount((pair + row)[inside], minlength=len(cut) * BUCKETS).reshape(len(cut), BUCKETS)
    root = np.sqrt(counts.astype(np.float32))
    return root / np.maximum(np.sqrt((root * root).sum(1, keepdims=True)), 1e-9)


def _encode(m: Model, x: np.ndarray) -> np.ndarray:
    return np.tanh(x @ m.encode + m.bias)


def _attend(m: Model, h: np.ndarray, of: np.ndarray, n: int):
    t, s = np.tanh(h @ m.tanh), 1 / (1 + np.exp(-(h @ m.sigm)))
    e = (t * s) @ m.attend
    top = np.full(n, -np.inf)
    np.maximum.at(top, of, e)
    w = np.exp(e - top[of])
    a = w / np.bincount(of, w, n)[of]
    z = np.stack([np.bincount(of, a * h[:, j], n) for j in range(h.shape[1])], axis=1)
    p = 1 / (1 + np.exp(-np.clip(z @ m.out + m.out_bias, -30, 30)))
    return t, s, a, z, p


def _forward(m: Model, x: np.ndarray, of: np.ndarray, n: int):
    h = _encode(m, x)
    return h, *_attend(m, h, of, n)


def _gradient(m: Model, x: np.ndarray, of: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    h, t, s, a, z, p = _forward(m, x, of, len(y))
    d = (p - y) * weight / len(y)
    dz = d[:, None] * m.out
    da = (dz[of] * h).sum(1)
    de = a * (da - np.bincount(of, a * da, len(y))[of])
    dg = de[:, None] * m.attend
    dt, ds = dg * s * (1 - t * t), dg * t * s * (1 - s)
    dh = a[:, None] * dz[of] + dt @ m.tanh.T + ds @ m.sigm.T
    dx = dh * (1 - h * h)
    return [x.T @ dx, dx.sum(0), h.T @ dt, h.T @ ds, (t * s).T @ de, z.T @ d, np.array([d.sum()])]


def train(bags: list[list[bytes]], labels: list[int], seed: int = 11) -> Model:
    """bags: a document's passages; labels: 1 is good. Classes weigh alike."""
    rng = np.random.default_rng(seed)
    shape = [(BUCKETS, HIDDEN), (HIDDEN,), (HIDDEN, GATE), (HIDDEN, GATE), (GATE,), (HIDDEN,), (1,)]
    m = Model(*[rng.normal(0, 0.3, s) if len(s) == 2 or s[0] == GATE or s == (HIDDEN,) and i == 5 else np.zeros(s) for i, s in enumerate(shape)])
    if not bags:
        return m
    y = np.array(labels, dtype=np.float64)
    good = y.mean()
    weight = np.where(y == 1, 0.5 / max(good, 1e-3), 0.5 / max(1 - good, 1e-3)).clip(0, 20)
    flat = [p for b in bags for p in b]
    x, _, own = windows(flat, PASSAGE)
    x = features(x, own)
    ends = np.cumsum([len(b) for b in bags])
    starts = ends - [len(b) for b in bags]
    names = list(Model.__dataclass_fields__)
    first, second, steps, rate = [0.0] * 7, [0.0] * 7, 0, 0.02
    for _ in range(EPOCHS):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), 64):
            pick = order[at : at + 64]
            rows = np.concatenate([np.arange(starts[i], ends[i]) for i in pick])
            of = np.repeat(np.arange(len(pick)), ends[pick] - starts[pick])
            steps += 1
            for i, g in enumerate(_gradient(m, x[rows], of, y[pick], weight[pick])):
                w = getattr(m, names[i])
                g = g + 1e-5 * w
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                move = first[i] / (1 - 0.9**steps) / (np.sqrt(second[i] / (1 - 0.999**steps)) + 1e-8)
                setattr(m, names[i], w - rate * move)
        rate *= 0.9
    return m


def score(model: Model, texts: list[bytes | None]) -> np.ndarray:
    """Probability of label 1 for every whole text. Passages are encoded in blocks, so that a very long text needs
    little more memory than its bytes."""
    cut, of, own = windows([t or b"" for t in texts], PASSAGE, 1)
    blocks = [slice(i, i + BLOCK) for i in range(0, len(cut), BLOCK)]
    hidden = np.concatenate([_encode(model, features(cut[b], own[b])) for b in blocks])
    return _attend(model, hidden, of, len(texts))[-1]


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn from whole labelled documents outside the held-out fold, in the order of their id hashes: at most
    TRAIN_DOCS of them, and of these the ones that fit into TRAIN_BYTES.

    A label other than 0 and 1 or without id is none; of several labels of an id the larger one counts. A null text is
    the empty text. Of rows that share an id each may be learnt from. Without any labelled document the model is the
    untrained one. Other columns are ignored.
    """
    marked = labels.where(~held_out() & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    few = marked.withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(TRAIN_DOCS)  # the broadcast's bound
    rows = docs.select("doc_id", F.col("text").cast("string")).join(F.broadcast(few), "doc_id").select(
        "h", F.xxhash64("text").alias("t"), F.col("quality").cast("int"), whole("text").alias("text")
    )
    got = sampled(rows, TRAIN_DOCS, TRAIN_BYTES)
    cut = lambda t: [t[i : i + PASSAGE] for i in range(0, max(1, len(t)), PASSAGE)]
    return train([cut(r.text.encode()) for r in got], [r.quality for r in got])


@lru_cache(maxsize=2)
def _model(data: bytes) -> Model:
    return pickle.loads(data)


def _score_batches(data: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = utf8(batch.column(1))
            parts = [score(_model(data), texts[i : i + 64]) for i in range(0, len(texts), 64)]
            found = np.concatenate(parts) if parts else np.empty(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], ["doc_id", "score"])

    return run


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, text) -> (doc_id, score), one row per input row. A null text is scored as the empty text, which is a
    single passage without features; other columns are ignored."""
    chosen = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return chosen.mapInArrow(_score_batches(pickle.dumps(model)), "doc_id long, score double")


def op5_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = score_documents(docs, fit(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
