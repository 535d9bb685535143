"""Language identification by a convolutional network over bytes, trained in numpy.

Filters of several widths slide over the byte embeddings of a fixed-length window; each filter's largest answer is
kept and a softmax layer reads them. A whole text is cut into windows, and its windows' logits are averaged by their
bytes. When applied, embedding and filters are multiplied out into tables by byte pair, so that a filter of up to
four bytes costs two look-ups.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
import pickle

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytewindows import windows
from .common import held_out, loaded, returning, sampled, table, utf8

WIDTHS = (2, 3, 4)
FILTERS = 12
EMBED = 8
WINDOW = 256
OVERLAP = 3
#: Bounds of the training sample: documents, and bytes of their whole texts.
TRAIN_DOCS, TRAIN_BYTES = 2000, 4 << 20
#: Training sees so many windows, every one of the sample's equally often.
TRAIN_STEPS, BATCH = 900, 64
UNKNOWN = "und"

_LETTER = regex.compile(r"\p{L}")


@dataclass
class Model:
    languages: list[str]
    embed: np.ndarray  # (256, EMBED)
    conv: np.ndarray  # (4, EMBED, filters): offset by offset; zero beyond a filter's width
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray


def _mask() -> np.ndarray:
    width = np.repeat(WIDTHS, FILTERS)
    return (np.arange(4)[:, None] < width)[:, None, :].astype(np.float32)


def train(texts: list[bytes], langs: list[str], seed: int = 7) -> Model:
    """Fit on all windows of the texts; half of them cropped, so that short texts are seen as well. A window weighs as
    the share of its text, so that a long text counts as much as a short one."""
    rng = np.random.default_rng(seed)
    languages = sorted(set(langs))
    n_filters, mask = len(WIDTHS) * FILTERS, _mask()
    size = max(1, len(languages))
    params = [
        rng.normal(0, 0.5, (256, EMBED)), rng.normal(0, 0.25, (4, EMBED, n_filters)), np.zeros(n_filters),
        rng.normal(0, 0.2, (n_filters, size)), np.zeros(size),
    ]
    params = [p.astype(np.float32) for p in params]
    params[1] *= mask
    if not texts:
        return Model(languages, *params)
    cut, of, length = windows(texts, WINDOW, OVERLAP)
    target = np.array([languages.index(x) for x in langs])[of]
    share = 1 / np.sqrt(np.bincount(of)[of])  # between a text's one vote and a window's
    share /= share.mean()
    first = [np.zeros_like(p) for p in params]
    second = [np.zeros_like(p) for p in params]
    steps, rate, epochs = 0, 0.01, max(1, round(TRAIN_STEPS * BATCH / len(cut)))
    for _ in range(epochs):
        order = rng.permutation(len(cut))
        for at in range(0, len(order), BATCH):
            pick = order[at : at + BATCH]
            x = cut[pick].copy()
            keep = np.where(rng.random(len(pick)) < 0.5, rng.integers(12, WINDOW, len(pick)), WINDOW)
            x[np.arange(WINDOW) >= np.minimum(keep, length[pick])[:, None]] = 0
            embed, conv, bias, out, out_bias = params
            e = embed[x]
            span = WINDOW - 3
            patches = np.concatenate([e[:, j : j + span] for j in range(4)], axis=2)
            answers = patches @ conv.reshape(-1, n_filters)
            where = answers.argmax(axis=1)
            top = np.take_along_axis(answers, where[:, None], 1)[:, 0] + bias
            hidden = np.maximum(top, 0)
            logits = hidden @ out + out_bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(pick)), target[pick]] -= 1
            p *= share[pick][:, None].astype(np.float32) / len(pick)
            d_hidden = (p @ out.T) * (top > 0)
            rows = np.arange(len(pick))[:, None]
            chosen = patches[rows, where]  # (batch, filters, 4 * EMBED)
            d_conv = np.einsum("bf,bfe->ef", d_hidden, chosen).reshape(conv.shape) * mask
            d_patch = d_hidden[..., None] * conv.reshape(-1, n_filters).T
            d_embed = np.zeros_like(embed)
            for j in range(4):
                np.add.at(d_embed, x[rows, where + j], d_patch[..., j * EMBED : (j + 1) * EMBED])
            steps += 1
            for i, g in enumerate((d_embed, d_conv, d_hidden.sum(0), hidden.T @ p, p.sum(0))):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                move = (first[i] / (1 - 0.9**steps)) / (np.sqrt(second[i] / (1 - 0.999**steps)) + 1e-8)
                params[i] = (params[i] - rate * move).astype(np.float32)
        rate *= 0.15 ** (1 / epochs)
    return Model(languages, *params)


class Scorer:
    """A model with its tables by byte pair."""

    def __init__(self, model: Model):
        self.model = model
        by_byte = np.einsum("ve,jef->jvf", model.embed, model.conv)
        f = by_byte.shape[2]
        self.front = (by_byte[0][:, None] + by_byte[1][None]).reshape(-1, f)
        back = by_byte[2][:, None] + by_byte[3][None]
        self.back = np.ascontiguousarray(back.reshape(-1, f)[:, FILTERS:])

    def logits(self, cut: np.ndarray) -> np.ndarray:
        span, model = cut.shape[1] - 3, self.model
        top = np.empty((len(cut), self.front.shape[1]), dtype=np.float32)
        for at in range(0, len(cut), 64):  # stays within the processor's cache
            some = cut[at : at + 64]
            pair = some[:, :-1].astype(np.int32) << 8 | some[:, 1:]
            answers = self.front[pair[:, :span]]
            answers[:, :, FILTERS:] += self.back[pair[:, 2:]]
            top[at : at + 64] = answers.max(axis=1)
        return np.maximum(top + model.bias, 0) @ model.out + model.out_bias

    def predict(self, texts: list[bytes | None]) -> tuple[list[str], list[float]]:
        """Language and its probability for every whole text."""
        known = [i for i, t in enumerate(texts) if t and _LETTER.search(t.decode("utf-8", "replace"))]
        langs, scores = [UNKNOWN] * len(texts), [1.0] * len(texts)
        languages = self.model.languages
        if not known or not languages:
            return langs, scores
        cut, of, own = windows([texts[i] for i in known], WINDOW, OVERLAP)
        logits = self.logits(cut).astype(np.float64)
        weight = np.maximum(own, 1).astype(np.float64)
        total = np.stack([np.bincount(of, logits[:, j] * weight, len(known)) for j in range(len(languages))], axis=1)
        mean = total / np.bincount(of, weight, len(known))[:, None]
        p = np.exp(mean - mean.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        for i, best, row in zip(known, p.argmax(1).tolist(), p):
            langs[i], scores[i] = languages[best], float(row[best])
        return langs, scores


def fit(docs: DataFrame) -> Model:
    """Learn from whole documents outside the held-out fold, in the order of their id hashes: at most TRAIN_DOCS of
    them, and of these the ones that fit into TRAIN_BYTES.

    A document without language, id, text or letters teaches nothing; an empty ``lang`` is a value like any other. Of
    rows that share an id each may be learnt from. Where nothing can be learnt there is no language to predict. Other
    columns are ignored.
    """
    usable = docs.where(~held_out() & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    rows = usable.select(F.xxhash64("doc_id").alias("h"), F.xxhash64("text").alias("t"), F.col("text").cast("string"), "lang")
    got = sampled(rows, TRAIN_DOCS, TRAIN_BYTES)
    return train([r.text.encode() for r in got], [r.lang for r in got])


def _scorer(model: bytes) -> Scorer:
    return Scorer(pickle.loads(model))


def _predict_batches(model: bytes, text_at: int, kept: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = loaded(_scorer, model)
        for batch in batches:
            texts, langs, scores = utf8(batch.column(text_at)), [], []
            for at in range(0, len(texts), 128):
                lang, score = scorer.predict(texts[at : at + 128])
                langs += lang
                scores += score
            columns = [*batch.columns[:kept], pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:kept], "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(text and the columns ``keep``) -> keep, lang_pred, score, one row per input row. Null texts and texts without a
    letter are ``und`` with score 1, as is every text if no language was learnt. Whole texts are read."""
    given = keep if "text" in keep else (*keep, "text")
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), "lang_pred string, score double"])
    run = _predict_batches(pickle.dumps(model), given.index("text"), len(keep))
    return docs.select(*[F.col(f"`{c}`") for c in given]).mapInArrow(returning(run), schema)


def keep_known(docs: DataFrame) -> DataFrame:
    """The documents that the network gives a language. Rejected are those that have none, without text or letters; a
    low score rejects nothing, since clean short texts have one too. Where no language could be learnt, the same go.
    Null ids, repeated rows and an empty table stay as they are. All columns stay, whatever their names."""
    model = fit(docs)
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    names = docs.columns
    neutral = [c if c == "text" else f"c{i}" for i, c in enumerate(names)]
    found = predict(docs.toDF(*neutral), model, tuple(neutral)).where(F.col("lang_pred") != UNKNOWN)
    return found.select(*[F.col(n).alias(c) for n, c in zip(neutral, names)])


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    found = predict(docs, fit(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
