"""Language identification from averaged subword embeddings.

A text is the average of the embeddings of its hashed subwords (byte trigrams and words,
ASCII letters in lower case), classed by a linear softmax. Both are learned by stochastic
gradient descent in numpy on a bounded sample; as the layers are linear, prediction sums
one row of logits per subword. A temperature fitted on a part of the sample calibrates the
scores, and a threshold on them rejects doubtful texts.

Defined cases: null text, or text without a letter: `und`, score 0, rejected. Null labels
and null ids are never learned from. Nothing to learn from: all `und`. Repeated rows are
each predicted. Texts are whole, however long. Of languages that score alike, the first in
alphabetical order is told. An empty table gives an empty result. Columns other than id, text and
lang are not read, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ordina.llm._folds import held_out, sample
from ordina.llm._store import pick
from ordina.llm._text import Bytes, parts

TRIGRAMS, WORDS = 4096, 4096
BUCKETS = TRIGRAMS + WORDS
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123)]] = True
UNKNOWN = "und"


@dataclass(frozen=True)
class Training:
    """The sample is about per_language documents of every language, fewer where that would be more than documents in all."""

    per_language: int = 600
    documents: int = 12_000
    dimensions: int = 16
    epochs: int = 12
    rate: float = 4.0
    batch: int = 32
    precision: float = 0.99
    seed: int = 5


@dataclass(frozen=True)
class Model:
    labels: tuple[str, ...]
    logits: np.ndarray  # BUCKETS x labels
    bias: np.ndarray
    temperature: float
    least_score: float


def subwords(text: Bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of trigrams and of words, and how many of each every text has."""
    low = Bytes(LOWER[text.buf], text.off, text.first)
    start, end = low.words()
    words = (low.hashes(start, end) >> np.uint64(52)).astype(np.int32) + TRIGRAMS
    size = np.diff(text.off)
    if len(low.buf) < 3:
        return np.zeros(0, np.int32), np.zeros(len(text), np.int64), words, text.count(start)
    b = low.buf.astype(np.uint32)
    code = (b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA77) + b[2:] * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F)
    own = np.ones(len(code), bool)
    ends = text.off[1:]
    for k in (1, 2):  # trigrams that begin in the last two bytes of a text would leave it
        at = ends - k
        own[at[(at >= text.off[:-1]) & (at < len(code))]] = False
    return (code[own] >> np.uint32(20)).astype(np.int32), np.maximum(size - 2, 0), words, text.count(start)


def _row_sums(values: np.ndarray, n: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    ends = np.cumsum(n)
    return total[ends] - total[ends - n]


def _has_letter(text: Bytes) -> np.ndarray:
    has = text.count(np.flatnonzero(LETTER[text.buf])) > 0
    for i in np.flatnonzero(~has & (np.diff(text.off) > 0)).tolist():
        has[i] = any(c.isalpha() for c in text.buf[text.off[i] : text.off[i + 1]].tobytes().decode("utf-8", "replace"))
    return has


def _counts(texts: pa.Array) -> pa.Array:
    """Per text its buckets with their shares, for learning."""
    where, share, n = [], [], []
    for text in parts(texts):
        tri, n_tri, words, n_words = subwords(text)
        a, b = np.concatenate([[0], np.cumsum(n_tri)]), np.concatenate([[0], np.cumsum(n_words)])
        for i in range(len(text)):
            x = np.bincount(np.concatenate([tri[a[i] : a[i + 1]], words[b[i] : b[i + 1]]]), minlength=BUCKETS)
            at = np.flatnonzero(x)
            where.append(at.astype(np.int32))
            share.append((x[at] / max(1, x.sum())).astype(np.float32))
            n.append(len(at))
    off = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
    values = [pa.array(np.concatenate([*v, np.zeros(0, k)]).astype(k)) for v, k in ((where, np.int32), (share, np.float32))]
    return pa.StructArray.from_arrays([pa.ListArray.from_arrays(off, v) for v in values], names=["at", "share"])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(x: np.ndarray, y: np.ndarray, labels: tuple[str, ...], how: Training = Training()) -> Model:
    """x: shares of buckets; y: numbers of labels. A fifth of the rows calibrates."""
    rng = np.random.default_rng(how.seed)
    order = rng.permutation(len(y))
    cut = max(1, len(y) // 5) if len(y) > 20 else 0
    held, used = order[:cut], order[cut:]
    embed = (rng.standard_normal((BUCKETS, how.dimensions)) * 0.1).astype(np.float32)
    weight = (rng.standard_normal((how.dimensions, len(labels))) * 0.1).astype(np.float32)
    bias = np.zeros(len(labels), np.float32)
    for epoch in range(how.epochs):
        rate = how.rate * (1 - epoch / how.epochs)
        for k in range(0, len(used), how.batch):
            rows = rng.choice(used, min(how.batch, len(used)), replace=False)
            h = x[rows] @ embed
            g = softmax(h @ weight + bias)
            g[np.arange(len(rows)), y[rows]] -= 1
            g /= len(rows)
            back = g @ weight.T
            weight -= rate * (h.T @ g)
            bias -= 0.1 * rate * g.sum(axis=0)
            at = np.flatnonzero(x[rows].any(axis=0))
            embed[at] -= 10 * rate * (x[rows][:, at].T @ back)
    logits = embed @ weight
    temperature, least = 1.0, 0.0
    if len(held):
        z, t = x[held] @ logits + bias, y[held]
        losses = {s: -np.log(softmax(z / s)[np.arange(len(t)), t] + 1e-12).mean() for s in (0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 5.0)}
        temperature = min(losses, key=losses.get)
        p = softmax(z / temperature)
        score, right = p.max(axis=1), p.argmax(axis=1) == t
        down = np.argsort(-score)
        good = np.cumsum(right[down]) / np.arange(1, len(t) + 1) >= how.precision
        least = float(score[down][np.flatnonzero(good).max()]) if good.any() else 1.0
    return Model(labels, logits.astype(np.float32), bias, temperature, least)


def train(docs: DataFrame, how: Training = Training(), id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model | None:
    """Learns from the rows outside the held-out fold; None if no row has a text and a label."""
    rows = pick(docs, id=id, text=text, lang=lang).where(F.col("id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("id")))
    kind = T.StructType([T.StructField("at", T.ArrayType(T.IntegerType(), False), False), T.StructField("share", T.ArrayType(T.FloatType(), False), False)])
    chosen = sample(rows, "id", "lang", how.per_language, how.documents)
    found = chosen.select("lang", F.arrow_udf(_counts, kind)("text").alias("x")).select("lang", "x.at", "x.share").toArrow()
    if not found.num_rows:
        return None
    langs = found.column("lang").to_pylist()
    labels = tuple(sorted(set(langs)))
    x = np.zeros((len(langs), BUCKETS), np.float32)
    for i, (at, share) in enumerate(zip(found.column("at"), found.column("share"), strict=True)):
        x[i, at.values.to_numpy()] = share.values.to_numpy()
    return fit(x, np.array([labels.index(v) for v in langs]), labels, how)


def _predict(texts: pa.Array, model: Model | None) -> pa.Array:
    lang, score = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
    for text in parts(texts) if model else ():
        tri, n_tri, words, n_words = subwords(text)
        z = np.empty((len(text), len(model.labels)))
        for c in range(len(model.labels)):
            column = np.ascontiguousarray(model.logits[:, c])
            z[:, c] = _row_sums(column[tri], n_tri) + _row_sums(column[words], n_words)
        p = softmax((z / np.maximum(1, n_tri + n_words)[:, None] + model.bias) / model.temperature)
        has = np.flatnonzero(_has_letter(text))
        lang[text.first + has] = np.array(model.labels, object)[p[has].argmax(axis=1)]
        score[text.first + has] = p[has].max(axis=1)
    rejected = (lang == UNKNOWN) | (score < (model.least_score if model else 1))
    return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)], names=["lang_pred", "score", "rejected"])


def predict(docs: DataFrame, model: Model | None, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected (score below the calibrated threshold)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = T.StructType([T.StructField("lang_pred", T.StringType(), False), T.StructField("score", T.DoubleType(), False), T.StructField("rejected", T.BooleanType(), False)])
    say = F.arrow_udf(lambda texts: _predict(texts, shared.value), kind)
    rows = pick(docs, doc_id=id, text=text).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), say("text").alias("p"))
    return rows.select("doc_id", "held_out", "p.*")


def identify(docs: DataFrame, how: Training = Training(), id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Trains on docs and predicts every row of it."""
    return predict(docs, train(docs, how, id, text, lang), id, text)
