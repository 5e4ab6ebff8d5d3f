"""Quality classifier: a byte-level convolutional network in numpy.

Bytes are embedded and convolved by learned filters (width 8, stride 2) over the whole
text. Activations are max-pooled over chunks of 512 bytes that overlap by half; maximum,
mean and minimum over a text's chunks enter one logistic unit. Trained by Adam on a bounded
sample of labelled rows.

Defined cases: null or empty text is one chunk of padding and gets a score. Rows without an
id, a text or a label are never learned from. Nothing to learn from: every score is 0.5.
Repeated rows are each scored. Texts are whole, however long.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ordina.llm._folds import held_out, sample
from ordina.llm._store import flat, pick
from ordina.llm._text import Bytes, parts, runs

WIDTH, STRIDE, BLOCK = 8, 2, 256
#: Bytes scored at once.
PART = 1 << 17


@dataclass(frozen=True)
class Training:
    """The sample is at most per_class rows of each label, whatever their length. For learning only, a text of more than most_chars
    characters gives one span of so many, from a place chosen by a hash of its id.

    short: how many sentences out of good texts are added, per good text; short good texts are rare in a sample.
    """

    per_class: int = 1500
    most_chars: int = 20_000
    dimensions: int = 8
    filters: int = 32
    epochs: int = 14
    batch: int = 24
    rate: float = 4e-3
    seed: int = 11
    short: float = 0.4


@dataclass
class Net:
    embed: np.ndarray  # 256 x dimensions
    conv: np.ndarray  # width * dimensions x filters
    bias: np.ndarray
    out: np.ndarray  # 3 * filters
    base: np.ndarray  # one number

    def all(self) -> list[np.ndarray]:
        return [self.embed, self.conv, self.bias, self.out, self.base]


def layout(text: Bytes) -> tuple[np.ndarray, np.ndarray]:
    """One row of BLOCK + WIDTH bytes per block: the block's own and the first ones of the text's next block (zeros after its end); and the numbers of blocks."""
    size = np.diff(text.off)
    blocks = -(-(size + WIDTH) // BLOCK)
    begin = (np.cumsum(blocks) - blocks) * BLOCK
    buf = np.zeros(int(blocks.sum()) * BLOCK, np.uint8)
    buf[runs(begin, size)] = text.buf
    rows = np.zeros((int(blocks.sum()), BLOCK + WIDTH), np.uint8)
    rows[:, :BLOCK] = buf.reshape(-1, BLOCK)
    inner = np.ones(len(rows), bool)
    inner[np.cumsum(blocks) - 1] = False
    on = np.flatnonzero(inner)
    rows[on, BLOCK:] = rows[on + 1, :WIDTH]
    return rows, blocks


def windows(rows: np.ndarray, net: Net) -> np.ndarray:
    """Embedded bytes of every window of the blocks, one row each."""
    e = net.embed[rows]
    n, width, d = e.shape
    per = BLOCK // STRIDE
    view = np.lib.stride_tricks.as_strided(e, (n, per, WIDTH * d), (width * d * e.itemsize, STRIDE * d * e.itemsize, e.itemsize))
    return view.reshape(n * per, WIDTH * d)


def pooled(block_max: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chunk features (two neighbouring blocks; the last block alone if it is the only one), the first chunk and the number of chunks of each text."""
    n = np.maximum(blocks - 1, 1)
    first = np.cumsum(blocks) - blocks
    left = runs(first, n)
    right = left + np.repeat(blocks > 1, n)
    return np.maximum(block_max[left], block_max[right]), np.cumsum(n) - n, n


def features(block_max: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    chunk, first, n = pooled(block_max, blocks)
    return np.concatenate([np.maximum.reduceat(chunk, first), np.add.reduceat(chunk, first) / n[:, None].astype(np.float32), np.minimum.reduceat(chunk, first)], axis=1)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def score(text: Bytes, net: Net) -> np.ndarray:
    rows, blocks = layout(text)
    maxima = np.empty((len(rows), net.conv.shape[1]), np.float32)
    step = max(1, PART // BLOCK)
    for k in range(0, len(rows), step):  # a long text is as cheap in memory as many short ones
        part = rows[k : k + step]
        maxima[k : k + step] = (windows(part, net) @ net.conv).reshape(len(part), BLOCK // STRIDE, -1).max(axis=1)
    return _sigmoid(features(np.maximum(maxima + net.bias, 0), blocks) @ net.out + net.base[0])


def fit(texts: list[bytes], labels: np.ndarray, how: Training = Training()) -> Net:
    """Adam on the logistic loss; gradients reach the filters through the pooled maxima alone."""
    rng = np.random.default_rng(how.seed)
    pieces = [s for t, y in zip(texts, labels, strict=True) if y for s in t.split(b".")[1:-1] if len(s) > 15]
    some = rng.permutation(len(pieces))[: int(how.short * labels.sum())]
    texts, labels = [*texts, *(pieces[i].strip() + b"." for i in some)], np.append(labels, np.ones(len(some), np.float32))
    d, f = how.dimensions, how.filters
    net = Net((rng.standard_normal((256, d)) * 0.5).astype(np.float32), (rng.standard_normal((WIDTH * d, f)) / np.sqrt(WIDTH * d) * 1.5).astype(np.float32), np.zeros(f, np.float32), (rng.standard_normal(3 * f) * 0.05).astype(np.float32), np.zeros(1, np.float32))
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in net.all()]
    step, per = 0, BLOCK // STRIDE
    for epoch in range(how.epochs):
        rate = how.rate * (1 - epoch / how.epochs) + how.rate / 50
        order = rng.permutation(len(texts))
        for k in range(0, len(order), how.batch):
            rows = order[k : k + how.batch]
            size = np.array([len(texts[i]) for i in rows])
            off = np.concatenate([[0], np.cumsum(size)])
            buf, blocks = layout(Bytes(np.frombuffer(b"".join(texts[i] for i in rows), np.uint8), off, 0))
            n = len(buf)
            a = (windows(buf, net) @ net.conv).reshape(n, per, f)
            at = a.argmax(axis=1)
            peak = np.take_along_axis(a, at[:, None], axis=1)[:, 0] + net.bias
            block = np.maximum(peak, 0)
            chunk, first, count = pooled(block, blocks)
            x = features(block, blocks)
            g = (_sigmoid(x @ net.out + net.base[0]) - labels[rows]) / len(rows)
            grad_out, grad_base = x.T @ g + 1e-4 * net.out, np.array([g.sum()])
            back = (g[:, None] * net.out).reshape(-1, 3, f)
            owner = np.repeat(np.arange(len(rows)), count)
            grad_chunk = back[owner, 1] / count[owner, None]
            for part, op in ((0, np.maximum), (2, np.minimum)):
                hit = chunk == op.reduceat(chunk, first)[owner]
                hits = np.add.reduceat(hit, first, dtype=np.float32)
                grad_chunk += hit * (back[:, part] / hits)[owner]
            start = np.cumsum(blocks) - blocks
            left = runs(start, count)
            right = left + np.repeat(blocks > 1, count)
            to_left = block[left] >= block[right]
            grad_block = np.zeros_like(block)
            np.add.at(grad_block, left, grad_chunk * to_left)
            np.add.at(grad_block, right, grad_chunk * ~to_left)
            grad_block *= peak > 0
            grad_conv, grad_embed = np.zeros_like(net.conv), np.zeros_like(net.embed)
            seen = buf[np.arange(n)[:, None, None], (at * STRIDE)[:, :, None] + np.arange(WIDTH)]  # n x filters x width
            for w in range(WIDTH):
                b = seen[:, :, w]
                grad_conv[w * d : (w + 1) * d] = np.einsum("nf,nfd->df", grad_block, net.embed[b])
                hot = np.zeros((256, f), np.float32)
                np.add.at(hot, (b, np.broadcast_to(np.arange(f), b.shape)), grad_block)
                grad_embed += hot @ net.conv[w * d : (w + 1) * d].T
            step += 1
            for p, (m, v), grad in zip(net.all(), moments, (grad_embed, grad_conv, grad_block.sum(axis=0), grad_out, grad_base), strict=True):
                m += 0.1 * (grad - m)
                v += 0.001 * (grad * grad - v)
                p -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def train(docs: DataFrame, labels: DataFrame, how: Training = Training(), id: str = "doc_id", text: str = "text", label: str = "quality") -> Net | None:
    """Learns from labelled rows outside the held-out fold; None if there are none, or all have one label."""
    marks = pick(labels, id=id, label=label).where(F.col("id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("id"))).groupBy("id").agg(F.max("label").alias("label"))
    counts = {r["label"]: r["n"] for r in marks.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return None
    rows = sample(marks, "id", "label", how.per_class, 2 * how.per_class)
    texts = pick(docs, doc_id=id, text=text).where(F.col("text").isNotNull())
    spare = F.char_length("text") - how.most_chars
    start = F.pmod(F.xxhash64(F.lit(29), F.col("doc_id")), F.greatest(spare, F.lit(0)).cast("long") + 1).cast("int") + 1
    texts = texts.withColumn("text", F.when(spare > 0, F.substr("text", start, F.lit(how.most_chars))).otherwise(F.col("text")))
    found = texts.join(F.broadcast(rows), F.col("doc_id") == F.col("id")).select("doc_id", "text", "label").dropDuplicates(["doc_id"]).toArrow().sort_by("doc_id")
    y = found.column("label").to_numpy()
    if len(set(y.tolist())) < 2:
        return None
    net = fit([t.encode() for t in found.column("text").to_pylist()], y.astype(np.float32), how)
    # the sample holds the labels in other shares than the rows: shift to theirs
    net.base += np.float32(np.log(counts[1] / counts[0]) - np.log(y.mean() / (1 - y.mean())))
    return net


def _scores(texts: pa.Array, net: Net | None) -> pa.Array:
    out = np.full(len(texts), 0.5)
    for text in parts(texts) if net else ():
        out[text.first : text.first + len(text)] = score(text, net)
    return pa.array(out)


def _scorer(docs: DataFrame, net: Net | None):
    shared = docs.sparkSession.sparkContext.broadcast(net)
    return F.arrow_udf(lambda texts: _scores(texts, shared.value), T.DoubleType()).asNondeterministic()


def classify(docs: DataFrame, net: Net | None, least: float = 0.3, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted (1 if the score is least or more)."""
    rows = pick(docs, doc_id=id, text=text).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), _scorer(docs, net)("text").alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= least).cast("int"))


def keep(docs: DataFrame, net: Net | None, least: float = 0.3, text: str = "text") -> DataFrame:
    """The documents that score least or more, with all their columns."""
    rows = flat(docs).withColumn("_s", _scorer(docs, net)(F.col(f"_{docs.columns.index(text)}")))
    return rows.where(F.col("_s") >= least).drop("_s").toDF(*docs.columns)
