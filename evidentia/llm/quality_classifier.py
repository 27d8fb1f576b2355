"""Supervised subword embeddings: mean of hashed word and character n-gram vectors, softmax.

Vectors and output weights are trained by stochastic gradient descent in numpy on a
bounded, hash-ordered sample of labelled documents. As the document vector is a mean
and the output linear, each feature's share of the logit is a single number; scoring
adds these up as fixed-point integers, which gives the same score on any partitioning.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from .store import bounded, fresh
from .training_sample import bounded_texts, held_out

#: Bounds on labelled documents that training sees, and on the bytes of their texts for each label.
SAMPLE = 2500
SAMPLE_BYTES = 24 << 20
BITS = 17
DIM = 12
EPOCHS = 3
RATE = 0.2
CUT = 0.3
NGRAMS = (3, 5)
_SCALE = 1 << 20
_BYTES = A.byte_values()


def features(buf: np.ndarray, off: np.ndarray, bits: int = BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets of words, word bigrams and byte n-grams inside words; with the byte where each starts.

    A bigram of one word twice has a bucket of its own: its pattern counts, not the word.
    """
    shift = np.uint64(64 - bits)
    s, e, first = A.find_words(buf, off)
    words = A.span_hash(buf, s, e)
    yield (words >> shift).astype(np.int64), s
    if not len(buf):
        return
    at = np.flatnonzero(A.window_mask(first, 2))
    if len(at):
        pairs = A.window_hash(words, 2)[at]
        yield np.where(words[at] == words[at + 1], 0, (pairs >> shift).astype(np.int64)), s[at]
    space = A.SPACE[buf]
    value = _BYTES[np.where(space, np.uint8(32), buf)]
    blanks = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(space, out=blanks[1:])
    for n in NGRAMS:
        g = A.window_hash(value, n, seed=n)
        if not len(g):
            continue
        ok = A.window_mask(off, n)
        k = len(g)
        ok &= blanks[n - 1 : n - 1 + k] == blanks[1 : 1 + k]  # white space at the ends only
        at = np.flatnonzero(ok)
        yield (g[at] >> shift).astype(np.int64), at


class Model:
    """Trained parameters; ``weights`` and ``bias`` give the logit of label 1 over label 0."""

    def __init__(self, weights: np.ndarray, bias: float, bits: int):
        self.weights, self.bias, self.bits = weights, bias, bits

    def scores(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        total, count = np.zeros(len(off) - 1, np.int64), np.zeros(len(off) - 1, np.int64)
        for bucket, at in features(buf, off, self.bits):
            edges = np.searchsorted(at, off)
            sums = np.zeros(len(bucket) + 1, np.int64)
            np.cumsum(self.weights[bucket], out=sums[1:])
            total += sums[edges[1:]] - sums[edges[:-1]]
            count += np.diff(edges)
        logit = total / np.maximum(count, 1) / _SCALE + self.bias
        return 1 / (1 + np.exp(-np.clip(logit, -500, 500)))


def train(texts: list[bytes], labels: np.ndarray, bits: int = BITS, dim: int = DIM, epochs: int = EPOCHS, rate: float = RATE, seed: int = 7) -> Model:
    """Plain SGD, one document a step, linearly falling rate. One class or no rows: a constant score."""
    rng = np.random.default_rng(seed)
    inputs = rng.uniform(-1 / dim, 1 / dim, (1 << bits, dim)).astype(np.float32)
    out, bias = np.zeros((2, dim), np.float32), np.zeros(2, np.float32)
    share = float(np.clip(labels.mean(), 0.01, 0.99)) if len(labels) else 0.5
    if not len(labels) or len(set(labels.tolist())) < 2:
        return Model(np.zeros(1 << bits, np.int64), float(np.log(share / (1 - share))), bits)
    rows = []
    for t in texts:
        got = [b for b, _ in features(np.frombuffer(t, np.uint8), np.array([0, len(t)]), bits)]
        ids, n = np.unique(np.concatenate(got), return_counts=True)
        rows.append((ids.astype(np.int32), (n / max(1, n.sum())).astype(np.float32)))
    steps, done = epochs * len(rows), 0
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            ids, w = rows[k]
            if not len(ids):
                continue
            lr = rate * (1 - done / steps)
            done += 1
            hidden = w @ inputs[ids]
            logits = out @ hidden + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[int(labels[k])] -= 1
            back = p @ out
            out -= lr * np.outer(p, hidden)
            bias -= lr * 0.1 * p
            # scaled so that the document vector moves by lr * back, however many features it has
            inputs[ids] -= (lr / float(w @ w) * w)[:, None] * back
    return Model(np.rint(inputs @ (out[1] - out[0]) * _SCALE).astype(np.int64), float(bias[1] - bias[0]), bits)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, size: int = SAMPLE_BYTES) -> Model:
    """Learns ``labels.quality`` from at most ``sample`` labelled documents that are not held out.

    Of each label, whole texts of at most ``size`` bytes in all are taken. Null doc_id,
    quality or text does not count as labelled; a doc_id labelled more than once takes
    its largest label, one with more than one text its least.
    """
    taken, label = fresh(docs, "labelled"), fresh(docs, "label")
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1))
        .where(~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("quality").alias(label))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        .select(F.col("doc_id").alias(taken), label)
    )
    rows = docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(chosen), F.col("doc_id") == F.col(taken))
    got = bounded_texts(rows.select(F.col(label).alias("label"), "doc_id", "text"), size)
    return train([t.encode() for _, _, t in got], np.array([q for q, _, _ in got], np.int64))


def _score(model: Model, keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, buf, off in A.blocks(batches, "text"):
            p = model.scores(buf, off)
            if keep:
                yield piece.filter(pa.array(p >= CUT))
            else:
                yield pa.record_batch([piece.column(0), pa.array(p), pa.array((p >= CUT).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of every row.

    Null text scores as empty: the bias alone. A text of any length is scored whole;
    repeated rows each get their row; extra columns are ignored.
    """
    rows = bounded(docs).select("doc_id", "text").mapInArrow(_score(model, False), "doc_id long, score double, predicted int")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """The rows, all columns, that the model does not reject."""
    return bounded(docs).mapInArrow(_score(model, True), docs.schema)
