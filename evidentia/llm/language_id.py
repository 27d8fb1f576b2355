"""Language identification with a bidirectional gated recurrent network over bytes.

The network reads segments of ``SEGMENT`` bytes in both directions and gives language
probabilities at every byte; a document's probabilities are the mean over all its
bytes. It is trained in numpy by backpropagation through time on a bounded,
hash-ordered sample of labelled documents. Arrays are feature-major, (features, rows),
so each gate is one contiguous block and thousands of segments advance together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import arrays as A
from .store import bounded
from .training_sample import bounded_texts, held_out

#: Bounds on training documents of one language, and on the bytes of their texts.
SAMPLE = 200
SAMPLE_BYTES = 16 << 20
HIDDEN = 8
EMBED = 8
SEGMENT = 64
TRAIN_SEGMENT = 32
BATCH = 384
STEPS = 260
RATE = 0.02
UNKNOWN = "und"
_ROWS = 2048


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(np.minimum(x, 80, out=x), out=x)
    x += 1
    return np.reciprocal(x, out=x)


class Network:
    """Parameters by name: ``embed``; for each direction ``w``, ``u``, ``b``, ``c``; ``out``, ``bias``."""

    def __init__(self, languages: list[str], seed: int = 11):
        rng = np.random.default_rng(seed)
        small = lambda *s: (rng.standard_normal(s) / np.sqrt(s[-1])).astype(np.float32)
        self.languages = languages
        self.p = {"embed": small(EMBED, 256) * np.float32(8), "out": small(len(languages), 2 * HIDDEN), "bias": np.zeros((len(languages), 1), np.float32)}
        for d in "fb":
            self.p |= {f"w{d}": small(3 * HIDDEN, EMBED), f"u{d}": small(3 * HIDDEN, HIDDEN), f"b{d}": np.zeros((3 * HIDDEN, 1), np.float32), f"c{d}": np.zeros((HIDDEN, 1), np.float32)}

    def direction(self, d: str, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        """States (steps, hidden, rows) of one direction; with ``keep`` also what the gradient needs.

        At masked steps the state is 0, so a reversed, padded segment starts clean.
        """
        p, k = self.p, HIDDEN
        steps, _, rows = x.shape
        u, c = p[f"u{d}"], p[f"c{d}"]
        states = np.empty((steps, k, rows), np.float32)
        h, saved = np.zeros((k, rows), np.float32), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            gx = p[f"w{d}"] @ x[t]
            gx += p[f"b{d}"]
            gh = u @ h
            gates = _sigmoid(gx[: 2 * k] + gh[: 2 * k])
            r, z = gates[:k], gates[k:]
            inner = gh[2 * k :] + c
            n = np.tanh(gx[2 * k :] + r * inner)
            new = (h - n) * z
            new += n
            new *= mask[t]
            if keep:
                saved.append((t, h, r, z, n, inner))
            h = states[t] = new
        return states, saved

    def back(self, d: str, x: np.ndarray, mask: np.ndarray, saved: list, grad: np.ndarray, out: dict) -> np.ndarray:
        """Backpropagation through time of one direction; gives the gradient of the inputs."""
        k = HIDDEN
        u, w = self.p[f"u{d}"], self.p[f"w{d}"]
        dx, dh = np.zeros_like(x), np.zeros((k, x.shape[2]), np.float32)
        for t, h, r, z, n, inner in reversed(saved):
            dh = (dh + grad[t]) * mask[t]
            dn = dh * (1 - z) * (1 - n * n)
            dz = dh * (h - n) * z * (1 - z)
            dr = dn * inner * r * (1 - r)
            gx = np.concatenate((dr, dz, dn))
            gh = np.concatenate((dr, dz, dn * r))
            out[f"u{d}"] += gh @ h.T
            out[f"w{d}"] += gx @ x[t].T
            out[f"b{d}"] += gx.sum(1, keepdims=True)
            out[f"c{d}"] += (dn * r).sum(1, keepdims=True)
            dx[t] = w.T @ gx
            dh = dh * z + u.T @ gh
        return dx

    def probabilities(self, states: np.ndarray) -> np.ndarray:
        logits = self.p["out"] @ states + self.p["bias"]
        logits -= logits.max(-2, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(-2, keepdims=True)
        return logits

    def positions(self, codes: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Language probabilities (steps, languages, rows) at each byte of the segments ``codes`` (steps, rows)."""
        x = np.ascontiguousarray(np.take(self.p["embed"], codes, axis=1).transpose(1, 0, 2))
        m = mask[:, None, :]
        f, _ = self.direction("f", x, m)
        b, _ = self.direction("b", x, m)
        return self.probabilities(np.concatenate((f, b), axis=1))

    def documents(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Mean probabilities (documents, languages) over all bytes of each document."""
        size = np.diff(off)
        parts = -(-size // SEGMENT)
        doc = np.repeat(np.arange(len(size)), parts)
        begin = off[:-1][doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)) * SEGMENT
        length = np.minimum(off[1:][doc] - begin, SEGMENT)
        total = np.zeros((len(size), len(self.languages)))
        padded = np.concatenate((buf, np.zeros(SEGMENT, np.uint8)))
        step = np.arange(SEGMENT)[:, None]
        for lo in range(0, len(doc), _ROWS):
            s = slice(lo, lo + _ROWS)
            mask = (step < length[s]).astype(np.float32)
            p = (self.positions(padded[begin[s] + step], mask) * mask[:, None, :]).sum(0, dtype=np.float64)
            for k in range(len(self.languages)):
                total[:, k] += np.bincount(doc[s], p[k], minlength=len(size))
        return total / np.maximum(size, 1)[:, None]


def train(texts: list[bytes], labels: list[int], languages: list[str], steps: int = STEPS, seed: int = 3) -> Network:
    """Adam on the cross-entropy at every position of segments drawn evenly by language, from anywhere in a text."""
    net, rng = Network(languages), np.random.default_rng(seed)
    usable = [(np.frombuffer(t, np.uint8), y) for t, y in zip(texts, labels, strict=True) if len(t)]
    by = [[t for t, y in usable if y == k] for k in range(len(languages))]
    have = [k for k, x in enumerate(by) if x]
    if len(languages) < 2 or not have:
        return net
    m, v = ({k: np.zeros_like(x) for k, x in net.p.items()} for _ in range(2))
    for step in range(1, steps + 1):
        y = rng.choice(have, BATCH)
        codes, mask = np.zeros((TRAIN_SEGMENT, BATCH), np.uint8), np.zeros((TRAIN_SEGMENT, BATCH), np.float32)
        for j, k in enumerate(y):
            t = by[k][rng.integers(len(by[k]))]
            at = rng.integers(max(1, len(t) - TRAIN_SEGMENT + 1))
            piece = t[at : at + TRAIN_SEGMENT]
            codes[: len(piece), j], mask[: len(piece), j] = piece, 1
        x, w = np.ascontiguousarray(np.take(net.p["embed"], codes, axis=1).transpose(1, 0, 2)), mask[:, None, :]
        f, sf = net.direction("f", x, w, True)
        b, sb = net.direction("b", x, w, True)
        both = np.concatenate((f, b), axis=1)
        d = net.probabilities(both)
        d[:, y, np.arange(BATCH)] -= 1
        d *= w / mask.sum()
        g = {k: np.zeros_like(p) for k, p in net.p.items()}
        g["out"] = np.einsum("tlr,thr->lh", d, both)
        g["bias"] = d.sum((0, 2))[:, None]
        dh = net.p["out"].T @ d
        dx = net.back("f", x, w, sf, dh[:, :HIDDEN], g) + net.back("b", x, w, sb, dh[:, HIDDEN:], g)
        for e in range(EMBED):
            g["embed"][e] = np.bincount(codes.ravel(), dx[:, e].ravel(), minlength=256)
        rate = RATE * min(1, 2 * (1 - (step - 1) / steps))
        for k, p in net.p.items():
            m[k] += 0.1 * (g[k] - m[k])
            v[k] += 0.01 * (g[k] ** 2 - v[k])
            p -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def fit(docs: DataFrame, sample: int = SAMPLE, size: int = SAMPLE_BYTES) -> Network:
    """Learns text and non-null lang of at most ``sample`` documents a language, not held out.

    The choice is by hash of doc_id; whole texts are taken while they have ``size`` bytes
    a language. Of several texts of one doc_id and language the least is taken.
    """
    rows = docs.select("doc_id", "text", "lang").where("doc_id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL").where(~held_out(F.col("doc_id")))
    by = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = rows.select("doc_id", "lang").withColumn("k", F.dense_rank().over(by)).where(F.col("k") <= sample).select("doc_id", "lang").distinct()
    got = bounded_texts(rows.join(F.broadcast(chosen), ["doc_id", "lang"], "left_semi").select(F.col("lang").alias("label"), "doc_id", "text"), size)
    languages = sorted({x for x, _, _ in got})
    return train([t.encode() for _, _, t in got], [languages.index(x) for x, _, _ in got], languages)


_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def _has_letter(raw: bytes) -> bool:
    return any(c.isalpha() for c in raw.decode())


def _label(net: Network):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*net.languages, UNKNOWN], object)
        for piece, buf, off in A.blocks(batches, "text", 1 << 20):
            seen = np.zeros(len(buf) + 1, np.int64)
            np.cumsum(_LETTER[buf], out=seen[1:])
            letters = seen[off[1:]] > seen[off[:-1]]
            for k in np.flatnonzero(~letters & (off[1:] > off[:-1])):
                letters[k] = _has_letter(buf[off[k] : off[k + 1]].tobytes())
            if net.languages:
                p = net.documents(buf, off)
                best = np.where(letters, p.argmax(1), len(net.languages))
                score = np.where(letters, p.max(1), 0.0)
            else:
                best, score = np.zeros(len(letters), np.int64), np.zeros(len(letters))
            yield pa.record_batch([piece.column(0), pa.array(names[best].tolist(), pa.string()), pa.array(np.clip(score, 0, 1))], names=["doc_id", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id, held_out, lang_pred and score (mean probability of that language) of every row.

    Null text, or text without a letter: ``und`` with score 0. So is every text if no
    language was learned. A text of any length counts whole. Repeated rows each get their
    own row; extra columns are ignored.
    """
    rows = bounded(docs).select("doc_id", "text").mapInArrow(_label(net), "doc_id long, lang_pred string, score double")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
