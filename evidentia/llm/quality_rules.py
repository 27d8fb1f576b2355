"""Document quality rules: counts per text, then a hashed n-gram log-likelihood ratio.

Two multinomials over hashed word uni- and bigrams are counted, one over the trusted
target documents and one over the raw corpus. A document's score is the sum of its
n-grams' log ratios divided by their number. Log ratios are fixed-point integers, so
the score, and with it the verdict at the threshold, is the same on any partitioning.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from .store import bounded, checked

BITS = 16
SMOOTH = 1.0
#: Log-likelihood ratio per n-gram (natural log) below which a document is rejected.
THRESHOLD = -0.1
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
_SCALE = 1 << 20

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_CODE_POINT = np.ones(256, bool)
_CODE_POINT[0x80:0xC0] = False


def _grams(h: np.ndarray, first: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets of uni- and bigrams, and the place of the word where each starts."""
    mask = np.uint64((1 << bits) - 1)
    yield (h & mask).astype(np.int64), np.arange(len(h))
    at = np.flatnonzero(A.window_mask(first, 2))
    yield (A.window_hash(h, 2)[at] & mask).astype(np.int64), at


def _sum_by_doc(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[edges[1:]] - total[edges[:-1]]


def _count(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = 1 << bits
        raw, target = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for piece, buf, off in A.blocks(batches, "text"):
            trusted = piece.column(1).fill_null(False).to_numpy(zero_copy_only=False)
            s, e, first = A.find_words(buf, off)
            doc = np.repeat(np.arange(len(off) - 1), np.diff(first))
            for bucket, at in _grams(A.span_hash(buf, s, e), first, bits):
                raw += np.bincount(bucket, minlength=size)
                target += np.bincount(bucket[trusted[doc[at]]], minlength=size)
        some = np.flatnonzero(raw)
        yield pa.record_batch([pa.array(some.astype(np.int32)), pa.array(raw[some]), pa.array(target[some])], names=["bucket", "raw", "target"])

    return run


def ratios(docs: DataFrame, trusted: DataFrame, bits: int = BITS, smooth: float = SMOOTH) -> np.ndarray:
    """Fixed-point log ratio of each bucket, counted over all documents.

    ``trusted``: one column doc_id, the target documents. The result has 2**bits values.
    """
    flags = trusted.select(F.col(trusted.columns[0]).alias("__t")).where("__t IS NOT NULL").distinct().withColumn("__trusted", F.lit(True))
    rows = bounded(docs).select("doc_id", "text").join(checked(flags), F.col("doc_id") == F.col("__t"), "left").select("text", "__trusted")
    counts = rows.mapInArrow(_count(bits), "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    raw, target = np.zeros(1 << bits), np.zeros(1 << bits)
    raw[counts["bucket"]], target[counts["bucket"]] = counts["raw"], counts["target"]
    if not target.sum():
        return np.zeros(1 << bits, np.int64)
    log = lambda c: np.log((c + smooth) / (c.sum() + smooth * len(c)))
    return np.rint((log(target) - log(raw)) * _SCALE).astype(np.int64)


def _repeat_words(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per document, words that lie in a 3-word window found twice or more in it."""
    at = np.flatnonzero(A.window_mask(first, 3))
    covered = np.zeros(len(h) + 1, np.int8)
    if len(at):
        doc = (np.searchsorted(first, at, "right") - 1).astype(np.uint64)
        keys = A.mix(A.window_hash(h, 3)[at] + doc * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(keys)
        runs = A.group_runs(keys[order])
        size = np.diff(np.append(runs, len(keys)))
        hit = at[order[np.repeat(size > 1, size)]]
        for k in range(3):
            covered[hit + k] = 1
    return _sum_by_doc(covered[:-1], first)


def _dup_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.split()]
    return len(lines) - len(set(lines))


_OUT = [("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), ("base_failed", pa.bool_()), ("llr", pa.float64()), ("kept", pa.bool_())]


def _judge(table: np.ndarray, bits: int, threshold: float):
    floor = round(threshold * _SCALE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, buf, off in A.blocks(batches, "text"):
            s, e, first = A.find_words(buf, off)
            h = A.span_hash(buf, s, e)
            words = np.diff(first)
            chars = _sum_by_doc(_CODE_POINT[buf] & ~A.SPACE[buf], off)
            symbols = _sum_by_doc(_SYMBOL[buf], off)
            raw = buf.tobytes()
            lines = np.array([_dup_lines(raw[a:b]) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)], np.int64)
            repeats = _repeat_words(h, first)
            total, grams = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
            for bucket, at in _grams(h, first, bits):
                edges = np.searchsorted(at, first)
                total += _sum_by_doc(table[bucket], edges)
                grams += np.diff(edges)
            failed = (words < MIN_WORDS) | (100 * repeats > MAX_REPEAT_PERCENT * words)
            kept = ~failed & (total >= floor * grams)
            llr = total / np.maximum(grams, 1) / _SCALE
            values = [piece.column(0), *map(pa.array, (words, chars, symbols, lines, repeats, failed, llr, kept))]
            yield pa.record_batch(values, schema=pa.schema(_OUT))

    return run


def judge(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD, bits: int = BITS) -> DataFrame:
    """Counts, base rules, log-likelihood ratio and verdict of every document.

    Words are runs of anything but ASCII white space. Null or empty text has no words and
    fails the base rule. Repeated rows each get their own row. Without trusted documents
    (or with none that has words) all ratios are 0 and the base rules alone decide.
    Extra columns are ignored; a null doc_id stays null.
    """
    table = ratios(docs, trusted, bits)
    return docs.select("doc_id", "text").mapInArrow(_judge(table, bits, threshold), "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, llr double, kept boolean")
