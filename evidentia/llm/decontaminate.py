"""Benchmark decontamination with spaced seeds.

A mask slides over the tokens and hashes only its marked positions, so a window still
meets its source after a substitution at an unmarked one. Hashes of the test items and
of all documents are joined; around each hit, item and document are compared token by
token on that diagonal. An item counts as found where the diagonal holds ``SHARE`` of all
its tokens, or where a segment of it holds ``RUN`` matching tokens.

Items of one token sequence are one class. The documents are read once: the index of a
benchmark of up to ``ITEM_BYTES`` goes to every task, a larger one is joined by hash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from .store import bounded, fresh, save, shared_dir

#: Fixed masks, each of 6 marked positions over 11 tokens. Together they meet every item of
#: 13 tokens and more of which 0.8 match (all patterns tried up to 20 tokens, samples beyond).
MASKS = ("11001010011", "10010011101", "11110000011", "10001110101", "11001101001", "11110000011")
SPAN = 11
#: Items of fewer tokens have masks as long as themselves.
SHORT = 13
#: Share of an item's tokens that a diagonal must match.
SHARE = 0.8
#: Or so many matching tokens in one segment, whatever the item's length.
RUN = 20
#: Score of a substituted token in a segment, where a match scores 1.
PENALTY = -3
#: Benchmarks of so many bytes of distinct text travel to the tasks whole.
ITEM_BYTES = 2 << 20
_FILTER_BITS = 26

#: All ASCII but letters and digits separates tokens.
_BREAK = np.zeros(256, bool)
_BREAK[:128] = True
_BREAK[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False


def _tokens(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    s, e, first = A.find_words(buf, off, _BREAK)
    return A.span_hash(buf, s, e), first


def short_masks(n: int) -> list[str]:
    """Masks over a whole item of n < SHORT tokens: any substitutions that SHARE allows leave one of them whole.

    Positions fall into three classes by their remainder. One substitution spares two
    classes, two spare one; with none allowed all is marked.
    """
    free = n - math.ceil(SHARE * n - 1e-9)
    if not free:
        return ["1" * n]
    return ["".join("1" if (k % 3 != r) == (free == 1) else "0" for k in range(n)) for r in range(3)]


def _seed(h: np.ndarray, mask: str, name: int) -> np.ndarray:
    """Hash of the marked tokens of each window; ``name`` tells masks apart."""
    n = len(h) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, name, np.uint64)
    for k, c in enumerate(mask):
        if c == "1":
            out += h[k : k + n] * np.uint64((2 * k + 1) * 0x9E3779B97F4A7C15 % (1 << 64) | 1)
    return A.mix(out)


def all_masks() -> list[tuple[int, int, str]]:
    """(name, tokens of the items it is for, or 0 for all of SHORT and more, mask)."""
    rows = [(0, m) for m in dict.fromkeys(MASKS)] + [(n, m) for n in range(1, SHORT) for m in short_masks(n)]
    return [(k + 1, n, m) for k, (n, m) in enumerate(rows)]


def item_seeds(tokens: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, str, np.ndarray, np.ndarray, np.ndarray]]:
    """For each mask that some item uses: name, mask, and hash, item and place of its seeds."""
    sizes = np.diff(first)
    for name, size, mask in all_masks():
        at = np.flatnonzero(A.window_mask(first, len(mask)))
        item = np.searchsorted(first, at, "right") - 1
        mine = sizes[item] == size if size else sizes[item] >= SHORT
        at, item = at[mine], item[mine]
        if len(at):
            yield name, mask, _seed(tokens, mask, name)[at], item, at - first[item]


def overlap(own: np.ndarray, words: np.ndarray, diagonal: int) -> tuple[str, int, int, int, int] | None:
    """How an item is found on a diagonal: rule, matched tokens, span, start in the document and in the item; or None."""
    lo, hi = max(0, -diagonal), min(len(own), len(words) - diagonal)
    same = own[lo:hi] == words[lo + diagonal : hi + diagonal]
    if int(same.sum()) >= math.ceil(SHARE * len(own) - 1e-9):
        at = np.flatnonzero(same)
        rule, begin, end = "share", int(at[0]), int(at[-1]) + 1
    else:
        total = np.concatenate(([0], np.cumsum(np.where(same, 1, PENALTY))))
        end = int(np.argmax(total - np.minimum.accumulate(total)))
        rule, begin = "run", int(np.argmin(total[: end + 1]))
        if int(same[begin:end].sum()) < RUN:
            return None
    return rule, int(same[begin:end].sum()), end - begin, lo + begin + diagonal, lo + begin


def _better(new: tuple, old: tuple | None) -> bool:
    return old is None or (new[1], new[0] == "share") > (old[1], old[0] == "share")


class Items:
    """Token hashes of all item classes and their sorted seeds for each mask."""

    def __init__(self, ids: list[int], texts: list[bytes]):
        off = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) for t in texts], out=off[1:])
        self.ids = np.array(ids, np.int64)
        self.tokens, self.first = _tokens(np.frombuffer(b"".join(texts), np.uint8), off)
        self.seeds = []
        for name, mask, hashes, item, place in item_seeds(self.tokens, self.first):
            order = np.argsort(hashes, kind="stable")
            bits = np.zeros(1 << 20, bool)
            bits[hashes >> np.uint64(44)] = True
            self.seeds.append((name, mask, hashes[order], item[order], place[order], bits))

    def hits(self, h: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Distinct rows (document, item, diagonal) of all seed hits."""
        found = []
        for name, mask, hashes, item, place, bits in self.seeds:
            mine = _seed(h, mask, name)
            at = np.flatnonzero(bits[mine >> np.uint64(44)] & A.window_mask(first, len(mask))) if len(mine) else np.empty(0, np.int64)
            lo, hi = np.searchsorted(hashes, mine[at]), np.searchsorted(hashes, mine[at], "right")
            n = hi - lo
            k = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
            at = np.repeat(at, n)
            doc = np.searchsorted(first, at, "right") - 1
            found.append(np.stack((doc, item[k], at - first[doc] - place[k]), 1))
        return np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 3), np.int64)

    def verify(self, h: np.ndarray, first: np.ndarray) -> list[tuple]:
        """(document, item, rule, matched, span, start in document, start in item) of all items found."""
        best: dict[tuple[int, int], tuple] = {}
        for doc, item, diagonal in self.hits(h, first).tolist():
            got = overlap(self.tokens[self.first[item] : self.first[item + 1]], h[first[doc] : first[doc + 1]], diagonal)
            if got and _better(got, best.get((doc, item))):
                best[doc, item] = got
        return [(d, i, *v) for (d, i), v in sorted(best.items())]


def _canonical(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Items by their tokens, joined by one space; those without a token go."""
    for piece, buf, off in A.blocks(batches, "text"):
        s, e, first = A.find_words(buf, off, _BREAK)
        raw, k = buf.tobytes(), np.flatnonzero(np.diff(first))
        words = [raw[a:b] for a, b in zip(s.tolist(), e.tolist(), strict=True)]
        text = [b" ".join(words[first[i] : first[i + 1]]).decode() for i in k.tolist()]
        yield pa.record_batch([piece.column(0).take(pa.array(k)), pa.array(text, pa.string())], names=["item_id", "text"])


def item_classes(benchmark: DataFrame) -> DataFrame:
    """Classes of items with equal tokens: class (a 64-bit hash), text, item_id (the smallest), n_items."""
    rows = benchmark.where("text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), F.lower("text").alias("text"))
    rows = rows.mapInArrow(_canonical, "item_id long, text string")
    return rows.groupBy("text").agg(F.min("item_id").alias("item_id"), F.count(F.lit(1)).alias("n_items")).withColumn("class", F.xxhash64("text"))


_FOUND = "class long, rule string, n_matched long, n_span long, doc_start long, item_start long, overlap double"


def _found_batch(rows: list[tuple], lead: list[pa.Array], lead_names: list[str]) -> pa.RecordBatch:
    columns = [pa.array(c, pa.string() if k == 1 else pa.float64() if k == 6 else pa.int64()) for k, c in enumerate(zip(*rows, strict=True))]
    return pa.record_batch([*lead, *columns], names=[*lead_names, "class", "rule", "n_matched", "n_span", "doc_start", "item_start", "overlap"])


def _find(items):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = items.value
        sizes = np.diff(index.first)
        for piece, buf, off in A.blocks(batches, "text"):
            got = index.verify(*_tokens(buf, off))
            if got:
                rows = [(int(index.ids[i]), *rest, rest[1] / int(sizes[i])) for _, i, *rest in got]
                yield _found_batch(rows, [piece.column(0).take(pa.array([r[0] for r in got]))], ["doc_id"])

    return run


def _emit_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece, buf, off in A.blocks(batches, "text"):
        ids = piece.column(0).to_numpy()
        for _, _, hashes, item, place in item_seeds(*_tokens(buf, off)):
            yield pa.record_batch([pa.array(hashes.view(np.int64)), pa.array(ids[item]), pa.array(place)], names=["seed", "class", "place"])


def _probe(bits):
    """Document seeds that may be item seeds, by the bit filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(bits.value, np.uint64)
        for piece, buf, off in A.blocks(batches, "text"):
            h, first = _tokens(buf, off)
            for name, _, mask in all_masks():
                mine = _seed(h, mask, name)
                if not len(mine):
                    continue
                cell = (mine >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)
                may = (table[cell >> 6] >> (cell & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
                at = np.flatnonzero(may & A.window_mask(first, len(mask)))
                doc = np.searchsorted(first, at, "right") - 1
                yield pa.record_batch([piece.column(0).take(pa.array(doc)), pa.array(mine[at].view(np.int64)), pa.array(at - first[doc])], names=["doc_id", "seed", "at"])

    return run


def _check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Verifies rows (doc_id, text, class, item, diagonals)."""
    for batch in batches:
        words, own = ([_tokens(b, np.array([0, len(b)]))[0] for t in batch.column(c).to_pylist() for b in [np.frombuffer((t or "").encode(), np.uint8)]] for c in (1, 3))
        at, rows = [], []
        for k, (w, o, cls, diagonals) in enumerate(zip(words, own, batch.column(2).to_pylist(), batch.column(4).to_pylist(), strict=True)):
            best = None
            for d in sorted(diagonals):
                got = overlap(o, w, d)
                if got and _better(got, best):
                    best = got
            if best:
                at.append(k)
                rows.append((cls, *best, best[1] / len(o)))
        if rows:
            yield _found_batch(rows, [batch.column(0).take(pa.array(at))], ["doc_id"])


def _joined(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """What :func:`_find` gives, by a hash join of document and item seeds, for a benchmark of any size."""
    spark = rows.sparkSession
    seeds = save(classes.select("class", "text").mapInArrow(_emit_seeds, "seed long, class long, place long"), shared_dir(spark, "item-seeds"))
    cell = F.shiftrightunsigned("seed", 64 - _FILTER_BITS)
    bits = seeds.groupBy(F.shiftright(cell, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, CAST(shiftrightunsigned(seed, {64 - _FILTER_BITS}) & 63 AS INT))")).alias("bits")).toPandas()
    table = np.zeros(1 << (_FILTER_BITS - 6), np.int64)
    table[bits["word"].to_numpy(np.int64)] = bits["bits"].to_numpy(np.int64)
    hits = rows.mapInArrow(_probe(spark.sparkContext.broadcast(table.tobytes())), "doc_id long, seed long, at long")
    near = hits.join(seeds, "seed").select("doc_id", "class", (F.col("at") - F.col("place")).alias("diagonal")).distinct()
    near = near.groupBy("doc_id", "class").agg(F.collect_list("diagonal").alias("diagonals")).withColumnRenamed("doc_id", "hit_id")
    near = save(near.join(classes.select("class", F.col("text").alias("item")), "class"), shared_dir(spark, "item-hits"))
    both = near.join(rows, F.col("hit_id").eqNullSafe(F.col("doc_id")))
    return both.select("doc_id", "text", "class", "item", "diagonals").mapInArrow(_check, f"doc_id long, {_FOUND}")


def _matches(docs: DataFrame, classes: DataFrame, item_bytes: int) -> DataFrame:
    rows = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.lower("text").alias("text"))
    if (classes.agg(F.sum(F.octet_length("text"))).first()[0] or 0) > item_bytes:
        return _joined(rows, classes)
    got = sorted((r["class"], r["text"]) for r in classes.select("class", "text").collect())
    items = docs.sparkSession.sparkContext.broadcast(Items([c for c, _ in got], [t.encode() for _, t in got]))
    return rows.mapInArrow(_find(items), f"doc_id long, {_FOUND}")


def _classes(benchmark: DataFrame) -> DataFrame:
    return save(item_classes(bounded(benchmark)), shared_dir(benchmark.sparkSession, "items"))


def find(docs: DataFrame, benchmark: DataFrame, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """A row for each document and class of items that overlap: the contaminated documents.

    doc_id, item_id (the smallest of the class) and n_items of it, the rule that holds
    (``share`` or ``run``), tokens matched and how far they reach, where they start in
    document and item (in tokens), and the share of the item matched. Tokens are runs of
    letters and digits, lower-cased. Null or empty texts meet nothing, a text of any
    length is searched whole; an empty benchmark gives no rows; repeated rows give a row
    each; a null doc_id or item_id stays null (an item_id, where its class has no other).
    Extra columns are ignored.
    """
    classes = _classes(benchmark)
    found = _matches(docs, classes, item_bytes)
    return found.join(F.broadcast(classes.select("class", "item_id", "n_items")) if _few(classes) else classes.select("class", "item_id", "n_items"), "class").select("doc_id", "item_id", "n_items", "rule", "n_matched", "n_span", "doc_start", "item_start", "overlap")


def _few(classes: DataFrame, rows: int = 200_000) -> bool:
    return classes.limit(rows + 1).count() <= rows


def _keep(items, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = items.value
        for piece, buf, off in A.blocks(batches, name):
            clean = np.ones(piece.num_rows, bool)
            for got in index.verify(*_tokens(buf, off)):
                clean[got[0]] = False
            yield piece.filter(pa.array(clean))

    return run


def clean(docs: DataFrame, benchmark: DataFrame, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """The rows, all columns, that overlap no test item, by the rules of :func:`find`.

    With a benchmark over ``item_bytes``, rows of one doc_id go together.
    """
    classes = _classes(benchmark)
    if (classes.agg(F.sum(F.octet_length("text"))).first()[0] or 0) > item_bytes:
        name = fresh(docs, "found")
        found = _matches(docs, classes, item_bytes).select(F.col("doc_id").alias(name)).distinct()
        return docs.join(found, F.col("doc_id").eqNullSafe(F.col(name)), "left_anti")
    got = sorted((r["class"], r["text"]) for r in classes.select("class", "text").collect())
    items = docs.sparkSession.sparkContext.broadcast(Items([c for c, _ in got], [t.encode() for _, t in got]))
    name = fresh(docs, "lower")
    rows = bounded(docs).withColumn(name, F.lower("text"))
    return rows.mapInArrow(_keep(items, name), rows.schema).drop(name)
