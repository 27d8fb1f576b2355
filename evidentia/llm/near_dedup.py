"""Near-duplicate groups by improved consistent weighted sampling of TF-IDF shingles.

Shingles are five consecutive words (a shorter text is one shingle), weighted by
(1 + ln tf) * idf. Document frequencies come from a count-min sketch over all documents,
whose size does not grow with them; a shingle has the same weight everywhere. Each of
``BANDS * ROWS`` samples picks one (shingle, quantised weight) of a document such that
two documents agree with probability equal to their weighted Jaccard similarity.

Exact copies (equal word sequences) collapse to a class first. Classes that agree in a
band are candidates. Each member of a bucket is first verified against two pivots, which
is linear in the bucket and settles most; then, in every bucket whose members this leaves
in several components, all pairs of different components are compared, in blocks. Groups
are so the connected components over all candidate pairs of enough weighted Jaccard
similarity, whatever the size of a bucket.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from .components import components
from .store import bounded, checked, fresh, release, remove, save, shared_dir

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 12
ROWS = 4
#: Two pivots meet all pairs of a bucket of so many members.
COVERED = 3
#: Members of a bucket that a task holds on either side.
BLOCK = 128
#: How far document frequency spreads weights: idf lies between 1 and 1 + GAIN.
GAIN = 0.5
SKETCH_BITS = 19
_SLICE = 1 << 14
#: Sketches that a task adds up.
_FAN = 128


def _shingles(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes by document, how often each occurs, and the first of each document."""
    n = np.diff(first)
    at = np.flatnonzero(A.window_mask(first, SHINGLE))
    h = A.window_hash(words, SHINGLE)[at]
    doc = np.searchsorted(first, at, "right") - 1
    extra_doc, extra = [], []
    for size in range(1, SHINGLE):
        some = np.flatnonzero(n == size)
        if len(some):
            extra_doc.append(some)
            extra.append(A.window_hash(words, size, seed=size)[first[some]])
    if extra:
        h, doc = np.concatenate((h, *extra)), np.concatenate((doc, *extra_doc))
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    lead = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])))) if len(h) else np.empty(0, np.int64)
    count = np.diff(np.append(lead, len(h)))
    return h[lead], count, np.searchsorted(doc[lead], np.arange(len(n) + 1))


def _cells(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64((1 << SKETCH_BITS) - 1)
    return (h & mask).astype(np.int64), (h >> np.uint64(24) & mask).astype(np.int64) + (1 << SKETCH_BITS)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard
    from pyspark import TaskContext

    counts = np.zeros(2 << SKETCH_BITS, np.int64)
    docs = 0
    for _, buf, off in A.blocks(batches, "text"):
        s, e, first = A.find_words(buf, off)
        h, _, _ = _shingles(A.span_hash(buf, s, e), first)
        for cells in _cells(h):
            counts += np.bincount(cells, minlength=len(counts))
        docs += len(off) - 1
    if docs:
        z, task, rows = zstandard.ZstdCompressor(level=1), TaskContext.get().partitionId(), []
        for k in range(len(counts) // _SLICE):
            part = counts[k * _SLICE : (k + 1) * _SLICE]
            if part.any():
                rows.append((task // _FAN, k, z.compress(part.astype("<i8").tobytes())))
        rows.append((task // _FAN, -1, z.compress(np.array([docs], "<i8").tobytes())))
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PART, strict=True)], schema=_PART)


_PART = pa.schema([("part", pa.int64()), ("slice", pa.int32()), ("counts", pa.binary())])


def _add(table):
    import zstandard

    z, total = zstandard.ZstdDecompressor(), 0
    for x in table["counts"]:
        total = total + np.frombuffer(z.decompress(x.as_py()), "<i8")
    packed = zstandard.ZstdCompressor(level=1).compress(total.astype("<i8").tobytes())
    return pa.table([pa.array([table["part"][0].as_py() // _FAN]), table["slice"][:1], pa.array([packed], pa.binary())], schema=_PART)


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Count-min cells of document frequencies over all documents, and the number of documents."""
    import zstandard

    kind = "part long, slice int, counts binary"
    parts = docs.select("text").mapInArrow(_sketch, kind)
    for _ in range(3):  # a task adds up to _FAN sketches of a slice: enough for two million tasks
        parts = parts.groupBy("part", "slice").applyInArrow(_add, kind)
    cells, n, z = np.zeros(2 << SKETCH_BITS, np.int64), 0, zstandard.ZstdDecompressor()
    for r in parts.collect():
        got = np.frombuffer(z.decompress(r.counts), "<i8")
        if r.slice < 0:
            n = int(got[0])
        else:
            cells[r.slice * _SLICE : (r.slice + 1) * _SLICE] = got
    return cells, n


def idf_table(cells: np.ndarray, docs: int) -> np.ndarray:
    """idf by cell. Each row of cells loses its mean, which is what other shingles add to a cell."""
    if not docs:
        return np.ones(len(cells), np.float32)
    rows = cells.reshape(2, -1).astype(np.float64)
    own = np.maximum(rows - rows.mean(1, keepdims=True), 0).ravel()
    return (1 + GAIN * np.clip(np.log((1 + docs) / (1 + own)) / np.log(1 + docs), 0, 1)).astype(np.float32)


def _weights(h: np.ndarray, count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    a, b = _cells(h)
    return (1 + np.log(count.astype(np.float32))) * np.maximum(idf[a], idf[b])  # the lesser count


class _Draws:
    """Quantised variates: Gamma(2, 1) at 4096 points, the log of another at 65536."""

    def __init__(self):
        self.r = self._gamma(4096).astype(np.float32)
        self.log_c = np.log(self._gamma(65536)).astype(np.float32)

    @staticmethod
    def _gamma(n: int) -> np.ndarray:
        """Quantiles of Gamma(2, 1) at midpoints: inverts 1 - (1 + x) exp(-x)."""
        q = (np.arange(n) + 0.5) / n
        x = np.sqrt(2 * q) + q
        for _ in range(60):
            x = np.maximum(x - ((1 - (1 + x) * np.exp(-x)) - q) / np.maximum(x * np.exp(-x), 1e-300), x / 4)
        return x


_draws: list[_Draws] = []


def samples(h: np.ndarray, weights: np.ndarray, first: np.ndarray, number: int) -> np.ndarray:
    """Sample values (number, documents) as uint32; documents must have a shingle."""
    if not _draws:
        _draws.append(_Draws())
    d, log_w = _draws[0], np.log(weights).astype(np.float32)
    out = np.empty((number, len(first) - 1), np.uint32)
    for k in range(number):
        x = A.mix(h + np.uint64((k + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
        r = d.r[(x & np.uint64(0xFFF)).astype(np.int32)]
        beta = (x >> np.uint64(12) & np.uint64(0xFFFFF)).astype(np.float32) * np.float32(2**-20)
        t = np.floor(log_w / r + beta)
        rank = d.log_c[(x >> np.uint64(48)).astype(np.int32)] - r * (t - beta + 1)
        rank += np.float32(4096)  # positive floats order as their bits
        name = (x >> np.uint64(16)).astype(np.uint32) + t.astype(np.int32).view(np.uint32) * np.uint32(0x85EBCA6B)
        both = rank.view(np.uint32).astype(np.uint64) << np.uint64(32) | name
        out[k] = np.minimum.reduceat(both, first[:-1]).astype(np.uint32)
    return out


def _sign(idf, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = idf.value
        for piece, buf, off in A.blocks(batches, "text"):
            s, e, first = A.find_words(buf, off)
            some = np.flatnonzero(np.diff(first))
            if not len(some):
                continue
            h, count, begin = _shingles(A.span_hash(buf, s, e), first)
            begin = np.append(begin[some], begin[-1])
            got = samples(h, _weights(h, count, table), begin, bands * rows).astype(np.uint64)
            keys = np.empty((len(some), bands), np.int64)
            for b in range(bands):
                key = np.full(len(some), b + 1, np.uint64)
                for r in range(rows):
                    key = A.mix(key * np.uint64(0x9E3779B97F4A7C15) + got[b * rows + r])
                keys[:, b] = key.view(np.int64)
            raw = buf.tobytes()
            names = [hashlib.blake2b(b" ".join(raw[a:z].split()), digest_size=16).digest() for a, z in zip(off[:-1][some].tolist(), off[1:][some].tolist(), strict=True)]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * bands, pa.int32()), pa.array(keys.ravel()))
            yield pa.record_batch([piece.column(0).take(pa.array(some)), pa.array(names, pa.binary()), lists], names=["doc_id", "class", "keys"])

    return run


def buckets(classes: DataFrame) -> DataFrame:
    """Members (key, id, n, p1, p2) of buckets of n > 1 classes, with the two pivots of each bucket."""
    members = classes.select(F.col("id"), F.explode("keys").alias("key"))
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("p1"), F.min_by("id", F.xxhash64("id", "key")).alias("p2"))
    return members.join(sizes.where("n > 1"), "key")


def pivot_pairs(shared: DataFrame) -> DataFrame:
    """Distinct pairs (id, pivot) of the buckets, with the size n of the largest one that has the pair."""
    rows = shared.select("id", "n", "p1", F.explode(F.array("p1", "p2")).alias("pivot")).where("id <> pivot AND id <> p1")
    return rows.groupBy("id", "pivot").agg(F.max("n").alias("n"))


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard of two (sorted shingles, weights)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    low = float(np.minimum(a[1][i], b[1][j]).sum())
    return low / (float(a[1].sum()) + float(b[1].sum()) - low)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    z = zstandard.ZstdCompressor(level=3)
    for piece, buf, off in A.blocks(batches, "text"):
        raw = buf.tobytes()
        yield pa.record_batch([piece.column(0), pa.array([z.compress(raw[a:b]) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)], pa.binary())], names=["id", "packed"])


def _vector(packed: bytes, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted shingles and weights of a packed text."""
    import zstandard

    buf = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
    s, e, first = A.find_words(buf, np.array([0, len(buf)]))
    h, count, _ = _shingles(A.span_hash(buf, s, e), first)
    return h, _weights(h, count, table).astype(np.float64)


def _verify(idf, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, held, held_id = idf.value, None, None
        for batch in batches:
            ids, pivots, out = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
            for k in range(batch.num_rows):
                if held_id != pivots[k]:
                    held_id, held = pivots[k], _vector(batch.column(3)[k].as_py(), table)
                if similarity(held, _vector(batch.column(2)[k].as_py(), table)) >= least:
                    out.append(sorted((ids[k], pivots[k])))
            if out:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])

    return run


def packed_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows (id, packed), one for each id in ``wanted``."""
    rows = docs.select(F.col("doc_id").alias("id"), "text")
    # repeated doc_ids: one text speaks for the document
    return rows.join(checked(wanted), "id", "left_semi").mapInArrow(_pack, "id long, packed binary").groupBy("id").agg(F.min("packed").alias("packed"))


def links(texts: DataFrame, pairs: DataFrame, idf, least: float) -> DataFrame:
    """The pairs (id, pivot) whose weighted Jaccard similarity is at least ``least``, as a < b.

    A pivot's text goes once to each part of at most about ``BLOCK`` of its members, so
    the pivot of a large bucket is spread over as many tasks.
    """
    parts = F.ceil(F.col("n") / F.lit(BLOCK))
    members = pairs.withColumn("part", F.pmod(F.xxhash64("id"), parts)).join(texts.withColumnRenamed("packed", "x"), "id")
    sides = pairs.groupBy("pivot").agg(F.max("n").alias("n")).join(texts.select(F.col("id").alias("pivot"), F.col("packed").alias("y")), "pivot")
    sides = sides.select("pivot", "y", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"))
    return members.join(sides, ["pivot", "part"]).select("id", "pivot", "x", "y").mapInArrow(_verify(idf, least), "a long, b long")


def _across(idf, least: float):
    """Links of a block of a bucket's rest with a chunk of its members, one for each two components."""

    def run(table: pa.Table) -> pa.Table:
        weigh = idf.value
        table = table.sort_by([("id", "ascending"), ("side", "ascending")])
        side, rest, ids = (table[c].to_numpy() for c in ("side", "rest", "id"))
        root = np.unique(table["label"].to_numpy(), return_inverse=True)[1]
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        out = []
        if len(left) and len(right):
            held = {}
            for k in range(len(ids)):
                if ids[k] not in held:
                    held[ids[k]] = _vector(table["packed"][k].as_py(), weigh)
            keys = np.array(table["keys"].to_pylist(), np.int64)
            band = keys == table["key"][0].as_py()
            earlier = ~np.logical_or.accumulate(band, axis=1)
            vectors = [held[ids[k]] for k in right]
            owner = np.repeat(np.arange(len(right)), [len(v[0]) for v in vectors])
            every, place = np.unique(np.concatenate([v[0] for v in vectors]), return_inverse=True)
            weight, total = np.concatenate([v[1] for v in vectors]), np.array([v[1].sum() for v in vectors])
            dense = np.zeros(len(every))
            for k in left.tolist():
                open_ = root[right] != root[k]
                open_ &= ~rest[right] | (ids[right] > ids[k])  # pairs within the rest once
                if open_.any():  # a pair that shares an earlier band is met there
                    open_ &= ~((keys[right] == keys[k]) & earlier[k]).any(1)
                if not open_.any():
                    continue
                h, w = held[ids[k]]
                if not len(h) or not len(every):
                    continue
                at = np.minimum(np.searchsorted(every, h), len(every) - 1)
                same = every[at] == h
                dense[at[same]] = w[same]
                low = np.bincount(owner, np.minimum(dense[place], weight), len(right))
                dense[at[same]] = 0
                for m in np.flatnonzero(open_ & (low >= (least - 1e-9) * (total + w.sum() - low))).tolist():
                    other = right[m]
                    if root[other] != root[k] and similarity(held[ids[k]], vectors[m]) >= least:
                        out.append(sorted((int(ids[k]), int(ids[other]))))
                        root[root == root[other]] = root[k]
        x, y = zip(*out, strict=True) if out else ((), ())
        return pa.table({"a": pa.array(x, pa.int64()), "b": pa.array(y, pa.int64())})

    return run


def remainder(texts: DataFrame, classes: DataFrame, shared: DataFrame, labels: DataFrame, root: str, idf, least: float) -> DataFrame | None:
    """Links (a, b) across components (``labels``) within buckets; None if no bucket is open.

    All pairs of different components are compared, in blocks; the largest component of
    a bucket is not compared with itself, so a bucket with few left over costs little.
    """
    large = shared.where(F.col("n") > COVERED).select("key", "id").distinct()
    large = large.join(labels.select(F.col("v").alias("id"), "label"), "id", "left").select("key", "id", F.coalesce("label", "id").alias("label"))
    sizes = large.groupBy("key", "label").agg(F.count(F.lit(1)).alias("c"))
    open_ = sizes.groupBy("key").agg(F.count(F.lit(1)).alias("labels"), F.max(F.struct("c", "label")).alias("most"), F.sum("c").alias("n")).where("labels > 1")
    parts = lambda c: F.ceil(c / F.lit(BLOCK)).cast("int")
    open_ = save(open_.select("key", F.col("most.label").alias("base"), parts(F.col("n") - F.col("most.c")).alias("blocks"), parts(F.col("n")).alias("chunks")), f"{root}/open")
    if open_.isEmpty():
        return None
    rest = F.col("label") != F.col("base")
    members = save(large.join(checked(open_), "key").select("key", "id", "label", rest.alias("rest"), "blocks", "chunks"), f"{root}/left")
    spread = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    rows = members.where("rest").select("*", F.lit(0).alias("side"), spread("blocks").alias("block"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    rows = rows.unionByName(members.select("*", F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), spread("chunks").alias("chunk")))
    known = texts.join(classes.groupBy("id").agg(F.min("keys").alias("keys")), "id")
    rows = rows.select("key", "block", "chunk", "side", "rest", "id", "label").join(known, "id")
    return rows.groupBy("key", "block", "chunk").applyInArrow(_across(idf, least), "a long, b long")


def groups(docs: DataFrame, least: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per document row: doc_id, class_id, group_id, kept.

    class_id is the smallest doc_id with the same word sequence, group_id the smallest in
    the near-duplicate group, kept whether doc_id is its group's smallest. A null doc_id,
    and a text without a word (null, empty), stand alone, with the own doc_id as class and
    group. Texts of fewer than five words are one shingle; a text of any length is taken
    whole. Rows that repeat a doc_id repeat its result; if their texts differ, they are
    one document of both classes. Extra columns are ignored.
    """
    spark = docs.sparkSession
    root = shared_dir(spark, "neardup")
    docs = bounded(docs).select("doc_id", "text")
    cells, n = document_frequencies(docs)
    idf = spark.sparkContext.broadcast(idf_table(cells, n))
    signed = save(docs.where("doc_id IS NOT NULL").mapInArrow(_sign(idf, bands, rows), "doc_id long, class binary, keys array<long>"), f"{root}/signed")
    classes = save(signed.groupBy("class").agg(F.min("doc_id").alias("id"), F.first("keys").alias("keys")), f"{root}/classes")
    shared = save(buckets(classes), f"{root}/shared")
    release()
    texts = save(packed_texts(docs, shared.select("id").distinct()), f"{root}/texts")
    pairs = save(pivot_pairs(shared), f"{root}/pairs")
    found = save(links(texts, pairs, idf, least), f"{root}/links")
    release()
    labels = components(found, f"{root}/components")
    more = remainder(texts, classes, shared, labels, root, idf, least)
    if more is not None:
        more = save(more, f"{root}/more")
        release()
        if not more.isEmpty():
            labels = components(found.unionByName(more.distinct()), f"{root}/components2")
    for spent in ("shared", "open", "left", "texts", "pairs", "links", "more"):
        remove(spark, f"{root}/{spent}")
    known = classes.select("class", F.col("id").alias("v")).join(labels, "v", "left").select("class", F.col("v").alias("class_id"), F.coalesce("label", "v").alias("group_id"))
    full = signed.select("doc_id", "class").join(known, "class").select("doc_id", "class_id", "group_id")
    blank = (F.length(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", "")) == 0) | F.col("doc_id").isNull()
    alone = docs.where(blank).select("doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("group_id"))
    out = full.unionByName(alone)
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("group_id")))


def dedup(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The rows, all columns, of the smallest doc_id of each group and of documents without a group."""
    spark, name = docs.sparkSession, fresh(docs, "gone")
    gone = groups(docs, least).where("NOT kept").select(F.col("doc_id").alias(name)).distinct()
    gone = save(gone, shared_dir(spark, "neardup-gone"))
    return docs.join(checked(gone), F.col("doc_id") == F.col(name), "left_anti")
