"""Incremental removal of repeated word windows with a log-structured fingerprint index.

Documents come in batches of ascending ``doc_id``. Map tasks hash every window of
``width`` words of a chunk of documents, settle repeats inside the chunk, and send
the first occurrences as packed sorted arrays, one for each bucket. A window's bucket
follows from the least hash among its word 8-grams, which neighbouring windows mostly
share: equal windows meet, and a repeated passage comes back in few rows. Windows of an
8-gram that is frequent by itself (a licence line in differing surroundings) go by their
own hash instead, over all buckets. For each bucket one task merge-joins the batch with the sorted, immutable runs of
earlier batches, confirms each hit with a second hash that starts from other hashes of
the words, and writes the batch's new fingerprints as one more sorted run. When ``fanout`` runs have gathered,
each bucket's runs are merged into one. A passage that a third of all documents
share reaches a bucket once per chunk, not once per document.

All hashes start from a key drawn for each run, so no text can be made to collide; the
result does not depend on it.
"""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import arrays as A
from .store import bounded, file_system, fresh, put, release, remove, save, shared_dir

WIDTH = 20
#: Batches, at least; more where one would have over BATCH_BYTES of text.
BATCHES = 4
BATCH_BYTES = 1 << 42
FANOUT = 3
CHUNK_BYTES = 3 << 20
BUCKET_WINDOWS = 4_000_000
LEAST_BUCKETS = 64
#: One document in so many is looked at for frequent 8-grams; what is found moves windows, no result.
HOT_SAMPLE = 32
_ANCHOR = 8
_NO_ID = -(1 << 63)

_SENT = "bucket int, doc_id long, n int, hashes binary, checks binary, locs binary, docs binary, firsts binary"
_HITS = pa.schema([("doc_id", pa.int64()), ("starts", pa.binary())])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Documents in ascending doc_id within each chunk of bounded size; long batches are cut."""
    held, size = [], 0
    for piece, buf, _ in A.blocks(batches, "text"):
        held.append(piece)
        size += len(buf)
        if size >= CHUNK_BYTES:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _anchors(h: np.ndarray, width: int) -> np.ndarray:
    """The least hash among the word 8-grams of each window."""
    return A.mix(_least(A.window_hash(h, min(_ANCHOR, width), seed=2), max(1, width - _ANCHOR + 1)))


def _hashed(table: pa.Table, width: int, key: int):
    """doc ids (ascending), first word of each, and window hashes, checks and starts of the chunk."""
    ids = table["doc_id"].combine_chunks().fill_null(_NO_ID).to_numpy(zero_copy_only=False)
    order = np.argsort(ids, kind="stable")
    words, others, counts = [None] * len(order), [None] * len(order), np.zeros(len(order), np.int64)
    at = 0
    for _, buf, off in A.blocks(table.to_batches(), "text"):
        starts, ends, first = A.find_words(buf, off)
        h, other = A.span_hash(buf, starts, ends, key), A.span_hash(buf, starts, ends, key + 1)
        for k in range(len(off) - 1):
            words[at], others[at] = h[first[k] : first[k + 1]], other[first[k] : first[k + 1]]
            counts[at] = len(words[at])
            at += 1
    first = np.zeros(len(order) + 1, np.int64)
    np.cumsum(counts[order], out=first[1:])
    none = np.empty(0, np.uint64)
    h, other = (np.concatenate([x[k] for k in order]) if len(order) else none for x in (words, others))
    del words, others
    at = np.flatnonzero(A.window_mask(first, width))
    checks = (A.window_hash(other, width, seed=1)[at] & np.uint64(0xFFFF)).astype(np.uint16)
    del other
    hashes, grams = A.window_hash(h, width)[at], _anchors(h, width)[at]
    return ids[order], first, hashes, checks, grams, at


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values, by doubling."""
    n, size = len(x) - width + 1, 1
    if n <= 0:
        return np.empty(0, x.dtype)
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[:n], x[width - size : width - size + n])


def _starts_by_doc(ids: np.ndarray, pos: np.ndarray) -> pa.RecordBatch:
    """One row per document with the starts of its repeated windows."""
    order = np.lexsort((pos, ids))
    ids, pos = ids[order], pos[order].astype("<u4")
    runs = A.group_runs(ids)
    ends = np.append(runs[1:], len(ids))
    return pa.record_batch([pa.array(ids[runs]), pa.array([pos[a:b].tobytes() for a, b in zip(runs, ends, strict=True)], pa.binary())], schema=_HITS)


def _frequent(width: int, key: int):
    """Anchors that occur more than once in a chunk, with how many windows they have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _chunks(batches):
            grams, n = np.unique(_hashed(table, width, key)[4], return_counts=True)
            much = n > max(1, width - _ANCHOR + 1)  # so of more than one place
            yield pa.record_batch([pa.array(grams[much].view(np.int64)), pa.array(n[much])], names=["anchor", "n"])

    return run


def _send(width: int, buckets: int, key: int, hot: np.ndarray):
    shift = np.uint64(64 - buckets.bit_length() + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = pa.schema([("bucket", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int32()), *((c, pa.binary()) for c in ("hashes", "checks", "locs", "docs", "firsts"))])
        for table in _chunks(batches):
            ids, first, hashes, checks, grams, at = _hashed(table, width, key)
            del table
            if len(hot):
                grams = np.where(np.isin(grams, hot), A.mix(hashes), grams)
            if not len(at):
                continue
            order = np.argsort(hashes)
            bucket = (grams >> shift).astype(np.uint32) if buckets > 1 else np.zeros(len(grams), np.uint32)
            if buckets <= 1 << 16:
                bucket = bucket.astype(np.uint16)
            del grams
            hs, ck = hashes[order], checks[order]
            loc = at[order]
            runs = A.group_runs(hs)
            lead = np.minimum.reduceat(order, runs)  # windows ascend with (doc_id, start)
            size = np.diff(np.append(runs, len(hs)))
            whose = np.repeat(lead, size)
            # same document and start only where a doc_id is repeated: then neither is earlier
            doc = np.searchsorted(first, loc, "right") - 1
            lead_at = at[whose]
            lead_doc = np.searchsorted(first, lead_at, "right") - 1
            same = ck == checks[whose]
            level = (ids[doc] == ids[lead_doc]) & (loc - first[doc] == lead_at - first[lead_doc])
            again = same & ~level
            if again.any():
                hits = _starts_by_doc(ids[doc[again]], (loc - first[doc])[again])
                n = hits.num_rows
                empty = pa.nulls(n, pa.binary())
                spread = pa.array((A.mix(hits.column(0).to_numpy().view(np.uint64)) % np.uint64(buckets)).astype(np.int32))
                yield pa.record_batch([spread, hits.column(0), pa.nulls(n, pa.int32()), empty, empty, hits.column(1), empty, empty], schema=out)
            keep = (order == whose) | ~same
            bucket = bucket[order][keep]
            by = np.argsort(bucket, kind="stable")  # ascending hashes within each bucket
            bucket = bucket[by]
            hs, ck, loc, doc = (x[keep][by] for x in (hs, ck, loc, doc))
            present = A.group_runs(bucket)
            ends = np.append(present[1:], len(bucket))
            rows = []
            for lo, hi in zip(present.tolist(), ends.tolist(), strict=True):
                s = slice(lo, hi)
                there = np.unique(doc[s])
                planes = np.ascontiguousarray(hs[s].astype("<u8").view(np.uint8).reshape(-1, 8).T)
                places = np.ascontiguousarray(loc[s].astype("<u4").view(np.uint8).reshape(-1, 4).T)
                rows.append((int(bucket[lo]), None, hi - lo, planes.tobytes(), ck[s].tobytes(), places.tobytes(), ids[there].tobytes(), first[there].astype("<u4").tobytes()))
            for lo in range(0, len(rows), 64):
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows[lo : lo + 64], strict=True), out, strict=True)], schema=out)

    return run


def _read_run(fs, path: str) -> tuple[np.ndarray, np.ndarray]:
    with fs.open_input_file(path) as f:
        t = pa.ipc.open_file(f).read_all()
    return A.unpack_sorted(t["hashes"][0].as_py()), np.frombuffer(t["checks"][0].as_py(), np.uint16)


def _write_run(fs, path: str, hashes: np.ndarray, checks: np.ndarray) -> None:
    t = pa.table({"hashes": pa.array([A.pack_sorted(hashes)], pa.binary()), "checks": pa.array([checks.tobytes()], pa.binary())})

    def write(out):
        with pa.ipc.new_file(out, t.schema) as w:
            w.write_table(t)

    put(fs, path, write)


def _known(fs, runs: list[str], bucket: int, hashes: np.ndarray, checks: np.ndarray) -> np.ndarray:
    """Which sorted fingerprints are in a run, with the same check."""
    from pyarrow.fs import FileType

    found = np.zeros(len(hashes), bool)
    for path in (f"{r}/{bucket}.arrow" for r in runs):
        if fs.get_file_info(path).type == FileType.NotFound:
            continue
        h, c = _read_run(fs, path)
        at = np.searchsorted(h, hashes)
        while len(h):  # colliding hashes have neighbouring entries with other checks
            ok = at < len(h)
            ok[ok] = h[at[ok]] == hashes[ok]
            if not ok.any():
                break
            found[ok] |= c[at[ok]] == checks[ok]
            at = at + 1
            if not (ok & ~found).any():
                break
    return found


def _merge(root: str, runs: list[str], new: str):
    """The task of one bucket: join with the runs, verify, write the new run, give the hits."""

    def run(key, table):
        bucket = key[0].as_py()
        settled = table.filter(pa.compute.is_valid(table["doc_id"]))
        out = [pa.table({"doc_id": settled["doc_id"], "starts": settled["locs"]}, schema=_HITS)]
        rows = table.filter(pa.compute.is_null(table["doc_id"])).to_pylist()
        del table
        if rows:
            get = lambda c, kind: [np.frombuffer(r[c], kind) for r in rows]
            hashes = np.concatenate([np.ascontiguousarray(x.reshape(8, -1).T).view("<u8").ravel() for x in get("hashes", np.uint8)])
            checks = np.concatenate(get("checks", np.uint16))
            ids, pos = [], []
            for places, docs, firsts in zip(get("locs", np.uint8), get("docs", np.int64), get("firsts", "<u4"), strict=True):
                loc = np.ascontiguousarray(places.reshape(4, -1).T).view("<u4").ravel()
                d = np.searchsorted(firsts, loc, "right") - 1
                ids.append(docs[d])
                pos.append(loc - firsts[d])
            ids, pos = np.concatenate(ids), np.concatenate(pos)
            del rows
            order = np.argsort(hashes)
            hashes, checks, ids, pos = hashes[order], checks[order], ids[order], pos[order]
            begin = A.group_runs(hashes)
            size = np.diff(np.append(begin, len(hashes)))
            many = np.repeat(size > 1, size)
            at = np.flatnonzero(many)
            if len(at):  # earliest first within each fingerprint
                inner = at[np.lexsort((pos[at], ids[at], checks[at], hashes[at]))]
                checks[at], ids[at], pos[at] = checks[inner], ids[inner], pos[inner]
            lead = A.group_runs(hashes) if not len(at) else np.flatnonzero(np.concatenate(([True], (hashes[1:] != hashes[:-1]) | (checks[1:] != checks[:-1]))))
            size = np.diff(np.append(lead, len(hashes)))
            whose = np.repeat(lead, size)
            again = (ids != ids[whose]) | (pos != pos[whose])
            fs, top = file_system(root)
            old = _known(fs, [f"{top}/{r}" for r in runs], bucket, hashes[lead], checks[lead])
            hit = again | np.repeat(old, size)
            if hit.any():
                out.append(pa.Table.from_batches([_starts_by_doc(ids[hit], pos[hit])]))
            fs.create_dir(f"{top}/{new}", recursive=True)
            _write_run(fs, f"{top}/{new}/{bucket}.arrow", hashes[lead[~old]], checks[lead[~old]])
        return pa.concat_tables(out)

    return run


def _compact(root: str, runs: list[str], new: str):
    """Merges the sorted runs of each bucket into one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileType

        fs, top = file_system(root)
        fs.create_dir(f"{top}/{new}", recursive=True)
        for batch in batches:
            for b in batch.column(0).to_pylist():
                got = [_read_run(fs, p) for r in runs if fs.get_file_info(p := f"{top}/{r}/{b}.arrow").type != FileType.NotFound]
                if got:
                    h, c = np.concatenate([x[0] for x in got]), np.concatenate([x[1] for x in got])
                    order = np.argsort(h)
                    _write_run(fs, f"{top}/{new}/{b}.arrow", h[order], c[order])
            yield pa.record_batch([batch.column(0)], schema=pa.schema([("bucket", pa.int64())]))

    return run


class FingerprintIndex:
    """Sorted runs of window fingerprints in a shared folder, by hash range.

    ``add`` must see documents whose ids exceed those of all earlier calls. Runs are
    files ``<run>/<bucket>.arrow`` that are never changed once in place.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int, width: int = WIDTH, fanout: int = FANOUT, hot: np.ndarray | None = None, key: int | None = None):
        if buckets & (buckets - 1):
            raise ValueError("buckets must be a power of two")
        self.spark, self.root, self.buckets, self.width, self.fanout = spark, root, buckets, width, fanout
        self.key = secrets.randbits(62) if key is None else key
        self.hot = np.empty(0, np.uint64) if hot is None else hot
        self.runs: list[str] = []
        self.made = 0

    def _name(self) -> str:
        self.made += 1
        return f"run{self.made:05d}"

    def add(self, docs: DataFrame, hits_path: str) -> DataFrame:
        """Rows (doc_id, starts): starts of windows seen before, as packed little-endian uint32."""
        new = self._name()
        sent = docs.select("doc_id", "text").mapInArrow(_send(self.width, self.buckets, self.key, self.hot), _SENT)
        hits = sent.groupBy("bucket").applyInArrow(_merge(self.root, list(self.runs), new), "doc_id long, starts binary")
        out = save(hits, hits_path)
        self.runs.append(new)
        del sent, hits
        release()
        return out

    def compact(self) -> None:
        """Once ``fanout`` runs have gathered, merges them; the old files go after the new are whole."""
        if len(self.runs) < self.fanout:
            return
        new, old = self._name(), self.runs
        self.spark.range(0, self.buckets, 1, min(self.buckets, max(8, self.spark.sparkContext.defaultParallelism))).mapInArrow(_compact(self.root, list(old), new), "bucket long").write.format("noop").mode("overwrite").save()
        self.runs = [new]
        for r in old:
            remove(self.spark, f"{self.root}/{r}")


def _cover(data: list[bytes] | None, n: int, width: int) -> np.ndarray:
    """Which of n words a repeated window covers."""
    edge = np.zeros(n + 1, np.int32)
    for x in data or ():
        s = np.frombuffer(x, "<u4").astype(np.int64)
        s = s[s + width <= n]
        np.add.at(edge, s, 1)
        np.add.at(edge, s + width, -1)
    return np.cumsum(edge[:n]) > 0


def _rewrite(width: int, starts: str, whole: bool):
    """Removes covered words. whole: the rows go on with new text; else only digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = batch.column(batch.schema.get_field_index(starts))
            texts = batch.column(batch.schema.get_field_index("text"))
            n_words, n_removed, out = [], [], []
            for k in range(batch.num_rows):
                t = texts[k]
                words = t.as_py().encode().split() if t.is_valid else []
                found = hits[k].as_py() if hits[k].is_valid else None
                cut = 0
                if found:
                    gone = _cover(found, len(words), width)
                    cut = int(gone.sum())
                    kept = b" ".join(words[i] for i in np.flatnonzero(~gone)) if cut else None
                if not whole:
                    out.append(hashlib.sha256(kept if cut else b" ".join(words)).hexdigest())
                else:
                    out.append(kept.decode() if cut else t.as_py())
                n_words.append(len(words))
                n_removed.append(cut)
            if whole:
                cols = {c: batch.column(batch.schema.get_field_index(c)) for c in batch.schema.names if c != starts}
                cols["text"] = pa.array(out, pa.string())
                if "n_chars" in cols:
                    sizes = [None if o is None else len(o) for o in out]
                    cols["n_chars"] = pa.array([s if r else o for s, o, r in zip(sizes, cols["n_chars"].to_pylist(), n_removed, strict=True)], cols["n_chars"].type)
                yield pa.record_batch(list(cols.values()), names=list(cols))
            else:
                yield pa.record_batch([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(out, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return run


def _plan(docs: DataFrame, batches: int | None, bucket_windows: int) -> tuple[list, int]:
    """Ascending cut points of doc_id for the batches, and the number of buckets."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    batches = batches or max(BATCHES, -(-size // BATCH_BYTES))
    cuts = []
    if batches > 1:
        shares = ", ".join(str((k + 1) / batches) for k in range(batches - 1))
        cuts = sorted(set(docs.agg(F.expr(f"percentile_approx(doc_id, array({shares}), 1000)")).first()[0] or []))
    buckets = 1
    while buckets * bucket_windows < size / 6:
        buckets *= 2
    return cuts, max(LEAST_BUCKETS, buckets)


def frequent_anchors(docs: DataFrame, width: int, key: int, least: int) -> np.ndarray:
    """8-grams that by the sampled documents are the anchor of over ``least`` windows.

    They only spread load, so a sample will do; their number is at most that of all
    windows over ``least``.
    """
    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(HOT_SAMPLE)) == 0).mapInArrow(_frequent(width, key), "anchor long, n long")
    rows = some.groupBy("anchor").agg(F.sum("n").alias("n")).where(F.col("n") * HOT_SAMPLE > least).select("anchor").collect()
    return np.array(sorted(r.anchor for r in rows), np.int64).view(np.uint64)


def find_repeats(docs: DataFrame, width: int = WIDTH, batches: int | None = None, fanout: int = FANOUT, bucket_windows: int = BUCKET_WINDOWS) -> DataFrame:
    """Rows (doc_id, starts) of all windows that also start earlier, by incremental batches."""
    spark, key = docs.sparkSession, secrets.randbits(62)
    root = shared_dir(spark, "fingerprints")
    docs = bounded(docs).select("doc_id", "text")
    cuts, buckets = _plan(docs, batches, bucket_windows)
    index = FingerprintIndex(spark, f"{root}/index", buckets, width, fanout, frequent_anchors(docs, width, key, bucket_windows // 4), key)
    edges = [None, *cuts, None]
    out = None
    for k in range(len(edges) - 1):
        lo, hi = edges[k], edges[k + 1]
        part = docs
        if hi is not None:
            part = part.where((F.col("doc_id") <= hi) | F.lit(lo is None) & F.col("doc_id").isNull())
        if lo is not None:
            part = part.where(F.col("doc_id") > lo)
        hits = index.add(part, f"{root}/hits{k}")
        out = hits if out is None else out.unionByName(hits)
        index.compact()
    remove(spark, f"{root}/index")
    release()
    return out


def _with_hits(docs: DataFrame, hits: DataFrame) -> tuple[DataFrame, str]:
    """The rows with their packed starts, and the name of that column."""
    key, name = fresh(docs, "id"), fresh(docs, "starts")
    # an absent doc_id travels as the smallest id
    by_doc = hits.groupBy(F.col("doc_id").alias(key)).agg(F.collect_list("starts").alias(name))
    return docs.withColumn(key, F.coalesce(F.col("doc_id"), F.lit(_NO_ID))).join(by_doc, key, "left").drop(key), name


def dedup_digest(docs: DataFrame, width: int = WIDTH, batches: int | None = None) -> DataFrame:
    """Per row: doc_id, n_words, n_removed and the SHA-256 of the kept words.

    Null or empty text: no words, digest of the empty string. Null doc_id counts as the
    smallest id. Rows with one doc_id are one document: equal windows at equal starts of
    its rows are not earlier than each other. Extra columns are ignored.
    """
    docs = docs.select("doc_id", "text")
    rows, starts = _with_hits(docs, find_repeats(docs, width, batches))
    return rows.mapInArrow(_rewrite(width, starts, False), "doc_id long, n_words long, n_removed long, kept_sha256 string")


def dedup(docs: DataFrame, width: int = WIDTH, batches: int | None = None) -> DataFrame:
    """The documents with repeated windows cut out of ``text`` (words joined by one space) and ``n_chars`` renewed.

    Documents without a repeat keep their text byte for byte; one of which nothing is
    left stays with an empty text. Nulls and repeated ids as in :func:`dedup_digest`.
    """
    rows, starts = _with_hits(docs, find_repeats(docs, width, batches))
    return rows.select(*docs.columns, starts).mapInArrow(_rewrite(width, starts, True), docs.schema)
