"""Token ids as Arrow IPC files of equal-length sequences.

Each range of ascending ``doc_id`` becomes one shard: an Arrow file whose record
batches hold fixed-size lists (ids and packed mask bits), so that sequence ``i`` is
a view into the mapped file at a computable place, and a second Arrow file with the
place of each document. Ids take 16 bits where the vocabulary allows.

Where the tokenizer is of the kind ``_PIPELINE`` tells, a text is encoded word by word:
it drops white space and never joins across it, so each distinct word is encoded once per worker. Words of ASCII and
Latin-1 letters are one pre-token: their case is folded as the tokenizer's own
normaliser does, closing punctuation is split off, and the library's model gets them
directly. All other words go through the whole library pipeline unchanged. With any
other tokenizer the library encodes whole texts.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import arrays as A
from .store import bounded, file_system, put, shared_dir
from .wordcache import WordCache

END_ID = 1
LENGTH = 2048
ROWS_PER_BATCH = 256

_ALPHA = np.zeros(256, bool)
_ALPHA[[*range(65, 91), *range(97, 123)]] = True
_LEAD = 0xC3  # first byte of the Latin-1 letters; 0x97 and 0xB7 after it are signs
_TRAIL = np.zeros(256, bool)
_TRAIL[0x80:0xC0] = True
_TRAIL[[0x97, 0xB7]] = False
_CLOSING = np.zeros(256, bool)
_CLOSING[[ord(c) for c in ".,!?;:"]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER_TRAIL = np.arange(256, dtype=np.uint8)
_LOWER_TRAIL[0x80:0x9F] += 32
#: Normaliser and pre-tokeniser, as the library states them, that work within words.
_PIPELINE = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
)
_PLAIN = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+")


def _pieces(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buffer with folded words, piece starts and ends, and first piece of each document."""
    starts, ends, first = A.find_words(buf, off)
    if not len(starts):
        return buf, starts, ends, first
    body = ends.copy()
    for _ in range(3):
        can = (body > starts + 1) & _CLOSING[buf[body - 1]]
        body = body - can
    lead = buf == _LEAD
    after = np.zeros(len(buf), bool)
    after[1:] = lead[:-1]
    letters = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(_ALPHA[buf] | lead | after & _TRAIL[buf], out=letters[1:])
    plain = letters[body] - letters[starts] == body - starts
    body = np.where(plain, body, ends)
    edge = np.zeros(len(buf) + 1, np.int8)
    edge[starts[plain]] += 1
    edge[body[plain]] -= 1
    folded = np.where(np.cumsum(edge[:-1], dtype=np.int8) > 0, np.where(after, _LOWER_TRAIL[buf], _LOWER[buf]), buf)
    two = body < ends
    at = np.arange(len(starts)) + np.cumsum(two) - two
    n = len(starts) + int(two.sum())
    s, e = np.empty(n, np.int64), np.empty(n, np.int64)
    s[at], e[at] = starts, body
    s[at[two] + 1], e[at[two] + 1] = body[two], ends[two]
    return folded, s, e, np.append(at, n)[first]


class Encoder:
    """Ids of whole texts, by distinct pieces."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        stated = json.loads(self.tokenizer.to_str())
        self.by_word = (stated["normalizer"], stated["pre_tokenizer"]) == _PIPELINE and stated["model"]["type"] == "BPE" and not any(c.isspace() for t in stated["added_tokens"] for c in t["content"])
        self.dtype = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.cache = WordCache(self._make, self.dtype)
        from tokenizers.pre_tokenizers import ByteLevel

        level = ByteLevel(add_prefix_space=False, use_regex=False)
        #: Latin-1 letters as the byte-level model spells them.
        self.spelt = {c: level.pre_tokenize_str(chr(c))[0][0] for c in range(0xC0, 0x100)}

    def _make(self, words: list[bytes]) -> list:
        out: list = [None] * len(words)
        rest, tokenize = [], self.tokenizer.model.tokenize
        for k, w in enumerate(words):
            t = w.decode()
            if _PLAIN.fullmatch(t):
                out[k] = [x.id for x in tokenize(t if t.isascii() else t.translate(self.spelt))]
            else:
                rest.append(k)
        for k, x in zip(rest, self.tokenizer.encode_batch_fast([words[k].decode() for k in rest], add_special_tokens=False), strict=True):
            out[k] = x.ids
        return out

    def encode(self, buf: np.ndarray, off: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents one after another, each closed by ``end_id``, and their counts."""
        if not self.by_word:
            raw = buf.tobytes()
            got = self.tokenizer.encode_batch_fast([raw[a:b].decode() for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)], add_special_tokens=False)
            return np.concatenate([np.array([*x.ids, end_id], self.dtype) for x in got]), np.array([len(x.ids) + 1 for x in got], np.int64)
        folded, s, e, first = _pieces(buf, off)
        docs = len(off) - 1
        if not len(s):
            return np.full(docs, end_id, self.dtype), np.ones(docs, np.int64)
        ids, n = self.cache.gather(self.cache.rows(folded, s, e))
        total = np.zeros(len(n) + 1, np.int64)
        np.cumsum(n, out=total[1:])
        ends = total[first[1:]]
        return np.insert(ids, ends, end_id), np.diff(ends, prepend=0) + 1


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _schema(dtype, length: int, end_id: int) -> pa.Schema:
    kind = pa.uint16() if dtype == np.uint16 else pa.uint32()
    return pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.uint8(), length // 8))], metadata={"length": str(length), "end_id": str(end_id), "rows_per_batch": str(ROWS_PER_BATCH)})


_INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


class _Sequences:
    """Cuts a stream of ids into equal sequences and writes full batches."""

    def __init__(self, writer, schema: pa.Schema, dtype, length: int):
        self.writer, self.schema, self.length = writer, schema, length
        self.held, self.room = np.zeros(length * ROWS_PER_BATCH, dtype), length * ROWS_PER_BATCH
        self.used = 0

    def add(self, ids: np.ndarray) -> None:
        while len(ids):
            n = min(len(ids), self.room - self.used)
            self.held[self.used : self.used + n] = ids[:n]
            self.used += n
            ids = ids[n:]
            if self.used == self.room:
                self.flush()

    def flush(self) -> None:
        if not self.used:
            return
        rows = -(-self.used // self.length)
        n = rows * self.length
        self.held[self.used : n] = 0
        mask = np.packbits(np.arange(n) < self.used, bitorder="little")
        cols = [pa.FixedSizeListArray.from_arrays(pa.array(self.held[:n]), self.length), pa.FixedSizeListArray.from_arrays(pa.array(mask), self.length // 8)]
        self.writer.write_batch(pa.record_batch(cols, schema=self.schema))
        self.used = 0


def _write(root: str, path: str, end_id: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, enc = TaskContext.get().partitionId(), encoder(path)
        fs, top = file_system(root)
        fs.create_dir(top, recursive=True)
        schema, done, index = _schema(enc.dtype, length, end_id), [0], []

        def data(out):
            with pa.ipc.new_file(out, schema) as w:
                to = _Sequences(w, schema, enc.dtype, length)
                for piece, buf, off in A.blocks(batches, "text", 2 << 20):
                    ids, n = enc.encode(buf, off, end_id)
                    to.add(ids)
                    at = done[0] + np.cumsum(n) - n
                    index.append(pa.record_batch([piece.column(0), pa.array(at), pa.array(n)], schema=_INDEX))
                    done[0] += int(n.sum())
                to.flush()

        def places(out):
            with pa.ipc.new_file(out, _INDEX) as w:
                for b in index:
                    w.write_batch(b)

        put(fs, f"{top}/{shard:08d}.arrow", data)
        put(fs, f"{top}/{shard:08d}.index.arrow", places)
        yield pa.record_batch([pa.array([shard], pa.int64()), pa.array([done[0]], pa.int64())], names=["shard", "n_tokens"])

    return run


def write_tokens(docs: DataFrame, tokenizer_path: str, root: str, end_id: int = END_ID, length: int = LENGTH) -> list[tuple[int, int, int]]:
    """Writes shards in ascending doc_id order; gives (shard, first token, tokens) of each.

    Null text is empty: its ids are the end id alone. A null doc_id comes first. Rows of
    one doc_id are ordered by text. No documents: no shard has a token. Extra columns
    are ignored. ``length`` must be a multiple of 8.
    """
    if length % 8:
        raise ValueError("length must be a multiple of 8")
    rows = bounded(docs).select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    got = sorted(tuple(r) for r in rows.mapInArrow(_write(root, tokenizer_path, end_id, length), "shard long, n_tokens long").collect())
    out, start = [], 0
    for shard, n in got:
        out.append((shard, start, n))
        start += n
    return out


class TokenFile:
    """Random access to one shard. On a local path the sequences are views of the mapped file."""

    def __init__(self, root: str, shard: int):
        from pyarrow.fs import LocalFileSystem

        fs, top = file_system(root)
        open_ = pa.memory_map if isinstance(fs, LocalFileSystem) else fs.open_input_file
        self.reader = pa.ipc.open_file(open_(f"{top}/{shard:08d}.arrow"))
        self.index = pa.ipc.open_file(open_(f"{top}/{shard:08d}.index.arrow"))
        meta = self.reader.schema.metadata
        self.length, self.per_batch = int(meta[b"length"]), int(meta[b"rows_per_batch"])

    def ids(self, batch: int) -> np.ndarray:
        column = self.reader.get_batch(batch).column(0)
        return column.flatten().to_numpy(zero_copy_only=True)

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask bits (little-endian, packed) of sequence ``i``, without a copy."""
        b, k = divmod(i, self.per_batch)
        batch, n = self.reader.get_batch(b), self.length
        ids, mask = (batch.column(c).flatten().to_numpy(zero_copy_only=True) for c in (0, 1))
        return ids[k * n : (k + 1) * n], mask[k * n // 8 : (k + 1) * n // 8]

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """doc_id, start in the shard and ids of each document, in order."""
        step = self.length * self.per_batch
        at, held = -1, None
        for b in range(self.index.num_record_batches):
            t = self.index.get_batch(b)
            for doc, start, n in zip(*(t.column(c).to_pylist() for c in range(3)), strict=True):
                parts, p, end = [], start, start + n
                while p < end:
                    if at != p // step:
                        at = p // step
                        held = self.ids(at)
                    q = min(end, (at + 1) * step)
                    parts.append(held[p - at * step : q - at * step])
                    p = q
                yield doc, start, parts[0] if len(parts) == 1 else np.concatenate(parts)


def _digest(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, base in zip(*(batch.column(c).to_pylist() for c in (0, 1)), strict=True):
                out = []
                for doc, start, ids in TokenFile(root, shard).documents():
                    out.append((doc, base + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    if len(out) == 20_000:
                        yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                        out = []
                if out:
                    yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def read_digest(spark: SparkSession, root: str, shards: list[tuple[int, int, int]]) -> DataFrame:
    """Per document, read back from the files: global start, count and CRC-32 of its ids as uint32."""
    rows = [(s, base) for s, base, _ in shards]
    if not rows:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    listed = spark.createDataFrame(rows, "shard long, base long").repartition(len(rows))
    return listed.mapInArrow(_digest(root), "doc_id long, start long, n_tokens long, ids_crc32 long")


def encode_digest(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, root: str | None = None) -> DataFrame:
    """Writes the files below ``root`` (default: a new shared folder) and reads them back."""
    spark = docs.sparkSession
    root = root or shared_dir(spark, "tokens")
    return read_digest(spark, root, write_tokens(docs, tokenizer_path, root, end_id))


