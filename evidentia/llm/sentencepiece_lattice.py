"""Sampled SentencePiece segmentation by forward filtering and backward sampling.

All segmentations of a text into pieces form a lattice. Going forward, each place gets
the total weight of the ways to reach it; going backward from the end, each step draws
the last piece in proportion to the weight that it carries. Draws are hashes of row
key, unit and step, compared with whole numbers: a row gets the same segmentation
wherever and whenever it runs.

No piece of the vocabulary spans the start of a space run or a line end, so the lattice
falls apart into units there; a long unit also falls apart at each place that no piece
in it crosses. Each distinct unit is filtered once by a Python worker and its draws'
probabilities are kept. Work is on UTF-8 bytes with the space as SentencePiece's mark;
characters without a piece of their own become byte pieces, the mark's own character
too, so decoding is lossless.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import arrays as A
from .store import bounded, fresh
from .wordcache import WordIndex

#: Weight of a piece is (rank + OFFSET) ** -SHARPNESS, by rank in the vocabulary: a merge model's scores are ranks.
OFFSET = 10.0
SHARPNESS = 1.0
#: Units over so many bytes are cut where no piece crosses.
LONG_UNIT = 48
#: Units over so many bytes that nothing cuts (one letter repeated) are filtered place by place, not side by side.
HUGE_UNIT = 1024
#: Nodes of the units that a worker keeps; beyond, it starts anew.
LIMIT_NODES = 1_500_000
_MARK = "▁"
_ONE = 1 << 32
_SLOT_BITS = 19
_STEP = 0x9E3779B97F4A7C15


class Pieces:
    """Piece bytes and weights of a model file, and a trie over the bytes."""

    def __init__(self, path: str):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = m.get_piece_size()
        self.bytes: list[bytes] = [b""] * self.size
        self.byte_id = np.full(256, m.unk_id(), np.int64)
        weight, known = np.full(self.size, -np.inf), []
        for i in range(self.size):
            if m.is_byte(i):
                code = int(m.id_to_piece(i)[3:5], 16)
                self.bytes[i], self.byte_id[code] = bytes([code]), i
                weight[i] = 0.0
            elif not (m.is_control(i) or m.is_unknown(i) or m.is_unused(i)):
                text = m.id_to_piece(i).replace(_MARK, " ")
                inner = text.lstrip(" ")
                if "\n" in text or " " in inner or not text:
                    continue  # would cross the places where units part
                self.bytes[i] = text.encode()
                weight[i] = -SHARPNESS * np.log(i + OFFSET)
                known.append(i)
        self.weight = weight
        self.longest = max(len(self.bytes[i]) for i in known)
        self.by_text = {self.bytes[i]: i for i in reversed(known)}
        self._grow_trie()
        self.off = np.zeros(self.size + 1, np.int64)
        np.cumsum([len(b) for b in self.bytes], out=self.off[1:])
        self.data = np.frombuffer(b"".join(self.bytes), np.uint8)

    def _grow_trie(self) -> None:
        child, piece = {}, [-1]
        for text, i in self.by_text.items():
            at = 0
            for c in text:
                nxt = child.setdefault(at << 8 | c, len(piece))
                if nxt == len(piece):
                    piece.append(-1)
                at = nxt
            piece[at] = i
        self.keys = np.array(sorted(child), np.int64)
        self.child = np.array([child[k] for k in self.keys.tolist()], np.int64)
        self.piece = np.array(piece, np.int64)
        # most steps are found in a table by hash; a key whose slot another one took, in the sorted keys
        self.slot_key, self.slot_child = np.full(1 << _SLOT_BITS, -1, np.int64), np.zeros(1 << _SLOT_BITS, np.int64)
        slot = self._slot(self.keys)
        self.slot_key[slot], self.slot_child[slot] = self.keys, self.child
        self.shared = np.zeros(1 << _SLOT_BITS, bool)
        self.shared[slot[self.slot_key[slot] != self.keys]] = True

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(_STEP) >> np.uint64(64 - _SLOT_BITS)).view(np.int64)

    def _step(self, keys: np.ndarray) -> np.ndarray:
        """The trie node at the end of each step (node << 8 | byte), or -1."""
        slot = self._slot(keys)
        out = np.where(self.slot_key[slot] == keys, self.slot_child[slot], -1)
        other = np.flatnonzero((out < 0) & self.shared[slot])
        if len(other):
            p = np.minimum(np.searchsorted(self.keys, keys[other]), len(self.keys) - 1)
            ok = self.keys[p] == keys[other]
            out[other[ok]] = self.child[p[ok]]
        return out

    def matches(self, text: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places, lengths and ids of all pieces, longer ones first; ``left`` is how many bytes each place has to its unit's end."""
        at = np.flatnonzero((text & 0xC0) != 0x80)
        node, out = np.zeros(len(at), np.int64), []
        for size in range(1, self.longest + 1):
            ok = left[at] >= size
            at, node = at[ok], node[ok]
            if not len(at):
                break
            node = self._step(node << 8 | text[at + size - 1])
            ok = node >= 0
            at, node = at[ok], node[ok]
            ids = self.piece[node]
            hit = ids >= 0
            out.append((at[hit].astype(np.int32), np.full(int(hit.sum()), size, np.int32), ids[hit].astype(np.int32)))
        return tuple(np.concatenate(c[::-1]) for c in zip(*out, strict=True)) if out else (np.empty(0, np.int32),) * 3


_loaded: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


def _widths(lead: np.ndarray) -> np.ndarray:
    """Bytes of the UTF-8 character with each first byte."""
    return np.where(lead < 0x80, 1, np.where(lead < 0xE0, 2, np.where(lead < 0xF0, 3, 4)))


class _Filled:
    """An array that doubles as it fills."""

    def __init__(self, dtype):
        self.data, self.size = np.empty(1 << 16, dtype), 0

    def add(self, values: np.ndarray) -> None:
        while len(self.data) < self.size + len(values):
            self.data = np.concatenate((self.data, np.empty_like(self.data)))
        self.data[self.size : self.size + len(values)] = values
        self.size += len(values)


class Lattices:
    """Lattices of distinct units, laid one after another as they come.

    A unit of n bytes has n + 1 nodes; ``begin`` and ``end`` are its outer ones. The
    edges into a node stand together from ``low`` on; ``last`` is the greatest 32-bit
    draw that takes an edge.
    """

    def __init__(self, vocabulary: Pieces):
        self.vocabulary = vocabulary
        self.clear()

    def clear(self) -> None:
        self.index = WordIndex()
        self.begin, self.end, self.low = (_Filled(np.int64) for _ in range(3))
        self.source, self.piece, self.last = _Filled(np.int32), _Filled(np.int32), _Filled(np.int64)

    def rows(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Number of each unit; new ones are filtered."""
        if self.low.size > LIMIT_NODES:
            self.clear()
        before = len(self.index)
        out = self.index.rows(buf, starts, ends)
        if len(self.index) > before:
            self._add(*self.index.spans(before))
        return out

    def _add(self, text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        n, v = ends - starts, self.vocabulary
        begin = np.cumsum(n + 1) - (n + 1)
        total, most = int((n + 1).sum()), int(n.max())
        unit = np.repeat(np.arange(len(n)), n)
        place = (np.arange(len(text)) - starts[unit]).astype(np.int32)
        node, left = (begin[unit] + place).astype(np.int32), (n[unit] - place).astype(np.int32)
        where, length, piece = v.matches(text, left)
        inner = (text & 0xC0) == 0x80  # not at a character's start
        lone = np.zeros(len(text), bool)
        lone[where[_widths(text[where]) == length]] = True
        # byte pieces for each character that is no piece itself
        first = np.maximum.accumulate(np.where(inner, 0, np.arange(len(text))))
        raw = np.flatnonzero(~lone[first]).astype(np.int32)
        where = np.concatenate((where, raw))
        length = np.concatenate((length, np.ones(len(raw), np.int32)))
        piece = np.concatenate((piece, v.byte_id[text[raw]].astype(np.int32)))
        # by the node an edge enters, longer pieces first
        order = np.argsort(node[where] + length, kind="stable")
        where, length, piece = where[order], length[order], piece[order]
        source = node[where]
        target, depth = source + length, place[where] + length
        reach = np.full(total, -np.inf)
        reach[begin] = 0.0
        share, score = np.empty(len(target)), v.weight[piece]
        level = np.argsort(depth.astype(np.uint16), kind="stable")
        cuts = np.searchsorted(depth[level], np.arange(1, most + 2))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            at = level[a:b]
            to = target[at]
            w = reach[source[at]] + score[at]
            runs = A.group_runs(to)
            size = np.diff(np.append(runs, b - a))
            top = np.maximum.reduceat(w, runs)
            value = top + np.log(np.add.reduceat(np.exp(w - np.repeat(top, size)), runs))
            reach[to[runs]] = value
            share[at] = np.exp(w - np.repeat(value, size))
        runs = A.group_runs(target)
        size = np.diff(np.append(runs, len(target)))
        part = np.minimum(share * _ONE, _ONE).astype(np.int64)
        upto = np.cumsum(part)
        last = np.minimum(upto - np.repeat(upto[runs] - part[runs], size), _ONE) - 1
        last[runs + size - 1] = _ONE - 1
        low = np.zeros(total, np.int64)
        low[target[runs]] = self.source.size + runs
        nodes = self.low.size
        self.begin.add(begin + nodes)
        self.end.add(begin + n + nodes)
        self.low.add(low)
        self.source.add(source + nodes)
        self.piece.add(piece)
        self.last.add(last)

    def sample(self, units: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of all occurrences one after another, and their counts; ``keys`` seed each occurrence."""
        low, last, source, piece = self.low.data, self.last.data, self.source.data, self.piece.data
        node, begin = self.end.data[units], self.begin.data[units]
        count, active, step, drawn = np.zeros(len(units), np.int64), np.arange(len(units)), 0, []
        while len(active):
            e, u = low[node], draws(keys, step)
            far = np.flatnonzero(u > last[e])
            while len(far):
                e[far] += 1
                far = far[u[far] > last[e[far]]]
            drawn.append((active, piece[e]))
            node = source[e]
            count[active] += 1
            go = np.flatnonzero(node > begin)
            active, node, begin, keys = active[go], node[go], begin[go], keys[go]
            step += 1
        ends = np.cumsum(count)
        out = np.empty(int(ends[-1]) if len(ends) else 0, np.int32)
        for step, (who, ids) in enumerate(drawn):
            out[ends[who] - 1 - step] = ids
        return out, count


def draws(keys: np.ndarray, step: int) -> np.ndarray:
    """Whole numbers below 2**32 from seeds and a step."""
    return (A.mix(keys + np.uint64((step + 1) * _STEP % (1 << 64))) >> np.uint64(32)).astype(np.int64)


def sample_one(vocabulary: Pieces, unit: bytes, key: int) -> list[int]:
    """The draw for one unit of any length, place by place."""
    n, text = len(unit), np.frombuffer(unit, np.uint8)
    into: list[list] = [[] for _ in range(n + 1)]
    where, length, ids = vocabulary.matches(text, np.arange(n, 0, -1))
    lone = np.zeros(n, bool)
    lone[where[_widths(text[where]) == length]] = True
    for a, size, i, x in zip(where.tolist(), length.tolist(), ids.tolist(), vocabulary.weight[ids].tolist(), strict=True):
        into[a + size].append((a, i, x))
    first = np.maximum.accumulate(np.where((text & 0xC0) == 0x80, 0, np.arange(n)))
    for a in np.flatnonzero(~lone[first]).tolist():
        into[a + 1].append((a, int(vocabulary.byte_id[unit[a]]), 0.0))
    reach, exp, log = [0.0] * (n + 1), math.exp, math.log
    for at in range(1, n + 1):
        w = [reach[a] + x for a, _, x in into[at]]
        top = max(w, default=-math.inf)
        if top == -math.inf:  # inside a character that is a piece
            reach[at] = top
            continue
        reach[at] = top + log(sum([exp(x - top) for x in w]))
    steps = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_STEP)
    out, at, u = [], n, (A.mix(np.uint64(key) + steps) >> np.uint64(32)).tolist()
    while at:
        got, mine = 0, u[len(out)]
        for a, i, x in into[at]:
            got += int(min(exp(reach[a] + x - reach[at]), 1.0) * _ONE)
            if mine < got:
                break
        out.append(i)
        at = a
    return out[::-1]


def _units(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of units, and the first unit of each document."""
    n = len(buf)
    begins = np.zeros(n, bool)
    space, line = buf == 32, buf == 10
    begins[1:] = space[1:] & ~space[:-1] | line[1:] | line[:-1]
    begins[off[:-1][off[:-1] < n]] = True
    starts = np.flatnonzero(begins)
    return starts, np.append(starts[1:], n) if len(starts) else starts, np.searchsorted(starts, off)


def _cut(vocabulary: Pieces, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Places in the units, ascending and their starts among them, that no piece crosses: every segmentation stops there."""
    n = ends - starts
    first = np.cumsum(n) - n
    unit = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(unit)) - first[unit]
    text = buf[starts[unit] + place]
    where, length, _ = vocabulary.matches(text, n[unit] - place)
    over = np.zeros(len(text) + 1, np.int64)
    np.add.at(over, where + 1, 1)
    np.add.at(over, where + length, -1)
    free = (np.cumsum(over[:-1]) == 0) & ((text & 0xC0) != 0x80)
    free[first] = True
    at = np.flatnonzero(free)
    return starts[unit[at]] + place[at]


def encode_block(vocabulary: Pieces, buf: np.ndarray, off: np.ndarray, row_keys: np.ndarray, lattices: Lattices | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all documents one after another, and their counts. Empty texts have no pieces."""
    size = np.diff(off)
    full = np.flatnonzero(size)
    if not len(full):
        return np.empty(0, np.int32), np.zeros(len(size), np.int64)
    lattices = lattices or Lattices(vocabulary)
    marked = np.insert(buf, off[:-1][full], 32)  # the mark before each text
    edges = off + np.searchsorted(full, np.arange(len(off)))
    starts, ends, first = _units(marked, edges)
    long = np.flatnonzero(ends - starts > LONG_UNIT)
    if len(long):
        inner = _cut(vocabulary, marked, starts[long], ends[long])
        starts = np.union1d(starts, inner)
        ends, first = np.append(starts[1:], len(marked)), np.searchsorted(starts, edges)
    doc = np.repeat(np.arange(len(size)), np.diff(first))
    keys = A.mix(row_keys[doc] + (np.arange(len(doc)) - first[doc]).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
    huge = np.flatnonzero(ends - starts > HUGE_UNIT)
    rest = np.flatnonzero(ends - starts <= HUGE_UNIT)
    ids, n = lattices.sample(lattices.rows(marked, starts[rest], ends[rest]), keys[rest])
    counts = np.zeros(len(starts), np.int64)
    counts[rest] = n
    parts = []
    for k in huge:
        parts.append(sample_one(vocabulary, marked[starts[k] : ends[k]].tobytes(), int(keys[k])))
        counts[k] = len(parts[-1])
    total = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=total[1:])
    if len(huge):
        out = np.empty(int(total[-1]), np.int32)
        mine = np.repeat(ends - starts <= HUGE_UNIT, counts)
        out[mine] = ids
        for k, x in zip(huge, parts, strict=True):
            out[total[k] : total[k + 1]] = x
        ids = out
    return ids, total[first[1:]] - total[first[:-1]]


def decode_block(vocabulary: Pieces, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after another and their offsets."""
    n = vocabulary.off[ids + 1] - vocabulary.off[ids]
    total = np.zeros(len(ids) + 1, np.int64)
    np.cumsum(n, out=total[1:])
    data = vocabulary.data[np.repeat(vocabulary.off[ids] - total[:-1], n) + np.arange(total[-1])]
    ends = np.cumsum(counts)
    begin = total[ends - counts]
    data = np.delete(data, begin[counts > 0])  # the mark
    size = total[ends] - begin - (counts > 0)
    return data, np.concatenate(([0], np.cumsum(size)))


def _ids(lattices: Lattices, piece: pa.RecordBatch, buf: np.ndarray, off: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    key = piece.column(piece.schema.get_field_index("doc_id")).cast(pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False)
    rows = A.mix(key.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
    return encode_block(lattices.vocabulary, buf, off, rows, lattices)


def _unless(nulls: pa.Array, values: pa.Array) -> pa.Array:
    return pa.compute.if_else(nulls, pa.nulls(len(nulls), values.type), values) if nulls.true_count else values


def _lists(ids: np.ndarray, n: np.ndarray, nulls: pa.Array) -> pa.Array:
    return _unless(nulls, pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32()), pa.array(ids, pa.int32())))


def _texts(data: np.ndarray, off: np.ndarray, nulls: pa.Array) -> pa.Array:
    raw = pa.Array.from_buffers(pa.large_string(), len(off) - 1, [None, pa.py_buffer(off.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
    return _unless(nulls, raw.cast(pa.string()))


def _encode(path: str, seed: int, names: list[str]):
    """Adds the ids under ``names[0]``; under ``names[1]``, if given, the text decoded from them in the same pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = pieces(path)
        lattices = Lattices(vocabulary)
        for piece, buf, off in A.blocks(batches, "text"):
            ids, n = _ids(lattices, piece, buf, off, seed)
            nulls = piece.column(piece.schema.get_field_index("text")).is_null()
            more = [_texts(*decode_block(vocabulary, ids, n), nulls)] if len(names) > 1 else []
            yield pa.record_batch([*piece.columns, _lists(ids, n, nulls), *more], names=[*piece.schema.names, *names])

    return run


def _schema(rows: DataFrame, more: str):
    from pyspark.sql.types import StructType, _parse_datatype_string

    return StructType([*rows.schema.fields, *_parse_datatype_string(more).fields])


def _named(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    """Columns ``names`` under their new names, in place of columns that have these."""
    return rows.drop(*names.values()).withColumnsRenamed(names)


def encode(docs: DataFrame, model_path: str, column: str = "ids", seed: int = 0) -> DataFrame:
    """All columns and ``column``, the sampled piece ids of ``text`` as an array of int.

    The row key is doc_id (null: -1); repeated rows get the same ids. Null text gives null,
    empty text an empty array; a text of any length is one row. A column already called
    ``column`` is replaced, every other one goes through.
    """
    new = fresh(docs, "ids")
    return _named(bounded(docs).mapInArrow(_encode(model_path, seed, [new]), _schema(docs, f"{new} array<int>")), {new: column})


def recode(docs: DataFrame, model_path: str, column: str = "ids", text: str = "decoded", seed: int = 0) -> DataFrame:
    """As :func:`encode` and then :func:`decode`, in one pass."""
    new, back = fresh(docs, "ids"), fresh(docs, "text")
    rows = bounded(docs).mapInArrow(_encode(model_path, seed, [new, back]), _schema(docs, f"{new} array<int>, {back} string"))
    return _named(rows, {new: column, back: text})


def _decode(path: str, column: str, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = pieces(path)
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                batch = whole.slice(lo, 256)
                lists = batch.column(batch.schema.get_field_index(column))
                n = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                text = _texts(*decode_block(vocabulary, lists.flatten().to_numpy(zero_copy_only=False), n), lists.is_null())
                yield pa.record_batch([*batch.columns, text], names=[*batch.schema.names, name])

    return run


def decode(rows: DataFrame, model_path: str, column: str = "ids", text: str = "decoded") -> DataFrame:
    """All columns and ``text``, the text that the ids stand for. Null ids give null."""
    back = fresh(rows, "text")
    return _named(bounded(rows).mapInArrow(_decode(model_path, column, back), _schema(rows, f"{back} string")), {back: text})


def _digest(path: str, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = pieces(path)
        lattices = Lattices(vocabulary)
        for piece, buf, off in A.blocks(batches, "text"):
            ids, n = _ids(lattices, piece, buf, off, seed)
            data, edges = decode_block(vocabulary, ids, n)
            wide, ends = ids.astype("<u4"), np.cumsum(n)
            crc = [zlib.crc32(wide[e - k : e].tobytes()) for e, k in zip(ends.tolist(), n.tolist(), strict=True)]
            got, was = data.tobytes(), buf.tobytes()
            back = [got[edges[k] : edges[k + 1]] for k in range(len(n))]
            same = [back[k] == was[off[k] : off[k + 1]] for k in range(len(n))]
            sha = _unless(piece.column(1).is_null(), pa.array([hashlib.sha256(x).hexdigest() for x in back], pa.string()))
            yield pa.record_batch([piece.column(0), pa.array(n), pa.array(crc, pa.int64()), pa.array(same), sha], names=["doc_id", "n_pieces", "ids_crc32", "lossless", "decoded_sha256"])

    return run


def round_trip(docs: DataFrame, model_path: str, seed: int = 0) -> DataFrame:
    """doc_id, n_pieces, CRC-32 of the ids as uint32, whether decoding gives the text back, and its SHA-256 (null for null)."""
    rows = bounded(docs).select("doc_id", "text")
    return rows.mapInArrow(_digest(model_path, seed), "doc_id long, n_pieces long, ids_crc32 long, lossless boolean, decoded_sha256 string")
