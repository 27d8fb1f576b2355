"""Vectorised text primitives over Arrow string buffers.

Texts stay UTF-8 bytes: a block of documents is one byte array with offsets, and
words are found, hashed and windowed with numpy over the whole block at once.
Blocks are bounded in bytes, so memory does not follow the batch size.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 19
#: Spans over so many bytes are hashed one at a time.
LONG_WORD = 1 << 9

_U = np.uint64
_M1, _M2 = _U(0xFF51AFD7ED558CCD), _U(0xC4CEB9FE1A85EC53)

#: ASCII white space: the separators of ``[^\x20\x09-\x0D]+``.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every output bit depends on every input bit."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> _U(33))) * _M1
    x = (x ^ (x >> _U(33))) * _M2
    return x ^ (x >> _U(33))


def _lanes(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as little-endian numbers; zeros follow the last byte."""
    padded = np.zeros(len(buf) + 8, np.uint8)
    padded[: len(buf)] = buf
    return np.ndarray((len(buf) + 1,), "<u8", padded, 0, (1,))


#: Masks of the lowest 0 to 8 bytes.
_LOW = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def byte_values() -> np.ndarray:
    """A 64-bit value for each byte, for n-grams of bytes."""
    return mix(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))


def span_hash(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of each byte span ``buf[start:end]``.

    Eight bytes at a time go through the finaliser, so no arithmetic of the bytes alone
    (as with polynomials) makes two spans alike; other seeds give independent hashes.
    Spans over ``LONG_WORD`` bytes are hashed by BLAKE2 instead.
    """
    import hashlib

    n = ends - starts
    if not len(n):
        return np.empty(0, np.uint64)
    one, two = mix(np.array([2 * seed + 1, 2 * seed + 2], np.uint64) * _U(0x9E3779B97F4A7C15))
    odd = one | _U(1)
    lanes = _lanes(buf)
    out = mix((lanes[starts] & _LOW[np.minimum(n, 8)] ^ two) + n.astype(np.uint64) * odd)
    at, k = np.flatnonzero((n > 8) & (n <= LONG_WORD)), 8
    while len(at):
        out[at] = mix(out[at] * odd + (lanes[starts[at] + k] & _LOW[np.minimum(n[at] - k, 8)]))
        k += 8
        at = at[n[at] > k]
    salt = int(one).to_bytes(8, "little")
    for i in np.flatnonzero(n > LONG_WORD).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(buf[starts[i] : ends[i]].tobytes(), digest_size=8, salt=salt).digest(), "little")
    return out


def same_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray, begins: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Whether each span of ``buf`` holds the same bytes as that of ``other``, compared eight at a time."""
    n = ends - starts
    same = n == stops - begins
    mine, theirs = _lanes(buf), _lanes(other)
    at, k = np.flatnonzero(same & (n > 0)), 0
    while len(at):
        low = _LOW[np.minimum(n[at] - k, 8)]
        equal = (mine[starts[at] + k] ^ theirs[begins[at] + k]) & low == 0
        same[at[~equal]] = False
        k += 8
        at = at[equal]
        at = at[n[at] > k]
    return same


def find_words(buf: np.ndarray, off: np.ndarray, separators: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each document the index of its first word (plus the total)."""
    n = len(buf)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(off), np.int64)
    inside = ~separators[buf]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:]
    edges = off[(off > 0) & (off < n)]
    begins[edges] |= inside[edges]
    stops[edges - 1] |= inside[edges - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return starts, ends, np.searchsorted(starts, off)


def window_hash(h: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """Hash of each run of ``width`` consecutive values, by doubling; not masked at document edges."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    base = int(mix(np.array([seed * 2 + 77], np.uint64))[0]) | 1
    power = lambda k: _U(pow(base, k, 1 << 64))
    part, size, out, used, rest = h, 1, None, 0, width
    while rest:
        if rest & 1:
            got = part[used : used + n]
            out = got.copy() if out is None else out + power(used) * got
            used += size
        rest >>= 1
        if rest:
            part = part[: len(part) - size] + power(size) * part[size:]
            size *= 2
    return mix(out)


def window_mask(first: np.ndarray, width: int) -> np.ndarray:
    """True at each word where a window of ``width`` words of one document starts."""
    total = int(first[-1])
    ok = np.ones(max(0, total - width + 1), bool)
    for e in np.unique(first[1:-1]):
        lo, hi = max(0, int(e) - width + 1), min(int(e), len(ok))
        ok[lo:hi] = False
    return ok


def binary(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """As a binary array without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if not (pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type)):
        column = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
    return pc.fill_null(column, b"") if column.null_count else column


def bytes_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and its offsets, from 0."""
    a = binary(column)
    if not len(a):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = a.buffers()
    kind = np.int64 if pa.types.is_large_binary(a.type) else np.int32
    off = np.frombuffer(offsets, kind)[a.offset : a.offset + len(a) + 1].astype(np.int64)
    if data is None or off[-1] == off[0]:
        return np.empty(0, np.uint8), off - off[0]
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def blocks(batches: Iterable[pa.RecordBatch], text: str, limit: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cuts batches so that each piece has at most ``limit`` bytes of text, or one document."""
    for batch in batches:
        if not batch.num_rows:
            continue
        buf, off = bytes_of(batch.column(batch.schema.get_field_index(text)))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
            yield batch.slice(lo, hi - lo), buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
            lo = hi


def take_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The byte spans as a binary array."""
    n = ends - starts
    off = np.zeros(len(n) + 1, np.int64)
    np.cumsum(n, out=off[1:])
    at = np.repeat(starts - off[:-1], n) + np.arange(off[-1])
    return pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(buf[at]))])


def group_runs(values: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins in a sorted array."""
    if not len(values):
        return np.empty(0, np.int64)
    return np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))


def pack_sorted(h: np.ndarray) -> bytes:
    """Sorted uint64 values as byte planes of their differences, compressed."""
    import zstandard

    d = np.diff(h, prepend=_U(0)) if len(h) else h
    planes = np.ascontiguousarray(d.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack_sorted(data: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)
