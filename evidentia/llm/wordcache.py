"""Distinct words of one Python worker: numbered once, found again by hash and compared by bytes."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd

from . import arrays as A

LIMIT = 1_500_000
#: Bytes of all words held, at most.
LIMIT_BYTES = 48 << 20


class Ragged:
    """Integer sequences one after another in an array that doubles as it fills."""

    def __init__(self, dtype):
        self.data, self.off, self.size = np.empty(1 << 16, dtype), np.zeros(1 << 16, np.int64), 0

    def add(self, values: np.ndarray, counts: np.ndarray) -> None:
        begin, rows = int(self.off[self.size]), len(counts)
        while len(self.off) < self.size + rows + 1:
            self.off = np.concatenate((self.off, np.zeros_like(self.off)))
        while len(self.data) < begin + len(values):
            self.data = np.concatenate((self.data, np.empty_like(self.data)))
        self.data[begin : begin + len(values)] = values
        self.off[self.size + 1 : self.size + 1 + rows] = begin + np.cumsum(counts)
        self.size += rows

    @property
    def used(self) -> int:
        return int(self.off[self.size])


class WordIndex:
    """A number for each distinct word, in order of appearance.

    Hashes find a word again; its bytes then decide, so words that hash alike stay
    apart. Two sorted levels keep insertion cheap.
    """

    def __init__(self, seed: int = 0):
        none = (np.empty(0, np.uint64), np.empty(0, np.int64))
        self.seed, self.levels, self.words, self.odd = seed, [none, none], Ragged(np.uint8), {}

    def __len__(self) -> int:
        return self.words.size

    def _new(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        n = ends - starts
        at = np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        rows = len(self) + np.arange(len(n))
        self.words.add(buf[at], n)
        return rows

    def rows(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of each word; new words get the next numbers."""
        codes, uniq = pd.factorize(A.span_hash(buf, starts, ends, self.seed))
        row = np.full(len(uniq), -1, np.int64)
        for keys, at in self.levels:
            if len(keys):
                p = np.minimum(np.searchsorted(keys, uniq), len(keys) - 1)
                ok = keys[p] == uniq
                row[ok] = at[p[ok]]
        new = np.flatnonzero(row < 0)
        if len(new):
            first = np.empty(len(uniq), np.int64)
            first[codes[::-1]] = np.arange(len(codes))[::-1]
            f = first[new]
            row[new] = self._new(buf, starts[f], ends[f])
            self._insert(uniq[new], row[new])
        out = row[codes]
        w = self.words
        same = A.same_spans(buf, starts, ends, w.data[: w.used], w.off[out], w.off[out + 1])
        for k in np.flatnonzero(~same).tolist():  # another word had this hash first
            word = buf[starts[k] : ends[k]].tobytes()
            if word not in self.odd:
                self.odd[word] = int(self._new(buf, starts[k : k + 1], ends[k : k + 1])[0])
            out[k] = self.odd[word]
        return out

    def _insert(self, keys: np.ndarray, at: np.ndarray) -> None:
        keys, at = np.concatenate((self.levels[1][0], keys)), np.concatenate((self.levels[1][1], at))
        if len(keys) > len(self.levels[0][0]) // 4:
            keys, at = np.concatenate((self.levels[0][0], keys)), np.concatenate((self.levels[0][1], at))
            order = np.argsort(keys)
            self.levels = [(keys[order], at[order]), (np.empty(0, np.uint64), np.empty(0, np.int64))]
        else:
            order = np.argsort(keys)
            self.levels[1] = (keys[order], at[order])

    def spans(self, begin: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes, starts and ends of the words from number ``begin`` on."""
        off = self.words.off[begin : self.words.size + 1]
        return self.words.data[off[0] : off[-1]], off[:-1] - off[0], off[1:] - off[0]


class WordCache:
    """Ragged integer values by word, kept between blocks of one Python worker.

    ``make`` gets distinct words as byte strings and gives one integer sequence for
    each. At ``limit`` words or ``LIMIT_BYTES`` of them the cache starts anew, which
    bounds memory and changes no result.
    """

    def __init__(self, make: Callable[[list[bytes]], list], dtype=np.uint16, limit: int = LIMIT, seed: int = 0):
        self.make, self.dtype, self.limit, self.seed = make, dtype, limit, seed
        self.clear()

    def clear(self) -> None:
        self.index, self.values = WordIndex(self.seed), Ragged(self.dtype)

    def rows(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Row of each word, for :meth:`gather`."""
        if len(self.index) > self.limit or self.index.words.used > LIMIT_BYTES:
            self.clear()
        before = len(self.index)
        out = self.index.rows(buf, starts, ends)
        if len(self.index) > before:
            raw, s, e = self.index.spans(before)
            raw = raw.tobytes()
            made = self.make([raw[a:b] for a, b in zip(s.tolist(), e.tolist(), strict=True)])
            n = np.fromiter(map(len, made), np.int64, len(made))
            self.values.add(np.fromiter((x for r in made for x in r), self.dtype, int(n.sum())), n)
        return out

    def gather(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values of the rows one after another, and how many each has."""
        off = self.values.off
        n = off[rows + 1] - off[rows]
        at = np.repeat(off[rows] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return self.values.data[at], n
