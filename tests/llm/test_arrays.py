import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from evidentia.llm import arrays as A

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="ab é\n\t \x85\x0b日", max_size=30)), max_size=8)


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_words_are_runs_without_ascii_space(texts):
    buf, off = A.bytes_of(pa.array(texts, pa.string()))
    s, e, first = A.find_words(buf, off)
    got = [buf[a:b].tobytes().decode() for a, b in zip(s, e)]
    want = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    assert got == [w for ws in want for w in ws]
    assert np.diff(first).tolist() == [len(ws) for ws in want]


@settings(max_examples=60, deadline=None)
@given(TEXTS, st.integers(1, 4))
def test_equal_hash_means_equal_window(texts, width):
    buf, off = A.bytes_of(pa.array(texts, pa.string()))
    s, e, first = A.find_words(buf, off)
    at = np.flatnonzero(A.window_mask(first, width))
    h = A.window_hash(A.span_hash(buf, s, e), width)[at]
    words = [buf[a:b].tobytes() for a, b in zip(s, e)]
    seen = {}
    for k, x in zip(at, h):
        assert seen.setdefault(int(x), words[k : k + width]) == words[k : k + width]
    assert len(seen) == len({tuple(words[k : k + width]) for k in at})
    doc = np.searchsorted(first, np.arange(len(words)), "right")
    assert all(len(set(doc[k : k + width])) == 1 for k in at)


def test_hash_does_not_depend_on_place_or_segment():
    long = b"y" * (A.LONG_WORD + 5)
    text = (b"word " * (1 << 18)) + long + b" word " + long
    buf = np.frombuffer(text, np.uint8)
    s, e, _ = A.find_words(buf, np.array([0, len(text)]))
    h = A.span_hash(buf, s, e)
    assert len(set(h.tolist())) == 2 and h[-1] == h[-3] and h[0] == h[-2]


def test_packed_runs_round_trip():
    h = np.unique(np.random.default_rng(0).integers(0, 1 << 63, 1000).astype(np.uint64))
    assert (A.unpack_sorted(A.pack_sorted(h)) == h).all()
    assert len(A.unpack_sorted(A.pack_sorted(h[:0]))) == 0
