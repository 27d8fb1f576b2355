"""Scores and verdicts restated text by text, n-gram by n-gram and byte by byte, without blocks or offsets."""

import collections
import math
import random
import re

import numpy as np
import pytest

from evidentia.llm import arrays as A
from evidentia.llm import language_id, quality_classifier, quality_rules, url_filter

TEXTS = [None, "", " \t\n", "a", "ab ab", "one\x0btwo\x0cthree", "é ß 日本 語 x", "word " * 70, "12 34 ..,", "x" * 63, "y" * 64, "z é" * 40 + "!", "the river of stone " * 30]


def plain_hash(word):
    return int(A.span_hash(np.frombuffer(word, np.uint8), np.array([0]), np.array([len(word)]))[0])


def plain_window(values, seed=0):
    return int(A.window_hash(np.array(values, np.uint64), len(values), seed=seed)[0])


def words_of(raw):
    return re.findall(rb"[^\x20\x09-\x0D]+", raw)


def sigmoid(x):
    return 1 / (1 + math.exp(-x))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(8)
    kinds = "alpha beta gamma delta ε".split(), "kappa lambda mu ν".split()
    texts = TEXTS + [" ".join(rng.choice(kinds[k % 2]) + str(rng.randrange(9)) for _ in range(rng.randrange(1, 140))) for k in range(40)]
    return spark.createDataFrame([*enumerate(texts), (None, "no id"), (4, texts[4])], "doc_id long, text string").repartition(3)


def test_verdict_of_the_likelihood_ratio(spark, docs):
    trusted, bits = set(range(13, 35, 2)), 12  # of one kind only
    counts = [collections.Counter(), collections.Counter()]
    rows = [(r.doc_id, r.text) for r in docs.collect()]

    def grams(text):
        h = [plain_hash(w) for w in words_of((text or "").encode())]
        return [x % (1 << bits) for x in [*h, *(plain_window(p) for p in zip(h, h[1:]))]]

    for i, t in rows:
        counts[0].update(grams(t))
        if i in trusted:
            counts[1].update(grams(t))
    total = [sum(c.values()) + (1 << bits) for c in counts]
    ratio = lambda g: round((math.log((counts[1][g] + 1) / total[1]) - math.log((counts[0][g] + 1) / total[0])) * (1 << 20))
    out = quality_rules.judge(docs, spark.createDataFrame([(i,) for i in trusted], "doc_id long"), threshold=0.05, bits=bits).collect()
    got, verdicts = collections.defaultdict(list), set()
    for r in out:
        got[r.doc_id].append(r)
    assert len(out) == len(rows)
    for i, t in rows:
        g = grams(t)
        llr = sum(map(ratio, g)) / max(1, len(g)) / (1 << 20)
        for r in got[i]:
            assert r.llr == pytest.approx(llr, abs=2e-6), (i, t)
            if abs(llr - 0.05) > 1e-5:
                assert r.kept == (not r.base_failed and llr >= 0.05)
            verdicts.add((r.base_failed, r.kept))
    assert verdicts == {(True, False), (False, False), (False, True)}


def test_language_of_each_byte(docs):
    net = language_id.Network(["aa", "bb", "cc"], seed=5)
    rng = np.random.default_rng(4)
    p = net.p = {k: (v + rng.normal(0, 0.3, v.shape)).astype(np.float32) for k, v in net.p.items()}
    k, size = language_id.HIDDEN, language_id.SEGMENT
    s = lambda x: 1 / (1 + np.exp(-x))

    def read(d, codes):
        h, out = np.zeros(k), []
        for c in codes:
            a, b = p[f"w{d}"] @ p["embed"][:, c] + p[f"b{d}"][:, 0], p[f"u{d}"] @ h
            r, z = s(a[:k] + b[:k]), s(a[k : 2 * k] + b[k : 2 * k])
            n = np.tanh(a[2 * k :] + r * (b[2 * k :] + p[f"c{d}"][:, 0]))
            h = (1 - z) * n + z * h
            out.append(h)
        return out

    def mean(raw):
        total = np.zeros(3)
        for at in range(0, len(raw), size):
            codes = list(raw[at : at + size])
            for f, b in zip(read("f", codes), read("b", codes[::-1])[::-1], strict=True):
                e = np.exp(p["out"] @ np.concatenate((f, b)) + p["bias"][:, 0])
                total += e / e.sum()
        return total / max(1, len(raw))

    texts = {(r.doc_id, r.text): mean((r.text or "").encode()) for r in docs.collect()}
    by_id = {i: (t, m) for (i, t), m in texts.items()}
    for r in language_id.identify(docs, net).collect():
        text, m = by_id[r.doc_id]
        if not any(c.isalpha() for c in text or ""):
            assert (r.lang_pred, r.score) == ("und", 0)
            continue
        assert r.score == pytest.approx(m.max(), abs=1e-4), text
        if np.sort(m)[-1] - np.sort(m)[-2] > 1e-3:
            assert r.lang_pred == net.languages[m.argmax()]


def test_score_is_the_mean_of_its_features(docs):
    bits = 14
    model = quality_classifier.Model(np.random.default_rng(2).integers(-(4 << 20), 4 << 20, 1 << bits), -0.85, bits)  # near the threshold
    value = A.byte_values()

    def buckets(raw):
        h = [plain_hash(w) for w in words_of(raw)]
        out = [x >> 64 - bits for x in h]
        out += [0 if a == b else plain_window((a, b)) >> 64 - bits for a, b in zip(h, h[1:])]
        flat = re.sub(rb"[\x20\x09-\x0D]", b" ", raw)
        for n in quality_classifier.NGRAMS:
            pieces = (flat[i : i + n] for i in range(len(flat) - n + 1))
            out += [plain_window(value[list(x)], n) >> 64 - bits for x in pieces if b" " not in x[1:-1]]
        return out

    want = {}
    for r in docs.collect():
        b = buckets((r.text or "").encode())
        want[r.doc_id] = sigmoid(sum(int(model.weights[x]) for x in b) / max(1, len(b)) / (1 << 20) - 0.85)
    assert len(set(want.values())) > 40
    rows = quality_classifier.score(docs, model).collect()
    for r in rows:
        assert r.score == pytest.approx(want[r.doc_id], abs=1e-9), r
        assert r.predicted == int(r.score >= 0.3)
    assert {r.predicted for r in rows} == {0, 1}


def test_score_of_a_url(spark):
    model, value = url_filter.fit(), A.byte_values()
    urls = [None, "", "none", "http://a.example.org", "https://xn--1.info/p/q?x#y", "http://É.Org/ü/" + "k" * 3000, "http://h.org/a", "http://h.org/a"]
    pages = spark.createDataFrame([*enumerate(urls)], "page_id long, url string").repartition(2)
    for r in url_filter.judge(pages, model).collect():
        raw = f"^{r.host}${r.path}$".encode()
        grams = [raw[i : i + n] for n in url_filter.NGRAMS for i in range(len(raw) - n + 1)]
        total = sum(int(model.weights[plain_window(value[list(g)], len(g)) >> 64 - model.bits]) for g in grams)
        assert r.score == pytest.approx(sigmoid(total / (1 << 20) / math.sqrt(max(1, len(grams))) + model.bias), abs=1e-9), r
