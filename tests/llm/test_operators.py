"""Each operator against a plain re-statement of its rule, on small tables with the awkward cases in them."""

import base64
import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from evidentia.llm import decontaminate, language_id, near_dedup, quality_classifier, quality_rules, sentencepiece_lattice, substring_dedup, token_output, url_filter, warc
from evidentia.llm.components import components

WORDS = "the of and house river stone light water green wind cloud over under near town people market bridge morning evening".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, hits int"


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(60)) for _ in range(n))


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    base = prose(rng, 120)
    passage = prose(rng, 55)
    texts = [base, base, base.replace(" ", "\n", 3), passage + " " + prose(rng, 60), prose(rng, 40) + "\t" + passage + "\n" + prose(rng, 10), None, "", "  \n ", "one", "one", "one two three", "é " * 70, "日本 語\u00a0x", "line a\nline a\n\nline a \n" * 5, "#*$ %&| <>" * 9, "word " * 300]
    w = base.split()
    w[60] = "changed"
    texts.append(" ".join(w))
    texts += [prose(rng, rng.randrange(20, 200)) for _ in range(25)]
    texts.append(" ".join(prose(rng, 400).split() * 8))
    out = [(i, t, "en", "s", len(t or ""), True, 1) for i, t in enumerate(texts)]
    out += [(None, base, "en", "s", 5, None, None), (3, texts[3], "en", "s", 5, None, None)]  # no id; a repeated row
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def by_row(df, *keys):
    return collections.Counter(tuple(r[k] for k in keys) for r in df.collect())


# ------------------------------------------------------------------ 1


def base_counts(text):
    w = split(text)
    grams = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if split(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(spark, docs, rows, none):
    trusted = spark.createDataFrame([(i,) for i in range(17, 40)] + [(None,), (17,)], "doc_id long")
    table = quality_rules.ratios(docs, trusted)
    got = by_row(quality_rules.judge(docs, trusted), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    want = collections.Counter()
    for i, t, *_ in rows:
        c = base_counts(t)
        failed = c[0] < 50 or 100 * c[4] > 50 * c[0]
        buf = np.frombuffer((t or "").encode(), np.uint8)
        s, e, first = quality_rules.A.find_words(buf, np.array([0, len(buf)]))
        score = [table[b] for b, _ in quality_rules._grams(quality_rules.A.span_hash(buf, s, e), first, quality_rules.BITS)]
        total, n = sum(int(x.sum()) for x in score), sum(map(len, score))
        want[(i, *c, failed, not failed and total >= round(quality_rules.THRESHOLD * (1 << 20)) * n)] += 1
    assert got == want
    assert quality_rules.judge(none, trusted).count() == 0


def test_likelihood_ratio_counts_all_documents(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "a c"), (3, None)], "doc_id long, text string")
    table = quality_rules.ratios(docs, spark.createDataFrame([(1,)], "doc_id long"), bits=10)
    one = lambda w: int(quality_rules.A.span_hash(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0]) & 1023
    ratio = lambda t, r: np.log((t + 1) / (3 + 1024)) - np.log((r + 1) / (6 + 1024))
    assert table[one(b"a")] / (1 << 20) == pytest.approx(ratio(1, 2), abs=1e-5)
    assert table[one(b"b")] / (1 << 20) == pytest.approx(ratio(1, 1), abs=1e-5)
    assert table[one(b"c")] / (1 << 20) == pytest.approx(ratio(0, 1), abs=1e-5)


# ------------------------------------------------------------------ 2


def test_gradient_of_the_network():
    net = language_id.Network(["x", "y", "z"])
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 256, (5, 4)).astype(np.uint8)
    mask = np.ones((5, 4), np.float32)
    mask[3:, 1] = 0
    y = np.array([0, 1, 2, 0])
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}

    def loss():
        p = net.positions(codes, mask)
        return -(np.log(p[:, y, np.arange(4)]) * mask).sum()

    x, m = np.take(net.p["embed"], codes, axis=1).transpose(1, 0, 2).copy(), mask[:, None, :]
    f, sf = net.direction("f", x, m, True)
    b, sb = net.direction("b", x, m, True)
    d = net.probabilities(np.concatenate((f, b), 1))
    d[:, y, np.arange(4)] -= 1
    d *= m
    g = {k: np.zeros_like(v) for k, v in net.p.items()}
    dh = net.p["out"].T @ d
    net.back("f", x, m, sf, dh[:, : language_id.HIDDEN], g)
    net.back("b", x, m, sb, dh[:, language_id.HIDDEN :], g)
    for name in ("uf", "ub", "wf", "wb", "bf", "cb"):
        at = (1, 0)
        step, was = 1e-2, net.p[name][at]
        net.p[name][at] = was + step
        up = loss()
        net.p[name][at] = was - step
        down = loss()
        net.p[name][at] = was
        assert g[name][at] == pytest.approx((up - down) / (2 * step), rel=0.03, abs=2e-3), name


def test_language_id(spark, none):
    rng = random.Random(2)
    a, b = "ka lu mi no pe".split(), "str ßch ung eit öp".split()
    make = lambda parts, n: " ".join("".join(rng.choice(parts) for _ in range(3)) for _ in range(n))
    rows = [(i, make(a if i % 2 else b, rng.randrange(3, 60)), "aa" if i % 2 else "bb") for i in range(240)]
    rows += [(900, None, "aa"), (901, "123 .,;", "aa"), (902, make(a, 5), None), (903, "日本", None), (None, make(b, 9), "bb"), (904, make(a, 30_000), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = {r.doc_id: r for r in language_id.identify(docs, language_id.fit(docs)).collect()}
    assert len(out) == len(rows)
    held = [r for r in rows if r[0] is not None and r[0] < 900 and zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert held and all(out[i].held_out for i, *_ in held)
    assert sum(out[i].lang_pred == lang for i, _, lang in held) / len(held) >= 0.95
    assert out[900].lang_pred == out[901].lang_pred == "und" and out[900].score == 0
    assert out[903].lang_pred in ("aa", "bb") and out[904].lang_pred == out[902].lang_pred == "aa"
    assert all(0 <= r.score <= 1 for r in out.values())
    assert language_id.identify(docs, language_id.fit(docs.where("lang IS NULL"))).where("lang_pred <> 'und'").count() == 0
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert language_id.identify(empty, language_id.fit(empty)).count() == 0


# ------------------------------------------------------------------ 3


def brute_repeats(rows, width=20):
    seen, out = {}, {}
    for i, t, *_ in sorted({(-(1 << 63) if r[0] is None else r[0], r[1]) for r in rows}, key=lambda r: r[0]):
        w = split(t)
        gone = set()
        for k in range(len(w) - width + 1):
            if seen.setdefault(tuple(w[k : k + width]), (i, k)) != (i, k):
                gone |= set(range(k, k + width))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept)
    return out


@pytest.mark.parametrize("batches", [1, 3, 5])
def test_substring_dedup(docs, rows, batches):
    want = brute_repeats(rows)
    got = by_row(substring_dedup.dedup_digest(docs, batches=batches), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == collections.Counter((i, *want[-(1 << 63) if i is None else i][:3]) for i, *_ in rows)


def test_substring_dedup_rewrites_only_what_repeats(docs, rows, none):
    want = brute_repeats(rows)
    out = substring_dedup.dedup(docs)
    assert out.columns == docs.columns
    for r in out.collect():
        text = next(t for i, t, *_ in rows if i == r.doc_id)
        expected = want[-(1 << 63) if r.doc_id is None else r.doc_id]
        assert r.text == (expected[3] if expected[1] else text)
        if expected[1]:
            assert r.n_chars == len(r.text)
    assert substring_dedup.dedup_digest(none).count() == 0


def test_fingerprint_index_compacts_and_stays_exact(spark, rows, tmp_path):
    rows = [r for r in rows if r[0] is not None]
    index = substring_dedup.FingerprintIndex(spark, f"file://{tmp_path}/index", 4, fanout=2)
    found = collections.defaultdict(set)
    for lo in range(0, 44, 11):
        part = spark.createDataFrame([r for r in rows if lo <= r[0] < lo + 11], SCHEMA)
        for r in index.add(part, f"file://{tmp_path}/hits{lo}").collect():
            found[r.doc_id] |= set(np.frombuffer(r.starts, "<u4").tolist())
        index.compact()
        assert len(index.runs) < 2
    seen, want = {}, collections.defaultdict(set)
    for i, t, *_ in sorted({(r[0], r[1]) for r in rows}, key=lambda r: r[0]):
        w = split(t)
        for k in range(len(w) - 19):
            if seen.setdefault(tuple(w[k : k + 20]), (i, k)) != (i, k):
                want[i].add(k)
    assert found == want


# ------------------------------------------------------------------ 4


def test_decontamination_tolerates_substitutions(spark, docs, none):
    rng = random.Random(9)
    items = [prose(rng, 40), prose(rng, 15), "Alpha, beta! Gamma delta epsilon zeta eta.", None, ""]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    w = items[0].split()
    for k in range(5, 40, 9):
        w[k] = "changed"
    texts = [prose(rng, 30) + " " + items[0].upper() + "\n" + prose(rng, 9), " ".join(w), "x " + items[1].replace(" ", ", "), items[2], " ".join(items[0].split()[:8]) + " " + prose(rng, 50), prose(rng, 90), None, " ".join(reversed(items[0].split()))]
    test = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.find(test, bench).collect()}
    assert set(got) == {(0, 0), (1, 0), (2, 1), (3, 2)}
    assert got[0, 0].n_matched == 40 and got[0, 0].doc_start == 30 and got[1, 0].n_matched >= 28
    clean = decontaminate.clean(test.withColumn("__x", F.lit(1)), bench)
    assert sorted(r.doc_id for r in clean.collect()) == [4, 5, 6, 7] and clean.columns == ["doc_id", "text", "__x"]
    assert decontaminate.find(none, bench).count() == 0
    assert decontaminate.find(docs, bench.limit(0)).count() == 0 and decontaminate.clean(docs, bench.limit(0)).count() == docs.count()


def test_decontamination_counts_the_whole_overlap(spark):
    rng = random.Random(4)
    items = [[f"w{rng.randrange(10**9)}" for _ in range(n)] for n in (16, 18, 16, 11, 400, 400)]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    rows = []
    # 14 of 16, 15 of 18, 12 of 16 and 10 of 11 tokens
    for item, places in ((0, (1, 3)), (1, (1, 3, 5)), (2, (0, 1, 2, 3)), (3, (5,))):
        rows.append((item, " ".join(["some", *("changed" if k in places else w for k, w in enumerate(items[item])), "more"])))
    rows += [(4, " ".join(items[4][50:63])), (5, "x " + " ".join(items[5][50:75]))]  # 13 and 25 tokens of a long item
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.find(docs, bench).collect()}
    assert set(got) == {(0, 0), (1, 1), (3, 3), (5, 5)}
    assert [(r.n_matched, r.n_span, r.doc_start, r.item_start) for r in (got[0, 0], got[1, 1], got[5, 5])] == [(14, 16, 1, 0), (15, 18, 1, 0), (25, 25, 1, 50)]
    assert got[5, 5].rule == "run" and got[0, 0].rule == "share" and got[5, 5].overlap == 25 / 400
    assert sorted(r.doc_id for r in decontaminate.clean(docs, bench).collect()) == [2, 4]


def brute_found(words, item):
    """The rule that an item meets on any diagonal, by trying them all."""
    rules = set()
    for d in range(-len(item) + 1, len(words)):
        same = [0 <= k + d < len(words) and words[k + d] == w for k, w in enumerate(item)]
        if sum(same) >= 0.8 * len(item) - 1e-9:
            rules.add("share")
        for i in range(len(item)):
            score = low = 0
            for k in range(i, len(item)):
                low += same[k]
                score += 1 if same[k] else decontaminate.PENALTY
                if score <= 0:
                    break
                if same[k] and low >= decontaminate.RUN:
                    rules.add("run")
    return rules


@pytest.mark.parametrize("item_bytes", [decontaminate.ITEM_BYTES, 0])
def test_decontamination_against_brute_force(spark, item_bytes):
    rng = random.Random(11)
    items = [[f"t{rng.randrange(300)}" for _ in range(rng.choice((1, 3, 4, 5, 7, 9, 10, 12, 13, 15, 22, 45)))] for _ in range(40)]
    bench = [(i, " ".join(w)) for i, w in enumerate(items)] + [(99, " ".join(items[3]).upper()), (None, " ".join(items[4])), (None, "only here " * 3), (50, None), (51, " .,")]
    rows = []
    for i in range(160):
        w = [f"t{rng.randrange(300)}" for _ in range(rng.randrange(0, 60))]
        v = [x if rng.random() > rng.choice((0, 0.1, 0.2, 0.3)) else "changed" for x in rng.choice(items)]
        at = rng.randrange(len(w) + 1)
        rows.append((i, " ".join(w[:at] + v + w[at:])))
    rows += [(160, None), (161, ""), (None, " ".join(items[20])), (None, "nothing"), rows[7], (162, " ".join([*(f"u{k}" for k in range(40_000)), *items[11]]))]
    docs, test = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    want, could = collections.Counter(), set()
    for i, t in rows:
        for k, item in enumerate([*items, ["only", "here"] * 3]):
            rules = brute_found(split(t)[-300:] if i == 162 else split(t), item)
            if "share" in rules:
                want[i, k if k < len(items) else None] += 1
            elif rules:
                could.add((i, k if k < len(items) else None))
    # each class once, under its smallest id
    same = {tuple(w): min(j for j, v in enumerate(items) if v == w) for w in items}
    want = collections.Counter({(i, k if k is None else same[tuple(items[k])]): n for (i, k), n in want.items()})
    found = decontaminate.find(docs, test, item_bytes).collect()
    got = collections.Counter((r.doc_id, r.item_id) for r in found)
    if item_bytes == 0:  # rows of one doc_id are told apart by their text alone
        got, want = collections.Counter(set(got)), collections.Counter(set(want))
    assert {k for k in want if want[k] != got[k]} == set()
    assert set(got) - set(want) <= could
    assert {r.n_items for r in found if r.item_id == 3} <= {2} and sum(want.values()) > 100
    dirty = {i for i, _ in got}
    kept = [r.doc_id for r in decontaminate.clean(docs, test, item_bytes).collect()]
    assert {i for i in kept if i is not None} == {i for i, _ in rows if i is not None} - dirty


def test_masks_spare_every_pattern_of_substitutions():
    import itertools

    for n in range(1, 19):
        spans = [m for _, size, m in decontaminate.all_masks() if size == (n if n < decontaminate.SHORT else 0)]
        marks = [sum(1 << (k + s) for k, c in enumerate(m) if c == "1") for m in spans for s in range(n - len(m) + 1)]
        free = n - -(-4 * n // 5)
        for places in itertools.combinations(range(n), free):
            changed = sum(1 << p for p in places)
            assert any(not m & changed for m in marks), (n, places)


# ------------------------------------------------------------------ 5


def test_samples_agree_as_often_as_weighted_jaccard():
    rng = np.random.default_rng(4)
    h = rng.integers(0, 1 << 63, 60).astype(np.uint64)
    a, b = rng.uniform(0.5, 3, 60).astype(np.float32), rng.uniform(0.5, 3, 60).astype(np.float32)
    a[:10], b[-10:] = 1e-6, 1e-6
    n = 4000
    x, y = (near_dedup.samples(h, w, np.array([0, 60]), n)[:, 0] for w in (a, b))
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert (x == y).mean() == pytest.approx(want, abs=0.03)


def test_near_dedup(spark, none):
    rng = random.Random(8)
    rows, truth = [], {}
    for g in range(12):
        w = prose(rng, 260).split()
        for k in range(5 if g else 60):  # the first group has more than a small bucket holds
            v = list(w)
            for _ in range(k % 3):
                v[rng.randrange(len(v))] = "edit" + str(rng.randrange(999))
            rows.append((len(rows), " ".join(v)))
            truth[len(rows) - 1] = g
    lone = [prose(rng, 150) for _ in range(30)] + ["one two", "a b c d"]
    for t in lone:
        rows.append((len(rows), t))
        truth[len(rows) - 1] = -len(rows)
    rows += [(900, "one two"), (901, None), (902, ""), (903, " "), (None, rows[0][1]), (0, rows[0][1])]
    truth[900] = truth[next(i for i, t in rows if t == "one two")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, kept string")
    got = near_dedup.groups(docs).collect()
    assert len(got) == len(rows)
    group = {r.doc_id: r.group_id for r in got}
    groups = collections.defaultdict(set)
    for i, g in truth.items():
        groups[g].add(i)
    for members in groups.values():
        assert {group[i] for i in members} == {min(members)}
    assert {group[i] for i in (901, 902, 903)} == {901, 902, 903} and group[None] is None
    assert all(r.kept == (r.doc_id == r.group_id) for r in got if r.doc_id is not None)
    out = near_dedup.dedup(docs)
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect() if r.doc_id is not None) == sorted([min(m) for m in groups.values()] + [901, 902, 903, 0])
    assert near_dedup.groups(none).count() == 0 and near_dedup.dedup(none).count() == 0


def test_near_dedup_finds_all_pairs_over_the_threshold(spark):
    rng = random.Random(1)
    rows = []
    for _ in range(25):
        w = prose(rng, 200).split()
        rows.append(w)
        v = list(w)
        for p in rng.sample(range(200), rng.randrange(1, 9)):
            v[p] = "new" + str(rng.randrange(10**6))
        rows.append(v)
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string")
    cells, n = near_dedup.document_frequencies(docs)
    idf = near_dedup.idf_table(cells, n)

    def vector(w):
        buf = np.frombuffer(" ".join(w).encode(), np.uint8)
        s, e, first = near_dedup.A.find_words(buf, np.array([0, len(buf)]))
        h, c, _ = near_dedup._shingles(near_dedup.A.span_hash(buf, s, e), first)
        return h, near_dedup._weights(h, c, idf).astype(np.float64)

    v = [vector(w) for w in rows]
    want = {(a, b) for a in range(len(v)) for b in range(a + 1, len(v)) if near_dedup.similarity(v[a], v[b]) >= 0.8}
    group = {r.doc_id: r.group_id for r in near_dedup.groups(docs).collect()}
    assert want and all(group[a] == group[b] for a, b in want)
    together = {(a, b) for a in group for b in group if a < b and group[a] == group[b]}
    assert together == want  # pairs here stand apart, so groups are pairs


def test_near_dedup_groups_large_families_as_brute_force_does(spark):
    rng = random.Random(5)
    base, rows = prose(rng, 200).split(), []
    for _ in range(400):
        v = list(base)
        for p in rng.sample(range(200), rng.choice((3, 3, 4, 5))):
            v[p] = "new" + str(rng.randrange(10**6))
        rows.append(v)
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string")
    idf = near_dedup.idf_table(*near_dedup.document_frequencies(docs))
    buf = np.frombuffer("".join(" ".join(w) + " " for w in rows).encode(), np.uint8)
    s, e, _ = near_dedup.A.find_words(buf, np.array([0, len(buf)]))
    h, c, first = near_dedup._shingles(near_dedup.A.span_hash(buf, s, e), np.arange(len(rows) + 1) * 200)
    w = near_dedup._weights(h, c, idf).astype(np.float64)
    v = [(h[a:b], w[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
    label = list(range(len(v)))
    for a in range(len(v)):
        for b in range(a + 1, len(v)):
            if label[a] != label[b] and near_dedup.similarity(v[a], v[b]) >= 0.8:
                low, high = sorted((label[a], label[b]))
                label = [low if x == high else x for x in label]
    assert 1 < len(set(label)) < len(label)
    got = {r.doc_id: r.group_id for r in near_dedup.groups(docs).collect()}
    assert got == dict(enumerate(label))


def test_components(spark, tmp_path):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (7, 7)]
    got = {r.v: r.label for r in components(spark.createDataFrame(chain, "a long, b long"), f"file://{tmp_path}/c").collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "a long, b long"), f"file://{tmp_path}/d").count() == 0


# ------------------------------------------------------------------ 6


def test_quality_classifier(spark, none):
    rng = random.Random(6)
    good = lambda: prose(rng, rng.randrange(5, 80))
    bad = lambda: " | ".join(rng.choice(WORDS).upper() + "!!" for _ in range(rng.randrange(5, 80))) if rng.random() < 0.5 else ("Spam" + str(rng.randrange(10**6)) + " ") * 40
    rows = [(i, bad() if i % 4 == 0 else good()) for i in range(400)] + [(900, None), (901, ""), (None, good()), (902, "x" * 100_000)]
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(400)] + [(1, 1), (None, 0), (5, None), (900, 0)], "doc_id long, quality int")
    model = quality_classifier.fit(docs, labels)
    out = {r.doc_id: r for r in quality_classifier.score(docs, model).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(out[i].held_out for i in held) and not out[None].held_out
    assert sum(out[i].predicted == int(i % 4 > 0) for i in held) / len(held) >= 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out.values()) and out[900].score == out[901].score
    kept = quality_classifier.keep_good(docs, model)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(i for i, r in out.items() if i is not None and r.predicted)
    assert quality_classifier.score(none, quality_classifier.fit(none, labels.limit(0))).count() == 0
    one = quality_classifier.fit(docs, labels.where("quality = 1"))
    assert {r.predicted for r in quality_classifier.score(docs, one).collect()} == {1}


# ------------------------------------------------------------------ 7


def test_warc_round_trip(spark, tmp_path):
    html = ["<p>é</p>", "same", None, "same", "", "same\r\n\r\nWARC/1.1\r\n", "y" * 300_000, "same", "<p>é</p>"]
    pages = [(10 - i, f"https://h.example.org/{i} x\n", h, 1) for i, h in enumerate(html)] + [(50, None, "same", 1), (None, "http://a/", "same", 1), (None, "http://b/", "only", 1)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, kind int").repartition(3)
    got = warc.round_trip(df, f"file://{tmp_path}/w").collect()
    least = {}
    for i, _, h, _ in pages:
        if i is not None:
            least[h or ""] = min(i, least.get(h or "", i))
    want = collections.Counter()
    for i, _, h, _ in pages:
        raw = (h or "").encode()
        first = least.get(h or "")
        revisit = first is not None and first != i
        want[i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", first if revisit else None] += 1
    assert collections.Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    assert all(r.intact for r in got)
    responses = {r.record_id: r.page_id for r in got if r.record_type == "response"}
    assert all(responses[r.refers_to_record] == r.refers_to if r.record_type == "revisit" else r.refers_to_record is None for r in got)
    found = warc.read(spark, f"file://{tmp_path}/w2", warc.write(df, f"file://{tmp_path}/w2"), payloads=True)
    nested = warc.assemble(found).collect()
    assert len(nested) == len(pages) and all(r.request.kind == "request" and r.metadata.kind == "metadata" for r in nested)
    assert {bytes(r.response.payload).decode() for r in nested if r.response.payload is not None} == {h or "" for _, _, h, _ in pages}
    lost = warc.assemble(found.where("kind <> 'request'")).collect()
    assert len(lost) == len(pages) and all(r.request is None for r in lost)
    assert warc.round_trip(df.limit(0)).count() == 0


# ------------------------------------------------------------------ 8

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def test_sentencepiece_round_trip(spark, docs, none):
    import sentencepiece

    more = spark.createDataFrame([(700, "▁mark ▁▁ end▁"), (701, "🙂 日本語テキスト\x00 é"), (702, "z" * 5000 + " \n\n  "), (703, " lead")], "doc_id long, text string")
    both = docs.select("doc_id", "text").unionByName(more)
    rows = sentencepiece_lattice.decode(sentencepiece_lattice.encode(both, MODEL), MODEL).collect()
    assert all(r.decoded == r.text for r in rows) and len(rows) == both.count()
    assert {r.doc_id: r.ids for r in rows}[5] is None and {r.doc_id: r.ids for r in rows}[6] == []
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    assert all(sp.decode(r.ids) == r.text for r in rows if r.text and "▁" not in r.text)
    again = sentencepiece_lattice.encode(both.repartition(7), MODEL)
    assert collections.Counter((r.doc_id, tuple(r.ids or ())) for r in again.collect()) == collections.Counter((r.doc_id, tuple(r.ids or ())) for r in rows)
    other = sentencepiece_lattice.encode(both, MODEL, seed=1).collect()
    assert {r.doc_id: r.ids for r in other} != {r.doc_id: r.ids for r in rows}
    assert sentencepiece_lattice.round_trip(none, MODEL).count() == 0
    assert sentencepiece_lattice.round_trip(docs, MODEL).where("NOT lossless").count() == 0


def test_segmentations_are_drawn_by_weight():
    v, unit, n = sentencepiece_lattice.pieces(MODEL), b" then", 20_000
    lattices = sentencepiece_lattice.Lattices(v)
    row = lattices.rows(np.frombuffer(unit, np.uint8), np.array([0]), np.array([len(unit)]))
    keys = sentencepiece_lattice.A.mix(np.arange(n).astype(np.uint64))
    ids, counts = lattices.sample(np.repeat(row, n), keys)
    ends = np.cumsum(counts)
    drawn = [tuple(ids[e - c : e].tolist()) for e, c in zip(ends, counts)]

    def ways(b):
        if not b:
            yield ()
        for k in range(1, len(b) + 1):
            if b[:k] in v.by_text:
                yield from ((v.by_text[b[:k]], *r) for r in ways(b[k:]))

    weight = {w: float(np.exp(sum(v.weight[i] for i in w))) for w in ways(unit)}
    total = sum(weight.values())
    seen = collections.Counter(drawn)
    assert set(seen) <= set(weight) and len(seen) > 2
    for w, p in weight.items():
        assert seen[w] / n == pytest.approx(p / total, abs=0.012)
    assert [tuple(sentencepiece_lattice.sample_one(v, unit, int(k))) for k in keys[:200]] == drawn[:200]


# ------------------------------------------------------------------ 9


def brute_url(url, rules):
    m = re.match(r"(?s)(.*?)://([^/?#]*)([^?#]*)", url or "")
    host, path = ("".join(c.lower() if c.isascii() else c for c in m[2]), m[3]) if m else ("", "")
    fit = [(r, v) for r, v in rules if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
    return host, path, max(fit, key=lambda x: len(x[0])) if fit else (None, None)


def test_url_filter(spark, none):
    urls = ["http://A.Example.NET/en/x?q#f", "https://example.net/en", "http://xexample.net/en/1", "x://net/", "http://net", "https://b.example.com/de/?", "https://b.example.com/den", "ftp://o.org/fr/a", "http://org#a", None, "", "no scheme", "a://b://c/d", "http://İ.Net/EN/", "http://h.example.com:80/de/x\ny", "https://spam-farm.example.org/en/3", "https://blog.garden.example.com/en/4", "https://h.org/fr/" + "p" * 100_000, "net", None]
    pages = spark.createDataFrame([(i, u, "r") for i, u in enumerate(urls)] + [(3, urls[3], "s"), (None, urls[0], None)], "page_id long, url string, rule string")
    model = url_filter.fit()
    rows = url_filter.judge(pages, model).collect()
    assert collections.Counter(r.page_id for r in rows) == {**dict.fromkeys(range(len(urls)), 1), 3: 2, None: 1}
    got = {r.page_id: r for r in rows}
    for i, u in enumerate(urls):
        host, path, (rule, verdict) = brute_url(u, url_filter.RULES)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), u
        assert got[i].verdict == (verdict or ("block" if got[i].score >= 0.5 else "allow"))
    assert got[15].verdict == "block" and got[16].verdict == "allow"
    assert all((s >= 0.5) == bool(y) for (u, y), s in zip(url_filter.LABELLED, 1 / (1 + np.exp(-model.logits([url_filter._text(*url_filter._split(u)) for u, _ in url_filter.LABELLED])))))
    assert url_filter.judge(pages.limit(0), model).count() == 0


# ------------------------------------------------------------------ 10

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def test_token_output(spark, docs, rows, tmp_path, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    extra = [(800, "It's THE <|ENDOFTEXT|> a<|endoftext|>b don't J\u030c e\u0301 Ünï,,, x!!! ÷a 12ab", "", "", 0, None, None)]
    got = token_output.encode_digest(docs.unionByName(spark.createDataFrame(extra, SCHEMA)), TOKENIZER, root=f"file://{tmp_path}/t").collect()
    start, want = 0, collections.Counter()
    for i, text, *_ in sorted([*rows, *extra], key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        want[i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
        start += len(ids)
    assert collections.Counter((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got) == want
    assert token_output.encode_digest(none, TOKENIZER).count() == 0


def test_sequences_are_views(spark, docs, tmp_path):
    root = f"file://{tmp_path}/t"
    shards = token_output.write_tokens(docs, TOKENIZER, root, length=64)
    for shard, _, n in shards:
        f = token_output.TokenFile(root, shard)
        whole = np.concatenate([x for _, _, x in f.documents()]) if n else np.empty(0, np.uint16)
        assert len(whole) == n
        for i in range(-(-n // 64)):
            ids, mask = f.sequence(i)
            bits = np.unpackbits(mask, bitorder="little")
            part = whole[i * 64 : (i + 1) * 64]
            assert ids[: len(part)].tolist() == part.tolist() and bits.sum() == len(part) and not ids.flags.owndata
    with pytest.raises(ValueError):
        token_output.write_tokens(docs, TOKENIZER, root, length=63)
