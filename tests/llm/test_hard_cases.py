"""Texts made to collide, names that clash, long units, and tokenizers of another kind."""

import collections
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from evidentia.llm import arrays as A
from evidentia.llm import decontaminate, language_id, near_dedup, quality_classifier, quality_rules, sentencepiece_lattice, store, substring_dedup, token_output, url_filter, warc, wordcache

MODEL = public_tokenizers.path("piece_bpe_32k.model")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def thue_morse(a, b, n):
    return "".join(b if bin(k).count("1") % 2 else a for k in range(n))


TWINS = thue_morse("a", "b", 2048), thue_morse("b", "a", 2048)


def test_twins_do_not_hash_alike():
    for n in (1024, 2048):
        one, two = (t[:n].encode() for t in TWINS)
        buf = np.frombuffer(one + two, np.uint8)
        for seed in (0, 1, 12345):
            h = A.span_hash(buf, np.array([0, n]), np.array([n, 2 * n]), seed)
            assert h[0] != h[1]


def test_operators_tell_twins_apart(spark, tmp_path):
    rest = " ".join(f"w{k}" for k in range(19))
    rows = [(1, f"{TWINS[0]} {rest}"), (2, f"{TWINS[1]} {rest}"), (3, f"{TWINS[0]} {rest}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    cut = {r.doc_id: r.n_removed for r in substring_dedup.dedup_digest(docs).collect()}
    assert cut == {1: 0, 2: 0, 3: 20}
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORD_BPE)
    got = {r.doc_id: r.ids_crc32 for r in token_output.encode_digest(docs, WORD_BPE, root=f"file://{tmp_path}/t").collect()}
    assert got == {i: zlib.crc32(np.array([*t.encode(x, add_special_tokens=False).ids, 1], "<u4").tobytes()) for i, x in rows}
    found = decontaminate.find(docs, spark.createDataFrame([(9, TWINS[0])], "item_id long, text string"))
    assert sorted(r.doc_id for r in found.collect()) == [1, 3]
    short = spark.createDataFrame([(1, f"{TWINS[0]} x"), (2, f"{TWINS[1]} x"), (3, f"{TWINS[0]} x")], "doc_id long, text string")
    assert {r.doc_id: r.group_id for r in near_dedup.groups(short).collect()} == {1: 1, 2: 2, 3: 1}


def test_word_cache_survives_equal_hashes(monkeypatch):
    monkeypatch.setattr(A, "span_hash", lambda buf, s, e, seed=0: (e - s).astype(np.uint64) % np.uint64(3))
    rng, cache = random.Random(1), wordcache.WordCache(lambda words: [list(w) for w in words], np.uint8)
    for _ in range(5):
        words = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 20))) for _ in range(200)]
        buf = np.frombuffer(" ".join(words).encode(), np.uint8)
        s, e, _ = A.find_words(buf, np.array([0, len(buf)]))
        data, n = cache.gather(cache.rows(buf, s, e))
        assert data.tobytes() == "".join(words).encode() and n.tolist() == list(map(len, words))


def test_another_tokenizer_encodes_whole_texts(spark, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [(1, "Two  words\n here, é "), (2, None), (3, ""), (4, " x" * 50)]
    t = Tokenizer.from_file(path)
    got = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in token_output.encode_digest(spark.createDataFrame(rows, "doc_id long, text string"), path, root=f"file://{tmp_path}/t").collect()}
    for i, x in rows:
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 1]
        assert got[i] == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))


LONG = {
    "japanese": "".join(chr(0x3041 + k * 7 % 83) if k % 3 else chr(0x4E00 + k * 31 % 900) for k in range(900)),
    "ascii": "".join(chr(33 + k * k % 94) for k in range(1500)),
    "one letter": "z" * 700,
    "letters": "".join(random.Random(3).choice("abcdefghij") for _ in range(900)),
}


@pytest.mark.parametrize("name", LONG)
def test_long_units_draw_as_place_by_place(name):
    v, text = sentencepiece_lattice.pieces(MODEL), LONG[name]
    raw = f" {text}".encode()
    buf = np.frombuffer(raw, np.uint8)
    starts = sentencepiece_lattice._cut(v, buf, np.array([0]), np.array([len(raw)]))
    ends = np.append(starts[1:], len(raw))
    assert name != "japanese" or len(starts) > 100
    lattices = sentencepiece_lattice.Lattices(v)
    keys = A.mix(np.arange(len(starts)).astype(np.uint64))
    for _ in range(2):  # the second time from what is kept
        ids, counts = lattices.sample(lattices.rows(buf, starts, ends), keys)
        want = [sentencepiece_lattice.sample_one(v, raw[a:b], int(k)) for a, b, k in zip(starts, ends, keys, strict=True)]
        assert ids.tolist() == [i for w in want for i in w] and counts.tolist() == list(map(len, want))
        assert b"".join(v.bytes[i] for i in ids) == raw


def test_pieces_do_not_depend_on_company():
    v = sentencepiece_lattice.pieces(MODEL)
    texts = [*LONG.values(), "some words here", "z" * 3000, "日本 語 text", ""]
    alone = []
    for k, t in enumerate(texts):
        buf = np.frombuffer(t.encode(), np.uint8)
        alone.append(sentencepiece_lattice.encode_block(v, buf, np.array([0, len(buf)]), np.array([k], np.uint64))[0].tolist())
    off = np.cumsum([0, *(len(t.encode()) for t in texts)])
    buf = np.frombuffer("".join(texts).encode(), np.uint8)
    lattices = sentencepiece_lattice.Lattices(v)
    for _ in range(2):
        ids, n = sentencepiece_lattice.encode_block(v, buf, off, np.arange(len(texts)).astype(np.uint64), lattices)
        ends = np.cumsum(n)
        assert [ids[e - c : e].tolist() for e, c in zip(ends, n, strict=True)] == alone


CLASH = ["__lower", "lower_added", "__starts", "__id", "id_added", "starts_added", "__gone", "gone_added", "__ids", "__text", "ids_added", "text_added", "class", "seed", "pivot", "label", "labelled_added"]


def test_columns_of_any_name_go_through(spark):
    rng = random.Random(7)
    words = lambda n: " ".join(f"w{rng.randrange(500)}" for _ in range(n))
    base, passage, item = words(120), words(40), words(30)
    rows = [(1, base), (2, base), (3, f"{words(20)} {passage}"), (4, f"{passage} {words(20)}"), (5, f"{words(9)} {item}"), (6, None), (7, "")]
    kind = "doc_id long, text string, " + ", ".join(f"`{c}` int" for c in CLASH)
    docs = spark.createDataFrame([(i, t, *range(len(CLASH))) for i, t in rows], kind)
    bench = spark.createDataFrame([(1, item, 5)], "item_id long, text string, class int")
    labels = spark.createDataFrame([(i, i % 2, 3) for i in range(1, 7)], "doc_id long, quality int, label int")
    outs = {
        "near": near_dedup.dedup(docs), "repeats": substring_dedup.dedup(docs), "leaks": decontaminate.clean(docs, bench), "leaks joined": decontaminate.clean(docs, bench, 0),
        "quality": quality_classifier.keep_good(docs, quality_classifier.fit(docs, labels)),
    }
    kept = {"near": {1, 3, 4, 5, 6, 7}, "repeats": set(range(1, 8)), "leaks": {1, 2, 3, 4, 6, 7}, "leaks joined": {1, 2, 3, 4, 6, 7}}
    for name, out in outs.items():
        got = out.collect()
        assert out.columns == docs.columns, name
        assert name not in kept or {r.doc_id for r in got} == kept[name], name
        assert all(r[c] == k for r in got for k, c in enumerate(CLASH)), name
    coded = sentencepiece_lattice.decode(sentencepiece_lattice.encode(docs, MODEL), MODEL)
    both = sentencepiece_lattice.recode(docs, MODEL)
    for out in (coded, both):
        assert out.columns == [*docs.columns, "ids", "decoded"]
        assert all(r.decoded == r.text and all(r[c] == k for k, c in enumerate(CLASH)) for r in out.collect())
    trusted = spark.createDataFrame([(1,)], "doc_id long")
    assert quality_rules.judge(docs, trusted).count() == substring_dedup.dedup_digest(docs).count() == near_dedup.groups(docs).count() == 7
    assert language_id.identify(docs, language_id.fit(docs.withColumn("lang", F.lit("x")))).count() == 7
    pages = spark.createDataFrame([(1, "http://a/", "x", 1, 2), (2, None, "x", 1, 2)], "page_id long, url string, html string, sha int, first int")
    assert {r.page_id: r.refers_to for r in warc.round_trip(pages).collect()} == {1: None, 2: 1}
    assert url_filter.judge(pages.withColumn("host", F.lit("h")), url_filter.fit()).count() == 2


def test_frequent_grams_spread_and_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "HOT_SAMPLE", 1)
    rng = random.Random(2)
    line = " ".join(f"licence{k}" for k in range(16))
    word = lambda: f"w{rng.randrange(10**6)}"
    rows = [(i, " ".join([*(word() for _ in range(12)), line, *(word() for _ in range(12))])) for i in range(300)]
    rows += [(1000 + i, t) for i, t in rows[:20]]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    hot = substring_dedup.frequent_anchors(docs, 20, 5, 50)
    got = {r.doc_id: r.n_removed for r in substring_dedup.dedup_digest(docs).collect()}
    assert len(hot) and got == {i: 40 if i >= 1000 else 0 for i, _ in rows}
    index = substring_dedup.FingerprintIndex(spark, f"{store.shared_dir(spark, 'x')}/index", 8, hot=hot, key=5)
    found = collections.Counter()
    for r in index.add(docs, store.shared_dir(spark, "hits")).collect():
        found[r.doc_id] += len(r.starts) // 4
    assert found == {i: 21 for i, _ in rows if i >= 1000}


def test_urls_the_regression_has_not_seen():
    model = url_filter.fit()
    unwanted = ["http://www.spam-farm.example.org/en/12", "https://casino-win.example.com/slots", "http://cheap-viagra.example.org/order", "https://porn-live.example.net/cams", "http://free-poker.example.com/bonus", "https://spam-sale.example.net/fr/8"]
    wanted = ["https://www.gardening.example.org/en/12", "https://docs.example.com/paper/3", "http://m.ththan.example.net/de/44", "https://blog.tionsh.example.com/en/9?page=2", "http://bridge.example.org/es/1", "https://history-society.example.net/fr/8"]
    hosts = {url_filter._split(u)[0] for u, _ in url_filter.LABELLED}
    assert not hosts & {url_filter._split(u)[0] for u in unwanted + wanted}
    score = model.logits([url_filter._text(*url_filter._split(u)) for u in unwanted + wanted])
    assert (score[: len(unwanted)] > 0).all() and (score[len(unwanted) :] < 0).all()


def test_scratch_needs_a_shared_folder_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError):
        store.shared_dir(Session(), "x")
    assert store.fresh(spark.range(1).selectExpr("id", "1 AS A_added"), "a") == "a_added_"
