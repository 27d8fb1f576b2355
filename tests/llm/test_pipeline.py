import random

import pytest

pipeline = pytest.importorskip("corpus_pipeline")


def prose(rng, n):
    return " ".join(rng.choice(["river", "stone", "light", "water", "cloud", "wind"]) + str(rng.randrange(400)) for _ in range(n))


def test_stages_keep_clean_documents_and_catch_the_rest(spark, tmp_path):
    rng = random.Random(12)
    junk = lambda: " | ".join(rng.choice("ABCDEF") * 4 + "!!" for _ in range(60))
    item, passage = prose(rng, 40), prose(rng, 60)
    clean = {i: prose(rng, 120) for i in range(60)}
    rows = dict(clean)
    rows |= {100 + k: junk() for k in range(30)}
    rows |= {200: clean[3], 201: clean[4].replace("river", "RIVER", 1)}
    rows |= {300: prose(rng, 50) + " " + passage, 301: prose(rng, 70) + " " + passage + " " + prose(rng, 20)}
    rows |= {400: prose(rng, 50) + " " + item, 500: None, 501: "", 502: prose(rng, 30_000)}
    d = str(tmp_path)
    # columns called as the operators' own
    kind = "doc_id long, text string, lang string, source string, n_chars long, __lower string, __starts int, gone_added int, class long, rule string"
    listed = [*rows.items(), (7, clean[7]), (None, clean[9])]  # a repeated row, a row without id
    spark.createDataFrame([(i, t, "en", "s", len(t or ""), "l", 1, 2, i, "r") for i, t in listed], kind).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(i < 100), 0) for i in rows if i < 200] + [(500, 1, 0), (None, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item), (None, "  ."), (2, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns = docs.columns
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, d)
        assert out.columns == columns, name
    out = pipeline.run(spark, d)
    assert out.columns == [*columns, "ids", "n_pieces", "lossless"]
    found = out.collect()
    got = {r.doc_id: r for r in found if r.doc_id is not None}
    blank = {i for i in (500, 501) if i in got}  # the classifier's bias decides on these
    assert set(got) - blank == {*clean, 300, 301, 502}
    assert len(found) == len(got) + 2 and sum(r.doc_id == 7 for r in found) == 2
    assert all(got[i].text == rows[i] and got[i].lossless for i in blank) and got[502].text == rows[502]
    assert all(r["__lower"] == "l" and r.rule == "r" and r["class"] == r.doc_id for r in found)
    assert all(got[i].text == t and got[i].lossless for i, t in clean.items() if i != 9)
    assert passage in got[300].text and passage not in got[301].text
    alone = spark.read.parquet(f"{d}/documents.parquet").where("doc_id IS NULL")
    assert [s(spark, alone, d).count() for _, s in pipeline.STAGES[1:]] == [1, 1, 1, 1]
    empty = str(tmp_path / "empty")
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{d}/{t}.parquet").limit(0).write.parquet(f"{empty}/{t}.parquet")
    assert pipeline.run(spark, empty).count() == 0
