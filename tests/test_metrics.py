import random

import pytest
from pyspark.sql import functions as F

from evidentia.operators import metrics

# Published confusion counts: label, TP, FP, FN, TN.
COUNTS = [
    ("Acute myocardial infarction", 0, 0, 82, 1152), ("Chronic kidney disease", 197, 60, 96, 881), ("Chronic obstructive pulmonary disease", 111, 47, 124, 952),
    ("Conduction disorders", 11, 24, 22, 1177), ("Coronary atherosclerosis and related", 320, 15, 144, 755), ("Diabetes mellitus without complication", 311, 38, 193, 692),
    ("Essential hypertension", 465, 15, 131, 623), ("Gastrointestinal hemorrhage", 8, 19, 348, 859), ("Pneumonia", 1, 3, 284, 946), ("Shock", 0, 0, 153, 1081),
]


@pytest.fixture(scope="module")
def golden(spark):
    rows = [(k, label, y, s) for label, *c in COUNTS for n, (y, s) in zip(c, ((1, 1.0), (0, 1.0), (1, 0.0), (0, 0.0))) for k in range(n)]
    return spark.createDataFrame(rows, "entity long, label string, gold int, score double").cache()


def test_published_macro_and_micro(golden):
    m = metrics.macro(metrics.per_label(golden)).first()
    assert m.macro_acc == pytest.approx(0.8542949756888168, abs=1e-12)
    assert m.macro_bacc == pytest.approx(0.6670144723802172, abs=1e-12)
    assert m.macro_auc == pytest.approx(0.6670144723802172, abs=1e-12)
    assert m.macro_aupr == pytest.approx(0.4201945523892908, abs=1e-12)
    assert m.macro_f1 == pytest.approx(0.4047979025947607, abs=1e-12)
    u = metrics.micro(golden).first()
    assert u.micro_acc == u.micro_f1 == pytest.approx(0.8542949756888168, abs=1e-12)
    assert u.micro_auc == pytest.approx(0.7254221466456964, abs=1e-12)
    assert u.micro_aupr == pytest.approx(0.5385557252510581, abs=1e-12)


def test_curves_against_pairs_and_sweep(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice("ab"), rng.randrange(2), rng.choice([None, *(k / 7 for k in range(8)), rng.random()])) for i in range(600)]
    df = spark.createDataFrame(rows, "entity long, label string, gold int, score double")
    for r in metrics.curves(df, ["label"], parts=5).collect():
        mine = [(y, s) for _, lab, y, s in rows if lab == r.label and s is not None]
        pos, neg = [s for y, s in mine if y], [s for y, s in mine if not y]
        auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg)
        ap, last = 0.0, 0
        for t in sorted({s for _, s in mine}, reverse=True):
            tp, k = sum(s >= t for s in pos), sum(s >= t for _, s in mine)
            ap, last = ap + (tp - last) / len(pos) * tp / k, tp
        assert (r.auc, r.aupr) == (pytest.approx(auc, abs=1e-12), pytest.approx(ap, abs=1e-12))


def test_one_class_threshold_and_gaps(spark):
    df = spark.createDataFrame([(1, "neg", 0, 0.5), (2, "neg", 0, 0.9), (1, "pos", 1, 0.5), (2, "pos", 1, 0.4), (1, "mix", 1, 0.5), (2, "mix", 0, None)], "entity long, label string, gold int, score double")
    got = {r.label: r for r in metrics.per_label(df).collect()}
    assert got["neg"].auc is None and got["neg"].aupr == 0.0 and got["neg"].acc == 0.5 and got["neg"].bacc == 0.5 and got["neg"].f1 == 0.0
    assert got["pos"].auc is None and got["pos"].aupr == 1.0 and got["pos"].acc == 0.0  # 0.5 is not above the threshold
    assert got["mix"].support_total == 1
    assert {r.entity for r in metrics.complete_entities(df, 3).collect()} == {1}
    assert metrics.skipped(df, 3).first().asDict() == {"entities": 2, "scored": 1, "skipped": 1}
    assert metrics.per_label(df.limit(0)).count() == 0 and metrics.micro(df.limit(0)).count() <= 1
    twice = df.withColumn("ord", F.lit(1)).unionByName(df.where("label = 'neg'").withColumns({"score": F.lit(0.1), "ord": F.lit(2)}))
    assert {r.score for r in metrics.last_wins(twice, ["entity", "label"], "ord").where("label = 'neg'").collect()} == {0.1}


def test_label_filters(spark):
    df = spark.createDataFrame([("a",), ("b",), ("c",)], "label string")
    index = spark.createDataFrame([("a", 2), ("b", -1)], "label string, index int")
    names = lambda mode: sorted(r.label for r in metrics.keep_labels(df, index, mode).collect())
    assert (names("drop_neg_only"), names("keep_nonneg_only"), names("none")) == (["a", "c"], ["a"], ["a", "b", "c"])
    assert [r.label for r in metrics.dropped_labels(df, metrics.keep_labels(df, index)).collect()] == ["b"]
    with pytest.raises(ValueError):
        metrics.keep_labels(df, index, "other")
