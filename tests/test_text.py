import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evidentia.functions import conclusions, text, vectors
from evidentia.operators import review

PIECES = ["yes", "No", "TRUE", "false", "maybe", "Final answer: ", "**", "`", "> ", ".", "!", "\n", "\r\n", "\x1c", "\x85", " ", " ", "(", ")", "é", "_", "-", "–", ",", "genetic", "Genetic", " and ", "A", "x2", "\t", "<start>", "<END>", "### Input:\n"]


def run(spark, values, **columns):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [tuple(r)[1:] for r in rows.select("i", *(c.alias(k) for k, c in columns.items())).orderBy("i").collect()]


def last_line(t):
    lines = [x.strip() for x in t.splitlines() if x.strip()]
    return lines[-1] if lines else None


def strict(t):
    line, wrap = last_line(t) or "", set(">`*_~\"'()-–—")
    while line and (line[0] in wrap or line[0].isspace()):
        line = line[1:]
    while line and (line[-1] in wrap - {">"} | set(".!?") or line[-1].isspace()):
        line = line[:-1]
    said = [w.lower() for w in re.findall(r"\w+", line)]
    return next(("Yes" if w in ("yes", "true") else "No" for w in said if w in ("yes", "no", "true", "false")), None)


def norm(t):
    return " ".join(re.findall("[a-z0-9]+", re.sub(text.DROPPED_WORD, "", t.lower().strip())))


def anywhere(t):
    first = re.search(r"Final answer:\s*(yes|no)\b", t, re.I)
    every = re.findall(r"\b(yes|no)\b", t, re.I)
    return first[1].title() if first else every[-1].title() if every else None


@settings(max_examples=4, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=12).map("".join), min_size=40, max_size=60))
def test_readers_agree_with_plain_python(spark, values):
    v = F.col("v")
    got = run(spark, values, s=conclusions.strict(v), n=text.norm_key(v), a=conclusions.anywhere(v), l=text.last_line(v), q=text.norm_space_lower(v))
    for t, (s, n, a, line, q) in zip(values, got):
        assert s == strict(t), t
        assert n == norm(t), t
        assert a == anywhere(t), t
        assert line == last_line(t), t
        assert q == re.sub(r"\s+", " ", t).strip().lower(), t


def test_conclusions(spark):
    cases = ["**Yes**", "No.", "True", "> *no*", "", None, "yes and no", "yes\nwell", "a\nFALSE!\n\n", "x **Final answer:** No", "Final answer: no\nYes", "noé", "(true)"]
    v = F.col("v")
    got = run(spark, cases, s=conclusions.strict(v), e=conclusions.exact(v), t=conclusions.exact_truth(v), a=conclusions.anywhere(v), b=conclusions.anywhere_truth(v))
    assert [g[0] for g in got] == ["Yes", "No", "Yes", "No", None, None, "Yes", None, "No", "No", "Yes", None, "Yes"]
    assert [g[1] for g in got] == ["Yes", "No", None, None, None, None, None, None, None, None, "Yes", None, None]
    assert [g[2] for g in got] == [None, None, 1, None, None, None, None, None, 0, None, None, None, 1]
    assert [g[3] for g in got] == ["Yes", "No", None, "No", None, None, "No", "Yes", None, "No", "No", None, None]
    assert [g[4] for g in got] == [None, None, 1, None, None, None, None, None, 0, None, None, None, 1]


def test_labels(spark):
    got = run(spark, ["1", " 0 ", "1.0", "true", None, "2", "+1", "-1", "", "99999999999"], n=text.label_int(F.col("v"), "string"))
    assert [g[0] for g in got] == [1, 0, None, None, None, 2, 1, -1, None, None]
    row = spark.sql("SELECT 0.9D a, -0.9D b, true c, CAST('NaN' AS DOUBLE) d, CAST(NULL AS INT) e")
    assert tuple(row.select(*(text.label_int(F.col(c), k) for c, k in zip("abcde", ("double", "double", "boolean", "double", "int")))).first()) == (0, 0, 1, None, None)


def test_fields(spark):
    v = F.col("v")
    got = run(spark, ["  \n\n ## INPUT :\n\n  a\n b \n\n \n", "Output:\nx", None, "\tx\r\n", "input is here"], i=text.clean_field(v, "input"), o=text.clean_field(v, "output"), n=text.clean_field(v))
    assert [g[0] for g in got] == ["a\n b ", "Output:\nx", "", "x", "input is here"]
    assert [g[1] for g in got] == ["## INPUT :\n\n  a\n b ", "x", "", "x", "input is here"]


def test_small_functions(spark):
    v = F.col("v")
    got = run(spark, ["A, B", "Gland and duct", "x AND y", "", "a,"], q=text.query_variants(v), s=text.split_features(v))
    assert [g[0] for g in got] == [["A, B", "A"], ["Gland and duct", "Gl"], ["x AND y"], [], ["a,", "a"]]
    assert [g[1] for g in got] == [["A", "B"], ["Gland and duct"], ["x AND y"], [], ["a"]]
    got = run(spark, [" a <Start> b <END> c", "<end> x <start>", "  ", None, "<start><end>"], m=text.between_markers(v))
    assert [g[0] for g in got] == ["b", "<end> x <start>", None, None, ""]
    got = run(spark, ["  é/b-c ! ", "__"], f=text.file_safe(v))
    assert [g[0] for g in got] == ["é_b-c", ""]
    none = F.array().cast("array<string>")
    row = spark.range(1).select(text.join_or_none(none, ", "), text.join_or_none(F.array(F.lit("a"), F.lit("b")), "; "), text.bullets(F.array(F.lit("p"))), text.bullets(none), text.join_or_none(F.lit(None).cast("array<string>"), ",")).first()
    assert tuple(row) == ("(none)", "a; b", "- p", "(none)", "(none)")


def test_vectors(spark):
    a = lambda *x: F.array(*map(F.lit, x))
    row = spark.range(1).select(
        vectors.dot(a(1.0, 2.0), a(3.0, 4.0)), vectors.unit(a(3.0, 4.0)), vectors.unit(a(0.0, 0.0)), vectors.softmax(a(1000.0, 1000.0)), vectors.yes_probability(F.lit(0.3), F.lit(0.1)), vectors.yes_probability(F.lit(None).cast("double"), F.lit(None).cast("double")),
        vectors.last_position(a(1, 2, 1, 2, 3), a(1, 2)), vectors.last_position(a(1), a(1, 2)), vectors.last_position(a(1, 2), F.array().cast("array<int>")),
    ).first()
    assert row[0] == 11.0 and row[1] == pytest.approx([0.6, 0.8]) and row[2:4] == ([0.0, 0.0], [0.5, 0.5])
    assert abs(row[4] - 0.75) < 1e-12 and tuple(row)[5:] == (0.5, 2, None, None)


def test_three_way_split(spark):
    rows = [(1, "i", "### Input:\nq", "so\n**Yes**", "1", "d"), (2, "i", "", "No", "1", None), (3, "i", "x", "hm", "0", "d"), (4, "i", "x", "yes", "2", "d"), (5, "i", "x", "no", None, "d")]
    df = spark.createDataFrame(rows, "ord int, instruction string, input string, output string, label string, disease string")
    b = review.bucketed(df)
    assert [r.bucket for r in b.orderBy("ord").collect()] == ["kept", "mismatch", "bad", "bad", "bad"]
    kept = review.training_rows(b).first()
    assert kept.input == "q" and kept.instruction == "i\n" + review.CLOSING
    assert review.training_rows(b, False).first().instruction == "i"
    assert review.totals(b).first().asDict() == {"total": 5, "kept": 1, "mismatch": 1, "bad": 3, "unparsed": 1}
    assert {r.label: (r.total, r.mismatches, r.percent) for r in review.mismatch_by_label(b).collect()} == {1: (2, 1, 50.0)}
    assert {r.disease: (r.n, r.n_valid, r.accuracy) for r in review.accuracy_by_disease(b).collect()} == {"d": (4, 1, 1.0), "<unknown>": (1, 1, 0.0)}
    ints = df.withColumn("label", F.col("label").cast("int"))
    assert review.totals(review.bucketed(ints)).first().kept == 1
