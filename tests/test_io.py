import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidentia import models
from evidentia.sources import readers, sinks
from evidentia.streaming import resume


def put(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text, encoding="utf-8")
    return str(p)


def test_line_files(spark, tmp_path):
    path = put(tmp_path, "h.txt", "1,2,,3\n\n {7}-8\n")
    lines = readers.whole_lines(spark, path)
    assert [(r.entity, r.ids) for r in readers.digit_lists(lines).orderBy("entity").collect()] == [(0, [1, 2, 3]), (1, []), (2, [7, 8])]
    path = put(tmp_path, "g.txt", "1,2,,3\n\n5 , 6\n")
    for lines in (readers.whole_lines(spark, path), readers.numbered_lines(spark, path)):
        assert [(r.entity, r.ids) for r in readers.id_lists(lines).orderBy("entity").collect()] == [(0, [1, 2, 3]), (1, []), (2, [5, 6])]
        assert [(r.entity, r.ids) for r in readers.id_lists(lines, skip_blank=True).orderBy("entity").collect()] == [(0, [1, 2, 3]), (1, [5, 6])]
    bits = readers.whole_lines(spark, put(tmp_path, "m.txt", "0,1,1\n1,0,0"))
    assert [(r.entity, r.ids) for r in readers.indicator_positions(bits).orderBy("entity").collect()] == [(0, [1, 2]), (1, [0])]
    assert readers.label_matrix(bits).where("label = 1").count() == 3
    assert readers.exploded(readers.id_lists(bits)).count() == 6


def test_edge_table(spark, tmp_path):
    path = put(tmp_path, "kg.csv", 'relation,x_index,x_name,y_index,y_name,extra\nr,1,"A, b",2.0,NA,z\nr,,null,3,C,z\n')
    rows = readers.edge_table(spark, path).orderBy("ord").collect()
    assert [(r.x_index, r.x_name, r.y_index, r.y_name) for r in rows] == [(1, "A, b", 2, None), (None, None, 3, "C")]
    assert readers.edge_table(spark, path, ["x_name"]).columns == ["x_name"]


def test_json_files(spark, tmp_path):
    path = put(tmp_path, "n.json", '{"3": "c", "1": "a", "x": "no", "3": "d"}')
    assert [(r.node_id, r.name) for r in readers.id_names(spark, path).orderBy("ord").collect()][:2] == [(3, "d"), (1, "a")]
    path = put(tmp_path, "f.json", '{"A": [null, 5], "B": ["al", -1], "C": ["x"], "D": ["y", 2.0]}')
    assert {r.disease: (r.alias, r.kg_index) for r in readers.disease_filter(spark, path).collect()} == {"A": (None, 5), "B": ("al", -1), "C": ("x", None), "D": ("y", 2)}
    path = put(tmp_path, "p.json", '{"A": ["x", "y"], "B": []}')
    assert {(r.disease, r.pos, r.path) for r in readers.path_lists(spark, path).collect()} == {("A", 0, "x"), ("A", 1, "y")}
    assert readers.name_list(spark, put(tmp_path, "l.json", '["a", 1]')) == ["a", 1]
    for bad in ('{"a": 1}', "[]"):
        with pytest.raises(ValueError):
            readers.name_list(spark, put(tmp_path, "bad.json", bad), allow_empty=False)
    assert readers.prompt_file(spark, put(tmp_path, "s.txt", "a\nb")) == "a\nb"
    rows = readers.json_lines(spark, put(tmp_path, "r.jsonl", '{"a": 1}\n\n{"a": null, "b": "x"}\n'), "a int, b string")
    assert rows.count() == 2


def test_relevance(spark, tmp_path):
    raw = '"X, genetic": {\n"selected_entity_2": {"name": "n2", "reason": "r"},\n"selected_entity_1": {"name": "n1", "reason": "q"},\n}\n"Y": {"e": {"name": "m"}}'
    rows = readers.relevance_file(spark, put(tmp_path, "r.txt", raw)).collect()
    assert {(r.disease, r.entity_key, r.name) for r in rows} == {("X, genetic", "selected_entity_2", "n2"), ("X, genetic", "selected_entity_1", "n1"), ("Y", "e", "m")}
    assert readers.relevance_file(spark, put(tmp_path, "w.txt", "{" + raw.replace("},\n}", "}\n}").replace('}\n"Y"', '},\n"Y"') + "}")).count() == 3
    with pytest.raises(Exception, match="cannot be parsed"):
        readers.relevance_file(spark, put(tmp_path, "b.txt", '"X": [')).collect()


def test_maps_and_catalogues(spark, tmp_path):
    lines = readers.whole_lines(spark, put(tmp_path, "m.txt", "'Q, a': ['E, x', 12],\n'R': ['S, 13]\nbad line\n'T': [None, -1]\n'U': [\"V\", x]\n"))
    got = [(r.query, r.entity, r.kg_index) for r in readers.refined_map(lines).orderBy("ord").collect()]
    assert got == [("Q, a", "E, x", 12), ("R", "S", 13), ("T", "None", -1)]
    assert readers.refined_map(lines, quote_mode="double").orderBy("ord").first().query == "'Q, a'"
    lines = readers.whole_lines(spark, put(tmp_path, "e.txt", "a: b: 3\nno index\nc: x\nd: 4.0\n"))
    assert [(r.name, r.kg_index) for r in readers.entity_lines(lines).orderBy("ord").collect()] == [("a: b", 3), ("d", 4)]
    path = put(tmp_path, "p.csv", 'features_present,x\n"a, b",1\nc,0\n')
    assert [r.patient_id for r in readers.patients_csv(spark, path).collect()] == [0, 1]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(2, "b", None), (1, "é", 0.5)], "ord int, name string, v double")
    read = lambda p: "\n".join(x.read_text(encoding="utf-8").strip() for x in sorted((tmp_path / p).rglob("part-*")))
    sinks.json_array(rows, str(tmp_path / "a"), "ord")
    assert json.loads(read("a")) == [{"name": "é", "v": 0.5}, {"name": "b", "v": None}]
    sinks.json_lines(rows, str(tmp_path / "l"))
    assert "é" in read("l") and '"v":null' in read("l")
    sinks.table_csv(rows, str(tmp_path / "c"))
    assert read("c").split("\n")[0] == "ord,name,v" and "2,b," in read("c")
    sinks.name_index_lines(rows.withColumn("kg_index", F.col("ord")), str(tmp_path / "n"))
    assert sorted(x for x in read("n").split("\n") if x) == ["b: 2", "é: 1"]
    sinks.name_lines(rows, str(tmp_path / "o"))
    one = spark.createDataFrame([(0.5, None)], "acc double, auc double")
    sinks.summary(one, one, str(tmp_path / "s"))
    assert json.loads(read("s")) == {"probability": {"acc": 0.5, "auc": None}, "hard_label": {"acc": 0.5, "auc": None}}
    paths = spark.createDataFrame([("D/1", 1, "q"), ("D/1", 0, "p"), ("D/1", 2, "q"), ("E", 0, "z")], "disease string, pos int, path string")
    sinks.path_mapping(paths, str(tmp_path / "m"))
    assert json.loads(read("m")) == {"D/1": ["p", "q"], "E": ["z"]}
    sinks.path_report(paths.withColumnsRenamed({"pos": "ord", "path": "line"}), str(tmp_path / "t"))
    assert sorted(p.name for p in (tmp_path / "t").glob("file=*")) == ["file=D_1", "file=E"]
    pp = spark.createDataFrame([(1, "d", 1, 5, "p"), (1, "d", 1, 6, "p")], "patient long, disease string, label int, start_index long, path string")
    sinks.patient_paths(pp.limit(1), str(tmp_path / "pp"))
    sinks.patient_paths(pp, str(tmp_path / "pp"))
    assert spark.read.parquet(str(tmp_path / "pp")).count() == 2


def test_models(spark, tmp_path):
    class Flaky:  # local, so that it travels to the workers by value
        def answer(self, prompts):
            if "bad" in prompts[0]:
                raise RuntimeError("down")
            return [("Final answer: Yes", 0.6, 0.2)]

    prompts = spark.createDataFrame([(1, "ok"), (2, "bad")], "id int, prompt string")
    got = {r.id: r for r in models.predictions(models.generate(prompts, Flaky())).collect()}
    assert (got[1].pred_label, got[1].parsed) == (1, True) and abs(got[1].score_p_yes - 0.75) < 1e-12
    assert (got[2].pred_label, got[2].parsed, got[2].score_p_yes, got[2].generated_text) == (None, False, 0.5, "")
    noted = {r.id: r.generated_text for r in models.generate(prompts, Flaky(), "note").collect()}
    assert noted[2] == "NONE  # error: down"
    played = models.predictions(models.replay(prompts, spark.createDataFrame([(2, "it is false")], "id int, generated_text string"), ["id"]))
    assert {r.id: r.pred_label for r in played.collect()} == {1: None, 2: 0}
    texts = spark.createDataFrame([("a b",), ("c",), (None,)], "text string")
    path, enc = str(tmp_path / "cache"), models.HashingEncoder(16)
    first = models.embed_cached(texts, enc, path)
    assert first.count() == 2
    more = models.embed_cached(texts.unionByName(spark.createDataFrame([("new",)], "text string")), enc, path)
    assert more.count() == 3 and spark.read.parquet(path).count() == 3
    assert abs(np.linalg.norm(first.first().embedding) - 1) < 1e-9
    states = np.arange(12.0).reshape(1, 3, 4)
    assert models.pool(states, "first").tolist() == [[0, 1, 2, 3]] and models.pool(states, "mean").tolist() == [[4, 5, 6, 7]]


def test_resume(spark, tmp_path):
    work = spark.createDataFrame([(i,) for i in range(6)], "id long")
    path = str(tmp_path / "out")
    step = lambda df: df.withColumn("v", F.col("id") * 2)
    assert resume.resume_append(work.where("id < 4"), step, path, ["id"], "id long, v long").count() == 4
    assert resume.resume_append(work, step, path, ["id"], "id long, v long").count() == 6
    source, sink, mark = (str(tmp_path / x) for x in ("in", "sink", "mark"))
    for lo in (0, 3):
        work.where(f"id >= {lo} AND id < {lo} + 3").write.mode("append").parquet(source)
        resume.stream_append(spark, source, "id long", step, sink, mark).awaitTermination()
        resume.stream_append(spark, source, "id long", step, sink, mark).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(sink).collect()) == list(range(6))
