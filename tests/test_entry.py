import sys

import duckdb
import pytest

import __spark_entry__ as entry
from evidentia.plans import catalogue

SF = "/root/testdata/sf0.001"


def test_flagship(spark):
    assert entry.entry(spark).count() == 3


def test_every_query_has_a_name_in_both(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("missing", ["evidentia.llm", "evidentia.llm.queries", "public_tokenizers"])
def test_entry_works_without_training_data_operators(monkeypatch, missing):
    for name in [m for m in sys.modules if m.startswith("evidentia.llm") or m in ("corpus_pipeline", "public_tokenizers")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, missing, None)  # as if it were not installed
    if hasattr(sys.modules["evidentia"], "llm"):
        monkeypatch.delattr(sys.modules["evidentia"], "llm")
    assert set(entry.queries()) == set(catalogue.QUERIES) and set(entry.oracle_sql()) == set(catalogue.ORACLE)
    assert not any(m.startswith("evidentia.llm") for m in vars(sys.modules["evidentia.plans.catalogue"]))


def norm(v):
    return "N" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", ["per_label_metrics", "metrics_drop_entity", "conclusion_strict", "conclusion_anywhere", "three_way_filter", "prompt_rows", "worklist_graph", "bfs_directed_depth3", "path_render_disease", "expand_source", "topk_similarity", "absent_features", "candidate_triples", "review_files_round_trip", "decision_alignment", "name_gate_absent", "edge_table_round_trip"])
def test_against_duckdb(spark, name):
    db = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "labels", "conversations"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in columns) for r in df.collect())
    r = db.execute(catalogue.ORACLE[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == columns
    assert got == sorted(tuple(norm(x[names.index(c)]) for c in columns) for x in r.fetchall())


def test_absent_names_come_from_the_whole_dictionary(spark, tmp_path):
    spark.createDataFrame([(100 + k, f"n{k % 8}") for k in range(16)], "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(1, 100), (1, 101), (2, 111)], "l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r.entity: r.absent for r in catalogue.QUERIES["absent_shuffled"](spark, str(tmp_path)).collect()}
    assert got == {1: "n2, n3, n4, n5, n6, n7", 2: "n0, n1, n2, n4, n5, n6, n7"}
