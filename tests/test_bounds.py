"""What a task holds and what is shuffled follow from the way a plan is made, so plans are looked at here."""

from pyspark.sql import functions as F

from evidentia.operators import graph, scratch
from evidentia.plans import catalogue, outputs  # noqa: F401
from evidentia.sources import readers, sinks

EDGE = "x_index long, x_name string, relation string, y_index long, y_name string, ord long"


def test_pieces_grow_with_the_table(spark):
    assert scratch.pieces(spark, 10) == spark.sparkContext.defaultParallelism
    assert scratch.pieces(spark, 216_000_000) == 540


def test_search_carries_places_and_shuffles_edges_once(spark, monkeypatch):
    levels = []
    monkeypatch.setattr(graph, "saved", lambda df, name="step": (levels.append(df.columns) if name == "bfs" else None) or scratch.saved(df, name))
    edges = spark.createDataFrame([(a, b) for a, b in (("s", "b"), ("s", "a"), ("b", "t"), ("a", "t"), ("t", "u"))], "src string, dst string")
    one, aim = spark.createDataFrame([("s",)], "source string"), spark.createDataFrame([("u",), ("b",)], "node string")
    got = {r.node: (r.path, r.depth) for r in graph.shortest_paths(edges, one, aim).collect()}
    assert got == {"u": (["s", "a", "t", "u"], 3), "b": (["s", "b"], 1)}
    assert len(levels) > 3 and not any("path" in c for c in levels)


def test_search_with_nodes_of_one_hash(spark, monkeypatch):
    plain = F.xxhash64
    monkeypatch.setattr(F, "xxhash64", lambda c, salt: F.when(salt == 0, F.lit(7).cast("long")).otherwise(plain(c, salt)))
    edges = spark.createDataFrame([("s", "a"), ("a", "t")], "src string, dst string")
    got = graph.shortest_paths(edges, spark.createDataFrame([("s",)], "source string")).collect()
    assert {r.node: r.path for r in got} == {"s": ["s"], "a": ["s", "a"], "t": ["s", "a", "t"]}


def test_relations_of_the_asked_pairs_only(spark):
    edges = spark.createDataFrame([(1, "A", "second", 2, "B", 5), (2, "B", "first", 1, "A", 1), (3, "C", "to", 2, "B", 2), (4, "D", "self", 4, "D", 3), (5, None, "r", 1, "A", 0)], EDGE)
    asked = spark.createDataFrame([("A", "B"), ("D", "D"), ("A", "Q")], "src string, dst string")
    got = sorted((r.src, r.dst, r.relation) for r in graph.relation_either(edges, asked, 3).collect())
    assert got == [("A", "B", "first"), ("B", "A", "first"), ("D", "D", "self")]
    assert ("C", "B", "to") in {(r.src, r.dst, r.relation) for r in graph.relation_either(edges).collect()}


def plan(spark, name):
    return catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()


def test_absent_features_spread(spark):
    for name in ['absent_features']:
        p = plan(spark, name)
        assert "REPARTITION_BY_NUM" in p


def test_kg_edges_spread(spark):
    for name in ['kg_edges_undirected']:
        p = plan(spark, name)
        assert "REPARTITION_BY_NUM" in p and p.count("REPARTITION_BY_NUM") > 2


def test_entity_catalogue_hashed(spark):
    for name in ['entity_catalogue']:
        p = plan(spark, name)
        assert "REPARTITION_BY_NUM" in p and "SortAggregate" not in p


def test_name_lines_are_read_apart(spark, monkeypatch):
    monkeypatch.setattr(readers, "whole_lines", None)
    assert catalogue.QUERIES["name_lines_round_trip"](spark, "/root/testdata/sf0.001").count() > 0


def test_backward_search_makes_edges_once(spark, monkeypatch):
    made = []
    monkeypatch.setattr(graph, "bucketed", lambda *a: made.append(a[1:3]) or scratch.bucketed(*a))
    edges = spark.createDataFrame([(1, 2), (2, 3)], "src long, dst long")
    got = graph.paths_to_targets(edges, edges.select(F.col("src").alias("source")), spark.createDataFrame([(3,)], "node long"), 3, 5).collect()
    assert sorted(r.path for r in got) == [[1, 2, 3], [2, 3]] and made == [("dst", 5)]


def test_patient_rendering_spread(spark):
    for name in ['path_render_patient', 'path_stats', 'feature_statistics']:
        p = plan(spark, name)
        assert "REPARTITION_BY_NUM" in p


def test_crowded_steps_are_not_sent_to_one_task(spark, monkeypatch):
    most = []

    def spread(df, parts, *keys):
        most.append(df.groupBy(*keys).count().agg(F.max("count")).first()[0])
        return scratch.spread(df, parts, *keys)

    edges = spark.createDataFrame([(k, f"n{k}", "in", 1, "hub", k) for k in range(100, 700)] + [(1, "hub", "of", 2, "end", 1)], EDGE)
    paths = spark.createDataFrame([(k, [k, 1, 2]) for k in range(100, 700)] + [(1, [1, 2]), (2, [2])], "path_id long, path array<long>")
    queries = spark.createDataFrame([(2, "END"), (150, "Q")], "node long, query string")
    relations, names = graph.relation_directed(edges, 3), graph.node_names(edges, 3)
    monkeypatch.setattr(graph, "CROWD", 100, raising=False)
    monkeypatch.setattr(graph, "spread", spread)
    got = {r.path_id: r.rendered for r in graph.render_by_index(paths, relations, names, queries, 3).collect()}
    last = "hub(node)->of(edge)->END(node)"
    assert got == {k: ("Q" if k == 150 else "") + f"(node)->in(edge)->{last}" for k in range(100, 700)} | {1: "(node)->of(edge)->END(node)", 2: ""}
    assert max(x for x in most if x) <= 100


def test_both_sides_of_the_path_joins_are_spread(spark, monkeypatch):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.shuffle.partitions", "50")  # else one side would be dealt anew, to this many and then coalesced by bytes
    try:
        edges = spark.createDataFrame([(1, 2), (2, 3)], "src long, dst long")
        paths = graph.paths_to_targets(edges, edges.select(F.col("src").alias("source")), spark.createDataFrame([(3,)], "node long"), 3, 5)
        assert "ENSURE_REQUIREMENTS" not in paths._jdf.queryExecution().executedPlan().toString() and paths.count() == 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_patient_paths_spread(spark):
    for name in ['patient_path_search']:
        p = plan(spark, name)
        assert "REPARTITION_BY_NUM" in p


def test_array_in_pieces(spark, tmp_path, request):
    import json

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # few rows would go to one file
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled"))

    rows = spark.createDataFrame([(k, f"t{k}\né") for k in range(40)], "ord int, output string").repartition(3)
    for name, part in (("all", rows), ("one", rows.where("ord = 7")), ("none", rows.where("ord < 0"))):
        path = str(tmp_path / name)
        sinks.json_array_pieces(part, path, "ord")
        files = sorted((tmp_path / name).glob("part-*"))
        want = sorted(r.ord for r in part.collect())
        assert json.loads("".join(f.read_text(encoding="utf-8") for f in files)) == [{"output": f"t{k}\né"} for k in want]
        assert sorted(r.x.output for r in readers.json_array_items(spark, path, "output string").collect()) == sorted(f"t{k}\né" for k in want)
    assert len(list((tmp_path / "all").glob("part-*"))) > 1


def test_prompt_rows_spread(spark):
    for name in ['eval_rows', 'prompt_rows']:
        p = plan(spark, name)
        assert "REPARTITION_BY_NUM" in p and p.count("REPARTITION_BY_NUM") > 3
