import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidentia.operators import catalogue, evidence, graph, linking, prompts, worklist

EDGE = "x_index long, x_name string, relation string, y_index long, y_name string, ord long"


def brute(adjacency, source, depth=None):
    best, front = {source: [source]}, {source: [source]}
    while front and (depth is None or len(next(iter(front.values()))) <= depth):
        new = {}
        for v, p in front.items():
            for w in adjacency[v]:
                if w not in best and (w not in new or p + [w] < new[w]):
                    new[w] = p + [w]
        best |= new
        front = new
    return best


@pytest.mark.parametrize("seed", [1, 2])
def test_shortest_paths(spark, seed):
    rng = random.Random(seed)
    pairs = {(rng.randrange(25), rng.randrange(25)) for _ in range(50)}
    edges = spark.createDataFrame([(a, f"n{a}", "r", b, f"n{b}", k) for k, (a, b) in enumerate(sorted(pairs))], EDGE)
    out = collections.defaultdict(list)
    for a, b in pairs:
        out[a].append(b)
    starts = spark.createDataFrame([(i,) for i in range(6)] + [(99,)], "source long")
    for depth in (None, 3):
        got = {(r.source, r.node): r.path for r in graph.shortest_paths(graph.directed(edges), starts, max_depth=depth).collect()}
        want = {(s, v): p for s in [*range(6), 99] for v, p in brute(out, s, depth).items()}
        assert got == want
        targets = spark.createDataFrame([(3,), (7,), (9,)], "node long")
        back = {(r.source, r.node): r.path for r in graph.paths_to_targets(graph.directed(edges), starts, targets, depth).collect()}
        assert back == {k: p for k, p in want.items() if k[1] in (3, 7, 9)}
        only = {(r.source, r.node): r.path for r in graph.shortest_paths(graph.directed(edges), starts, targets, depth).collect()}
        assert only == back
    both = collections.defaultdict(list)
    for a, b in pairs:
        both[f"n{a}"].append(f"n{b}")
        both[f"n{b}"].append(f"n{a}")
    names = spark.createDataFrame([("n0",)], "source string")
    got = {r.node: r.path for r in graph.shortest_paths(graph.undirected(edges), names).collect()}
    assert got == brute(both, "n0")


def test_rendering(spark):
    edges = spark.createDataFrame([(1, "A", "second", 2, "B", 5), (2, "B", "first", 1, "A", 1), (3, "C", "to", 2, "B", 2), (2, "B2", "late", 9, "Z", 9)], EDGE)
    paths = spark.createDataFrame([(1, ["A", "B", "C"]), (2, ["A"]), (3, ["A", "Q"])], "path_id int, path array<string>")
    got = {r.path_id: r.rendered for r in graph.render_by_name(paths, graph.relation_either(edges)).collect()}
    assert got == {1: "A (node) -> first (edge) -> B (node) -> to (edge) -> C (node)", 2: "A", 3: "A (node) -> unknown_relation (edge) -> Q (node)"}
    by_id = spark.createDataFrame([(1, [1, 2, 3]), (2, [1]), (3, [1, 8])], "path_id int, path array<bigint>")
    queries = spark.createDataFrame([(1, "qa"), (3, "qc")], "node long, query string")
    got = {r.path_id: r.rendered for r in graph.render_by_index(by_id, graph.relation_directed(edges), graph.node_names(edges), queries).collect()}
    assert got == {1: "qa(node)->second(edge)->B(node)->to(edge)->qc(node)", 2: "", 3: "qa(node)->(edge)->(node)"}


def test_path_statistics(spark):
    paths = spark.createDataFrame([(1, "d", "a (edge) b (edge) c"), (1, "d", "x (edge) y"), (2, "e", "z")], "patient long, disease string, rendered string")
    ends = spark.createDataFrame([(1, "d"), (1, "e"), (2, "d"), (2, "e")], "patient long, disease string")
    assert graph.path_statistics(paths, ends).first().asDict() == {"paths_per_patient": 1.5, "path_length": 1.0, "paths_per_endpoint": 0.75}
    pos = spark.createDataFrame([(1, 7), (1, 8), (2, 7)], "patient long, feature long")
    assert {r.feature: (r.paths_per_patient, r.path_length) for r in graph.feature_statistics(paths, ends, pos).collect()} == {7: (1.5, 1.0), 8: (1.0, 1.5)}
    assert graph.path_statistics(paths.limit(0), ends.limit(0)).first().path_length == 0.0
    starts = spark.createDataFrame([(1, 10), (1, 11), (2, 10)], "patient long, start_index long")
    labels = spark.createDataFrame([(1, "d", 1, 5), (2, "d", 0, 5)], "patient long, disease string, label int, end_index long")
    found = spark.createDataFrame([(10, 5, [10, 5])], "source long, node long, path array<bigint>")
    assert {(r.patient, r.label, r.start_index) for r in graph.patient_paths(starts, labels, found).collect()} == {(1, 1, 10), (2, 0, 10)}


def test_links(spark):
    nodes = spark.createDataFrame([("Red Bolt", 1), ("red bolt", 2), ("red, small", 3), ("reduce", 4), ("blue", 5)], "name string, ord long")
    terms = spark.createDataFrame([("Red Bolt",), ("RED BOLT",), ("red",), ("none",)], "term string")
    got = {r.term: (r.node, r.why) for r in linking.exact_or_case(terms, nodes).collect()}
    assert got == {"Red Bolt": ("Red Bolt", "exact"), "RED BOLT": ("red bolt", "exact(case-insensitive)")}
    assert {r.node for r in linking.prefix_matches(terms.where("term = 'red'"), nodes).collect()} == {"Red Bolt", "red bolt", "red, small"}
    near = spark.createDataFrame([("none", "blue", 1, 0.9), ("red", "blue", 1, 0.95), ("red", "red bolt", 2, 0.9)], "term string, node string, rank int, similarity double")
    assert {r.term: r.status for r in linking.resolve_targets(terms, nodes, near).collect()} == {"Red Bolt": "exact", "RED BOLT": "exact(case-insensitive)", "red": "similar(score=0.950)", "none": "similar(score=0.900)"}
    rows = [(r.pos, r.node, r.why) for r in linking.expand_sources(terms, nodes, near).where("term = 'red'").orderBy("pos").collect()]
    assert rows == [(1, "blue", "similar(score=0.950)"), (2, "red bolt", "similar(score=0.900)"), (3, "Red Bolt", "prefix_match"), (4, "red, small", "prefix_match")]


def test_top_k_in_blocks(spark):
    rng = np.random.default_rng(2)
    m = rng.standard_normal((60, 8))
    m[7] = m[9] = 2 * m[3]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "node_id long, embedding array<double>")
    queries = df.select(F.col("node_id").alias("query_id"), "embedding").where("query_id < 12")
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    for block in (100, 13):
        got = collections.defaultdict(list)
        for r in linking.top_k(queries, df, 4, block).orderBy("query_id", "rank").collect():
            got[r.query_id].append(r.node_id)
        for q in range(12):
            assert got[q] == sorted(range(60), key=lambda i: (-round(float(u[q] @ u[i]), 12), i))[:4]
    assert linking.top_k(queries, df.limit(0), 3).count() == 0


def test_catalogue(spark):
    edges = spark.createDataFrame([("1.0", "A", "r", "2", " B ", 1), ("7", "A", "r", "x", "C", 2), (None, "D", "r", "3", None, 3), ("0", "E", "r", "4", " ", 4), ("9", "C", "r", "5", "A", 5)], "x_index string, x_name string, relation string, y_index string, y_name string, ord long")
    got = {r.name: r.kg_index for r in catalogue.entity_catalogue(edges).collect()}
    assert got == {"A": 5, "B": 2, "E": 0, "C": 9}
    assert {r.name for r in catalogue.positive_only(catalogue.entity_catalogue(edges)).collect()} == {"A", "B", "C"}


def test_evidence(spark):
    features = spark.createDataFrame([(1, 0, 5), (1, 1, 4), (1, 2, 99), (2, 0, 4)], "entity long, pos int, node_id int")
    names = spark.createDataFrame([(4, "old", 0), (4, "Red Ring", 1), (5, "hot", 2), (6, "cold", 3)], "node_id int, name string, ord int")
    last = evidence.last_names(names)
    present = evidence.present_features(features, last)
    assert {r.entity: r.names for r in evidence.feature_lists(present).collect()} == {1: ["hot", "Red Ring"], 2: ["Red Ring"]}
    with pytest.raises(Exception, match="no name"):
        evidence.require_names(features, last).collect()
    entities = spark.createDataFrame([(1,), (2,), (3,)], "entity long")
    absent = evidence.absent_features(entities, features, last)
    assert {(r.entity, r.node_id) for r in absent.collect()} == {(1, 6), (2, 5), (2, 6), (3, 4), (3, 5), (3, 6)}
    allowed = spark.createDataFrame([(" red  RING",)], "name string")
    assert {r.entity for r in evidence.name_gate(present, allowed).collect()} == {1, 2}
    labels = spark.createDataFrame([(0, "d"), (1, "e")], "label_idx int, disease string")
    gold = evidence.gold_labels(entities, labels, spark.createDataFrame([(2, 1), (2, 1)], "entity long, label_idx int"))
    assert {(r.entity, r.label_idx): r.gold for r in gold.collect()} == {(e, k): int((e, k) == (2, 1)) for e in (1, 2, 3) for k in (0, 1)}
    a, b = evidence.relevance_partition(F.array(F.lit("Red Ring")), F.array(F.lit("ring"), F.lit("bolt")))
    assert tuple(spark.range(1).select(a, b).first()) == (["ring"], ["bolt"])


def test_worklist(spark):
    entities = spark.createDataFrame([(i,) for i in (5, 3, 9, 3)], "entity long")
    labels = spark.createDataFrame([(0, "Zeta, genetic"), (1, "alpha"), (2, "")], "label_idx int, disease string")
    work = worklist.graph_worklist(entities, labels)
    rows = [(r.ord, r.entity, r.disease) for r in work.orderBy("ord").collect()]
    assert rows == [(0, 3, "alpha"), (1, 3, "Zeta, genetic"), (2, 5, "alpha"), (3, 5, "Zeta, genetic"), (4, 9, "alpha"), (5, 9, "Zeta, genetic")]
    assert [r.ord for r in worklist.piece(work, 2, 4).orderBy("ord").collect()] == [2, 3]
    assert [r.ord for r in worklist.first_entities(work, 1, 1).orderBy("ord").collect()] == [1]
    assert [r.ord for r in worklist.first_entities(work, 9, 3).orderBy("ord").collect()] == [3, 4, 5]
    widths = spark.createDataFrame([(3, 1), (5, 2)], "entity long, width int")
    assert [(r.entity, r.label_idx) for r in worklist.graph_worklist(entities, labels, widths).orderBy("ord").collect()] == [(3, 0), (5, 1), (5, 0)]
    csv = spark.createDataFrame([("p", "a,b", 1, 0)], "patient_id string, features_present string, x int, y int")
    assert {(r.disease, r.label) for r in worklist.csv_worklist(csv, ["features_present"]).collect()} == {("x", 1), ("y", 0)}
    with pytest.raises(ValueError):
        worklist.csv_worklist(csv, ["features_present", "x", "y"])


def test_seeded_sampling(spark):
    assert worklist.id_order([10, 9, "10", "9", "x"]) == ["9", "10", 10, 9, "x"]
    assert worklist.sample_size(100, 0.1, 7) == 7
    with pytest.raises(ValueError):
        worklist.sample_size(5, 0.1, 5)
    df = spark.createDataFrame([(i, "n") for i in range(30)], "id long, v string")
    want = set(random.Random(42).sample(sorted(range(30), key=str), 5))
    assert {r.id for r in worklist.seeded_sample(df, "id", 5).collect()} == want
    mixed = ["10", "9", "x", "00", "123456789012345678901234567890", "", "a b", "é", "-3", "7\n", *(str(k) for k in range(40, 90))]
    df = spark.createDataFrame([(i, k) for k, i in enumerate([*mixed, *mixed, None])], "id string, v long").repartition(5)
    want = set(random.Random(7).sample(worklist.id_order(mixed), 20))
    got = worklist.seeded_sample(df, "id", 20, 7).collect()
    assert {r.id for r in got} == want and len(got) == 40
    assert worklist.seeded_sample(df.limit(0), "id", 5).count() == 0 and worklist.seeded_sample(df, "id", 1000).count() == 2 * len(mixed)
    lists = spark.createDataFrame([(2, list("abcdef")), (3, list("ab"))], "entity long, names array<string>")
    x = list("abcdef")
    random.Random(123 + 2).shuffle(x)
    assert {r.entity: r.names for r in worklist.shuffled_cut(lists, most=3).collect()} == {2: x[:3], 3: ["a", "b"]}


def test_prompts(spark):
    s = lambda *x: F.array(*map(F.lit, x)) if x else F.array().cast("array<string>")
    d = F.lit("D")
    row = spark.range(1).select(
        prompts.generation_input(d, s("a", "b"), s(), s("c"), prompts.answer(F.lit(0)), s("p", "q")), prompts.dataset_input(d, s(), s("x"), s()), prompts.presence_input(d, s("a"), s()),
        prompts.instruction(d, custom="Check {disease} now. "), prompts.instruction(d, "no_kg"), prompts.answer(F.lit(1), "csv"), prompts.render(prompts.messages(F.lit("S"), F.lit("U")), "turns"),
    ).first()
    assert row[0] == "### Input:\nDisease to be verified: D\n\ndiagnostic_features_present: a; b\n\npotentially_relevant_present_features: (none)\n\npotentially_relevant_absent_features: c\n\nReasoning Paths:\n- p\n- q\n\nAnswer: **False**\n"
    assert row[1] == "### Input:\nDisease to be verified: D\n\ndiagnostic_features_present:  (none)\n\npotentially_relevant_present_features: x\n\npotentially_relevant_absent_features: (none)\n\n"
    assert row[2].endswith("Patient features absent(truncated): (none)\n") and row[3] == "Check D now.\n" + prompts.CLOSING
    assert row[4] == prompts.SYSTEM["no_kg"] and row[5] == "Yes" and row[6] == "<start_of_turn>user\nS\nU<end_of_turn>\n<start_of_turn>model\n"
    with pytest.raises(ValueError):
        prompts.render(prompts.messages(d, d), "other")
