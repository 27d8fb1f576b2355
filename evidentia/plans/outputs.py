"""More queries: what readers and sinks make of the tables on a round trip, and composed operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors
from ..operators import catalogue as names_
from ..operators import evidence, graph, linking, metrics, prompts, review, worklist
from ..operators.scratch import folder, small
from ..sources import readers, sinks
from ..streaming import resume
from . import catalogue as C
from . import inputs as I
from .catalogue import long, query, rounded

# ---------------------------------------------------------------- files there and back


@query(f"WITH {I.EDGES} SELECT x_index, x_name, relation, y_index, y_name FROM edges")
def edge_table_round_trip(spark, d):
    path = folder(spark, "edges")
    I.edges(spark, d).drop("ord").write.csv(path, header=True)
    return readers.edge_table(spark, path, ["x_index", "x_name", "relation", "y_index", "y_name"])


@query(C.ORACLE["entity_catalogue"])
def name_lines_round_trip(spark, d):
    path = folder(spark, "names")
    sinks.name_index_lines(names_.entity_catalogue(I.edges(spark, d)), path)
    return long(readers.entity_lines(readers.numbered_lines(spark, path)).select("name", "kg_index"))


@query(f"""WITH {I.RECORDS} SELECT ord, sha256(input) AS input, sha256(output) AS output, label, disease FROM records""")
def json_lines_round_trip(spark, d):
    path, rows = folder(spark, "records"), I.records(spark, d)
    early = F.col("ord") % 2 == 0
    sinks.json_lines(rows.where(early), path)
    sinks.json_lines(rows.where(~early), path, append=True)
    got = readers.json_lines(spark, path, rows.schema)
    return got.select("ord", F.sha2("input", 256).alias("input"), F.sha2("output", 256).alias("output"), "label", "disease")


@query(f"""WITH {I.RECORDS}, {{clean}}
    SELECT 'alpaca' AS file, sha256(clean) AS output, NULL AS label, NULL AS parsed FROM cleaned WHERE bucket = 'kept'
    UNION ALL SELECT 'bad', sha256(output), label, NULL FROM bucketed WHERE bucket = 'bad'
    UNION ALL SELECT 'mismatch', sha256(output), CAST(label_value AS VARCHAR), conclusion FROM bucketed WHERE bucket = 'mismatch'""".replace(
    "{clean}", "cleaned AS (SELECT *, " + C._clean_sql("output", "output") + " AS clean FROM bucketed)"))
def review_files_round_trip(spark, d):
    path = folder(spark, "review")
    sinks.review_files(review.bucketed(I.records(spark, d)), path)
    rows = []
    for name, label, parsed in (("alpaca", None, None), ("bad", "label", None), ("mismatch", "label", "_parsed_conclusion")):
        items = readers.json_array_items(spark, f"{path}/{name}", "output string, label string, _parsed_conclusion string")
        pick = lambda c: F.col(f"x.{c}") if c else F.lit(None).cast("string")
        rows.append(items.select(F.lit(name).alias("file"), F.sha2("x.output", 256).alias("output"), pick(label).alias("label"), pick(parsed).alias("parsed")))
    return metrics.union_all(rows)


@query("""WITH p AS (SELECT c_mktsegment AS disease, n_name AS path, min(c_custkey) AS k FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2)
    SELECT disease, row_number() OVER (PARTITION BY disease ORDER BY k) - 1 AS pos, path FROM p""")
def path_mapping_round_trip(spark, d):
    path = folder(spark, "mapping")
    customer, nation = I.table(spark, d, "customer"), I.table(spark, d, "nation")
    rows = customer.join(small(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    sinks.path_mapping(rows.select(F.col("c_mktsegment").alias("disease"), F.col("c_custkey").alias("pos"), F.col("n_name").alias("path")), path)
    return long(readers.path_lists(spark, path).select("disease", "pos", "path"))


@query("SELECT s_suppkey AS patient, n_name AS disease, CAST(1 AS BIGINT) AS label, CAST(s_nationkey AS BIGINT) AS start_index, s_name AS path FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def patient_paths_round_trip(spark, d):
    path = folder(spark, "paths")
    supplier, nation = I.table(spark, d, "supplier"), I.table(spark, d, "nation")
    rows = supplier.join(small(nation), F.col("s_nationkey") == F.col("n_nationkey"))
    rows = rows.select(F.col("s_suppkey").alias("patient"), F.col("n_name").alias("disease"), F.lit(1).cast("long").alias("label"), F.col("s_nationkey").cast("long").alias("start_index"), F.col("s_name").alias("path"))
    sinks.patient_paths(rows.where("start_index < 10"), path)
    sinks.patient_paths(rows, path)  # a repeated run adds what is new
    return sinks.read_patient_paths(spark, path, rows.schema.simpleString()[7:-1].replace(":", " "))


@query(f"WITH {I.CELLS} SELECT CAST(dense_rank() OVER (ORDER BY label) - 1 AS BIGINT) AS label_index, label AS label_name, count(*) FILTER (score IS NOT NULL) AS support_total, CAST(sum(gold) FILTER (score IS NOT NULL) AS BIGINT) AS support_positive FROM cells GROUP BY label")
def label_tables_round_trip(spark, d):
    path = folder(spark, "labels")
    labels = metrics.per_label(I.cells(spark, d))
    order = labels.select(F.col("label").alias("name")).agg(F.array_sort(F.collect_list("name")).alias("all"))
    rows = labels.crossJoin(F.broadcast(order)).withColumn("label_index", F.array_position("all", F.col("label")) - 1).drop("all")
    sinks.label_tables(rows.withColumnRenamed("label", "label_name"), path)
    csv = spark.read.csv(f"{path}/csv", header=True, inferSchema=True)
    return csv.select(*(F.col(c).cast("long") if c != "label_name" else F.col(c) for c in ("label_index", "label_name", "support_total", "support_positive")))


@query("SELECT doc_id, lang, CAST(length(text) AS BIGINT) AS n FROM documents")
def resume_append(spark, d):
    """Half of the work is done by a first run; the second does what is left, once."""
    docs, path = I.table(spark, d, "documents").select("doc_id", "text", "lang"), folder(spark, "resume")
    run = lambda rows: resume.resume_append(rows, lambda r: r.select("doc_id", "lang", F.length("text").cast("long").alias("n")), path, ["doc_id"], "doc_id long, lang string, n long")
    run(docs.where("lang = 'en'"))
    return run(docs)


# ---------------------------------------------------------------- linking and paths


@query(f"""WITH {C._NODES}, {C._NAMES}, {C._TK}, {C._S},
    v AS (SELECT query, [query, CASE WHEN contains(query, ',') THEN trim(split_part(query, ',', 1)) END, CASE WHEN contains(lower(query), ' and ') THEN trim(split_part(query, 'and', 1)) END] AS a FROM q),
    u AS (SELECT query, unnest(a) AS variant, unnest(range(3)) AS i FROM v), f AS (SELECT query, variant, min(i) AS i FROM u WHERE variant <> '' GROUP BY query, variant),
    e AS (SELECT query, variant, i, name AS node, 1 AS r, 1.0 AS similarity FROM f JOIN nodes ON lower(variant) = lower(name)),
    c AS (SELECT * FROM e UNION ALL SELECT f.query, f.variant, f.i, sim.node, sim.rank, similarity FROM f JOIN sim ON sim.term = f.variant WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.query = f.query AND e.variant = f.variant)),
    n AS (SELECT c.*, row_number() OVER (PARTITION BY query ORDER BY i, r) AS place, ord FROM c JOIN nodes ON nodes.name = c.node)
    SELECT q.query AS query_name, coalesce(string_agg(place || ':' || node || ':' || ord || ':' || variant || ':' || printf('%.3f', similarity), '|' ORDER BY place), '') AS triples FROM q LEFT JOIN n USING (query) GROUP BY q.query""")
def candidate_triples(spark, d):
    queries = I.inline(spark, [(q,) for q in I.QUERY_NAMES], "query string")
    entities = C._nodes(spark, d).withColumn("kg_index", F.col("ord"))
    found = linking.ranked_candidates(_with_blank(queries), entities, C._near(spark, d).withColumnRenamed("term", "variant"))
    say = lambda t: F.format_string("%d:%s:%d:%s:%.3f", t["rank"], t["entity_name"], t["entity_index"], t["query_variant"], t["similarity"])
    return found.select("query_name", F.array_join(F.transform("query_triples", say), "|").alias("triples"))


def _with_blank(queries):
    """Variants, and a null one for a query that has none."""
    rows = names_.variants(queries)
    return queries.join(rows, "query", "left").select("query", "variant_pos", "variant")


@query(f"""WITH {C._DIRECTED}, starts AS (SELECT c_custkey % 50 AS patient, 10000000 + c_custkey AS start_index FROM customer)
    SELECT patient, r_name AS disease, start_index, array_to_string(path, '>') AS path FROM starts CROSS JOIN region JOIN short ON short.source = start_index AND short.node = r_regionkey""")
def patient_path_search(spark, d):
    customer, region = I.table(spark, d, "customer"), I.table(spark, d, "region")
    starts = customer.select((F.col("c_custkey") % 50).alias("patient"), (F.col("c_custkey") + 10_000_000).alias("start_index"))
    patients = starts.select("patient").distinct()
    ends = patients.crossJoin(small(region.select(F.col("r_name").alias("disease"), F.lit(1).alias("label"), F.col("r_regionkey").cast("long").alias("end_index"))))
    found = graph.patient_paths(starts, ends, C._to_regions(spark, d), I.parts(spark, d))
    return found.select("patient", "disease", "start_index", F.array_join(F.col("path").cast("array<string>"), ">").alias("path"))


@query(f"""WITH {C._PATIENT}, ends AS (SELECT DISTINCT x_index % 50 AS patient FROM edges), p AS (SELECT source % 50 AS patient, count(*) AS n, sum(len(regexp_extract_all(rendered, '\\(edge\\)'))) AS l FROM rendered GROUP BY 1),
    f AS (SELECT DISTINCT c_custkey % 50 AS patient, c_mktsegment AS feature FROM customer)
    SELECT feature, round(sum(n) / (SELECT count(*) FROM ends), 6) AS paths_per_patient, round(sum(l) / sum(n), 6) AS path_length FROM f JOIN p USING (patient) GROUP BY feature""")
def feature_statistics(spark, d):
    region = I.table(spark, d, "region").select(F.col("r_name").alias("disease"))
    patients = I.edges(spark, d).select((F.col("x_index") % 50).alias("patient")).distinct()
    paths = C._patient_style(spark, d).withColumn("patient", F.col("source") % 50)
    positives = I.table(spark, d, "customer").select((F.col("c_custkey") % 50).alias("patient"), F.col("c_mktsegment").alias("feature"))
    return rounded(graph.feature_statistics(paths, patients.crossJoin(small(region)), positives))


# ---------------------------------------------------------------- evidence, worklists, review


@query(f"""WITH {I.FEATURES}, {I.values(C._ALLOWED, 'name', 'a')}, g AS (SELECT DISTINCT name FROM names WHERE name IN (SELECT lower(trim(regexp_replace(name, '\\s+', ' ', 'g'))) FROM a))
    SELECT entity, coalesce((SELECT string_agg(name, ', ' ORDER BY name) FROM g WHERE NOT list_contains(lists.names, g.name)), '') AS absent FROM lists""")
def name_gate_absent(spark, d):
    lists = I.lists(spark, d)
    return evidence.gated_absent(lists, I.names(spark, d), I.inline(spark, C._ALLOWED, "name string")).select("entity", F.array_join("absent", ", ").alias("absent"))


@query(f"WITH {I.values(I.DISEASES, 'label_idx, disease', 'l')} SELECT o_orderkey AS entity, CAST(label_idx AS BIGINT) AS label_idx, disease FROM orders, l WHERE o_orderkey % 4 > label_idx")
def worklist_widths(spark, d):
    entities = I.entities(spark, d)
    widths = entities.select("entity", (F.col("entity") % 4).alias("width"))
    return long(worklist.graph_worklist(entities, I.diseases(spark), widths).drop("ord"))


@query(f"WITH {I.RECORDS} SELECT ord, CAST(label_value AS BIGINT) AS label, conclusion AS parsed FROM bucketed WHERE bucket = 'mismatch' ORDER BY ord LIMIT 5")
def mismatch_preview(spark, d):
    rows = review.mismatch_rows(review.bucketed(I.records(spark, d)))
    return long(worklist.preview(rows.select("ord", "label", F.col("_parsed_conclusion").alias("parsed")), "ord"))


# ---------------------------------------------------------------- model boundary


@query("""WITH a AS (SELECT l_orderkey AS k, list(l_partkey % 4 ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice) AS x FROM lineitem GROUP BY 1),
    b AS (SELECT k, x, x[greatest(len(x) - 2, 1):greatest(len(x) - 1, 1)] AS line FROM a),
    c AS (SELECT *, list_filter(range(greatest(len(x) - len(line) + 1, 0)), lambda i: x[i + 1:i + len(line)] = line)[-1] AS span, list_filter(range(len(line)), lambda i: line[i + 1] = 1)[1] AS one, list_filter(range(len(line)), lambda i: line[i + 1] = 2)[1] AS two,
          list_filter(range(len(x)), lambda i: x[i + 1] = 1)[-1] AS late FROM b),
    p AS (SELECT k, coalesce(span + coalesce(one, two), late) AS pos FROM c)
    SELECT k, CAST(pos AS BIGINT) AS pos, round(CASE WHEN pos IS NULL THEN 0.5 ELSE (pos + 1.0) / (pos + 3.0) END, 6) AS p_yes FROM p""")
def decision_alignment(spark, d):
    """Tokens are a stand-in: the parts of an order; the final line is the two before the last."""
    t = I.table(spark, d, "lineitem")
    items = F.array_sort(F.collect_list(F.struct("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")))
    rows = t.groupBy(F.col("l_orderkey").alias("k")).agg(F.transform(items, lambda x: x["l_partkey"] % 4).alias("x"))
    begin = F.greatest(F.size("x") - 2, F.lit(1))
    line = F.slice("x", begin, F.greatest(F.size("x") - 1, F.lit(1)) - begin + 1)
    at = vectors.decision_position(F.col("x"), line, [F.array(F.lit(v).cast("long")) for v in (1, 2)])
    steps = F.sequence(F.lit(0), F.size("x") - 1)
    p = vectors.decision_probability(F.col("pos"), F.transform(steps, lambda i: (i + 1) / 100.0), F.transform(steps, lambda i: F.lit(0.02)))
    return rows.select("k", at.cast("long").alias("pos"), "x").select("k", "pos", F.round(p, 6).alias("p_yes"))


@query("SELECT conv_id, turn, '<<system>>Answer briefly.<<end>><<user>>' || text || '<<end>><<assistant>>' AS chat FROM conversations")
def template_chat(spark, d):
    marks = {r: (f"<<{r}>>", "<<end>>") for r in ("system", "user")}
    chat = prompts.messages(F.lit("Answer briefly."), F.col("text"))
    return I.table(spark, d, "conversations").select("conv_id", "turn", prompts.render_template(chat, marks, "<<assistant>>").alias("chat"))
