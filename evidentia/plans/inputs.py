"""Stand-ins for the pipeline's inputs, derived from the driver tables, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evidence
from ..operators.scratch import pieces, small

ENDINGS = ("**Yes**", "No.", "True", "> *no*", "", "yes and then no", "Final answer: No", "_false_!", "Final answer: Yes\nno", "(Yes)", "maybe", "The answer is `True`.")
DISEASES = ((0, "Flag R"), (1, "Flag A, Genetic"), (2, "Flag N"))
FILTER = (("Flag R", 1), ("Flag A, Genetic", 0), ("Flag N", -1), ("Other", 7))
RELEVANCE = (("flag a", "selected_entity_1", "Anvil"), ("flag a", "selected_entity_10", "ring"), ("flag a", "selected_entity_2", "hot"), ("flag r, genetic", "selected_entity_1", "RED"), ("flag r, genetic", "selected_entity_2", "copper"), ("unmatched", "selected_entity_1", "bolt"))
PATHS = (("Flag R", 0, "red bolt (node) -> part_of (edge) -> Flag R (node)"), ("Flag R", 1, "hot rod (node) -> near (edge) -> Flag R (node)"), ("Flag Z", 0, "nowhere"))
QUERY_NAMES = ("Red Bolt, large", "Gland and duct", "hot ring and cold ring", "blue gizmo", "OLD ANVIL", "", "old", "new and used, maybe", "Large and small")


def quoted(x) -> str:
    if x is None:
        return "NULL"
    return str(x) if isinstance(x, (int, float)) else "'" + x.replace("'", "''") + "'"


def values(rows, names: str, alias: str) -> str:
    """An inline table in SQL."""
    body = ", ".join("(" + ", ".join(quoted(v) for v in r) + ")" for r in rows)
    return f"{alias}({names}) AS (VALUES {body})"


def inline(spark: SparkSession, rows, schema: str) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in rows], schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity, label, gold, score, ord): two real labels with tied scores, one with gaps, and one without positives."""
    t = table(spark, sf_dir, "labels").where("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL")
    d = F.col("doc_id")
    one = lambda name, gold, score: t.select(d.alias("entity"), F.lit(name).alias("label"), gold.cast("int").alias("gold"), score.alias("score"), d.alias("ord"))
    return (
        one("quality", F.col("quality"), ((d * 37 + 11) % 101 + 40 * F.col("quality")) / 200.0)
        .unionByName(one("toxic", F.col("toxic"), F.when(d % 11 != 0, ((d * 53 + 7) % 97 + 60 * F.col("toxic")) / 200.0)))
        .unionByName(one("rare", F.lit(0), (d % 10) / 10.0))
    )


CELLS = """cells AS (
    SELECT doc_id AS entity, 'quality' AS label, CAST(quality AS INT) AS gold, ((doc_id * 37 + 11) % 101 + 40 * quality) / 200.0 AS score, doc_id AS ord FROM labels
    UNION ALL SELECT doc_id, 'toxic', CAST(toxic AS INT), CASE WHEN doc_id % 11 <> 0 THEN ((doc_id * 53 + 7) % 97 + 60 * toxic) / 200.0 END, doc_id FROM labels
    UNION ALL SELECT doc_id, 'rare', 0, (doc_id % 10) / 10.0, doc_id FROM labels)"""


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated records over documents: (ord, instruction, input, output, label, disease, patient_id)."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    d = F.col("doc_id")
    ending = F.element_at(F.array(*map(F.lit, ENDINGS)), (d % len(ENDINGS) + 1).cast("int"))
    q = F.col("quality").cast("string")
    label = F.when(d % 13 == 0, F.concat(F.lit(" "), q, F.lit(" "))).when(d % 17 == 0, "1.0").when(d % 29 == 0, "2").when(d % 19 != 0, q)
    return docs.select(
        d.alias("ord"), F.concat(F.lit("\n  Judge document "), d.cast("string"), F.lit("\n\n")).alias("instruction"), F.concat(F.lit("\n### Input:\n\n"), "text", F.lit("\n")).alias("input"),
        F.concat("text", F.lit("\n\n"), ending, F.lit("\n")).alias("output"), label.alias("label"), F.when(d % 23 != 0, F.col("lang")).alias("disease"), d.alias("patient_id"),
    )


_ENDING = "list_extract([" + ", ".join(quoted(e) for e in ENDINGS) + f"], CAST(doc_id % {len(ENDINGS)} + 1 AS BIGINT))".replace("\\n", "\n")
_WS = r"^[\s\x0B\x1C-\x1E]+|[\s\x0B\x1C-\x1E]+$"
#: Conclusions in SQL: \pL\pN_ spells out a Unicode word boundary, which RE2 lacks.
RECORDS = f"""records AS (
    SELECT doc_id AS ord, chr(10) || '  Judge document ' || doc_id || chr(10) || chr(10) AS instruction, chr(10) || '### Input:' || chr(10) || chr(10) || text || chr(10) AS input,
           text || chr(10) || chr(10) || {_ENDING} || chr(10) AS output,
           CASE WHEN doc_id % 13 = 0 THEN ' ' || quality || ' ' WHEN doc_id % 17 = 0 THEN '1.0' WHEN doc_id % 29 = 0 THEN '2' WHEN doc_id % 19 <> 0 THEN CAST(quality AS VARCHAR) END AS label,
           CASE WHEN doc_id % 23 <> 0 THEN lang END AS disease, doc_id AS patient_id
    FROM documents JOIN labels USING (doc_id)),
lined AS (SELECT *, list_filter(list_transform(regexp_split_to_array(output, '\\r\\n|[\\n\\r\\x0B\\f]'), lambda x: regexp_replace(x, '{_WS}', '', 'g')), lambda x: x <> '')[-1] AS line FROM records),
worded AS (SELECT *, lower(regexp_extract(regexp_replace(regexp_replace(line, '^[>\\s`*_~"''()\\-–—]+', ''), '[\\s`*_~"''()\\-–—.!?]+$', ''), '(?i)(?:^|[^\\pL\\pN_])(yes|no|true|false)(?:$|[^\\pL\\pN_])', 1)) AS word FROM lined),
read AS (SELECT *, CASE WHEN word IN ('yes', 'true') THEN 'Yes' WHEN word IN ('no', 'false') THEN 'No' END AS conclusion,
                CASE WHEN regexp_matches(trim(label), '^[+-]?[0-9]+$') THEN TRY_CAST(trim(label) AS INT) END AS label_value FROM worded),
bucketed AS (SELECT *, CASE WHEN conclusion IS NULL OR label_value IS NULL OR label_value NOT IN (0, 1) THEN 'bad' WHEN (conclusion = 'Yes') = (label_value = 1) THEN 'kept' ELSE 'mismatch' END AS bucket FROM read)"""


def parts(spark: SparkSession, sf_dir: str, name: str = "lineitem") -> int:
    """Partitions for what has about a row for each of a table's (counted in the files' footers)."""
    return pieces(spark, table(spark, sf_dir, name).count())


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Knowledge graph: customers and suppliers in nations, nations in regions, customers in segments, parts from suppliers."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    supplier, part = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "part")
    customer = table(spark, sf_dir, "customer").repartition(parts(spark, sf_dir, "customer"), "c_custkey")
    # One shuffle by part serves the distinct pairs and the join; the scan keeps no rows.
    n = parts(spark, sf_dir)
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").repartition(n, "l_partkey").distinct()
    part = part.select("p_partkey", "p_name").repartition(n, "p_partkey")
    sellers = small(supplier.select("s_suppkey", "s_name"), 1_000_000)
    e = lambda df, xi, xn, rel, yi, yn, o: df.select(xi.cast("long").alias("x_index"), xn.alias("x_name"), F.lit(rel).alias("relation"), yi.cast("long").alias("y_index"), yn.alias("y_name"), o.cast("long").alias("ord"))
    c = F.col
    seg = F.ascii(F.substr("c_mktsegment", F.lit(1), F.lit(1)))
    return (
        e(nation.join(region, c("n_regionkey") == c("r_regionkey")), 100 + c("n_nationkey"), c("n_name"), "nation_in", c("r_regionkey"), c("r_name"), c("n_nationkey"))
        .unionByName(e(supplier.join(nation, c("s_nationkey") == c("n_nationkey")), 1000 + c("s_suppkey"), c("s_name"), "supplier_in", 100 + c("n_nationkey"), c("n_name"), 1000 + c("s_suppkey")))
        .unionByName(e(customer.join(nation, c("c_nationkey") == c("n_nationkey")), 10_000_000 + c("c_custkey"), c("c_name"), "customer_in", 100 + c("n_nationkey"), c("n_name"), 10_000_000 + c("c_custkey")))
        .unionByName(e(customer, 10_000_000 + c("c_custkey"), c("c_name"), "in_segment", 200 + seg, c("c_mktsegment"), 20_000_000 + c("c_custkey")))
        .unionByName(e(lines.join(part, c("l_partkey") == c("p_partkey")).join(sellers, c("l_suppkey") == c("s_suppkey")), 100_000_000 + c("p_partkey"), F.concat("p_name", F.lit(" #"), "p_partkey"), "supplied_by", 1000 + c("s_suppkey"), c("s_name"), 100_000_000 + c("p_partkey") * 100_000 + c("s_suppkey")))
    )


EDGES = """edges AS (
    SELECT 100 + n_nationkey AS x_index, n_name AS x_name, 'nation_in' AS relation, CAST(r_regionkey AS BIGINT) AS y_index, r_name AS y_name, CAST(n_nationkey AS BIGINT) AS ord FROM nation JOIN region ON n_regionkey = r_regionkey
    UNION ALL SELECT 1000 + s_suppkey, s_name, 'supplier_in', 100 + n_nationkey, n_name, 1000 + s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey
    UNION ALL SELECT 10000000 + c_custkey, c_name, 'customer_in', 100 + n_nationkey, n_name, 10000000 + c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey
    UNION ALL SELECT 10000000 + c_custkey, c_name, 'in_segment', 200 + ascii(c_mktsegment), c_mktsegment, 20000000 + c_custkey FROM customer
    UNION ALL SELECT 100000000 + p_partkey, p_name || ' #' || p_partkey, 'supplied_by', 1000 + s_suppkey, s_name, 100000000 + p_partkey * 100000 + s_suppkey
              FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey)"""


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity, pos, node_id): the distinct parts of each order, by part."""
    from pyspark.sql import Window

    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("entity"), F.col("l_partkey").alias("node_id")).repartition(parts(spark, sf_dir), "entity").distinct()
    return rows.select("entity", (F.row_number().over(Window.partitionBy("entity").orderBy("node_id")) - 1).alias("pos"), "node_id")


FEATURES = """features AS (SELECT entity, row_number() OVER (PARTITION BY entity ORDER BY node_id) - 1 AS pos, node_id FROM (SELECT DISTINCT l_orderkey AS entity, l_partkey AS node_id FROM lineitem)),
names AS (SELECT p_partkey AS node_id, p_name AS name FROM part),
lists AS (SELECT entity, list(name ORDER BY pos) AS names FROM features JOIN names USING (node_id) GROUP BY entity)"""


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node_id"), F.col("p_name").alias("name"))


def lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity, names) of :func:`features`."""
    n = parts(spark, sf_dir)
    return evidence.feature_lists(evidence.present_features(features(spark, sf_dir), names(spark, sf_dir), n), n)


def diseases(spark: SparkSession) -> DataFrame:
    return inline(spark, DISEASES, "label_idx int, disease string")


def positives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity, label_idx): the return flags of each order, from one number per flag."""
    flag = F.col("l_returnflag")
    idx = F.when(flag == "R", 0).when(flag == "A", 1).when(flag == "N", 2)
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("entity"), idx.alias("label_idx")).where("label_idx IS NOT NULL").repartition(parts(spark, sf_dir), "entity").distinct()


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("entity"))
