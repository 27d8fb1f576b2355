"""Queries over the driver tables, one or more for each operator, with independent DuckDB SQL."""

from __future__ import annotations

import random

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import models
from ..functions import conclusions, text, vectors
from ..operators import catalogue as names_
from ..operators import evidence, graph, linking, metrics, prompts, review, worklist
from ..operators.scratch import saved, small, spread
from ..sources import readers
from . import inputs as I

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *but: str) -> DataFrame:
    return df.select(*(F.round(c, 6).alias(c) if t == "double" and c not in but else F.col(c) for c, t in df.dtypes))


def long(df: DataFrame) -> DataFrame:
    return df.select(*(F.col(c).cast("long").alias(c) if t in ("int", "smallint") else F.col(c) for c, t in df.dtypes))


# ---------------------------------------------------------------- metrics

_CONFUSION = """counts AS (
    SELECT {by} count(*) AS support_total, count(*) FILTER (gold = 1) AS support_positive, count(*) FILTER (gold = 0) AS support_negative,
           count(*) FILTER (gold = 1 AND score > 0.5) AS tp, count(*) FILTER (gold = 0 AND score > 0.5) AS fp, count(*) FILTER (gold = 1 AND score <= 0.5) AS fn, count(*) FILTER (gold = 0 AND score <= 0.5) AS tn
    FROM used WHERE gold IS NOT NULL AND score IS NOT NULL {group}),
pairs AS (
    SELECT {pby} sum(CASE WHEN p.score > n.score THEN 1.0 WHEN p.score = n.score THEN 0.5 ELSE 0 END * p.c * n.c) / sum(p.c * n.c) AS auc
    FROM (SELECT {by} score, count(*) AS c FROM used WHERE gold = 1 AND score IS NOT NULL GROUP BY {by} score) p,
         (SELECT {by} score, count(*) AS c FROM used WHERE gold = 0 AND score IS NOT NULL GROUP BY {by} score) n {on} {pgroup}),
points AS (SELECT {by} score, sum(gold) AS pos, count(*) AS c FROM used WHERE score IS NOT NULL AND gold IS NOT NULL GROUP BY {by} score),
steps AS (SELECT a.*, (SELECT sum(b.pos) FROM points b WHERE b.score >= a.score {same}) AS tp, (SELECT sum(b.c) FROM points b WHERE b.score >= a.score {same}) AS k FROM points a),
ap AS (SELECT {by} coalesce(sum(pos * tp / k) / nullif(sum(pos), 0), 0) AS aupr FROM steps {group})"""
_BY = _CONFUSION.format(by="label,", group="GROUP BY label", pby="p.label,", on="WHERE p.label = n.label", pgroup="GROUP BY p.label", same="AND b.label = a.label")
_ALL = _CONFUSION.format(by="", group="", pby="", on="", pgroup="", same="")
_LABELS = """per_label AS (
    SELECT c.label, support_total, support_positive, support_negative, (tp + tn) / support_total AS acc,
           (coalesce(tp / nullif(tp + fn, 0), 0) + coalesce(tn / nullif(tn + fp, 0), 0)) / ((tp + fn > 0)::INT + (tn + fp > 0)::INT) AS bacc,
           auc, aupr, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1
    FROM counts c JOIN ap USING (label) LEFT JOIN pairs USING (label))"""
_METRIC_COLS = ", ".join(f"round({m}, 6) AS {m}" for m in metrics.METRICS)
_USED = "used AS (SELECT * FROM cells)"


def _per_label(cells: DataFrame) -> DataFrame:
    return rounded(metrics.per_label(cells).select("label", "support_total", "support_positive", "support_negative", *metrics.METRICS))


@query(f"WITH {I.CELLS}, {_USED}, {_BY}, {_LABELS} SELECT label, support_total, support_positive, support_negative, {_METRIC_COLS} FROM per_label")
def per_label_metrics(spark, d):
    return _per_label(I.cells(spark, d))


@query(f"WITH {I.CELLS}, {_USED}, {_BY}, {_LABELS} SELECT " + ", ".join(f"round(avg({m}), 6) AS macro_{m}" for m in metrics.METRICS) + " FROM per_label")
def macro_metrics(spark, d):
    return rounded(metrics.macro(metrics.per_label(I.cells(spark, d))))


@query(f"WITH {I.CELLS}, {_USED}, {_ALL} SELECT round((tp + tn) / support_total, 6) AS micro_acc, round(auc, 6) AS micro_auc, round(aupr, 6) AS micro_aupr, round((tp + tn) / support_total, 6) AS micro_f1 FROM counts, pairs, ap")
def micro_metrics(spark, d):
    return rounded(metrics.micro(I.cells(spark, d)))


@query(f"WITH {I.CELLS}, {_USED}, {_BY}, {_LABELS} SELECT label, support_total, round(auc, 6) AS auc FROM per_label")
def metrics_mask_cell(spark, d):
    return rounded(metrics.per_label(I.cells(spark, d)).select("label", "support_total", "auc"))


@query(f"WITH {I.CELLS}, used AS (SELECT * FROM cells WHERE entity IN (SELECT entity FROM cells GROUP BY entity HAVING count(score) = 3)), {_BY}, {_LABELS} SELECT label, support_total, support_positive, support_negative, {_METRIC_COLS} FROM per_label")
def metrics_drop_entity(spark, d):
    return _per_label(metrics.complete_entities(I.cells(spark, d), 3))


@query(f"WITH {I.CELLS}, e AS (SELECT entity, count(score) = 3 AS w FROM cells GROUP BY entity) SELECT count(*) AS entities, count(*) FILTER (w) AS scored, count(*) FILTER (NOT w) AS skipped FROM e")
def skipped_entities(spark, d):
    return metrics.skipped(I.cells(spark, d), 3)


@query(f"WITH {I.CELLS}, {_USED}, {_BY}, {_LABELS} SELECT round(avg(auc), 6) AS macro_auc_valid, count(auc) AS labels_with_auc FROM per_label")
def macro_auc_valid_only(spark, d):
    return rounded(metrics.curves(I.cells(spark, d), ["label"]).agg(F.avg("auc").alias("macro_auc_valid"), F.count("auc").alias("labels_with_auc")))


@query(f"WITH {I.CELLS}, {_USED}, {_BY}, {_LABELS} SELECT " + ", ".join(f"round(sum({m} * support_positive) FILTER ({m} IS NOT NULL AND support_positive > 0) / sum(support_positive) FILTER ({m} IS NOT NULL AND support_positive > 0), 6) AS weighted_{m}" for m in metrics.METRICS) + " FROM per_label")
def weighted_macro(spark, d):
    return rounded(metrics.macro_weighted(metrics.per_label(I.cells(spark, d)), "support_positive"))


@query(f"WITH {I.CELLS}, twice AS (SELECT * FROM cells UNION ALL SELECT entity, label, gold, score / 2, ord + 1000000 FROM cells WHERE entity % 3 = 0) SELECT entity, label, round(arg_max(struct_pack(s := score), ord).s, 6) AS score FROM twice GROUP BY entity, label")
def last_cell_wins(spark, d):
    c = I.cells(spark, d)
    twice = c.unionByName(c.where("entity % 3 = 0").withColumns({"score": F.col("score") / 2, "ord": F.col("ord") + 1000000}))
    return rounded(metrics.last_wins(twice, ["entity", "label"], "ord").select("entity", "label", "score"))


_INDEX = (("quality", 3), ("toxic", -1))
_FILTER_SQL = f"WITH {I.CELLS}, {I.values(_INDEX, 'label, idx', 'f')} SELECT label, count(*) AS n FROM cells WHERE label {{}} GROUP BY label"


def _filtered(spark, d, mode):
    index = I.inline(spark, _INDEX, "label string, index int")
    return metrics.keep_labels(I.cells(spark, d), index, mode).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query(_FILTER_SQL.format("NOT IN (SELECT label FROM f WHERE idx < 0)"))
def disease_filter_drop_neg(spark, d):
    return _filtered(spark, d, "drop_neg_only")


@query(_FILTER_SQL.format("IN (SELECT label FROM f WHERE idx >= 0)"))
def disease_filter_keep_nonneg(spark, d):
    return _filtered(spark, d, "keep_nonneg_only")


@query(_FILTER_SQL.format("IS NOT NULL"))
def disease_filter_none(spark, d):
    return _filtered(spark, d, "none")


@query(f"WITH {I.CELLS}, {I.values(_INDEX, 'label, idx', 'f')} SELECT DISTINCT label FROM cells WHERE label NOT IN (SELECT label FROM f WHERE idx >= 0)")
def dropped_labels(spark, d):
    c = I.cells(spark, d)
    return metrics.dropped_labels(c, metrics.keep_labels(c, I.inline(spark, _INDEX, "label string, index int"), "keep_nonneg_only"))


# ---------------------------------------------------------------- names and maps

_FILTERS = I.values(I.FILTER, "disease, kg_index", "f")


@query(f"WITH {I.values(I.DISEASES, 'label_idx, disease', 'l')}, {_FILTERS} SELECT CAST(label_idx AS BIGINT) AS label_idx, disease FROM l WHERE disease IN (SELECT disease FROM f WHERE kg_index >= 0)")
def allowed_labels(spark, d):
    return long(evidence.allowed_labels(I.diseases(spark), I.inline(spark, I.FILTER, "disease string, kg_index long")))


_WANTED = (("  nation_3 ",), ("NATION_11",), ("Nation_99",), ("nation_3",))


@query(f"WITH {I.values(_WANTED, 'name', 'w')}, k AS (SELECT name, lower(trim(name)) AS k FROM w) SELECT DISTINCT CAST(n_nationkey AS BIGINT) AS label_idx, n_name AS disease FROM nation JOIN k ON lower(n_name) = k")
def whitelist_resolve(spark, d):
    labels = I.table(spark, d, "nation").select(F.col("n_nationkey").alias("label_idx"), F.col("n_name").alias("disease"))
    return long(evidence.resolve_whitelist(labels, I.inline(spark, _WANTED, "name string"))[0])


@query(f"WITH {I.values(_WANTED, 'name', 'w')} SELECT name AS wanted FROM w WHERE lower(trim(name)) NOT IN (SELECT lower(n_name) FROM nation)")
def whitelist_unresolved(spark, d):
    labels = I.table(spark, d, "nation").select(F.col("n_nationkey").alias("label_idx"), F.col("n_name").alias("disease"))
    return evidence.resolve_whitelist(labels, I.inline(spark, _WANTED, "name string"))[1]


@query(f"WITH {I.EDGES}, p AS (SELECT x_name AS name, x_index AS i, 0 AS side, ord FROM edges UNION ALL SELECT y_name, y_index, 1, ord FROM edges) SELECT name, arg_max(i, side * 1000000000000000 + ord) AS kg_index FROM p WHERE trim(name) <> '' GROUP BY name")
def entity_catalogue(spark, d):
    return names_.entity_catalogue(I.edges(spark, d))


@query("SELECT r_name AS name, CAST(r_regionkey AS BIGINT) AS kg_index FROM region WHERE r_regionkey > 0")
def matched_positive(spark, d):
    rows = I.table(spark, d, "region").select(F.col("r_name").alias("name"), F.col("r_regionkey").cast("long").alias("kg_index"))
    return names_.positive_only(rows)


@query("""WITH lines AS (SELECT p_partkey AS line_no, p_partkey % 3 AS file_no, p_name || ' ' || p_size AS query, p_brand AS entity, CASE WHEN p_partkey % 7 = 0 THEN -1 ELSE p_size END AS kg_index FROM part)
    SELECT CAST(kg_index AS BIGINT) AS kg_index, arg_max(query, file_no * 1000000000 + line_no) AS query, arg_max(entity, file_no * 1000000000 + line_no) AS entity FROM lines WHERE kg_index <> -1 GROUP BY kg_index""")
def refined_map_last_wins(spark, d):
    part = I.table(spark, d, "part")
    index = F.when(F.col("p_partkey") % 7 == 0, -1).otherwise(F.col("p_size"))
    line = F.concat(F.lit("'"), "p_name", F.lit(" "), "p_size", F.lit("': ['"), "p_brand", F.lit("', "), index, F.lit("]"))
    lines = part.select((F.col("p_partkey") % 3).alias("f"), F.col("p_partkey").alias("line_no"), line.alias("line"))
    return names_.merge_maps(metrics.union_all([readers.refined_map(lines.where(F.col("f") == k), k) for k in range(3)]))


@query("""WITH m AS (SELECT p_name AS query, min(p_size) AS kg_index FROM part WHERE p_name NOT LIKE 'r%' GROUP BY p_name) SELECT DISTINCT part.p_name AS name, CAST(kg_index AS BIGINT) AS kg_index FROM part LEFT JOIN m ON p_name = query""")
def query_name_to_index(spark, d):
    part = I.table(spark, d, "part")
    merged = part.where("p_name NOT LIKE 'r%'").select(F.col("p_name").alias("query"), F.col("p_size").cast("long").alias("kg_index"))
    return names_.index_of_names(part.select(F.col("p_name").alias("name")).distinct(), merged)


_NAMES = I.values([(q,) for q in I.QUERY_NAMES], "query", "q")


@query(f"""WITH {_NAMES}, v AS (SELECT query, [query, CASE WHEN contains(query, ',') THEN trim(split_part(query, ',', 1)) END, CASE WHEN contains(lower(query), ' and ') THEN trim(split_part(query, 'and', 1)) END] AS a FROM q),
    u AS (SELECT query, unnest(a) AS variant, unnest(range(3)) AS i FROM v), f AS (SELECT query, variant, min(i) AS i FROM u WHERE variant <> '' GROUP BY query, variant)
    SELECT query, row_number() OVER (PARTITION BY query ORDER BY i) - 1 AS variant_pos, variant FROM f""")
def query_variants(spark, d):
    return long(names_.variants(I.inline(spark, [(q,) for q in I.QUERY_NAMES], "query string")))


@query(f"""WITH {I.values(I.DISEASES, 'label_idx, disease', 'l')}, {I.values(I.RELEVANCE, 'key, entity_key, name', 'r')}, {I.values(I.PATHS, 'pkey, pos, path', 'p')},
    k AS (SELECT *, trim(regexp_replace(regexp_replace(lower(trim(disease)), '\\b,?\\s*genetic\\b', '', 'g'), '[^a-z0-9]+', ' ', 'g')) AS nk FROM l),
    rk AS (SELECT *, trim(regexp_replace(regexp_replace(lower(trim(key)), '\\b,?\\s*genetic\\b', '', 'g'), '[^a-z0-9]+', ' ', 'g')) AS nk FROM r),
    pk AS (SELECT *, trim(regexp_replace(regexp_replace(lower(trim(pkey)), '\\b,?\\s*genetic\\b', '', 'g'), '[^a-z0-9]+', ' ', 'g')) AS nk FROM p)
    SELECT disease, (SELECT count(*) FROM rk WHERE rk.nk = k.nk) AS entities, (SELECT count(*) FROM pk WHERE pk.nk = k.nk) AS paths FROM k""")
def norm_key_match(spark, d):
    labels = I.diseases(spark)
    count = lambda rows, key, name: evidence.by_norm_key(labels, "disease", I.inline(spark, rows[0], rows[1]), key).groupBy("disease").agg(F.count(name).alias(name))
    r = count((I.RELEVANCE, "key string, entity_key string, entities string"), "key", "entities")
    p = count((I.PATHS, "pkey string, pos int, paths string"), "pkey", "paths")
    return r.join(p, "disease")


@query("SELECT p_partkey, lower(p_brand) || ' ' || p_size AS nk FROM (SELECT p_partkey, replace(p_brand, '#', ' ') AS p_brand, p_size FROM part)")
def norm_key_parts(spark, d):
    t = I.table(spark, d, "part")
    return t.select("p_partkey", text.norm_key(F.concat(F.lit("  "), "p_brand", F.lit(", Genetic -- "), "p_size")).alias("nk"))


# ---------------------------------------------------------------- model text

_CONV = "c AS (SELECT conv_id, turn, text || chr(10) || chr(10) || " + I._ENDING.replace("doc_id", "(conv_id * 7 + turn)") + " || chr(10) AS output FROM conversations)"
_ROUND = "[\\s*`_~''\"()\\[\\]{}<>\\-–—.!?:;]"


def _turns(spark, d):
    ending = F.element_at(F.array(*map(F.lit, I.ENDINGS)), ((F.col("conv_id") * 7 + F.col("turn")) % len(I.ENDINGS) + 1).cast("int"))
    return I.table(spark, d, "conversations").select("conv_id", "turn", F.concat("text", F.lit("\n\n"), ending, F.lit("\n")).alias("output"))


@query(f"WITH {I.RECORDS} SELECT ord, conclusion FROM read")
def conclusion_strict(spark, d):
    return I.records(spark, d).select("ord", conclusions.strict(F.col("output")).alias("conclusion"))


_LINE = f"lines AS (SELECT conv_id, turn, output, list_filter(list_transform(regexp_split_to_array(output, '\\r\\n|[\\n\\r\\x0B\\f]'), lambda x: regexp_replace(x, '{I._WS}', '', 'g')), lambda x: x <> '')[-1] AS line FROM c)"
_CHARS = "*`_~'\"()[]{}<>-–—.!?:;"


@query(f"WITH {_CONV}, {_LINE}, t AS (SELECT *, lower(trim(line, {I.quoted(_CHARS)})) AS t FROM lines) SELECT conv_id, turn, CASE t WHEN 'yes' THEN 'Yes' WHEN 'no' THEN 'No' END AS conclusion, CAST(CASE t WHEN 'true' THEN 1 WHEN 'false' THEN 0 END AS BIGINT) AS truth, line AS last_line FROM t")
def conclusion_exact(spark, d):
    o = F.col("output")
    return long(_turns(spark, d).select("conv_id", "turn", conclusions.exact(o).alias("conclusion"), conclusions.exact_truth(o).alias("truth"), text.last_line(o).alias("last_line")))


def _any(words: str) -> str:
    b = "[^\\pL\\pN_]"
    return f"lower(coalesce(nullif(regexp_extract(output, '(?i)Final answer:\\s*({words})(?:$|{b})', 1), ''), regexp_extract_all(regexp_replace(output, '({b})', '\\1\\1', 'g'), '(?i)(?:^|{b})({words})(?:$|{b})', 1)[-1]))"


@query(f"WITH {_CONV}, t AS (SELECT *, {_any('yes|no')} AS y, {_any('true|false')} AS f FROM c) SELECT conv_id, turn, CASE y WHEN 'yes' THEN 'Yes' WHEN 'no' THEN 'No' END AS conclusion, CAST(CASE f WHEN 'true' THEN 1 WHEN 'false' THEN 0 END AS BIGINT) AS truth FROM t")
def conclusion_anywhere(spark, d):
    o = F.col("output")
    return long(_turns(spark, d).select("conv_id", "turn", conclusions.anywhere(o).alias("conclusion"), conclusions.anywhere_truth(o).alias("truth")))


_RAW = (("1",), (" 0 ",), ("1.0",), ("true",), ("",), (None,), ("2",), ("+1",), ("-3",), ("1 2",), ("99999999999",))


@query(f"WITH {I.values(_RAW, 'raw', 'r')} SELECT raw, CAST(CASE WHEN regexp_matches(trim(raw), '^[+-]?[0-9]+$') THEN TRY_CAST(trim(raw) AS INT) END AS BIGINT) AS label FROM r")
def label_normalise(spark, d):
    return I.inline(spark, _RAW, "raw string").select("raw", text.label_int(F.col("raw"), "string").cast("long").alias("label"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, CAST(trunc(l_discount * 20 - 0.5) AS BIGINT) AS label FROM lineitem")
def label_normalise_number(spark, d):
    t = I.table(spark, d, "lineitem")
    return t.select("l_orderkey", "l_linenumber", "l_partkey", text.label_int(F.col("l_discount") * 20 - 0.5, "double").cast("long").alias("label"))


_EDGE = "regexp_replace(regexp_replace({}, '^\\s*\\n+', ''), '\\n+\\s*$', '')"
_CLEAN = "regexp_replace(regexp_replace({}, '^[ \\t]+', ''), '\\r+$', '')"


def _clean_sql(c: str, header: str | None = None) -> str:
    s = _EDGE.format(c)
    if header:
        s = f"regexp_replace({s}, '(?i)^\\s*#{{0,6}}\\s*{header}\\s*:?\\s*\\n+', '')"
    return _CLEAN.format(_EDGE.format(s))


@query(f"WITH {I.RECORDS} SELECT ord, sha256({_clean_sql('instruction')}) AS instruction, sha256({_clean_sql('input', 'input')}) AS input, sha256({_clean_sql('output', 'output')}) AS output FROM records")
def clean_fields(spark, d):
    sha = lambda c: F.sha2(c, 256)
    return I.records(spark, d).select("ord", sha(text.clean_field(F.col("instruction"))).alias("instruction"), sha(text.clean_field(F.col("input"), "input")).alias("input"), sha(text.clean_field(F.col("output"), "output")).alias("output"))


@query(f"WITH {I.RECORDS} SELECT ord, CAST(label_value AS BIGINT) AS label_value, bucket FROM bucketed")
def three_way_filter(spark, d):
    return long(review.bucketed(I.records(spark, d)).select("ord", "label_value", "bucket"))


@query(f"WITH {I.RECORDS} SELECT count(*) AS total, count(*) FILTER (bucket = 'kept') AS kept, count(*) FILTER (bucket = 'mismatch') AS mismatch, count(*) FILTER (bucket = 'bad') AS bad, count(*) FILTER (conclusion IS NULL) AS unparsed FROM bucketed")
def filter_stats(spark, d):
    return review.totals(review.bucketed(I.records(spark, d)))


@query(f"WITH {I.RECORDS} SELECT ord, {_clean_sql('instruction')} || chr(10) || {I.quoted(review.CLOSING)} AS instruction, sha256({_clean_sql('input', 'input')}) AS input, sha256({_clean_sql('output', 'output')}) AS output FROM bucketed WHERE bucket = 'kept'")
def alpaca_records(spark, d):
    return review.training_rows(review.bucketed(I.records(spark, d))).withColumns({c: F.sha2(c, 256) for c in ("input", "output")})


@query(f"WITH {I.RECORDS} SELECT CAST(label_value AS BIGINT) AS label, count(*) AS total, count(*) FILTER (bucket = 'mismatch') AS mismatches, round(100.0 * count(*) FILTER (bucket = 'mismatch') / count(*), 6) AS percent FROM bucketed WHERE bucket <> 'bad' GROUP BY label_value")
def mismatch_by_label(spark, d):
    return long(rounded(review.mismatch_by_label(review.bucketed(I.records(spark, d)))))


@query(f"WITH {I.RECORDS} SELECT coalesce(disease, '<unknown>') AS disease, count(*) AS n, count(*) FILTER (bucket <> 'bad') AS n_valid, round(avg(CASE WHEN bucket <> 'bad' THEN (bucket = 'kept')::INT END), 6) AS accuracy, round((avg(CASE WHEN label_value = 0 AND bucket <> 'bad' THEN (conclusion = 'No')::INT END) + avg(CASE WHEN label_value = 1 AND bucket <> 'bad' THEN (conclusion = 'Yes')::INT END)) / 2, 6) AS auc FROM bucketed GROUP BY 1")
def per_disease_accuracy(spark, d):
    return rounded(review.accuracy_by_disease(review.bucketed(I.records(spark, d))))


@query("""WITH t AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'x <START> ' || text || ' <End> y' WHEN 1 THEN '<end>' || text || '<start>' WHEN 2 THEN '  ' ELSE text END AS s FROM documents),
    p AS (SELECT doc_id, regexp_replace(s, '^\\s+|\\s+$', '', 'g') AS s FROM t), q AS (SELECT *, instr(lower(s), '<start>') AS a, instr(lower(s), '<end>') AS b FROM p)
    SELECT doc_id, sha256(CASE WHEN a > 0 AND b > a THEN regexp_replace(substr(s, a + 7, b - a - 7), '^\\s+|\\s+$', '', 'g') ELSE nullif(s, '') END) AS inner_sha256 FROM q""")
def marker_extract(spark, d):
    k = F.col("doc_id") % 4
    s = F.when(k == 0, F.concat(F.lit("x <START> "), "text", F.lit(" <End> y"))).when(k == 1, F.concat(F.lit("<end>"), "text", F.lit("<start>"))).when(k == 2, "  ").otherwise(F.col("text"))
    return I.table(spark, d, "documents").select("doc_id", F.sha2(text.between_markers(s), 256).alias("inner_sha256"))


@query("SELECT DISTINCT source, lang, regexp_replace(regexp_replace('  ' || source || ' / (' || lang || ')!', '[^\\w\\-]+', '_', 'g'), '^_+|_+$', '', 'g') AS safe FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL")
def file_safe_names(spark, d):
    return I.table(spark, d, "documents").where("source IS NOT NULL AND lang IS NOT NULL").select("source", "lang", text.file_safe(F.concat(F.lit("  "), "source", F.lit(" / ("), "lang", F.lit(")!"))).alias("safe")).distinct()


# ---------------------------------------------------------------- evidence


@query(f"WITH {I.FEATURES} SELECT entity, count(*) AS n, string_agg(node_id, ',' ORDER BY pos) AS ids FROM features GROUP BY entity")
def hyperedges(spark, d):
    lists = I.features(spark, d).groupBy("entity").agg(F.array_sort(F.collect_list(F.struct("pos", "node_id"))).alias("x"))
    return lists.select("entity", F.size("x").cast("long").alias("n"), F.array_join(F.transform("x", lambda v: v["node_id"].cast("string")), ",").alias("ids"))


@query("SELECT o_orderkey AS entity, CASE WHEN o_orderkey % 4 = 3 THEN '' ELSE concat_ws(',', CASE WHEN o_orderkey % 2 = 1 THEN 0 END, CASE WHEN o_orderkey % 3 = 0 THEN 1 END, CASE WHEN o_orderkey % 5 = 0 THEN 2 END) END AS ids FROM orders")
def indicator_positions(spark, d):
    k = F.col("o_orderkey")
    bit = lambda c: c.cast("int").cast("string")
    line = F.when(k % 4 == 3, " ").otherwise(F.concat_ws(", ", bit(k % 2 == 1), bit(k % 3 == 0), bit(k % 5 == 0)))
    lines = I.table(spark, d, "orders").select(k.alias("line_no"), line.alias("line"))
    return readers.indicator_positions(lines).select("entity", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


@query("SELECT e, CAST(sum(v) AS BIGINT) AS total, count(*) AS n FROM (SELECT event_id AS e, unnest(regexp_extract_all(props, '[0-9]+'))::BIGINT AS v FROM events) GROUP BY e")
def digit_lists(spark, d):
    lines = I.table(spark, d, "events").select(F.col("event_id").alias("line_no"), F.col("props").alias("line"))
    lists = readers.digit_lists(lines).where(F.size("ids") > 0)
    return lists.select(F.col("entity").alias("e"), F.aggregate("ids", F.lit(0).cast("long"), lambda s, x: s + x).alias("total"), F.size("ids").cast("long").alias("n"))


@query(f"WITH {I.FEATURES} SELECT entity, CAST(pos AS BIGINT) AS pos, node_id, name FROM features JOIN names USING (node_id)")
def present_features(spark, d):
    return long(evidence.present_features(I.features(spark, d), I.names(spark, d)))


@query(f"WITH {I.FEATURES} SELECT o_orderkey AS entity, count(*) AS absent, CAST(sum(node_id) AS BIGINT) AS id_sum FROM orders, names n WHERE NOT EXISTS (SELECT 1 FROM features f WHERE f.entity = o_orderkey AND f.node_id = n.node_id) GROUP BY o_orderkey")
def absent_features(spark, d):
    return long(evidence.absent_totals(I.entities(spark, d), I.features(spark, d), I.names(spark, d), I.parts(spark, d)))


_ALLOWED = (("  Hot   RING",), ("cold anvil",), ("nothing",))


@query(f"WITH {I.FEATURES}, {I.values(_ALLOWED, 'name', 'a')} SELECT entity, node_id, name FROM features JOIN names USING (node_id) WHERE name IN (SELECT lower(trim(regexp_replace(name, '\\s+', ' ', 'g'))) FROM a)")
def name_gate(spark, d):
    named = evidence.present_features(I.features(spark, d), I.names(spark, d)).select("entity", "node_id", "name")
    return evidence.name_gate(named, I.inline(spark, _ALLOWED, "name string"))


_ENTITIES = ("Anvil", "RING", "copper", "hot r")
_ENT_SQL = "[" + ", ".join(I.quoted(e) for e in _ENTITIES) + "]"
_HAS = "len(list_filter(names, lambda f: contains(lower(f), lower(e)))) > 0"


@query(f"WITH {I.FEATURES} SELECT entity, array_to_string(list_filter({_ENT_SQL}, lambda e: {_HAS}), '|') AS present, array_to_string(list_filter({_ENT_SQL}, lambda e: NOT ({_HAS})), '|') AS absent FROM lists")
def relevance_partition(spark, d):
    lists = I.lists(spark, d)
    present, absent = evidence.relevance_partition(F.col("names"), F.array(*map(F.lit, _ENTITIES)))
    return lists.select("entity", F.array_join(present, "|").alias("present"), F.array_join(absent, "|").alias("absent"))


_GOLD = "pos AS (SELECT DISTINCT l_orderkey AS entity, CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 WHEN 'N' THEN 2 END AS label_idx FROM lineitem)"


@query(f"WITH {_GOLD}, {I.values(I.DISEASES, 'label_idx, disease', 'l')} SELECT o_orderkey AS entity, CAST(l.label_idx AS BIGINT) AS label_idx, disease, CAST(pos.entity IS NOT NULL AS BIGINT) AS gold FROM orders CROSS JOIN l LEFT JOIN pos ON pos.entity = o_orderkey AND pos.label_idx = l.label_idx")
def gold_labels(spark, d):
    return long(evidence.gold_labels(I.entities(spark, d), I.diseases(spark), I.positives(spark, d), I.parts(spark, d)))


# ---------------------------------------------------------------- worklists

_NK = "trim(regexp_replace(regexp_replace(lower(trim(disease)), '\\b,?\\s*genetic\\b', '', 'g'), '[^a-z0-9]+', ' ', 'g'))"
_WORK = f"{I.values(I.DISEASES, 'label_idx, disease', 'l')}, w AS (SELECT o_orderkey AS entity, CAST(label_idx AS BIGINT) AS label_idx, disease, row_number() OVER (ORDER BY o_orderkey, {_NK}, label_idx) - 1 AS ord FROM orders, l)"


def _work(spark, d):
    return long(worklist.graph_worklist(I.entities(spark, d), I.diseases(spark)))


@query(f"WITH {_WORK} SELECT * FROM w")
def worklist_graph(spark, d):
    return _work(spark, d)


@query("SELECT doc_id AS patient_id, disease, CAST(label AS BIGINT) AS label FROM (SELECT doc_id, unnest(['quality', 'toxic']) AS disease, unnest([quality, toxic]) AS label FROM labels)")
def worklist_csv(spark, d):
    rows = I.table(spark, d, "labels").select(F.col("doc_id").alias("patient_id"), "quality", "toxic")
    return long(worklist.csv_worklist(rows, []))


@query(f"WITH {_WORK} SELECT * FROM w WHERE ord >= 5 AND entity IN (SELECT DISTINCT entity FROM w WHERE ord >= 5 ORDER BY entity LIMIT 7)")
def first_n_patients(spark, d):
    return worklist.first_entities(_work(spark, d), 7, 5)


@query(f"WITH {_WORK} SELECT * FROM w WHERE ord >= 100 AND ord < 250")
def slice_worklist(spark, d):
    return worklist.piece(_work(spark, d), 100, 250)


def _drawn() -> str:
    """The places that Python's generator draws from n ids in order, for the sizes of the driver's customer tables."""
    return ", ".join(f"({n}, {k})" for n in (150, 1500, 15000) for k in random.Random(42).sample(range(n), n // 10))


@query(f"""WITH drawn(n, k) AS (VALUES {_drawn()}), placed AS (SELECT c_custkey, c_name, row_number() OVER (ORDER BY CAST(c_custkey AS VARCHAR)) - 1 AS k, count(*) OVER () AS n FROM customer)
    SELECT c_custkey, c_name FROM placed JOIN drawn USING (n, k)""")
def seeded_sample(spark, d):
    rows = I.table(spark, d, "customer").select("c_custkey", "c_name")
    total = rows.count()
    return worklist.seeded_sample(rows, "c_custkey", worklist.sample_size(total, 0.1, total), 42)


#: Distinct names that one array may hold.
MOST_NAMES = 10_000


@query()
def absent_shuffled(spark, d):
    names = I.names(spark, d).groupBy("name").agg(F.min("node_id").alias("least"))
    if names.limit(MOST_NAMES + 1).count() > MOST_NAMES:
        raise ValueError(f"over {MOST_NAMES} distinct names do not go into one array")
    whole = names.agg(F.transform(F.array_sort(F.collect_list(F.struct("least", "name"))), lambda x: x["name"]).alias("whole"))
    lists = I.lists(spark, d)
    absent = evidence.absent_array(F.col("names"), F.col("whole"))
    return worklist.shuffled_cut(lists.crossJoin(F.broadcast(whole)).select("entity", absent.alias("names")), most=20).select("entity", F.array_join("names", ", ").alias("absent"))


# ---------------------------------------------------------------- prompts

_REL = """rel AS (SELECT trim(regexp_replace(regexp_replace(lower(trim(key)), '\\b,?\\s*genetic\\b', '', 'g'), '[^a-z0-9]+', ' ', 'g')) AS nk, list(name ORDER BY entity_key) AS ents FROM r GROUP BY 1),
pth AS (SELECT trim(regexp_replace(regexp_replace(lower(trim(pkey)), '\\b,?\\s*genetic\\b', '', 'g'), '[^a-z0-9]+', ' ', 'g')) AS nk, list(path ORDER BY pos) AS paths FROM p GROUP BY 1)"""
_ROWS = f"""{_GOLD}, {I.FEATURES}, {I.values(I.DISEASES, 'label_idx, disease', 'l')}, {I.values(I.RELEVANCE, 'key, entity_key, name', 'r')}, {I.values(I.PATHS, 'pkey, pos, path', 'p')}, {_REL},
x AS (SELECT o_orderkey AS entity, l.label_idx, l.disease, coalesce(lists.names, []) AS names, coalesce(rel.ents, []) AS ents, coalesce(pth.paths, []) AS paths, CAST(pos.entity IS NOT NULL AS BIGINT) AS gold
      FROM orders CROSS JOIN l LEFT JOIN lists ON lists.entity = o_orderkey LEFT JOIN rel ON rel.nk = {_NK} LEFT JOIN pth ON pth.nk = {_NK} LEFT JOIN pos ON pos.entity = o_orderkey AND pos.label_idx = l.label_idx WHERE l.label_idx < 2),
y AS (SELECT *, list_filter(ents, lambda e: {_HAS}) AS have, list_filter(ents, lambda e: NOT ({_HAS})) AS lack FROM x)"""


def _j(a: str, sep: str) -> str:
    return f"(CASE WHEN len({a}) > 0 THEN array_to_string({a}, '{sep}') ELSE '(none)' END)"


def _prompt_sql(sep: str, gap: str) -> str:
    n = "chr(10)"
    line = lambda label, a: f"'{label}' || {_j(a, sep)} || {n} || {n}"
    return f"'### Input:' || {n} || 'Disease to be verified: ' || disease || {n} || {n} || {line('diagnostic_features_present: ' + gap, 'names')} || {line('potentially_relevant_present_features: ', 'have')} || {line('potentially_relevant_absent_features: ', 'lack')} || 'Reasoning Paths:' || {n} || (CASE WHEN len(paths) > 0 THEN array_to_string(list_transform(paths, lambda p: '- ' || p), {n}) ELSE '(none)' END) || {n} || {n}"


def evidence_rows(spark: SparkSession, d: str) -> DataFrame:
    """One row per order and allowed label with all evidence: the pipeline's central plan."""
    lists = I.lists(spark, d)
    labels = evidence.allowed_labels(I.diseases(spark), I.inline(spark, I.FILTER, "disease string, kg_index long"))
    rel = I.inline(spark, I.RELEVANCE, "key string, entity_key string, name string").groupBy(text.norm_key(F.col("key")).alias("nk")).agg(F.transform(F.array_sort(F.collect_list(F.struct("entity_key", "name"))), lambda x: x["name"]).alias("ents"))
    pth = I.inline(spark, I.PATHS, "pkey string, pos int, path string").groupBy(text.norm_key(F.col("pkey")).alias("nk")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "path"))), lambda x: x["path"]).alias("paths"))
    by_label = labels.withColumn("nk", text.norm_key(F.col("disease"))).join(rel, "nk", "left").join(pth, "nk", "left").drop("nk")
    none = F.array().cast("array<string>")
    rows = evidence.gold_labels(I.entities(spark, d), by_label, I.positives(spark, d), I.parts(spark, d)).join(lists, "entity", "left")
    rows = rows.withColumns({c: F.coalesce(c, none) for c in ("names", "ents", "paths")})
    have, lack = evidence.relevance_partition(F.col("names"), F.col("ents"))
    return rows.withColumns({"have": have, "lack": lack})


@query(f"WITH {_ROWS} SELECT entity, CAST(label_idx AS BIGINT) AS label_idx, gold, {_prompt_sql('; ', '')} || 'Answer: ' || (CASE gold WHEN 1 THEN '**True**' ELSE '**False**' END) || chr(10) AS prompt FROM y")
def prompt_rows(spark, d):
    rows = evidence_rows(spark, d)
    c = F.col
    return long(rows.select("entity", "label_idx", "gold", prompts.generation_input(c("disease"), c("names"), c("have"), c("lack"), prompts.answer(c("gold")), c("paths")).alias("prompt")))


@query(f"WITH {_ROWS} SELECT entity, CAST(label_idx AS BIGINT) AS label_idx, gold, {_prompt_sql(', ', ' ')} AS prompt, {I.quoted(prompts.SYSTEM['default'])} AS instruction FROM y")
def eval_rows(spark, d):
    rows = evidence_rows(spark, d)
    c = F.col
    return long(rows.select("entity", "label_idx", "gold", prompts.evaluation_input(c("disease"), c("names"), c("have"), c("lack"), c("paths")).alias("prompt"), prompts.instruction(c("disease")).alias("instruction")))


@query(f"WITH {I.FEATURES} SELECT entity, '### Input:' || chr(10) || 'Patient features present: ' || {_j('names', ', ')} || chr(10) || 'Disease to be verified: X' || chr(10) AS prompt, 'System: Verify X.' || chr(10) || {I.quoted(prompts.CLOSING)} || chr(10) || 'User: hello' || chr(10) || 'Assistant: ' AS chat FROM lists")
def presence_prompts(spark, d):
    lists = I.lists(spark, d)
    x = F.lit("X")
    chat = prompts.messages(prompts.instruction(x, custom="Verify {disease}."), F.lit("hello"))
    return lists.select("entity", prompts.presence_input(x, F.col("names")).alias("prompt"), prompts.render(chat).alias("chat"))


# ---------------------------------------------------------------- graph

_UND = "und AS (SELECT x_name AS src, y_name AS dst FROM edges UNION SELECT y_name, x_name FROM edges)"


@query(f"WITH {I.EDGES}, {_UND} SELECT src, count(*) AS degree, min(dst) AS least FROM und GROUP BY src")
def kg_edges_undirected(spark, d):
    return graph.undirected(I.edges(spark, d), parts=2 * I.parts(spark, d)).groupBy("src").agg(F.count(F.lit(1)).alias("degree"), F.min("dst").alias("least"))


_DIRECTED = f"""{I.EDGES}, de AS (SELECT DISTINCT x_index AS src, y_index AS dst FROM edges),
walks AS (SELECT a.src AS source, a.dst AS node, [a.src, a.dst] AS path FROM de a
          UNION ALL SELECT a.src, b.dst, [a.src, a.dst, b.dst] FROM de a JOIN de b ON a.dst = b.src
          UNION ALL SELECT a.src, c.dst, [a.src, a.dst, b.dst, c.dst] FROM de a JOIN de b ON a.dst = b.src JOIN de c ON b.dst = c.src),
found AS (SELECT source, node, min(struct_pack(n := len(path), p := path)) AS m FROM walks WHERE node < 100 GROUP BY source, node),
short AS (SELECT source, node, m.p AS path FROM found)"""


def _to_regions(spark, d):
    e = I.edges(spark, d)
    starts = e.select(F.col("x_index").alias("source"))
    targets = I.table(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("node"))
    return graph.paths_to_targets(e.select(F.col("x_index").alias("src"), F.col("y_index").alias("dst")), starts, targets, 3, I.parts(spark, d))


@query(f"WITH {_DIRECTED} SELECT source, node, array_to_string(path, '>') AS path, CAST(len(path) - 1 AS BIGINT) AS depth FROM short")
def bfs_directed_depth3(spark, d):
    return long(_to_regions(spark, d).select("source", "node", F.array_join(F.col("path").cast("array<string>"), ">").alias("path"), "depth"))


_SHORTEST = f"""{I.EDGES}, ue AS (SELECT x_name AS src, y_name AS dst FROM edges UNION SELECT y_name, x_name FROM edges),
r AS (SELECT r_name AS source, r_name AS node, [r_name] AS path, 0 AS depth FROM region
      UNION ALL SELECT source, dst, min(list_append(path, dst)), depth + 1 FROM r JOIN ue ON node = src WHERE depth < 5 GROUP BY source, dst, depth),
short AS (SELECT source, node, arg_min(path, depth) AS path, min(depth) AS depth FROM r WHERE node IN (SELECT s_name FROM supplier) GROUP BY source, node)"""


def _from_regions(spark, d):
    e = graph.both_ways(I.edges(spark, d))
    sources = I.table(spark, d, "region").select(F.col("r_name").alias("source"))
    return graph.shortest_paths(e, sources, I.table(spark, d, "supplier").select(F.col("s_name").alias("node")), back=2, parts=2 * I.parts(spark, d))


@query(f"WITH RECURSIVE {_SHORTEST} SELECT source, node, array_to_string(path, '>') AS path, CAST(depth AS BIGINT) AS depth FROM short")
def shortest_path_undirected(spark, d):
    return long(_from_regions(spark, d).select("source", "node", F.array_join("path", ">").alias("path"), "depth"))


@query(f"""WITH RECURSIVE {_SHORTEST}, rel AS (SELECT src, dst, arg_min(relation, ord) AS relation FROM (SELECT x_name AS src, y_name AS dst, relation, ord FROM edges UNION ALL SELECT y_name, x_name, relation, ord FROM edges) GROUP BY src, dst),
    st AS (SELECT source, node, unnest(range(1, len(path))) AS i, path FROM short), pt AS (SELECT source, node, i, path[i] AS a, path[i + 1] AS b FROM st)
    SELECT source, node, string_agg(CASE WHEN i = 1 THEN a || ' (node) -> ' ELSE '' END || coalesce(relation, 'unknown_relation') || ' (edge) -> ' || b || ' (node)', ' -> ' ORDER BY i) AS rendered FROM pt LEFT JOIN rel ON rel.src = a AND rel.dst = b GROUP BY source, node""")
def path_render_disease(spark, d):
    paths = saved(_from_regions(spark, d).select(F.struct("source", "node").alias("path_id"), "path"), "paths")
    out = graph.render_by_name(paths, graph.relation_either(I.edges(spark, d), graph.steps_of(paths), I.parts(spark, d)))
    return out.select("path_id.source", "path_id.node", "rendered")


_PATIENT = f"""{_DIRECTED}, rel AS (SELECT src, dst, arg_min(relation, prio * 1000000000000000 + ord) AS relation FROM (SELECT x_index AS src, y_index AS dst, relation, ord, 0 AS prio FROM edges UNION ALL SELECT y_index, x_index, relation, ord, 1 FROM edges) GROUP BY src, dst),
nm AS (SELECT x_index AS node, arg_min(x_name, ord) AS name FROM edges GROUP BY x_index), st AS (SELECT source, node, unnest(range(1, len(path))) AS i, path FROM short), pt AS (SELECT source, node, i, len(path) - 1 AS n, path[i] AS a, path[i + 1] AS b FROM st),
rendered AS (SELECT source, pt.node, string_agg(CASE WHEN i = 1 THEN 'q' || a || '(node)' ELSE '' END || '->' || coalesce(relation, '') || '(edge)->' || (CASE WHEN i = n THEN 'q' || b ELSE coalesce(nb.name, '') END) || '(node)', '' ORDER BY i) AS rendered
             FROM pt LEFT JOIN rel ON rel.src = a AND rel.dst = b LEFT JOIN nm nb ON nb.node = b GROUP BY source, pt.node)"""


def _patient_style(spark, d):
    e, n = I.edges(spark, d), 2 * I.parts(spark, d)
    paths = saved(_to_regions(spark, d).select(F.struct("source", "node").alias("path_id"), "path"), "paths")
    ends = spread(e.select(F.col("x_index").alias("node")).unionByName(e.select(F.col("y_index").alias("node"))), n, "node").distinct()
    queries = ends.select("node", F.concat(F.lit("q"), "node").alias("query"))
    out = graph.render_by_index(paths, graph.relation_directed(e, n), graph.node_names(e, n), queries, n)
    return out.select("path_id.source", "path_id.node", "rendered")


@query(f"WITH {_PATIENT} SELECT * FROM rendered")
def path_render_patient(spark, d):
    return _patient_style(spark, d)


@query(f"""WITH {_PATIENT}, ends AS (SELECT DISTINCT x_index % 50 AS patient, r_name AS disease, CAST(r_regionkey AS BIGINT) AS node FROM edges, region),
    p AS (SELECT source % 50 AS patient, node, len(regexp_extract_all(rendered, '\\(edge\\)')) AS len FROM rendered)
    SELECT round(count(*) / (SELECT count(DISTINCT patient) FROM ends), 6) AS paths_per_patient, round(sum(len) / count(*), 6) AS path_length, round(count(*) / (SELECT count(*) FROM ends), 6) AS paths_per_endpoint FROM p""")
def path_stats(spark, d):
    region = I.table(spark, d, "region").select(F.col("r_name").alias("disease"), F.col("r_regionkey").cast("long").alias("node"))
    patients = I.edges(spark, d).select((F.col("x_index") % 50).alias("patient")).distinct()
    paths = _patient_style(spark, d).withColumn("patient", F.col("source") % 50).join(small(region), "node")
    return rounded(graph.path_statistics(paths, patients.crossJoin(small(region)).select("patient", "disease")))


@query("SELECT c_mktsegment AS seg, row_number() OVER (PARTITION BY c_mktsegment ORDER BY first_at, c_nationkey) AS pos, CAST(c_nationkey AS BIGINT) AS nation FROM (SELECT c_mktsegment, c_nationkey, min(c_custkey) AS first_at FROM customer GROUP BY 1, 2)")
def distinct_in_order(spark, d):
    rows = I.table(spark, d, "customer").select(F.col("c_mktsegment").alias("seg"), F.col("c_nationkey").alias("nation"), "c_custkey")
    return long(graph.distinct_in_order(rows, "seg", "nation", "c_custkey"))


# ---------------------------------------------------------------- linking

_TERMS = tuple((q,) for q in I.QUERY_NAMES if q) + (("BLUE ring",), ("red",), ("zz",))
_NODES = "nodes AS (SELECT p_name AS name, min(p_partkey) AS ord FROM part GROUP BY p_name)"
_T = I.values(_TERMS, "term", "t")


def _nodes(spark, d):
    return I.table(spark, d, "part").groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("ord"))


@query(f"WITH {_NODES}, {_T} SELECT term, name AS node, CASE WHEN term = name THEN 'exact' ELSE 'exact(case-insensitive)' END AS why FROM t JOIN nodes ON lower(term) = lower(name)")
def exact_ci_match(spark, d):
    return linking.exact_or_case(I.inline(spark, _TERMS, "term string"), _nodes(spark, d))


@query(f"WITH {_NODES}, {_T} SELECT term, name AS node FROM t JOIN nodes ON starts_with(lower(name), lower(term) || ' ') OR starts_with(lower(name), lower(term) || ',')")
def prefix_match(spark, d):
    return linking.prefix_matches(I.inline(spark, _TERMS, "term string"), _nodes(spark, d)).select("term", "node")


_SIM = "s AS (SELECT q.vec_id AS query_id, n.vec_id AS node_id, list_cosine_similarity(q.embedding::DOUBLE[], n.embedding::DOUBLE[]) AS sim FROM embeddings q, embeddings n WHERE q.vec_id % 20 = 0), top AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 12) DESC, node_id) AS rank, node_id, sim FROM s)"


def _similar(spark, d, k):
    e = I.table(spark, d, "embeddings").where("embedding IS NOT NULL")
    return linking.top_k(e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), e.select(F.col("vec_id").alias("node_id"), "embedding"), k)


@query(f"WITH {_SIM} SELECT query_id, rank, node_id FROM top WHERE rank <= 3")
def topk_similarity(spark, d):
    return long(_similar(spark, d, 3).select("query_id", "rank", "node_id"))


@query(f"WITH {_SIM} SELECT query_id, node_id FROM top WHERE rank <= 2 AND sim >= 0.5")
def similarity_threshold(spark, d):
    return linking.threshold(_similar(spark, d, 2), 0.5).select("query_id", "node_id")


#: Stand-in embeddings: of the k-th term that of vector 20 k, of a node that of its place modulo 500.
_S = """tv AS (SELECT term, embedding FROM tk JOIN embeddings ON vec_id = 20 * k), nv AS (SELECT name, ord, embedding FROM nodes JOIN embeddings ON vec_id = ord % 500),
    near AS (SELECT term, name, ord, list_cosine_similarity(tv.embedding::DOUBLE[], nv.embedding::DOUBLE[]) AS similarity FROM tv, nv),
    sim AS (SELECT term, name AS node, similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY round(similarity, 12) DESC, ord) AS rank FROM near) WHERE rank <= 2 AND similarity >= 0.1)"""
_TK = I.values([(t, k) for k, (t,) in enumerate(_TERMS)], "term, k", "tk")


def _near(spark, d):
    e = I.table(spark, d, "embeddings").where("embedding IS NOT NULL").select("vec_id", "embedding")
    terms = I.inline(spark, [(20 * k, t, k) for k, (t,) in enumerate(_TERMS)], "vec_id long, term string, query_id long").join(e, "vec_id")
    nodes = _nodes(spark, d).withColumn("vec_id", F.col("ord") % 500).join(e, "vec_id").withColumnRenamed("ord", "node_id")
    found = linking.threshold(linking.top_k(terms.select("query_id", "embedding"), nodes.select("node_id", "embedding"), 2), 0.1)
    return found.join(terms.select("query_id", "term"), "query_id").join(nodes.select("node_id", F.col("name").alias("node")), "node_id").select("term", "node", "rank", "similarity")


_DIRECT = "direct AS (SELECT term, name AS node, CASE WHEN term = name THEN 'exact' ELSE 'exact(case-insensitive)' END AS why FROM t JOIN nodes ON lower(term) = lower(name))"


@query(f"WITH {_NODES}, {_T}, {_TK}, {_S}, {_DIRECT} SELECT term, node, why AS status FROM direct UNION ALL SELECT term, node, printf('similar(score=%.3f)', similarity) FROM sim WHERE rank = 1 AND term NOT IN (SELECT term FROM direct)")
def resolve_target(spark, d):
    return linking.resolve_targets(I.inline(spark, _TERMS, "term string"), _nodes(spark, d), _near(spark, d))


@query(f"""WITH {_NODES}, {_T}, {_TK}, {_S}, {_DIRECT}, m AS (SELECT term, node, printf('similar(score=%.3f)', similarity) AS why, 0 AS kind, rank AS place FROM sim WHERE term NOT IN (SELECT term FROM direct)
    UNION ALL SELECT term, name, 'prefix_match', 1, ord FROM t JOIN nodes ON starts_with(lower(name), lower(term) || ' ') OR starts_with(lower(name), lower(term) || ',') WHERE term NOT IN (SELECT term FROM direct)),
    f AS (SELECT term, node, arg_min(why, kind * 1000000 + place) AS why, min(kind * 1000000 + place) AS place FROM m GROUP BY term, node)
    SELECT term, row_number() OVER (PARTITION BY term ORDER BY place) AS pos, node, why FROM (SELECT * FROM f UNION ALL SELECT term, node, why, 1 FROM direct)""")
def expand_source(spark, d):
    return long(linking.expand_sources(I.inline(spark, _TERMS, "term string"), _nodes(spark, d), _near(spark, d)))


# ---------------------------------------------------------------- arrays, probabilities, models

@query("SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) / list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]), 6) AS self, len(embedding) AS dim FROM embeddings")
def unit_vectors(spark, d):
    u = vectors.unit(F.col("embedding"))
    return I.table(spark, d, "embeddings").select("vec_id", F.round(vectors.dot(u, u), 6).alias("self"), F.size("embedding").cast("long").alias("dim"))


@query("WITH a AS (SELECT l_orderkey AS k, list(CAST(l_partkey % 3 AS BIGINT) ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice) AS x FROM lineitem GROUP BY 1) SELECT k, list_filter(range(len(x) - 1), lambda i: x[i + 1] = 1 AND x[i + 2] = 2)[-1] AS at FROM a")
def subsequence_position(spark, d):
    t = I.table(spark, d, "lineitem")
    items = F.array_sort(F.collect_list(F.struct("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")))
    rows = t.groupBy(F.col("l_orderkey").alias("k")).agg(F.transform(items, lambda x: x["l_partkey"] % 3).alias("x"))
    return rows.select("k", vectors.last_position(F.col("x"), F.array(F.lit(1).cast("long"), F.lit(2).cast("long"))).cast("long").alias("at"))


@query("WITH p AS (SELECT event_id, exp(value / 10) AS a, exp((100 - value) / 10) AS b FROM events) SELECT event_id, round(CASE WHEN event_id % 9 = 0 THEN 0.5 ELSE a / (a + b) END, 6) AS p FROM p")
def yes_probability(spark, d):
    s = vectors.softmax(F.array(F.col("value") / 10, (100 - F.col("value")) / 10))
    none = F.col("event_id") % 9 == 0
    p = lambda i: F.when(~none, F.get(s, F.lit(i)))
    return I.table(spark, d, "events").select("event_id", F.round(vectors.yes_probability(p(0), p(1)), 6).alias("p"))


@query("""SELECT disease, entity_key, name, reason, row_number() OVER (PARTITION BY disease ORDER BY n) AS pos FROM (VALUES ('A', 'selected_entity_2', 'x', 'r2', 2), ('A', 'selected_entity_10', 'y', NULL, 10), ('B, genetic', 'entity', 'z', 'has } and " in it', 1000000000)) t(disease, entity_key, name, reason, n)""")
def relevance_repair(spark, d):
    raw = '"A": {\n "selected_entity_2": {"name": "x", "reason": "r2"},\n "selected_entity_10": {"name": "y"},\n}\n"B, genetic": {"entity": {"name": "z", "reason": "has } and \\" in it"}}'
    rows = readers.relevance(I.inline(spark, [(raw,)], "value string"))
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy("disease").orderBy(readers.entity_number(F.col("entity_key")))).cast("long"))


@query()
def model_replay(spark, d):
    rows = _turns(spark, d).select("conv_id", "turn", F.col("output").alias("generated_text"))
    asked = rows.select("conv_id", "turn")
    return models.predictions(models.replay(asked, rows.where("turn <> 1"), ["conv_id", "turn"])).select("conv_id", "turn", "pred_label", "parsed", "score_p_yes")


@query()
def encoder_embeddings(spark, d):
    return models.embed(I.table(spark, d, "part").select(F.col("p_name").alias("text")), models.HashingEncoder()).select("text", F.round(vectors.dot(F.col("embedding"), F.col("embedding")), 6).alias("norm"))
