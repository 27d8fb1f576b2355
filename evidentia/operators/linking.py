"""Linking names to graph nodes: exact, case-insensitive, by prefix and by embedding similarity.

Similarity search packs queries and nodes into blocks of ``BLOCK`` vectors. Every block of
queries meets every block of nodes in a matrix product inside a task; the best k of each
meeting are merged per query with a total order, so no table of pairs arises and nothing
goes through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 4096


def lower_map(nodes: DataFrame) -> DataFrame:
    """(lname, node): of names that differ by case only, the last by ``ord``."""
    return nodes.groupBy(F.lower("name").alias("lname")).agg(F.max_by("name", "ord").alias("node"))


def exact_or_case(terms: DataFrame, nodes: DataFrame) -> DataFrame:
    """(term, node, why) for terms that are a node's name, else one apart from case."""
    same = terms.join(nodes.select(F.col("name").alias("term")).distinct(), "term", "left_semi").select("term", F.col("term").alias("node"), F.lit("exact").alias("why"))
    rest = terms.join(same.select("term"), "term", "left_anti").withColumn("lname", F.lower("term"))
    return same.unionByName(rest.join(lower_map(nodes), "lname").select("term", "node", F.lit("exact(case-insensitive)").alias("why")))


def prefix_matches(terms: DataFrame, nodes: DataFrame) -> DataFrame:
    """(term, node, ord): nodes whose lower name starts with the term and then a space or comma.

    An equi-join on each node's own prefixes that end before a space or comma.
    """
    low = F.lower(F.col("name"))
    ends = F.filter(F.sequence(F.lit(2), F.greatest(F.length(low), F.lit(2))), lambda i: F.substr(low, i, F.lit(1)).isin(" ", ","))
    keyed = nodes.select("name", "ord", F.explode(F.transform(ends, lambda i: F.substr(low, F.lit(1), i - 1))).alias("key"))
    return terms.withColumn("key", F.lower("term")).join(keyed, "key").select("term", F.col("name").alias("node"), "ord").distinct()


def _pack(key, table):
    """One row (block, ids, matrix) of unit vectors by ascending id."""
    table = table.sort_by("id")
    m = np.array(table["embedding"].to_pylist(), np.float64)
    m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    ids = table["id"].to_numpy().astype("<i8")
    return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "ids": pa.array([ids.tobytes()], pa.binary()), "matrix": pa.array([m.astype("<f8").tobytes()], pa.binary())})


def _blocks(rows: DataFrame, name: str, block: int) -> DataFrame:
    n = rows.agg(F.count(F.lit(1)).alias("n")).first().n
    parts = F.lit(max(1, -(-n // block)))
    rows = rows.select(F.col(name).alias("id"), "embedding", F.pmod(F.xxhash64(name), parts).alias("block"))
    return rows.groupBy("block").applyInArrow(_pack, "block long, ids binary, matrix binary")


def _best(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                queries, ids = (np.frombuffer(row[c], "<i8") for c in ("q_ids", "ids"))
                q, m = (np.frombuffer(row[c], "<f8").reshape(len(i), -1) for c, i in (("q_matrix", queries), ("matrix", ids)))
                for lo in range(0, len(queries), 256):
                    score = q[lo : lo + 256] @ m.T
                    top = np.lexsort((np.broadcast_to(ids, score.shape), -np.round(score, 12)), axis=1)[:, :k]
                    query = np.repeat(queries[lo : lo + 256], top.shape[1])
                    columns = [query, ids[top].ravel(), np.take_along_axis(score, top, 1).ravel()]
                    yield pa.record_batch([pa.array(c) for c in columns], names=["query_id", "node_id", "similarity"])

    return run


def top_k(queries: DataFrame, nodes: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, node_id, similarity): the k nearest nodes by cosine; ties by smaller node_id."""
    left = _blocks(queries, "query_id", block).select(F.col("ids").alias("q_ids"), F.col("matrix").alias("q_matrix"))
    right = _blocks(nodes, "node_id", block).select("ids", "matrix")
    # blocks of the stated queries against blocks of all nodes: one row for each two blocks
    out = left.crossJoin(right).mapInArrow(_best(k), "query_id long, node_id long, similarity double")
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("similarity", 12)), "node_id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "node_id", "similarity")


def threshold(matches: DataFrame, tau: float = 0.85) -> DataFrame:
    return matches.where(F.col("similarity") >= tau)


def resolve_targets(terms: DataFrame, nodes: DataFrame, similar: DataFrame) -> DataFrame:
    """(term, node, status): exact, else case-insensitive, else the nearest of ``similar`` (term, node, similarity, rank)."""
    direct = exact_or_case(terms, nodes)
    rest = similar.join(direct.select("term"), "term", "left_anti")
    best = rest.groupBy("term").agg(F.min_by("node", "rank").alias("node"), F.min_by("similarity", "rank").alias("s"))
    return direct.select("term", "node", F.col("why").alias("status")).unionByName(best.select("term", "node", F.format_string("similar(score=%.3f)", "s").alias("status")))


def expand_sources(terms: DataFrame, nodes: DataFrame, similar: DataFrame) -> DataFrame:
    """(term, pos, node, why): a direct hit alone, else the similar nodes and then the prefix matches, each node once."""
    direct = exact_or_case(terms, nodes)
    rest = terms.join(direct.select("term"), "term", "left_anti")
    near = similar.join(rest, "term", "left_semi").select("term", "node", F.format_string("similar(score=%.3f)", "similarity").alias("why"), F.struct(F.lit(0).alias("kind"), F.col("rank").cast("long").alias("at")).alias("place"))
    prefix = prefix_matches(rest, nodes).select("term", "node", F.lit("prefix_match").alias("why"), F.struct(F.lit(1).alias("kind"), F.col("ord").cast("long").alias("at")).alias("place"))
    more = near.unionByName(prefix).groupBy("term", "node").agg(F.min_by("why", "place").alias("why"), F.min("place").alias("place"))
    alone = direct.select("term", "node", "why", F.struct(F.lit(0).alias("kind"), F.lit(1).cast("long").alias("at")).alias("place"))
    rows = alone.unionByName(more.select("term", "node", "why", "place"))
    return rows.select("term", F.row_number().over(Window.partitionBy("term").orderBy("place", "node")).alias("pos"), "node", "why")


def ranked_candidates(variants: DataFrame, entities: DataFrame, similar: DataFrame) -> DataFrame:
    """(query_name, query_triples): the candidates of each query over its variants, with one running rank.

    ``variants`` is (query, variant_pos, variant), ``entities`` (name, kg_index, ord). A
    variant that is an entity's name, apart from case, has that one candidate, with
    similarity 1; another has its nearest in ``similar`` (variant, node, rank, similarity).
    A query without a variant has an empty list.
    """
    index = entities.groupBy("name").agg(F.max_by("kg_index", "ord").alias("kg_index"))
    named = variants.withColumn("lname", F.lower("variant")).join(lower_map(entities), "lname", "left")
    exact = named.where("node IS NOT NULL").select("query", "variant_pos", "variant", "node", F.lit(1).alias("rank"), F.lit(1.0).alias("similarity"))
    near = named.where("node IS NULL").drop("node").join(similar, "variant").select("query", "variant_pos", "variant", "node", "rank", F.round("similarity", 6).alias("similarity"))
    rows = exact.unionByName(near).join(index, F.col("node") == F.col("name"))
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy("variant_pos", "rank")))
    triple = F.struct(F.col("place").alias("rank"), F.col("node").alias("entity_name"), "similarity", F.col("kg_index").alias("entity_index"), F.col("variant").alias("query_variant"))
    lists = rows.groupBy("query").agg(F.array_sort(F.collect_list(triple)).alias("query_triples"))
    whole = variants.select("query").distinct().join(lists, "query", "left")
    none = F.array().cast(lists.schema["query_triples"].dataType)
    return whole.select(F.col("query").alias("query_name"), F.coalesce("query_triples", none).alias("query_triples"))
