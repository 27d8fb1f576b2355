"""Entity catalogues and name maps built from edge tables and curated lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import query_variants, strip


def entity_catalogue(edges: DataFrame) -> DataFrame:
    """(name, kg_index) of all edge ends: missing values and blank names out, of a name's indices the last (largest ``ord``)."""
    first = edges.select(F.col("x_name").alias("name"), F.col("x_index").alias("idx"), F.lit(0).alias("side"), "ord")
    second = edges.select(F.col("y_name").alias("name"), F.col("y_index").alias("idx"), F.lit(1).alias("side"), "ord")
    rows = first.unionByName(second).where("name IS NOT NULL AND idx IS NOT NULL").withColumn("name", strip(F.col("name")))
    rows = rows.withColumn("kg_index", F.col("idx").try_cast("double").try_cast("long")).where("name <> '' AND kg_index IS NOT NULL")
    # A side at a time, so that both aggregates hold plain longs and are hashed, not sorted.
    at = F.coalesce(F.col("ord").cast("long"), F.lit(-(1 << 63)))
    last = lambda side: F.max_by(F.when(F.col("side") == side, F.col("kg_index")), F.when(F.col("side") == side, at))
    return rows.groupBy("name").agg(last(1).alias("second"), last(0).alias("first")).select("name", F.coalesce("second", "first").alias("kg_index"))


def positive_only(catalogue: DataFrame) -> DataFrame:
    """Entries with an index above 0: index 0 goes too."""
    return catalogue.where("kg_index > 0")


def merge_maps(maps: DataFrame) -> DataFrame:
    """Refined maps (query, entity, kg_index, file_no, ord) as one: of an index's lines the last of the last file; rejects out."""
    rows = maps.where("kg_index <> -1 AND entity <> 'NONE'")
    return rows.groupBy("kg_index").agg(F.max_by(F.struct("query", "entity"), F.struct("file_no", "ord")).alias("m")).select("kg_index", "m.query", "m.entity")


def index_of_names(names: DataFrame, merged: DataFrame) -> DataFrame:
    """Each name with the first map index whose query it is, or null."""
    first = merged.groupBy("query").agg(F.min("kg_index").alias("kg_index"))
    return names.join(first, names["name"] == first["query"], "left").select(names["name"], "kg_index")


def variants(queries: DataFrame) -> DataFrame:
    """(query, variant_pos, variant): each query's spellings to try, in order."""
    return queries.select("query", F.posexplode(query_variants(F.col("query"))).alias("variant_pos", "variant"))
