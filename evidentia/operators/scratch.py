"""Tables in the shared scratch folder, to cut the lineage of iterative plans."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession, name: str) -> str:
    """A new place below spark.checkpoint.dir; where that is unset, a local one, but only if the master is local too."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="evidentia-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str = "step") -> DataFrame:
    """Written below spark.checkpoint.dir and read back: survives a lost executor."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, parts: int, name: str = "bucketed") -> DataFrame:
    """As :func:`saved`, in one file for each of ``parts`` hash values of ``key``: joins on it do not shuffle the table again."""
    spark, path, table = df.sparkSession, folder(df.sparkSession, name), f"{name}_{uuid.uuid4().hex}"
    df.repartition(parts, key).write.bucketBy(parts, key).option("path", path).format("parquet").saveAsTable(table)
    rows = spark.read.table(table)
    rows.schema  # resolved, so the files are known without the name
    spark.sql(f"DROP TABLE {table}")
    return rows


def pieces(spark: SparkSession, rows: int, each: int = 400_000) -> int:
    """How many partitions hold ``each`` rows or fewer, one a core at least: what a task holds does not grow with the table."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // each))


def spread(df: DataFrame, parts: int | None, *keys: str) -> DataFrame:
    """By hash of ``keys`` over ``parts`` partitions, if given; aggregates and joins on the keys then go without another shuffle."""
    return df if parts is None else df.repartition(parts, *keys)


def small(df: DataFrame, rows: int = 200_000, size: int = 16 << 20) -> DataFrame:
    """Marks a table for broadcast if it is counted and measured to be small; else leaves the join to a shuffle."""
    width = F.lit(0).cast("long")
    for f in df.schema.fields:
        width = width + (F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0)) if f.dataType.typeName() in ("string", "binary") else F.lit(8))
    got = df.limit(rows + 1).agg(F.count(F.lit(1)).alias("n"), F.sum(width).alias("size")).first()
    return F.broadcast(df) if got["n"] <= rows and (got["size"] or 0) <= size else df
