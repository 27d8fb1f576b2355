"""Shared scratch space, size-checked joins and release of finished shuffles."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only up to so many rows and bytes of values; beyond, the join shuffles.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 16 << 20
#: Bounds of the Arrow batches that go to Python.
ARROW_ROWS = 2000
ARROW_BYTES = "8m"


def bounded(df: DataFrame) -> DataFrame:
    """The table, once the session's Arrow batches are bounded in bytes: texts may be long, and Python workers small."""
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", min(int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")), ARROW_ROWS))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    return df


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the table does not have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    out = f"{name}_added"
    while out.lower() in taken:
        out += "_"
    return out


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir; where that is unset, below a local one, but only if the master is local too."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="evidentia-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder through Hadoop's file system, so any shared store works."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def save(df: DataFrame, path: str) -> DataFrame:
    """Writes a table into the shared folder and reads it back: cuts lineage, survives lost executors."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release() -> None:
    """Lets Spark's cleaner drop shuffle files of plans that nothing refers to any more."""
    spark = SparkSession.getActiveSession()
    gc.collect()
    if spark is not None:
        spark.sparkContext._jvm.System.gc()


def checked(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """Marks a table for broadcast if it is counted and measured to be small enough; else leaves the join to a shuffle."""
    width = F.lit(0).cast("long")
    for f in df.schema.fields:
        width = width + (F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0)) if f.dataType.typeName() in ("string", "binary") else F.lit(8))
    got = df.limit(rows + 1).agg(F.count(F.lit(1)).alias("n"), F.sum(width).alias("size")).first()
    return F.broadcast(df) if got["n"] <= rows and (got["size"] or 0) <= size else df


def file_system(uri: str):
    """pyarrow file system and path for a shared folder: local, HDFS or an object store."""
    from pyarrow import fs

    if re.match(r"file:/+", uri):
        return fs.LocalFileSystem(), "/" + re.sub(r"^file:/+", "", uri)
    if uri.startswith("/"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def put(fs, path: str, write) -> None:
    """Writes a file under another name and moves it in place: a repeated task leaves one whole file."""
    part = f"{path}.{uuid.uuid4().hex}.part"
    with fs.open_output_stream(part) as out:
        write(out)
    fs.move(part, path)
