"""Resumable work: new rows are done once, whatever stopped the last run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def pending(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are not among the finished ones."""
    return work.join(done.select(*keys).distinct(), keys, "left_anti")


def resume_append(work: DataFrame, transform: Callable[[DataFrame], DataFrame], path: str, keys: list[str], schema: str) -> DataFrame:
    """Does the pending rows, appends them to a Parquet folder, and reads all finished rows."""
    spark = work.sparkSession
    try:
        todo = pending(work, spark.read.schema(schema).parquet(path), keys)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        todo = work
    transform(todo).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def stream_append(spark: SparkSession, source: str, schema: str, transform: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, keys: list[str] | None = None) -> StreamingQuery:
    """Takes what is new in a Parquet folder since the last call, in one or more batches, and ends.

    The checkpoint holds the progress; a batch that was cut off is done again under the same
    number and overwrites its own folder, so each input row is done once. With ``keys``, so
    is each key: rows whose key an earlier batch has finished fall away.
    """

    def batch(df: DataFrame, number: int) -> None:
        if keys:
            df = df.dropDuplicates(keys)
            if number:
                try:
                    done = spark.read.parquet(sink).where(F.col("batch") < number)
                    df = pending(df, done, keys)
                except AnalysisException as e:
                    if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                        raise
        out = transform(df)
        out.write.mode("overwrite").parquet(f"{sink}/batch={number}")

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
