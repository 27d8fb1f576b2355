"""Writers. Tables go out as Parquet, CSV or JSON lines in parallel; single JSON documents are assembled in one row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import file_safe
from ..operators.scratch import saved


def name_index_lines(rows: DataFrame, path: str) -> None:
    """``name: index`` lines."""
    rows.select(F.concat_ws(": ", "name", F.col("kg_index").cast("string"))).write.mode("overwrite").text(path)


def name_lines(rows: DataFrame, path: str, column: str = "name") -> None:
    rows.select(F.col(column)).write.mode("overwrite").text(path)


def json_lines(rows: DataFrame, path: str, append: bool = False) -> None:
    """One JSON object a line, non-ASCII kept."""
    rows.write.mode("append" if append else "overwrite").json(path, ignoreNullFields=False)


def json_array(rows: DataFrame, path: str, order: str) -> None:
    """One JSON array of the rows by ``order``, which is left out of them; written as one text file, so for small results."""
    body = F.struct(*[c for c in rows.columns if c != order])
    items = F.array_sort(F.collect_list(F.struct(F.col(order).alias("k"), F.to_json(body, {"ignoreNullFields": "false"}).alias("v"))))
    one = rows.agg(F.concat(F.lit("["), F.array_join(F.transform(items, lambda x: x["v"]), ",\n"), F.lit("]")).alias("value"))
    one.coalesce(1).write.mode("overwrite").text(path)


def json_array_pieces(rows: DataFrame, path: str, order: str) -> None:
    """The text of :func:`json_array` in many files, one record a line: joined by file name they are the array.

    The rows are kept once as lines; their sorted files tell which line opens the array and which ends it.
    """
    body = F.struct(*[c for c in rows.columns if c != order])
    lines = saved(rows.select(F.col(order).alias("k"), F.to_json(body, {"ignoreNullFields": "false"}).alias("v")).orderBy("k", "v").select("v", F.monotonically_increasing_id().alias("at")), "lines")
    ends = lines.agg(F.min("at").alias("lo"), F.max("at").alias("hi")).first()
    if ends["lo"] is None:
        rows.sparkSession.createDataFrame([("[]",)], "value string").coalesce(1).write.mode("overwrite").text(path)
        return
    text = F.concat(F.when(F.col("at") == ends["lo"], "[").otherwise(""), "v", F.when(F.col("at") == ends["hi"], "]").otherwise(","))
    lines.select("at", text.alias("value")).orderBy("at").select("value").write.mode("overwrite").text(path)


def table_csv(rows: DataFrame, path: str) -> None:
    """CSV with header in one file; a missing metric is blank."""
    rows.coalesce(1).write.mode("overwrite").csv(path, header=True, nullValue="", emptyValue="")


def label_tables(metrics: DataFrame, path: str) -> None:
    """Per-label metrics twice: CSV (``path``/csv) and one JSON array (``path``/json), by label_index."""
    table_csv(metrics.orderBy("label_index"), f"{path}/csv")
    json_array(metrics.withColumn("ord", F.col("label_index")), f"{path}/json", "ord")


def review_files(rows: DataFrame, path: str) -> None:
    """Three JSON arrays of bucketed records by ``ord``, in pieces: training rows, unparsed ones, and mismatches."""
    from ..operators import review

    for name, part in (("alpaca", review.training_rows(rows)), ("bad", review.bad_rows(rows).withColumn("_ord", F.col("ord"))), ("mismatch", review.mismatch_rows(rows).withColumn("_ord", F.col("ord")))):
        json_array_pieces(part, f"{path}/{name}", "ord" if name == "alpaca" else "_ord")


def read_patient_paths(spark: SparkSession, path: str, schema: str, by: str | None = None, value=None) -> DataFrame:
    """What :func:`patient_paths` wrote, all or of one patient or disease."""
    rows = spark.read.schema(schema).parquet(path)
    return rows if by is None else rows.where(F.col(by) == value)


def summary(probability: DataFrame, hard: DataFrame, path: str) -> None:
    """One nested JSON object of two one-row metric tables."""
    one = probability.select(F.struct("*").alias("probability")).crossJoin(hard.select(F.struct("*").alias("hard_label")))
    one.coalesce(1).write.mode("overwrite").json(path, ignoreNullFields=False)


def path_report(rows: DataFrame, path: str) -> None:
    """Lines (disease, ord, line) as one text per disease, below a folder with its file-safe name."""
    text = rows.groupBy("disease").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda x: x["line"]), "\n").alias("value"))
    text.select("value", file_safe(F.col("disease")).alias("file")).write.mode("overwrite").partitionBy("file").text(path)


def path_mapping(rows: DataFrame, path: str) -> None:
    """(disease, pos, path) as one JSON object from diseases to their distinct paths in order."""
    lists = rows.groupBy("disease").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("pos", "path"))), lambda x: x["path"])).alias("paths"))
    one = lists.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("disease", "paths")))).alias("m")).select(F.to_json("m").alias("value"))
    one.coalesce(1).write.mode("overwrite").text(path)


def patient_paths(rows: DataFrame, path: str) -> None:
    """(patient, disease, label, start_index, path), added where the key is new: a repeated run does not repeat rows."""
    spark = rows.sparkSession
    key = ["patient", "disease", "start_index"]
    try:
        old = spark.read.schema(rows.schema).parquet(path)
        rows = rows.join(old.select(*key), key, "left_anti").select(*rows.columns)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
    rows.dropDuplicates(key).write.mode("append").parquet(path)
