"""Generated records against their labels: three-way split, training rows, agreement reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import conclusions
from ..functions.text import clean_field, label_int
from .prompts import CLOSING


def bucketed(records: DataFrame) -> DataFrame:
    """Adds ``conclusion``, ``label_value`` and ``bucket``: kept, mismatch, or bad (unparsed, or a label that is not 0 or 1)."""
    kind = dict(records.dtypes)["label"]
    rows = records.withColumns({"conclusion": conclusions.strict(F.col("output")), "label_value": label_int(F.col("label"), kind)})
    said = (F.col("conclusion") == "Yes").cast("int")
    bad = F.col("conclusion").isNull() | ~F.coalesce(F.col("label_value").isin(0, 1), F.lit(False))
    return rows.withColumn("bucket", F.when(bad, "bad").when(said == F.col("label_value"), "kept").otherwise("mismatch"))


def training_rows(rows: DataFrame, append_final_instruction: bool = True) -> DataFrame:
    """Instruction, input and output of the kept records, cleaned."""
    instruction = clean_field(F.col("instruction"))
    if append_final_instruction:
        instruction = F.concat(instruction, F.lit("\n" + CLOSING))
    text = clean_field(F.col("input"), "input")
    kept = rows.where("bucket = 'kept'")
    extra = [c for c in ("ord",) if c in rows.columns]
    return kept.select(*extra, instruction.alias("instruction"), F.when(F.trim(text) != "", text).otherwise("").alias("input"), clean_field(F.col("output"), "output").alias("output"))


def bad_rows(rows: DataFrame) -> DataFrame:
    """The records without a conclusion or a label of 0 or 1, as they were."""
    return rows.where("bucket = 'bad'").drop("conclusion", "label_value", "bucket")


def mismatch_rows(rows: DataFrame) -> DataFrame:
    """The judged records that contradict their label: with ``_parsed_conclusion``, and the label as a whole number."""
    return rows.where("bucket = 'mismatch'").withColumns({"label": F.col("label_value"), "_parsed_conclusion": F.col("conclusion")}).drop("conclusion", "label_value", "bucket")


def totals(rows: DataFrame) -> DataFrame:
    of = lambda b: F.count_if(F.col("bucket") == b).alias(b)
    return rows.agg(F.count(F.lit(1)).alias("total"), of("kept"), of("mismatch"), of("bad"), F.count_if(F.col("conclusion").isNull()).alias("unparsed"))


def mismatch_by_label(rows: DataFrame) -> DataFrame:
    """For labels 0 and 1: judged records, mismatches, and their share in percent."""
    judged = rows.where("bucket <> 'bad'").groupBy(F.col("label_value").alias("label")).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("bucket") == "mismatch").alias("mismatches"))
    return judged.withColumn("percent", 100.0 * F.col("mismatches") / F.col("total"))


def accuracy_by_disease(rows: DataFrame) -> DataFrame:
    """Records, judged records, accuracy and ROC-AUC of the judged; a missing disease is ``<unknown>``.

    Accuracy is null if none is judged, AUC if they have one label only. With a conclusion
    as the score, AUC is the mean of the shares of each label that are told right.
    """
    judged = F.col("bucket") != "bad"
    right = lambda y: F.avg(F.when(judged & (F.col("label_value") == y), (F.col("bucket") == "kept").cast("int")))
    return rows.groupBy(F.coalesce("disease", F.lit("<unknown>")).alias("disease")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(judged).alias("n_valid"), F.avg(F.when(judged, (F.col("bucket") == "kept").cast("int"))).alias("accuracy"),
        ((right(0) + right(1)) / 2).alias("auc"),
    )
