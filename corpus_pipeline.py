"""Corpus pipeline: quality, near duplicates, repeated passages, benchmark leaks, pieces.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; its
result is written as Parquet and read again as the next stage's input. All but the last
return the columns of ``documents``, with any others that came along, whatever their
names. Empty tables go through all stages as empty ones; texts of any length are taken
whole; what null, empty and repeated rows come to is said at each stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.llm import decontaminate, near_dedup, quality_classifier, sentencepiece_lattice, store, substring_dedup


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier, trained on ``labels``, rejects.

    Null and empty texts score alike, by the bias; repeated rows go or stay together if
    their texts are equal.
    """
    return quality_classifier.keep_good(docs, quality_classifier.fit(docs, _table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each near-duplicate group.

    Documents without a word or without a doc_id are in no group and stay; all rows of a
    kept doc_id stay.
    """
    return near_dedup.dedup(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts words of 20-word windows that start earlier in the corpus too; every document stays.

    Null and empty texts stay as they are; a null doc_id counts as the smallest; rows of
    one doc_id are one document, whose equal places are not repeats of each other.
    """
    return substring_dedup.dedup(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of ``benchmark``.

    Null and empty texts hold none and stay; items without text find nothing; repeated
    rows go or stay together.
    """
    return decontaminate.clean(docs, _table(spark, sf_dir, "benchmark"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled pieces of each text and the text decoded from them: ids, n_pieces, lossless beside all columns.

    Null text has null pieces, n_pieces and text, and counts as lossless; empty text has
    none. Rows that repeat a doc_id and text get the same pieces. Columns called ids,
    n_pieces or lossless are replaced.
    """
    model, back = public_tokenizers.path("piece_bpe_32k.model"), store.fresh(docs, "decoded")
    new = ("ids", "n_pieces", "lossless")
    docs = docs.drop(*new)
    rows = sentencepiece_lattice.recode(docs, model, "ids", back)
    whole = F.col(back).eqNullSafe(F.col("text")).alias("lossless")
    count = F.when(F.col("ids").isNotNull(), F.size("ids")).cast("long").alias("n_pieces")
    return rows.select(*(F.col(back).alias(c) if c == "text" else F.col(c) for c in docs.columns), "ids", count, whole)


STAGES = [
    ("quality_classifier", quality),
    ("near_dedup", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("decontaminate", benchmark_leaks),
    ("sentencepiece", encode_pieces),
]

#: SQL expresses neither the trained classifier nor the sampled lattice.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, root = _table(spark, sf_dir, "documents"), store.shared_dir(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        docs = store.save(stage(spark, docs, sf_dir), f"{root}/{k}")
        if k:
            store.remove(spark, f"{root}/{k - 1}")
    return docs
