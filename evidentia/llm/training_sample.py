"""The bounded sample of labelled documents that a model is fitted on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import bounded, remove, save, shared_dir


def held_out(doc_id) -> F.Column:
    """Rows that training never sees: CRC-32 of the decimal doc_id is a multiple of 5."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def bounded_texts(rows: DataFrame, size: int) -> list[tuple]:
    """Rows (label, doc_id, text) on the driver: of each label, whole texts in order of the id's hash while they have ``size`` bytes in all.

    One row for each label and doc_id, that of the least text. ``rows`` must be bounded in
    number; only lengths are collected before the choice is made. A text that does not
    fit is passed over.
    """
    spark = rows.sparkSession
    path = shared_dir(spark, "sample")
    kept = save(bounded(rows).groupBy("label", "doc_id").agg(F.min("text").alias("text")), path)
    left, chosen = {}, []
    lengths = kept.select("label", "doc_id", F.xxhash64("doc_id").alias("h"), F.octet_length("text").alias("n")).collect()
    for r in sorted(lengths, key=lambda r: (str(r.label), r.h, r.doc_id)):
        room = left.setdefault(r.label, size)
        if r.n <= room:
            left[r.label] = room - r.n
            chosen.append((r.label, r.doc_id))
    ids = sorted({d for _, d in chosen})
    got = {(r.label, r.doc_id): r.text for r in kept.where(F.col("doc_id").isin(ids)).collect()} if ids else {}
    remove(spark, path)
    return [(label, doc, got[label, doc]) for label, doc in sorted(chosen, key=lambda c: (c[1], str(c[0])))]
