"""Connected components of an edge table by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import remove, save


def components(edges: DataFrame, root: str) -> DataFrame:
    """Rows (v, label): every endpoint of ``edges`` (a, b) with the least vertex of its component.

    Each round takes the least label among a vertex and its neighbours, then follows the
    label once, so long chains halve; rounds end when no label changes. Tables of each
    round lie in the shared folder ``root``; none of them goes to the driver.
    """
    both = save(edges.select(F.col("a").alias("v"), F.col("b").alias("w")).unionByName(edges.select(F.col("b").alias("v"), F.col("a").alias("w"))).distinct(), f"{root}/edges")
    labels = save(both.groupBy("v").agg(F.least(F.col("v"), F.min("w")).alias("label")), f"{root}/labels0")
    step = 0
    while True:
        step += 1
        near = both.join(labels.select(F.col("v").alias("w"), F.col("label").alias("near")), "w").groupBy("v").agg(F.min("near").alias("near"))
        low = labels.join(near, "v").select("v", F.col("label").alias("old"), F.least("label", "near").alias("mid"))
        jump = labels.select(F.col("v").alias("mid"), F.col("label").alias("far"))
        new = save(low.join(jump, "mid", "left").select("v", "old", F.least("mid", F.coalesce("far", "mid")).alias("label")), f"{root}/labels{step}")
        labels = new.select("v", "label")
        if step > 1:
            remove(edges.sparkSession, f"{root}/labels{step - 2}")
        if new.where("old <> label").isEmpty():
            remove(edges.sparkSession, f"{root}/labels{step - 1}")
            remove(edges.sparkSession, f"{root}/edges")
            return labels
