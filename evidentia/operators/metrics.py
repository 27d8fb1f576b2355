"""Binary classification metrics over long tables of (entity, label, gold, score).

A missing score is null, never NaN. ROC-AUC counts ties half and is null for one class;
average precision is the step sum over distinct scores, 0 without positives.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import small

METRICS = ("acc", "bacc", "auc", "aupr", "f1")


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b)


def confusion(cells: DataFrame, by: list[str], threshold: float = 0.5) -> DataFrame:
    """Counts and count-based metrics of scored cells. A score counts as 1 if above the threshold."""
    y, p = F.col("gold") == 1, F.col("score") > threshold
    counts = cells.where("gold IS NOT NULL AND score IS NOT NULL").groupBy(*by).agg(
        F.count(F.lit(1)).alias("support_total"), F.count_if(y).alias("support_positive"), F.count_if(~y).alias("support_negative"),
        F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    recalls = F.filter(F.array(_ratio(tp, tp + fn), _ratio(tn, tn + fp)), lambda x: x.isNotNull())
    return counts.withColumns({
        "acc": _ratio(tp + tn, F.col("support_total")),
        "bacc": F.aggregate(recalls, F.lit(0.0), lambda s, x: s + x) / F.nullif(F.size(recalls), F.lit(0)),
        "f1": F.coalesce(_ratio(2.0 * tp, 2 * tp + fp + fn), F.lit(0.0)),
    })


def curves(cells: DataFrame, by: list[str], parts: int = 64) -> DataFrame:
    """ROC-AUC and average precision by ``by`` (may be empty).

    Running counts over scores in falling order are taken inside score ranges, then
    shifted by the ranges above, so that one label, or all cells, needs no single task.
    """
    points = cells.where("gold IS NOT NULL AND score IS NOT NULL").groupBy(*by, "score").agg(F.sum("gold").alias("pos"), F.count(F.lit(1)).alias("cnt"))
    cuts = points.agg(F.percentile_approx("score", [k / parts for k in range(1, parts)], 10000).alias("cuts"))
    points = points.crossJoin(F.broadcast(cuts)).withColumn("part", F.size(F.filter("cuts", lambda c: c < F.col("score")))).drop("cuts")
    above = Window.partitionBy(*by).orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    offset = points.groupBy(*by, "part").agg(F.sum("pos").alias("part_pos"), F.sum("cnt").alias("part_cnt")).withColumns({
        "pos_above": F.coalesce(F.sum("part_pos").over(above), F.lit(0)), "cnt_above": F.coalesce(F.sum("part_cnt").over(above), F.lit(0)),
    }).drop("part_pos", "part_cnt")
    inside = Window.partitionBy(*by, "part").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    run = points.withColumns({"run_pos": F.sum("pos").over(inside), "run_cnt": F.sum("cnt").over(inside)}).join(offset, [*by, "part"])
    tp, k, neg = F.col("run_pos") + F.col("pos_above"), F.col("run_cnt") + F.col("cnt_above"), F.col("cnt") - F.col("pos")
    sums = run.groupBy(*by).agg(
        F.sum(neg * (tp - F.col("pos")) + 0.5 * F.col("pos") * neg).alias("area"), F.sum(F.col("pos") * tp / k).alias("steps"),
        F.sum("pos").alias("all_pos"), F.sum(neg).alias("all_neg"),
    )
    return sums.select(*by, _ratio(F.col("area"), F.col("all_pos") * F.col("all_neg")).alias("auc"), F.coalesce(_ratio(F.col("steps"), F.col("all_pos")), F.lit(0.0)).alias("aupr"))


def per_label(cells: DataFrame, threshold: float = 0.5) -> DataFrame:
    return confusion(cells, ["label"], threshold).join(curves(cells, ["label"]), "label")


def macro(labels: DataFrame, names=METRICS) -> DataFrame:
    """Unweighted means over labels; a label without the metric is left out."""
    return labels.agg(*(F.avg(m).alias(f"macro_{m}") for m in names))


def macro_weighted(labels: DataFrame, weight: str, names=METRICS) -> DataFrame:
    """Means weighted by a positive column, over labels that have the metric."""
    ok = lambda m: F.col(m).isNotNull() & (F.col(weight) > 0)
    return labels.agg(*((F.sum(F.when(ok(m), F.col(m) * F.col(weight))) / F.nullif(F.sum(F.when(ok(m), F.col(weight))), F.lit(0))).alias(f"weighted_{m}") for m in names))


def micro(cells: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Over all cells as one label; micro F1 of a flattened 0/1 vector is its accuracy."""
    one = confusion(cells, [], threshold).crossJoin(curves(cells, []))
    return one.select(F.col("acc").alias("micro_acc"), F.col("auc").alias("micro_auc"), F.col("aupr").alias("micro_aupr"), F.col("acc").alias("micro_f1"))


def last_wins(cells: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row for each key: the last by ``order``."""
    rest = [c for c in cells.columns if c not in keys]
    return cells.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("last")).select(*keys, "last.*")


def complete_entities(cells: DataFrame, labels: int) -> DataFrame:
    """Cells of entities that have a score for all ``labels`` labels."""
    whole = cells.groupBy("entity").agg(F.count("score").alias("have")).where(F.col("have") == labels).select("entity")
    return cells.join(whole, "entity", "left_semi")


def skipped(cells: DataFrame, labels: int) -> DataFrame:
    """Entities in all, scored and skipped under the complete-case rule."""
    have = cells.groupBy("entity").agg((F.count("score") == labels).alias("whole"))
    return have.agg(F.count(F.lit(1)).alias("entities"), F.count_if("whole").alias("scored"), F.count_if(~F.col("whole")).alias("skipped"))


def keep_labels(cells: DataFrame, index: DataFrame, mode: str = "drop_neg_only") -> DataFrame:
    """By an index per label: ``drop_neg_only`` drops negative ones, ``keep_nonneg_only`` keeps listed others, ``none`` all."""
    if mode == "none":
        return cells
    if mode == "drop_neg_only":
        return cells.join(small(index.where("index < 0").select("label")), "label", "left_anti")
    if mode == "keep_nonneg_only":
        return cells.join(small(index.where("index >= 0").select("label")), "label", "left_semi")
    raise ValueError(f"unknown filter mode: {mode}")


def dropped_labels(cells: DataFrame, kept: DataFrame) -> DataFrame:
    return cells.select("label").distinct().join(kept.select("label").distinct(), "label", "left_anti")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
