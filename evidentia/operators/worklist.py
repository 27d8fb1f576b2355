"""Worklists of (entity, label), seeded samples and slices by order."""

from __future__ import annotations

import random
from collections.abc import Iterable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import norm_key
from .scratch import saved, small


def graph_worklist(entities: DataFrame, labels: DataFrame, widths: DataFrame | None = None) -> DataFrame:
    """(entity, label_idx, disease, ord): entities with labels, by entity and normalised disease; ord from 0.

    ``widths`` (entity, width) drops labels beyond an entity's row and entities without one.
    """
    pairs = entities.select("entity").distinct().crossJoin(small(labels.where("disease <> ''")))
    if widths is not None:
        pairs = pairs.join(widths, "entity").where("label_idx < width").drop("width")
    return numbered(pairs, [F.col("entity")], [norm_key(F.col("disease")), F.col("label_idx")])


def numbered(rows: DataFrame, lead: list[Column], rest: list[Column], name: str = "ord") -> DataFrame:
    """Adds the place of each row, from 0, in the order of ``lead`` then ``rest``; groups by ``lead`` are ranked apart.

    Places within a lead value come from a window on it; the values' starts from running sizes
    over hash-independent ranges of the lead, so no single task sees all rows.
    """
    tagged = rows.withColumn("__lead", lead[0])
    sizes = tagged.groupBy("__lead").agg(F.count(F.lit(1)).alias("__n"))
    cuts = sizes.agg(F.percentile_approx("__lead", [k / 64 for k in range(1, 64)], 10000).alias("__cuts"))
    parted = sizes.crossJoin(F.broadcast(cuts)).withColumn("__part", F.size(F.filter("__cuts", lambda c: c < F.col("__lead")))).drop("__cuts")
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parted.groupBy("__part").agg(F.sum("__n").alias("__m")).withColumn("__base", F.coalesce(F.sum("__m").over(before), F.lit(0))).drop("__m")
    inside = Window.partitionBy("__part").orderBy("__lead").rowsBetween(Window.unboundedPreceding, -1)
    starts = parted.withColumn("__in", F.coalesce(F.sum("__n").over(inside), F.lit(0))).join(F.broadcast(parts), "__part").select("__lead", (F.col("__base") + F.col("__in")).alias("__start"))
    place = F.row_number().over(Window.partitionBy("__lead").orderBy(*rest)) - 1
    return tagged.withColumn("__place", place).join(starts, "__lead").withColumn(name, (F.col("__start") + F.col("__place")).cast("long")).drop("__lead", "__place", "__start")


def csv_worklist(rows: DataFrame, exclude: Iterable[str], id_column: str = "patient_id") -> DataFrame:
    """(id, disease, label) of every column that is not excluded, unpivoted."""
    columns = disease_columns(rows, {id_column, *exclude})
    if not columns:
        raise ValueError("no disease columns")
    return rows.unpivot([id_column], columns, "disease", "label")


def disease_columns(rows: DataFrame, exclude: Iterable[str]) -> list[str]:
    gone = set(exclude)
    return [c for c in rows.columns if c not in gone]


def piece(worklist: DataFrame, start: int = 0, end: int | None = None, order: str = "ord") -> DataFrame:
    """Rows with start <= order < end."""
    rows = worklist.where(F.col(order) >= start)
    return rows if end is None else rows.where(F.col(order) < end)


def preview(rows: DataFrame, order: str, n: int = 5) -> DataFrame:
    """The first ``n`` rows by a column."""
    return rows.orderBy(order).limit(n)


def first_entities(worklist: DataFrame, n: int, start: int = 0, order: str = "ord") -> DataFrame:
    """From ``start`` on, the rows before the (n+1)-th distinct entity begins."""
    rows = piece(worklist, start, None, order)
    firsts = rows.groupBy("entity").agg(F.min(order).alias("at")).orderBy("at").limit(n + 1)
    end = firsts.agg(F.when(F.count(F.lit(1)) > n, F.max("at")).alias("end"))
    return rows.crossJoin(F.broadcast(end)).where(F.col("end").isNull() | (F.col(order) < F.col("end"))).drop("end")


def id_order(ids: Iterable[Any]) -> list[Any]:
    """Digit strings first, by number; everything else by its text, integers too."""
    return sorted(ids, key=lambda x: (0, int(x), "") if isinstance(x, str) and x.isdigit() else (1, 0, str(x)))


def sample_size(total: int, ratio: float, available: int) -> int:
    n = min(int(total * ratio), available)
    if n <= 0:
        raise ValueError("the sample would be empty")
    return n


def id_key(rows: DataFrame, column: str) -> Column:
    """A string that sorts as :func:`id_order` does; digits are ASCII ones."""
    text = F.col(column).cast("string")
    other = F.concat(F.lit("1"), text)
    if dict(rows.dtypes)[column] != "string":
        return other
    digits = F.regexp_replace(text, "^0+", "")
    number = F.concat(F.lit("0"), F.lpad(F.length(digits).cast("string"), 10, "0"), digits)
    return F.when(text.rlike(r"^[0-9]+\z"), number).otherwise(other)


def seeded_sample(rows: DataFrame, id_column: str, n: int, seed: int = 42) -> DataFrame:
    """Rows of n ids drawn with Python's generator from all ids in :func:`id_order`.

    The generator draws places only, so the ids stay where they are: they are ranged by
    their order and counted by range, and the driver holds the n drawn places. Ids that
    are the same number ("1", "01") go by their text; rows without an id are not drawn.
    """
    key = id_key(rows, id_column)
    ids = rows.select(F.col(id_column).alias("id"), key.alias("key")).where("id IS NOT NULL").distinct()
    ranged = saved(ids.repartitionByRange("key", "id").withColumn("range", F.spark_partition_id()), "ids")
    sizes = ranged.groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    inside = F.row_number().over(Window.partitionBy("range").orderBy("key", "id")) - 1
    placed = ranged.withColumn("inside", inside).join(small(first), "range").select("id", (F.col("first") + F.col("inside")).alias("place"))
    drawn = random.Random(seed).sample(range(total), min(n, total))
    places = rows.sparkSession.createDataFrame(pd.DataFrame({"place": pd.Series(drawn, dtype="int64")}), "place long")
    chosen = placed.join(small(places), "place", "left_semi").select(F.col("id").alias(id_column))
    return rows.join(small(chosen), id_column, "left_semi")


def shuffled_cut(rows: DataFrame, names: str = "names", entity: str = "entity", most: int = 50, seed: int = 123) -> DataFrame:
    """Arrays longer than ``most`` are shuffled by Python's generator, seeded with seed + entity, and cut."""
    schema = rows.schema

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            def cut(x, e):
                x = list(x)
                if len(x) > most:
                    random.Random(seed + int(e)).shuffle(x)
                    x = x[:most]
                return x

            f[names] = [cut(x, e) for x, e in zip(f[names], f[entity], strict=True)]
            yield f

    return rows.mapInPandas(run, schema)
