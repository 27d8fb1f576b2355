"""Array arithmetic as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(a: Column) -> Column:
    """Scaled to length 1; a zero vector stays."""
    n = F.sqrt(dot(a, a))
    return F.transform(a, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))


def softmax(a: Column) -> Column:
    top = F.array_max(a)
    e = F.transform(a, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, y: s + y))


def yes_probability(p_yes: Column, p_no: Column) -> Column:
    """p_yes among the two answers; 0.5 where neither is there."""
    total = F.coalesce(p_yes, F.lit(0.0)) + F.coalesce(p_no, F.lit(0.0))
    return F.when(total > 0, F.coalesce(p_yes, F.lit(0.0)) / total).otherwise(F.lit(0.5))


def last_position(a: Column, part: Column) -> Column:
    """Where ``part`` last occurs as a run in ``a``, from 0; null if nowhere or empty."""
    n = F.size(part)
    places = F.filter(F.sequence(F.lit(1), F.greatest(F.size(a) - n + 1, F.lit(1))), lambda i: F.slice(a, i, n) == part)
    return F.when(n > 0, F.try_element_at(places, F.lit(-1)) - 1)


def first_position(items: Column, part: Column) -> Column:
    """Where ``part`` first occurs in ``items``, from 0, or null."""
    n = F.size(part)
    starts = F.when(F.size(items) >= n, F.sequence(F.lit(0), F.size(items) - n))
    return F.get(F.filter(starts, lambda i: F.slice(items, i + 1, n) == part), F.lit(0))


def decision_position(tokens: Column, line: Column, variants: list[Column]) -> Column:
    """The step of the decision among generated tokens, or null.

    The final line is sought from the end, and in it the first variant of the decision
    that occurs; failing that, the last place of the first variant counts.
    """
    inside = F.coalesce(*(first_position(line, v) for v in variants))
    return F.coalesce(last_position(tokens, line) + inside, last_position(tokens, variants[0]))


def decision_probability(position: Column, yes: Column, no: Column) -> Column:
    """p_yes / (p_yes + p_no) at a step, from arrays by step; 0.5 without a step, p_yes where both are 0."""
    y, n = F.get(yes, position.cast("int")), F.get(no, position.cast("int"))
    return F.coalesce(F.when(y + n > 0, y / (y + n)).otherwise(y), F.lit(0.5))
