"""Collectors as aggregates, merged map-side by Spark; ordered ones take the ordering columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def counting(name: str = "n") -> Column:
    return F.count(F.lit(1)).alias(name)


def summing(c: str | Column, name: str = "total") -> Column:
    return F.sum(c).alias(name)


def averaging(c: str | Column, name: str = "average") -> Column:
    return F.avg(c).alias(name)


def minimum(c: str | Column, name: str = "low") -> Column:
    return F.min(c).alias(name)


def maximum(c: str | Column, name: str = "high") -> Column:
    return F.max(c).alias(name)


def to_list(c: str, *order: str, name: str = "items") -> Column:
    """Values in order. For bounded groups: a list is one value of one row."""
    held = F.array_sort(F.collect_list(F.struct(*order, F.col(c).alias("__v"))))
    return F.transform(held, lambda x: x["__v"]).alias(name)


def joining(c: str, separator: str, *order: str, name: str = "joined") -> Column:
    return F.array_join(to_list(c, *order), separator).alias(name)


def reducing(c: str, initial: Column, merge: Callable[[Column, Column], Column], *order: str, name: str = "result") -> Column:
    """A fold in order over a bounded group's values, as an expression."""
    return F.aggregate(to_list(c, *order), initial, merge).alias(name)
