"""Mapping in parallel: Spark's tasks are the workers; order is a column and survives."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..flow import Flow, Operator


def _spread(f: Flow, concurrency: int, *by: str):
    if concurrency < 1:
        raise ValueError("there must be a worker")
    return f.df.repartition(concurrency, *by) if by else f.df.repartition(concurrency)


def map_balance_ordered(value: Column | None = None, name: str = "value", concurrency: int | None = None, batches: Callable | None = None, schema: str | None = None) -> Operator:
    """Map rows in parallel; output in input order, nulls dropped.

    An expression needs no exchange: the scan's own partitions are the workers. ``concurrency`` spreads rows over so
    many tasks first, for functions over Arrow batches that wait (on IO, say) more than they compute.
    """

    def apply(f: Flow) -> Flow:
        rows = _spread(f, concurrency) if concurrency else f.df
        if batches:
            return f.with_df(rows.mapInArrow(batches, schema))
        return f.with_df(rows.withColumn(name, value).where(F.col(name).isNotNull()))

    return Operator(apply, "map_balance_ordered")


def map_balance_partitioned(classifier: Column, value: Column | None = None, name: str = "value", concurrency: int = 8, permits: int = 1, batches: Callable | None = None, schema: str | None = None, key: str = "k") -> Operator:
    """The same with at most ``permits`` workers on the rows of one key, which they see in order.

    With as many permits as workers keys don't matter and it is ``map_balance_ordered``. A null key is an error.
    """
    if permits < 1:
        raise ValueError("a key needs a permit")

    def apply(f: Flow) -> Flow:
        checked = F.when(classifier.isNull(), F.raise_error(F.lit("a key must not be null"))).otherwise(classifier)
        f = f.with_df(f.df.withColumn(key, checked))
        if permits >= concurrency:
            return map_balance_ordered(value, name, concurrency, batches, schema)(f)
        part = F.pmod(F.xxhash64(*f.order), F.lit(permits)).cast("int")
        rows = f.df.withColumn("__permit", part).repartition(concurrency, key, "__permit").sortWithinPartitions(key, *f.order).drop("__permit")
        if batches:
            return f.with_df(rows.mapInArrow(batches, schema))
        return f.with_df(rows.withColumn(name, value).where(F.col(name).isNotNull()))

    return Operator(apply, "map_balance_partitioned")


def balance_merge_source(concurrency: int, value: Column, name: str = "value") -> Operator:
    """Workers take rows as they come; results in any order, nulls dropped."""
    return Operator(lambda f: f.with_df(_spread(f, concurrency).withColumn(name, value).where(F.col(name).isNotNull())), "balance_merge_source")


def balance_merge_sink(concurrency: int, value: Column, name: str = "value") -> Operator:
    """The same seen from the consumer's side."""
    return Operator(balance_merge_source(concurrency, value, name).apply, "balance_merge_sink")
