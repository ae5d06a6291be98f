"""Operators that need no exchange: map, filter, flat-map, and branch-wise adapters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..flow import Flow, Operator


def filter_map(value: Column, name: str = "value") -> Operator:
    """Map each row to ``value``; rows for which that is null are dropped."""
    return Operator(lambda f: f.with_df(f.df.withColumn(name, value).where(F.col(name).isNotNull())), "filter_map")


def filter_map_batches(fn: Callable, schema: str) -> Operator:
    """The same for an opaque function over Arrow batches, where no expression will do."""
    return Operator(lambda f: f.with_df(f.df.mapInArrow(fn, schema)), "filter_map_batches")


def flat_map(items: Column, name: str = "value", inner: str = "inner") -> Operator:
    """Concatenate each row's array, in order; null and empty arrays give nothing."""

    def apply(f: Flow) -> Flow:
        out = f.df.select("*", F.posexplode(items).alias(inner, name))
        return f.with_df(out, order=(*f.order, inner))

    return Operator(apply, "flat_map")


def take_while(condition: Column) -> Operator:
    """Keep rows up to the first one for which ``condition`` fails; what comes later is never looked at again."""

    def apply(f: Flow) -> Flow:
        fails = ~F.coalesce(condition, F.lit(False))
        place = F.struct(*f.order)
        if f.key:
            cut = f.df.groupBy(*f.key).agg(F.min(F.when(fails, place)).alias("__cut"))
            rows = f.df.join(cut, list(f.key))
            return f.with_df(rows.where(F.col("__cut").isNull() | (place < F.col("__cut"))).drop("__cut"))
        first = f.df.where(fails).select(place.alias("p")).orderBy("p").limit(1).collect()  # one row
        if not first:
            return f
        return f.with_df(f.df.where(place < F.struct(*[F.lit(first[0].p[c]).alias(c) for c in f.order])))

    return Operator(apply, "take_while")


def adapt_source_of_sink(op: Operator, branch: Callable[[Flow], DataFrame]) -> Callable[[Flow], DataFrame]:
    """One branch of a fan-out with ``op`` in front of it; other branches don't see it."""
    return lambda f: branch(op(f))


def adapt_sink_of_source(op: Operator, source: Flow) -> Flow:
    """One input of a fan-in with ``op`` behind it; other inputs don't see it."""
    return op(source)
