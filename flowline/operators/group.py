"""Keyed grouping and splitting into consecutive segments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..flow import Flow, Operator
from ..plans.ordinal import with_running


def group_by(classifier: Column, key: str = "k", first: str | None = None, of: str | None = None) -> Operator:
    """A stream for each key; with ``first``, the value ``of`` the key's first row is added to all its rows.

    A null key is an error. The first value is an aggregate joined back, so a hot key is split like any skewed join.
    """

    def apply(f: Flow) -> Flow:
        checked = F.when(classifier.isNull(), F.raise_error(F.lit("a group's key must not be null"))).otherwise(classifier)
        rows = f.df.withColumn(key, checked)
        if first:
            firsts = rows.groupBy(key).agg(F.min_by(of, F.struct(*f.order)).alias(first))
            rows = rows.join(firsts, key)
        return f.with_df(rows, key=(key,))

    return Operator(apply, "group_by")


def take_each(n: int) -> Operator:
    """Each stream's consumer cancels after ``n`` rows: later rows of the key are dropped, other keys go on."""

    def apply(f: Flow) -> Flow:
        return f.with_df(f.df.withColumn("rn", F.row_number().over(f.window())).where(F.col("rn") <= n))

    return Operator(apply, "take_each")


def take_each_eager(n: int) -> Operator:
    """The whole flow ends with the row that makes any key's consumer cancel, its ``n``-th."""

    def apply(f: Flow) -> Flow:
        nth = f.df.withColumn("__rn", F.row_number().over(f.window())).where(F.col("__rn") == n)
        place = F.struct(*f.order)
        cut = nth.select(place.alias("p")).orderBy("p").limit(1).collect()  # one row
        if not cut:
            return f
        return f.with_df(f.df.where(place <= F.struct(*[F.lit(cut[0].p[c]).alias(c) for c in f.order])))

    return Operator(apply, "take_each_eager")


def split(predicate: Column, after: bool = False, segment: str = "segment", first: str | None = None, of: str | None = None) -> Operator:
    """Number consecutive segments from 1. A row with ``predicate`` opens one or, with ``after``, ends one.

    The first row opens a segment in any case.
    """

    def apply(f: Flow) -> Flow:
        hit = F.coalesce(predicate, F.lit(False)).cast("long")
        if f.key:
            running = F.sum(hit).over(f.window().rowsBetween(Window.unboundedPreceding, 0))
            rows = f.df.withColumns({"__hits": running, "__hit": hit, "__first": F.row_number().over(f.window()) == 1})
            opening = F.first("__hit").over(f.window().rowsBetween(Window.unboundedPreceding, 0))
        else:
            rows = with_running(f.df.withColumn("__hit", hit), f.order, {"__hits": ("sum", F.col("__hit"))}, "__pos")
            opened = rows.where(F.col("__pos") == 0).select("__hit").collect()  # one row
            opening = F.lit(opened[0][0] if opened else 0)
        # before: hits so far, plus one if the first row, which opens a segment, is none; after: hits before the row, plus one
        number = F.col("__hits") - F.col("__hit") + 1 if after else F.col("__hits") + 1 - opening
        rows = rows.withColumn(segment, number.cast("long")).drop("__hits", "__hit", "__first", "__pos")
        if first:
            keys = [*f.key, segment]
            rows = rows.join(rows.groupBy(*keys).agg(F.min_by(of, F.struct(*f.order)).alias(first)), keys)
        return f.with_df(rows)

    return Operator(apply, "split")


def split_take(predicate: Column, n: int, key: Sequence[str] = (), segment: str = "segment", after: bool = False, eager: bool = False) -> Operator:
    """Segments whose consumer cancels after ``n`` rows: the next row opens a new segment, matched or not.

    If ``eager``, the flow (or each of its streams) ends instead with the row at which the first consumer cancels.
    """

    def apply(f: Flow) -> Flow:
        base = split(predicate, after, segment if eager else "__base")(f.keyed(*key))
        inner = F.row_number().over(base.keyed(*key, segment if eager else "__base").window())
        rows = base.df.withColumn("__n", inner)
        if not eager:
            rows = rows.withColumn("__opens", (F.pmod(F.col("__n") - 1, F.lit(n)) == 0).cast("long"))
            if key:
                rows = rows.withColumn(segment, F.sum("__opens").over(base.window().rowsBetween(Window.unboundedPreceding, 0)))
            else:
                rows = with_running(rows, base.order, {segment: ("sum", F.col("__opens"))}, "__pos")
            return base.with_df(rows.drop("__opens", "__base", "__n", "__pos"))
        if key:
            before = F.max(F.col("__n") == n).over(base.window().rowsBetween(Window.unboundedPreceding, -1))
            return base.with_df(rows.withColumn("__done", F.coalesce(before, F.lit(False))).where("not __done").drop("__done", "__n"))
        place = F.struct(*base.order)
        end = rows.where(F.col("__n") == n).select(place.alias("p")).orderBy("p").limit(1).collect()  # one row
        if end:
            rows = rows.where(place <= F.struct(*[F.lit(end[0].p[c]).alias(c) for c in base.order]))
        return base.with_df(rows.drop("__n"))

    return Operator(apply, "split_take")
