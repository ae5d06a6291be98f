"""Stateful gathering: windows, scans, folds, and any gatherer of one's own."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..flow import Flow, Operator
from ..plans.fold import Fold, ordered_fold
from ..plans.ordinal import with_neighbours, with_position, with_running


def window_sliding(n: int, value: str, name: str = "window") -> Operator:
    """Arrays of each ``n`` consecutive values; streams shorter than n give none."""
    if n < 1:
        raise ValueError("a window has one row at least")

    def apply(f: Flow) -> Flow:
        if f.key:
            out = f.df.withColumn(name, F.collect_list(value).over(f.window().rowsBetween(-(n - 1), 0)))
        else:
            out = with_neighbours(f.df, f.order, value, n, name)
        return f.with_df(out.where(F.size(name) == n))

    return Operator(apply, "window_sliding")


def window_fixed(n: int, value: str, name: str = "window") -> Operator:
    """Arrays of ``n`` values after each other; the last one may be shorter."""
    if n < 1:
        raise ValueError("a window has one row at least")

    def apply(f: Flow) -> Flow:
        rows = f.df.withColumn("pos", F.row_number().over(f.window()) - 1) if f.key else with_position(f.df, f.order)
        rows = rows.withColumn("window_id", F.floor(F.col("pos") / n))
        values = F.transform(F.array_sort(F.collect_list(F.struct("pos", F.col(value).alias("v")))), lambda x: x["v"])
        return f.with_df(rows.groupBy(*f.key, "window_id").agg(values.alias(name)), order=("window_id",))

    return Operator(apply, "window_fixed")


def scan(value: Column, name: str = "total", how: str = "sum") -> Operator:
    """Running sum or maximum up to and with each row."""

    def apply(f: Flow) -> Flow:
        if f.key:
            return f.with_df(f.df.withColumn(name, {"sum": F.sum, "max": F.max}[how](value).over(f.window().rowsBetween(Window.unboundedPreceding, 0))))
        return f.with_df(with_running(f.df, f.order, {name: (how, value)}))

    return Operator(apply, "scan")


def fold(*aggregates: Column) -> Operator:
    """All rows (or each stream) to one row."""
    return Operator(lambda f: f.with_df(f.collect(*aggregates), order=f.key), "fold")


class Gatherer:
    """A gatherer of one's own: ``initial`` state, ``integrate`` (state, row, push) -> go on?, ``finish`` (state, push)."""

    def __init__(self, integrate: Callable[[Any, dict, Callable], bool], initial: Callable[[], Any] = dict, finish: Callable[[Any, Callable], None] | None = None):
        self.integrate, self.initial, self.finish = integrate, initial, finish

    @staticmethod
    def map(fn: Callable[[dict], dict]) -> Gatherer:
        return Gatherer(lambda s, row, push: push(fn(row)) or True)

    @staticmethod
    def flat_map(fn: Callable[[dict], Iterable[dict]]) -> Gatherer:
        def integrate(state, row, push):
            for x in fn(row):
                push(x)
            return True

        return Gatherer(integrate)


def gather(gatherer: Gatherer, schema: str) -> Operator:
    """Run a gatherer over each stream of a keyed flow.

    Once ``integrate`` returns False a stream's further rows are skipped; ``finish`` runs in either case.
    """

    class Run(Fold):
        def start(self):
            return {"own": gatherer.initial(), "open": True}

        def step(self, state, row):
            out: list[dict] = []
            if state["open"]:
                state["open"] = bool(gatherer.integrate(state["own"], row, out.append))
            return out

        def finish(self, state):
            out: list[dict] = []
            if gatherer.finish:
                gatherer.finish(state["own"], out.append)
            return out

    return Operator(lambda f: ordered_fold(f, Run, schema), "gather")
