"""Flows: DataFrames with an explicit order, and the operators that turn one into another.

A ``Flow`` is a DataFrame plus the columns that order it, optionally the columns that split it into independent
streams (``key``) and the column of arrival times (``clock``). An ``Operator`` is a function from flow to flow;
``then`` and ``compose`` chain operators downstream and upstream, and a chain is an operator again. A flow is a plan, run by
a terminal (``collect``, ``for_each``) or by a station's action. Operators that need the order of a whole flow, or where it
ends, run jobs while the plan is made: they stage the ordered rows, or bring one row to the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Flow:
    df: DataFrame
    order: tuple[str, ...]
    key: tuple[str, ...] = ()
    clock: str | None = None

    def then(self, *ops: Operator | Callable[[Flow], Flow]) -> Flow:
        """Apply operators one after the other."""
        out = self
        for op in ops:
            out = op(out)
        return out

    def into(self, sink: Callable[[Flow], Any]) -> Station:
        """Connect to a sink; nothing runs before the station does."""
        return Station(self, sink)

    def with_df(self, df: DataFrame, **changes) -> Flow:
        return replace(self, df=df, **changes)

    def keyed(self, *key: str) -> Flow:
        return replace(self, key=key)

    def window(self) -> WindowSpec:
        """Rows of each stream in order. Only keyed flows have one; whole streams use ``plans.ordinal``."""
        if not self.key:
            raise ValueError("a window over a flow without key would be a single task")
        return Window.partitionBy(*self.key).orderBy(*self.order)

    def collect(self, *aggregates: Column) -> DataFrame:
        """Terminal: reduce the flow, or each of its streams, to one row."""
        return self.df.groupBy(*self.key).agg(*aggregates) if self.key else self.df.agg(*aggregates)

    def for_each(self, consume: Callable[[Any], None]) -> None:
        """Terminal: call ``consume`` on each row, on the executors."""
        self.df.foreach(consume)

    def rows(self) -> list:
        """Terminal for small flows: all rows in order, on the driver."""
        return self.df.orderBy(*self.order).collect()


class Operator:
    """A function from flow to flow that can be chained."""

    def __init__(self, apply: Callable[[Flow], Flow], name: str = "operator"):
        self.apply, self.name = apply, name

    def __call__(self, flow: Flow) -> Flow:
        return self.apply(flow)

    def then(self, other: Operator) -> Operator:
        """This one, then ``other`` downstream of it."""
        return Operator(lambda f: other(self(f)), f"{self.name}|{getattr(other, 'name', 'operator')}")

    def compose(self, other: Operator) -> Operator:
        """``other`` upstream of this one."""
        return Operator(lambda f: self(other(f)), f"{getattr(other, 'name', 'operator')}|{self.name}")

    def __repr__(self) -> str:
        return f"Operator({self.name})"


def chain(*ops: Operator) -> Operator:
    """Operators in the order of flow; none at all is the identity."""
    out = Operator(lambda f: f, "identity")
    for op in ops:
        out = out.then(op)
    return out


@dataclass
class Station:
    """A closed connection from a flow to a sink. ``run`` is the action."""

    flow: Flow
    sink: Callable[[Flow], Any]

    def run(self) -> Any:
        return self.sink(self.flow)


def proxied(*wrapped: Operator, before: Callable[[Flow], Flow] | None = None, after: Callable[[Flow], Flow] | None = None) -> Operator:
    """Base for operators that wrap others and change only what goes in or comes out."""
    inner = chain(*wrapped)
    return Operator(lambda f: (after or (lambda x: x))(inner((before or (lambda x: x))(f))), "proxied")


def position_columns(order: Sequence[str]) -> list[Column]:
    return [F.col(c) for c in order]
