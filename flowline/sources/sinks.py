"""Sinks: functions over a flow that run it."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

from ..flow import Flow


def for_each(consume: Callable[[Any], None]) -> Callable[[Flow], None]:
    """Each row to ``consume`` on the executors."""
    return lambda f: f.for_each(consume)


def rows_to(consume: Callable[[Iterator[Any]], None]) -> Callable[[Flow], None]:
    """Each partition's rows, in order, to ``consume`` on the executors: one connection a partition, not a row."""
    return lambda f: f.df.sortWithinPartitions(*f.order).foreachPartition(consume)


def batches_to(path: str, fmt: str = "parquet", mode: str = "overwrite") -> Callable[[Flow], None]:
    """Write the flow as files, sorted inside each."""
    return lambda f: f.df.sortWithinPartitions(*f.order).write.format(fmt).mode(mode).save(path)


def collect_list(limit: int = 100_000) -> Callable[[Flow], list]:
    """All rows in order on the driver; more than ``limit`` is an error, not a truncation."""

    def run(f: Flow) -> list:
        got = f.df.orderBy(*f.order).limit(limit + 1).collect()
        if len(got) > limit:
            raise ValueError(f"more than {limit} rows")
        return got

    return run
