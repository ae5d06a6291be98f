"""Sources: tables, rows at hand, one-shot iterators, and partitions made by a function on the executors."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..flow import Flow


def from_frame(df: DataFrame, *order: str, key: tuple[str, ...] = (), clock: str | None = None) -> Flow:
    """A flow over a DataFrame with a column (or more) that orders it."""
    return Flow(df, order, key, clock)


def from_rows(spark: SparkSession, rows: Iterable[tuple], schema: str, close: Callable[[], None] | None = None) -> Flow:
    """Rows from the driver in their order; a null row is an error. ``close`` runs once they are read, or reading failed."""
    try:
        numbered = []
        for i, row in enumerate(rows):
            if row is None:
                raise ValueError("a source must not give null")
            numbered.append((i, *row))
    finally:
        if close:
            close()
    return Flow(spark.createDataFrame(numbered, f"pos long, {schema}"), ("pos",))


def one_shot(spark: SparkSession, rows: Iterator[tuple], schema: str) -> Callable[[], Flow]:
    """A source that gives its rows once; drained again it is empty."""
    taken = iter(rows)
    return lambda: from_rows(spark, taken, schema)


class _Part(InputPartition):
    def __init__(self, value: int):
        super().__init__(value)


def from_callable(spark: SparkSession, name: str, produce: Callable[[int], Iterable[tuple]], partitions: int, schema: str, *order: str) -> Flow:
    """A data source of one's own: ``produce(i)`` yields the rows of partition i, on an executor."""

    class Reader(DataSourceReader):
        def partitions(self):
            return [_Part(i) for i in range(partitions)]

        def read(self, partition: Any):
            yield from produce(partition.value)

    class Source(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return schema

        def reader(self, schema):
            return Reader()

    spark.dataSource.register(Source)
    return Flow(spark.read.format(name).load(), order)
