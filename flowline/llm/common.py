"""Helpers that the training-data operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..plans.staging import stage as spill

__all__ = ["slices", "spill", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches, rows: int = 256, size: int = 1 << 20):
    """Cut Arrow batches so that each piece has few rows and, but for one long row, few bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        start = 0
        while start < batch.num_rows:
            n = min(rows, batch.num_rows - start)
            while n > 1 and batch.slice(start, n).nbytes > size:
                n //= 2
            yield batch.slice(start, n)
            start += n
