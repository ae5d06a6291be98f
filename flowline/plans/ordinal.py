"""Positions and running values over a whole ordered stream, without a single-partition window.

Spark rows have no order, so an ordered stream is a DataFrame with an ordering key. What is needed of the order
is computed in two passes: rows are range-partitioned and sorted, each row gets a number inside its partition and
the result is staged (range boundaries are sampled, a second computation could cut elsewhere); then one row for
each partition gives what comes before it, and is broadcast: as many rows as there are partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import stage

PART, ROW = "__part", "__row"


def ordered_parts(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Staged rows with their range partition and their number in it (from 0)."""
    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # The id's upper bits are the partition, its lower 33 bits count rows in the order they come.
    numbered = sorted_.withColumn("__id", F.monotonically_increasing_id())
    numbered = numbered.withColumn(PART, F.shiftright("__id", 33)).withColumn(ROW, F.col("__id").bitwiseAND((1 << 33) - 1))
    return stage(numbered.drop("__id"), "ordered")


_TOTAL = {"sum": F.sum, "max": F.max, "last": lambda c: F.last(c, ignorenulls=True)}


def _before(parts: DataFrame, totals: dict[str, tuple[str, Column]]) -> DataFrame:
    """For each partition the totals over the partitions before it (null before the first)."""
    of = lambda kind, c: F.max_by(c, F.when(c.isNotNull(), F.col(ROW))) if kind == "last" else _TOTAL[kind](c)
    per = parts.groupBy(PART).agg(*[of(kind, c).alias(n) for n, (kind, c) in totals.items()])
    earlier = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    return per.select(F.col(PART).alias("__of"), *[_TOTAL[kind](n).over(earlier).alias(f"{n}__b") for n, (kind, _) in totals.items()])


def with_position(df: DataFrame, order: Sequence[str], name: str = "pos") -> DataFrame:
    """Add the 0-based position of each row in the order."""
    return with_running(df, order, {}, name)


def with_running(df: DataFrame, order: Sequence[str], totals: dict[str, tuple[str, Column]], position: str = "pos") -> DataFrame:
    """Add the position and running totals up to and with each row: name -> ("sum", "max" or "last", column); last: of the values that aren't null."""
    parts = ordered_parts(df, order)
    before = F.broadcast(_before(parts, {"__n": ("sum", F.lit(1)), **totals}))
    local = Window.partitionBy(PART).orderBy(ROW).rowsBetween(Window.unboundedPreceding, 0)
    out = parts.withColumns({n: _TOTAL[kind](c).over(local) for n, (kind, c) in totals.items()}) if totals else parts
    out = out.join(before, F.col(PART) == F.col("__of"))
    both = {"sum": lambda n: F.coalesce(F.col(f"{n}__b"), F.lit(0)) + F.coalesce(F.col(n), F.lit(0)), "max": lambda n: F.greatest(f"{n}__b", n), "last": lambda n: F.coalesce(n, f"{n}__b")}
    out = out.withColumns({**{n: both[kind](n) for n, (kind, _) in totals.items()}, position: F.col(ROW) + F.coalesce(F.col("__n__b"), F.lit(0))})
    return out.drop(PART, ROW, "__of", "__n__b", *[f"{n}__b" for n in totals])


def with_neighbours(df: DataFrame, order: Sequence[str], value: str, back: int, name: str, position: str = "pos") -> DataFrame:
    """Add the position and an array of the last ``back`` values up to the row (fewer at the start).

    Each row is sent to the block of positions it is in and, if it is among the last of a block, to the next one, so
    windows never need more than one block.
    """
    block = max(1024, 4 * back)
    rows = with_position(df, order, position).withColumn("__block", F.floor(F.col(position) / block))
    extra = rows.where(F.pmod(F.col(position), F.lit(block)) >= block - back + 1).withColumn("__block", F.col("__block") + 1).withColumn("__own", F.lit(False))
    both = rows.withColumn("__own", F.lit(True)).union(extra)
    last = Window.partitionBy("__block").orderBy(position).rowsBetween(-(back - 1), 0)
    return both.withColumn(name, F.collect_list(value).over(last)).where("__own").drop("__own", "__block")


def with_next(df: DataFrame, order: Sequence[str], values: dict[str, str]) -> DataFrame:
    """Add columns of the next row in the order: name -> column; null for the last row."""
    parts = ordered_parts(df, order)
    first = parts.where(F.col(ROW) == 0).select(F.col(PART).alias("__of"), *[F.col(c).alias(f"{n}__f") for n, c in values.items()])
    later = Window.orderBy("__of").rowsBetween(1, 1)
    # The next partition that has rows; one row for each partition.
    first = first.select("__of", *[F.first(f"{n}__f").over(later).alias(f"{n}__f") for n in values])
    local = Window.partitionBy(PART).orderBy(ROW)
    out = parts.withColumns({n: F.lead(c).over(local) for n, c in values.items()}).withColumn("__end", F.lead(ROW).over(local).isNull())
    out = out.join(F.broadcast(first), F.col(PART) == F.col("__of"))
    out = out.withColumns({n: F.when(F.col("__end"), F.col(f"{n}__f")).otherwise(F.col(n)) for n in values})
    return out.drop(PART, ROW, "__of", "__end", *[f"{n}__f" for n in values])
