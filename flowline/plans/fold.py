"""Ordered folds: state carried from row to row of a stream, for what no built-in expression says.

Rows of a stream meet in one task, sorted on disk if need be, and are run through batch by batch, so memory holds one
Arrow batch and one state, whatever the length of a stream. Streams are independent: the more keys, the more tasks.

A flow without key is one stream, and its fold one row after the other by nature. Its rows never meet in one task even so:
they are range-partitioned, and one part after the other is folded by a job of its own that begins with the state the last
one ended with. What goes through the driver is that state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, StructField, StructType, _parse_datatype_string

from pyspark import cloudpickle
from pyspark.sql import functions as F

from ..flow import Flow
from .ordinal import PART, ROW, ordered_parts
from .staging import stage


class Fold:
    """``start`` makes a stream's state, ``step`` takes a row (a dict), ``finish`` is called at the stream's end."""

    def start(self) -> Any:
        return None

    def step(self, state: Any, row: dict) -> Iterable[dict]:
        raise NotImplementedError

    def finish(self, state: Any) -> Iterable[dict]:
        return ()


def ordered_fold(flow: Flow, make: Callable[[], Fold], schema: str | StructType) -> Flow:
    """Run a fold over each stream of a flow."""
    out_type = _parse_datatype_string(schema) if isinstance(schema, str) else schema
    if not flow.key:
        return _handed_over(flow, make, out_type)
    key = list(flow.key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow, fold, now, state = to_arrow_schema(out_type), make(), None, None
        for batch in batches:
            out: list[dict] = []
            for row in batch.to_pylist():
                own = tuple(row[k] for k in key)
                if own != now:
                    if now is not None:
                        out.extend(fold.finish(state))
                    now, state = own, fold.start()
                out.extend(fold.step(state, row))
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)
        if now is not None and (rest := list(fold.finish(state))):
            yield pa.RecordBatch.from_pylist(rest, schema=arrow)

    rows = flow.df.repartition(*key).sortWithinPartitions(*key, *flow.order)
    return flow.with_df(rows.mapInArrow(run, out_type))


def _handed_over(flow: Flow, make: Callable[[], Fold], out_type: StructType) -> Flow:
    """The fold over a whole flow, part by part."""
    spark, held = flow.df.sparkSession, StructType([*out_type.fields, StructField("__state", BinaryType())])
    parts = ordered_parts(flow.df, flow.order)
    numbers = sorted(r[0] for r in parts.select(PART).distinct().collect())
    out, before = spark.createDataFrame([], out_type), None
    for number in numbers:

        def run(batches: Iterator[pa.RecordBatch], before=before, ends=number == numbers[-1]) -> Iterator[pa.RecordBatch]:
            arrow, fold = to_arrow_schema(held), make()
            state = fold.start() if before is None else cloudpickle.loads(before)
            for batch in batches:
                if rows := [x for row in batch.to_pylist() for x in fold.step(state, row)]:
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)
            rest = [*fold.finish(state)] if ends else [{"__state": cloudpickle.dumps(state)}]
            if rest:
                yield pa.RecordBatch.from_pylist(rest, schema=arrow)

        rows = parts.where(F.col(PART) == number).coalesce(1).sortWithinPartitions(ROW).drop(PART, ROW)
        done = stage(rows.mapInArrow(run, held), "folded")
        if number != numbers[-1]:
            before = bytes(done.where("__state is not null").first()["__state"])
        out = out.union(done.where("__state is null").drop("__state"))
    return flow.with_df(out)
