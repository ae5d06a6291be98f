"""The timed boundaries of ``operators.timed`` over streams.

The folds are the same; what changes is who drives them. A key's state lives in the state store, rows of a
micro-batch are taken in order of their time, and what leaves in the future becomes an event-time timer
that fires once the watermark has passed it. So every boundary that runs over tables runs over streams, with the
same outputs and emission times; what still waits when a stream ends stays in the state, to go on from.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BinaryType, StructField, StructType, _parse_datatype_string

from ..flow import Flow, Operator
from ..operators.timed import MAX, Boundary, Timed, as_fold


def stream_flow(df: DataFrame, *order: str, clock: str | None = None, late: str = "0 seconds") -> Flow:
    """A flow over a streaming DataFrame; with a timestamp ``clock``, a watermark that allows for rows so late.

    Operators of ``operators.narrow`` and the fans without limits apply to it as they are.
    """
    return Flow(df.withWatermark(clock, late) if clock else df, order, (), clock)


class BoundaryProcessor(StatefulProcessor):
    """Outputs that leave later than what has been seen wait in the state, for a timer."""

    def __init__(self, make: Callable[[], Boundary | Timed], schema: StructType, clock: str, order: tuple[str, ...], emit: str):
        self.make, self.schema, self.clock, self.order, self.emit = make, schema, clock, order, emit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("boundary", StructType([StructField("held", BinaryType())]))

    def _load(self):
        fold = as_fold(self.make, self.clock, self.emit)
        return fold, *(pickle.loads(self.held.get()[0]) if self.held.exists() else (fold.start(), []))

    def _give(self, fold: Timed, state, waiting: list[dict], until: int) -> Iterator[pd.DataFrame]:
        now = [x for x in waiting if x[self.emit] <= until]
        waiting = [x for x in waiting if x[self.emit] > until]
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        due = min([fold.next_due(state), *(x[self.emit] for x in waiting)])
        if until < due < MAX:
            # Timers count milliseconds; one that fires within the deadline's millisecond is not too early by more.
            self.handle.registerTimer(-(-due // 1000))
        self.held.update((pickle.dumps((state, waiting)),))
        if now:
            yield pd.DataFrame(now, columns=self.schema.names)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        fold, state, waiting = self._load()
        new = pd.concat(list(rows)).sort_values([self.clock, *self.order], kind="stable")
        for row in new[[c for c in new.columns if c in self.schema.names]].to_dict("records"):
            waiting += fold.step(state, row)
        yield from self._give(fold, state, waiting, int(new[self.clock].iloc[-1]))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        fold, state, waiting = self._load()
        until = expiredTimerInfo.getExpiryTimeInMs() * 1000
        waiting += fold.due(state, until)
        yield from self._give(fold, state, waiting, until)


def stream_boundary(make: Callable[[], Boundary | Timed], schema: str, clock: str, event_time: str, emit: str = "emit_us") -> Operator:
    """``timed.boundary`` for a streaming flow, keyed; ``clock`` is in microseconds, ``event_time`` its watermarked timestamp.

    ``schema`` has the columns that pass through, and ``emit``. The session must keep its state in RocksDB.
    """
    kind = _parse_datatype_string(schema)

    def apply(f: Flow) -> Flow:
        order = tuple(c for c in f.order if c in kind.names)
        processor = BoundaryProcessor(make, kind, clock, order, emit)
        out = f.df.groupBy(*f.key).transformWithStateInPandas(processor, kind, "Append", "EventTime")
        return f.with_df(out, order=(emit, *order), clock=emit)

    return Operator(apply, "stream_boundary")


def windowed(f: Flow, clock: str, width: str, *aggregates, slide: str | None = None, gap: str | None = None) -> DataFrame:
    """Aggregates by tumbling, sliding or session window of event time, by key."""
    frame = F.session_window(clock, gap) if gap else F.window(clock, width, slide) if slide else F.window(clock, width)
    return f.df.groupBy(frame.alias("window"), *f.key).agg(*aggregates)
