"""Failure, completion and resources."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from contextlib import ExitStack, contextmanager

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType, _parse_datatype_string

from ..flow import Flow, Operator
from ..plans.ordinal import with_position
from ..plans.staging import stage


class UpstreamError(Exception):
    """What a consumer sees when its producer failed; the cause is chained."""


class AsyncError(Exception):
    """A failure of a task that runs beside the caller's."""


def synchronize() -> Operator:
    """Tasks share nothing, so concurrent producers and consumers need no lock: the identity."""
    return Operator(lambda f: f, "synchronize")


synchronize_step_source = synchronize_step_sink = synchronize


def recover(fails: Column, fallback: Callable[[], Flow]) -> Operator:
    """Rows before the first one that fails, then the fallback's rows.

    ``fails`` says of each row whether processing it fails; without such a row there is no fallback.
    """

    def apply(f: Flow) -> Flow:
        place = F.struct(*f.order)
        first = f.df.where(fails).select(place.alias("p")).orderBy("p").limit(1).collect()  # one row
        if not first:
            return f.with_df(f.df.withColumn("src", F.lit(0)), order=("src", *f.order))
        head = f.df.where(place < F.struct(*[F.lit(first[0].p[c]).alias(c) for c in f.order]))
        other = fallback()
        rest = with_position(other.df, other.order, "__pos") if other.order != f.order else other.df
        return f.with_df(head.withColumn("src", F.lit(0)).unionByName(rest.withColumn("src", F.lit(1)), allowMissingColumns=True), order=("src", *f.order))

    return Operator(apply, "recover")


recover_step = recover


def recover_processing(process: Callable[[dict], dict], schema: str, fallback: Callable[[str], Flow]) -> Operator:
    """Rows through ``process`` up to the first one at which it raises, then the rows of ``fallback``, which is told the error.

    Each row is tried once, on the executors, in Arrow batches; what it makes has ``schema``, with the order's columns.
    """
    kind = _parse_datatype_string(schema)
    tried = StructType([*kind.fields, StructField("__error", StringType())])

    def attempt(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                try:
                    out.append({**process(row), "__error": None})
                except Exception as e:  # noqa: BLE001 - any failure of the processing is what this is for
                    out.append({**{k: v for k, v in row.items() if k in kind.names}, "__error": f"{type(e).__name__}: {e}"})
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=to_arrow_schema(tried))

    def apply(f: Flow) -> Flow:
        done = f.with_df(stage(f.df.mapInArrow(attempt, tried), "tried"))
        first = done.df.where("__error is not null").orderBy(*f.order).select("__error").limit(1).collect()  # one row
        out = recover(F.col("__error").isNotNull(), lambda: fallback(first[0][0]))(done)
        return out.with_df(out.df.drop("__error"))

    return Operator(apply, "recover_processing")


def recover_run(run: Callable[[], object], fallback: Callable[[BaseException], object]) -> object:
    """For failures only an action shows: run, or else the fallback. If that fails too, its error carries the first."""
    try:
        return run()
    except Exception as e:
        try:
            other = fallback(e)
        except Exception:  # no fallback was made: the original counts
            raise e from None
        if callable(other):
            try:
                return other()
            except Exception as again:
                raise UpstreamError(str(again)) from e
        return other


def also_complete(trailer: Flow) -> Operator:
    """When the flow completes, the trailer follows."""

    def apply(f: Flow) -> Flow:
        both = f.df.withColumn("src", F.lit(0)).unionByName(trailer.df.withColumn("src", F.lit(1)), allowMissingColumns=True)
        return f.with_df(both, order=("src", *f.order))

    return Operator(apply, "also_complete")


@contextmanager
def also_close(*resources: Callable[[], None]):
    """Close resources with the block, in reverse; the first error wins, others are noted on it."""
    try:
        yield
    finally:
        composed(reversed(resources))


def composed(actions: Iterable[Callable[[], None]]) -> None:
    """Call all; raise the first error, with later ones attached as notes."""
    first: BaseException | None = None
    for act in actions:
        try:
            act()
        except BaseException as e:  # noqa: BLE001 - every action must get its turn
            if first is None:
                first = e
            else:
                first.add_note(f"also: {e!r}")
    if first is not None:
        raise first


composed_close = composed_complete = composed


def composed_complete_abruptly(actions: Iterable[Callable[[BaseException], None]], cause: BaseException) -> None:
    """Tell all consumers of a failure."""
    composed([lambda a=a: a(cause) for a in actions])


class FailureHandlingScope(ExitStack):
    """Runs tasks side by side; a failed one is handed to ``handler`` while its siblings go on."""

    def __init__(self, handler: Callable[[BaseException], None], workers: int = 8):
        from concurrent.futures import ThreadPoolExecutor

        super().__init__()
        self.handler, self.pool, self.futures = handler, ThreadPoolExecutor(workers), []
        self.callback(self.join)

    def fork(self, task: Callable[[], object]):
        self.futures.append(self.pool.submit(task))
        return self.futures[-1]

    def join(self) -> None:
        for f in self.futures:
            if (e := f.exception()) is not None:
                self.handler(e)
        self.futures = []
        self.pool.shutdown()
