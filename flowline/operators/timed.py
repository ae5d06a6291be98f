"""Operators with a clock, over arrival times.

Batch runs have no wall clock, so time is a column of microseconds: rows arrive at their time, the consumer is always
ready (or ready every ``pull_every`` microseconds), arrivals come before timers of the same instant, and the input
completes with its last arrival.

What leaves when follows from the arrivals by a recurrence. Where that is a running maximum, a lag or an explosion,
windows say it (delay, buffer, keep-alive, extrapolate, batches by count); where it isn't, it is a fold with one state and one
step for each arrival (``Timed``: throttle, batches by a deadline, delays with a bounded buffer). ``Boundary`` is the
extension point for boundaries of one's own: hooks that set deadlines, run by one simulation. All work on flows with and
without key, and the folds over streams as well.
"""

from __future__ import annotations

import heapq
from collections import deque
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..flow import Flow, Operator
from ..plans.fold import Fold, ordered_fold
from ..plans.ordinal import with_neighbours, with_next, with_position, with_running

MIN, MAX = -(1 << 63), (1 << 63) - 1


def micros(ts: str | Column) -> Column:
    """Microseconds since 1970 of a timestamp, by its own fields (no time zone involved)."""
    t = F.col(ts) if isinstance(ts, str) else ts
    day = F.datediff(t, F.lit("1970-01-01").cast("date")).cast("long") * 86_400_000_000
    second = (F.extract(F.lit("SECOND"), t) * 1_000_000).cast("long")
    return day + F.hour(t).cast("long") * 3_600_000_000 + F.minute(t).cast("long") * 60_000_000 + second


class Timed(Fold):
    """A fold over arrivals whose outputs say when they leave, as ``emit``. ``due`` is for streams, where time passes without arrivals."""

    clock, emit = "us", "emit_us"

    def due(self, state, until: int) -> Iterable[dict]:
        """What leaves by ``until`` if nothing arrives before."""
        return ()

    def next_due(self, state) -> int:
        return MAX


class Control:
    """What hooks may latch: when the next push and pull may happen, an output, and the end."""

    def __init__(self):
        self.push_at, self.pull_at, self.closed = MIN, MAX, False
        self.output: list = []


class Boundary:
    """Hooks of a boundary between a producer and a consumer. ``now`` is in microseconds."""

    def clock(self, row: dict, column: str) -> int:
        """When a row arrives: a boundary may keep a clock of its own."""
        return row[column]

    def on_init(self, ctl: Control, now: int) -> None: ...

    def on_push(self, ctl: Control, row: dict, now: int) -> None:
        raise NotImplementedError

    def on_pull(self, ctl: Control, now: int) -> None:
        raise NotImplementedError

    def on_complete(self, ctl: Control, now: int) -> None:
        raise NotImplementedError


class _Simulation(Timed):
    """One stream through a boundary: each output is emitted with the time it is pulled at."""

    def __init__(self, make: Callable[[], Boundary], clock: str, emit: str, pull_every: int):
        self.make, self.clock, self.emit, self.pull_every = make, clock, emit, pull_every

    def start(self):
        return {"own": self.make(), "ctl": Control(), "now": None, "ready": MIN, "idle": 0}

    def _pull_until(self, s, limit, inclusive, out, until=lambda: False):
        ctl = s["ctl"]
        while not ctl.closed and not until():
            at = max(ctl.pull_at, s["ready"], s["now"])
            if ctl.pull_at == MAX or (at > limit if inclusive else at >= limit):
                return
            s["now"] = at
            before = (ctl.pull_at, ctl.push_at)
            s["own"].on_pull(ctl, at)
            if ctl.output:
                out.append({**ctl.output.pop(), self.emit: at})
                s["ready"] = at + self.pull_every
                s["idle"] = 0
            else:
                # a hook that neither emits nor moves a deadline would be called forever
                s["idle"] = s["idle"] + 1 if before == (ctl.pull_at, ctl.push_at) else 0
                if s["idle"] > 1:
                    raise RuntimeError("a boundary was pulled without output or a later deadline")

    def step(self, s, row):
        out: list[dict] = []
        at = s["own"].clock(row, self.clock)
        if s["now"] is None:
            s["now"] = at
            s["own"].on_init(s["ctl"], at)
        self._pull_until(s, at, False, out)
        s["now"] = max(s["now"], at)
        if s["ctl"].push_at > s["now"]:  # full: time passes until there is room
            self._pull_until(s, MAX, True, out, until=lambda: s["ctl"].push_at <= s["now"])
        if not s["ctl"].closed:
            s["own"].on_push(s["ctl"], row, s["now"])
            self._pull_until(s, s["now"], True, out, until=lambda: s["ctl"].pull_at > s["now"])
        return out

    def finish(self, s):
        out: list[dict] = []
        s["own"].on_complete(s["ctl"], s["now"])
        self._pull_until(s, MAX, True, out)
        return out


    def due(self, s, until):
        out: list[dict] = []
        self._pull_until(s, until, True, out)
        return out

    def next_due(self, s):
        return s["ctl"].pull_at if s["ctl"].pull_at > s["now"] else MAX


def as_fold(make: Callable[[], Boundary | Timed], clock: str, emit: str = "emit_us", pull_every: int = 0) -> Timed:
    made = make()
    if isinstance(made, Timed):
        made.clock, made.emit = clock, emit
        return made
    return _Simulation(make, clock, emit, pull_every)


def boundary(make: Callable[[], Boundary | Timed], schema: str, clock: str, emit: str = "emit_us", pull_every: int = 0) -> Operator:
    """Run each stream of a flow through a boundary (or timed fold) of one's own; ``schema`` includes ``emit``."""

    def apply(f: Flow) -> Flow:
        out = ordered_fold(f, lambda: as_fold(make, clock, emit, pull_every), schema)
        return out.with_df(out.df, order=(emit, *(c for c in f.order if c in out.df.columns)), clock=emit)

    return Operator(apply, "boundary")


class Throttled(Timed):
    """Rows leave in turn, each once its cost is covered by tokens: one more for each whole interval, ``limit`` at first and at most.

    Row i comes to the front when it has arrived and row i - 1 has left. What it lacks then it waits for, though the
    limit be lower, and leaves nothing over. With a buffer of ``room`` rows the producer can push row i only once row
    i - room has left; that is when row i - 1 leaves at the latest, so ``room`` tells in ``pushed`` alone.
    """

    def __init__(self, interval: int, limit: int, cost: str, room: int | None = None, pushed: str | None = None):
        if interval < 1 or limit < 0 or (room is not None and room < 1):
            raise ValueError("the interval and the buffer must be positive, the limit not negative")
        self.interval, self.limit, self.cost, self.room, self.pushed = interval, limit, cost, room, pushed

    def start(self):
        return {"tokens": self.limit, "since": None, "left": MIN, "waiting": deque(maxlen=self.room or 1)}

    def step(self, s, row):
        at, cost, waiting = row[self.clock], row[self.cost], s["waiting"]
        if cost < 0:
            raise ValueError("a cost must not be negative")
        pushed = max(at, waiting[0]) if self.room and len(waiting) == self.room else at
        front = max(pushed, s["left"])
        since = front if s["since"] is None else s["since"]
        if whole := (front - since) // self.interval:
            since, s["tokens"] = since + whole * self.interval, min(s["tokens"] + whole, self.limit)
        lacks = max(0, cost - s["tokens"])
        s["left"] = since + lacks * self.interval if lacks else front
        s["tokens"], s["since"] = max(0, s["tokens"] - cost), s["left"] if lacks else since
        waiting.append(s["left"])
        yield {**row, self.emit: s["left"], **({self.pushed: pushed} if self.pushed else {})}


class Batched(Timed):
    """Rows into batches that leave at a deadline of their own, told by ``deadline`` from a batch's rows after each arrival.

    None keeps the deadline so far (at first there is none); ``MIN`` closes the batch with this row.
    """

    def __init__(self, deadline: Callable[[list[dict]], int | None], members: str, carry: tuple[str, ...]):
        self.deadline, self.members, self.carry = deadline, members, carry

    def start(self):
        return {"rows": [], "by": MAX, "now": MIN}

    def _close(self, s, at):
        rows = s["rows"]
        s["rows"], s["by"] = [], MAX
        return [{**{c: rows[0][c] for c in self.carry}, self.members: rows, "n": len(rows), self.emit: at}] if rows else []

    def step(self, s, row):
        out = self._close(s, s["by"]) if s["by"] < row[self.clock] else []
        s["now"] = row[self.clock]
        s["rows"].append(row)
        by = self.deadline(s["rows"])
        s["by"] = s["by"] if by is None else max(by, s["now"])
        return [*out, *self._close(s, s["now"])] if by == MIN else out

    def due(self, s, until):
        return self._close(s, s["by"]) if s["by"] <= until else []

    def next_due(self, s):
        return s["by"] if s["rows"] else MAX

    def finish(self, s):
        return self._close(s, min(s["by"], s["now"]) if s["by"] < s["now"] else s["now"])


class Delayed(Timed):
    """Rows leave at their deadline or, if that is past, at once; at most ``limit`` wait, and a full buffer holds arrivals back."""

    def __init__(self, deadline: str, limit: int):
        if limit < 1:
            raise ValueError("a buffer holds one row at least")
        self.deadline, self.limit = deadline, limit

    def start(self):
        return {"heap": [], "n": 0, "now": MIN}

    def _leave(self, s, until):
        while s["heap"] and s["heap"][0][0] <= until:
            by, _, row = heapq.heappop(s["heap"])
            yield {**row, self.emit: max(by, s["now"])}

    def step(self, s, row):
        at = row[self.clock]
        yield from self._leave(s, at - 1)
        if len(s["heap"]) >= self.limit:  # time passes until there is room
            at = max(at, s["heap"][0][0])
            yield from self._leave(s, s["heap"][0][0])
        s["now"] = max(s["now"], at)
        s["n"] += 1
        heapq.heappush(s["heap"], (row[self.deadline], s["n"], row))
        yield from self._leave(s, s["now"])

    def due(self, s, until):
        return self._leave(s, until)

    def next_due(self, s):
        return s["heap"][0][0] if s["heap"] else MAX

    def finish(self, s):
        return self._leave(s, MAX)


def identity(name: str) -> Operator:
    """Boundaries that only hand rows over: Spark's own exchanges buffer, so rows and order stay as they are."""
    return Operator(lambda f: f, name)


def rendezvous() -> Operator:
    return identity("rendezvous")


def _running(f: Flow, name: str, value: Column, position: str) -> DataFrame:
    """Each row's number in its stream (from 0), and the maximum of ``value`` up to it."""
    if not f.key:
        return with_running(f.df, f.order, {name: ("max", value)}, position)
    w = f.window()
    rows = f.df.withColumn(position, F.row_number().over(w).cast("long") - 1)
    return rows.withColumn(name, F.max(value).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def _numbered(f: Flow, position: str) -> Flow:
    """The flow in order of each row's number in its stream, so that what follows can count with it."""
    rows = f.df.withColumn(position, F.row_number().over(f.window()).cast("long") - 1) if f.key else with_position(f.df, f.order, position)
    return f.with_df(rows, order=(position,))


def _with_next(f: Flow, values: dict[str, str]) -> DataFrame:
    return f.df.withColumns({n: F.lead(c).over(f.window()) for n, c in values.items()}) if f.key else with_next(f.df, f.order, values)


def buffer(limit: int, clock: str | None = None, pull_every: int = 0, emit: str = "emit_us", pushed: str = "pushed_us") -> Operator:
    """A queue of at most ``limit`` rows. With a ``clock``, when each row leaves and when the producer could push it.

    The consumer takes a row every ``pull_every`` at most: row i leaves at i * pull_every + max over j <= i of (arrival of j - j * pull_every),
    and is pushed on arrival or when row i - limit leaves.
    """
    if limit < 1:
        raise ValueError("a buffer holds one row at least")
    if clock is None:
        return identity("buffer")

    def apply(f: Flow) -> Flow:
        f = _numbered(f, "__i")
        paced = F.col("__i") * F.lit(pull_every).cast("long")
        rows = _running(f, "__late", F.col(clock) - paced, "__at").drop("__at").withColumn(emit, F.col("__late") + paced)
        if f.key:
            room = F.lag(emit, limit).over(f.with_df(rows).window())
        else:
            rows = with_neighbours(rows, ("__i",), emit, limit + 1, "__last", "__at").drop("__at")
            room = F.when(F.size("__last") > limit, F.get("__last", F.lit(0)))
        rows = rows.withColumn(pushed, F.greatest(clock, room)).drop("__i", "__late", "__last")
        return Flow(rows, (emit,), f.key, emit)

    return Operator(lambda f: f.with_df((out := apply(f)).df, clock=out.clock), "buffer")


def batch_count(n: int, *aggregates: Column) -> Operator:
    """Batches of ``n`` rows, the last one as it is; aggregates of each."""
    if n < 1:
        raise ValueError("a batch has one row at least")

    def apply(f: Flow) -> Flow:
        rows = f.df.withColumn("pos", F.row_number().over(f.window()) - 1) if f.key else with_position(f.df, f.order)
        out = rows.withColumn("batch_id", F.floor(F.col("pos") / n).cast("long")).groupBy(*f.key, "batch_id").agg(F.count(F.lit(1)).alias("n"), *aggregates)
        return f.with_df(out, order=("batch_id",))

    return Operator(apply, "batch_count")


def batch(deadline: Callable[[list[dict]], int | None], clock: str, schema: str, carry: tuple[str, ...] = (), members: str = "rows") -> Operator:
    """Batches that leave at a deadline of their own (see ``Batched``); ``schema`` has carry, members (array of rows), n, emit_us."""
    return boundary(lambda: Batched(deadline, members, carry), schema, clock)


def batch_timeout(count: int, timeout: int, clock: str, schema: str, carry: tuple[str, ...] = (), members: str = "rows") -> Operator:
    """Batches by count or timeout, whichever comes first; ``schema`` as for ``batch``."""
    return batch(lambda rows: MIN if len(rows) >= count else rows[0][clock] + timeout, clock, schema, carry, members)


def throttle(interval: int, limit: int, cost: str, schema: str, clock: str, room: int | None = None, pushed: str | None = None) -> Operator:
    """One token each ``interval``; a row leaves when its cost is covered. With a buffer of ``room`` rows, ``pushed`` says when each came in."""
    Throttled(interval, limit, cost, room, pushed)
    return boundary(lambda: Throttled(interval, limit, cost, room, pushed), schema, clock)


def delay(deadline: Column, clock: str, emit: str = "emit_us") -> Operator:
    """Rows leave at their deadline or, if it is past, on arrival; ordered by that."""

    def apply(f: Flow) -> Flow:
        rows = f.df.withColumn("deadline_us", deadline).withColumn(emit, F.greatest(clock, "deadline_us"))
        return f.with_df(rows, order=(emit, "deadline_us", *f.order), clock=emit)

    return Operator(apply, "delay")


def delay_buffered(deadline: str, limit: int, schema: str, clock: str) -> Operator:
    """The same while at most ``limit`` rows wait: a full buffer holds arrivals back."""
    return boundary(lambda: Delayed(deadline, limit), schema, clock)


def keep_alive(timeout: int, clock: str, extra: dict[str, Column], emit: str = "emit_us", start: Column | None = None) -> Operator:
    """Rows of ``extra`` values wherever a stream is silent for ``timeout``, repeatedly, up to its last row.

    With ``start``, the time a stream begins at, silence before its first row counts as well. Extra rows keep key
    columns; columns without an extra value are null.
    """
    if timeout < 1:
        raise ValueError("the timeout must be positive")

    def apply(f: Flow) -> Flow:
        if start is None:
            base = f.df.withColumn("__seed", F.lit(False))
        else:  # as if a row had come at the start, which isn't given
            streams = f.df.select(*f.key).distinct() if f.key else f.df.limit(1).select(F.lit(0).alias("__one"))
            seeds = streams.withColumn(clock, start.cast("long")).withColumn("__seed", F.lit(True)).drop("__one")
            base = f.df.withColumn("__seed", F.lit(False)).unionByName(seeds, allowMissingColumns=True).withColumn("__late", ~F.col("__seed"))
        f = f.with_df(base, order=(*(("__late",) if start is not None else ()), *f.order))
        rows = _with_next(f, {"__next": clock})
        n = F.coalesce(F.ceil((F.col("__next") - F.col(clock)) / F.lit(timeout).cast("long")) - 1, F.lit(0)).cast("int")
        rows = rows.withColumn("__n", F.greatest(n, F.lit(0)))
        rows = rows.withColumn("extra", F.explode(F.sequence(F.lit(0), F.col("__n")))).where("extra > 0 or not __seed")
        rows = rows.drop("__n", "__next", "__seed", "__late").withColumn(emit, F.col(clock) + F.col("extra") * F.lit(timeout).cast("long"))
        keep = {*f.key, clock, emit, "extra"}
        names = [c for c in rows.columns if c not in keep]
        kinds = dict(rows.dtypes)
        rows = rows.withColumns({c: F.when(F.col("extra") > 0, extra.get(c, F.lit(None)).cast(kinds[c])).otherwise(F.col(c)) for c in names})
        return f.with_df(rows, order=(emit, "extra"), clock=emit)

    return Operator(apply, "keep_alive")


def extrapolate(pull_every: int, clock: str, injected: Column, most: int | None = None, nth: str = "nth", name: str = "value", initial: dict[str, Column] | None = None, start: Column | None = None) -> Operator:
    """A consumer that pulls each ``pull_every``: it gets the oldest row not yet given or, if there is none, the next of the
    values that the last row given is continued with: the first ``most`` of ``injected`` (of the columns and ``nth``, from 1) or,
    without ``most``, the elements of the array ``injected``.

    ``initial`` values make a row that each stream begins with, at the time ``start``, before any arrival; its other
    columns, but keys, are null. Row i is given at tick e(i) = max(e(i - 1) + 1, c(i)) with c(i) its first tick after
    arrival, which is i + max over j <= i of (c(j) - j): a running maximum. Nothing is injected after the last row.
    """

    def apply(f: Flow) -> Flow:
        if initial is not None:
            streams = f.df.select(*f.key).distinct() if f.key else f.df.limit(1).select(F.lit(0).alias("__one"))
            seeds = streams.withColumns({clock: start.cast("long"), **initial, "__late": F.lit(0)}).drop("__one")
            f = f.with_df(f.df.withColumn("__late", F.lit(1)).unionByName(seeds, allowMissingColumns=True), order=("__late", *f.order))
        if f.key:
            rows = f.df.withColumn("__start", F.first(clock).over(f.window().rowsBetween(Window.unboundedPreceding, 0)))
        else:
            first = f.df.orderBy(*f.order).select(clock).limit(1).collect()  # one row
            rows = f.df.withColumn("__start", F.lit(first[0][0] if first else 0).cast("long"))
        rows = rows.withColumn("__c", F.ceil((F.col(clock) - F.col("__start")) / F.lit(pull_every).cast("long")).cast("long"))
        f = _numbered(f.with_df(rows), "__i")
        rows = _running(f, "__late_by", F.col("__c") - F.col("__i"), "__at").drop("__at").withColumn("tick", F.col("__i") + F.col("__late_by"))
        rows = _with_next(f.with_df(rows), {"__after": "tick"})
        limit = F.lit(most) if most is not None else F.size(injected)
        rows = rows.withColumn("__free", F.when(F.col("__after").isNotNull(), F.greatest(F.lit(0), F.least(F.col("__after") - F.col("tick") - 1, limit))).otherwise(0).cast("int"))
        rows = rows.withColumn(nth, F.explode(F.sequence(F.lit(0), F.col("__free")))).withColumn("tick", F.col("tick") + F.col(nth))
        given = injected if most is not None else F.get(injected, F.col(nth) - 1)
        rows = rows.withColumn(name, F.when(F.col(nth) > 0, given).otherwise(F.col(name)))
        rows = rows.withColumn("emit_us", F.col("__start") + F.col("tick") * F.lit(pull_every).cast("long"))
        return f.with_df(rows.drop("__i", "__c", "__start", "__late", "__late_by", "__after", "__free"), order=("tick",), clock="emit_us")

    return Operator(apply, "extrapolate")
