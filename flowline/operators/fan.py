"""Fan-out to several consumers and fan-in from several sources."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..flow import Flow, Operator
from ..plans.ordinal import with_position, with_running


def balance(n: int, name: str = "sink", by: Column | None = None) -> Operator:
    """Each row to exactly one of ``n`` consumers: by its order's remainder, or a hash of it."""
    if n < 1:
        raise ValueError("there must be a consumer")

    def apply(f: Flow) -> Flow:
        place = by if by is not None else F.col(f.order[0]) if len(f.order) == 1 else F.xxhash64(*f.order)
        return f.with_df(f.df.withColumn(name, F.pmod(place, F.lit(n)).cast("int")))

    return Operator(apply, "balance")


def broadcast(limits: Sequence[int | None], name: str = "sink") -> Operator:
    """Each row to all consumers. Consumer i cancels after ``limits[i]`` rows (None: never).

    The row at which one cancels still reaches the others, then all end.
    """
    if not limits:
        raise ValueError("there must be a consumer")

    def apply(f: Flow) -> Flow:
        ends = [x for x in limits if x is not None]
        rows = f.df
        if ends:
            rows = with_position(rows, f.order, "__pos").where(F.col("__pos") < min(ends)).drop("__pos")
        return f.with_df(rows.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(len(limits) - 1)))), order=(name, *f.order))

    return Operator(apply, "broadcast")


def route(targets: Column, sinks: int, limits: Sequence[int | None] | None = None, eager: bool = True, name: str = "sink", value: str = "value") -> Operator:
    """``targets`` is an array of (index, value) structs; each goes to the consumer of its index.

    An index outside 0..sinks-1 is an error. Consumer i cancels after ``limits[i]`` values: it gets no more, and the
    flow ends with the row at which one (eager) or the last one (not eager) cancels.
    """

    def apply(f: Flow) -> Flow:
        # Rows without targets stay through the explode and are no output.
        out = f.df.select("*", F.posexplode(targets).alias("nth", "__t")).select("*", F.col("__t.index").alias(name), F.col("__t.value").alias(value)).drop("__t")
        bad = (F.col(name) < 0) | (F.col(name) >= sinks) | F.col(name).isNull()
        out = out.withColumn(name, F.when(bad, F.raise_error(F.concat(F.lit("no consumer "), F.col(name).cast("string")))).otherwise(F.col(name)).cast("int"))
        flow = f.with_df(out, order=(*f.order, "nth"))
        if not limits or all(x is None for x in limits):
            return flow
        ranked = flow.df.withColumn("__rn", F.row_number().over(flow.keyed(name).window()))
        limit = F.get(F.array(*[F.lit(x).cast("long") for x in limits]), F.col(name))
        ends = ranked.where(F.col("__rn") == limit).groupBy(name).agg(F.min(F.struct(*f.order)).alias("p")).collect()  # one row a consumer
        rows = ranked.where(limit.isNull() | (F.col("__rn") <= limit)).drop("__rn")
        if ends and (eager or len(ends) == sinks):
            last = (min if eager else max)(tuple(e.p) for e in ends)
            rows = rows.where(F.struct(*f.order) <= F.struct(*[F.lit(v).alias(c) for c, v in zip(f.order, last, strict=True)]))
        return flow.with_df(rows)

    return Operator(apply, "route")


def tagged(flows: Sequence[Flow], name: str = "src") -> DataFrame:
    """All rows with the number of their source, matched by column names."""
    return reduce(lambda a, b: a.unionByName(b), [f.df.withColumn(name, F.lit(i)) for i, f in enumerate(flows)])


def concat(flows: Sequence[Flow], name: str = "src") -> Flow:
    """One source after the other."""
    return flows[0].with_df(tagged(flows, name), order=(name, *flows[0].order))


concat_step = concat


def merge(flows: Sequence[Flow], name: str = "src") -> Flow:
    """All sources at once, in order of arrival by the clock; each source keeps its own order."""
    clock = flows[0].clock
    return flows[0].with_df(tagged(flows, name), order=((clock,) if clock else ()) + (name, *flows[0].order))


def merge_sorted(flows: Sequence[Flow], by: str, is_sorted: bool = True, name: str = "src") -> Flow | None:
    """Always the source with the smallest head next; ties by source. No sources: no flow.

    Sources that aren't sorted are merged as their heads come: a row can't leave before a larger one in front of it,
    so it is ordered by the running maximum of its source.
    """
    if not flows:
        return None
    if is_sorted:
        return flows[0].with_df(tagged(flows, name), order=(by, name, *flows[0].order))
    seen = [f.with_df(with_running(f.df, f.order, {"head": ("max", F.col(by))})) for f in flows]
    return flows[0].with_df(tagged(seen, name), order=("head", name, "pos"))


def zip_flows(left: Flow, right: Flow, combine: Column | None = None, name: str = "value", prefixes: tuple[str, str] = ("l_", "r_")) -> Flow:
    """Pair rows by position, to the end of the shorter flow. A null of ``combine`` is an error."""
    sides = [with_position(f.df, f.order).select("pos", *[F.col(c).alias(p + c) for c in f.df.columns]) for f, p in zip((left, right), prefixes, strict=True)]
    out = sides[0].join(sides[1], "pos")
    if combine is not None:
        out = out.withColumn(name, F.when(combine.isNull(), F.raise_error(F.lit("zip made a null"))).otherwise(combine))
    return Flow(out, ("pos",))


def zip_latest(left: Flow, right: Flow, value: str, hold: bool = True, combine: Column | None = None, name: str = "value") -> Flow:
    """The latest ``value`` of either side at each arrival, as (l, r), and what ``combine`` makes of them; its null is an error.

    With ``hold``, rows of the side that starts first are not overwritten: they wait for the other side's first row
    and then follow one by one. Without, plain forward filling: only the latest value before a row counts. An empty
    side gives an empty result. Keyed flows are combined stream by stream.
    """
    key, clock = list(left.key), left.clock
    rows = tagged([left, right])

    def combined(flow: Flow) -> Flow:
        if combine is None:
            return flow
        return flow.with_df(flow.df.withColumn(name, F.when(combine.isNull(), F.raise_error(F.lit("zip made a null"))).otherwise(combine)))

    first = F.min(F.struct(clock, *left.order))
    if key:
        starts = rows.groupBy(*key, "src").agg(first.alias("s"))
        starts = starts.groupBy(*key).pivot("src", [0, 1]).agg(F.first("s")).toDF(*key, "s0", "s1")
        rows = rows.join(starts.where("s0 is not null and s1 is not null"), key)
    else:
        got = {r.src: r.s for r in rows.groupBy("src").agg(first.alias("s")).collect()}  # two rows
        if len(got) < 2:
            nothing = rows.where(F.lit(False)).withColumns({"l": F.col(value), "r": F.col(value), "pos": F.lit(0).cast("long")})
            return combined(Flow(nothing, ("pos",), (), clock))
        rows = rows.withColumns({f"s{i}": F.struct(*[F.lit(got[i][c]).alias(c) for c in (clock, *left.order)]) for i in (0, 1)})
    opens = F.greatest(F.col(f"s0.{clock}"), F.col(f"s1.{clock}"))
    own = F.when(F.col("src") == 0, F.col("s0")).otherwise(F.col("s1"))
    is_first = F.struct(clock, *left.order) == own if hold else F.lit(False)
    rows = rows.withColumns({"moment": F.greatest(F.col(clock), opens) if hold else F.col(clock), "later": F.when(is_first, 0).otherwise(1)})
    order = ("moment", "later", clock, "src", *left.order)
    if key:
        flow = Flow(rows, order, tuple(key), clock)
        run = flow.window().rowsBetween(Window.unboundedPreceding, 0)
        side = lambda i: F.last(F.when(F.col("src") == i, F.col(value)), ignorenulls=True).over(run)
        out = rows.withColumns({"l": side(0), "r": side(1)}).where("l is not null and r is not null")
        # two held first rows give one result
        return combined(flow.with_df(out.drop("s0", "s1")))
    rows = rows.drop("s0", "s1")
    side = lambda i: ("last", F.when(F.col("src") == i, F.col(value)))
    out = with_running(rows, order, {"l": side(0), "r": side(1)}).where("l is not null and r is not null")
    return combined(Flow(out, ("pos",), (), clock))
