"""The registered queries of the flow operators, and SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import functions as C
from .flow import Flow, chain
from .operators import fan, gather, group, lifecycle, narrow, parallel, timed
from .plans.staging import stage
from .sources import from_callable, from_frame, from_rows

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str, *columns: str) -> Flow:
    """Events in order of their id, with the arrival time in microseconds and the value in cents.

    Operators over a whole order stage their rows, which ends column pruning; they get only the ``columns`` they need.
    """
    df = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", F.round(F.col("value") * 100).cast("long").alias("cents"), "props")
    df = df.withColumn("us", timed.micros("ts"))
    return from_frame(df.select(*columns) if columns else df, "event_id", clock="us")


#: The same view of the events in the SQL below.
E = "(SELECT event_id, ts, user_id, event_type, round(value * 100)::BIGINT AS cents, props, epoch_us(ts) AS us FROM events)"


def of_type(f: Flow, kind: str) -> Flow:
    return f.with_df(f.df.where(F.col("event_type") == kind))


# --- sources and terminals ---


@query("SELECT * FROM (VALUES (0::BIGINT, 'now'), (1, 'or'), (2, 'never')) t(pos, s)")
def iterator_source(spark, sf_dir):
    return from_rows(spark, iter([("now",), ("or",), ("never",)]), "s string").df


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")
def stream_source(spark, sf_dir):
    return from_frame(table(spark, sf_dir, "orders"), "o_orderkey").df.select("o_orderkey", "o_custkey", "o_orderstatus")


@query("SELECT i::BIGINT AS pos, (i * i)::BIGINT AS square FROM range(0, 4000) t(i)")
def lambda_source(spark, sf_dir):
    produce = lambda part: ((i, i * i) for i in range(part * 1000, part * 1000 + 1000))
    return from_callable(spark, "flow_squares", produce, 4, "pos long, square long", "pos").df


@query("SELECT count(*) AS n FROM lineitem")
def for_each(spark, sf_dir):
    """The terminal that visits each row; what it saw is counted on the executors."""
    seen = spark.sparkContext.accumulator(0)
    from_frame(table(spark, sf_dir, "lineitem").select("l_orderkey"), "l_orderkey").df.foreachPartition(lambda rows: seen.add(sum(1 for _ in rows)))
    return spark.createDataFrame([(seen.value,)], "n long")


@query(f"SELECT count(*) AS n, sum(cents)::BIGINT AS total, min(cents) AS low, max(cents) AS high, sum(cents)::DOUBLE / count(*) AS average FROM {E}")
def collect_agg(spark, sf_dir):
    return events(spark, sf_dir).collect(C.counting(), C.summing("cents"), C.minimum("cents"), C.maximum("cents"), C.averaging("cents"))


@query(f"SELECT event_type, count(*) AS n, sum(cents)::BIGINT AS total FROM {E} GROUP BY event_type")
def collect_grouped(spark, sf_dir):
    return events(spark, sf_dir).keyed("event_type").collect(C.counting(), C.summing("cents"))


@query("SELECT conv_id, string_agg(role, '>' ORDER BY turn) AS joined FROM conversations GROUP BY conv_id")
def collect_joining(spark, sf_dir):
    return from_frame(table(spark, sf_dir, "conversations"), "turn", key=("conv_id",)).collect(C.joining("role", ">", "turn"))


# --- projection, filter, flat-map ---


@query(f"SELECT event_id, -cents AS value FROM {E} WHERE cents % 2 = 1")
def filter_map(spark, sf_dir):
    return events(spark, sf_dir).then(narrow.filter_map(F.when(F.col("cents") % 2 == 1, -F.col("cents")))).df.select("event_id", "value")


@query(r"SELECT doc_id, (i - 1)::INTEGER AS inner, w[i] AS value FROM (SELECT doc_id, string_split(text, chr(10)) AS w FROM documents) d, LATERAL (SELECT unnest(range(1, len(w) + 1)) AS i) r")
def flat_map(spark, sf_dir):
    return from_frame(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").then(narrow.flat_map(F.split("text", "\n"))).df.select("doc_id", "inner", "value")


@query(f"SELECT event_id, cents FROM {E} WHERE event_id < coalesce((SELECT min(event_id) FROM {E} WHERE cents > 20000), 1e18)")
def take_while(spark, sf_dir):
    return events(spark, sf_dir).then(narrow.take_while(F.col("cents") <= 20000)).df.select("event_id", "cents")


@query("SELECT o_orderkey, round(o_totalprice * 100)::BIGINT * 2 AS value FROM orders")
def gather_map(spark, sf_dir):
    f = from_frame(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents")), "o_orderkey", key=("o_custkey",))
    own = gather.Gatherer.map(lambda r: {"o_orderkey": r["o_orderkey"], "value": 2 * r["cents"]})
    return f.then(gather.gather(own, "o_orderkey long, value long")).df


@query(f"""SELECT event_id, cents, (row_number() OVER (ORDER BY event_id))::BIGINT AS nth FROM (
  SELECT event_id, cents, max(cents) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM {E}) WHERE cents > coalesce(best, -1)
UNION ALL SELECT -1, max(cents), count(*) FROM {E}""")
def gather_whole(spark, sf_dir):
    """A gatherer over a flow without key: each new highest value, numbered, and at the end how many rows there were."""

    def integrate(state, row, push):
        state["rows"] = state.get("rows", 0) + 1
        if row["cents"] > state.get("best", -1):
            state["best"], state["nth"] = row["cents"], state.get("nth", 0) + 1
            push({"event_id": row["event_id"], "cents": row["cents"], "nth": state["nth"]})
        return True

    own = gather.Gatherer(integrate, finish=lambda s, push: push({"event_id": -1, "cents": s["best"], "nth": s["rows"]}))
    return events(spark, sf_dir, "event_id", "cents").then(gather.gather(own, "event_id long, cents long, nth long")).df


@query(f"SELECT user_id, event_id, i AS copy, cents + i AS value FROM {E}, (SELECT unnest(range(0, 3)) AS i) r WHERE i < event_id % 3")
def gather_flat_map(spark, sf_dir):
    own = gather.Gatherer.flat_map(lambda r: [{"user_id": r["user_id"], "event_id": r["event_id"], "copy": i, "value": r["cents"] + i} for i in range(r["event_id"] % 3)])
    return events(spark, sf_dir).keyed("user_id").then(gather.gather(own, "user_id long, event_id long, copy long, value long")).df


@query(f"""SELECT event_id, w[1] AS a, w[2] AS b, w[3] AS c FROM (
  SELECT event_id, list(cents) OVER (ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS w FROM {E}) WHERE len(w) = 3""")
def gather_sliding(spark, sf_dir):
    out = events(spark, sf_dir, "event_id", "cents").then(gather.window_sliding(3, "cents")).df
    return out.select("event_id", *[F.col("window")[i].alias(n) for i, n in enumerate("abc")])


@query(f"""SELECT user_id, event_id, list_sum(w)::BIGINT AS total FROM (
  SELECT user_id, event_id, list(cents) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS w FROM {E}) WHERE len(w) = 4""")
def gather_sliding_keyed(spark, sf_dir):
    out = events(spark, sf_dir).keyed("user_id").then(gather.window_sliding(4, "cents")).df
    return out.select("user_id", "event_id", F.aggregate("window", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query(f"""SELECT (rn // 5)::BIGINT AS window_id, string_agg(cents::VARCHAR, ',' ORDER BY rn) AS joined FROM (
  SELECT cents, row_number() OVER (ORDER BY event_id) - 1 AS rn FROM {E}) GROUP BY rn // 5""")
def gather_fixed(spark, sf_dir):
    out = events(spark, sf_dir, "event_id", "cents").then(gather.window_fixed(5, "cents")).df
    return out.select("window_id", F.array_join(F.col("window").cast("array<string>"), ",").alias("joined"))


@query(f"SELECT event_id, (sum(cents) OVER (ORDER BY event_id))::BIGINT AS total FROM {E}")
def gather_scan(spark, sf_dir):
    return events(spark, sf_dir, "event_id", "cents").then(gather.scan(F.col("cents"))).df.select("event_id", "total")


@query(f"SELECT user_id, bit_xor(cents) AS folded FROM {E} GROUP BY user_id")
def gather_fold(spark, sf_dir):
    """A fold in order, written as a gatherer with a finisher."""

    def integrate(state, row, push):
        state["user_id"], state["folded"] = row["user_id"], state.get("folded", 0) ^ row["cents"]
        return True

    own = gather.Gatherer(integrate, finish=lambda s, push: push({"user_id": s["user_id"], "folded": s["folded"]}))
    return events(spark, sf_dir).keyed("user_id").then(gather.gather(own, "user_id long, folded long")).df


@query(f"""WITH r AS (SELECT *, coalesce(sum(cents) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM {E})
SELECT user_id, event_id, cents FROM r WHERE spent < 10000 UNION ALL SELECT user_id, -1, sum(cents)::BIGINT FROM r WHERE spent < 10000 GROUP BY user_id""")
def gather_stop(spark, sf_dir):
    """A gatherer that stops its stream once 100.00 are spent; its finisher still runs and gives the sum."""

    def integrate(state, row, push):
        state["user_id"], state["spent"] = row["user_id"], state.get("spent", 0) + row["cents"]
        push({k: row[k] for k in ("user_id", "event_id", "cents")})
        return state["spent"] < 10000

    own = gather.Gatherer(integrate, finish=lambda s, push: push({"user_id": s["user_id"], "event_id": -1, "cents": s["spent"]}))
    return events(spark, sf_dir).keyed("user_id").then(gather.gather(own, "user_id long, event_id long, cents long")).df


@query(f"SELECT event_id, (event_id % 2)::INTEGER AS sink, CASE WHEN event_id % 2 = 0 THEN cents ELSE 10 - cents END AS value FROM {E}")
def adapt_source_of_sink(spark, sf_dir):
    """Two consumers share the rows; one has an operator in front of it."""
    f = events(spark, sf_dir).then(fan.balance(2))
    plain = f.df.where("sink = 0").withColumn("value", F.col("cents"))
    adapted = narrow.adapt_source_of_sink(narrow.filter_map(10 - F.col("cents")), lambda x: x.df)(f.with_df(f.df.where("sink = 1")))
    return plain.unionByName(adapted).select("event_id", "sink", "value")


@query(f"""SELECT 0 AS src, event_id, cents AS value FROM {E} WHERE event_type = 'click'
UNION ALL SELECT 1, event_id, cents + i FROM {E}, (SELECT unnest([0, 1, 2]) AS i) r WHERE event_type = 'view'""")
def adapt_sink_of_source(spark, sf_dir):
    """Two sources merged; one has a flat-map behind it."""
    f = events(spark, sf_dir)
    plain = of_type(f, "click")
    adapted = narrow.adapt_sink_of_source(narrow.flat_map(F.array(*[F.col("cents") + i for i in range(3)])), of_type(f, "view"))
    return fan.merge([plain.with_df(plain.df.select("event_id", F.col("cents").alias("value"), "us")), adapted.with_df(adapted.df.select("event_id", "value", "us"), order=("event_id",))]).df.select("src", "event_id", "value")


# --- grouping and splitting ---


@query(f"SELECT event_id, user_id AS k, cents, first_value(cents) OVER (PARTITION BY user_id ORDER BY event_id) AS first FROM {E}")
def group_first(spark, sf_dir):
    return events(spark, sf_dir).then(group.group_by(F.col("user_id"), first="first", of="cents")).df.select("event_id", "k", "cents", "first")


@query(f"SELECT user_id AS k, event_id FROM {E} QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) <= 10")
def group_take(spark, sf_dir):
    return events(spark, sf_dir).then(group.group_by(F.col("user_id")), group.take_each(10)).df.select("k", "event_id")


@query(f"""SELECT event_id, user_id AS k FROM {E} WHERE event_id <= coalesce((SELECT min(event_id) FROM (
  SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM {E}) WHERE rn = 5), 1e18)""")
def group_eager_cancel(spark, sf_dir):
    return events(spark, sf_dir).then(group.group_by(F.col("user_id")), group.take_each_eager(5)).df.select("event_id", "k")


_SPLIT = "SELECT event_id, {} AS segment FROM (SELECT event_id, event_type = 'purchase' AS p, row_number() OVER (ORDER BY event_id) AS rn FROM events)"


@query("SELECT s.event_id, s.segment, min(s.event_id) OVER (PARTITION BY s.segment) AS first FROM (" + _SPLIT.format("(sum(CASE WHEN rn = 1 OR p THEN 1 ELSE 0 END) OVER (ORDER BY event_id))::BIGINT") + ") s")
def split_before(spark, sf_dir):
    return events(spark, sf_dir, "event_id", "event_type").then(group.split(F.col("event_type") == "purchase", first="first", of="event_id")).df.select("event_id", "segment", "first")


@query("SELECT s.event_id, s.segment, min(s.event_id) OVER (PARTITION BY s.segment) AS first FROM (" + _SPLIT.format("(1 + coalesce(sum(CASE WHEN p THEN 1 ELSE 0 END) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT") + ") s")
def split_after(spark, sf_dir):
    return events(spark, sf_dir, "event_id", "event_type").then(group.split(F.col("event_type") == "purchase", after=True, first="first", of="event_id")).df.select("event_id", "segment", "first")


@query(f"""WITH b AS (SELECT *, sum(CASE WHEN rn = 1 OR event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS base
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM {E})),
o AS (SELECT *, ((row_number() OVER (PARTITION BY user_id, base ORDER BY event_id) - 1) % 3 = 0)::INTEGER AS opens FROM b)
SELECT user_id, event_id, (sum(opens) OVER (PARTITION BY user_id ORDER BY event_id))::BIGINT AS segment FROM o""")
def split_take(spark, sf_dir):
    return events(spark, sf_dir).then(group.split_take(F.col("event_type") == "purchase", 3, ["user_id"])).df.select("user_id", "event_id", "segment")


_SEGMENTS = "(SELECT event_id, {} AS base FROM (SELECT event_id, event_type = 'purchase' AS p, row_number() OVER (ORDER BY event_id) AS rn FROM events))"
_BEFORE = _SEGMENTS.format("(sum(CASE WHEN rn = 1 OR p THEN 1 ELSE 0 END) OVER (ORDER BY event_id))::BIGINT")
_AFTER = _SEGMENTS.format("(1 + coalesce(sum(CASE WHEN p THEN 1 ELSE 0 END) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT")


@query(f"""SELECT event_id, (sum(((n - 1) % 3 = 0)::INTEGER) OVER (ORDER BY event_id))::BIGINT AS segment
FROM (SELECT event_id, row_number() OVER (PARTITION BY base ORDER BY event_id) AS n FROM {_AFTER})""")
def split_after_take(spark, sf_dir):
    """Segments that a purchase ends, over the whole flow; a consumer cancels after three rows."""
    return events(spark, sf_dir, "event_id", "event_type").then(group.split_take(F.col("event_type") == "purchase", 3, after=True)).df.select("event_id", "segment")


@query(f"""WITH n AS (SELECT event_id, base, row_number() OVER (PARTITION BY base ORDER BY event_id) AS n FROM {_BEFORE})
SELECT event_id, base AS segment FROM n WHERE event_id <= coalesce((SELECT min(event_id) FROM n WHERE n = 9), 1e18)""")
def split_eager_cancel(spark, sf_dir):
    """The flow ends with the row at which the first consumer of a segment cancels, its ninth."""
    return events(spark, sf_dir, "event_id", "event_type").then(group.split_take(F.col("event_type") == "purchase", 9, eager=True)).df.select("event_id", "segment")


# --- fan-out ---


@query(f"SELECT (event_id % 4)::INTEGER AS sink, count(*) AS n, sum(cents)::BIGINT AS total FROM {E} GROUP BY 1")
def balance(spark, sf_dir):
    return events(spark, sf_dir).then(fan.balance(4)).keyed("sink").collect(C.counting(), C.summing("cents"))


@query(f"SELECT s::INTEGER AS sink, event_id, cents + s + 1 AS value FROM {E}, (SELECT unnest([0, 1, 2]) AS s) r")
def broadcast(spark, sf_dir):
    return events(spark, sf_dir).then(fan.broadcast([None, None, None])).df.select("sink", "event_id", (F.col("cents") + F.col("sink") + 1).alias("value"))


@query("SELECT s::INTEGER AS sink, event_id FROM (SELECT event_id FROM events ORDER BY event_id LIMIT 700), (SELECT unnest([0, 1, 2]) AS s) r")
def broadcast_cancel(spark, sf_dir):
    return events(spark, sf_dir, "event_id").then(fan.broadcast([None, 700, 900])).df.select("sink", "event_id")


_ROUTES = f"""(SELECT event_id, (event_id % 3)::INTEGER AS sink, cents AS value, 0 AS nth FROM {E} WHERE cents % 5 <> 0
  UNION ALL SELECT event_id, 0, -cents, 1 FROM {E} WHERE cents % 5 <> 0 AND cents > 1000)"""


def _routes():
    target = lambda i, v: F.struct(i.cast("int").alias("index"), v.alias("value"))
    both = F.array(target(F.col("event_id") % 3, F.col("cents")), target(F.lit(0), -F.col("cents")))
    one = F.array(target(F.col("event_id") % 3, F.col("cents")))
    return F.when(F.col("cents") % 5 != 0, F.when(F.col("cents") > 1000, both).otherwise(one))


@query(f"SELECT event_id, sink, value FROM {_ROUTES}")
def route(spark, sf_dir):
    return events(spark, sf_dir).then(fan.route(_routes(), 3)).df.select("event_id", "sink", "value")


@query(f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY sink ORDER BY event_id, nth) AS rn FROM {_ROUTES})
SELECT event_id, sink, value FROM r WHERE (sink <> 1 OR rn <= 50) AND (sink <> 2 OR rn <= 80)
AND event_id <= (SELECT min(event_id) FROM r WHERE (sink = 1 AND rn = 50) OR (sink = 2 AND rn = 80))""")
def route_eager_cancel(spark, sf_dir):
    return events(spark, sf_dir).then(fan.route(_routes(), 3, [None, 50, 80])).df.select("event_id", "sink", "value")


@query(f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY sink ORDER BY event_id, nth) AS rn FROM {_ROUTES})
SELECT event_id, sink, value FROM r WHERE rn <= 20 + 10 * sink""")
def route_lazy_cancel(spark, sf_dir):
    return events(spark, sf_dir).then(fan.route(_routes(), 3, [20, 30, 40], eager=False)).df.select("event_id", "sink", "value")


# --- fan-in ---

_TWO = f"SELECT 0 AS src, event_id, cents FROM {E} WHERE event_type = 'click' UNION ALL SELECT 1, event_id, cents FROM {E} WHERE event_type = 'view'"


def _two(spark, sf_dir):
    f = events(spark, sf_dir, "event_id", "us", "cents", "event_type")
    return [of_type(f, "click"), of_type(f, "view")]


@query(f"SELECT src, event_id, cents, row_number() OVER (ORDER BY src, event_id) - 1 AS pos FROM ({_TWO})")
def concat(spark, sf_dir):
    out = fan.concat(_two(spark, sf_dir))
    return timed.with_position(out.df.select("src", "event_id", "cents"), out.order)


@query(_TWO)
def concat_step(spark, sf_dir):
    return fan.concat_step(_two(spark, sf_dir)).df.select("src", "event_id", "cents")


@query(_TWO)
def merge(spark, sf_dir):
    return fan.merge(_two(spark, sf_dir)).df.select("src", "event_id", "cents")


@query("SELECT row_number() OVER (ORDER BY day, src, key) - 1 AS pos, src, key, strftime(day, '%Y-%m-%d') AS day FROM (SELECT 0 AS src, o_orderkey AS key, o_orderdate::DATE AS day FROM orders UNION ALL SELECT 1, event_id, ts::DATE FROM events)")
def merge_sorted(spark, sf_dir):
    a = from_frame(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderdate").cast("date").alias("day")), "key")
    b = from_frame(table(spark, sf_dir, "events").select(F.col("event_id").alias("key"), F.col("ts").cast("date").alias("day")), "key")
    out = fan.merge_sorted([a, b], "day")
    return timed.with_position(out.df, out.order).select("pos", "src", "key", F.date_format("day", "yyyy-MM-dd").alias("day"))


@query(f"""WITH t AS (SELECT *, max(cents) OVER (PARTITION BY src ORDER BY event_id) AS head FROM ({_TWO}))
SELECT row_number() OVER (ORDER BY head, src, event_id) - 1 AS place, src, event_id, cents FROM t""")
def merge_sorted_unsorted(spark, sf_dir):
    out = fan.merge_sorted(_two(spark, sf_dir), "cents", is_sorted=False)
    return timed.with_position(out.df, out.order, "place").select("place", "src", "event_id", "cents")


@query(f"""SELECT a.pos, a.event_id AS l_event_id, b.event_id AS r_event_id, a.cents + b.cents AS value
FROM (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS pos FROM {E} WHERE event_type = 'click') a
JOIN (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS pos FROM {E} WHERE event_type = 'view') b ON a.pos = b.pos""")
def zip(spark, sf_dir):  # noqa: A001 - the operator's name
    return fan.zip_flows(*_two(spark, sf_dir), F.col("l_cents") + F.col("r_cents")).df.select("pos", "l_event_id", "r_event_id", "value")


def _latest(key: str, hold: bool) -> str:
    part = f"PARTITION BY {key} " if key else ""
    keys = f"{key}, " if key else ""
    opens = "greatest(us, f0, f1)" if hold else "us"
    later = "CASE WHEN us = CASE WHEN src = 0 THEN f0 ELSE f1 END THEN 0 ELSE 1 END" if hold else "1"
    return f"""WITH t AS (SELECT 0 AS src, * FROM {E} WHERE event_type = 'purchase' UNION ALL SELECT 1, * FROM {E} WHERE event_type = 'view'),
f AS (SELECT *, min(CASE WHEN src = 0 THEN us END) OVER ({part}) AS f0, min(CASE WHEN src = 1 THEN us END) OVER ({part}) AS f1 FROM t),
o AS (SELECT *, {opens} AS moment, {later} AS later FROM f WHERE f0 IS NOT NULL AND f1 IS NOT NULL),
l AS (SELECT *, last_value(CASE WHEN src = 0 THEN cents END IGNORE NULLS) OVER w AS l, last_value(CASE WHEN src = 1 THEN cents END IGNORE NULLS) OVER w AS r
FROM o WINDOW w AS ({part}ORDER BY moment, later, us, src, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT {keys}event_id, l, r FROM l WHERE l IS NOT NULL AND r IS NOT NULL"""


def _late(spark, sf_dir, *key):
    f = events(spark, sf_dir, "event_id", "us", "cents", "event_type", *key).keyed(*key)
    return of_type(f, "purchase"), of_type(f, "view")


@query(_latest("", True))
def zip_latest(spark, sf_dir):
    return fan.zip_latest(*_late(spark, sf_dir), "cents").df.select("event_id", "l", "r")


@query(f"SELECT event_id, 3 * l - r AS value FROM ({_latest('', True)})")
def zip_latest_combined(spark, sf_dir):
    return fan.zip_latest(*_late(spark, sf_dir), "cents", combine=3 * F.col("l") - F.col("r")).df.select("event_id", "value")


@query(_latest("user_id", True))
def zip_latest_keyed(spark, sf_dir):
    return fan.zip_latest(*_late(spark, sf_dir, "user_id"), "cents").df.select("user_id", "event_id", "l", "r")


@query(_latest("", False))
def combine_latest_ffill(spark, sf_dir):
    return fan.zip_latest(*_late(spark, sf_dir), "cents", hold=False).df.select("event_id", "l", "r")


# --- parallel map ---


@query("SELECT l_orderkey, l_linenumber, round(l_quantity * 2)::BIGINT AS value FROM lineitem WHERE l_returnflag <> 'N'")
def map_balance_ordered(spark, sf_dir):
    f = from_frame(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")
    return f.then(parallel.map_balance_ordered(F.when(F.col("l_returnflag") != "N", F.round(F.col("l_quantity") * 2).cast("long")))).df.select("l_orderkey", "l_linenumber", "value")


@query("SELECT o_custkey AS k, o_orderkey, md5(o_orderstatus || o_orderkey::VARCHAR) AS value FROM orders WHERE o_orderstatus <> 'P'")
def map_balance_partitioned(spark, sf_dir):
    f = from_frame(table(spark, sf_dir, "orders"), "o_orderkey")
    value = F.when(F.col("o_orderstatus") != "P", F.md5(F.concat("o_orderstatus", F.col("o_orderkey").cast("string"))))
    return f.then(parallel.map_balance_partitioned(F.col("o_custkey"), value, concurrency=8, permits=2)).df.select("k", "o_orderkey", "value")


@query(f"SELECT event_id, cents * 2 AS value FROM {E} WHERE cents > 100")
def balance_merge_source(spark, sf_dir):
    return events(spark, sf_dir).then(parallel.balance_merge_source(4, F.when(F.col("cents") > 100, F.col("cents") * 2))).df.select("event_id", "value")


@query(f"SELECT event_id, cents * 3 AS value FROM {E}")
def balance_merge_sink(spark, sf_dir):
    return events(spark, sf_dir).then(parallel.balance_merge_sink(4, F.col("cents") * 3)).df.select("event_id", "value")


# --- boundaries and time ---


@query("SELECT event_id, user_id FROM events")
def rendezvous(spark, sf_dir):
    return events(spark, sf_dir).then(timed.rendezvous()).df.select("event_id", "user_id")


HOUR = 3_600_000_000


def _paced(part: str, limit: int, every: int) -> str:
    return f"""WITH i AS (SELECT *, row_number() OVER ({part}ORDER BY event_id) - 1 AS i FROM {E}),
e AS (SELECT *, (i * {every} + max(us - i * {every}) OVER ({part}ORDER BY event_id))::BIGINT AS emit_us FROM i)
SELECT event_id, user_id, emit_us, greatest(us, lag(emit_us, {limit}) OVER ({part}ORDER BY event_id)) AS pushed_us FROM e"""


@query(_paced("", 4, HOUR // 12))
def buffer(spark, sf_dir):
    """A consumer that takes a row every five minutes, more slowly than rows come: the producer waits for one of four places."""
    return events(spark, sf_dir, "event_id", "user_id", "us").then(timed.buffer(4, "us", HOUR // 12)).df.select("event_id", "user_id", "emit_us", "pushed_us")


@query(_paced("PARTITION BY user_id ", 2, 48 * HOUR))
def buffer_keyed(spark, sf_dir):
    out = events(spark, sf_dir).keyed("user_id").then(timed.buffer(2, "us", 48 * HOUR)).df
    return out.select("event_id", "user_id", "emit_us", "pushed_us")


@query(f"SELECT (rn // 100)::BIGINT AS batch_id, count(*) AS n, sum(cents)::BIGINT AS total FROM (SELECT cents, row_number() OVER (ORDER BY event_id) - 1 AS rn FROM {E}) GROUP BY 1")
def batch_count(spark, sf_dir):
    return events(spark, sf_dir, "event_id", "cents").then(timed.batch_count(100, C.summing("cents"))).df.select("batch_id", "n", "total")


@query(f"""WITH RECURSIVE r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM {E}),
b AS (SELECT user_id, rn, 1 AS batch, 1 AS n, us AS opened, us, cents FROM r WHERE rn = 1
  UNION ALL SELECT r.user_id, r.rn, CASE WHEN b.n = 5 OR r.us > b.opened + {72 * HOUR} THEN b.batch + 1 ELSE b.batch END,
    CASE WHEN b.n = 5 OR r.us > b.opened + {72 * HOUR} THEN 1 ELSE b.n + 1 END, CASE WHEN b.n = 5 OR r.us > b.opened + {72 * HOUR} THEN r.us ELSE b.opened END, r.us, r.cents
  FROM b JOIN r ON r.user_id = b.user_id AND r.rn = b.rn + 1),
last AS (SELECT user_id, max(us) AS completed FROM r GROUP BY user_id)
SELECT b.user_id, count(*) AS n, sum(cents)::BIGINT AS total, CASE WHEN count(*) = 5 THEN max(us) ELSE least(min(opened) + {72 * HOUR}, any_value(completed)) END AS emit_us
FROM b JOIN last USING (user_id) GROUP BY b.user_id, batch""")
def batch_timeout(spark, sf_dir):
    """Five rows or 72 hours, for each user."""
    f = events(spark, sf_dir).keyed("user_id")
    f = f.with_df(f.df.select("user_id", "event_id", "us", "cents"))
    member = "array<struct<user_id:long,event_id:long,us:long,cents:long>>"
    out = f.then(timed.batch_timeout(5, 72 * HOUR, "us", f"user_id long, rows {member}, n long, emit_us long", ("user_id",))).df
    return out.select("user_id", "n", F.aggregate("rows", F.lit(0).cast("long"), lambda a, x: a + x["cents"]).alias("total"), "emit_us")


_BUYS = f"(SELECT * FROM {E} WHERE event_type = 'purchase')"


def _buys(spark, sf_dir, *columns):
    f = of_type(events(spark, sf_dir), "purchase")
    return f.with_df(f.df.select("event_id", "us", "cents", *columns))


@query(f"""WITH RECURSIVE r AS (SELECT *, row_number() OVER (ORDER BY event_id) AS rn FROM {_BUYS}),
b AS (SELECT rn, 1 AS batch, cents AS total, us AS opened, us, cents FROM r WHERE rn = 1
  UNION ALL SELECT r.rn, CASE WHEN b.total >= 20000 OR r.us > b.opened + {8 * HOUR} THEN b.batch + 1 ELSE b.batch END,
    CASE WHEN b.total >= 20000 OR r.us > b.opened + {8 * HOUR} THEN r.cents ELSE b.total + r.cents END,
    CASE WHEN b.total >= 20000 OR r.us > b.opened + {8 * HOUR} THEN r.us ELSE b.opened END, r.us, r.cents
  FROM b JOIN r ON r.rn = b.rn + 1)
SELECT count(*) AS n, max(total)::BIGINT AS total, CASE WHEN max(total) >= 20000 THEN max(us) ELSE least(min(opened) + {8 * HOUR}, (SELECT max(us) FROM r)) END AS emit_us FROM b GROUP BY batch""")
def batch_own_deadline(spark, sf_dir):
    """Over the whole flow: a batch leaves once it is worth 200.00, or 8 hours after its first row."""
    own = lambda rows: timed.MIN if sum(r["cents"] for r in rows) >= 20000 else rows[0]["us"] + 8 * HOUR
    out = _buys(spark, sf_dir).then(timed.batch(own, "us", "rows array<struct<event_id:long,us:long,cents:long>>, n long, emit_us long")).df
    return out.select("n", F.aggregate("rows", F.lit(0).cast("long"), lambda a, x: a + x["cents"]).alias("total"), "emit_us")


def _throttled(rows: str, part: str, every: int, limit: int, cost: str) -> str:
    """A recursion over rows: the token bucket row by row."""
    keys, same = ("user_id, ", "r.user_id = b.user_id AND ") if part else ("", "")
    own = "r.user_id, " if part else ""
    front = "greatest(r.us, b.emit_us)"
    whole = f"(({front} - b.accrued) // {every})"
    return f"""WITH RECURSIVE r AS (SELECT *, {cost} AS cost, row_number() OVER ({part}ORDER BY event_id) AS rn FROM {rows}),
b AS (SELECT {keys}event_id, rn, us, CASE WHEN cost <= {limit} THEN us ELSE us + {every} * (cost - {limit}) END AS emit_us,
    CASE WHEN cost <= {limit} THEN {limit} - cost ELSE 0 END AS tokens, CASE WHEN cost <= {limit} THEN us ELSE us + {every} * (cost - {limit}) END AS accrued FROM r WHERE rn = 1
  UNION ALL
  SELECT {keys}event_id, rn, us, CASE WHEN cost <= t THEN front ELSE ticked + {every} * (cost - t) END,
    CASE WHEN cost <= t THEN t - cost ELSE 0 END, CASE WHEN cost <= t THEN ticked ELSE ticked + {every} * (cost - t) END
  FROM (SELECT {own}r.event_id, r.rn, r.us, r.cost, {front} AS front, b.accrued + {whole} * {every} AS ticked,
      CASE WHEN {whole} > 0 THEN least(b.tokens + {whole}, {limit}) ELSE b.tokens END AS t
    FROM b JOIN r ON {same}r.rn = b.rn + 1) x)"""


@query(_throttled(E, "PARTITION BY user_id ", 12 * HOUR, 4, "1 + cents % 7") + " SELECT user_id, event_id, emit_us FROM b")
def throttle(spark, sf_dir):
    """A token each 12 hours and at most 4 for each user; a row costs 1 to 7."""
    f = events(spark, sf_dir).keyed("user_id")
    f = f.with_df(f.df.select("user_id", "event_id", "us", (1 + F.col("cents") % 7).alias("cost")))
    return f.then(timed.throttle(12 * HOUR, 4, "cost", "user_id long, event_id long, us long, cost long, emit_us long", "us")).df.select("user_id", "event_id", "emit_us")


@query(_throttled(_BUYS, "", HOUR // 2, 3, "cents % 5") + " SELECT event_id, emit_us, greatest(us, lag(emit_us, 2) OVER (ORDER BY event_id)) AS pushed_us FROM b")
def throttle_buffered(spark, sf_dir):
    """The whole flow at a token each half hour, behind a buffer of two rows that holds the producer back."""
    f = _buys(spark, sf_dir, (F.col("cents") % 5).alias("cost"))
    return f.then(timed.throttle(HOUR // 2, 3, "cost", "event_id long, us long, cost long, emit_us long, pushed_us long", "us", room=2, pushed="pushed_us")).df.select("event_id", "emit_us", "pushed_us")


@query(f"SELECT event_id, greatest(us, us + (cents % 11 - 5) * {HOUR}) AS emit_us FROM {E}")
def delay(spark, sf_dir):
    return events(spark, sf_dir).then(timed.delay(F.col("us") + (F.col("cents") % 11 - 5) * HOUR, "us")).df.select("event_id", "emit_us")


@query(f"SELECT user_id, event_id, max(greatest(us, us + (cents % 11 - 5) * {24 * HOUR})) OVER (PARTITION BY user_id ORDER BY event_id) AS emit_us FROM {E}")
def delay_buffered(spark, sf_dir):
    """A buffer of one row: the next one comes in when it has left, so rows leave in order and late."""
    f = events(spark, sf_dir).keyed("user_id")
    f = f.with_df(f.df.select("user_id", "event_id", "us", (F.col("us") + (F.col("cents") % 11 - 5) * 24 * HOUR).alias("deadline")))
    return f.then(timed.delay_buffered("deadline", 1, "user_id long, event_id long, us long, deadline long, emit_us long", "us")).df.select("user_id", "event_id", "emit_us")


@query(f"""SELECT user_id, CASE WHEN i = 0 THEN event_id ELSE -1 END AS event_id, us + i * {24 * HOUR} AS emit_us FROM (
  SELECT user_id, event_id, us, lead(us) OVER (PARTITION BY user_id ORDER BY event_id) - us AS gap FROM {E}) g,
LATERAL (SELECT unnest(range(0, 1 + coalesce(greatest(CAST(ceil(gap / {24 * HOUR}.0) AS BIGINT) - 1, 0), 0))) AS i) r""")
def keep_alive(spark, sf_dir):
    f = events(spark, sf_dir).keyed("user_id")
    f = f.with_df(f.df.select("user_id", "event_id", "us"))
    return f.then(timed.keep_alive(24 * HOUR, "us", {"event_id": F.lit(-1)})).df.select("user_id", "event_id", "emit_us")


@query(f"""WITH r AS (SELECT user_id, event_id, us, cents, row_number() OVER w AS i, min(us) OVER (PARTITION BY user_id) AS start FROM {E} WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
c AS (SELECT *, CAST(ceil((us - start) / {6 * HOUR}.0) AS BIGINT) AS c FROM r),
t AS (SELECT *, i + max(c - i) OVER (PARTITION BY user_id ORDER BY event_id) AS tick FROM c),
n AS (SELECT *, lead(tick) OVER (PARTITION BY user_id ORDER BY event_id) AS after FROM t),
g AS (SELECT *, CASE WHEN after IS NULL THEN 0 ELSE least(after - tick - 1, 3) END AS free FROM n)
SELECT user_id, event_id, nth::INTEGER AS nth, CASE WHEN nth > 0 THEN cents + nth * 10 ELSE cents END AS value, start + (tick + nth) * {6 * HOUR} AS emit_us
FROM g, LATERAL (SELECT unnest(range(0, free + 1)) AS nth) n""")
def extrapolate(spark, sf_dir):
    """A consumer that pulls every six hours; a value goes on by 10 a tick, three times at most."""
    f = events(spark, sf_dir).keyed("user_id")
    f = f.with_df(f.df.select("user_id", "event_id", "us", F.col("cents").alias("value")))
    out = f.then(timed.extrapolate(6 * HOUR, "us", F.col("value") + F.col("nth") * 10, 3)).df
    return out.select("user_id", "event_id", "nth", "value", "emit_us")


#: Midnight before the first event, in microseconds.
DAY_ONE = 1_704_067_200_000_000


@query(f"""WITH r AS (SELECT event_id, us FROM {_BUYS} UNION ALL SELECT NULL, {DAY_ONE}), g AS (SELECT *, lead(us) OVER (ORDER BY event_id NULLS FIRST) - us AS gap FROM r)
SELECT CASE WHEN i = 0 THEN event_id ELSE -1 END AS event_id, us + i * {HOUR // 4} AS emit_us
FROM g, LATERAL (SELECT unnest(range(0, 1 + coalesce(greatest(CAST(ceil(gap / {HOUR // 4}.0) AS BIGINT) - 1, 0), 0))) AS i) r WHERE i > 0 OR event_id IS NOT NULL""")
def keep_alive_whole(spark, sf_dir):
    """A row every quarter of an hour of silence, from the start of the first day on, before the first row too."""
    return _buys(spark, sf_dir).then(timed.keep_alive(HOUR // 4, "us", {"event_id": F.lit(-1)}, start=F.lit(DAY_ONE))).df.select("event_id", "emit_us")


@query(f"""WITH r AS (SELECT event_id, us, cents FROM {_BUYS} UNION ALL SELECT NULL, {DAY_ONE}, 5),
i AS (SELECT *, row_number() OVER (ORDER BY event_id NULLS FIRST) - 1 AS i, CAST(ceil((us - {DAY_ONE}) / {HOUR // 6}.0) AS BIGINT) AS c FROM r),
t AS (SELECT *, i + max(c - i) OVER (ORDER BY i) AS tick FROM i), n AS (SELECT *, lead(tick) OVER (ORDER BY i) AS after FROM t),
g AS (SELECT *, CASE WHEN after IS NULL THEN 0 ELSE least(after - tick - 1, cents % 4) END AS free FROM n)
SELECT event_id, nth::INTEGER AS nth, CASE WHEN nth > 0 THEN cents - nth ELSE cents END AS value, ({DAY_ONE} + (tick + nth) * {HOUR // 6})::BIGINT AS emit_us
FROM g, LATERAL (SELECT unnest(range(0, free + 1)) AS nth) n""")
def extrapolate_whole(spark, sf_dir):
    """From a first value of one's own on; each value goes on with as many more as its remainder by four says."""
    f = _buys(spark, sf_dir)
    more = F.transform(F.sequence(F.lit(1), F.lit(3)), lambda i: F.col("value") - i)
    more = F.slice(more, F.lit(1), (F.col("value") % 4).cast("int"))
    f = f.with_df(f.df.select("event_id", "us", F.col("cents").alias("value")))
    out = f.then(timed.extrapolate(HOUR // 6, "us", more, initial={"value": F.lit(5).cast("long")}, start=F.lit(DAY_ONE))).df
    return out.select("event_id", "nth", "value", "emit_us")


class _Settled(timed.Boundary):
    """A row leaves once nothing has come for so long behind it; those before it are dropped."""

    def __init__(self, quiet: int):
        self.quiet, self.row, self.done = quiet, None, False

    def on_push(self, ctl, row, now):
        self.row, ctl.pull_at = row, now + self.quiet

    def on_pull(self, ctl, now):
        if self.row:
            ctl.output.append(self.row)
        self.row, ctl.pull_at, ctl.closed = None, timed.MAX, self.done

    def on_complete(self, ctl, now):
        self.done, ctl.pull_at = True, timed.MIN


@query(f"""SELECT user_id, event_id, CASE WHEN gap IS NULL THEN us ELSE us + {36 * HOUR} END AS emit_us FROM (
  SELECT *, lead(us) OVER (PARTITION BY user_id ORDER BY event_id) - us AS gap FROM {E}) WHERE gap IS NULL OR gap > {36 * HOUR}""")
def deadline_boundary(spark, sf_dir):
    """The extension point itself: of rows in quick succession the last, a day and a half later."""
    f = events(spark, sf_dir).keyed("user_id")
    f = f.with_df(f.df.select("user_id", "event_id", "us"))
    return f.then(timed.boundary(lambda: _Settled(36 * HOUR), "user_id long, event_id long, us long, emit_us long", "us")).df.select("user_id", "event_id", "emit_us")


# --- failure, completion, composition ---


@query("SELECT event_id, user_id FROM events")
def synchronize(spark, sf_dir):
    return events(spark, sf_dir).then(lifecycle.synchronize_step_source(), lifecycle.synchronize_step_sink()).df.select("event_id", "user_id")


_RECOVER = f"""SELECT 0 AS src, event_id, cents FROM {E} WHERE event_id < coalesce((SELECT min(event_id) FROM {E} WHERE cents > 20000), 1e18)
UNION ALL SELECT 1, x, x * 10 FROM (SELECT unnest([7, 8, 9]) AS x) WHERE EXISTS (SELECT 1 FROM {E} WHERE cents > 20000)"""


def _recovered(spark, sf_dir, op):
    f = events(spark, sf_dir)
    f = f.with_df(f.df.select("event_id", "cents"))
    other = lambda: from_frame(spark.createDataFrame([(x, x * 10) for x in (7, 8, 9)], "event_id long, cents long"), "event_id")
    return f.then(op(F.col("cents") > 20000, other)).df.select("src", "event_id", "cents")


@query(_RECOVER)
def recover(spark, sf_dir):
    return _recovered(spark, sf_dir, lifecycle.recover)


@query(_RECOVER)
def recover_step(spark, sf_dir):
    return _recovered(spark, sf_dir, lifecycle.recover_step)


@query(f"""WITH bad AS (SELECT min(event_id) AS x FROM {E} WHERE cents % 1000 = 7)
SELECT 0 AS src, event_id, 1000000 // (cents % 1000 - 7) AS share FROM {E}, bad WHERE event_id < coalesce(x, 1e18)
UNION ALL SELECT 1, v, 11 FROM (SELECT unnest([7, 8]) AS v), bad WHERE x IS NOT NULL""".replace("1000000 // (cents % 1000 - 7)", "floor(1000000 / (cents % 1000 - 7))::BIGINT"))
def recover_processing(spark, sf_dir):
    """Processing that divides by nothing at some row; the other flow is told the error."""
    f = events(spark, sf_dir, "event_id", "cents")
    process = lambda r: {"event_id": r["event_id"], "share": 1_000_000 // (r["cents"] % 1000 - 7)}
    other = lambda error: from_frame(spark.createDataFrame([(7, 11), (8, 11)] if error.startswith("ZeroDivisionError") else [], "event_id long, share long"), "event_id")
    return f.then(lifecycle.recover_processing(process, "event_id long, share long", other)).df.select("src", "event_id", "share")


@query("SELECT 0 AS src, event_id FROM events UNION ALL SELECT 1, x FROM (SELECT unnest([0, 0, 0]) AS x)")
def also_complete(spark, sf_dir):
    f = events(spark, sf_dir)
    trailer = from_frame(spark.createDataFrame([(0,)] * 3, "event_id long"), "event_id")
    return f.with_df(f.df.select("event_id")).then(lifecycle.also_complete(trailer)).df.select("src", "event_id")


@query(f"SELECT sink, event_id, cents + i AS value FROM (SELECT (event_id % 3)::INTEGER AS sink, * FROM {E}), (SELECT unnest([0, 1]) AS i) r")
def flat_map_merge(spark, sf_dir):
    """Flat-maps side by side, one for each consumer of a balance, merged again."""
    op = chain(fan.balance(3), narrow.flat_map(F.array(F.col("cents"), F.col("cents") + 1)))
    return events(spark, sf_dir).then(op).df.select("sink", "event_id", "value")


@query("""WITH RECURSIVE c AS (SELECT DISTINCT (o_orderkey % 6199 + 1)::BIGINT AS v0, (o_orderkey % 6199 + 1)::BIGINT AS v, 0 AS step FROM orders
UNION ALL SELECT v0, CASE WHEN v % 2 = 0 THEN v // 2 ELSE 3 * v + 1 END, step + 1 FROM c WHERE v <> 1)
SELECT o_orderkey, step AS steps FROM orders JOIN c ON v0 = o_orderkey % 6199 + 1 WHERE v = 1""")
def cycle(spark, sf_dir):
    """A loop in the graph: values go round until they reach 1, however long it takes. Equal values share their rounds."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 6199 + 1).cast("long").alias("v0"))
    turn = lambda v: F.when(v % 2 == 0, F.floor(v / 2)).otherwise(3 * v + 1).cast("long").alias("v")
    # One expression goes round 64 times inside a row; what has not arrived then goes through it again.
    rounds = F.aggregate(F.sequence(F.lit(1), F.lit(64)), F.struct("v", "n"), lambda s, _: F.when(s["v"] == 1, s).otherwise(F.struct(turn(s["v"]), (s["n"] + 1).alias("n"))))
    left, done = orders.select("v0", F.col("v0").alias("v"), F.lit(0).alias("n")).distinct(), None
    while True:
        went = stage(left.withColumn("s", rounds).select("v0", "s.v", "s.n"), "cycle")
        there = went.where("v = 1").select(F.col("v0").alias("of"), F.col("n").alias("steps"))
        done, left = there if done is None else done.union(there), went.where("v <> 1")
        if left.isEmpty():
            return orders.join(done, F.col("v0") == F.col("of")).select("o_orderkey", "steps")


@query(f"""SELECT event_type, (rn // 100)::BIGINT AS batch_id, count(*) AS n, sum(cents)::BIGINT AS total, max(cents) AS high FROM (
  SELECT event_type, cents, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS rn FROM {E} WHERE event_type <> 'error') GROUP BY 1, 2""")
def pipeline_batches(spark, sf_dir):
    """The flagship: drop errors, group by type, batches of 100, aggregates of each."""
    op = chain(narrow.filter_map(F.when(F.col("event_type") != "error", F.col("cents"))), group.group_by(F.col("event_type"), key="event_type"), timed.batch_count(100, C.summing("cents"), C.maximum("cents")))
    return events(spark, sf_dir).then(op).df.select("event_type", "batch_id", "n", "total", "high")


# --- the three harnesses over a million rows ---


@query("SELECT 999999000000::BIGINT AS total")
def million_map(spark, sf_dir):
    f = from_frame(spark.range(1_000_000).withColumnRenamed("id", "pos"), "pos")
    return f.then(parallel.map_balance_ordered(F.col("pos") * 2)).collect(C.summing("value"))


@query("SELECT 1500004500000::BIGINT AS total")
def million_broadcast(spark, sf_dir):
    f = from_frame(spark.range(1_000_000).withColumnRenamed("id", "pos"), "pos")
    return f.then(fan.broadcast([None] * 3), timed.buffer(4)).collect(C.summing(F.col("pos") + F.col("sink") + 1))


@query("SELECT 499999500000::BIGINT AS total")
def million_push(spark, sf_dir):
    return from_frame(spark.range(1_000_000).withColumnRenamed("id", "pos"), "pos").collect(C.summing("pos"))
