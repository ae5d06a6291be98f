"""Streams give what tables give."""

import pytest
from pyspark.sql import functions as F

from flowline.flow import Flow
from flowline.operators import fan, narrow, timed
from flowline.operators.lifecycle import UpstreamError
from flowline.streaming import QueryGroup, stream_boundary, stream_flow
from flowline.streaming.processors import windowed

SCHEMA = "k long, pos long, us long, x long, at timestamp"
OUT = "k long, pos long, us long, x long, emit_us long"


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    """Three files of rows, later ones in later files."""
    where = str(tmp_path_factory.mktemp("stream") / "in")
    rows = [(i % 2, i, (i + 1) * 1_000_000 + (i % 5) * 1000, i % 4) for i in range(90)]
    for part in range(3):
        df = spark.createDataFrame(rows[part * 30 : part * 30 + 30], "k long, pos long, us long, x long")
        df.withColumn("at", F.timestamp_micros("us")).coalesce(1).write.mode("append").parquet(where)
    return where, rows


def run(spark, flow, tmp_path, name):
    q = flow.df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    with QueryGroup() as group:
        group.add(q)
        assert group.await_all(120)
    return spark.sql(f"select * from {name}").collect()


def source(spark, files, clock=None):
    df = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(files[0])
    return stream_flow(df, "pos", clock=clock)


def test_stateless_operators(spark, files, tmp_path):
    flow = source(spark, files).then(narrow.filter_map(F.when(F.col("x") > 1, F.col("x") * 2), "y"), fan.balance(3), narrow.flat_map(F.array("y", F.col("y") + 1)))
    got = run(spark, flow, tmp_path, "stateless")
    want = [(i, i % 3, y) for _, i, _, x in files[1] if x > 1 for y in (x * 2, x * 2 + 1)]
    assert sorted((r.pos, r.sink, r.value) for r in got) == sorted(want)


@pytest.mark.parametrize("name", ["throttle", "delay"])
def test_boundaries_equal_batch(spark, files, tmp_path, name):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    make = {"throttle": lambda: timed.Throttled(3_000_000, 2, "x"), "delay": lambda: timed.Delayed("x", 10)}[name]
    shift = F.col("us") + F.col("x") * 1_500_000 if name == "delay" else F.col("x")
    batch = Flow(spark.createDataFrame(files[1], "k long, pos long, us long, x long").withColumn("x", shift), ("pos",), ("k",), "us")
    want = {(r.pos, r.emit_us) for r in batch.then(timed.boundary(make, OUT, "us")).df.collect()}
    flow = source(spark, files, "at")
    flow = flow.with_df(flow.df.withColumn("x", shift), key=("k",))
    got = {(r.pos, r.emit_us) for r in run(spark, flow.then(stream_boundary(make, OUT, "us", "at")), tmp_path, f"live_{name}")}
    seen = max(r[2] for r in files[1])
    assert got <= want and {p for p in want if p[1] < seen - 3_000_000} <= got


def test_event_time_windows(spark, files, tmp_path):
    flow = source(spark, files, "at")
    got = run(spark, flow.with_df(windowed(flow.keyed("k"), "at", "10 seconds", F.count(F.lit(1)).alias("n"))), tmp_path, "windows")
    assert got and all(r.n in (4, 5) for r in got)


def test_group_hands_failures_over(spark, files, tmp_path):
    bad = source(spark, files).df.select(F.raise_error(F.lit("no")).alias("x"))
    start = lambda df, n: df.writeStream.format("noop").option("checkpointLocation", str(tmp_path / n)).trigger(availableNow=True).start()
    seen, closed = [], []
    with QueryGroup(lambda q, e: seen.append(e)) as group:
        group.also_close(lambda: closed.append(1))
        group.add(start(bad, "bad"))
        group.add(start(source(spark, files).df, "good"))
        assert group.await_all(120)
    assert len(seen) == 1 and closed == [1]
    with pytest.raises(UpstreamError), QueryGroup() as group:
        group.add(start(bad, "worse"))
        group.await_all(120)
