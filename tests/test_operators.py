"""Operators on the small inputs whose results are known, at their edges, and against plain Python."""

import random
from collections import deque

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from flowline import functions as C
from flowline.flow import Flow, Operator, chain, proxied
from flowline.operators import fan, gather, group, lifecycle, narrow, parallel, timed
from flowline.plans.ordinal import with_neighbours, with_position, with_running
from flowline.sources import batches_to, collect_list, from_callable, from_rows, one_shot, rows_to


def ints(spark, *values):
    return from_rows(spark, [(v,) for v in values], "v int")


def values(flow, *cols):
    cols = cols or ("v",)
    return [r[cols[0]] if len(cols) == 1 else tuple(r[c] for c in cols) for r in flow.rows()]


def test_filter_map_odd_negated(spark):
    assert values(ints(spark, *range(1, 7)).then(narrow.filter_map(F.when(F.col("v") % 2 == 1, -F.col("v")), "v"))) == [-1, -3, -5]


def test_split_even_starts(spark):
    out = ints(spark, *range(6)).then(group.split(F.col("v") % 2 == 0, first="first", of="v"))
    assert values(out, "v", "first") == [(0, 0), (1, 0), (2, 2), (3, 2), (4, 4), (5, 4)]
    late = ints(spark, 1, 2, 3, 4).then(group.split(F.col("v") % 2 == 0))
    assert values(late, "segment") == [1, 2, 2, 3]  # the first row opens a segment without a match
    after = ints(spark, 1, 2, 3, 4, 5).then(group.split(F.col("v") % 2 == 0, after=True))
    assert values(after, "segment") == [1, 1, 2, 2, 3]


def test_split_keyed_equals_whole(spark):
    f = ints(spark, *[random.Random(1).randrange(5) for _ in range(60)])
    one = f.with_df(f.df.withColumn("k", F.lit(1))).keyed("k")
    for after in (False, True):
        assert values(f.then(group.split(F.col("v") == 0, after=after)), "segment") == values(one.then(group.split(F.col("v") == 0, after=after)), "segment")


def test_group_by_first_letter(spark):
    f = from_rows(spark, [("now",), ("or",), ("never",)], "s string")
    out = f.then(group.group_by(F.substring("s", 1, 1), first="first", of="s"))
    assert values(out, "k", "s", "first") == [("n", "now", "now"), ("o", "or", "or"), ("n", "never", "now")]
    with pytest.raises(PySparkException):
        from_rows(spark, [(None,)], "s string").then(group.group_by(F.col("s"))).rows()


def test_flat_map_colors(spark):
    out = from_rows(spark, [("red",), ("blue",), ("green",)], "s string").then(narrow.flat_map(F.array(F.lit("color"), F.col("s"))))
    assert values(out, "value") == ["color", "red", "color", "blue", "color", "green"]
    assert not from_rows(spark, [("x",)], "s string").then(narrow.flat_map(F.lit(None).cast("array<string>"))).rows()


def test_gather_map_doubles(spark):
    f = ints(spark, 1, 2, 3)
    f = f.with_df(f.df.withColumn("k", F.lit(0))).keyed("k")
    out = f.then(gather.gather(gather.Gatherer.map(lambda r: {"pos": r["pos"], "v": r["v"] * 2}), "pos long, v int"))
    assert values(out) == [2, 4, 6]


@pytest.mark.parametrize("keyed", [False, True])
def test_windows(spark, keyed):
    f = ints(spark, 1, 2, 3, 4, 5)
    f = f.with_df(f.df.withColumn("k", F.lit(0))).keyed("k") if keyed else f
    assert values(f.then(gather.window_sliding(3, "v")), "window") == [[1, 2, 3], [2, 3, 4], [3, 4, 5]]
    assert values(f.then(gather.window_sliding(9, "v")), "window") == []
    assert values(f.then(gather.window_fixed(2, "v")), "window") == [[1, 2], [3, 4], [5]]
    assert values(f.then(gather.scan(F.col("v"))), "total") == [1, 3, 6, 10, 15]
    assert f.then(gather.fold(C.summing("v"))).df.collect()[0].total == 15


def test_positions_and_running_values(spark):
    rng = random.Random(2)
    data = [(i, rng.randrange(100)) for i in range(3000)]
    rng.shuffle(data)
    df = spark.createDataFrame(data, "id long, v long").repartition(7)
    got = with_running(df, ["id"], {"total": ("sum", F.col("v")), "high": ("max", F.col("v"))}).orderBy("id").collect()
    total, high = 0, -1
    for i, (r, (_, v)) in enumerate(zip(got, sorted(data), strict=True)):
        total, high = total + v, max(high, v)
        assert (r.pos, r.total, r.high) == (i, total, high)
    near = with_neighbours(df, ["id"], "v", 5, "w").orderBy("id").collect()
    plain = [v for _, v in sorted(data)]
    assert [r.w for r in near] == [plain[max(0, i - 4) : i + 1] for i in range(3000)]
    assert with_position(df.where("id < 0"), ["id"]).count() == 0


def test_staged_tables_are_released(spark):
    import os

    from flowline.plans.staging import release, shared_dir, stage

    got = stage(spark.range(5), "five")
    assert got.count() == 5 and any("five" in x for x in os.listdir(shared_dir(spark).removeprefix("file://")))
    release()
    assert not any("five" in x for x in os.listdir(shared_dir(spark).removeprefix("file://")))


def test_route_and_bad_index(spark):
    t = F.array(F.struct(F.lit(0).alias("index"), F.col("v").alias("value")), F.struct((F.col("v") % 2).alias("index"), (-F.col("v")).alias("value")))
    assert values(ints(spark, 1, 2).then(fan.route(t, 2)), "sink", "value") == [(0, 1), (1, -1), (0, 2), (0, -2)]
    with pytest.raises(PySparkException):
        ints(spark, 3).then(fan.route(t, 1)).rows()


def test_route_cancel_against_python(spark):
    rng = random.Random(3)
    plan = [[(rng.randrange(3), rng.randrange(9)) for _ in range(rng.randrange(3))] for _ in range(40)]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(plan)], "pos long, t array<struct<index:int,value:int>>")
    for limits, eager in (([4, 6, None], True), ([4, 6, 5], False), ([4, 6, None], False)):
        want, seen, active, done = [], [0] * 3, [True] * 3, False
        for p in plan:
            if done:
                break
            for i, v in p:
                if active[i]:
                    want.append((i, v))
                    seen[i] += 1
                    active[i] = limits[i] is None or seen[i] < limits[i]
            done = not all(active) if eager else not any(active)
        out = Flow(df, ("pos",)).then(fan.route(F.col("t"), 3, limits, eager))
        assert values(out, "sink", "value") == want


def test_broadcast_reaches_all_on_the_last_row(spark):
    out = ints(spark, *range(10)).then(fan.broadcast([None, 3]))
    assert values(out, "sink", "v") == [(s, v) for s in (0, 1) for v in range(3)]


def test_fan_in(spark):
    a, b = ints(spark, 1, 5, 2), ints(spark, 3, 4)
    assert values(fan.concat([a, b])) == [1, 5, 2, 3, 4]
    assert sorted(values(fan.merge([a, b]))) == [1, 2, 3, 4, 5]
    assert values(fan.zip_flows(a, b, F.col("l_v") + F.col("r_v")), "value") == [4, 9]
    assert fan.merge_sorted([], "v") is None
    with pytest.raises(PySparkException):
        fan.zip_flows(a, b, F.lit(None).cast("int")).rows()


def test_merge_sorted_of_unsorted_heads(spark):
    rng = random.Random(4)
    sources = [[rng.randrange(20) for _ in range(rng.randrange(1, 12))] for _ in range(3)]
    left, want = [deque(s) for s in sources], []
    while any(left):
        i = min((i for i in range(3) if left[i]), key=lambda i: (left[i][0], i))
        want.append((i, left[i].popleft()))
    assert values(fan.merge_sorted([ints(spark, *s) for s in sources], "v", is_sorted=False), "src", "v") == want


def test_zip_latest_holds_the_early_side(spark):
    a = spark.createDataFrame([(0, 1, 1), (1, 2, 2), (2, 3, 3)], "pos long, us long, v int")
    b = spark.createDataFrame([(0, 10, 9), (1, 11, 10)], "pos long, us long, v int")
    one, two = Flow(a, ("pos",), (), "us"), Flow(b, ("pos",), (), "us")
    assert values(fan.zip_latest(one, two, "v"), "l", "r") == [(1, 9), (2, 9), (3, 9), (3, 10)]
    assert values(fan.zip_latest(one, two, "v", hold=False), "l", "r") == [(3, 9), (3, 10)]
    assert not fan.zip_latest(one, two.with_df(b.where("v < 0")), "v").rows()


def test_take_operators(spark):
    f = from_rows(spark, [("a", 1), ("b", 2), ("a", 3), ("a", 4), ("b", 5)], "k string, v int").keyed("k")
    assert values(f.then(group.take_each(2))) == [1, 2, 3, 5]
    assert values(f.then(group.take_each_eager(2))) == [1, 2, 3]
    assert values(f.then(group.take_each_eager(9))) == [1, 2, 3, 4, 5]
    assert values(f.then(narrow.take_while(F.col("v") < 3))) == [1, 2]
    assert values(Flow(f.df, f.order).then(narrow.take_while(F.col("v") < 3))) == [1, 2]


# --- time ---


def timed_flow(spark, rows, schema="k int, pos long, us long, x long"):
    return Flow(spark.createDataFrame(rows, schema), ("pos",), ("k",), "us")


def random_rows(seed, n=60):
    rng = random.Random(seed)
    at, out = 0, []
    for i in range(n):
        at += rng.choice([0, 1, 2, 5, 9, 30])
        out.append((i % 2, i, at, rng.randrange(6)))
    return out


def brute_throttle(rows, interval, limit):
    """Every microsecond in turn: accrue, then emit what can be paid."""
    out = {}
    for k in {r[0] for r in rows}:
        own = deque(r for r in rows if r[0] == k)
        now, tokens, raised, queue, last = own[0][2], limit, 0, deque(), own[0][2]
        while own or queue:
            if now - last >= interval:
                tokens, last = min(tokens + 1, max(limit, raised)), last + interval
            while own and own[0][2] <= now:
                queue.append(own.popleft())
            while queue and tokens >= queue[0][3]:
                tokens, raised = tokens - queue[0][3], 0
                out[queue.popleft()[1]] = now
            if queue:
                raised = queue[0][3]
            now += 1
    return out


@pytest.mark.parametrize("seed", range(3))
def test_throttle(spark, seed):
    rows = random_rows(seed)
    out = timed_flow(spark, rows).then(timed.throttle(4, 3, "x", "k int, pos long, us long, x long, emit_us long", "us"))
    assert {r.pos: r.emit_us for r in out.df.collect()} == brute_throttle(rows, 4, 3)


def test_throttle_rejects_negative_costs(spark):
    with pytest.raises(PySparkException):
        timed_flow(spark, [(0, 0, 0, -1)]).then(timed.throttle(4, 3, "x", "k int, pos long, us long, x long, emit_us long", "us")).rows()


def test_batch_by_count_or_timeout(spark):
    rows = [(0, i, t, 0) for i, t in enumerate([0, 1, 2, 3, 20, 21, 40])]
    member = "array<struct<k:int,pos:long,us:long,x:long>>"
    out = timed_flow(spark, rows).then(timed.batch_timeout(3, 10, "us", f"k int, rows {member}, n long, emit_us long", ("k",)))
    assert [([m.pos for m in r["rows"]], r.emit_us) for r in out.df.orderBy("emit_us").collect()] == [([0, 1, 2], 2), ([3], 13), ([4, 5], 30), ([6], 40)]


def test_delay_orders_by_deadline_and_buffers(spark):
    rows = [(0, 0, 0, 50), (0, 1, 1, 5), (0, 2, 2, 1)]
    out = timed_flow(spark, rows).then(timed.delay(F.col("x"), "us"))
    assert values(out, "pos", "emit_us") == [(2, 2), (1, 5), (0, 50)]
    schema = "k int, pos long, us long, x long, emit_us long"
    full = timed_flow(spark, rows).then(timed.delay_buffered("x", 1, schema, "us"))
    assert [(r.pos, r.emit_us) for r in full.df.orderBy("emit_us", "pos").collect()] == [(0, 50), (1, 50), (2, 50)]


def test_keep_alive(spark):
    rows = [(0, 0, 0, 1), (0, 1, 10, 2), (0, 2, 35, 3)]
    out = timed_flow(spark, rows).then(timed.keep_alive(10, "us", {"x": F.lit(-1)}))
    assert values(out, "emit_us", "x") == [(0, 1), (10, 2), (20, -1), (30, -1), (35, 3)]


@pytest.mark.parametrize("seed", range(3))
def test_extrapolate(spark, seed):
    rows = random_rows(seed, 30)
    out = timed_flow(spark, rows).then(timed.extrapolate(4, "us", F.col("x") + 100 * F.col("nth"), 2, name="x"))
    got = sorted((r.k, r.emit_us, r.x) for r in out.df.collect())
    want = []
    for k in (0, 1):
        own = deque(r for r in rows if r[0] == k)
        now, queue, base, n = own[0][2], deque(), None, 0
        while own or queue:
            while own and own[0][2] <= now:
                queue.append(own.popleft())
            if queue:
                base, n = queue.popleft(), 0
                want.append((k, now, base[3]))
            elif n < 2:
                n += 1
                want.append((k, now, base[3] + 100 * n))
            now += 4
    assert got == sorted(want)


@pytest.mark.parametrize("keyed", [True, False])
def test_paced_buffer(spark, keyed):
    """A producer that waits for room, a consumer that takes a row each 5 microseconds: step by step."""
    rows = random_rows(1)
    rows = rows if keyed else [(0, *r[1:]) for r in rows]
    f = timed_flow(spark, rows)
    out = (f if keyed else f.keyed()).then(timed.buffer(3, "us", 5)).df.collect()
    for k in {r[0] for r in rows}:
        left: list[int] = []
        want = {}
        for i, (_, pos, us, _) in enumerate(sorted((r for r in rows if r[0] == k), key=lambda r: r[1])):
            pushed = max(us, left[i - 3]) if i >= 3 else us
            left.append(max(pushed, left[-1] + 5) if left else pushed)
            want[pos] = (left[-1], pushed)
        assert {r.pos: (r.emit_us, r.pushed_us) for r in out if r.k == k} == want
    for op in (timed.rendezvous(), timed.buffer(1), lifecycle.synchronize()):
        assert values(ints(spark, 3, 1, 2).then(op)) == [3, 1, 2]
    for bad in (lambda: timed.buffer(0), lambda: timed.batch_count(0), lambda: timed.keep_alive(0, "us", {}), lambda: timed.throttle(0, 1, "x", "", "us"), lambda: timed.throttle(1, 1, "x", "", "us", room=0)):
        with pytest.raises(ValueError):
            bad()


@pytest.mark.parametrize("seed", range(2))
def test_whole_flows_equal_one_key(spark, seed):
    """Without key, a flow gives what it gives as the only stream of a key."""
    rows = [(0, i, us, x) for i, (_, _, us, x) in enumerate(sorted(random_rows(seed, 40), key=lambda r: (r[2], r[1])))]
    schema = "k int, pos long, us long, x long, emit_us long"
    member = "array<struct<k:int,pos:long,us:long,x:long>>"
    ops = [
        timed.throttle(4, 3, "x", schema, "us"), timed.delay_buffered("x", 2, schema, "us"), timed.keep_alive(3, "us", {"x": F.lit(-1)}, start=F.lit(-10)),
        timed.extrapolate(4, "us", F.col("x") + 100 * F.col("nth"), 2, name="x", initial={"x": F.lit(3).cast("long")}, start=F.lit(-9)),
        timed.batch(lambda r: timed.MIN if sum(x["x"] for x in r) > 6 else r[0]["us"] + 9 if len(r) == 1 else None, "us", f"rows {member}, n long, emit_us long"),
        gather.gather(gather.Gatherer(lambda s, r, push: push({"k": r["k"], "s": s.update(n=s.get("n", 0) + r["x"]) or s["n"]}) or True), "k int, s long"),
    ]
    for op in ops:
        one, whole = timed_flow(spark, rows).then(op).df, timed_flow(spark, rows).keyed().then(op).df
        plain = lambda df: sorted(repr(sorted((k, v) for k, v in r.asDict().items() if k != "k")) for r in df.collect())
        assert plain(one) == plain(whole)


def test_throttle_tells_when_a_full_buffer_let_rows_in(spark):
    rows = [(0, i, 0, 2) for i in range(5)]
    schema = "k int, pos long, us long, x long, emit_us long, pushed long"
    out = timed_flow(spark, rows).then(timed.throttle(10, 2, "x", schema, "us", room=2, pushed="pushed"))
    assert values(out, "emit_us", "pushed") == [(0, 0), (20, 0), (40, 0), (60, 20), (80, 40)]


def test_batch_keeps_its_deadline(spark):
    """No new deadline keeps the old one, and a batch without any waits for the end."""
    rows = [(0, i, t, 0) for i, t in enumerate([0, 4, 30, 31])]
    schema = "rows array<struct<k:int,pos:long,us:long,x:long>>, n long, emit_us long"
    out = timed_flow(spark, rows).then(timed.batch(lambda r: 10 if len(r) == 1 and r[0]["us"] == 0 else None, "us", schema))
    assert [(r.n, r.emit_us) for r in out.df.orderBy("emit_us").collect()] == [(2, 10), (2, 31)]


def test_keep_alive_from_the_start(spark):
    rows = [(0, 0, 25, 1), (0, 1, 30, 2), (1, 2, 5, 3)]
    out = timed_flow(spark, rows).then(timed.keep_alive(10, "us", {"x": F.lit(-1)}, start=F.lit(0)))
    assert sorted((r.k, r.emit_us, r.x) for r in out.df.collect()) == [(0, 10, -1), (0, 20, -1), (0, 25, 1), (0, 30, 2), (1, 5, 3)]


def test_split_cancels(spark):
    f = ints(spark, 0, 1, 1, 1, 1, 0, 1, 1)
    at = F.col("v") == 0
    assert values(f.then(group.split_take(at, 3)), "segment") == [1, 1, 1, 2, 2, 3, 3, 3]
    assert values(f.then(group.split_take(at, 3, eager=True)), "segment") == [1, 1, 1]
    assert values(f.then(group.split_take(at, 9, eager=True)), "segment") == [1, 1, 1, 1, 1, 2, 2, 2]
    two = f.with_df(f.df.withColumn("k", F.lit(1)))
    assert values(two.then(group.split_take(at, 3, ["k"], eager=True)), "segment") == [1, 1, 1]
    assert values(f.then(group.split_take(at, 2, after=True)), "segment") == [1, 2, 2, 3, 3, 4, 5, 5]


def test_recover_from_failing_processing(spark):
    op = lifecycle.recover_processing(lambda r: {"pos": r["pos"], "v": 12 // r["v"]}, "pos long, v int", lambda error: ints(spark, *([7, 8] if "ZeroDivision" in error else [])))
    assert values(ints(spark, 1, 2, 3, 0, 4).then(op)) == [12, 6, 4, 7, 8]
    assert values(ints(spark, 1, 2).then(op)) == [12, 6]


class Pairs(timed.Boundary):
    """Two rows at a time are added up, by a clock that runs at half speed."""

    def __init__(self):
        self.held = None

    def clock(self, row, column):
        return row[column] // 2

    def on_push(self, ctl, row, now):
        if self.held is None:
            self.held = row
        else:
            self.held, ctl.pull_at = {**row, "x": row["x"] + self.held["x"]}, timed.MIN

    def on_pull(self, ctl, now):
        if ctl.pull_at == timed.MIN:
            ctl.output.append(self.held)
        self.held, ctl.pull_at = None, timed.MAX

    def on_complete(self, ctl, now):
        ctl.closed = True


def test_boundary_with_its_own_clock(spark):
    out = timed_flow(spark, [(0, i, 10 * i, i) for i in range(5)]).then(timed.boundary(Pairs, "k int, pos long, us long, x long, emit_us long", "us"))
    assert values(out, "x", "emit_us") == [(1, 5), (5, 15)]


# --- parallel map ---


def test_parallel_maps(spark):
    f = ints(spark, *range(100))
    even = F.when(F.col("v") % 2 == 0, F.col("v") * 10)
    want = [v * 10 for v in range(0, 100, 2)]
    for op in (parallel.map_balance_ordered(even, "v"), parallel.map_balance_ordered(even, "v", 4), parallel.map_balance_partitioned(F.col("pos") % 3, even, "v", 4, 1), parallel.map_balance_partitioned(F.col("pos") % 3, even, "v", 2, 2)):
        assert values(f.then(op)) == want
    for op in (parallel.balance_merge_source(4, even, "v"), parallel.balance_merge_sink(4, even, "v")):
        assert sorted(values(f.then(op))) == want
    with pytest.raises(PySparkException):
        f.then(parallel.map_balance_partitioned(F.lit(None), even)).rows()


def test_keys_stay_in_one_task_and_order(spark):
    def tag(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        for b in batches:
            yield b.append_column("task", pa.array([TaskContext.get().partitionId()] * b.num_rows, pa.int32()))

    f = ints(spark, *range(200))
    out = f.then(parallel.map_balance_partitioned(F.col("v") % 7, concurrency=4, permits=1, batches=tag, schema="pos long, v int, k int, task int"))
    tasks = out.df.groupBy("k").agg(F.countDistinct("task").alias("n")).collect()
    assert len(tasks) == 7 and all(r.n == 1 for r in tasks)


# --- failure, completion, composition ---


def test_recover(spark):
    out = ints(spark, 1, 2, 3, 0, 4).then(lifecycle.recover(F.col("v") == 0, lambda: ints(spark, 7, 8, 9)))
    assert values(out) == [1, 2, 3, 7, 8, 9]
    assert values(ints(spark, 1, 2).then(lifecycle.recover(F.col("v") == 0, lambda: 1 / 0))) == [1, 2]


def test_recover_run():
    fail = lambda: 1 / 0
    assert lifecycle.recover_run(lambda: 1, fail) == 1
    assert lifecycle.recover_run(fail, lambda e: (lambda: 2)) == 2
    with pytest.raises(ZeroDivisionError):
        lifecycle.recover_run(fail, lambda e: [][0])
    with pytest.raises(lifecycle.UpstreamError) as caught:
        lifecycle.recover_run(fail, lambda e: (lambda: [][0]))
    assert isinstance(caught.value.__cause__, ZeroDivisionError)


def test_also_complete_and_close(spark):
    assert values(ints(spark, 0, 1).then(lifecycle.also_complete(ints(spark, 0, 0, 0)))) == [0, 1, 0, 0, 0]
    done = []
    with lifecycle.also_close(lambda: done.append("a"), lambda: done.append("b")):
        pass
    assert done == ["b", "a"]


def test_composed_errors():
    done = []

    def bad(name):
        def run(*_):
            done.append(name)
            raise ValueError(name)

        return run

    with pytest.raises(ValueError, match="a") as caught:
        lifecycle.composed([bad("a"), lambda: done.append("b"), bad("c")])
    assert done == ["a", "b", "c"] and caught.value.__notes__ == ["also: ValueError('c')"]
    with pytest.raises(ValueError):
        lifecycle.composed_complete_abruptly([bad("x")], RuntimeError())


def test_failure_handling_scope():
    seen, done = [], []
    with lifecycle.FailureHandlingScope(seen.append) as scope:
        scope.fork(lambda: 1 / 0)
        scope.fork(lambda: done.append(1))
    assert done == [1] and isinstance(seen[0], ZeroDivisionError)


def test_composition(spark):
    add = lambda n: Operator(lambda f: f.with_df(f.df.withColumn("v", F.col("v") * 2 + n)), f"x2+{n}")
    f = ints(spark, 1)
    assert values(f.then(add(1), add(5))) == values(add(1).then(add(5))(f)) == values(add(5).compose(add(1))(f)) == values(chain(add(1), add(5))(f)) == [11]
    assert values(chain()(f)) == [1]
    assert values(proxied(add(0), after=add(3))(f)) == [7]
    assert f.into(collect_list()).run()[0].v == 1


# --- sources and sinks ---


def test_sources(spark, tmp_path):
    closed = []
    f = from_rows(spark, iter([(1,), (2,)]), "v int", close=lambda: closed.append(1))
    assert values(f) == [1, 2] and closed == [1]
    with pytest.raises(ValueError):
        from_rows(spark, [(1,), None], "v int")
    source = one_shot(spark, iter([(1,), (2,)]), "v int")
    assert values(source()) == [1, 2] and values(source()) == []
    assert values(from_callable(spark, "three", lambda i: [(i, i * 2)], 3, "pos long, v long", "pos")) == [0, 2, 4]
    batches_to(str(tmp_path / "out"))(f)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    seen = spark.sparkContext.accumulator(0)
    rows_to(lambda rows: seen.add(sum(r.v for r in rows)))(f)
    f.for_each(lambda r: seen.add(r.v))
    assert seen.value == 6
    with pytest.raises(ValueError):
        collect_list(1)(f)


def test_collectors(spark):
    f = from_rows(spark, [("a", 3), ("b", 1), ("a", 2)], "k string, v int").keyed("k")
    got = f.collect(C.counting(), C.summing("v"), C.averaging("v"), C.minimum("v"), C.maximum("v"), C.to_list("v", "pos"), C.joining("v", "-", "pos"), C.reducing("v", F.lit(0), lambda a, x: a * 10 + x, "pos"))
    a = next(r for r in got.collect() if r.k == "a")
    assert (a.n, a.total, a.average, a.low, a.high, a["items"], a.joined, a.result) == (2, 5, 2.5, 2, 3, [3, 2], "3-2", 32)
    with pytest.raises(ValueError):
        Flow(f.df, f.order).window()


def test_staged_tables_go_with_their_scope(spark):
    import os

    from flowline.plans import staging

    outer = staging.stage(ints(spark, 1).df, "outer")
    with staging.scope():
        inner = staging.stage(ints(spark, 2).df, "inner").inputFiles()[0]
        assert os.path.exists(inner.removeprefix("file:").replace("///", "/"))
    assert not os.path.exists(inner.removeprefix("file:").replace("///", "/")) and outer.count() == 1
