import os
import tempfile

import pytest
from pyspark.sql import functions as F

from keyclock.functions import assigners as A
from keyclock.model import key_by
from keyclock.operators import windows as W
from keyclock.plans.scenarios import HOUR, replay
from keyclock.sources.replay import read_replay, start_sink
from keyclock.strategy import WatermarkStrategy as S
from keyclock.streaming import windows as SW

TICK = 72 * HOUR


@pytest.fixture(scope="module")
def ticks(spark, sf_dir):
    """One parquet file per arrival tick, in arrival order."""
    ks = replay(spark, sf_dir, "global50")
    ks = ks.with_df(ks.df.withColumn("k", F.col("user_id") % 3))
    slim = ks.df.select("k", "t_ms", "arrival", "event_id", F.round(F.col("value") * 100).cast("bigint").alias("cents"))
    slim = slim.withColumn("tick", F.expr(f"arrival div {TICK}")).cache()
    path = tempfile.mkdtemp(prefix="keyclock-ticks-")
    for i, (t,) in enumerate(sorted(tuple(r) for r in slim.select("tick").distinct().collect())):
        target = os.path.join(path, f"part={i:04d}")
        slim.where(F.col("tick") == t).drop("tick").coalesce(1).write.parquet(target)
        stamp = 1_600_000_000 + i * 10
        for f in os.listdir(target):
            os.utime(os.path.join(target, f), (stamp, stamp))
    return path, slim.drop("tick")


def keyed(df):
    return key_by(df, "k", ts="t_ms", arrival="arrival", tie="event_id", bucket_ms=6 * HOUR)


def run(spark, ticks_path, schema, strategy, assigner, **options):
    src = read_replay(spark, ticks_path + "/*", schema=schema, streaming=True, files_per_batch=1)
    out = SW.stream_windows(keyed(src), strategy, assigner, **options)
    work = tempfile.mkdtemp(prefix="keyclock-stream-")
    sink, cp = work + "/out", work + "/cp"
    start_sink(out, cp, path=sink).awaitTermination()
    return spark.read.parquet(sink), cp


def firings(df, *more):
    return sorted(tuple(r) for r in df.select("k", "window_start", "window_end", "firing_no", "elements", "wm", *more).collect())


@pytest.mark.parametrize("lateness,combine", [(0, False), (3 * HOUR, False), (0, True)])
def test_tick_stream_equals_batch(spark, ticks, lateness, combine):
    path, df = ticks
    cents = [W.count(), W.total("cents", F.col("cents"))]
    strategy, assigner = S.bounded(1000).every_tick(TICK), A.tumbling(6 * HOUR)
    got, cp = run(spark, path, df.schema, strategy, assigner, measures=cents, lateness_ms=lateness, combine=combine)
    fired = got.where("tag = 'firing'")
    flushed = SW.open_windows(spark, cp, ("k",), ["cents"])
    both = fired.select("k", "window_start", "window_end", "firing_no", "elements", "wm", "cents").unionByName(flushed.drop("tag"))
    want = W.window_firings(keyed(df), strategy, assigner, cents, lateness)
    final = lambda d: {r[:3]: (r[3], r[4], r[6]) for r in firings(d, "cents")}  # the last firing of every window
    if lateness == 0:
        assert firings(both, "cents") == firings(want, "cents")
    else:
        # inside one tick refirings have no order of their own; their number and the last value do
        assert len(firings(both)) == want.count()
        assert final(both) == final(want)
    late = got.where("tag = 'late'").agg(F.sum("elements")).first()[0] or 0
    assert late == W.late_rows(keyed(df), strategy, assigner, lateness).count() > 0
    clocks = {tuple(r) for r in SW.current_watermarks(spark, cp, ("k",)).collect()}
    from keyclock.operators.watermark import final_watermarks

    assert clocks == {tuple(r) for r in final_watermarks(keyed(df), S.bounded(1000)).collect()}


def test_record_stream_equals_batch(spark, ticks):
    path, df = ticks
    strategy, assigner = S.bounded(1000), A.sliding(12 * HOUR, 6 * HOUR)
    got, cp = run(spark, path, df.schema, strategy, assigner, lateness_ms=2 * HOUR)
    both = got.where("tag = 'firing'").select("k", "window_start", "window_end", "firing_no", "elements", "wm").unionByName(
        SW.open_windows(spark, cp, ("k",)).drop("tag"))
    assert firings(both) == firings(W.window_firings(keyed(df), strategy, assigner, lateness_ms=2 * HOUR))
    late = {r[0] for r in got.where("tag = 'late'").select("tie").collect()}
    assert late == {r[0] for r in W.late_rows(keyed(df), strategy, assigner, 2 * HOUR).select("event_id").collect()}


@pytest.mark.parametrize("size,slide,combine", [(6, 10, True), (12, 6, True), (6, 10, False)])
def test_gaps_overlaps_and_fractions(spark, ticks, size, slide, combine):
    """Rows without a window keep their clock step, a row is late with all its windows, and sums keep their fractions."""
    path, df = ticks
    strategy, assigner = S.bounded(1000).every_tick(TICK), A.sliding(size * HOUR, slide * HOUR)
    money = F.col("cents") / 7.0
    measures = [W.count(), W.total("part", money), W.average("mean", money), W.value_of_largest("dearest", F.col("event_id"), F.col("cents"))]
    got, _ = run(spark, path, df.schema, strategy, assigner, measures=measures, combine=combine)
    want = W.window_firings(keyed(df), strategy, assigner, measures).where("fired_at is not null")
    names = ["k", "window_start", "window_end", "elements", "wm", "dearest", "part", "mean"]
    own, other = [sorted(tuple(r) for r in d.select(*names).collect()) for d in (got.where("tag = 'firing'"), want)]
    assert [r[:6] for r in own] == [r[:6] for r in other] and len(own) > 10
    assert all(a[6:] == pytest.approx(b[6:], rel=1e-9) for a, b in zip(own, other))
    late = got.where("tag = 'late'").agg(F.sum("elements")).first()[0] or 0
    assert late == W.late_rows(keyed(df), strategy, assigner).count()


def test_batches_are_refused(ticks):
    with pytest.raises(ValueError, match="window_firings"):
        SW.stream_windows(keyed(ticks[1]), S.bounded(1000), A.tumbling(HOUR))


def test_restart_continues(spark, ticks):
    path, df = ticks
    strategy, assigner = S.bounded(1000).every_tick(TICK), A.tumbling(6 * HOUR)
    work = tempfile.mkdtemp(prefix="keyclock-restart-")

    def start(**trigger):
        src = read_replay(spark, path + "/*", schema=df.schema, streaming=True, files_per_batch=1)
        return start_sink(SW.stream_windows(keyed(src), strategy, assigner), work + "/cp", path=work + "/out", trigger=trigger)

    q = start(processingTime="0 seconds")
    while (q.lastProgress or {"batchId": 0})["batchId"] < 2:
        q.awaitTermination(1)
    q.stop()
    start(availableNow=True).awaitTermination()
    got = spark.read.parquet(work + "/out").where("tag = 'firing'").drop("tag").unionByName(
        SW.open_windows(spark, work + "/cp", ("k",)).drop("tag"), allowMissingColumns=True)
    assert firings(got) == firings(W.window_firings(keyed(df), strategy, assigner))


def test_sessions_stream_equals_batch(spark, ticks):
    from keyclock.operators.sessions import session_firings
    from keyclock.streaming.sessions import open_sessions, stream_sessions

    path, df = ticks
    strategy, gap, lateness = S.bounded(1000), 2 * HOUR, HOUR
    measures = [W.count(), W.total("cents", F.col("cents")), W.average("mean", F.col("cents")), W.value_of_smallest("cheapest", F.col("event_id"), F.col("cents"))]
    src = read_replay(spark, path + "/*", schema=df.schema, streaming=True, files_per_batch=1)
    work = tempfile.mkdtemp(prefix="keyclock-sess-")
    start_sink(stream_sessions(keyed(src), strategy, gap, lateness, measures), work + "/cp", path=work + "/out").awaitTermination()
    got = spark.read.parquet(work + "/out")
    shape = ["k", "window_start", "window_end", "elements", "wm", "cents", "mean", "cheapest"]
    first = got.where("tag = 'firing'").select(*shape).unionByName(open_sessions(spark, work + "/cp", ("k",), measures).select(*shape))
    want = session_firings(keyed(df), strategy, gap, lateness, measures=measures)
    bag = lambda d: sorted(tuple(r) for r in d.select(*shape).collect())
    assert bag(first) == bag(want.where("not refired"))
    assert bag(got.where("tag = 'refiring'")) == bag(want.where("refired"))
    late = session_firings(keyed(df), strategy, gap, lateness, late=True)
    assert {r[0] for r in got.where("tag = 'late'").select("tie").collect()} == {r["tie"] for r in late.collect()}


def restarted(spark, make, path, schema, work):
    """The query stopped after some batches and started again."""

    def start(**trigger):
        src = read_replay(spark, path + "/*", schema=schema, streaming=True, files_per_batch=1)
        return start_sink(make(src), work + "/cp", path=work + "/out", trigger=trigger)

    q = start(processingTime="0 seconds")
    while (q.lastProgress or {"batchId": 0})["batchId"] < 2:
        q.awaitTermination(1)
    q.stop()
    start(availableNow=True).awaitTermination()
    return spark.read.parquet(work + "/out")


@pytest.mark.parametrize("size,slide", [(10, None), (12, 5)])
def test_count_windows_over_restarts_equal_batch(spark, ticks, size, slide):
    from keyclock.operators.counts import sliding_count_windows
    from keyclock.streaming.counts import stream_count_windows

    path, df = ticks
    measures = [W.total("cents", F.col("cents")), W.average("mean", F.col("cents")), W.value_of_largest("dearest", F.col("event_id"), F.col("cents"))]
    work = tempfile.mkdtemp(prefix="keyclock-count-")
    got = restarted(spark, lambda src: stream_count_windows(keyed(src), size, slide, measures), path, df.schema, work)
    want = sliding_count_windows(keyed(df), size, slide or size, *measures)
    bag = lambda d: sorted(tuple(r) for r in d.select("k", "window_no", "elements", "cents", "mean", "dearest").collect())
    assert bag(got) == bag(want) and want.count() > 20


def test_count_windows_with_gaps_between(spark, ticks):
    from keyclock.operators.counts import sliding_count_windows
    from keyclock.streaming.counts import stream_count_windows

    path, df = ticks
    work = tempfile.mkdtemp(prefix="keyclock-count-")
    src = read_replay(spark, path + "/*", schema=df.schema, streaming=True, files_per_batch=2)
    start_sink(stream_count_windows(keyed(src), 4, 9, [W.total("cents", F.col("cents"))]), work + "/cp", path=work + "/out").awaitTermination()
    bag = lambda d: sorted(tuple(r) for r in d.select("k", "window_no", "elements", "cents").collect())
    assert bag(spark.read.parquet(work + "/out")) == bag(sliding_count_windows(keyed(df), 4, 9, W.total("cents", F.col("cents"))))
    with pytest.raises(ValueError, match="batch"):
        stream_count_windows(keyed(df), 4)


class LatestThird:
    """A clock of one's own with state: the largest time of every third row."""

    def __init__(self):
        self.rows, self.top = 0, None

    def on_event(self, row, key, ts, out):
        self.rows += 1
        if self.rows % 3 == 0:
            self.top = ts if self.top is None else max(self.top, ts)

    def on_periodic_emit(self, out):
        if self.top is not None:
            out.emit(self.top - 1)


@pytest.mark.parametrize("tick", [False, True])
def test_generator_class_over_restarts_equals_batch(spark, ticks, tick):
    path, df = ticks
    strategy, assigner = S.generator(LatestThird), A.tumbling(6 * HOUR)
    strategy = strategy.every_tick(TICK) if tick else strategy
    work = tempfile.mkdtemp(prefix="keyclock-gen-")
    got = restarted(spark, lambda src: SW.stream_windows(keyed(src), strategy, assigner, lateness_ms=0), path, df.schema, work)
    both = got.where("tag = 'firing'").drop("tag").unionByName(SW.open_windows(spark, work + "/cp", ("k",)).drop("tag"), allowMissingColumns=True)
    assert firings(both) == firings(W.window_firings(keyed(df), strategy, assigner))
    late = {r[0] for r in got.where("tag = 'late'").select("tie").collect()}
    assert late == {r[0] for r in W.late_rows(keyed(df), strategy, assigner).select("event_id").collect()} != set()


@pytest.mark.parametrize("tick,lateness,combine", [(True, 0, True), (False, 3 * HOUR, False)])
def test_own_aggregate_stream_equals_batch(spark, ticks, tick, lateness, combine):
    from keyclock.operators.aggregates import aggregate_firings
    from keyclock.plans.catalog import Scatter

    path, df = ticks
    strategy, assigner = S.bounded(1000), A.sliding(12 * HOUR, 6 * HOUR)
    strategy = strategy.every_tick(TICK) if tick else strategy
    src = read_replay(spark, path + "/*", schema=df.schema, streaming=True, files_per_batch=1)
    work = tempfile.mkdtemp(prefix="keyclock-own-")
    out = SW.stream_aggregates(keyed(src), strategy, assigner, Scatter(), lateness, combine)
    start_sink(out.drop("tie", "ts"), work + "/cp", path=work + "/out").awaitTermination()
    got = spark.read.parquet(work + "/out").where("tag = 'firing'")
    want = aggregate_firings(keyed(df), strategy, assigner, Scatter(), lateness).where("fired_at is not null")
    names = ["k", "window_start", "window_end", "firing_no", "scatter", "wm"]
    bag = lambda d: sorted(tuple(r) for r in d.select(*names).collect())
    assert bag(got) == bag(want) and want.count() > 20


def test_a_batch_touches_due_windows_only(spark, ticks):
    """Many windows are open; a batch reads and writes those of its rows and those the clock reaches."""
    from pyspark.sql import Row
    from pyspark.sql import types as T

    reads, writes, drops = [], [], []

    class Value:
        def __init__(self):
            self.v = None

        def exists(self):
            return self.v is not None

        def get(self):
            return self.v

        def update(self, v):
            self.v = v

    class Map:
        def __init__(self):
            self.m = {}

        def getValue(self, k):
            reads.append(k)
            return self.m[k]

        def updateValue(self, k, v):
            writes.append(k)
            self.m[k] = v

        def removeKey(self, k):
            drops.append(k)
            del self.m[k]

    class Handle:
        def getValueState(self, *a):
            return Value()

        def getMapState(self, *a):
            return Map()

    names = ["k", "tag", "window_start", "window_end", "firing_no", "elements", "wm", "fired_at", "tie", "ts"]
    out = T.StructType([T.StructField(n, T.LongType()) for n in names])
    p = SW.KeyClockProcessor(SW.WindowSpec(("k",), (), (), 0, False), out)
    p.init(Handle())

    def row(ts, at):
        return Row(cand=ts - 5001, ts=ts, at=at, tie=at, n=1, wins=[{"window_start": ts // 10 * 10, "window_end": ts // 10 * 10 + 10}])

    # 500 windows open, none of them due
    list(p.handleInputRows((1,), iter([row(5000 - 10 * i, i) for i in range(500)]), None))
    assert len(p._panes.m) == 500 and not reads
    for log in (reads, writes, drops):
        log.clear()
    fired = list(p.handleInputRows((1,), iter([row(5031, 600)]), None))
    assert {(r["window_start"], r["window_end"]) for r in fired} == {(10, 20), (20, 30)} or len(fired) <= 3
    assert len(reads) == len(fired) == len(drops) and writes == [(5030, 5040)]
    assert len(p._panes.m) == 500 - len(fired) + 1


def test_pairs_of_streams_under_key_clocks_equal_batch(spark, ticks):
    from keyclock.operators.joins import interval_join
    from keyclock.streaming.joins import stream_pairs

    path, df = ticks
    work = tempfile.mkdtemp(prefix="keyclock-pairs-")
    side = lambda d, n: keyed(d.where(f"event_id % 2 = {n}"))

    def make(src):
        other = read_replay(spark, path + "/*", schema=df.schema, streaming=True, files_per_batch=1)
        return stream_pairs(side(src, 0), side(other, 1), -3 * HOUR, 2 * HOUR, S.bounded(1000), upper_exclusive=True)

    got = restarted(spark, make, path, df.schema, work)
    want = interval_join(side(df, 0), side(df, 1), -3 * HOUR, 2 * HOUR, strategy=S.bounded(1000), upper_exclusive=True)
    pairs = lambda d: sorted((r["left"]["event_id"], r["right"]["event_id"]) for r in d.collect())
    assert pairs(got.where("tag = 'pair'")) == pairs(want.joined) and want.joined.count() > 20
    for name, late in (("left", want.late_left), ("right", want.late_right)):
        ids = sorted(r[name]["event_id"] for r in got.where(f"tag = 'late_{name}'").collect())
        assert ids == sorted(r["event_id"] for r in late.collect()) and ids
    # what no partner can reach any more has left the state
    state = spark.read.format("statestore").option("path", work + "/cp").option("stateVarName", "left_rows").load()
    assert 0 < state.count() < 20 * 3


def test_process_function_stream_equals_batch(spark, ticks):
    from pyspark.sql import types as T

    from keyclock.plans.catalog import DayReport
    from keyclock.streaming.process import process_keyed, process_stream

    path, df = ticks
    shape = T.StructType([T.StructField(n, T.LongType()) for n in ("user_id", "day_end", "seen", "wm")])
    src = read_replay(spark, path + "/*", schema=df.schema, streaming=True, files_per_batch=2)
    work = tempfile.mkdtemp(prefix="keyclock-proc-")
    out = process_stream(keyed(src), S.bounded(1000), DayReport(), shape)
    start_sink(out, work + "/cp", path=work + "/out").awaitTermination()
    got = sorted(tuple(r) for r in spark.read.parquet(work + "/out").drop("tag").collect())
    want = process_keyed(keyed(df), S.bounded(1000), DayReport(), shape).drop("tag")
    # the stream has no end of input, so timers after the last clock step stay pending
    assert got == sorted(tuple(r) for r in want.where(f"wm < {2**63 - 1}").collect())
    assert len(got) > 20


def test_rolling_reduce_function(spark, ticks):
    from pyspark.sql import types as T

    from keyclock.operators.rolling import rolling
    from keyclock.streaming.process import RollingReduce, process_keyed

    _, df = ticks
    add = RollingReduce(lambda acc, row: {"event_id": row["event_id"], "cents": acc["cents"] + row["cents"]}, ["event_id", "cents"])
    shape = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("cents", T.LongType())])
    got = {(r["event_id"], r["cents"]) for r in process_keyed(keyed(df), S.none(), add, shape).collect()}
    assert got == {(r["event_id"], r["running"]) for r in rolling(keyed(df), "sum", "cents").collect()}


def test_idle_and_active_by_processing_time(spark):
    import time

    from keyclock.streaming.queries import idle_stream

    src = tempfile.mkdtemp(prefix="keyclock-idle-")
    work = tempfile.mkdtemp(prefix="keyclock-idleq-")

    def put(name, rows):
        spark.createDataFrame(rows, "id long, k string, t long").coalesce(1).write.mode("append").parquet(src + "/" + name)

    put("a", [(1, "x", 1), (2, "y", 2)])
    stream = spark.readStream.schema("id long, k string, t long").option("recursiveFileLookup", True).parquet(src)
    ks = key_by(stream, "k", ts="t", tie="id")
    q = start_sink(idle_stream(ks, 1500), work + "/cp", fmt="memory", name="idle_rows", trigger={"processingTime": "300 milliseconds"})
    try:
        def seen():
            return [(r["k"], r["status"]) for r in spark.table("idle_rows").orderBy("at").collect()]

        end = time.time() + 60
        while time.time() < end and len(seen()) < 2:
            time.sleep(0.5)
        assert sorted(seen()) == [("x", "idle"), ("y", "idle")]
        put("b", [(3, "x", 3)])
        end = time.time() + 60
        while time.time() < end and len(seen()) < 4:
            time.sleep(0.5)
        assert [s for k, s in seen() if k == "x"] == ["idle", "active", "idle"]
        assert [s for k, s in seen() if k == "y"] == ["idle"]
    finally:
        q.stop()


def test_spark_native_streams(spark, ticks):
    from keyclock.operators.joins import interval_join
    from keyclock.operators.rolling import latest_state
    from keyclock.streaming import queries as Q

    path, df = ticks
    read = lambda: keyed(read_replay(spark, path + "/*", schema=df.schema, streaming=True, files_per_batch=3))
    work = tempfile.mkdtemp(prefix="keyclock-native-")
    a, b = read(), read()
    a, b = a.with_df(a.df.where("event_id % 2 = 0")), b.with_df(b.df.where("event_id % 2 = 1"))
    joined = Q.stream_interval_join(a, b, -HOUR, HOUR, 100 * 24 * HOUR)
    start_sink(joined, work + "/cp1", path=work + "/out1").awaitTermination()
    pairs = lambda d: sorted((r["left"]["event_id"], r["right"]["event_id"]) for r in d.collect())
    l, r = keyed(df.where("event_id % 2 = 0")), keyed(df.where("event_id % 2 = 1"))
    assert pairs(spark.read.parquet(work + "/out1")) == pairs(interval_join(l, r, -HOUR, HOUR).joined)

    start_sink(Q.latest_stream(read(), "event_id", "t_ms"), work + "/cp2", fmt="memory", name="latest_rows", mode="complete").awaitTermination()
    bag = lambda d: sorted(tuple(x) for x in d.select("k", "event_id", "t_ms").collect())
    assert bag(spark.table("latest_rows")) == bag(latest_state(keyed(df), "event_id", "t_ms"))

    base = Q.stream_level_windows(read(), 100 * 24 * HOUR, 6 * HOUR)
    start_sink(base, work + "/cp3", fmt="memory", name="base_rows", mode="complete").awaitTermination()
    assert spark.table("base_rows").agg(F.sum("elements")).first()[0] == df.count()

    now = Q.stream_arrival_windows(read(), HOUR)
    start_sink(now, work + "/cp4", fmt="memory", name="now_rows", mode="complete").awaitTermination()
    assert spark.table("now_rows").agg(F.sum("elements")).first()[0] == df.count()


@pytest.mark.parametrize("kind", ["event", "event_purging", "count", "count_purging"])
def test_trigger_classes_equal_declared_triggers(spark, ticks, kind):
    from pyspark.sql import types as T

    from keyclock.operators.counts import count_triggered
    from keyclock.streaming import triggers as X
    from keyclock.streaming.process import process_keyed

    _, df = ticks
    strategy, lateness, day = S.bounded(1000), 3 * HOUR, 24 * HOUR
    inner = X.CountTrigger(4) if kind.startswith("count") else X.EventTimeTrigger()
    trigger = X.PurgingTrigger(inner) if kind.endswith("purging") else inner
    run = X.TriggeredWindows(
        lambda t: [(t - t % day, t - t % day + day)], trigger, lambda acc, row: (acc or 0) + 1,
        lambda acc, ctx: {"k": ctx.key[0], "window_start": ctx.window[0], "elements": acc}, "t_ms", lateness, lambda row: {"k": row["k"]})
    shape = T.StructType([T.StructField(n, T.LongType()) for n in ("k", "window_start", "elements")])
    out = process_keyed(keyed(df), strategy, run, shape)
    bag = lambda d: sorted(tuple(r) for r in d.select("k", "window_start", "elements").collect())
    if kind.startswith("count"):
        want = count_triggered(keyed(df), strategy, A.tumbling(day), 4, lateness_ms=lateness, purging=kind.endswith("purging"))
    else:
        want = W.window_firings(keyed(df), strategy, A.tumbling(day), lateness_ms=lateness, purging=kind.endswith("purging"))
    assert bag(out.where("tag is null")) == bag(want)
    assert out.where("tag = 'late'").count() == W.late_rows(keyed(df), strategy, A.tumbling(day), lateness).count()


@pytest.mark.parametrize("lateness", [0, 2 * HOUR])
def test_sessions_with_a_trigger_equal_declared_ones(spark, ticks, lateness):
    from pyspark.sql import types as T

    from keyclock.operators.sessions import session_firings
    from keyclock.streaming import triggers as X
    from keyclock.streaming.process import process_keyed

    _, df = ticks
    gap, strategy = 2 * HOUR, S.bounded(1000)
    run = X.TriggeredSessions(
        gap, X.EventTimeTrigger(), lambda acc, row: (acc or 0) + 1, lambda a, b: a + b,
        lambda acc, ctx: {"k": ctx.key[0], "window_start": ctx.window[0], "window_end": ctx.window[1], "elements": acc, "wm": ctx.current_watermark},
        "t_ms", lateness, lambda row: {"k": row["k"]})
    shape = T.StructType([T.StructField(n, T.LongType()) for n in ("k", "window_start", "window_end", "elements", "wm")])
    out = process_keyed(keyed(df), strategy, run, shape)
    want = session_firings(keyed(df), strategy, gap, lateness)
    bag = lambda d: sorted(tuple(r) for r in d.select("k", "window_start", "window_end", "elements", "wm").collect())
    assert bag(out.where("tag is null")) == bag(want)
    assert out.where("tag = 'late'").count() == session_firings(keyed(df), strategy, gap, lateness, late=True).count()


def test_count_trigger_adds_up_merged_sessions(spark):
    from pyspark.sql import types as T

    from keyclock.streaming import triggers as X
    from keyclock.streaming.process import process_keyed

    rows = [(1, "a", 0), (2, "a", 100), (3, "a", 5), (4, "a", 105), (5, "a", 50), (6, "a", 20), (7, "a", 60), (8, "a", 80)]
    df = spark.createDataFrame(rows, "id long, k string, t long").withColumn("at", F.col("id"))
    ks = key_by(df, "k", ts="t", arrival="at", tie="id")
    run = X.TriggeredSessions(30, X.CountTrigger(5), lambda acc, row: [*(acc or []), row["id"]], lambda a, b: sorted(a + b),
                              lambda acc, ctx: {"start": ctx.window[0], "end": ctx.window[1], "ids": len(acc)}, "t")
    shape = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "end", "ids")])
    got = process_keyed(ks, S.bounded(1000), run, shape).collect()
    # 20 bridges two sessions, whose three rows count; 60 is the fifth; 80 bridges what has fired and two others
    assert [(r["start"], r["end"], r["ids"]) for r in got] == [(0, 90, 5)]
    with pytest.raises(Exception, match="cannot merge"):
        bad = X.TriggeredSessions(30, X.Trigger(), lambda acc, row: 1, lambda a, b: 1, lambda acc, ctx: {}, "t")
        process_keyed(ks, S.bounded(1000), bad, shape).collect()


def test_one_processing_timer_stands_for_all_windows(spark):
    """Windows ask for timers of the machine's clock; the stream holds only the earliest."""
    import time

    from pyspark.sql import types as T

    from keyclock.streaming import triggers as X
    from keyclock.streaming.process import process_stream

    path, work = tempfile.mkdtemp(prefix="keyclock-ptime-"), tempfile.mkdtemp(prefix="keyclock-ptimecp-")
    rows = [(i, "x" if i % 2 else "y", i * 50) for i in range(12)]
    spark.createDataFrame(rows, "id long, k string, t long").coalesce(1).write.parquet(path + "/a")
    src = spark.readStream.schema("id long, k string, t long").parquet(path + "/*").withColumn("at", F.col("id"))
    ks = key_by(src, "k", ts="t", arrival="at", tie="id")
    run = X.TriggeredWindows(lambda t: [(t - t % 100, t - t % 100 + 100)], X.ProcessingTimeTrigger(1500), lambda acc, row: (acc or 0) + 1,
                             lambda acc, ctx: {"k": ctx.key[0], "window_start": ctx.window[0], "elements": acc}, "t")
    shape = T.StructType([T.StructField("k", T.StringType()), T.StructField("window_start", T.LongType()), T.StructField("elements", T.LongType())])
    q = start_sink(process_stream(ks, S.bounded(10_000), run, shape, processing_timers=True), work + "/cp", fmt="memory", name="ptime_rows", trigger={"processingTime": "300 milliseconds"})
    try:
        end = time.time() + 60
        while time.time() < end and spark.table("ptime_rows").count() < 12:
            time.sleep(0.5)
        got = sorted(tuple(r) for r in spark.table("ptime_rows").select("k", "window_start", "elements").collect())
        assert got == sorted(("x" if i % 2 else "y", i * 50 - i * 50 % 100, 1) for i in range(12))
    finally:
        q.stop()


def test_sessions_of_a_silent_key_expire(spark):
    """With expiry a key that comes back after a silence starts anew: its old session is gone."""
    import time

    from keyclock.streaming.sessions import stream_sessions

    path, work = tempfile.mkdtemp(prefix="keyclock-ttl-"), tempfile.mkdtemp(prefix="keyclock-ttlcp-")

    def put(name, rows):
        spark.createDataFrame(rows, "id long, k string, t long").coalesce(1).write.parquet(f"{path}/{name}")

    put("a", [(1, "x", 0), (2, "x", 5)])
    src = spark.readStream.schema("id long, k string, t long").parquet(path + "/*").withColumn("at", F.col("id"))
    ks = key_by(src, "k", ts="t", arrival="at", tie="id")
    out = stream_sessions(ks, S.bounded(0), 100, measures=[W.count()], state_ttl_ms=4000)
    q = start_sink(out, work + "/cp", fmt="memory", name="ttl_rows", trigger={"processingTime": "500 milliseconds"})
    try:
        end = time.time() + 60
        while time.time() < end and not any(p["numInputRows"] for p in q.recentProgress):
            time.sleep(0.5)
        time.sleep(8)
        put("b", [(3, "x", 50), (4, "x", 1000)])
        end = time.time() + 60
        while time.time() < end and not spark.table("ttl_rows").count():
            time.sleep(0.5)
        assert [tuple(r) for r in spark.table("ttl_rows").select("window_start", "window_end", "elements").collect()] == [(50, 150, 1)]
    finally:
        q.stop()
