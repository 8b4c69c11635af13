"""Hand-made rows at the edges of the rules, argument checks, key types, hot keys, time units."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyclock.functions import assigners as A
from keyclock.functions.timeunits import MAX_WM, MIN_WM, epoch_ms
from keyclock.model import key_by
from keyclock.operators import counts, joins, multisource, rolling, sessions, watermark
from keyclock.operators import windows as W
from keyclock.operators.scan import Fold
from keyclock.plans.scenarios import HOUR, replay
from keyclock.sources.replay import SideOutputs
from keyclock.strategy import WatermarkStrategy as S
from tests import simulator as sim


def stream(spark, rows, key_type="string", **kw):
    """rows: (key, ts), arrival = position."""
    data = [(i, k, t, i) for i, (k, t) in enumerate(rows)]
    df = spark.createDataFrame(data, f"id long, k {key_type}, t long, at long")
    return key_by(df, "k", ts="t", arrival="at", tie="id", bucket_ms=kw.pop("bucket_ms", 2), **kw)


def fired(df):
    return {(r["k"], r["window_start"], r["elements"], r["wm"]) for r in df.collect()}


def late_ids(*args):
    return {r["id"] for r in W.late_rows(*args).collect()}


def test_clock_exactly_at_the_last_instant(spark):
    # bound 0: row at 10 makes the clock 9 = end - 1, so window [0, 10) fires and a later row for it is late
    ks = stream(spark, [("a", 5), ("a", 10), ("a", 9), ("a", 10)])
    assert fired(W.window_firings(ks, S.bounded(0), A.tumbling(10))) == {("a", 0, 1, 9), ("a", 10, 2, MAX_WM)}
    assert late_ids(ks, S.bounded(0), A.tumbling(10)) == {2}


def test_clock_one_before_the_last_instant(spark):
    ks = stream(spark, [("a", 5), ("a", 10), ("a", 9)])
    assert fired(W.window_firings(ks, S.bounded(1), A.tumbling(10))) == {("a", 0, 2, MAX_WM), ("a", 10, 1, MAX_WM)}
    assert late_ids(ks, S.bounded(1), A.tumbling(10)) == set()


def test_negative_times(spark):
    ks = stream(spark, [("a", -15), ("a", -1), ("a", -12), ("a", 4)])
    assert fired(W.window_firings(ks, S.bounded(0), A.tumbling(10))) == {("a", -20, 1, -2), ("a", -10, 1, 3), ("a", 0, 1, MAX_WM)}
    assert late_ids(ks, S.bounded(0), A.tumbling(10)) == {2}


def test_null_key_is_a_group_and_null_time_is_invalid(spark):
    ks = stream(spark, [(None, 5), ("a", 5), (None, 25), ("a", None), (None, 6)])
    got = fired(W.window_firings(ks, S.bounded(0), A.tumbling(10)))
    assert got == {(None, 0, 1, 24), ("a", 0, 1, MAX_WM), (None, 20, 1, MAX_WM)}
    assert late_ids(ks, S.bounded(0), A.tumbling(10)) == {4}
    assert [r["id"] for r in ks.invalid().collect()] == [3]


def test_empty_input(spark):
    ks = stream(spark, [("a", 1)])
    ks = ks.with_df(ks.df.where("false"))
    assert W.window_firings(ks, S.bounded(0), A.tumbling(10), lateness_ms=5).count() == 0
    assert sessions.session_firings(ks, S.bounded(0), 5).count() == 0


def test_lateness_near_the_largest_number(spark):
    ks = stream(spark, [("a", 5), ("a", 500), ("a", 6)])
    got = W.window_firings(ks, S.bounded(0), A.tumbling(10), lateness_ms=MAX_WM)
    assert {(r["window_start"], r["firing_no"], r["elements"]) for r in got.collect()} == {(0, 1, 1), (0, 2, 2), (500, 1, 1)}
    assert late_ids(ks, S.bounded(0), A.tumbling(10), MAX_WM) == set()


def test_smallest_key_flushes_nothing(spark):
    ks = stream(spark, [(MIN_WM, 50), (1, 5), (1, 7)], "long")
    assert fired(W.window_firings(ks, S.bounded(0), A.tumbling(10))) == {(MIN_WM, 50, 1, MAX_WM), (1, 0, 2, MAX_WM)}


@pytest.mark.parametrize("key_type,keys", [("double", [1.5, 2.5]), ("struct<x:int,y:string>", [(1, "a"), (2, "b")]), ("date", [dt.date(2024, 1, 1), dt.date(2024, 1, 2)])])
def test_key_types(spark, key_type, keys):
    ks = stream(spark, [(keys[0], 5), (keys[1], 500), (keys[0], 6)], key_type)
    assert {(r["window_start"], r["elements"]) for r in W.window_firings(ks, S.bounded(0), A.tumbling(10)).collect()} == {(0, 2), (500, 1)}


@pytest.mark.parametrize("key_type", ["array<int>", "map<int,int>", "struct<x:array<int>>"])
def test_refused_key_types(spark, key_type):
    df = spark.createDataFrame([], f"k {key_type}, t long, id long")
    with pytest.raises(ValueError, match="cannot be used as keys"):
        key_by(df, "k", ts="t", tie="id")


def test_argument_checks(spark):
    ks = stream(spark, [("a", 1)])
    for bad in (
        lambda: S.bounded(-1),
        lambda: S.bounded(0).with_idleness(0),
        lambda: S.bounded(0).every_tick(0),
        lambda: S.bounded(0).with_scope("table"),
        lambda: A.tumbling(0),
        lambda: A.sliding(5, 0),
        lambda: W.window_firings(ks, S.bounded(0), A.tumbling(5), lateness_ms=-1),
        lambda: W.window_firings(ks, S.bounded(0), A.processing_tumbling(5)),
        lambda: joins.interval_join(ks, ks, None, 5),
        lambda: joins.interval_join(ks, ks, 5, 1),
        lambda: joins.interval_join(ks, ks, 0, 1, event_time=False),
        lambda: counts.count_windows(ks, 0),
        lambda: sessions.sessions(ks, 0),
        lambda: watermark.idleness_events(ks, 0),
        lambda: rolling.rolling(ks, "avg", "t"),
        lambda: key_by(ks.df, ts="t", tie="id"),
        lambda: multisource.alignment_report(ks, S.bounded(0), "k"),
    ):
        with pytest.raises(ValueError):
            bad()


def test_side_output_keeps_its_type(spark):
    df = spark.createDataFrame([("late", 1), ("other", 2)], "tag string, x long")
    sides = SideOutputs(df)
    assert [tuple(r) for r in sides.get("late").collect()] == [(1,)]
    from pyspark.sql import types as T

    with pytest.raises(ValueError, match="another type"):
        sides.get("late", T.StructType([T.StructField("x", T.StringType())]))


def test_equal_arrivals_follow_the_tie(spark):
    df = spark.createDataFrame([(2, "a", 9, 0), (1, "a", 10, 0)], "id long, k string, t long, at long")
    ks = key_by(df, "k", ts="t", arrival="at", tie="id")
    assert late_ids(ks, S.bounded(0), A.tumbling(10)) == {2}


def test_event_time_does_not_depend_on_the_session_zone(spark):
    df = spark.sql("select timestamp_ntz'2024-03-10 02:30:00.123456' a, timestamp_ntz'1969-12-31 23:59:59.9995' b, date'2024-03-10' c")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for z in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", z)
            row = df.select(*[epoch_ms(F.col(c), df.schema[c].dataType) for c in "abc"]).first()
            assert tuple(row) == (1710037800123, -1, 1710028800000)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_whole_numbers_next_to_nulls_stay_exact(spark):
    big = 2**53
    rows = [(1, big, 10), (2, big + 1, 20), (3, None, 30), (4, big + 1, 40)]
    df = spark.createDataFrame(rows, "id long, k long, t long").withColumn("payload", F.when(F.col("id") != 3, F.col("id") + big + 1))
    ks = key_by(df, "k", ts="t", tie="id")
    fired = sessions.session_firings(ks, S.bounded(0), 100).collect()
    assert sorted(((r.k or 0), r.elements) for r in fired) == [(0, 1), (big, 1), (big + 1, 2)]

    def ids(window, rows):
        for r in rows:
            yield {"k": window["k"], "payload": r["payload"]}

    shape = T.StructType([T.StructField("k", T.LongType()), T.StructField("payload", T.LongType())])
    got = W.window_process(ks, S.bounded(0), A.tumbling(100), ids, shape).collect()
    assert sorted((r.k or 0, r.payload or 0) for r in got) == [(0, 0), (big, big + 2), (big + 1, big + 3), (big + 1, big + 5)]


def test_purging_keeps_what_the_inner_trigger_purges():
    from keyclock.streaming.triggers import CONTINUE, FIRE, FIRE_AND_PURGE, PURGE, PurgingTrigger, Trigger

    class Fixed(Trigger):
        def __init__(self, decision):
            self.decision = decision

        def on_element(self, row, ctx):
            return self.decision

    got = [PurgingTrigger(Fixed(d)).on_element({}, None) for d in (CONTINUE, FIRE, PURGE, FIRE_AND_PURGE)]
    assert got == [CONTINUE, FIRE_AND_PURGE, PURGE, FIRE_AND_PURGE]


@pytest.mark.parametrize("bucket_ms", [1, 7, 1000, 10**9])
def test_slices_do_not_change_results(spark, bucket_ms):
    rows = [("ab"[i % 2], (i * 37) % 101) for i in range(80)]
    ks = stream(spark, rows, bucket_ms=bucket_ms)
    want, late = sim.replay([(k, t, i, i) for i, (k, t) in enumerate(rows)], sim.sliding(20, 7), lambda t: t - 6, 9)
    got = W.window_firings(ks, S.bounded(5), A.sliding(20, 7), lateness_ms=9)
    assert {tuple(r) for r in got.select("k", "window_start", "window_end", "firing_no", "elements", "wm", "fired_at").collect()} == set(want)
    assert late_ids(ks, S.bounded(5), A.sliding(20, 7), 9) == set(late)


def test_properties(spark, sf_dir):
    ks = replay(spark, sf_dir, "median50")
    keyed = W.late_counts(ks, S.bounded(1000), A.tumbling(HOUR)).agg(F.sum("total"), F.sum("late"), F.sum("kept")).first()
    level = W.late_counts(ks, S.bounded(1000).with_scope("stream"), A.tumbling(HOUR)).agg(F.sum("kept")).first()
    assert keyed[1] + keyed[2] == keyed[0] == ks.df.count()
    assert keyed[2] >= level[0]
    steps = watermark.watermark_progress(ks, S.bounded(1000))
    assert steps.where("wm <= wm_before").count() == 0
    one = ks.with_df(ks.df.withColumn("k", F.lit(1).cast("bigint")))
    a, b = [W.window_firings(one, S.bounded(1000).with_scope(s), A.tumbling(HOUR)) for s in ("key", "stream")]
    assert sorted(map(str, a.select(sorted(a.columns)).collect())) == sorted(map(str, b.select(sorted(a.columns)).collect()))


def test_assigning_again_replaces_the_clock(spark):
    ks = stream(spark, [("a", 5), ("a", 10)])
    twice = watermark.assign_watermarks(ks.with_df(watermark.assign_watermarks(ks, S.bounded(3))), S.bounded(0))
    assert [(r["wm_before"], r["wm_after"]) for r in twice.orderBy("id").collect()] == [(MIN_WM, 4), (4, 9)]


def test_rolling_fold_with_nulls(spark):
    ks = stream(spark, [("a", 5), ("a", None), ("a", 3)], bucket_ms=1)
    got = rolling.rolling_reduce(ks, Fold("m", "max", F.col("t")), Fold("s", "sum", F.col("t"))).orderBy("id").collect()
    assert [(r["m"], r["s"]) for r in got] == [(5, 5), (5, 5), (5, 8)]


def test_fitted_slices(spark):
    flat = stream(spark, [("a", 0)] * 1000)
    assert flat.fitted().bucket_ms == 999 // 64
    assert flat.fitted(slice_rows=5).bucket_ms == 999 // 200
    # half of all rows arrive within one percent of the time
    df = flat.df.withColumn("at", F.when(F.col("id") < 500, F.col("id") * 100).otherwise(50_000 + F.col("id")))
    width = flat.with_df(df).fitted(slice_rows=50).bucket_ms
    densest = df.groupBy(F.expr(f"at div {width}")).count().agg(F.max("count")).first()[0]
    assert densest <= 2 * 50
    assert stream(spark, [("a", 1)]).fitted().bucket_ms > 0
