"""Overlapping windows put together from slices, slices under bursts, sessions by epochs, and aggregates with a merge of their own."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyclock.functions import assigners as A
from keyclock.model import key_by
from keyclock.operators import aggregates as G
from keyclock.operators import counts, sessions, watermark
from keyclock.operators import windows as W
from keyclock.plans.scenarios import HOUR, replay
from keyclock.strategy import WatermarkStrategy as S
from tests import simulator as sim

LONG = T.LongType()


def stream(spark, rows, **options):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, k string, t long, at long, v long")
    return key_by(df, "k", ts="t", arrival="at", tie="id", **options)


def rows_of(rnd, n, keys=("a", "b", None)):
    out = []
    for at in range(n):
        out.append((rnd.choice(keys), rnd.randint(-20, 400) + at // 3, at, rnd.randint(-5, 50)))
    return out


@pytest.mark.parametrize("size,slide,offset,lateness", [(20, 7, 0, 9), (21, 14, -4, 0), (64, 2, 0, 0), (12, 5, 1, 9)])
def test_sliding_firings_against_the_simulator(spark, size, slide, offset, lateness):
    rows = rows_of(random.Random(size + lateness), 300)
    ks = stream(spark, rows, bucket_ms=37)
    spans = lambda t: [(s + offset, e + offset) for s, e in sim.sliding(size, slide)(t - offset)]
    want, late = sim.replay([(k, t, at, i) for i, (k, t, at, _) in enumerate(rows)], spans, lambda t: t - 6, lateness)
    got = W.window_firings(ks, S.bounded(5), A.sliding(size, slide, offset), lateness_ms=lateness)
    assert Counter((r["k"], r["window_start"], r["window_end"], r["firing_no"], r["elements"], r["wm"], r["fired_at"]) for r in got.collect()) == Counter(want)
    # sums and extremes in the type of one level
    measures = [W.total("sum", F.col("v").cast("decimal(8,2)")), W.smallest("low", F.col("v")), W.value_of_largest("last", F.col("id"), F.col("t"))]
    one = W.window_firings(ks, S.bounded(5), A.sliding(size, slide, offset), measures)
    two = W.window_firings(ks, S.bounded(5), A.custom(lambda ts: A.sliding(size, slide, offset).windows(ts)), measures)
    assert one.schema["sum"].dataType == two.schema["sum"].dataType == T.DecimalType(18, 2)
    bag = lambda d: Counter(tuple(r) for r in d.select("k", "window_start", "window_end", "sum", "low", "last", "wm").collect())
    assert bag(one) == bag(two)


def test_tick_and_stream_clocks_of_overlapping_windows(spark):
    ks = stream(spark, rows_of(random.Random(5), 400), bucket_ms=50)
    listed = A.custom(lambda ts: A.sliding(40, 15).windows(ts))
    for strategy in (S.bounded(3).every_tick(25), S.bounded(3).with_scope("stream"), S.none()):
        bag = lambda a: Counter((r["k"], r["window_start"], r["elements"], r["wm"], r["fired_at"]) for r in W.window_firings(ks, strategy, a).collect())
        assert bag(A.sliding(40, 15)) == bag(listed)
    both = [W.window_aggregate(ks, A.sliding(40, 15), *aggs) for aggs in ([W.count(), W.average("m", F.col("v"))], [F.count("*").alias("elements"), F.avg("v").alias("m")])]
    first, second = [sorted(((r["k"] or "", r["window_start"], r["elements"], round(r["m"], 9)) for r in d.collect())) for d in both]
    assert first == second


@pytest.mark.parametrize("assigner", [A.tumbling(30), A.sliding(40, 15), A.sliding(10, 25), A.sliding(60, 3)])
def test_rows_count_their_windows(spark, assigner):
    ks = stream(spark, rows_of(random.Random(17), 200), bucket_ms=45)
    listed = A.custom(lambda ts: assigner.windows(ts))
    for lateness in (0, 7):
        status = W.classify_lateness(ks, S.bounded(4), listed, lateness).where("window_status <> 'late'")
        want = Counter(r["id"] for r in status.select("id").collect())
        got = {r["id"]: r["entered"] for r in W.entries(ks, S.bounded(4), assigner, lateness).collect()}
        assert len(got) == 200 and {i: n for i, n in got.items() if n} == dict(want)
        late = lambda a: sorted(r["id"] for r in W.late_rows(ks, S.bounded(4), a, lateness).select("id").collect())
        assert late(assigner) == late(listed) and (lateness or late(assigner))


def test_no_row_is_copied(spark):
    ks = stream(spark, [("a", t, t, 1) for t in range(1000)])
    plan = W.window_firings(ks, S.bounded(0), A.sliding(1000, 1))._jdf.queryExecution().executedPlan().toString()
    assert "__wins" not in plan
    partial = counts.sliding_count_windows(ks, 1000, 1, W.count("n"))._jdf.queryExecution().optimizedPlan().toString()
    # the rows are aggregated before anything is exploded
    assert partial.index("Generate") < partial.rindex("Aggregate")


@pytest.mark.parametrize("size,slide", [(10, 4), (6, 6), (3, 7)])
def test_sliding_count_windows(spark, size, slide):
    rows = rows_of(random.Random(slide), 157)
    ks = stream(spark, rows, bucket_ms=20)
    want = Counter()
    for key in ("a", "b", None):
        mine = [v for k, _, _, v in rows if k == key]
        for i, end in enumerate(range(slide, len(mine) + 1, slide)):
            part = mine[max(0, end - size) : end]
            want[key, i, len(part), sum(part), min(part), round(sum(part) / len(part), 9)] += 1
    measures = [W.total("s", F.col("v")), W.smallest("m", F.col("v")), W.average("a", F.col("v"))]
    got = counts.sliding_count_windows(ks, size, slide, *measures)
    assert Counter((r["k"], r["window_no"], r["elements"], r["s"], r["m"], round(r["a"], 9)) for r in got.collect()) == want
    columns = counts.sliding_count_windows(ks, size, slide, F.sum("v").alias("s"))
    assert Counter((r["k"], r["window_no"], r["elements"], r["s"]) for r in columns.collect()) == Counter({k[:4]: n for k, n in want.items()})
    with pytest.raises(ValueError, match="either"):
        counts.sliding_count_windows(ks, size, slide, W.count("n"), F.sum("v"))


# --- slices under bursts ------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("tie", ["id", "name"])
def test_ninety_percent_of_all_rows_in_one_millisecond(spark, tie):
    rows = [("a" if i % 3 else "b", i % 777, 500_000 if i % 10 else i * 10, i) for i in range(20_000)]
    df = stream(spark, rows).df.withColumn("name", F.concat(F.lit("n"), F.sha2(F.col("id").cast("string"), 256)))
    ks = key_by(df, "k", ts="t", arrival="at", tie=tie)
    target = 500
    fitted = ks.fitted(slice_rows=target)
    assert fitted.cuts
    sizes = [r["count"] for r in fitted.df.groupBy(fitted.bucket()).count().collect()]
    assert max(sizes) <= 2 * target and sum(sizes) == len(rows)
    # slices rise along (arrival, tie), and results do not depend on them
    order = fitted.df.select(fitted.bucket().alias("s"), "at", tie).orderBy("at", tie).collect()
    assert all(a["s"] <= b["s"] for a, b in zip(order, order[1:]))
    bag = lambda s: Counter(tuple(r) for r in watermark.assign_watermarks(s, S.bounded(3)).select("id", "wm_before").collect())
    assert bag(fitted) == bag(ks)
    bag = lambda s: Counter(tuple(r) for r in counts.count_windows(s, 10, F.sum("v").alias("x")).collect())
    assert bag(fitted) == bag(ks)


# --- sessions -----------------------------------------------------------------------------------------------------------


def test_a_hot_key_is_folded_in_many_epochs(spark):
    rnd = random.Random(3)
    rows, t = [], 0
    for at in range(600):
        t += rnd.choice([1, 2, 3, 60])
        rows.append(("hot", t - rnd.choice([0, 0, 5, 40]), at, rnd.randint(0, 9)))
    ks = stream(spark, rows, bucket_ms=100)
    for lateness in (0, 12):
        items = sessions.session_items(ks, S.bounded(4), 10, lateness, [W.count()])
        assert items.select("epoch").distinct().count() > 20
        got = sessions.session_firings(ks, S.bounded(4), 10, lateness).collect()
        first, again, late = sim.replay_sessions([(k, t, at, i) for i, (k, t, at, _) in enumerate(rows)], 10, 4, lateness)
        shape = lambda r: (r["k"], r["window_start"], r["window_end"], r["elements"], r["wm"])
        assert Counter(shape(r) for r in got if not r["refired"]) == Counter(first)
        assert Counter(shape(r) for r in got if r["refired"]) == Counter(again)
        refused = sessions.session_firings(ks, S.bounded(4), 10, lateness, late=True)
        assert Counter(r["tie"] for r in refused.collect()) == Counter(late)


def test_measures_of_sessions_with_any_clock(spark):
    ks = stream(spark, rows_of(random.Random(7), 300), bucket_ms=60)
    measures = [W.count(), W.total("s", F.col("v")), W.average("m", F.col("v")), W.value_of_smallest("c", F.col("id"), F.col("v"))]
    for strategy in (S.bounded(5), S.generator(F.when(F.col("v") % 3 == 0, F.col("t") + 30)), S.bounded(5).every_tick(20)):
        rows = sessions.session_firings(ks, strategy, 6, 4, measures=measures).collect()
        plain = sessions.session_firings(ks, strategy, 6, 4).collect()
        shape = lambda r: (r["k"], r["window_start"], r["window_end"], r["elements"], r["wm"], r["refired"])
        assert Counter(map(shape, rows)) == Counter(map(shape, plain)) and rows
        assert all(abs(r["m"] * r["elements"] - r["s"]) < 1e-6 for r in rows)
    none = sessions.session_firings(ks, S.none(), 6, measures=measures)
    batch = sessions.sessions(ks, 6, measures)
    bag = lambda d: Counter(tuple(r) for r in d.select("k", "window_start", "window_end", "elements", "s", "m", "c").collect())
    assert bag(none) == bag(batch)
    assert sessions.session_firings(ks, S.none(), 6, late=True).collect() == []


# --- aggregates with a merge function -----------------------------------------------------------------------------------


class Least(G.Aggregate):
    """The two least values, and how many there were."""

    def __init__(self):
        super().__init__(T.StructType([T.StructField("n", LONG), T.StructField("low", T.ArrayType(LONG))]), T.StructType([T.StructField("elements", LONG), T.StructField("second", LONG)]))

    def add(self, acc, row):
        return {"n": (acc["n"] if acc else 0) + 1, "low": sorted([*(acc["low"] if acc else []), row["v"]])[:2]}

    def merge(self, a, b):
        return {"n": a["n"] + b["n"], "low": sorted([*a["low"], *b["low"]])[:2]}

    def result(self, acc):
        return {"elements": acc["n"], "second": acc["low"][1] if len(acc["low"]) > 1 else None}


@pytest.mark.parametrize("assigner,lateness,purging", [
    (A.tumbling(30), 12, False), (A.sliding(40, 15), 0, False), (A.sliding(40, 15), 12, True), (A.sliding(10, 25), 0, False),
    (A.custom(lambda ts: A.sliding(40, 15).windows(ts)), 12, False),
])
def test_own_aggregate_fires_like_measures(spark, assigner, lateness, purging):
    ks = stream(spark, rows_of(random.Random(11), 260), bucket_ms=45)
    got = G.aggregate_firings(ks, S.bounded(5), assigner, Least(), lateness, purging)
    want = W.window_firings(ks, S.bounded(5), assigner, [W.count()], lateness, purging)
    names = ["k", "window_start", "window_end", "firing_no", "elements", "wm", "fired_at", "result_ts"]
    bag = lambda d: Counter(tuple(r) for r in d.select(*names).collect())
    assert bag(got) == bag(want)
    if lateness == 0:
        contents = {}
        for r in W.pane_rows(ks, S.bounded(5), assigner).collect():
            contents.setdefault((r["k"], r["window_start"], r["window_end"]), []).append(r["v"])
        for r in got.collect():
            low = sorted(contents[r["k"], r["window_start"], r["window_end"]])[:2]
            assert r["second"] == (low[1] if len(low) > 1 else None)


def test_a_reduce_function_and_a_hot_window(spark, monkeypatch):
    monkeypatch.setattr(G, "HELD", 3)
    rows = [("hot", t % 30, t, t) for t in range(3000)] + [("k%d" % i, 5, i, i) for i in range(50)]
    ks = stream(spark, rows)
    largest = G.Reduce(lambda a, b: max(a, b, key=lambda x: x["v"]), T.StructType([T.StructField("v", LONG), T.StructField("id", LONG)]))
    got = {(r["k"], r["window_start"]): (r["v"], r["id"]) for r in G.aggregate_firings(ks, S.none(), A.tumbling(30), largest).collect()}
    assert got["hot", 0] == (2999, 2999) and got["k7", 0] == (7, 3007) and len(got) == 51
    parts = G.added_up(ks.df.withColumn("w", F.lit(0)), ["k", "w"], largest)
    assert parts.where("k = 'hot'").count() <= 60  # a busy key sends few rows


def test_other_clocks_for_own_aggregates(spark):
    ks = stream(spark, rows_of(random.Random(13), 200))
    for strategy in (S.bounded(3).every_tick(25), S.bounded(3).with_scope("stream"), S.none()):
        got = G.aggregate_firings(ks, strategy, A.sliding(40, 15), Least())
        want = W.window_firings(ks, strategy, A.sliding(40, 15))
        bag = lambda d: Counter(tuple(r) for r in d.select("k", "window_start", "elements", "wm", "fired_at").collect())
        assert bag(got) == bag(want)
    empty = ks.with_df(ks.df.where("false"))
    assert G.aggregate_firings(empty, S.bounded(0), A.tumbling(5), Least(), 4).collect() == []
