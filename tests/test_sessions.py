from collections import Counter

import pytest
from pyspark.sql import functions as F

from keyclock.operators import sessions as X
from keyclock.plans.scenarios import HOUR, replay
from keyclock.strategy import WatermarkStrategy as S
from tests import simulator as sim


@pytest.mark.parametrize("scenario,gap,bound,lateness,k", [
    ("global50", HOUR, 1000, 0, 20),
    ("global50", 4 * HOUR, 1000, 2 * HOUR, 20),
    ("global50", 2 * HOUR, 8 * HOUR, 0, 3),
    ("global5", 3 * HOUR, 1000, 9 * HOUR, 2),
    ("median50", HOUR, 0, 0, 20),
])
def test_sessions_against_clock(spark, sf_dir, scenario, gap, bound, lateness, k):
    ks = replay(spark, sf_dir, scenario)
    ks = ks.with_df(ks.df.withColumn("k", F.col("user_id") % k))
    rows = [tuple(r) for r in ks.df.select("k", "t_ms", "arrival", "event_id").collect()]
    got = X.session_firings(ks, S.bounded(bound), gap, lateness).collect()
    late = {r["tie"] for r in X.session_firings(ks, S.bounded(bound), gap, lateness, late=True).collect()}
    first, again, want_late = sim.replay_sessions(rows, gap, bound, lateness)
    assert late == set(want_late)
    shape = lambda r: (r["k"], r["window_start"], r["window_end"], r["elements"], r["wm"])
    assert Counter(shape(r) for r in got if not r["refired"]) == Counter(first)
    assert Counter(shape(r) for r in got if r["refired"]) == Counter(again)
    plain = X._plain_items  # the uncompressed path gives the same
    keep, X._clock_items = X._clock_items, plain
    try:
        slow = X.session_firings(ks, S.bounded(bound), gap, lateness)
        assert Counter(map(tuple, slow.collect())) == Counter(map(tuple, got))
    finally:
        X._clock_items = keep


def test_touching_sessions_merge(spark):
    from keyclock.model import key_by

    df = spark.createDataFrame([(1, "a", 0), (2, "a", 10), (3, "a", 21), (4, None, 5)], "id long, k string, t long")
    ks = key_by(df, "k", ts="t", tie="id", bucket_ms=7)
    got = {tuple(r) for r in X.sessions(ks, 10).collect()}
    assert got == {("a", 0, 20, 2), ("a", 21, 31, 1), (None, 5, 15, 1)}
