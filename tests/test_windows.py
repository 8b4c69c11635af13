import pytest
from pyspark.sql import functions as F

from keyclock.functions import assigners as A
from keyclock.operators import windows as W
from keyclock.plans.scenarios import HOUR, replay
from keyclock.strategy import WatermarkStrategy as S
from tests import simulator as sim


def spark_result(ks, strategy, assigner, lateness):
    got = W.window_firings(ks, strategy, assigner, lateness_ms=lateness)
    got = {tuple(r) for r in got.select(
        "k", "window_start", "window_end", "firing_no", "elements", "wm", "fired_at").collect()}
    late = {r[0] for r in W.late_rows(ks, strategy, assigner, lateness).select("event_id").collect()}
    return got, late


def rows_of(ks):
    return [tuple(r) for r in ks.df.select("k", "t_ms", "arrival", "event_id").collect()]


CASES = [
    ("median50", "key", None, 0, "tumbling"),
    ("median50", "key", None, 2 * HOUR, "tumbling"),
    ("global50", "key", None, 13 * HOUR, "tumbling"),
    ("global50", "key", None, 0, "sliding"),
    ("global50", "key", None, 3 * HOUR, "sliding"),
    ("median50", "stream", None, 0, "tumbling"),
    ("median50", "stream", None, 13 * HOUR, "sliding"),
    ("global50", "key", 6 * HOUR, 0, "tumbling"),
    ("global50", "key", 6 * HOUR, 2 * HOUR, "sliding"),
    ("median50", "stream", 6 * HOUR, 0, "tumbling"),
    ("global50", "key", None, 0, "gaps"),
    ("global50", "key", None, 0, "custom"),
    ("median50", "stream", None, 0, "custom"),
]


@pytest.mark.parametrize("scenario,scope,tick,lateness,kind", CASES)
def test_firings_match_replay(spark, sf_dir, scenario, scope, tick, lateness, kind):
    ks = replay(spark, sf_dir, scenario)
    strategy = S.bounded(1000).with_scope(scope)
    if tick:
        strategy = strategy.every_tick(tick)
    assigner, assign = {
        "tumbling": (A.tumbling(HOUR), sim.tumbling(HOUR)),
        "sliding": (A.sliding(6 * HOUR, 2 * HOUR), sim.sliding(6 * HOUR, 2 * HOUR)),
        "gaps": (A.sliding(HOUR, 3 * HOUR), sim.sliding(HOUR, 3 * HOUR)),
        "custom": (
            A.custom(lambda ts: F.array(
                F.struct((ts - F.pmod(ts, F.lit(7 * HOUR))).alias("a"), (ts - F.pmod(ts, F.lit(7 * HOUR)) + 7 * HOUR).alias("b")),
                F.struct((ts - F.pmod(ts, F.lit(5 * HOUR))).alias("a"), (ts - F.pmod(ts, F.lit(5 * HOUR)) + 5 * HOUR).alias("b")))),
            lambda t: sim.tumbling(7 * HOUR)(t) + sim.tumbling(5 * HOUR)(t),
        ),
    }[kind]
    got, late = spark_result(ks, strategy, assigner, lateness)
    want, want_late = sim.replay(rows_of(ks), assign, lambda t: t - 1001, lateness, scope, tick)
    assert late == set(want_late)
    assert got == set(want)
    assert len(want) > 50
