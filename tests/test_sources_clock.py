"""The clock of several sources, from changes only, against a tick-by-tick replay."""

import random

import pytest
from pyspark.sql import functions as F

from keyclock.functions.timeunits import MIN_WM
from keyclock.model import key_by
from keyclock.operators import multisource as M
from keyclock.strategy import WatermarkStrategy as S

SCHEMA = "id long, g string, src string, t long, at long"


def stream(spark, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], SCHEMA)
    return key_by(df, "g", ts="t", arrival="at", tie="id")


def dense(rows, bound, tick_ms, idle_ms=None):
    """Every tick, every source."""
    out = []
    for g in sorted({r[0] for r in rows}, key=str):
        mine = [r for r in rows if r[0] == g]
        ticks = [r[3] // tick_ms for r in mine]
        state = {r[1]: [MIN_WM, min(ticks) * tick_ms, False] for r in mine}
        clock = MIN_WM
        for tick in range(min(ticks), max(ticks) + 1):
            for _, src, t, at in mine:
                if at // tick_ms == tick:
                    state[src][0] = max(state[src][0], t - bound - 1)
                    state[src][1] = max(state[src][1], at) if state[src][0] > MIN_WM else at
            before = clock
            left = []
            for s in state.values():
                idle = idle_ms is not None and (tick + 1) * tick_ms - s[1] > idle_ms
                if idle and not s[2]:
                    left.append(s[0])
                s[2] = idle
            active = sorted(s[0] for s in state.values() if not s[2])
            if active:
                clock = next((a for a in active if a >= clock), clock)
            elif clock in left:
                clock = max(clock, max(s[0] for s in state.values()))
            if clock > before:
                out.append((g, tick, (tick + 1) * tick_ms, clock))
    return out


def rows_of(rnd, n, groups=("x", "y"), sources=4):
    rows, at = [], {g: 0 for g in groups}
    for _ in range(n):
        g = rnd.choice(groups)
        at[g] += rnd.choice([0, 1, 2, 3, 40, 200])
        src = f"s{rnd.randrange(sources)}"
        rows.append((g, src, at[g] - rnd.randint(0, 30) + 5 * int(src[1:]), at[g]))
    return rows


@pytest.mark.parametrize("idle,changes", [(None, 3), (4, 1 << 16), (30, 3), (100, 3)])
def test_against_every_tick(spark, monkeypatch, idle, changes):
    monkeypatch.setattr(M, "CHANGES", changes)
    monkeypatch.setattr(M, "_TICKS", 16)
    rows = rows_of(random.Random(idle or 0), 120)
    strategy = S.bounded(3).every_tick(10)
    strategy = strategy if idle is None else strategy.with_idleness(idle)
    got = M.combine_sources(stream(spark, rows), strategy, "src", ["g"])
    assert sorted(tuple(r) for r in got.select("g", "tick", "arrival", "wm").collect()) == sorted(dense(rows, 3, 10, idle))
    one = [("x", *r[1:]) for r in rows]
    got = M.combine_sources(stream(spark, one), strategy, "src")
    assert sorted(("x", *r) for r in got.select("tick", "arrival", "wm").collect()) == sorted(dense(one, 3, 10, idle))


def test_a_source_silent_for_a_year(spark):
    """Second ticks, one source that speaks twice a year, one that speaks once: rows go with what changes."""
    year = 365 * 24 * 3600 * 1000
    rows = [("x", "a", 0, 0), ("x", "b", 5, 500), ("x", "a", year, year), ("x", "b", year + 5, year + 900)]
    for strategy, steps in ((S.bounded(0).every_tick(1000), 2), (S.bounded(0).every_tick(1000).with_idleness(60_000), 3)):
        ks = stream(spark, rows)
        changes = M.source_changes(ks, strategy, "src")
        assert changes.count() <= 4 * len(rows)
        assert M.combine_sources(ks, strategy, "src").count() == steps
    ks = stream(spark, [*rows, ("x", "c", 7, 700)])
    flips = M.alignment_changes(ks, S.bounded(0).with_alignment("all", 1000, 1000), "src")
    assert sorted((r["src"], r["paused"]) for r in flips.collect()) == [("a", True), ("b", True)]


@pytest.mark.parametrize("changes", [4, 1 << 16])
def test_paused_sources_from_changes(spark, monkeypatch, changes):
    monkeypatch.setattr(M, "CHANGES", changes)
    rows = [("x", *r[1:]) for r in rows_of(random.Random(8), 150, groups=("x",))]
    ks = stream(spark, rows)
    strategy = S.bounded(3).with_alignment("all", 12, 10)
    report = M.alignment_report(ks, strategy, "src").collect()
    want, was = [], {}
    for r in sorted(report, key=lambda r: r["tick"]):
        if r["paused"] != was.get(r["src"], False):
            want.append((r["src"], r["tick"], r["wm"], r["group_wm"], r["paused"]))
        was[r["src"]] = r["paused"]
    got = M.alignment_changes(ks, strategy, "src")
    assert sorted(tuple(r) for r in got.select("src", "tick", "wm", "group_wm", "paused").collect()) == sorted(want) and len(want) > 4


def test_no_rows(spark):
    ks = stream(spark, [("x", "a", 0, 0)])
    empty = ks.with_df(ks.df.where(F.lit(False)))
    assert M.combine_sources(empty, S.bounded(0).every_tick(10).with_idleness(5), "src", ["g"]).collect() == []
    assert M.alignment_changes(empty, S.bounded(0).with_alignment("all", 1, 1), "src").collect() == []
