"""One clock from several sources: the minimum over those that are active, and alignment between them.

Everything is worked out from changes: a source speaks and its clock rises, or it has been silent for too long. Between changes nothing
is stored or computed, however many ticks pass and however many sources are silent meanwhile.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyclock.functions.arrow import batch_of
from keyclock.functions.joining import join_same
from keyclock.functions.timeunits import MAX_WM, MIN_WM, floor_div
from keyclock.model import KeyedStream
from keyclock.operators.scan import Fold, running
from keyclock.operators.watermark import tick_of
from keyclock.strategy import WatermarkStrategy

#: ticks that one task of a running value sorts at most, and changes that a sweep takes at a time
_TICKS = 1 << 16
CHANGES = 1 << 16


def source_changes(ks: KeyedStream, strategy: WatermarkStrategy, source: str, group: list[str] | None = None) -> DataFrame:
    """(group, source, ``tick``, ``wm``, ``idle``, ``last_tick``): a source's clock (null until it has spoken) and whether it is left out, from
    the end of ``tick`` on. One row per tick in which the source speaks, one when it falls silent for longer than the strategy's timeout, and
    at most two from the group's first tick to its first word; ``last_tick`` is the group's last.
    """
    group = group or []
    ks = ks.timed(strategy).valid()
    own = [*group, source]
    per_tick = (
        ks.df.withColumn("tick", tick_of(ks, strategy))
        .groupBy(*own, "tick")
        .agg(F.max(strategy.proposes(F.col(ks.ts))).alias("__c"), F.max(ks.arrival).alias("__a"))
    )
    ends = per_tick.groupBy(*group).agg(F.min("tick").alias("__from"), F.max("tick").alias("__to"))
    if group:
        spanned = join_same(per_tick, ends, group)
    else:
        spanned = per_tick.withColumn("__span", ends.select(F.struct("*")).scalar()).select("*", "__span.*").drop("__span")
    tick, backwards = F.col("tick"), -F.col("tick")
    folds = [Fold("wm", "max", F.col("__c")), Fold("__first", "min", tick)]
    steps = running(spanned, own, [tick], floor_div("tick", _TICKS), folds)
    steps = running(steps, own, [backwards], floor_div(backwards, _TICKS), [Fold("__next", "min", tick)], inclusive=False)

    def change(when, at, wm, idle):
        return F.when(when, F.struct(at.cast("bigint").alias("tick"), wm.alias("wm"), idle.alias("idle")))

    yes, no, nothing = F.lit(True), F.lit(False), F.lit(None).cast("bigint")
    unheard = (tick == F.col("__first")) & (F.col("__from") < tick)
    if strategy.idle_ms is None:
        items = [change(yes, tick, F.col("wm"), no), change(unheard, F.col("__from"), nothing, no)]
    else:
        silent = floor_div(F.col("__a") + F.lit(strategy.idle_ms).cast("bigint"), strategy.tick_ms)
        never = F.col("__from") + F.lit(strategy.idle_ms // strategy.tick_ms).cast("bigint")
        items = [
            change(yes, tick, F.col("wm"), silent <= tick),
            change((silent > tick) & (silent < F.coalesce("__next", F.col("__to") + 1)), silent, F.col("wm"), yes),
            change(unheard, F.col("__from"), nothing, never <= F.col("__from")),
            change(unheard & (never > F.col("__from")) & (never < tick), never, nothing, yes),
        ]
    spread = steps.select(*own, F.col("__to").alias("last_tick"), F.explode(F.array(*items)).alias("__i"))
    return spread.where(F.col("__i").isNotNull()).select(*own, "__i.*", "last_tick")


def _in_slices(changes: DataFrame, group: list[str], source: str) -> DataFrame:
    """Changes dealt to slices of about ``CHANGES`` of a group, and in front of each slice where every source of the group stood
    (rows without a tick). A group of fewer changes is one slice and needs nothing in front of it."""
    cells = changes.groupBy(*group, "tick").agg(F.count("*").alias("__n"))
    before = running(cells, group, [F.col("tick")], floor_div("tick", _TICKS), [Fold("__before", "sum", F.col("__n"))], inclusive=False)
    before = before.select(*group, "tick", floor_div(F.coalesce("__before", F.lit(0)), CHANGES).alias("slice"))
    dealt = join_same(changes, before, [*group, "tick"])
    last = dealt.groupBy(*group, source, "slice").agg(F.max_by(F.struct("wm", "idle"), "tick").alias("__s"))
    ends = before.groupBy(*group).agg(F.max("slice").alias("__last"))
    if group:
        last = join_same(last, ends, group)
    else:
        last = last.withColumn("__last", ends.select("__last").scalar())
    following = F.lead("slice").over(Window.partitionBy(*group, source).orderBy("slice"))
    last = last.withColumn("__until", F.coalesce(following, "__last"))
    carried = last.where(F.col("slice") < F.col("__until")).select(*group, source, "__s.*", F.explode(F.sequence(F.col("slice") + 1, "__until")).alias("slice"))
    return dealt.drop("last_tick").unionByName(carried, allowMissingColumns=True)


class _Sources:
    """Where the sources of a group stand, tick by tick."""

    def __init__(self, rows: list[dict], source: str):
        self.source, self.now, self.active, self.top = source, {}, [], MIN_WM
        self.rows = sorted((r for r in rows if r["tick"] is not None), key=lambda r: r["tick"])
        for r in rows:
            if r["tick"] is None:
                self._put(r)

    def _put(self, r: dict) -> int | None:
        """The clock of a source that falls silent with this change."""
        wm = MIN_WM if r["wm"] is None else r["wm"]
        old = self.now.get(r[self.source])
        if old is not None and not old[1]:
            del self.active[bisect_left(self.active, old[0])]
        if not r["idle"]:
            insort(self.active, wm)
        self.now[r[self.source]] = (wm, r["idle"])
        self.top = max(self.top, wm)
        return wm if r["idle"] and (old is None or not old[1]) else None

    def ticks(self) -> Iterator[tuple[int, list[int]]]:
        """Every tick with a change, when its changes have been made, and the clocks of those that fell silent in it."""
        i = 0
        while i < len(self.rows):
            tick, left = self.rows[i]["tick"], []
            while i < len(self.rows) and self.rows[i]["tick"] == tick:
                gone = self._put(self.rows[i])
                if gone is not None:
                    left.append(gone)
                i += 1
            yield tick, left


def combine_sources(ks: KeyedStream, strategy: WatermarkStrategy, source: str, group: list[str] | None = None) -> DataFrame:
    """Progress of the combined clock: (group, ``tick``, ``arrival`` of the tick's end, ``wm``), one row per increase.

    The clock is the minimum over active sources that have caught up with it. A source silent for longer than the
    strategy's idle timeout is left out; when the last one falls silent while standing at the output, the clock jumps to
    the maximum. Without a timeout every source counts all the time.

    What the changes of a slice do to any clock that enters it is a map of a few intervals (about one per source); the maps of a group
    are applied one after another, and each slice then replays its changes.
    """
    group = group or []
    rows = _in_slices(source_changes(ks, strategy, source, group), group, source)
    fields = [rows.schema[g] for g in group]
    long = T.LongType()
    whole = T.StructType([*fields, T.StructField("slice", long), T.StructField("steps", T.ArrayType(T.ArrayType(long)))])
    entered = T.StructType([*fields, T.StructField("slice", long), T.StructField("entry", long)])
    risen = T.StructType([*fields, T.StructField("tick", long), T.StructField("arrival", long), T.StructField("wm", long)])
    tick_ms = strategy.tick_ms

    def key(rows_: list[dict]) -> dict:
        return {g: rows_[0][g] for g in group}

    def composed(t: pa.Table) -> pa.Table:
        mine, steps = t.to_pylist(), []
        sources = _Sources(mine, source)
        for _, left in sources.ticks():
            steps = _then(steps, sources.active, left, sources.top)
        return pa.Table.from_batches([batch_of([{**key(mine), "slice": mine[0]["slice"], "steps": steps}], whole)])

    def entries(t: pa.Table) -> pa.Table:
        mine, out, found = sorted(t.to_pylist(), key=lambda r: r["slice"]), MIN_WM, []
        for r in mine:
            found.append({**key(mine), "slice": r["slice"], "entry": out})
            out = next((v for lo, hi, v in r["steps"] if lo <= out <= hi), out)
        return pa.Table.from_batches([batch_of(found, entered)])

    def replayed(t: pa.Table) -> pa.Table:
        mine = t.to_pylist()
        out, found, sources = mine[0]["entry"], [], _Sources(mine, source)
        for tick, left in sources.ticks():
            after = _moved(out, sources.active, left, sources.top)
            if after > out:
                out = after
                found.append({**key(mine), "tick": tick, "arrival": (tick + 1) * tick_ms, "wm": out})
        return pa.Table.from_batches([batch_of(found, risen)])

    maps = rows.groupBy(*group, "slice").applyInArrow(composed, whole)
    # one row per slice of thousands of changes
    began = maps.withColumn("__all", F.lit(0)).groupBy(*(group or ["__all"])).applyInArrow(entries, entered)
    return join_same(rows, began, [*group, "slice"]).groupBy(*group, "slice").applyInArrow(replayed, risen)


def _moved(out: int, active: list[int], left: list[int], top: int) -> int:
    """The clock after a tick: the lowest active source that has caught up with it; the highest of all when the last one leaves."""
    if active:
        at = bisect_left(active, out)
        return active[at] if at < len(active) else out
    return max(top, out) if out in left else out


def _then(steps: list[list[int]], active: list[int], left: list[int], top: int) -> list[list[int]]:
    """One more tick after ``steps``: sorted intervals [low, high, value] of clocks that end up at a value; others stay as they are."""
    after = [[lo, hi, _moved(v, active, left, top)] for lo, hi, v in steps]
    free, low = [], MIN_WM
    for lo, hi, _ in steps:
        if low < lo:
            free.append((low, lo - 1))
        low = hi + 1
    free.append((low, MAX_WM))
    for a, b in free:
        if active:
            for x in active[bisect_left(active, a) :]:
                if a > b:
                    break
                after.append([a, min(b, x), x])
                a = x + 1
        else:
            after += [[x, x, max(top, x)] for x in left if a <= x <= b and top > x]
    joined: list[list[int]] = []
    for lo, hi, v in sorted(after):
        if joined and joined[-1][2] == v and joined[-1][1] + 1 == lo:
            joined[-1][1] = hi
        else:
            joined.append([lo, hi, v])
    return joined


def _aligned(strategy: WatermarkStrategy) -> WatermarkStrategy:
    if strategy.align_group is None or strategy.align_drift_ms is None:
        raise ValueError("the strategy has no alignment group")
    return strategy.every_tick(strategy.align_interval_ms)


def alignment_report(ks: KeyedStream, strategy: WatermarkStrategy, source: str) -> DataFrame:
    """Which sources run ahead of the slowest one by more than the allowed drift, at every update.

    (``group``, source, ``tick``, ``wm``, ``group_wm``, ``paused``). Spark cannot hold back a single source; a stream is
    throttled at its reader (files or offsets per trigger), so this is a report. It has a row per update and source; what
    changes is in :func:`alignment_changes`.
    """
    changes = source_changes(ks, _aligned(strategy), source)
    backwards = -F.col("tick")
    spans = running(changes, [source], [backwards], floor_div(backwards, _TICKS), [Fold("__next", "min", F.col("tick"))], inclusive=False)
    upto = F.coalesce(F.col("__next") - 1, "last_tick")
    clocks = spans.where(F.col("wm").isNotNull()).select(source, "wm", F.explode(F.sequence("tick", upto)).alias("tick"))
    slowest = clocks.groupBy("tick").agg(F.min("wm").alias("group_wm"))
    drift = F.lit(strategy.align_drift_ms).cast("bigint")
    return clocks.join(slowest, "tick").select(
        F.lit(strategy.align_group).alias("group"),
        source,
        "tick",
        "wm",
        "group_wm",
        (F.col("wm") - F.col("group_wm") > drift).alias("paused"),
    )


def alignment_changes(ks: KeyedStream, strategy: WatermarkStrategy, source: str) -> DataFrame:
    """The updates at which a source is paused or let go: (``group``, source, ``tick``, ``wm``, ``group_wm``, ``paused``).

    Work and rows go with what changes. A source is let go until it is paused for the first time."""
    changes = source_changes(ks, _aligned(strategy), source)
    rows = _in_slices(changes.where(F.col("wm").isNotNull()), [], source)
    drift, name, long = strategy.align_drift_ms, strategy.align_group, T.LongType()
    shape = T.StructType([T.StructField("group", T.StringType()), rows.schema[source], *[T.StructField(n, long) for n in ("tick", "wm", "group_wm")], T.StructField("paused", T.BooleanType())])

    def flips(t: pa.Table) -> pa.Table:
        mine, clocks, standing, found = t.to_pylist(), {}, [], []
        names = {}  # sources by number, so that those of equal clocks can be sorted

        def put(r) -> None:
            who = names.setdefault(r[source], len(names))
            if who in clocks:
                del standing[bisect_left(standing, (clocks[who][0], who))]
            clocks[who] = (r["wm"], r[source])
            insort(standing, (r["wm"], who))

        for r in mine:
            if r["tick"] is None:
                put(r)
        limit = standing[0][0] + drift if standing else None
        held = {who for wm, who in standing if wm > limit}
        due = sorted((r for r in mine if r["tick"] is not None), key=lambda r: r["tick"])
        i = 0
        while i < len(due):
            tick, moved, old = due[i]["tick"], set(), limit
            while i < len(due) and due[i]["tick"] == tick:
                put(due[i])
                moved.add(names[due[i][source]])
                i += 1
            limit = standing[0][0] + drift
            if old is not None:  # whoever stands between the two limits
                low, high = sorted((old, limit))
                moved |= {who for _, who in standing[bisect_right(standing, (low, len(names))) : bisect_right(standing, (high, len(names)))]}
            for who in moved:
                wm, own = clocks[who]
                if (wm > limit) != (who in held):
                    (held.remove if who in held else held.add)(who)
                    found.append({"group": name, source: own, "tick": tick, "wm": wm, "group_wm": limit - drift, "paused": who in held})
        return pa.Table.from_batches([batch_of(found, shape)])

    return rows.groupBy("slice").applyInArrow(flips, shape)
