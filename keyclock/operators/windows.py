"""Event-time windows against a clock: lateness, firings, refirings, late rows."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyclock.functions.arrow import batch_of, records
from keyclock.functions.assigners import Sliding, WindowAssigner
from keyclock.functions.timeunits import floor_div, max_wm, min_wm
from keyclock.model import KeyedStream
from keyclock.operators.scan import Fold, running
from keyclock.operators.watermark import clock_keys, clocked_rows, progress_rows
from keyclock.strategy import WatermarkStrategy

_MERGE = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}


@dataclass(frozen=True)
class Measure:
    """A window aggregate that can be continued by late rows: ``count``, ``sum``, ``min`` or ``max``; also ``avg``, ``min_by`` and
    ``max_by``, which are carried as some of these (see :func:`expanded`)."""

    name: str
    kind: str
    value: Column | None = None
    by: Column | None = None

    def item(self) -> Column:
        return F.lit(1).cast("bigint") if self.kind == "count" else self.value

    def fold_kind(self) -> str:
        return "sum" if self.kind in ("count", "sum") else self.kind


def count(name: str = "elements") -> Measure:
    return Measure(name, "count")


def total(name: str, value: Column) -> Measure:
    return Measure(name, "sum", value)


def smallest(name: str, value: Column) -> Measure:
    return Measure(name, "min", value)


def largest(name: str, value: Column) -> Measure:
    return Measure(name, "max", value)


def average(name: str, value: Column) -> Measure:
    return Measure(name, "avg", value)


def value_of_smallest(name: str, value: Column, by: Column) -> Measure:
    """The value next to the smallest ``by``; of equals the smallest value. Rows without ``by`` do not count."""
    return Measure(name, "min_by", value, by)


def value_of_largest(name: str, value: Column, by: Column) -> Measure:
    """The value next to the largest ``by``; of equals the largest value. Rows without ``by`` do not count."""
    return Measure(name, "max_by", value, by)


def expanded(measures: list[Measure]) -> tuple[list[Measure], dict[str, Column]]:
    """Measures that merge on their own, and what each named result is made of."""
    plain, results = [], {}
    for m in measures:
        a, b = f"__{m.name}_a", f"__{m.name}_b"
        if m.kind == "avg":
            plain += [total(a, m.value), total(b, m.value.isNotNull().cast("bigint"))]
            results[m.name] = F.when(F.col(b) > 0, F.col(a).cast("double") / F.col(b))
        elif m.kind in ("min_by", "max_by"):
            pair = F.when(m.by.isNotNull(), F.struct(m.by.alias("by"), m.value.alias("value")))
            plain.append(Measure(a, m.kind[:3], pair))
            results[m.name] = F.col(f"{a}.value")
        else:
            plain.append(m)
            results[m.name] = F.col(m.name)
    return plain, results


def plain_aggs(measures: list[Measure]) -> list[Column]:
    return [_MERGE[m.kind](m.item()).alias(m.name) for m in measures]


def merge_aggs(measures: list[Measure], partial: DataFrame) -> list[Column]:
    """The same over partial results, in the type that one level of them has."""
    how = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}
    return [how[m.kind](m.name).cast(partial.schema[m.name].dataType).alias(m.name) for m in measures]


def _check_lateness(lateness_ms: int) -> None:
    if lateness_ms < 0:
        raise ValueError("the allowed lateness must not be negative")


def passed(wm: Column, instant: Column, lateness_ms: int) -> Column:
    """``instant + lateness <= wm`` without overflow; false while there is no watermark."""
    reached = wm.isNotNull() & (wm >= instant)
    if lateness_ms == 0:
        return reached
    return F.when(reached, wm - instant >= F.lit(lateness_ms).cast("bigint")).otherwise(False)


def _last(w: Column) -> Column:
    return w["window_end"] - 1


def assign_windows(ks: KeyedStream, assigner: WindowAssigner) -> DataFrame:
    """One row per (row, window) with ``window_start`` and ``window_end``."""
    time = F.col(ks.ts if assigner.event_time else ks.arrival)
    return ks.valid().df.select("*", F.inline(assigner.windows(time)))


def windowed(ks: KeyedStream, strategy: WatermarkStrategy, assigner: WindowAssigner) -> DataFrame:
    """Clocked rows, with their windows in ``__wins`` where the assigner only gives an array."""
    if not assigner.event_time:
        raise ValueError("arrival-clock windows have no watermark; use window_aggregate")
    rows = clocked_rows(ks, strategy)
    if assigner.candidates(ks.ts) is None:
        rows = rows.withColumn("__wins", assigner.windows(F.col(ks.ts)))
    return rows


def _items(ks, assigner, keep: Callable[[Column], Column], make: Callable[[Column], Column]) -> Column:
    """Array of ``make(w)`` for the row's windows with ``keep(w)``; elements may be null and are to be skipped."""
    listed = assigner.candidates(ks.ts)
    if listed is None:
        return F.transform(F.filter("__wins", keep), make)
    return F.array(*[F.when(mine & keep(w), make(w)) for w, mine in listed])


def _spread(rows: DataFrame, items: Column, *columns) -> DataFrame:
    """One row per non-null item, the item's fields next to ``columns``."""
    return rows.select(*columns, F.explode(items).alias("__i")).where(F.col("__i").isNotNull()).select("*", "__i.*").drop("__i")


def _overlapping(assigner: WindowAssigner) -> bool:
    return isinstance(assigner, Sliding) and assigner.overlaps and assigner.event_time


def _for_counting(ks: KeyedStream, strategy: WatermarkStrategy, assigner: WindowAssigner) -> DataFrame:
    """Clocked rows; windows that overlap are counted by their ends and need no list."""
    return clocked_rows(ks, strategy) if _overlapping(assigner) else windowed(ks, strategy, assigner)


def element_late(ks: KeyedStream, assigner: WindowAssigner, lateness_ms: int) -> Column:
    """No window takes the row, and its own time has passed as well."""
    wm = F.col("__wm")
    if _overlapping(assigner):  # the newest window is the last to go
        return passed(wm, assigner.last_end(ks.ts) - 1, lateness_ms)
    own = passed(wm, F.col(ks.ts), lateness_ms)
    listed = assigner.candidates(ks.ts)
    if listed is None:
        return own & F.forall("__wins", lambda w: passed(wm, _last(w), lateness_ms))
    for w, mine in listed:
        own = own & (~mine | passed(wm, _last(w), lateness_ms))
    return own


def accepted_windows(ks: KeyedStream, assigner: WindowAssigner, lateness_ms: int) -> Column:
    """How many windows take the row."""
    wm, one = F.col("__wm"), F.lit(1).cast("bigint")
    if _overlapping(assigner):
        open_ = assigner.last_end(ks.ts) - open_from(assigner, ks.ts, lateness_ms)
        return F.when(open_ >= 0, floor_div(open_, assigner.slide_ms) + one).otherwise(F.lit(0).cast("bigint"))
    listed = assigner.candidates(ks.ts)
    if listed is None:
        return F.size(F.filter("__wins", lambda w: ~passed(wm, _last(w), lateness_ms))).cast("bigint")
    out = F.lit(0).cast("bigint")
    for w, mine in listed:
        out = out + F.when(mine & ~passed(wm, _last(w), lateness_ms), one).otherwise(F.lit(0))
    return out


def entries(ks: KeyedStream, strategy: WatermarkStrategy, assigner: WindowAssigner, lateness_ms: int = 0) -> DataFrame:
    """Every row once, with the number of windows that take it (``entered``)."""
    _check_lateness(lateness_ms)
    rows = _for_counting(ks, strategy, assigner)
    return rows.withColumn("entered", accepted_windows(ks, assigner, lateness_ms)).drop("__wins", "__wm", "__cand")


def classify_lateness(
    ks: KeyedStream, strategy: WatermarkStrategy, assigner: WindowAssigner, lateness_ms: int = 0
) -> DataFrame:
    """One row per (row, window): ``window_status`` is ``on_time``, ``allowed`` or ``late``; plus ``element_late``."""
    _check_lateness(lateness_ms)
    rows = windowed(ks, strategy, assigner).withColumn("element_late", element_late(ks, assigner, lateness_ms))
    rows = _spread(rows, _items(ks, assigner, lambda w: F.lit(True), lambda w: w), "*")
    last, wm = F.col("window_end") - 1, F.col("__wm")
    status = (
        F.when(passed(wm, last, lateness_ms), "late").when(passed(wm, last, 0), "allowed").otherwise("on_time")
    )
    return (
        rows.withColumn("window_status", status)
        .withColumn("wm_before", F.coalesce(wm, min_wm()))
        .drop("__wins", "__wm", "__cand")
    )


def late_rows(ks: KeyedStream, strategy: WatermarkStrategy, assigner: WindowAssigner, lateness_ms: int = 0) -> DataFrame:
    """Late side output: the rows no window accepted, with the clock that refused them in ``wm_before``."""
    _check_lateness(lateness_ms)
    return (
        _for_counting(ks, strategy, assigner)
        .where(element_late(ks, assigner, lateness_ms))
        .withColumn("wm_before", F.col("__wm"))
        .drop("__wins", "__wm", "__cand")
    )


def late_counts(ks: KeyedStream, strategy: WatermarkStrategy, assigner: WindowAssigner, lateness_ms: int = 0) -> DataFrame:
    """Per key: ``total``, ``late`` (dropped or sent to the side output) and ``kept`` rows."""
    _check_lateness(lateness_ms)
    late = F.sum(element_late(ks, assigner, lateness_ms).cast("bigint"))
    return (
        _for_counting(ks, strategy, assigner)
        .groupBy(*ks.keys)
        .agg(F.count("*").alias("total"), late.alias("late"))
        .withColumn("kept", F.col("total") - F.col("late"))
    )


def _of_slices(partial: DataFrame, keys: list[str], assigner: Sliding, measures: list[Measure], first_end: str, *carried: str) -> DataFrame:
    """Windows from partial results per slice: each goes to the windows from ``first_end`` to the newest that has the slice.

    Rows are added up once, however many windows overlap; only what is left of a slice is copied. Items without a slice
    (``carried`` columns, with a window end) pass through. ``carried`` columns are merged by their minimum.
    """
    ends = F.sequence(F.col(first_end), assigner.last_end("__slice"), F.lit(assigner.slide_ms).cast("bigint"))
    ends = F.when(F.col("__slice").isNull(), F.array(first_end)).otherwise(ends)
    spread = partial.select("*", F.explode(ends).alias("window_end"))
    start = F.when(F.col("__slice").isNotNull(), F.col("window_end") - F.lit(assigner.size_ms).cast("bigint"))
    aggs = merge_aggs(measures, partial) + [F.min(c).alias(c) for c in carried]
    return spread.withColumn("window_start", start).groupBy(*keys, "window_start", "window_end").agg(*aggs)


def open_from(assigner: Sliding, ts: str, delay_ms: int) -> Column:
    """The end of the oldest window that takes a row, given the clock ``__wm`` before it; beyond the newest one if none does."""
    # a window that a clock value leaves open ends beyond the last end it completes
    still = assigner.end_reached(f"(__wm - {delay_ms}L)") + F.lit(assigner.slide_ms).cast("bigint")
    return F.greatest(assigner.first_end(ts), F.when(F.col("__wm").isNotNull(), still))


def _entry(assigner: WindowAssigner, delay_ms: int, lead: tuple[str, str], wm_before: str, wm_now: str, arrival: str) -> tuple[Column, Column]:
    """(is this a clock step into a new cell, the step as a window-like item)"""
    end = assigner.end_reached(f"({wm_now} - {delay_ms}L)")
    rises = F.expr(f"{wm_now} is not null and ({wm_before} is null or {wm_now} > {wm_before})")
    fresh = rises & (F.col(wm_before).isNull() | (end > assigner.end_reached(f"({wm_before} - {delay_ms}L)")))
    no_time = F.lit(None).cast("bigint")
    return fresh, F.struct(no_time.alias(lead[0]), end.alias(lead[1]), F.col(wm_now).alias("wm"), F.col(arrival).alias("fired_at"))


def fired_by_clock(ks: KeyedStream, strategy: WatermarkStrategy, assigner: WindowAssigner, grouped: DataFrame, delay_ms: int = 0) -> DataFrame:
    """Windows (keys, ``window_start``, ``window_end``, further columns) with the clock step that reached them: ``wm`` and ``fired_at``."""
    if strategy.kind == "none":
        return grouped.withColumns({"wm": max_wm(), "fired_at": F.lit(None).cast("bigint")})
    fresh, item = _entry(assigner, delay_ms, ("window_start", "window_end"), "wm_before", "__now", "arrival")
    steps = progress_rows(ks, strategy).withColumnRenamed("wm", "__now").where(fresh)
    steps = steps.select(*clock_keys(ks, strategy), item.alias("__i")).select("*", "__i.*").drop("__i")
    if strategy.scope == "stream":
        return _fire_by_stream_clock(grouped, steps, ks.bucket_ms)
    return _fire_by_key_clock(ks, grouped.unionByName(steps, allowMissingColumns=True), assigner)


def panes(
    ks: KeyedStream,
    strategy: WatermarkStrategy,
    assigner: WindowAssigner,
    measures: list[Measure],
    delay_ms: int = 0,
) -> DataFrame:
    """Rows accepted before the clock reached ``window_end - 1 + delay``, aggregated per (keys, window).

    Adds ``wm``, the watermark that reached it (end of event time if none did), and ``fired_at``, its arrival (null then).
    The clock steps that matter are those entering a new grid cell; they travel through the same explode and the same
    aggregation as the rows, so a keyed run reads and shuffles the rows once. Overlapping windows are put together from
    slices: the windows that still take a row are those from some end on, so rows are added up per slice and that end.
    """
    sliced = isinstance(assigner, Sliding) and assigner.overlaps
    rows = clocked_rows(ks, strategy) if sliced else windowed(ks, strategy, assigner)
    wm, keys = F.col("__wm"), list(ks.keys)
    no_time = F.lit(None).cast("bigint")
    fused = strategy.scope == "key" and strategy.emit == "record" and strategy.kind != "none"
    lead = ("__slice", "__first") if sliced else ("window_start", "window_end")

    if sliced:
        if not assigner.event_time:
            raise ValueError("arrival-clock windows have no watermark; use window_aggregate")
        first = open_from(assigner, ks.ts, delay_ms)
        item = F.struct(assigner.slice_start(ks.ts).alias("__slice"), first.alias("__first"), no_time.alias("wm"), no_time.alias("fired_at"))
        accepted = F.array(F.when(first <= assigner.last_end(ks.ts), item))
    else:
        accepted = _items(
            ks,
            assigner,
            lambda w: ~passed(wm, _last(w), delay_ms),
            lambda w: F.struct(w["window_start"], w["window_end"], no_time.alias("wm"), no_time.alias("fired_at")),
        )
    fired = [F.min("wm").alias("wm"), F.min("fired_at").alias("fired_at")]
    if fused:
        fresh, item = _entry(assigner, delay_ms, lead, "__wm", "__cand", ks.arrival)
        accepted = F.concat(accepted, F.array(F.when(fresh, item)))
    grouped = _spread(rows, accepted, "*").groupBy(*keys, *lead).agg(*plain_aggs(measures), *fired)
    if sliced:
        grouped = _of_slices(grouped, keys, assigner, measures, "__first", "wm", "fired_at")
    if fused:
        return _fire_by_key_clock(ks, grouped, assigner)
    return fired_by_clock(ks, strategy, assigner, grouped.drop("wm", "fired_at"), delay_ms)


def _fire_by_key_clock(ks: KeyedStream, grouped: DataFrame, assigner: WindowAssigner) -> DataFrame:
    """Give every window the first step at or beyond its end. ``grouped`` mixes windows and steps (no start)."""
    if assigner.on_grid:
        # at most one step per window slot and key: a window per key is as small as the result itself
        later = Window.partitionBy(*ks.keys).orderBy(F.col("window_end").desc())
        found = grouped.withColumns({"wm": F.min("wm").over(later), "fired_at": F.min("fired_at").over(later)})
    else:
        backwards = -F.col("window_end")
        found = running(
            grouped.withColumnsRenamed({"wm": "__w", "fired_at": "__a"}),
            ks.keys,
            [backwards, F.col("window_start").asc_nulls_first()],
            floor_div(backwards, ks.bucket_ms),
            [Fold("wm", "min", F.col("__w")), Fold("fired_at", "min", F.col("__a"))],
        ).drop("__w", "__a")
    return found.where(F.col("window_start").isNotNull()).withColumn("wm", F.coalesce("wm", max_wm()))


def _fire_by_stream_clock(grouped: DataFrame, steps: DataFrame, bucket_ms: int) -> DataFrame:
    """One clock for all keys: window end -> step is a table of the ends that occur, looked up by equality."""
    cells = steps.groupBy("window_end").agg(F.min("wm").alias("__w"), F.min("fired_at").alias("__a"))
    # every end that occurs looks back for the first step at or beyond it; no time slot without rows is ever made
    ends = grouped.select("window_end").distinct()
    asked = cells.withColumn("__kind", F.lit(0)).unionByName(ends.withColumn("__kind", F.lit(1)), allowMissingColumns=True)
    backwards = -F.col("window_end")
    folds = [Fold("wm", "min", F.col("__w")), Fold("fired_at", "min", F.col("__a"))]
    table = running(asked, [], [backwards, F.col("__kind")], floor_div(backwards, bucket_ms), folds)
    table = table.where(F.col("__kind") == 1).select("window_end", "wm", "fired_at")
    return grouped.join(table, "window_end", "left").withColumn("wm", F.coalesce("wm", max_wm()))


def window_firings(
    ks: KeyedStream,
    strategy: WatermarkStrategy,
    assigner: WindowAssigner,
    measures: list[Measure] | None = None,
    lateness_ms: int = 0,
    purging: bool = False,
) -> DataFrame:
    """All firings: (keys, ``window_start``, ``window_end``, ``firing_no``, measures, ``wm``, ``fired_at``, ``result_ts``).

    A window fires once when the clock reaches its last instant, with everything that came in time. With allowed
    lateness each later accepted row fires it again with the continued aggregate. Windows the clock never reached fire
    at the end of input, with ``wm`` at the end of event time and no ``fired_at``. ``purging`` empties a window whenever
    it fires, so a refiring carries only its own row.
    """
    _check_lateness(lateness_ms)
    measures, results = expanded(measures or [count()])
    first = panes(ks, strategy, assigner, measures)
    named = [c.alias(n) for n, c in results.items()]
    out = [*ks.keys, "window_start", "window_end", "firing_no", *named, "wm", "fired_at", "result_ts"]
    result_ts = F.col("window_end") - 1
    if lateness_ms == 0 or strategy.kind == "none":
        return first.withColumns({"firing_no": F.lit(1).cast("bigint"), "result_ts": result_ts}).select(*out)

    wm = F.col("__wm")
    again = _items(
        ks, assigner, lambda w: passed(wm, _last(w), 0) & ~passed(wm, _last(w), lateness_ms), lambda w: w
    )
    late = _spread(
        windowed(ks, strategy, assigner),
        again,
        *ks.keys,
        F.col(ks.arrival).alias("__at"),
        F.col(ks.tie).alias("__tie"),
        wm.alias("wm"),
        F.col(ks.arrival).alias("fired_at"),
        *[m.item().alias(m.name) for m in measures],
    )
    # the first firing opens the running aggregate of its window, before any arrival
    opened = first.withColumn("__at", min_wm())
    items = late.unionByName(opened, allowMissingColumns=True)
    at = F.col("__at")
    cut = F.when(at == min_wm(), at).otherwise(floor_div(at, ks.bucket_ms))
    folds = [Fold(f"__r{i}", m.fold_kind(), F.col(m.name)) for i, m in enumerate(measures) if not purging]
    folds.append(Fold("firing_no", "sum", F.lit(1).cast("bigint")))
    done = running(items, [*ks.keys, "window_start", "window_end"], [at, F.col("__tie")], cut, folds)
    if not purging:
        done = done.withColumns({m.name: F.col(f"__r{i}") for i, m in enumerate(measures)})
    return done.withColumn("result_ts", result_ts).select(*out)


def window_aggregate(ks: KeyedStream, assigner: WindowAssigner, *aggs: Column | Measure) -> DataFrame:
    """Batch mode: every row counts, one result per (keys, window). Also serves arrival-clock windows.

    Given measures instead of Columns, overlapping windows are put together from slices and no row is copied."""
    if not all(isinstance(a, Measure) for a in aggs):
        return assign_windows(ks, assigner).groupBy(*ks.keys, "window_start", "window_end").agg(*aggs)
    measures, results = expanded(list(aggs))
    named, keys = [c.alias(n) for n, c in results.items()], list(ks.keys)
    if isinstance(assigner, Sliding) and assigner.overlaps:
        time = ks.ts if assigner.event_time else ks.arrival
        partial = ks.valid().df.withColumn("__slice", assigner.slice_start(time)).groupBy(*keys, "__slice").agg(*plain_aggs(measures))
        grouped = _of_slices(partial.withColumn("__first", assigner.first_end("__slice")), keys, assigner, measures, "__first")
    else:
        grouped = assign_windows(ks, assigner).groupBy(*keys, "window_start", "window_end").agg(*plain_aggs(measures))
    return grouped.select(*keys, "window_start", "window_end", *named)


def global_window(ks: KeyedStream, *aggs: Column) -> DataFrame:
    """The single window of a key that never ends: one result per key at the end of input."""
    return ks.df.groupBy(*ks.keys).agg(*aggs)


def pane_rows(ks: KeyedStream, strategy: WatermarkStrategy, assigner: WindowAssigner) -> DataFrame:
    """The contents of every first firing as rows: columns of the row, window, ``position`` in arrival order, ``wm``."""
    on_time = _items(ks, assigner, lambda w: ~passed(F.col("__wm"), _last(w), 0), lambda w: w)
    rows = _spread(windowed(ks, strategy, assigner), on_time, *ks.df.columns)
    pane = [*ks.keys, "window_start", "window_end"]
    order = [F.col(ks.arrival), F.col(ks.tie)]
    cut = ks.bucket()
    placed = running(rows, pane, order, cut, [Fold("position", "sum", F.lit(1).cast("bigint"))])
    fired = panes(ks, strategy, assigner, [count()]).select(*pane, "elements", "wm", "fired_at")
    a, b = placed.alias("a"), fired.alias("b")
    same = None
    for c in pane:
        eq = F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
        same = eq if same is None else same & eq
    return a.join(b, same).select("a.*", "b.elements", "b.wm", "b.fired_at")


def window_process(
    ks: KeyedStream,
    strategy: WatermarkStrategy,
    assigner: WindowAssigner,
    function: Callable[[dict, Iterator[dict]], Iterable[dict]],
    schema: T.StructType,
) -> DataFrame:
    """Call ``function(window, rows)`` for every first firing and collect the dicts it gives.

    ``window`` has the keys, ``window_start``, ``window_end``, ``elements``, ``wm``, ``fired_at``; ``rows`` is an iterator over the
    pane in arrival order. Panes are streamed: nothing holds all rows of one, unless the function does.
    """
    pane = [*ks.keys, "window_start", "window_end"]
    about = [*pane, "elements", "wm", "fired_at"]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        rows = itertools.chain.from_iterable(records(batches))
        for _, mine in itertools.groupby(rows, key=lambda r: tuple(r[c] for c in pane)):
            first = next(mine)
            out.extend(function({c: first[c] for c in about}, itertools.chain([first], mine)))
            if len(out) >= 10_000:
                yield batch_of(out, schema)
                out = []
        yield batch_of(out, schema)

    rows = pane_rows(ks, strategy, assigner)
    return rows.repartition(*pane).sortWithinPartitions(*pane, "position").mapInArrow(fold, schema)
