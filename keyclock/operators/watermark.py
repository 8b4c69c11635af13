"""Clocks: the watermark before and after every row, progress, idleness, several sources, alignment."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keyclock.functions.timeunits import floor_div, min_wm
from keyclock.model import KeyedStream
from keyclock.operators.scan import Fold, running
from keyclock.strategy import WatermarkStrategy


def clock_keys(ks: KeyedStream, strategy: WatermarkStrategy) -> tuple[str, ...]:
    return ks.keys if strategy.scope == "key" else ()


def tick_of(ks: KeyedStream, strategy: WatermarkStrategy):
    return floor_div(ks.arrival, strategy.tick_ms)


def clocked_rows(ks: KeyedStream, strategy: WatermarkStrategy) -> DataFrame:
    """Rows plus ``__wm`` (clock before the row, null if none yet) and ``__cand`` (what the row proposes)."""
    ks = ks.timed(strategy).valid()
    if strategy.kind == "class":
        from keyclock.streaming.process import clock_by_class

        return clock_by_class(ks, strategy)
    rows = ks.df.withColumn("__cand", strategy.proposes(F.col(ks.ts)))
    if strategy.kind == "none":
        return rows.withColumn("__wm", F.lit(None).cast("bigint"))
    keys = clock_keys(ks, strategy)
    fold = Fold("__wm", "max", F.col("__cand"))
    order = [F.col(ks.arrival), F.col(ks.tie)]
    if strategy.emit == "record":
        return running(rows, keys, order, ks.bucket(), [fold], inclusive=False)
    return running(rows, keys, order, ks.bucket(), [fold], unit=tick_of(ks, strategy))


def assign_watermarks(ks: KeyedStream, strategy: WatermarkStrategy) -> DataFrame:
    """Every row with ``wm_before``, the clock it meets, and ``wm_after``, the clock it leaves behind.

    Assigning again replaces both columns: clocks are never inherited. In tick mode a row's time is not visible before
    the next tick, so ``wm_after`` equals ``wm_before`` and progress is read from :func:`watermark_progress`.
    """
    ks = ks.with_df(ks.df.drop("wm_before", "wm_after"))
    rows = clocked_rows(ks, strategy)
    after = F.greatest("__wm", "__cand") if strategy.emit == "record" else F.col("__wm")
    return rows.withColumns(
        {"wm_before": F.coalesce("__wm", min_wm()), "wm_after": F.coalesce(after, min_wm())}
    ).drop("__wm", "__cand")


def progress_rows(ks: KeyedStream, strategy: WatermarkStrategy, rows: DataFrame | None = None) -> DataFrame:
    """Clock steps: (clock keys, ``arrival``, ``wm_before`` or null, ``wm``), one per strict increase."""
    keys = clock_keys(ks, strategy)
    if strategy.kind == "class" and strategy.emit == "tick":
        from keyclock.streaming.process import clock_by_class

        return clock_by_class(ks.timed(strategy).valid(), strategy, steps=True)
    if strategy.emit == "record":
        rows = clocked_rows(ks, strategy) if rows is None else rows
        return rows.where(F.col("__cand").isNotNull() & (F.col("__wm").isNull() | (F.col("__cand") > F.col("__wm")))).select(
            *keys, F.col(ks.arrival).alias("arrival"), F.col("__wm").alias("wm_before"), F.col("__cand").alias("wm")
        )
    ks = ks.timed(strategy).valid()
    ticks = (
        ks.df.withColumn("__tick", tick_of(ks, strategy))
        .withColumn("__cand", strategy.proposes(F.col(ks.ts)))
        .groupBy(*keys, "__tick")
        .agg(F.max("__cand").alias("__cand"))
    )
    # one row per (key, tick) by now, so a plain window per key is small
    earlier = Window.partitionBy(*keys).orderBy("__tick").rowsBetween(Window.unboundedPreceding, -1)
    return (
        ticks.withColumn("__wm", F.max("__cand").over(earlier))
        .where(F.col("__cand").isNotNull() & (F.col("__wm").isNull() | (F.col("__cand") > F.col("__wm"))))
        .select(
            *keys,
            ((F.col("__tick") + 1) * F.lit(strategy.tick_ms).cast("bigint")).alias("arrival"),
            F.col("__wm").alias("wm_before"),
            F.col("__cand").alias("wm"),
        )
    )


def watermark_progress(ks: KeyedStream, strategy: WatermarkStrategy) -> DataFrame:
    """Emitted watermarks: strictly increasing per clock, with the arrival time of each step.

    This is also the START log of the latency reports.
    """
    return progress_rows(ks, strategy).withColumn("wm_before", F.coalesce("wm_before", min_wm()))


def final_watermarks(ks: KeyedStream, strategy: WatermarkStrategy) -> DataFrame:
    """The last watermark of every clock, as emitted when the input finishes."""
    ks = ks.timed(strategy).valid()
    keys = clock_keys(ks, strategy)
    return ks.df.groupBy(*keys).agg(F.max(strategy.proposes(F.col(ks.ts))).alias("wm"))


def idleness_events(ks: KeyedStream, timeout_ms: int) -> DataFrame:
    """``idle`` / ``active`` toggles per key: (keys, ``at``, ``status``).

    A key is idle from ``last arrival + timeout`` when its next arrival is strictly later than that, or never comes.
    """
    if timeout_ms <= 0:
        raise ValueError("the idle timeout must be positive")
    arrival = F.col(ks.arrival)
    wait = F.lit(timeout_ms).cast("bigint")
    slim = ks.df.select(*ks.keys, ks.arrival, ks.tie)
    seen = running(slim, ks.keys, [arrival, F.col(ks.tie)], ks.bucket(), [Fold("__prev", "max", arrival)], inclusive=False)
    toggles = seen.where(arrival - F.col("__prev") > wait).select(
        *ks.keys,
        F.inline(
            F.array(
                F.struct((F.col("__prev") + wait).alias("at"), F.lit("idle").alias("status")),
                F.struct(arrival.alias("at"), F.lit("active").alias("status")),
            )
        ),
    )
    trailing = slim.groupBy(*ks.keys).agg((F.max(arrival) + wait).alias("at")).withColumn("status", F.lit("idle"))
    return toggles.unionByName(trailing)


def status_log(ks: KeyedStream, strategy: WatermarkStrategy) -> DataFrame:
    """Watermark steps and idle/active toggles in one table: (keys, ``at``, ``status``, ``wm``)."""
    steps = watermark_progress(ks, strategy).select(
        *ks.keys, F.col("arrival").alias("at"), F.lit("watermark").alias("status"), "wm"
    )
    if strategy.idle_ms is None:
        return steps
    toggles = idleness_events(ks, strategy.idle_ms).withColumn("wm", F.lit(None).cast("bigint"))
    return steps.unionByName(toggles)
