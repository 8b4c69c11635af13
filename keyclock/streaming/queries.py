"""Streams that Spark's own operators already express: stream-level clock, interval join, latest and rolling state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyclock.functions.timeunits import ms_to_timestamp
from keyclock.model import KeyedStream
from keyclock.streaming.process import IdleWatch, process_stream
from keyclock.strategy import WatermarkStrategy


def _interval(ms: int) -> str:
    return f"{ms} milliseconds"


def with_stream_clock(ks: KeyedStream, bound_ms: int) -> DataFrame:
    """One clock for the whole stream: Spark's watermark on ``event_time``. Late rows are counted by Spark's metrics."""
    return ks.valid().df.withColumn("event_time", ms_to_timestamp(F.col(ks.ts))).withWatermark("event_time", _interval(bound_ms))


def stream_level_windows(ks: KeyedStream, bound_ms: int, size_ms: int, slide_ms: int | None = None, *aggs: Column) -> DataFrame:
    """The baseline to compare keyed clocks with: Spark windows under the stream-level watermark (append mode)."""
    rows = with_stream_clock(ks, bound_ms)
    window = F.window("event_time", _interval(size_ms), _interval(slide_ms or size_ms))
    out = rows.groupBy(*ks.keys, window).agg(F.count("*").alias("elements"), *aggs)
    start, end = [F.unix_millis(f"window.{side}").alias(f"window_{side}") for side in ("start", "end")]
    return out.select(start, end, *[c for c in out.columns if c != "window"])


def stream_arrival_windows(ks: KeyedStream, size_ms: int, slide_ms: int | None = None, *aggs: Column) -> DataFrame:
    """Windows over the time a row is processed at; nothing is ever late."""
    rows = ks.df.withColumn("event_time", F.current_timestamp()).withWatermark("event_time", "0 seconds")
    window = F.window("event_time", _interval(size_ms), _interval(slide_ms or size_ms))
    out = rows.groupBy(*ks.keys, window).agg(F.count("*").alias("elements"), *aggs)
    start, end = [F.unix_millis(f"window.{side}").alias(f"window_{side}") for side in ("start", "end")]
    return out.select(start, end, *[c for c in out.columns if c != "window"])


def stream_interval_join(
    left: KeyedStream, right: KeyedStream, lower_ms: int, upper_ms: int, bound_ms: int, lower_exclusive=False, upper_exclusive=False
) -> DataFrame:
    """Interval join of two streams, null keys equal as in batches; both watermarks and the time condition let Spark drop old rows from its state."""

    def side(ks, name):
        rows = ks.valid().df
        return rows.select(
            *[F.col(k).alias(f"{name}_{k}") for k in ks.keys],
            ms_to_timestamp(F.col(ks.ts)).alias(f"{name}_time"),
            F.struct(*rows.columns).alias(name),
        ).withWatermark(f"{name}_time", _interval(bound_ms))

    a, b = side(left, "left"), side(right, "right")
    lo = F.col("left_time") + F.expr(f"interval {lower_ms} milliseconds")
    hi = F.col("left_time") + F.expr(f"interval {upper_ms} milliseconds")
    t = F.col("right_time")
    near = (t > lo if lower_exclusive else t >= lo) & (t < hi if upper_exclusive else t <= hi)
    for lk, rk in zip(left.keys, right.keys):
        near = F.col(f"left_{lk}").eqNullSafe(F.col(f"right_{rk}")) & near
    return a.join(b, near).select(*[F.col(f"left_{k}").alias(k) for k in left.keys], "left", "right")


def latest_stream(ks: KeyedStream, *columns: str) -> DataFrame:
    """Latest row per key as a running table (update or complete mode); a memory or table sink makes it queryable."""
    columns = columns or tuple(c for c in ks.df.columns if c not in ks.keys)
    newest = F.max_by(F.struct(*columns), F.struct(ks.arrival, ks.tie)).alias("latest")
    return ks.df.groupBy(*ks.keys).agg(newest).select(*ks.keys, "latest.*")


def rolling_stream(ks: KeyedStream, *aggs: Column) -> DataFrame:
    """Running aggregates per key, one row per changed key and micro-batch (update mode)."""
    return ks.df.groupBy(*ks.keys).agg(*aggs)


def idle_stream(ks: KeyedStream, timeout_ms: int) -> DataFrame:
    """``idle`` / ``active`` rows by processing time: (keys, ``at``, ``status``). Stop the query by hand."""
    keys = [ks.df.schema[k] for k in ks.keys]
    shape = T.StructType([*keys, T.StructField("at", T.LongType()), T.StructField("status", T.StringType())])
    return process_stream(ks, WatermarkStrategy.none(), IdleWatch(timeout_ms, *ks.keys), shape, processing_timers=True).drop("tag")
