"""Interval join with late side outputs, union by key, and a small stream known to all keys."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyclock.functions.timeunits import floor_div
from keyclock.model import KeyedStream
from keyclock.operators.scan import Fold, running
from keyclock.operators.watermark import clock_keys
from keyclock.strategy import WatermarkStrategy



@dataclass(frozen=True)
class IntervalJoin:
    joined: DataFrame
    late_left: DataFrame | None = None
    late_right: DataFrame | None = None


def _sided(ks: KeyedStream, side: str, key_names) -> DataFrame:
    """Common shape of both sides: keys, time, arrival, tie and the row as a struct."""
    return ks.valid().df.select(
        *[F.col(k).alias(n) for k, n in zip(ks.keys, key_names)],
        F.col(ks.ts).cast("bigint").alias("__ts"),
        F.col(ks.arrival).cast("bigint").alias("__at"),
        F.col(ks.tie).alias("__tie"),
        F.lit(side).alias("__side"),
        F.struct(*ks.df.columns).alias(side),
    )


def with_pair_clock(left: KeyedStream, right: KeyedStream, strategy: WatermarkStrategy) -> DataFrame:
    """Both sides in arrival order with ``__late``: the row is behind the slower of the two clocks of its key.

    A side that has not spoken yet has no clock, so nothing is late before both have.
    """
    keys = left.keys
    both = _sided(left, "left", keys).unionByName(_sided(right, "right", keys), allowMissingColumns=True)
    proposed = strategy.proposes(F.col("__ts"))
    folds = [Fold(f"__wm_{s}", "max", F.when(F.col("__side") == s, proposed)) for s in ("left", "right")]
    scope = clock_keys(left, strategy)
    order = [F.col("__at"), F.col("__tie"), F.col("__side")]
    rows = running(both, scope, order, floor_div("__at", left.bucket_ms), folds, inclusive=False)
    wl, wr = F.col("__wm_left"), F.col("__wm_right")
    late = wl.isNotNull() & wr.isNotNull() & (F.col("__ts") < F.least(wl, wr))
    return rows.withColumn("__late", late).drop("__wm_left", "__wm_right")


def interval_join(
    left: KeyedStream,
    right: KeyedStream,
    lower_ms: int,
    upper_ms: int,
    *,
    lower_exclusive: bool = False,
    upper_exclusive: bool = False,
    strategy: WatermarkStrategy | None = None,
    event_time: bool = True,
) -> IntervalJoin:
    """Pairs of equal key with ``left.ts + lower <= right.ts <= left.ts + upper``.

    The result has the keys and the two rows as structs ``left`` and ``right``. With a ``strategy`` rows arriving behind
    the clock leave through ``late_left`` / ``late_right`` instead of joining.

    Rows meet in time slices as long as the interval, so a key with many rows spreads over its slices and no row is
    compared with partners more than an interval away.
    """
    if not event_time:
        raise ValueError("interval joins work in event time only")
    if lower_ms is None or upper_ms is None:
        raise ValueError("both bounds are needed")
    if lower_ms > upper_ms:
        raise ValueError("the lower bound must not exceed the upper bound")
    if len(left.keys) != len(right.keys):
        raise ValueError("both sides need the same number of keys")
    keys = left.keys
    late_left = late_right = None
    if strategy is None:
        lhs, rhs = _sided(left, "left", keys), _sided(right, "right", keys)
    else:
        # bounds and lateness only concern rows with a time, and each side keeps just its own struct
        rows = with_pair_clock(left, right, strategy)
        lhs = rows.where((F.col("__side") == "left") & ~F.col("__late")).drop("right")
        rhs = rows.where((F.col("__side") == "right") & ~F.col("__late")).drop("left")
        late_left = rows.where((F.col("__side") == "left") & F.col("__late")).select("left.*")
        late_right = rows.where((F.col("__side") == "right") & F.col("__late")).select("right.*")

    width = max(upper_ms - lower_ms, 1)
    lo, hi = F.lit(lower_ms).cast("bigint"), F.lit(upper_ms).cast("bigint")
    ts = F.col("__ts")
    slices = F.sequence(floor_div(ts + lo, width), floor_div(ts + hi, width))
    lhs = lhs.select(*keys, ts.alias("__lt"), "left", F.explode(slices).alias("__slice"))
    rhs = rhs.select(*keys, ts.alias("__rt"), "right", floor_div(ts, width).alias("__slice"))
    gap = F.col("__rt") - F.col("__lt")
    near = (gap > lo if lower_exclusive else gap >= lo) & (gap < hi if upper_exclusive else gap <= hi)
    a, b = lhs.alias("a"), rhs.alias("b")
    same = F.col("a.__slice") == F.col("b.__slice")
    for k in keys:
        same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    joined = a.join(b, same & near).select(*[F.col(f"a.{k}").alias(k) for k in keys], "left", "right")
    return IntervalJoin(joined, late_left, late_right)


def connect(left: KeyedStream, right: KeyedStream) -> KeyedStream:
    """Two inputs as one keyed stream with a ``side`` column, for process functions that handle both."""
    if left.keys != right.keys or (left.ts, left.arrival, left.tie) != (right.ts, right.arrival, right.tie):
        raise ValueError("connected streams need the same key, time, arrival and tie columns")
    l_df = left.df.withColumn("side", F.lit("left"))
    r_df = right.df.withColumn("side", F.lit("right"))
    return left.with_df(l_df.unionByName(r_df, allowMissingColumns=True))


def union(first: KeyedStream, *others: KeyedStream) -> KeyedStream:
    df = first.df
    for other in others:
        df = df.unionByName(other.df)
    return first.with_df(df)



def join_rules(df: DataFrame, rules: DataFrame, on: list[str] | Column, how: str = "inner") -> DataFrame:
    """Join with a small stream that all keys know. Whether it is small enough to be broadcast is left to what Spark measures."""
    return df.join(rules, on, how)
