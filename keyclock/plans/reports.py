"""Reports over firings and logs: accuracy, latency, state size. All experiments of a directory go through one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyclock.functions.joining import join_same
from keyclock.functions.assigners import WindowAssigner
from keyclock.functions.timeunits import floor_div
from keyclock.model import KeyedStream
from keyclock.operators.quantiles import exact_quantiles
from keyclock.operators.windows import count, entries, panes
from keyclock.strategy import WatermarkStrategy

QUANTILES = {"p90": 0.9, "p95": 0.95, "p99": 0.99}


# --- accuracy -------------------------------------------------------------------------------------------------------


def accuracy_report(firings: DataFrame, by: str = "experiment") -> DataFrame:
    """Elements that made it into a fired window, per experiment."""
    return firings.groupBy(by).agg(F.sum("elements").alias("processed_elements"))


def loss_report(counts: DataFrame, by: str = "experiment") -> DataFrame:
    """Kept and lost share per experiment, from per-key ``total`` and ``late`` counts."""
    return counts.groupBy(by).agg(F.sum("total").alias("total"), F.sum("late").alias("late")).select(
        by,
        "total",
        "late",
        F.round(1 - F.col("late") / F.col("total"), 6).alias("accuracy"),
        F.round(F.col("late") / F.col("total"), 6).alias("loss"),
    )


# --- latency --------------------------------------------------------------------------------------------------------


def _seconds(end: str, start: str) -> Column:
    return ((F.col(end) - F.col(start)) / F.lit(1_000_000_000)).cast("double")


def latency_keyed(start: DataFrame, end: DataFrame, *by: str) -> DataFrame:
    """Seconds from the first start to the last end of every (watermark, key)."""
    on = [*by, "watermark", "key"]
    first = start.groupBy(*on).agg(F.min("system_time").alias("__start"))
    last = end.groupBy(*on).agg(F.max("system_time").alias("__end"))
    return join_same(first, last, on).select(*on, _seconds("__end", "__start").alias("latency"))


def latency_envelope(latency: DataFrame, *by: str) -> DataFrame:
    """Largest and smallest latency over the keys, per watermark."""
    return latency.groupBy(*by, "watermark").agg(
        F.max("latency").alias("max_latency"), F.min("latency").alias("min_latency")
    )


def latency_stream(start: DataFrame, end: DataFrame, *by: str) -> DataFrame:
    """One clock: seconds from every start record to the last end of its watermark."""
    on = [*by, "watermark"]
    last = end.groupBy(*on).agg(F.max("system_time").alias("__end"))
    return join_same(start, last, on).select(*on, "system_time", _seconds("__end", "system_time").alias("latency"))


def latency_summary(latency: DataFrame, column: str = "latency", *by: str) -> DataFrame:
    """Maximum, minimum, mean and the 90/95/99 % quantiles (interpolated exactly), rounded to microseconds."""
    out = exact_quantiles(latency, column, QUANTILES, by, extremes=True)
    return out.select(*by, *[F.round(n, 6).alias(n) for n in ("max", "min", "avg", *QUANTILES)])


def latency_outliers(latency: DataFrame, column: str = "latency", *by: str) -> DataFrame:
    """Rows outside the quartiles by more than one and a half times their distance."""
    quartiles = exact_quantiles(latency, column, {"__q1": 0.25, "__q3": 0.75}, by)
    if by:
        rows = join_same(latency, quartiles, list(by))
    else:
        rows = latency.withColumn("__q", quartiles.select(F.struct("__q1", "__q3")).scalar()).select("*", "__q.*")
    reach = (F.col("__q3") - F.col("__q1")) * 1.5
    outside = (F.col(column) < F.col("__q1") - reach) | (F.col(column) > F.col("__q3") + reach)
    return rows.where(outside).select(*latency.columns)


def latency_summary_full(latency: DataFrame, column: str, *by: str) -> DataFrame:
    """The summary with its outliers as a sorted list, as in the result files. The list is as long as there are
    outliers; for large logs take :func:`latency_summary` and the rows of :func:`latency_outliers`."""
    summary = latency_summary(latency, column, *by)
    listed = latency_outliers(latency, column, *by).groupBy(*by).agg(F.array_sort(F.collect_list(column)).alias("outliers"))
    none = F.array().cast("array<double>")
    if by:
        return join_same(summary, listed, list(by), "left").withColumn("outliers", F.coalesce("outliers", none))
    return summary.withColumn("outliers", F.coalesce(listed.scalar(), none))


def latency_series(stream: DataFrame, envelope: DataFrame, *by: str) -> DataFrame:
    """Chart-ready long table: (by, watermark, ``series``, ``value``) for the stream clock and both keyed extremes."""
    base = stream.select(*by, "watermark", F.lit("stream").alias("series"), F.col("latency").alias("value"))
    pairs = F.array(
        F.struct(F.lit("keyed_max").alias("series"), F.col("max_latency").alias("value")),
        F.struct(F.lit("keyed_min").alias("series"), F.col("min_latency").alias("value")),
    )
    return base.unionByName(envelope.select(*by, "watermark", F.inline(pairs)))


# --- state ----------------------------------------------------------------------------------------------------------


def state_size(log: DataFrame, *by: str) -> DataFrame:
    """Total state over all keys at every logged time."""
    return log.groupBy(*by, "ts").agg(F.sum("size").alias("size"))


def state_diff(
    keyed: DataFrame, stream: DataFrame, *by: str, limit: int | None = None, exempt: tuple[str, str] | None = None, how: str = "full_outer"
) -> DataFrame:
    """Keyed minus stream-level state at every time: (by, ``ts``, ``size_keyed``, ``size_stream``, ``difference``).

    ``limit`` keeps times up to it; ``exempt=(column, value)`` names rows the limit does not apply to.
    """
    on = [*by, "ts"]
    joined = keyed.withColumnRenamed("size", "size_keyed").join(stream.withColumnRenamed("size", "size_stream"), on, how)
    return state_pair_diff(joined.fillna(0, ["size_keyed", "size_stream"]), *by, limit=limit, exempt=exempt)


def state_pair_diff(pairs: DataFrame, *by: str, limit: int | None = None, exempt: tuple[str, str] | None = None) -> DataFrame:
    """The same for a file that already holds both sizes."""
    if limit is not None:
        within = F.col("ts") <= limit
        pairs = pairs.where(within if exempt is None else within | (F.col(exempt[0]) == exempt[1]))
    return pairs.select(
        *by, "ts", "size_keyed", "size_stream", (F.col("size_keyed") - F.col("size_stream")).alias("difference")
    )


def state_timeline(
    ks: KeyedStream, strategy: WatermarkStrategy, assigner: WindowAssigner, tick_ms: int, lateness_ms: int = 0
) -> DataFrame:
    """State log of a replay: (keys, ``ts``, ``size``), buffered elements per key after every arrival tick with a change.

    A row enters with every window that accepts it; a window leaves when the clock passes its end plus the allowed
    lateness. Windows still open at the end of input stay in the log.
    """
    tick = F.lit(tick_ms).cast("bigint")
    entered = entries(ks, strategy, assigner, lateness_ms).where("entered > 0")
    entered = entered.select(*ks.keys, floor_div(ks.arrival, tick_ms).alias("__t"), F.col("entered").alias("__d"))
    cleared = panes(ks, strategy, assigner, [count("__n")], delay_ms=lateness_ms).where("fired_at is not null")
    left = cleared.select(*ks.keys, floor_div("fired_at", tick_ms).alias("__t"), (-F.col("__n")).alias("__d"))
    changes = entered.unionByName(left).groupBy(*ks.keys, "__t").agg(F.sum("__d").alias("__d"))
    # one row per key and tick: a time axis per key, not rows
    so_far = Window.partitionBy(*ks.keys).orderBy("__t")
    return changes.select(*ks.keys, (F.col("__t") * tick).alias("ts"), F.sum("__d").over(so_far).alias("size"))
