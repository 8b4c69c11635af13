"""Session (merging) windows: in batch mode, and against a clock with lateness tested on the merged window.

Touching sessions are one session: a row joins when its time is at most ``gap`` away from the session's rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyclock.functions.arrow import batch_of, records
from keyclock.functions.merging import merge_all
from keyclock.functions.timeunits import floor_div, max_wm
from keyclock.model import KeyedStream
from keyclock.operators.scan import Fold, running
from keyclock.operators.watermark import clocked_rows, progress_rows
from keyclock.operators.windows import _MERGE, Measure, _check_lateness, count, expanded, merge_aggs, passed
from keyclock.strategy import WatermarkStrategy


def sessions(ks: KeyedStream, gap_ms: int, measures: list[Measure] | None = None) -> DataFrame:
    """Batch mode: (keys, ``window_start``, ``window_end``, measures), every row counted.

    Each time slice of a key is first reduced to its own sessions; only those pieces are then stitched across slices,
    so neither a busy key nor one endless session has to pass through one task.
    """
    if gap_ms <= 0:
        raise ValueError("the session gap must be positive")
    measures, results = expanded(measures or [count()])
    ks = ks.valid()
    keys, ts, gap = list(ks.keys), F.col(ks.ts), F.lit(gap_ms).cast("bigint")
    cut = floor_div(ts, ks.bucket_ms)
    inside = Window.partitionBy(*keys, "__s").orderBy(ks.ts)
    opens = F.lag(ks.ts).over(inside)
    pieces = (
        ks.df.withColumn("__s", cut)
        .withColumn("__new", F.when(ts - opens <= gap, 0).otherwise(1))
        .withColumn("__piece", F.sum("__new").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*keys, "__s", "__piece")
        .agg(
            F.min(ts).alias("__from"),
            F.max(ts).alias("__to"),
            *[_MERGE[m.kind](m.item()).alias(m.name) for m in measures],
        )
        .drop("__s", "__piece")
    )
    start = F.col("__from")
    piece_cut = floor_div(start, ks.bucket_ms)
    seen = running(pieces, keys, [start], piece_cut, [Fold("__reach", "max", F.col("__to"))], inclusive=False)
    fresh = F.col("__reach").isNull() | (start - F.col("__reach") > gap)
    # pieces are in time order, so the latest opening so far is the largest
    named = running(seen, keys, [start], piece_cut, [Fold("window_start", "max", F.when(fresh, start))])
    stitched = named.groupBy(*keys, "window_start").agg((F.max("__to") + gap).alias("window_end"), *merge_aggs(measures, pieces))
    return stitched.select(*keys, "window_start", "window_end", *[c.alias(n) for n, c in results.items()])


def _clock_items(ks: KeyedStream, strategy: WatermarkStrategy, gap_ms: int, lateness_ms: int, measures: list[Measure]) -> DataFrame:
    """Rows in arrival order with the clock before them, runs of plain ones already put together.

    Let M be the largest time before a row. The session around M is always alive (its end is beyond M, the clock is not),
    so a row within ``gap`` of M is taken by it whatever else happened. As long as such a row is also out of reach of
    every other session it can be added up with its neighbours: ``limit`` is how far other sessions can reach. No session
    reaches further than ``gap`` past the M at the start of the slice, the M left behind by a later jump, or a straggler
    since. What remains single are stragglers and rows that might bridge two sessions.

    A row that jumps so far ahead of M that the clock it leaves behind drops everything up to M begins an epoch
    (``opens``): nothing that lived before it can take part in anything after.
    """
    keys, gap = list(ks.keys), F.lit(gap_ms).cast("bigint")
    values = [m.item().alias(f"m{i}") for i, m in enumerate(measures)]
    slim = ks.df.select(*keys, F.col(ks.ts).alias("ts"), F.col(ks.arrival).alias("at"), F.col(ks.tie).alias("tie"), *values)
    order, ts, m = [F.col("at"), F.col("tie")], F.col("ts"), F.col("__m")
    cut = floor_div("at", max(ks.bucket_ms, 8 * gap_ms))
    rows = running(slim, keys, order, cut, [Fold("__m", "max", ts)], inclusive=False, keep_slice="o1")
    inside = Window.partitionBy(*keys, "o1").orderBy(*order)
    before, upto = [inside.rowsBetween(Window.unboundedPreceding, end) for end in (-1, 0)]
    behind = m.isNotNull() & (ts < m - gap)
    jump = m.isNull() | (ts > m + gap)
    opens = jump & F.coalesce(ts - m - gap - F.lit(strategy.bound_ms).cast("bigint") >= F.lit(lateness_ms).cast("bigint"), F.lit(False))
    limit = F.greatest(F.first("__m").over(upto) + gap, F.max(F.when(behind, ts + gap).when(jump, m + gap)).over(before))
    marked = rows.withColumns({"__jump": jump, "__opens": opens, "__single": ~jump & (behind | F.coalesce(ts <= limit, F.lit(False)))})
    marked = marked.withColumn("o2", F.sum((F.col("__single") | F.col("__jump")).cast("bigint")).over(upto))
    return (
        marked.groupBy(*keys, "o1", "o2", "__single")
        .agg(
            F.min("ts").alias("lo"),
            F.max("ts").alias("hi"),
            F.min("tie").alias("tie"),
            (F.min("__m") - F.lit(strategy.bound_ms + 1).cast("bigint")).alias("wm"),
            F.max(F.col("__opens").cast("bigint")).alias("opens"),
            *[_MERGE[m.kind](f"m{i}").alias(f"m{i}") for i, m in enumerate(measures)],
        )
        .withColumn("o3", (~F.col("__single")).cast("int"))
    )


def _plain_items(ks: KeyedStream, strategy: WatermarkStrategy, gap_ms: int, lateness_ms: int, measures: list[Measure]) -> DataFrame:
    """One item per row, for clocks that may run ahead of the times they saw. Where the clock has dropped all that came before a row,
    the row begins an epoch."""
    ts, at, tie = F.col(ks.ts), F.col(ks.arrival), F.col(ks.tie)
    rows = clocked_rows(ks, strategy)
    rows = running(rows, ks.keys, [at, tie], ks.bucket(), [Fold("__m", "max", ts)], inclusive=False)
    last = F.col("__m") + F.lit(gap_ms - 1).cast("bigint")
    opens = F.coalesce(passed(F.col("__wm"), last, lateness_ms), F.lit(False))
    return rows.select(
        *ks.keys,
        ts.alias("lo"),
        ts.alias("hi"),
        tie.alias("tie"),
        F.col("__wm").alias("wm"),
        opens.cast("bigint").alias("opens"),
        ks.bucket().alias("o1"),
        F.struct(at, tie).alias("o2"),
        F.lit(0).alias("o3"),
        *[m.item().alias(f"m{i}") for i, m in enumerate(measures)],
    )


def session_items(ks: KeyedStream, strategy: WatermarkStrategy, gap_ms: int, lateness_ms: int, measures: list[Measure]) -> DataFrame:
    """The items of every key with the ``epoch`` they belong to: (key, epoch) can be folded on its own."""
    compact = strategy.kind == "bounded" and strategy.emit == "record"
    items = (_clock_items if compact else _plain_items)(ks, strategy, gap_ms, lateness_ms, measures)
    order = [F.col("o1"), F.col("o2"), F.col("o3")]
    return running(items, ks.keys, order, F.col("o1"), [Fold("epoch", "sum", F.col("opens"))])


def session_firings(
    ks: KeyedStream,
    strategy: WatermarkStrategy,
    gap_ms: int,
    lateness_ms: int = 0,
    late: bool = False,
    measures: list[Measure] | None = None,
) -> DataFrame:
    """Sessions against per-key clocks: (keys, ``window_start``, ``window_end``, measures, ``wm``, ``refired``).

    A row late on its own is rescued by a live session it touches; sessions that it bridges become one, and so do their
    measures. With allowed lateness every row accepted into a session the clock has passed fires it again (``refired``).
    ``late=True`` returns (keys, tie) of refused rows instead. The rows of a key are folded epoch by epoch.
    """
    if gap_ms <= 0:
        raise ValueError("the session gap must be positive")
    _check_lateness(lateness_ms)
    if strategy.scope != "key":
        raise ValueError("session windows against a clock are keyed")
    ks = ks.timed(strategy).valid()
    measures, results = expanded(measures or [count()])
    named = [c.alias(n) for n, c in results.items()]
    if strategy.kind == "none":
        if late:
            return ks.df.select(*ks.keys, F.col(ks.tie).alias("tie")).limit(0)
        done = sessions(ks, gap_ms, measures)
        return done.select(*ks.keys, "window_start", "window_end", *named, max_wm().alias("wm"), F.lit(False).alias("refired"))
    items = session_items(ks, strategy, gap_ms, lateness_ms, measures)
    values = [f"m{i}" for i in range(len(measures))]
    items = items.select(*ks.keys, "epoch", "lo", "hi", "tie", "wm", "o1", "o2", "o3", *values)
    long = T.LongType()
    schema = T.StructType(
        [
            *[items.schema[k] for k in ks.keys],
            T.StructField("window_start", long),
            T.StructField("window_end", long),
            T.StructField("wm", long),
            T.StructField("refired", T.BooleanType()),
            T.StructField("tie", items.schema["tie"].dataType),
            *[T.StructField(v, items.schema[v].dataType) for v in values],
        ]
    )
    by = [*ks.keys, "epoch"]
    sorted_items = items.repartition(*by).sortWithinPartitions(*by, "o1", "o2", "o3").drop("o1", "o2", "o3")
    kinds = [m.kind for m in measures]
    out = sorted_items.mapInArrow(_session_fold(list(ks.keys), kinds, gap_ms, lateness_ms, schema), schema)
    if late:
        return out.where(F.col("window_start").isNull()).select(*ks.keys, "tie")
    fired = out.where(F.col("window_start").isNotNull()).drop("tie")
    steps = progress_rows(ks, strategy).select(*ks.keys, F.col("wm").alias("__step"))
    found = _first_step_at(fired.withColumn("__pos", F.col("window_end") - 1), steps, ks)
    wm = F.when(F.col("refired"), F.col("wm")).otherwise(F.coalesce("__step", max_wm()))
    found = found.withColumnsRenamed({v: m.name for v, m in zip(values, measures)})
    return found.select(*ks.keys, "window_start", "window_end", *named, wm.alias("wm"), "refired")


def _first_step_at(waiting: DataFrame, steps: DataFrame, ks: KeyedStream) -> DataFrame:
    """Add ``__step``, the key's smallest clock step at or after ``__pos``: a running minimum backwards in event time."""
    steps = steps.withColumns({"__pos": F.col("__step"), "__kind": F.lit(0)}).withColumnRenamed("__step", "__v")
    both = waiting.withColumn("__kind", F.lit(1)).unionByName(steps, allowMissingColumns=True)
    backwards = -F.col("__pos")
    seen = running(both, ks.keys, [backwards, F.col("__kind")], floor_div(backwards, ks.bucket_ms), [Fold("__step", "min", F.col("__v"))])
    return seen.where(F.col("__kind") == 1).drop("__kind", "__pos", "__v")


def session_step(live: list, lo: int, hi: int, values: list, wm: int | None, gap: int, lateness: int, kinds):
    """One item meets the live sessions ``[start, end, measure values, fired]`` of its key under the clock ``wm``.

    Returns (sessions fired by the clock, the refired session or () or None if the item is late, live sessions).
    """
    fired = []
    if wm is not None:
        fired = [s for s in live if not s[3] and s[1] - 1 <= wm]
        for s in fired:
            s[3] = True
        live = [s for s in live if s[1] - 1 + lateness > wm]
    merged, rest = [lo, hi + gap, values, False], []
    for s in live:
        if s[0] <= hi + gap and s[1] >= lo:
            same = s[0] <= lo and s[1] >= hi + gap
            merged = [min(s[0], merged[0]), max(s[1], merged[1]), merge_all(kinds, merged[2], s[2]), s[3] and same]
        else:
            rest.append(s)
    if wm is not None and merged[1] - 1 + lateness <= wm:
        return fired, None, live
    if wm is not None and merged[1] - 1 <= wm:
        merged[3] = True
        return fired, merged, [*rest, merged]
    return fired, (), [*rest, merged]


def _session_fold(keys: list[str], kinds: list[str], gap: int, lateness: int, schema: T.StructType):
    """Fold over items of one (key, epoch) after another; the state is the few sessions a clock has not passed yet."""
    names, values = schema.fieldNames(), [f"m{i}" for i in range(len(kinds))]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, live = None, []
        out: list[dict] = []

        def emit(key, s, refired, wm=None):
            out.append(dict(zip(names, (*key[:-1], s[0], s[1], wm, refired, None, *s[2]))))

        for rows in records(batches):
            for r in rows:
                key = (*[r[k] for k in keys], r["epoch"])
                if current is None or key != current:
                    for s in live:
                        if not s[3]:
                            emit(current, s, False)
                    current, live = key, []
                wm = r["wm"]
                fired, again, live = session_step(live, r["lo"], r["hi"], [r[v] for v in values], wm, gap, lateness, kinds)
                for done in fired:
                    emit(current, done, False)
                if again is None:
                    out.append({**dict(zip(keys, current)), "tie": r["tie"]})
                elif again:
                    emit(current, again, True, wm)
            yield batch_of(out, schema)
            out.clear()
        if current is not None:
            for s in live:
                if not s[3]:
                    emit(current, s, False)
        yield batch_of(out, schema)

    return fold
