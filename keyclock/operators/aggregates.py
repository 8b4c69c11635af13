"""Window aggregates written by the user, with a merge function: two phases, like Spark's own.

Rows are added up inside the input partitions first; what crosses the network are accumulators, at most one per partition
and group at a time, so a busy key or window sends few rows. They are merged after the shuffle, one after another. Overlapping
windows share the accumulators of their slices. Late rows that fire a window again continue its accumulator.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyclock.functions.arrow import batch_of, records
from keyclock.functions.assigners import Sliding, WindowAssigner
from keyclock.functions.timeunits import min_wm
from keyclock.model import KeyedStream
from keyclock.operators.watermark import clocked_rows
from keyclock.operators.windows import _check_lateness, _items, _last, _spread, fired_by_clock, open_from, passed, windowed
from keyclock.strategy import WatermarkStrategy

#: accumulators that a task holds before it sends them on
HELD = 20_000


class Aggregate:
    """Override ``add``, ``merge`` and perhaps ``result``. Accumulators are dicts with the fields of ``state``, results dicts with those
    of ``out``. ``merge`` gets them in no particular order."""

    def __init__(self, state: T.StructType, out: T.StructType | None = None):
        self.state, self.out = state, out or state

    def add(self, acc: dict | None, row: dict) -> dict:
        """The accumulator with one more row; None at first."""
        raise NotImplementedError

    def merge(self, a: dict, b: dict) -> dict:
        raise NotImplementedError

    def result(self, acc: dict) -> dict:
        return acc


class Reduce(Aggregate):
    """``fn(a, b)`` over dicts of the columns of ``state``, which must not care about order."""

    def __init__(self, fn: Callable[[dict, dict], dict], state: T.StructType):
        super().__init__(state)
        self.fn, self.columns = fn, state.fieldNames()

    def add(self, acc, row):
        own = {c: row[c] for c in self.columns}
        return own if acc is None else self.fn(acc, own)

    def merge(self, a, b):
        return self.fn(a, b)


def added_up(rows: DataFrame, by: list[str], aggregate: Aggregate) -> DataFrame:
    """Phase one, without a shuffle: (by, ``acc``), a group perhaps more than once."""
    shape = T.StructType([*[rows.schema[c] for c in by], T.StructField("acc", aggregate.state)])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, dict] = {}

        def sent() -> pa.RecordBatch:
            out = batch_of([{**dict(zip(by, k)), "acc": acc} for k, acc in held.items()], shape)
            held.clear()
            return out

        for some in records(batches):
            for r in some:
                k = tuple(r[c] for c in by)
                held[k] = aggregate.add(held.get(k), r)
            if len(held) > HELD:
                yield sent()
        yield sent()

    return rows.mapInArrow(partial, shape)


def merged(partial: DataFrame, by: list[str], aggregate: Aggregate) -> DataFrame:
    """Phase two: (by, ``acc``), every group once."""
    shape = T.StructType([*[partial.schema[c] for c in by], T.StructField("acc", aggregate.state)])

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        rows = itertools.chain.from_iterable(records(batches))
        for k, mine in itertools.groupby(rows, key=lambda r: tuple(r[c] for c in by)):
            acc = next(mine)["acc"]
            for r in mine:
                acc = aggregate.merge(acc, r["acc"])
            out.append({**dict(zip(by, k)), "acc": acc})
            if len(out) >= 10_000:
                yield batch_of(out, shape)
                out = []
        yield batch_of(out, shape)

    return partial.select(*by, "acc").repartition(*by).sortWithinPartitions(*by).mapInArrow(final, shape)


def with_results(rows: DataFrame, aggregate: Aggregate) -> DataFrame:
    """``acc`` replaced by the fields of the result, which also replace columns of the same names."""
    names = [c for c in rows.columns if c not in ("acc", *aggregate.out.fieldNames())]
    shape = T.StructType([*[rows.schema[c] for c in names], *aggregate.out.fields])

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in records(batches):
            yield batch_of([{**r, **(aggregate.result(r["acc"]) if r["acc"] is not None else {})} for r in some], shape)

    return rows.mapInArrow(told, shape)


def window_accumulators(ks: KeyedStream, strategy: WatermarkStrategy, assigner: WindowAssigner, aggregate: Aggregate) -> DataFrame:
    """(keys, window, ``acc``) of the rows that came before the clock reached the window's last instant."""
    keys, window = list(ks.keys), ["window_start", "window_end"]
    if isinstance(assigner, Sliding) and assigner.overlaps and assigner.event_time:
        rows = clocked_rows(ks, strategy)
        first = open_from(assigner, ks.ts, 0)
        rows = rows.withColumns({"__slice": assigner.slice_start(ks.ts), "__first": first}).where(F.col("__first") <= assigner.last_end(ks.ts))
        parts = added_up(rows.drop("__wm", "__cand"), [*keys, "__slice", "__first"], aggregate)
        ends = F.sequence(F.col("__first"), assigner.last_end("__slice"), F.lit(assigner.slide_ms).cast("bigint"))
        parts = parts.select(*keys, "acc", F.explode(ends).alias("window_end"))
        parts = parts.withColumn("window_start", F.col("window_end") - F.lit(assigner.size_ms).cast("bigint"))
    else:
        on_time = _items(ks, assigner, lambda w: ~passed(F.col("__wm"), _last(w), 0), lambda w: w)
        parts = added_up(_spread(windowed(ks, strategy, assigner), on_time, *ks.df.columns), [*keys, *window], aggregate)
    return merged(parts, [*keys, *window], aggregate)


def aggregate_firings(
    ks: KeyedStream,
    strategy: WatermarkStrategy,
    assigner: WindowAssigner,
    aggregate: Aggregate,
    lateness_ms: int = 0,
    purging: bool = False,
) -> DataFrame:
    """All firings, as ``window_firings`` has them: (keys, window, ``firing_no``, result fields, ``wm``, ``fired_at``, ``result_ts``)."""
    _check_lateness(lateness_ms)
    ks = ks.timed(strategy).valid()
    first = fired_by_clock(ks, strategy, assigner, window_accumulators(ks, strategy, assigner, aggregate))
    pane = [*ks.keys, "window_start", "window_end"]
    if lateness_ms and strategy.kind != "none":
        first = _fired_again(ks, strategy, assigner, aggregate, first, lateness_ms, purging)
    else:
        first = first.withColumn("firing_no", F.lit(1).cast("bigint"))
    done = first.select(*pane, "firing_no", "acc", "wm", "fired_at", (F.col("window_end") - 1).alias("result_ts"))
    return with_results(done, aggregate).select(*pane, "firing_no", *aggregate.out.fieldNames(), "wm", "fired_at", "result_ts")


def _fired_again(ks, strategy, assigner, aggregate: Aggregate, first: DataFrame, lateness_ms: int, purging: bool) -> DataFrame:
    """The first firings, and one more for every row taken after it."""
    pane = [*ks.keys, "window_start", "window_end"]
    wm = F.col("__wm")
    again = _items(ks, assigner, lambda w: passed(wm, _last(w), 0) & ~passed(wm, _last(w), lateness_ms), lambda w: w)
    mine = F.struct(*ks.df.columns).alias("__row")
    late = _spread(windowed(ks, strategy, assigner), again, *ks.keys, mine, F.col(ks.arrival).alias("__at"), F.col(ks.tie).alias("__tie"), wm.alias("wm"))
    items = late.withColumn("fired_at", F.col("__at")).unionByName(first.withColumn("__at", min_wm()), allowMissingColumns=True)
    shape = T.StructType([*[items.schema[c] for c in pane], *[T.StructField(n, T.LongType()) for n in ("firing_no", "wm", "fired_at")], T.StructField("acc", aggregate.state)])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, acc, number = None, None, 0
        for some in records(batches):
            out = []
            for r in some:
                key = tuple(r[c] for c in pane)
                if key != current:
                    current, acc, number = key, None, 0
                if r["__row"] is None:
                    acc = r["acc"]
                else:
                    own = aggregate.add(None, r["__row"])
                    acc = own if acc is None or purging else aggregate.merge(acc, own)
                number += 1
                out.append({**dict(zip(pane, key)), "firing_no": number, "wm": r["wm"], "fired_at": r["fired_at"], "acc": acc})
            yield batch_of(out, shape)

    return items.repartition(*pane).sortWithinPartitions(*pane, "__at", "__tie").mapInArrow(fold, shape)
