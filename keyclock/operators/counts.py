"""Count windows and count triggers: positions within a key instead of times; watermarks play no part in the former."""

from __future__ import annotations

from math import gcd

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyclock.functions.assigners import WindowAssigner
from keyclock.model import KeyedStream
from keyclock.operators.scan import Fold, running
from keyclock.operators.windows import Measure, _MERGE, classify_lateness, count, expanded, merge_aggs, plain_aggs
from keyclock.functions.timeunits import floor_div
from keyclock.strategy import WatermarkStrategy


def _one() -> Column:
    return F.lit(1).cast("bigint")


def numbered(ks: KeyedStream) -> DataFrame:
    """Rows with ``__n``, their position in the key's arrival order, from 1."""
    order = [F.col(ks.arrival), F.col(ks.tie)]
    return running(ks.df, ks.keys, order, ks.bucket(), [Fold("__n", "sum", _one())])


def count_windows(ks: KeyedStream, size: int, *aggs: Column) -> DataFrame:
    """Tumbling: every ``size`` rows of a key make a window (``window_no`` from 0). An incomplete rest never fires."""
    if size <= 0:
        raise ValueError("window size must be positive")
    return (
        numbered(ks)
        .withColumn("window_no", floor_div(F.col("__n") - 1, size))
        .groupBy(*ks.keys, "window_no")
        .agg(F.count("*").alias("elements"), *aggs)
        .where(F.col("elements") == size)
    )


def sliding_count_windows(ks: KeyedStream, size: int, slide: int, *aggs: Column | Measure) -> DataFrame:
    """After every ``slide`` rows of a key, the last ``size`` of them; ``window_no`` counts the firings from 0.

    Given measures, rows are added up per slice of the greatest common divisor of both, and only slices go to the
    firings they are in. Other aggregates (Columns) cannot be put together from parts, and copy rows instead."""
    if size <= 0 or slide <= 0:
        raise ValueError("window size and slide must be positive")
    measures, results = expanded([a for a in aggs if isinstance(a, Measure)])
    if len(results) < len(aggs) and results:
        raise ValueError("either measures or Columns")
    n, step = F.col("__n"), F.lit(slide).cast("bigint")
    if len(results) < len(aggs):
        rows, merged = numbered(ks).withColumn("__upto", n), [F.count("*").alias("elements"), *aggs]
        width, merged_names = 1, None
    else:
        width = gcd(size, slide)
        measures = [count("elements"), *measures]
        rows = (
            numbered(ks)
            .groupBy(*ks.keys, (floor_div(n - 1, width) * width + width).alias("__upto"))
            .agg(*plain_aggs(measures), F.max(n).alias("__n"))
        )
        merged, merged_names = merge_aggs(measures, rows), ["elements", *[c.alias(m) for m, c in results.items()]]
    # a slice that ends at position e is in the firings at multiples of slide from e on, and less than size after its begin
    upto = F.col("__upto")
    first = floor_div(upto + slide - 1, slide) * slide
    last = floor_div(upto - width + size, slide) * slide
    fired = (
        rows.where(first <= last)
        .select("*", F.explode(F.sequence(first, last, step)).alias("__end"))
        .groupBy(*ks.keys, "__end")
        .agg(F.max("__n").alias("__seen"), *merged)
        .where(F.col("__seen") == F.col("__end"))
        .withColumn("window_no", floor_div("__end", slide) - 1)
    )
    if merged_names is None:
        return fired.drop("__end", "__seen")
    return fired.select(*ks.keys, "window_no", *merged_names)


def count_triggered(
    ks: KeyedStream,
    strategy: WatermarkStrategy,
    assigner: WindowAssigner,
    every: int,
    measures: list[Measure] | None = None,
    lateness_ms: int = 0,
    purging: bool = False,
) -> DataFrame:
    """Time windows that fire after every ``every`` accepted rows instead of by the clock.

    Accumulating firings carry everything so far, ``purging`` ones only the rows since the last firing.
    """
    if every <= 0:
        raise ValueError("the trigger count must be positive")
    measures = measures or [count()]
    items = classify_lateness(ks, strategy, assigner, lateness_ms).where("window_status <> 'late'")
    group = [*ks.keys, "window_start", "window_end"]
    order = [F.col(ks.arrival), F.col(ks.tie)]
    cut = ks.bucket()
    folds = [Fold("__n", "sum", _one())]
    if not purging:
        folds += [Fold(f"__r{i}", m.fold_kind(), m.item()) for i, m in enumerate(measures)]
    rows = running(items, group, order, cut, folds)
    firing = floor_div(F.col("__n") - 1, every) + 1
    if not purging:
        fired = rows.where(F.col("__n") % every == 0)
        return fired.select(*group, firing.alias("firing_no"), *[F.col(f"__r{i}").alias(m.name) for i, m in enumerate(measures)])
    aggs = [_MERGE[m.kind](m.item()).alias(m.name) for m in measures]
    return (
        rows.groupBy(*group, firing.alias("firing_no"))
        .agg(F.count("*").alias("__c"), *aggs)
        .where(F.col("__c") == every)
        .drop("__c")
    )
