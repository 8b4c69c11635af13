"""Exact interpolated quantiles that spill and spread: no per-group value map in one aggregation buffer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyclock.functions.joining import join_same
from keyclock.operators.scan import Fold, running


def _magnitude(x: Column) -> Column:
    """A coarse, order-keeping slice of a number: about one percent wide, whatever its scale."""
    size = F.floor(F.log(F.abs(x) + F.lit(1e-12)) * 100) + 3000
    return F.when(x == 0, 0).otherwise(F.signum(x) * size).cast("bigint")


def exact_quantiles(df: DataFrame, column: str, names: dict[str, float], by: tuple[str, ...] = (), extremes: bool = False) -> DataFrame:
    """(by, one column per name): the same linear interpolation as ``percentile``; with ``extremes`` also ``max``, ``min`` and ``avg``.

    Equal values are counted first; a running count over values, sliced by magnitude, then tells which values sit at the
    wanted positions.
    """
    keys = list(by)
    x = F.col("__x")
    counts = (
        df.select(*by, F.col(column).cast("double").alias("__x"))
        .where(x.isNotNull())
        .groupBy(*keys, "__x")
        .agg(F.count("*").alias("__c"))
    )
    ranked = running(counts, keys, [x], _magnitude(x), [Fold("__cum", "sum", F.col("__c"))])
    more = {"max": F.max(x), "min": F.min(x), "avg": F.sum(x * F.col("__c")) / F.sum("__c")} if extremes else {}
    sizes = counts.groupBy(*keys).agg(F.sum("__c").alias("__n"), *[c.alias(n) for n, c in more.items()])
    if keys:
        both = join_same(ranked, sizes, keys)
    else:
        both = ranked.withColumn("__all", sizes.select(F.struct("*")).scalar()).select("*", "__all.*").drop("__all")
    first, last = F.col("__cum") - F.col("__c"), F.col("__cum") - 1
    found = {}
    wanted = F.lit(False)
    for i, q in enumerate(names.values()):
        place = (F.col("__n") - 1) * F.lit(float(q))
        for side, at in (("lo", F.floor(place)), ("hi", F.ceil(place))):
            here = (first <= at) & (at <= last)
            wanted = wanted | here
            found[f"__{side}{i}"] = F.max(F.when(here, x))
    hits = both.where(wanted).groupBy(*keys, "__n", *more).agg(*[c.alias(n) for n, c in found.items()])
    out = {}
    for i, (name, q) in enumerate(names.items()):
        place = (F.col("__n") - 1) * F.lit(float(q))
        lo, hi = F.col(f"__lo{i}"), F.col(f"__hi{i}")
        out[name] = lo + (hi - lo) * (place - F.floor(place))
    return hits.select(*by, *more, *[c.alias(n) for n, c in out.items()])
