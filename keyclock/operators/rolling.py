"""Keyed aggregates without windows: one result per input row, plus the latest value per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyclock.model import KeyedStream
from keyclock.operators.scan import Fold, running


def _order(ks: KeyedStream) -> list[Column]:
    return [F.col(ks.arrival), F.col(ks.tie)]


def rolling_reduce(ks: KeyedStream, *folds: Fold) -> DataFrame:
    """Running folds side by side: a reduce whose pieces are sums, minima and maxima of expressions."""
    return running(ks.df, ks.keys, _order(ks), ks.bucket(), list(folds))


def rolling(ks: KeyedStream, kind: str, column: str, out: str = "running") -> DataFrame:
    """Rolling ``sum``, ``min`` or ``max`` of one column: (keys, arrival, tie, column, ``running``)."""
    if kind not in ("sum", "min", "max"):
        raise ValueError("kind is sum, min or max")
    slim = ks.with_df(ks.df.select(*dict.fromkeys([*ks.keys, ks.arrival, ks.tie, column])))
    return rolling_reduce(slim, Fold(out, kind, F.col(column)))


def rolling_by(ks: KeyedStream, kind: str, column: str, tie_rule: str = "first", element: list[str] | None = None) -> DataFrame:
    """Rolling ``min``/``max`` by a column, giving the whole element (``best``, a struct) after every row.

    Among equal values the ``first`` (default) or ``last`` arrived element wins.
    """
    if kind not in ("min", "max") or tie_rule not in ("first", "last"):
        raise ValueError("kind is min or max; tie_rule is first or last")
    element = element or ks.df.columns
    sign = F.lit(1 if (kind == "min") == (tie_rule == "first") else -1).cast("bigint")
    x = F.col(column)
    ranked = F.struct(
        x.alias("x"),
        (F.col(ks.arrival) * sign).alias("a"),
        (F.col(ks.tie) * sign).alias("t"),
        F.struct(*element).alias("e"),
    )
    slim = ks.with_df(ks.df.select(*dict.fromkeys([*ks.keys, ks.arrival, ks.tie, column, *element])))
    rows = rolling_reduce(slim, Fold("__best", kind, F.when(x.isNotNull(), ranked)))
    return rows.select(*ks.keys, ks.arrival, ks.tie, F.col("__best.e").alias("best"))


def latest_state(ks: KeyedStream, *columns: str) -> DataFrame:
    """The last arrived row of every key: the value an outside reader would see."""
    columns = columns or tuple(c for c in ks.df.columns if c not in ks.keys)
    newest = F.max_by(F.struct(*columns), F.struct(ks.arrival, ks.tie)).alias("__latest")
    return ks.df.groupBy(*ks.keys).agg(newest).select(*ks.keys, "__latest.*")


def reduced_state(ks: KeyedStream, *aggs: Column) -> DataFrame:
    """The reduced value of every key at the end of the input."""
    return ks.df.groupBy(*ks.keys).agg(*aggs)
