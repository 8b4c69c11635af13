"""Epoch-millisecond helpers that do not depend on the session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: "no watermark yet" and "end of event time" (fixed values)
MIN_WM = -(2**63)
MAX_WM = 2**63 - 1


def min_wm() -> Column:
    return F.lit(MIN_WM).cast("bigint")


def max_wm() -> Column:
    return F.lit(MAX_WM).cast("bigint")


def floor_div_sql(x: str, n: int) -> str:
    """SQL text of a division rounding towards minus infinity; SQL ``div`` alone truncates."""
    return f"((({x}) - pmod({x}, {n}L)) div {n}L)"


def floor_div(x: Column | str, n: int) -> Column:
    """The same for a Column, or shorter for a column name."""
    if isinstance(x, str):
        return F.expr(floor_div_sql(f"`{x}`", n))
    x = x.cast("bigint")
    step = F.lit(n).cast("bigint")
    return F.call_function("div", x - F.pmod(x, step), step)


def epoch_ms(col: Column, dtype: T.DataType) -> Column:
    """Milliseconds since the epoch, for bigint (kept), timestamp, timestamp_ntz and date columns."""
    if isinstance(dtype, T.IntegralType):
        return col.cast("bigint")
    if isinstance(dtype, T.TimestampNTZType):
        # a wall-clock difference, so no session zone gets involved
        since = col - F.expr("timestamp_ntz'1970-01-01 00:00:00'")
        micros = (since.cast("interval second").cast("decimal(20,6)") * 1000000).cast("bigint")
        return floor_div(micros, 1000)
    if isinstance(dtype, T.TimestampType):
        return floor_div(F.unix_micros(col), 1000)
    if isinstance(dtype, T.DateType):
        return F.unix_date(col).cast("bigint") * F.lit(86_400_000).cast("bigint")
    raise TypeError(f"cannot read event time from {dtype.simpleString()}")


def ms_to_timestamp(col: Column) -> Column:
    return F.timestamp_millis(col)


def ns_to_timestamp(col: Column) -> Column:
    """Nanosecond wall-clock readings of the latency logs as timestamps (microseconds kept)."""
    return F.timestamp_micros(floor_div(col, 1000))
