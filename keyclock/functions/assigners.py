"""Window assigners: an event time in, the windows it belongs to out, all as Columns.

Windows are half-open ``[window_start, window_end)`` in epoch milliseconds and their last instant is ``window_end - 1``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from math import gcd

from pyspark.sql import Column
from pyspark.sql import functions as F

from keyclock.functions.timeunits import floor_div_sql

#: beyond this overlap a row's windows are handled as one array instead of a list of expressions
MAX_LISTED = 16
WINDOW_TYPE = "array<struct<window_start:bigint,window_end:bigint>>"


def _span(start: Column, size: int) -> Column:
    return F.struct(start.alias("window_start"), (start + F.lit(size).cast("bigint")).alias("window_end"))


def _span_sql(ts: str, step: int, offset: int, back: int, size: int) -> Column:
    start = f"(`{ts}` - pmod(`{ts}` - {offset}L, {step}L) - {back}L)"
    return F.expr(f"named_struct('window_start', {start}, 'window_end', {start} + {size}L)")


def _grid_sql(wm: str, step: int, phase: int) -> Column:
    """The largest ``phase + i * step`` up to ``wm + 1``."""
    return F.expr(f"{floor_div_sql(f'{wm} + 1L - {phase}L', step)} * {step}L + {phase}L")


class WindowAssigner:
    """Base class. ``event_time=False`` marks windows over the arrival clock, which are never late."""

    event_time = True
    #: windows end on a regular grid, so a clock can be compared with them cell by cell
    on_grid = True

    def windows(self, ts: Column) -> Column:
        """All windows of a row as one array."""
        raise NotImplementedError

    def candidates(self, ts: str) -> list[tuple[Column, Column]] | None:
        """The same as a fixed list of (window, does the row belong to it), which stays inside generated code."""
        return None

    def covers_every_row(self) -> bool:
        """Every row lies inside at least one of its own windows."""
        return True

    def end_reached(self, wm: str) -> Column:
        """The latest possible window end that a watermark (SQL text) completes (``end - 1 <= wm``)."""
        raise NotImplementedError

    @property
    def step(self) -> int | None:
        return None


@dataclass(frozen=True)
class Tumbling(WindowAssigner):
    size_ms: int
    offset_ms: int = 0
    event_time: bool = True

    def __post_init__(self):
        if self.size_ms <= 0:
            raise ValueError("window size must be positive")

    @property
    def step(self):
        return self.size_ms

    def windows(self, ts: Column) -> Column:
        shifted = ts - F.lit(self.offset_ms).cast("bigint")
        return F.array(_span(ts - F.pmod(shifted, F.lit(self.size_ms).cast("bigint")), self.size_ms))

    def candidates(self, ts: str):
        return [(_span_sql(ts, self.size_ms, self.offset_ms, 0, self.size_ms), F.lit(True))]

    def end_reached(self, wm: str) -> Column:
        return _grid_sql(wm, self.size_ms, self.offset_ms)


@dataclass(frozen=True)
class Sliding(WindowAssigner):
    size_ms: int
    slide_ms: int
    offset_ms: int = 0
    event_time: bool = True

    def __post_init__(self):
        if self.size_ms <= 0 or self.slide_ms <= 0:
            raise ValueError("window size and slide must be positive")

    @property
    def step(self):
        return self.slide_ms

    @property
    def slice_ms(self) -> int:
        """Windows begin and end on multiples of this, so what lies between two of them is in the same windows."""
        return gcd(self.size_ms, self.slide_ms)

    @property
    def overlaps(self) -> bool:
        return self.slide_ms < self.size_ms

    def slice_start(self, ts: str) -> Column:
        return F.expr(f"`{ts}` - pmod(`{ts}` - {self.offset_ms}L, {self.slice_ms}L)")

    def first_end(self, ts: str) -> Column:
        """The end of the oldest window that a time (or the slice that begins there) is in."""
        phase = (self.offset_ms + self.size_ms) % self.slide_ms
        return F.expr(f"{floor_div_sql(f'`{ts}` - {phase}L', self.slide_ms)} * {self.slide_ms}L + {phase + self.slide_ms}L")

    def last_end(self, ts: str) -> Column:
        """The end of the newest one."""
        return F.expr(f"`{ts}` - pmod(`{ts}` - {self.offset_ms}L, {self.slide_ms}L) + {self.size_ms}L")

    def covers_every_row(self) -> bool:
        return self.slide_ms <= self.size_ms

    def _spans(self, ts: Column) -> list[Column]:
        slide = F.lit(self.slide_ms).cast("bigint")
        newest = ts - F.pmod(ts - F.lit(self.offset_ms).cast("bigint"), slide)
        return [_span(newest - slide * i, self.size_ms) for i in range(-(-self.size_ms // self.slide_ms))]

    def windows(self, ts: Column) -> Column:
        return F.filter(F.array(*self._spans(ts)), lambda w: w["window_end"] > ts)

    def candidates(self, ts: str):
        overlap = -(-self.size_ms // self.slide_ms)
        if overlap > MAX_LISTED:
            return None
        spans = [_span_sql(ts, self.slide_ms, self.offset_ms, i * self.slide_ms, self.size_ms) for i in range(overlap)]
        if self.size_ms % self.slide_ms == 0:
            return [(w, F.lit(True)) for w in spans]
        return [(w, w["window_end"] > F.col(ts)) for w in spans]

    def end_reached(self, wm: str) -> Column:
        return _grid_sql(wm, self.slide_ms, (self.offset_ms + self.size_ms) % self.slide_ms)


@dataclass(frozen=True)
class Custom(WindowAssigner):
    """User windows: ``assign(ts)`` returns an array of ``struct<window_start,window_end>``; other columns may be used."""

    assign: Callable[[Column], Column]
    event_time: bool = True
    on_grid = False

    def covers_every_row(self) -> bool:
        return False

    def windows(self, ts: Column) -> Column:
        return self.assign(ts).cast(WINDOW_TYPE)

    def end_reached(self, wm: str) -> Column:
        return F.expr(f"{wm} + 1L")


def tumbling(size_ms: int, offset_ms: int = 0) -> Tumbling:
    return Tumbling(size_ms, offset_ms)


def sliding(size_ms: int, slide_ms: int, offset_ms: int = 0) -> Sliding:
    return Sliding(size_ms, slide_ms, offset_ms)


def processing_tumbling(size_ms: int, offset_ms: int = 0) -> Tumbling:
    return Tumbling(size_ms, offset_ms, event_time=False)


def processing_sliding(size_ms: int, slide_ms: int, offset_ms: int = 0) -> Sliding:
    return Sliding(size_ms, slide_ms, offset_ms, event_time=False)


def custom(assign: Callable[[Column], Column]) -> Custom:
    return Custom(assign)
