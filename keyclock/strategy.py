"""How event time is read and how far a clock may run: the watermark strategy."""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_ALIGNMENT_INTERVAL_MS = 1000


@dataclass(frozen=True)
class WatermarkStrategy:
    """Immutable description of a clock.

    ``scope``  "key" gives every key its own clock, "stream" one clock for everything.
    ``emit``   "record": a row's time counts for the next row; "tick": it counts from the next arrival tick on.
    """

    kind: str = "bounded"
    bound_ms: int = 0
    candidate: Column | None = None
    generator_class: Any = None
    timestamp: Column | None = None
    scope: str = "key"
    emit: str = "record"
    tick_ms: int | None = None
    idle_ms: int | None = None
    align_group: str | None = None
    align_drift_ms: int | None = None
    align_interval_ms: int = DEFAULT_ALIGNMENT_INTERVAL_MS

    @staticmethod
    def bounded(bound_ms: int) -> "WatermarkStrategy":
        """Clock = largest time seen - bound - 1."""
        if bound_ms < 0:
            raise ValueError("the out-of-orderness bound must not be negative")
        return WatermarkStrategy("bounded", bound_ms)

    @staticmethod
    def monotonous() -> "WatermarkStrategy":
        """Times of a key never fall: a bound of zero."""
        return WatermarkStrategy.bounded(0)

    @staticmethod
    def none() -> "WatermarkStrategy":
        """No clock: nothing is late, everything fires at the end of input."""
        return WatermarkStrategy("none")

    @staticmethod
    def generator(source: Any) -> "WatermarkStrategy":
        """Own clock. A Column is the watermark a row proposes (null: none); a class gives Python callbacks."""
        if isinstance(source, Column):
            return WatermarkStrategy("candidate", candidate=source)
        return WatermarkStrategy("class", generator_class=source)

    def with_timestamp(self, column: Column) -> "WatermarkStrategy":
        return replace(self, timestamp=column)

    def with_scope(self, scope: str) -> "WatermarkStrategy":
        if scope not in ("key", "stream"):
            raise ValueError("scope is 'key' or 'stream'")
        return replace(self, scope=scope)

    def every_tick(self, tick_ms: int) -> "WatermarkStrategy":
        if tick_ms <= 0:
            raise ValueError("the emit interval must be positive")
        return replace(self, emit="tick", tick_ms=tick_ms)

    def with_idleness(self, timeout_ms: int) -> "WatermarkStrategy":
        if timeout_ms <= 0:
            raise ValueError("the idle timeout must be positive")
        return replace(self, idle_ms=timeout_ms)

    def with_alignment(
        self, group: str, max_drift_ms: int, interval_ms: int = DEFAULT_ALIGNMENT_INTERVAL_MS
    ) -> "WatermarkStrategy":
        return replace(self, align_group=group, align_drift_ms=max_drift_ms, align_interval_ms=interval_ms)

    def proposes(self, ts: Column) -> Column:
        """The watermark one row proposes; the clock is the running maximum of these."""
        if self.kind == "bounded":
            return ts - F.lit(self.bound_ms + 1).cast("bigint")
        if self.kind == "candidate":
            return self.candidate.cast("bigint")
        if self.kind == "none":
            return F.lit(None).cast("bigint")
        raise ValueError("a generator class has no column form")
