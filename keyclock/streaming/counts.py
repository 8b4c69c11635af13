"""Count windows over a live keyed stream: tumbling and sliding, with the same results as in a batch."""

from __future__ import annotations

from collections.abc import Iterator
from math import gcd

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from keyclock.functions.merging import merge
from keyclock.model import KeyedStream
from keyclock.operators.windows import Measure, expanded
from keyclock.streaming.windows import _flat, as_dict, measure_type, time_mode, use_state_store

_LONG = T.LongType()


class CountProcessor(StatefulProcessor):
    """State of a key: its position, and a ring of partial results, one per slice of positions that a coming firing needs.

    A row changes one slice. A firing reads the slices of its window, which are the whole ring."""

    def __init__(self, size: int, slide: int, kinds: tuple, types, out: T.StructType, ttl_ms: int | None):
        self.size, self.slide, self.width = size, slide, gcd(size, slide)
        self.kinds, self.types, self.out, self.ttl_ms = kinds, types, out, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._position = handle.getValueState("position", T.StructType([T.StructField("n", _LONG)]), self.ttl_ms)
        place = T.StructType([T.StructField("place", _LONG)])
        partial = [T.StructField("slice", _LONG)] + [T.StructField(f"m{i}", t) for i, t in enumerate(self.types)]
        self._ring = handle.getMapState("ring", place, T.StructType(partial), self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        n = self._position.get()[0] if self._position.exists() else 0
        many, began = self.size // self.width, n
        held, dirty, names = {}, set(), self.out.fieldNames()

        def partial(number: int) -> list | None:
            """The slice, if the ring has it."""
            place = number % many
            if place not in held:
                # only what earlier batches can have left
                stored = self._ring.getValue((place,)) if began and self._ring.containsKey((place,)) else None
                held[place] = [as_dict(v) for v in stored] if stored else None
            found = held[place]
            return found if found is not None and found[0] == number else None

        for r in sorted(rows, key=lambda r: (r.at, r.tie)):
            n += 1
            number, fires_at = (n - 1) // self.width, -(-n // self.slide) * self.slide
            if n > fires_at - self.size:  # rows between windows count, and are not kept
                found = partial(number)
                if found is None:
                    found = held[number % many] = [number, *[None] * len(self.kinds)]
                for i, kind in enumerate(self.kinds):
                    found[1 + i] = merge(kind, found[1 + i], as_dict(r[f"m{i}"]))
                dirty.add(number % many)
            if n == fires_at:
                values = [None] * len(self.kinds)
                for older in range(max(0, n - self.size) // self.width, n // self.width):
                    part = partial(older)
                    if part is not None:
                        values = [merge(kind, a, b) for kind, a, b in zip(self.kinds, values, part[1:])]
                yield Row(**dict(zip(names, [*key, n // self.slide - 1, min(n, self.size), *values])))
        self._position.update((n,))
        for place in dirty:
            self._ring.updateValue((place,), tuple(_flat(v) for v in held[place]))

    def close(self) -> None:
        pass


def stream_count_windows(ks: KeyedStream, size: int, slide: int | None = None, measures: list[Measure] | None = None, state_ttl_ms: int | None = None) -> DataFrame:
    """After every ``slide`` rows of a key (``size`` if not given), the last ``size``: (keys, ``window_no``, ``elements``, measures).

    Positions count over batches and restarts; the rows of a batch are taken in arrival order. ``window_no`` counts from 0. For batches there
    are ``count_windows`` and ``sliding_count_windows``."""
    slide = slide or size
    if size <= 0 or slide <= 0:
        raise ValueError("window size and slide must be positive")
    if not ks.df.isStreaming:
        raise ValueError("these are windows of a stream; a batch goes to count_windows or sliding_count_windows")
    use_state_store(ks.df.sparkSession)
    measures, results = expanded([m for m in (measures or []) if m.kind != "count"])
    types = [measure_type(ks.df, m) for m in measures]
    values = [m.item().cast(t).alias(f"m{i}") for i, (m, t) in enumerate(zip(measures, types))]
    rows = ks.df.select(*ks.keys, F.col(ks.arrival).alias("at"), F.col(ks.tie).alias("tie"), *values)
    out = T.StructType(
        [
            *[ks.df.schema[k] for k in ks.keys],
            T.StructField("window_no", _LONG),
            T.StructField("elements", _LONG),
            *[T.StructField(m.name, t) for m, t in zip(measures, types)],
        ]
    )
    runner = CountProcessor(size, slide, tuple(m.kind for m in measures), types, out, state_ttl_ms)
    done = rows.groupBy(*ks.keys).transformWithState(runner, out, "Append", time_mode(state_ttl_ms))
    return done.select(*ks.keys, "window_no", "elements", *[c.alias(n) for n, c in results.items()])
