"""Interval join of two live streams under per-key clocks, with late rows set apart.

Spark's own stream-stream join has one watermark for all keys. Here every key has a clock per side; a row behind the slower of the two
is late, and what the slower clock rules out leaves the state.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from keyclock.model import KeyedStream
from keyclock.strategy import WatermarkStrategy
from keyclock.streaming.windows import _flat, time_mode, use_state_store

_LONG = T.LongType()
_SIDES = ("left", "right")


class PairProcessor(StatefulProcessor):
    """State of a key: both clocks with the buckets in use, and the rows of each side by bucket of event time.

    A row reads the buckets of the other side that its interval covers, and writes its own; a bucket goes when no partner can
    come any more. ``ttl_ms`` drops what a silent key leaves behind."""

    def __init__(self, lower: int, upper: int, shapes: dict[str, T.StructType], out: T.StructType, ttl_ms: int | None):
        self.lower, self.upper, self.shapes, self.out, self.ttl_ms = lower, upper, shapes, out, ttl_ms
        self.width = max(1, (upper - lower + 1) // 4)

    def init(self, handle: StatefulProcessorHandle) -> None:
        clocks = [T.StructField(s, _LONG) for s in _SIDES] + [T.StructField(f"{s}_used", T.ArrayType(_LONG)) for s in _SIDES]
        self._clocks = handle.getValueState("clocks", T.StructType(clocks), self.ttl_ms)
        bucket = T.StructType([T.StructField("bucket", _LONG)])
        self._rows = {}
        for s in _SIDES:
            held = T.ArrayType(T.StructType([T.StructField("ts", _LONG), T.StructField("row", self.shapes[s])]))
            self._rows[s] = handle.getMapState(f"{s}_rows", bucket, T.StructType([T.StructField("held", held)]), self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        kept = self._clocks.get() if self._clocks.exists() else (None, None, [], [])
        clocks, used = dict(zip(_SIDES, kept[:2])), dict(zip(_SIDES, map(list, kept[2:])))
        stored = {s: set(used[s]) for s in _SIDES}
        read, dirty, names = {s: {} for s in _SIDES}, {s: set() for s in _SIDES}, self.out.fieldNames()

        def bucket(side: str, b: int) -> list:
            if b not in read[side]:
                found = self._rows[side].getValue((b,))[0] if b in stored[side] else []
                read[side][b] = [(x[0], x[1]) for x in found]
            return read[side][b]

        def told(tag, left, right) -> Row:
            return Row(**dict(zip(names, [*key, tag, left, right])))

        for r in sorted(rows, key=lambda r: (r.at, r.tie, r.side)):
            own, mine = r.side, r[r.side]
            other = "right" if own == "left" else "left"
            slower = None if None in clocks.values() else min(clocks.values())
            if slower is not None and r.ts < slower:
                yield told(f"late_{own}", mine if own == "left" else None, mine if own == "right" else None)
            else:
                low, high = (r.ts + self.lower, r.ts + self.upper) if own == "left" else (r.ts - self.upper, r.ts - self.lower)
                first = bisect_left(used[other], low // self.width)
                for b in used[other][first : bisect_left(used[other], high // self.width + 1)]:
                    for ts, partner in bucket(other, b):
                        if low <= ts <= high:
                            yield told("pair", *((mine, partner) if own == "left" else (partner, mine)))
                b = r.ts // self.width
                bucket(own, b).append((r.ts, mine))
                dirty[own].add(b)
                at = bisect_left(used[own], b)
                if at == len(used[own]) or used[own][at] != b:
                    used[own].insert(at, b)
            if r.cand is not None:
                clocks[own] = r.cand if clocks[own] is None else max(clocks[own], r.cand)
        slower = None if None in clocks.values() else min(clocks.values())
        for s, reach in (("left", self.upper), ("right", -self.lower)):
            while slower is not None and used[s] and (used[s][0] + 1) * self.width - 1 + reach < slower:
                b = used[s].pop(0)
                dirty[s].discard(b)
                if b in stored[s]:
                    self._rows[s].removeKey((b,))
            for b in dirty[s]:
                self._rows[s].updateValue((b,), ([(ts, _flat(row)) for ts, row in read[s][b]],))
        self._clocks.update((clocks["left"], clocks["right"], used["left"], used["right"]))

    def close(self) -> None:
        pass


def stream_pairs(
    left: KeyedStream,
    right: KeyedStream,
    lower_ms: int,
    upper_ms: int,
    strategy: WatermarkStrategy,
    *,
    lower_exclusive: bool = False,
    upper_exclusive: bool = False,
    state_ttl_ms: int | None = None,
) -> DataFrame:
    """(keys, ``tag``, ``left``, ``right``): ``pair`` rows have both structs, ``late_left`` and ``late_right`` rows their own.

    ``left.ts + lower <= right.ts <= left.ts + upper``, as in ``interval_join`` with the same strategy in a batch."""
    lower, upper = lower_ms + bool(lower_exclusive), upper_ms - bool(upper_exclusive)
    if lower_ms > upper_ms:
        raise ValueError("the lower bound must not exceed the upper bound")
    if len(left.keys) != len(right.keys):
        raise ValueError("both sides need the same number of keys")
    if strategy.scope != "key" or strategy.emit != "record":
        raise ValueError("the pairs of a stream are joined under per-key clocks, record by record")
    use_state_store(left.df.sparkSession)
    sides = []
    for name, ks in zip(_SIDES, (left, right)):
        ks = ks.timed(strategy).valid()
        ts = F.col(ks.ts)
        sides.append(
            ks.df.select(
                *[F.col(k).alias(n) for k, n in zip(ks.keys, left.keys)],
                F.lit(name).alias("side"),
                ts.alias("ts"),
                F.col(ks.arrival).alias("at"),
                F.col(ks.tie).alias("tie"),
                strategy.proposes(ts).alias("cand"),
                F.struct(*ks.df.columns).alias(name),
            )
        )
    rows = sides[0].unionByName(sides[1], allowMissingColumns=True)
    shapes = {s: rows.schema[s].dataType for s in _SIDES}
    out = T.StructType([*[rows.schema[k] for k in left.keys], T.StructField("tag", T.StringType()), *[T.StructField(s, shapes[s]) for s in _SIDES]])
    runner = PairProcessor(lower, upper, shapes, out, state_ttl_ms)
    return rows.groupBy(*left.keys).transformWithState(runner, out, "Append", time_mode(state_ttl_ms))
