"""Session windows over a live keyed stream, with the same merging and lateness rules as the batch operator."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from keyclock.functions.timeunits import MAX_WM
from keyclock.model import KeyedStream
from keyclock.operators.sessions import session_step
from keyclock.operators.windows import Measure, count, expanded
from keyclock.strategy import WatermarkStrategy
from keyclock.streaming.windows import _flat, as_dict, measure_type, time_mode, use_state_store

_LONG = T.LongType()


class SessionProcessor(StatefulProcessor):
    """State of a key: its clock, and its live sessions by window with their measures and whether they have fired."""

    def __init__(self, gap: int, lateness: int, tick: bool, kinds: tuple[str, ...], types, out: T.StructType, ttl_ms: int | None):
        self.gap, self.lateness, self.tick, self.kinds = gap, lateness, tick, kinds
        self.types, self.out, self.ttl_ms = types, out, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._clock = handle.getValueState("clock", T.StructType([T.StructField("wm", _LONG)]), self.ttl_ms)
        window = T.StructType([T.StructField("window_start", _LONG), T.StructField("window_end", _LONG)])
        session = [T.StructField("fired", T.BooleanType())] + [T.StructField(f"m{i}", t) for i, t in enumerate(self.types)]
        self._live = handle.getMapState("live", window, T.StructType(session), self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        wm = self._clock.get()[0] if self._clock.exists() else None
        stored = {(w[0], w[1]): tuple(as_dict(x) for x in v) for w, v in self._live.iterator()}
        live = [[*w, list(v[1:]), v[0]] for w, v in stored.items()]
        names, ahead, values = self.out.fieldNames(), wm, [f"m{i}" for i in range(len(self.kinds))]

        def row(tag, s, at_wm, tie=None):
            return Row(**dict(zip(names, [*key, tag, s[0], s[1], at_wm, tie, *s[2]])))

        for r in sorted(rows, key=lambda r: (r.at, r.tie)):
            fired, again, live = session_step(live, r.ts, r.ts, [as_dict(r[v]) for v in values], wm, self.gap, self.lateness, self.kinds)
            yield from (row("firing", s, wm) for s in fired)
            if again is None:
                yield row("late", (None, None, [r[v] for v in values]), wm, r.tie)
            elif again:
                yield row("refiring", again, wm)
            if r.cand is not None and (ahead is None or r.cand > ahead):
                ahead = r.cand
                if not self.tick:
                    wm = ahead
                    yield from (row("firing", s, wm) for s in _close(live, wm))
        if self.tick and ahead is not None:
            yield from (row("firing", s, ahead) for s in _close(live, ahead))
        if ahead is not None:
            live = [s for s in live if s[1] - 1 + self.lateness > ahead]
            self._clock.update((ahead,))
        now = {(s[0], s[1]): (s[3], *s[2]) for s in live}
        for w in stored.keys() - now.keys():
            self._live.removeKey(w)
        for w, v in now.items():
            if stored.get(w) != v:
                self._live.updateValue(w, _flat(v))

    def close(self) -> None:
        pass


def _close(live, wm):
    """Sessions the clock has just reached, marked as fired."""
    due = [s for s in sorted(live, key=lambda s: s[1]) if not s[3] and s[1] - 1 <= wm]
    for s in due:
        s[3] = True
    return due


def stream_sessions(
    ks: KeyedStream,
    strategy: WatermarkStrategy,
    gap_ms: int,
    lateness_ms: int = 0,
    measures: list[Measure] | None = None,
    state_ttl_ms: int | None = None,
) -> DataFrame:
    """``firing``, ``refiring`` and ``late`` rows: (keys, ``tag``, window, ``wm``, ``tie``, measures; of a late row: its own).

    ``state_ttl_ms`` lets the sessions and the clock of long silent keys expire; such a key starts anew, and the query runs until
    it is stopped."""
    use_state_store(ks.df.sparkSession)
    ks = ks.timed(strategy).valid()
    ts = F.col(ks.ts)
    measures, results = expanded(measures or [count()])
    types = [measure_type(ks.df, m) for m in measures]
    values = [m.item().cast(t).alias(f"m{i}") for i, (m, t) in enumerate(zip(measures, types))]
    rows = ks.df.select(*ks.keys, ts.alias("ts"), F.col(ks.arrival).alias("at"), F.col(ks.tie).alias("tie"), strategy.proposes(ts).alias("cand"), *values)
    out = T.StructType(
        [
            *[ks.df.schema[k] for k in ks.keys],
            T.StructField("tag", T.StringType()),
            *[T.StructField(n, _LONG) for n in ("window_start", "window_end", "wm")],
            T.StructField("tie", ks.df.schema[ks.tie].dataType),
            *[T.StructField(m.name, t) for m, t in zip(measures, types)],
        ]
    )
    runner = SessionProcessor(gap_ms, lateness_ms, strategy.emit == "tick", tuple(m.kind for m in measures), types, out, state_ttl_ms)
    done = rows.groupBy(*ks.keys).transformWithState(runner, out, "Append", time_mode(state_ttl_ms))
    return done.select(*ks.keys, "tag", "window_start", "window_end", "wm", "tie", *[c.alias(n) for n, c in results.items()])


def open_sessions(spark: SparkSession, checkpoint: str, keys: tuple[str, ...], measures: list[Measure] | None = None) -> DataFrame:
    """End of input: sessions of a stopped query that never fired, as firings at the end of event time."""
    state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "live").load()
    measures, results = expanded(measures or [count()])
    live = state.where("not user_map_value.fired").select(
        *[F.col("key")[k].alias(k) for k in keys],
        F.col("user_map_key.window_start").alias("window_start"),
        F.col("user_map_key.window_end").alias("window_end"),
        *[F.col(f"user_map_value.m{i}").alias(m.name) for i, m in enumerate(measures)],
    )
    return live.select(*keys, F.lit("flushed").alias("tag"), "window_start", "window_end", *[c.alias(n) for n, c in results.items()], F.lit(MAX_WM).cast("bigint").alias("wm"))
