"""Windows over a live keyed stream: per-key clocks and open windows live in Spark's state store.

One micro-batch is one emit tick in tick mode: all its rows meet the clock the previous batch left. In record mode the rows
of a key are taken in arrival order and each moves the clock for the next. Results equal the batch operators in the same
mode. Spark's own stream-wide watermark is never set here, a key's clock only moves with its own rows.
"""

from __future__ import annotations

import pickle
from bisect import bisect_right, insort
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from keyclock.functions.arrow import batch_of
from keyclock.functions.assigners import WindowAssigner
from keyclock.functions.merging import merge
from keyclock.functions.timeunits import MAX_WM
from keyclock.model import KeyedStream
from keyclock.operators.aggregates import Aggregate, with_results
from keyclock.operators.windows import Measure, expanded
from keyclock.strategy import WatermarkStrategy

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_LONG = T.LongType()


def use_state_store(spark: SparkSession) -> None:
    """Stateful operators need the RocksDB provider; enough to set on a running session."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


@dataclass(frozen=True)
class WindowSpec:
    """What the processor needs to know; the window columns are computed before it, by Spark."""

    keys: tuple[str, ...]
    kinds: tuple
    types: tuple[T.DataType, ...]
    lateness_ms: int
    tick: bool
    state_ttl_ms: int | None = None
    generator: Any = None


def time_mode(ttl_ms: int | None, timers: bool = False) -> str:
    """Expiry and processing-time timers need Spark's processing time; a query that has it runs until it is stopped."""
    return "ProcessingTime" if timers or ttl_ms is not None else "None"


class Emitted:
    """What a generator class emits to; the highest counts."""

    def __init__(self, wm: int | None = None):
        self.wm = wm

    def emit(self, wm: int) -> None:
        self.wm = wm if self.wm is None else max(self.wm, wm)


def as_dict(v):
    """Structs come as rows from the state, and as dicts from the input."""
    return v.asDict(recursive=True) if isinstance(v, Row) else v


def _flat(v):
    """Pairs and accumulators as plain tuples, as the state store takes them."""
    if isinstance(v, dict):
        return tuple(_flat(x) for x in v.values())
    return tuple(_flat(x) for x in v) if isinstance(v, tuple) else v


class KeyClockProcessor(StatefulProcessor):
    """Input rows: keys, ``cand``, ``ts``, ``at``, ``tie``, ``n``, ``wins`` (array of start/end), measures ``m0``, ``m1``, ...

    Kept per key: the clock with a list of the open windows in order of their ends, and the contents of each window on its
    own. A batch reads and writes the windows its rows are in and those the clock reaches, however many are open."""

    def __init__(self, spec: WindowSpec, out: T.StructType):
        self.spec, self.out = spec, out

    def init(self, handle: StatefulProcessorHandle) -> None:
        ttl = self.spec.state_ttl_ms
        clock = [T.StructField("wm", _LONG), T.StructField("open", T.ArrayType(_LONG)), T.StructField("generator", T.BinaryType())]
        self._clock = handle.getValueState("clock", T.StructType(clock), ttl)
        window = T.StructType([T.StructField("window_start", _LONG), T.StructField("window_end", _LONG)])
        pane = [T.StructField("firing_no", _LONG), T.StructField("elements", _LONG)]
        pane += [T.StructField(f"m{i}", t) for i, t in enumerate(self.spec.types)]
        self._panes = handle.getMapState("panes", window, T.StructType(pane), ttl)

    def _pane(self, w: tuple[int, int]) -> list:
        """The contents of a window, read when they are first asked for."""
        if w not in self._read:
            stored = self._panes.getValue(w) if (w[1], w[0]) in self._known else None
            values = [as_dict(v) for v in stored] if stored else [0, 0] + [None] * len(self.spec.kinds)
            self._read[w] = values
        return self._read[w]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        spec = self.spec
        stored = self._clock.get() if self._clock.exists() else None
        wm, flat, kept = stored if stored else (None, [], None)
        self._open = list(zip(flat[::2], flat[1::2]))  # (end, start), sorted
        self._known, self._read, self._dirty, self._gone = set(self._open), {}, set(), set()
        known = set(self._open)
        ahead, before = wm, (wm, list(flat))
        generator, told = None, Emitted(wm)
        if spec.generator is not None:
            generator = spec.generator()
            if kept is not None:
                generator.__dict__.update(pickle.loads(kept))
        who = key[0] if len(key) == 1 else tuple(key)

        if not spec.tick or generator is not None:
            rows = sorted(rows, key=lambda r: (r.at, r.tie))
        for r in rows:
            skipped = True
            for w in r.wins or ():
                w = (w["window_start"], w["window_end"])
                if wm is not None and w[1] - 1 + spec.lateness_ms <= wm:
                    continue
                skipped = False
                pane = self._pane(w)
                if (w[1], w[0]) not in known:
                    known.add((w[1], w[0]))
                    insort(self._open, (w[1], w[0]))
                pane[1] += r.n
                for i, kind in enumerate(spec.kinds):
                    pane[2 + i] = merge(kind, pane[2 + i], as_dict(r[f"m{i}"]))
                self._dirty.add(w)
                if wm is not None and w[1] - 1 <= wm:
                    pane[0] += 1
                    yield self._fired(key, w, pane, wm, r.at)
            if skipped and wm is not None and r.ts + spec.lateness_ms <= wm:
                yield self._late(key, r, wm)
            if generator is None:
                cand = r.cand
            else:
                generator.on_event(as_dict(r.row), who, r.ts, told)
                if not spec.tick:
                    generator.on_periodic_emit(told)
                cand = told.wm
            if cand is not None and (ahead is None or cand > ahead):
                ahead = cand
                if not spec.tick:
                    yield from self._advance(key, known, wm, ahead, r.at)
                    wm = ahead
        if spec.tick and generator is not None:
            generator.on_periodic_emit(told)
            ahead = told.wm
        if spec.tick and ahead != wm:
            yield from self._advance(key, known, wm, ahead, None)
        flat = [x for w in self._open for x in w]
        if generator is not None or (ahead, flat) != before:
            self._clock.update((ahead, flat, None if generator is None else pickle.dumps(generator.__dict__)))
        for w in self._gone:
            if (w[1], w[0]) in self._known:
                self._panes.removeKey(w)
        for w in self._dirty - self._gone:
            self._panes.updateValue(w, tuple(_flat(v) for v in self._read[w]))

    def _advance(self, key, known, old, new, at):
        """Fire what the clock reaches and drop what it leaves behind: both are stretches of the list of open windows."""
        low = 0 if old is None else bisect_right(self._open, (old + 1, MAX_WM))
        for end, start in self._open[low : bisect_right(self._open, (new + 1, MAX_WM))]:
            w = (start, end)
            pane = self._pane(w)
            pane[0] += 1
            self._dirty.add(w)
            yield self._fired(key, w, pane, new, at)
        past = bisect_right(self._open, (new + 1 - self.spec.lateness_ms, MAX_WM))
        for w in self._open[:past]:
            known.discard(w)
            self._gone.add((w[1], w[0]))
        del self._open[:past]

    def _fired(self, key, w, pane, wm, at) -> Row:
        return self._row(key, "firing", w, pane[0], pane[1], wm, at, None, None, pane[2:])

    def _late(self, key, r, wm) -> Row:
        return self._row(key, "late", (None, None), None, r.n, wm, r.at, r.tie, r.ts, [None] * len(self.spec.kinds))

    def _row(self, key, tag, w, no, elements, wm, at, tie, ts, measures) -> Row:
        return Row(**dict(zip(self.out.fieldNames(), [*key, tag, w[0], w[1], no, elements, wm, at, tie, ts, *measures])))

    def close(self) -> None:
        pass


def _output_type(ks: KeyedStream, measures: list[Measure], types) -> T.StructType:
    fields = [T.StructField(k, ks.df.schema[k].dataType) for k in ks.keys]
    fields += [T.StructField("tag", T.StringType())]
    fields += [T.StructField(n, _LONG) for n in ("window_start", "window_end", "firing_no", "elements", "wm", "fired_at")]
    fields += [T.StructField("tie", ks.df.schema[ks.tie].dataType), T.StructField("ts", _LONG)]
    return T.StructType(fields + [T.StructField(m.name, t) for m, t in zip(measures, types)])


def measure_type(df: DataFrame, m: Measure) -> T.DataType:
    """The measure's own type; sums take the type that Spark's sum gives."""
    value = df.select((F.sum(m.value) if m.kind == "sum" else m.item()).alias("v"))
    return value.schema["v"].dataType


def stream_windows(
    ks: KeyedStream,
    strategy: WatermarkStrategy,
    assigner: WindowAssigner,
    measures: list[Measure] | None = None,
    lateness_ms: int = 0,
    combine: bool = False,
    state_ttl_ms: int | None = None,
) -> DataFrame:
    """Firings and late rows of a keyed stream: ``tag`` is ``firing`` or ``late``. For batches there is ``window_firings``.

    ``combine`` (tick mode, no lateness) adds up the rows of a window inside every input partition before the shuffle, so
    a busy key sends a few partial rows instead of all its events; refused rows are then counted, not listed. Measures keep
    their type. ``state_ttl_ms`` lets the state of long silent keys expire; such a key starts with no clock again, and the query runs
    until it is stopped.
    """
    if not ks.df.isStreaming:
        raise ValueError("these are windows of a stream; a batch goes to window_firings")
    if strategy.scope != "key":
        raise ValueError("for one clock over the whole stream use withWatermark and Spark's own windows")
    if combine and (strategy.emit != "tick" or lateness_ms):
        raise ValueError("combine needs tick mode and no allowed lateness")
    measures, results = expanded([m for m in (measures or []) if m.kind != "count"])
    use_state_store(ks.df.sparkSession)
    ks = ks.timed(strategy).valid()
    types = tuple(measure_type(ks.df, m) for m in measures)
    own = strategy.kind == "class"
    if own and combine:
        raise ValueError("a generator class sees every row")
    spec = WindowSpec(ks.keys, tuple(m.kind for m in measures), types, lateness_ms, strategy.emit == "tick", state_ttl_ms, strategy.generator_class)
    ts = F.col(ks.ts)
    rows = ks.df.select(
        *ks.keys,
        *([F.struct(*ks.df.columns).alias("row")] if own else []),
        (F.lit(None).cast("bigint") if own else strategy.proposes(ts)).alias("cand"),
        ts.alias("ts"),
        F.col(ks.arrival).alias("at"),
        F.col(ks.tie).alias("tie"),
        F.lit(1).cast("bigint").alias("n"),
        assigner.windows(ts).alias("wins"),
        *[m.value.cast(t).alias(f"m{i}") for i, (m, t) in enumerate(zip(measures, types))],
    )
    if combine:
        rows = _combined(rows, ks.keys, spec.kinds)
    out = _output_type(ks, measures, types)
    done = rows.groupBy(*ks.keys).transformWithState(KeyClockProcessor(spec, out), out, "Append", time_mode(state_ttl_ms))
    own = {m.name for m in measures}
    return done.select(*[n for n in out.fieldNames() if n not in own], *[c.alias(n) for n, c in results.items()])


def stream_aggregates(
    ks: KeyedStream,
    strategy: WatermarkStrategy,
    assigner: WindowAssigner,
    aggregate: Aggregate,
    lateness_ms: int = 0,
    combine: bool = False,
    state_ttl_ms: int | None = None,
) -> DataFrame:
    """The same with an aggregate of one's own: every row becomes an accumulator, and accumulators are merged, with ``combine`` also
    before the shuffle."""
    own = aggregate.state
    shape = T.StructType([*ks.df.schema.fields, T.StructField("__acc", own)])
    kind = to_arrow_schema(T.StructType([T.StructField("__acc", own)])).field(0).type

    def begun(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            accs = pa.array([aggregate.add(None, r) for r in b.to_pylist()], kind)
            yield pa.record_batch([*b.columns, accs], [*b.schema.names, "__acc"])

    rows = ks.with_df(ks.df.mapInArrow(begun, shape))
    done = stream_windows(rows, strategy, assigner, [Measure("acc", aggregate.merge, F.col("__acc"))], lateness_ms, combine, state_ttl_ms)
    return with_results(done, aggregate)


def _combined(rows: DataFrame, keys, kinds) -> DataFrame:
    """Partial sums of an input partition: one row per key and list of windows goes on.

    Rows with the same list share acceptance, lateness and clock step. Rows without a window keep theirs, per time of the row."""
    how = {"cand": "max", "ts": "min", "n": "sum", **{f"m{i}": "sum" if k == "count" else k for i, k in enumerate(kinds)}}
    flat = rows.select(*keys, F.to_json("wins").alias("__wins"), F.when(F.size("wins") == 0, F.col("ts")).alias("__lone"), *how)
    by, names = [*keys, "__wins", "__lone"], flat.columns
    pairs = any(isinstance(flat.schema[c].dataType, T.StructType) for c in how)

    shape = flat.schema

    def merged(b: pa.RecordBatch) -> pa.RecordBatch:
        """Arrow has no order of pairs (the values next to extremes), so these are merged row by row."""
        found: dict[tuple, dict] = {}
        for r in b.to_pylist():
            own = found.setdefault(tuple(r[c] for c in by), r)
            if own is not r:
                own.update({c: merge(kind, own[c], r[c]) for c, kind in how.items()})
        return batch_of(list(found.values()), shape)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if pairs:
                yield merged(b)
                continue
            found = pa.Table.from_batches([b]).group_by(by).aggregate(list(how.items()))
            found = found.rename_columns([c.removesuffix(f"_{how[c.rsplit('_', 1)[0]]}") if c not in by else c for c in found.column_names])
            yield from found.select(names).combine_chunks().to_batches()

    small = flat.mapInArrow(partial, shape)
    return small.select(
        *keys,
        "cand",
        "ts",
        F.lit(None).cast("bigint").alias("at"),
        F.lit(None).cast(rows.schema["tie"].dataType).alias("tie"),
        "n",
        F.from_json("__wins", rows.schema["wins"].dataType).alias("wins"),
        *[f"m{i}" for i in range(len(kinds))],
    )


def open_windows(spark: SparkSession, checkpoint: str, keys: tuple[str, ...], measures: list[str] | None = None) -> DataFrame:
    """End of input: the windows still open in a stopped query's state, as firings with the clock at the end of time.

    Spark streams have no end marker, so this reads the checkpoint. Run it while the query is stopped; a restarted query
    continues with the same windows and would fire them again, which is why they carry ``tag`` ``flushed``.
    """
    state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "panes").load()
    pane, w = "user_map_value", "user_map_key"
    names = {m: F.col(f"{pane}.m{i}") for i, m in enumerate(measures or [])}
    return state.where(F.col(f"{pane}.firing_no") == 0).select(
        *[F.col("key")[k].alias(k) for k in keys],
        F.lit("flushed").alias("tag"),
        F.col(f"{w}.window_start").alias("window_start"),
        F.col(f"{w}.window_end").alias("window_end"),
        F.lit(1).cast("bigint").alias("firing_no"),
        F.col(f"{pane}.elements").alias("elements"),
        F.lit(MAX_WM).cast("bigint").alias("wm"),
        *[c.alias(m) for m, c in names.items()],
    )


def current_watermarks(spark: SparkSession, checkpoint: str, keys: tuple[str, ...]) -> DataFrame:
    """Every key's clock as stored in a query's checkpoint."""
    state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "clock").load()
    return state.select(*[F.col("key")[k].alias(k) for k in keys], F.col("single_value.wm" if "single_value" in state.columns else "value.wm").alias("wm"))
