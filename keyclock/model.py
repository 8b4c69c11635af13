"""The keyed stream: a DataFrame plus the columns that carry key, event time and arrival order."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyclock.functions.timeunits import epoch_ms, floor_div
from keyclock.strategy import WatermarkStrategy

DEFAULT_BUCKET_MS = 3_600_000
#: rows one arrival slice should hold at most, whatever the keys, and how many slices to have at least
SLICE_ROWS = 2_000_000
MIN_SLICES = 64
#: rows that a cut inside a slice rests on, and how many slices are cut
SKETCH = 64
MOST_CUT = 256
MOST_PARTS = 4096


def bad_key_types(dtype: T.DataType, path: str) -> list[str]:
    """Types that cannot be a key: arrays, maps and variants, also inside structs."""
    if isinstance(dtype, (T.ArrayType, T.MapType, T.VariantType)):
        return [f"{path}: {dtype.simpleString()}"]
    if isinstance(dtype, T.StructType):
        return [bad for f in dtype.fields for bad in bad_key_types(f.dataType, f"{path}.{f.name}")]
    return []


def validate_key_types(df: DataFrame, keys) -> None:
    bad = [b for k in keys for b in bad_key_types(df.select(F.col(k)).schema[0].dataType, k)]
    if bad:
        raise ValueError("these types cannot be used as keys: " + ", ".join(bad))


def fit_bucket_ms(df: DataFrame, arrival: str, slice_rows: int = SLICE_ROWS) -> int:
    """Slice width for this data: about ``slice_rows`` rows in the densest stretch of arrivals, all keys together.

    Reads one column, twice. Even if one key held everything, no task would sort more than a slice. Results do not depend
    on the width, so a value from older data or a sample serves as well.
    """
    low, high, rows = df.agg(F.min(arrival), F.max(arrival), F.count(arrival)).first()
    if not rows or high == low:
        return DEFAULT_BUCKET_MS
    width = max(1, (high - low) // max(MIN_SLICES, -(-rows // slice_rows)))
    if rows <= slice_rows:
        return width
    densest = df.groupBy(floor_div(arrival, width).alias("s")).count().agg(F.max("count")).first()[0]
    return max(1, width * slice_rows // densest) if densest > 2 * slice_rows else width


def fit_cuts(df: DataFrame, arrival: str, tie: str, bucket_ms: int, slice_rows: int = SLICE_ROWS) -> tuple[tuple[int, tuple], ...]:
    """Further cuts for the slices that stay too full however narrow they are: bursts, and rows of one arrival.

    For each such slice the places (arrival, tie) that part it into about ``slice_rows`` each, from a sample of ``SKETCH`` rows per place,
    so that the parts are even to about an eighth. At most ``MOST_CUT`` slices are cut, into ``MOST_PARTS`` together: with more rows than
    that in bursts, parts grow with them.
    """
    cell = floor_div(arrival, bucket_ms)
    full = df.groupBy(cell.alias("s")).count().where(F.col("count") > 2 * slice_rows).orderBy(F.desc("count"), "s").limit(MOST_CUT).collect()
    if not full:
        return ()
    rows = sum(r["count"] for r in full)
    parts = min(MOST_PARTS, sum(-(-r["count"] // slice_rows) for r in full))
    burst = df.where(cell.isin([r["s"] for r in full]))
    if rows > SKETCH * parts:
        grain = 1 << 40
        burst = burst.where(F.pmod(F.xxhash64(F.lit("cut"), arrival, tie), F.lit(grain)) < grain * SKETCH * parts // rows)
    places: dict[int, list] = {}
    for r in burst.select(cell.alias("s"), F.struct(F.col(arrival).alias("a"), F.col(tie).alias("t")).alias("p")).orderBy("s", "p").collect():
        places.setdefault(r["s"], []).append((r["p"]["a"], r["p"]["t"]))
    cuts = []
    for r in full:
        mine, own = places.get(r["s"], []), -(-parts * r["count"] // rows)
        at = sorted({len(mine) * i // own for i in range(1, own)})
        found = list(dict.fromkeys(mine[i] for i in at if 0 < i < len(mine)))
        if found:
            cuts.append((r["s"], tuple(found)))
    return tuple(cuts)


@dataclass(frozen=True)
class KeyedStream:
    df: DataFrame
    keys: tuple[str, ...]
    ts: str
    arrival: str
    tie: str
    bucket_ms: int = DEFAULT_BUCKET_MS
    cuts: tuple = ()

    def with_df(self, df: DataFrame) -> "KeyedStream":
        return replace(self, df=df)

    def key_by(self, *keys: str) -> "KeyedStream":
        """A different keying of the same rows; the only way to re-partition a keyed stream."""
        return replace(key_by(self.df, *keys, ts=self.ts, arrival=self.arrival, tie=self.tie, bucket_ms=self.bucket_ms), cuts=self.cuts)

    def fitted(self, slice_rows: int = SLICE_ROWS) -> "KeyedStream":
        """The same stream with arrival slices sized by :func:`fit_bucket_ms`, bursts cut by :func:`fit_cuts`; runs small jobs."""
        return self.with_cuts(fit_bucket_ms(self.df, self.arrival, slice_rows), slice_rows)

    def with_cuts(self, bucket_ms: int, slice_rows: int = SLICE_ROWS) -> "KeyedStream":
        """Slices of that width, of which those that hold more than twice ``slice_rows`` are cut by (arrival, tie)."""
        return replace(self, bucket_ms=bucket_ms, cuts=fit_cuts(self.df, self.arrival, self.tie, bucket_ms, slice_rows))

    def timed(self, strategy: WatermarkStrategy) -> "KeyedStream":
        """Apply the strategy's timestamp assigner, if it has one; otherwise keep the record's time."""
        if strategy.timestamp is None:
            return self
        dtype = self.df.select(strategy.timestamp).schema[0].dataType
        return self.with_df(self.df.withColumn(self.ts, epoch_ms(strategy.timestamp, dtype)))

    def valid(self) -> "KeyedStream":
        """Rows with an event time; rows without one come out of :meth:`invalid`."""
        return self.with_df(self.df.where(F.col(self.ts).isNotNull()))

    def invalid(self) -> DataFrame:
        return self.df.where(F.col(self.ts).isNull())

    def bucket(self) -> Column:
        """Arrival slice that bounds what one task sorts, whatever the key distribution. It rises with (arrival, tie)."""
        base = floor_div(self.arrival, self.bucket_ms)
        if not self.cuts:
            return base
        row = F.struct(F.col(self.arrival).alias("a"), F.col(self.tie).alias("t"))
        tie = self.df.schema[self.tie].dataType
        part = F.lit(0)
        for cell, places in self.cuts:
            steps = F.array(*[F.struct(F.lit(a).cast("bigint").alias("a"), F.lit(t).cast(tie).alias("t")) for a, t in places])
            part = F.when(base == F.lit(cell).cast("bigint"), F.size(F.filter(steps, lambda p: p <= row))).otherwise(part)
        return F.struct(base.alias("cell"), part.alias("part"))


def key_by(
    df: DataFrame,
    *keys: str,
    ts: str,
    arrival: str | None = None,
    tie: str,
    bucket_ms: int = DEFAULT_BUCKET_MS,
) -> KeyedStream:
    """Key a DataFrame. ``ts``/``arrival`` may be bigint milliseconds, timestamps or dates.

    Nested key paths (``"a.b"``) become flat columns (``a_b``). Without ``arrival`` the event time is the arrival.
    ``bucket_ms`` should keep one arrival slice within what a task sorts comfortably; ``.fitted()`` measures it.
    """
    if not keys:
        raise ValueError("key_by needs at least one key")
    if bucket_ms <= 0:
        raise ValueError("bucket_ms must be positive")
    validate_key_types(df, keys)
    flat = []
    for k in keys:
        name = k.replace(".", "_")
        if name != k:
            df = df.withColumn(name, F.col(k))
        flat.append(name)
    arrival = arrival or ts
    for name in {ts, arrival}:
        dtype = df.schema[name].dataType
        if not isinstance(dtype, T.LongType):
            df = df.withColumn(name, epoch_ms(F.col(name), dtype))
    return KeyedStream(df, tuple(flat), ts, arrival, tie, bucket_ms)
