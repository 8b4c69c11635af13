"""Replays of the ``events`` table under arrival scenarios.

The table is in time order, so a scenario decides which rows arrive late: delayed rows reach the system twelve hours plus
up to one hour of jitter after they happened. Integer arithmetic only, so every engine gets the same arrivals.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyclock.functions.timeunits import epoch_ms
from keyclock.model import KeyedStream, SLICE_ROWS, key_by

HOUR = 3_600_000
KEY_COUNT = 20

# fixed values: the delayed keys (or row share in 1/65537) of each scenario
MEDIAN20 = (8, 11)
MEDIAN50 = (5, 14)
RANDOM20 = (1, 6, 13, 17)
RANDOM50 = (0, 1, 3, 6, 8, 11, 13, 14, 17, 18)
GLOBAL5 = 3277
GLOBAL50 = 32768


def _delayed(name: str) -> str:
    share = "event_id * 48271 % 65537"
    return {
        "ordered": "false",
        "global5": f"{share} < {GLOBAL5}",
        "global50": f"{share} < {GLOBAL50}",
        "median20": "k between {} and {}".format(*MEDIAN20),
        "median50": "k between {} and {}".format(*MEDIAN50),
        "random20": f"k in {RANDOM20}",
        "random50": f"k in {RANDOM50}",
    }[name]


SCENARIOS = ("ordered", "global5", "global50", "median20", "median50", "random20", "random50")


def _arrival(name: str) -> Column:
    jitter = f"(event_id * 40503 % 65537) * {HOUR}L div 65537"
    return F.expr(f"t_ms + if({_delayed(name)}, {12 * HOUR}L + {jitter}, 0L)")


def timed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` with the key ``k`` and the event time ``t_ms``."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.withColumn("k", F.col("user_id") % KEY_COUNT).withColumn(
        "t_ms", epoch_ms(F.col("ts"), events.schema["ts"].dataType)
    )


def arriving_events(spark: SparkSession, sf_dir: str, scenario: str = "median50") -> DataFrame:
    return timed_events(spark, sf_dir).withColumn("arrival", _arrival(scenario))


_FITTED: dict = {}


def replay_of(df, keys, slice_rows: int = SLICE_ROWS, name: tuple | None = None) -> KeyedStream:
    """A keyed stream with slices fitted to the arrivals they cut; those of a recorded table (``name``) are measured once. Results do not
    depend on them."""
    ks = key_by(df, *keys, ts="t_ms", arrival="arrival", tie="event_id")
    if name is None:
        return ks.fitted(slice_rows)
    if name not in _FITTED:
        fitted = ks.fitted(slice_rows)
        _FITTED[name] = (fitted.bucket_ms, fitted.cuts)
    width, cuts = _FITTED[name]
    return replace(ks, bucket_ms=width, cuts=cuts)


def replay(spark: SparkSession, sf_dir: str, scenario: str = "median50", *keys: str) -> KeyedStream:
    """The scenario as a keyed stream (key ``k`` unless others are named)."""
    df = arriving_events(spark, sf_dir, scenario)
    return replay_of(df, keys or ("k",), name=(spark.sparkContext.applicationId, sf_dir, scenario))


def all_scenarios(spark: SparkSession, sf_dir: str, *keys: str) -> KeyedStream:
    """Every scenario at once, told apart by ``experiment``: the rows are read once and multiplied."""
    runs = F.array(*[F.struct(F.lit(s).alias("experiment"), _arrival(s).alias("arrival")) for s in SCENARIOS])
    df = timed_events(spark, sf_dir).select("event_id", "k", "t_ms", F.inline(runs))
    return replay_of(df, keys or ("experiment", "k"), name=(spark.sparkContext.applicationId, sf_dir, "all"))
