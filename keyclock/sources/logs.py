"""Experiment logs: directories of CSV files, one experiment per file, named by the file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyclock.functions.timeunits import ns_to_timestamp

# fixed values: the columns of each kind of file, by position
WINDOW_RESULT = "window_start bigint, watermark bigint, key bigint, window_end bigint, elements bigint"
KEYED_LATENCY = "type string, watermark bigint, key bigint, system_time bigint"
STREAM_LATENCY = "type string, watermark bigint, system_time bigint"
STATE_LOG = "key bigint, ts bigint, size int"
STATE_PAIR = "ts bigint, size_keyed bigint, size_stream bigint"


def read_logs(spark: SparkSession, directory: str, schema: str, header: bool = False, by_folder: bool = False) -> DataFrame:
    """All CSV files of a directory in one DataFrame, columns by position, plus the file's ``name``.

    ``name`` is the file name up to its first dot; ``by_folder`` takes the folder's instead, for logs that several tasks
    wrote. Say ``header=True`` only for files that have one, otherwise their first record would be lost.
    """
    df = spark.read.schema(schema).option("enforceSchema", True).csv(directory, header=header)
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2) if by_folder else F.col("_metadata.file_name")
    return df.withColumn("name", F.split(name, r"\.")[0])


def write_logs(df: DataFrame, directory: str, name: str, schema: str) -> None:
    """One experiment's log as CSV files without a header in a folder of its name, columns in the order of the schema."""
    columns = [part.split()[0] for part in schema.split(", ")]
    df.select(*columns).write.mode("append").csv(f"{directory.rstrip('/')}/{name}")


def label_experiments(df: DataFrame) -> DataFrame:
    """Columns from ``name``: ``role`` (start/end), ``experiment`` (name without role), ``clock``, ``scenario``, ``cores``.

    Both naming habits are understood: ``keyed_50median_start_4c`` and ``base_50median_4c_start_latency``.
    """
    name = F.col("name")
    role = F.regexp_extract(name, r"(?:^|_)(start|end)(?:_|$)", 1)
    experiment = F.regexp_replace(name, r"(^|_)(?:start|end)(_|$)", "$1")
    experiment = F.regexp_replace(F.regexp_replace(experiment, r"_latency$", ""), r"_+$", "")
    return df.withColumns(
        {
            "role": role,
            "experiment": experiment,
            "clock": F.regexp_extract(name, r"^([A-Za-z]+)_", 1),
            "scenario": F.regexp_extract(name, r"^[A-Za-z]+_(.+?)(?:_(?:\d+c|start|end|latency|state).*)?$", 1),
            "cores": F.regexp_extract(name, r"_(\d+)c(?:_|$)", 1).try_cast("int"),
        }
    )


def with_system_timestamp(df: DataFrame) -> DataFrame:
    """Wall-clock nanoseconds as a timestamp next to the exact number."""
    return df.withColumn("system_timestamp", ns_to_timestamp(F.col("system_time")))
