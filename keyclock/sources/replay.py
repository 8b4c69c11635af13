"""Reading recorded streams, and the sinks and side outputs at the other end."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_replay(
    spark: SparkSession,
    path: str,
    fmt: str = "parquet",
    schema: T.StructType | str | None = None,
    streaming: bool = False,
    files_per_batch: int | None = None,
    **options,
) -> DataFrame:
    """A recorded stream, whole (batch) or file by file (streaming). Any Spark format works.

    ``files_per_batch`` is the throttle of a streaming replay: one micro-batch then is one emit tick.
    """
    reader = spark.readStream if streaming else spark.read
    reader = reader.format(fmt).options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    elif streaming:
        raise ValueError("a streaming replay needs an explicit schema")
    if streaming and files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder under ``spark.checkpoint.dir``, which driver and executors share. Only a session on one machine that has none gets a
    temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="keyclock-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/keyclock-{uuid.uuid4().hex}"


def transform(df: DataFrame, *, where: Column | None = None, **columns: Column) -> DataFrame:
    """One-input step: optional filter, then new or replaced columns."""
    if where is not None:
        df = df.where(where)
    return df.withColumns(columns) if columns else df


def declare(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Fix the output type: columns by name, cast and checked by Spark."""
    return df.to(schema)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite", partition_by: tuple[str, ...] = (), **options) -> None:
    """Batch sink; ``fmt="csv", header=True`` gives the result files of the reports."""
    writer = df.write.format(fmt).mode(mode).options(**options)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def start_sink(
    df: DataFrame,
    checkpoint: str,
    *,
    name: str | None = None,
    fmt: str | None = None,
    path: str | None = None,
    each_batch: Callable[[DataFrame, int], None] | None = None,
    mode: str = "append",
    trigger: dict | None = None,
    **options,
):
    """Streaming sink: a format (``console``, ``memory``, ``parquet``, ``csv``, ...) or a function per micro-batch.

    ``name`` and ``checkpoint`` are the identity of the query across restarts.
    """
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).options(**options)
    if name:
        writer = writer.queryName(name)
    if each_batch is not None:
        writer = writer.foreachBatch(each_batch)
    else:
        writer = writer.format(fmt or "parquet")
    writer = writer.trigger(**(trigger or {"availableNow": True}))
    return writer.start(path) if path else writer.start()


class SideOutputs:
    """Split a result with a tag column into one DataFrame per tag; a tag keeps the schema it was first asked with."""

    def __init__(self, df: DataFrame, tag: str = "tag"):
        self._df, self._tag, self._asked = df, tag, {}

    def get(self, tag: str, schema: T.StructType | None = None) -> DataFrame:
        schema = schema or T.StructType([f for f in self._df.schema.fields if f.name != self._tag])
        if self._asked.setdefault(tag, schema) != schema:
            raise ValueError(f"side output {tag!r} was already asked for with another type")
        return self._df.where(F.col(self._tag) == tag).drop(self._tag).to(schema)
