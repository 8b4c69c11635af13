"""Rows of Arrow batches as dicts and back. Whole numbers stay whole: no detour through floats next to nulls."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def records(batches: Iterator[pa.RecordBatch], size: int = 4096) -> Iterator[list[dict]]:
    """The rows in lists of at most ``size``."""
    for batch in batches:
        for start in range(0, batch.num_rows, size):
            yield batch.slice(start, size).to_pylist()


def batch_of(rows: list[dict], schema: T.StructType) -> pa.RecordBatch:
    """Missing fields are null."""
    shape = to_arrow_schema(schema)
    return pa.record_batch([pa.array([r.get(f.name) for r in rows], f.type) for f in shape], schema=shape)
