"""What the operators of this subpackage share: intermediate tables in the shared folder, and Arrow batches cut to size."""

from __future__ import annotations

import sys
import tempfile
import types
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words: the six ASCII white-space characters, the same that ``bytes.split()`` splits on.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder under ``spark.checkpoint.dir``. Only a session on one machine that has none gets a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="keyclock-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/keyclock-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The same rows from a table in the shared folder: the plan before it is cut off, and it survives lost executors."""
    spark, path = df.sparkSession, shared_folder(df.sparkSession)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(df: DataFrame) -> None:
    """Deletes what ``written`` wrote, once nothing reads it any more."""
    jvm = df.sparkSession.sparkContext._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def hash_sample(df: DataFrame, by: str, most: int) -> DataFrame:
    """At most ``most`` rows, picked by a hash of a column; all where there are no more. Rows are thinned out before they are sorted,
    so that what all tasks together send to the last one is bounded, too."""
    total, cells = df.count(), 1 << 20
    if total > 2 * most:
        df = df.where(F.pmod(F.xxhash64(by), F.lit(cells)) < -(-3 * most * cells // (2 * total)))
    return df.orderBy(F.xxhash64(by), *df.columns).limit(most)


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once per row, however often ``use`` refers to it."""
    return F.transform(F.array(value), use)[0]


def slices(batch: pa.RecordBatch, column: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of which the given string or binary column holds at most ``most`` bytes, or one row."""
    import pyarrow.compute as pc

    start, held = 0, 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()):
        if held and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def once(key: tuple, make):
    """What ``make()`` returned the first time in this Python worker. Functions travel by value, so their modules keep nothing."""
    held = sys.modules.setdefault("keyclock_worker", types.ModuleType("keyclock_worker")).__dict__
    if key not in held:
        held[key] = make()
    return held[key]


class Memo:
    """Values by key in two generations: what is asked for moves to the young one; when that is full, the old one is forgotten."""

    def __init__(self, most: int) -> None:
        self.most, self.young, self.old = most, {}, {}

    def of(self, keys: set, learn) -> dict:
        """A mapping that has all the keys; ``learn`` gives the values of a list of new ones."""
        if len(self.young) > self.most:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        new = []
        for k in keys.difference(young):
            if k in old:
                young[k] = old[k]
            else:
                new.append(k)
        young.update(learn(new))
        return young


def byte_letters() -> dict[str, int]:
    """The usual byte-level alphabet: printable bytes stand for themselves, the others for the characters from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
