"""Whitening of embeddings with MLlib's BlockMatrix.

Every entry c becomes the whole number floor(64 c) + 1,000,000, so that sums are exact. Rows are packed, and numbered as the row blocks of
one matrix; each block is centred on the exact mean. The blocks' transpose times the blocks is the scatter matrix, summed up by many tasks
(the middle dimension is split, or one task would see all rows). Its eigenvectors are found on the driver, whose share is the square of the
dimension, whatever the rows; and the blocks times the whitening matrix are the projected rows.

Vectors that are null or hold a null or an entry that is no finite number are left out, and so are those of another length than most have
(of equally many the longest). Equal vectors count each. Null ids are ids like others. Components whose eigenvalue is nothing beside the
largest have no scale: their ``whitened`` is null, and they do not enter ``identity_error``. A deviation beyond a long is null. An empty
table gives an empty one. Only the two named columns are read."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices, MatrixUDT
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyclock.llm.shared import written

ROWS = 1024  # of a block
COLS = 1024
SHIFT = 1_000_000
COMPONENTS = 32
FLAT = 1e-12  # of the largest eigenvalue
_OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def packs(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Up to ``ROWS`` rows of one length each: ``part`` and ``place`` (the task that packed them, and the pack's number among its packs of
    that length), ``dim``, ``ids``, ``x`` (whole numbers, one vector after the other) and their ``sums``."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, places = TaskContext.get().partitionId(), {}
        for batch in batches:
            lists = batch.column(1)
            lengths = lists.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
            for dim in np.unique(lengths[lengths > 0]).tolist():
                rows = np.flatnonzero(lengths == dim)
                some = pa.array(rows)
                ids = batch.column(0).take(some)
                entries = lists.take(some).flatten()
                values = entries.cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False).reshape(-1, dim)
                good = np.isfinite(values).all(axis=1)
                x = np.floor(values[good] * 64).astype(np.int64) + SHIFT
                ids = ids.filter(pa.array(good))
                for i in range(0, len(x), ROWS):
                    mine = x[i : i + ROWS]
                    place = places[dim] = places.get(dim, -1) + 1
                    row = (part, place, dim, ids[i : i + ROWS].to_pylist(), mine.ravel(), mine.sum(axis=0))
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names)

    long_list = pa.list_(pa.int64())
    types = [pa.int32(), pa.int64(), pa.int32(), long_list, long_list, long_list]
    names = ["part", "place", "dim", "ids", "x", "sums"]
    rows = vectors.select(F.col(id_col).cast("long"), F.col(vector_col).cast("array<double>"))
    return rows.mapInArrow(packed, "part int, place long, dim int, ids array<long>, x array<long>, sums array<long>")


def block_matrix(blocks: DataFrame, rows: int, columns: int, row_blocks: int, all_columns: int) -> BlockMatrix:
    """A distributed matrix of the rows ((row block, column block), matrix) of a DataFrame, which no Python object stands between."""
    made = callMLlibFunc("createBlockMatrix", blocks, rows, columns, rows * row_blocks, all_columns)
    return BlockMatrix(made, rows, columns, rows * row_blocks, all_columns)


def centred_blocks(packed: DataFrame, mean: np.ndarray, first: dict[int, int]) -> DataFrame:
    """The packs as dense blocks of ``ROWS`` by ``COLS``, less the mean; what is missing of a block is zero and adds nothing to sums."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, place, x in zip(*(batch.column(c) for c in ("part", "place", "x"))):
                rows = x.values.to_numpy().reshape(-1, dim) - mean
                for j in range(0, dim, COLS):
                    block = np.zeros((ROWS, min(COLS, dim - j)))
                    block[: len(rows)] = rows[:, j : j + COLS]
                    at = pa.StructArray.from_arrays([pa.array([first[part.as_py()] + place.as_py()]), pa.array([j // COLS])], ["row", "column"])
                    yield pa.RecordBatch.from_arrays([at, _matrix(block)], ["at", "block"])

    dim = len(mean)
    at = T.StructType([T.StructField("row", T.LongType()), T.StructField("column", T.LongType())])
    return packed.select("part", "place", "x").mapInArrow(blocks, T.StructType([T.StructField("at", at), T.StructField("block", MatrixUDT())]))


def _matrix(values: np.ndarray) -> pa.StructArray:
    """A dense matrix, row after row, as MLlib's type has it."""
    none = pa.array([None], pa.list_(pa.int32()))
    fields = {
        "type": pa.array([1], pa.int8()),
        "numRows": pa.array([values.shape[0]], pa.int32()),
        "numCols": pa.array([values.shape[1]], pa.int32()),
        "colPtrs": none,
        "rowIndices": none,
        "values": pa.array([values.ravel()], pa.list_(pa.float64())),
        "isTransposed": pa.array([True]),
    }
    return pa.StructArray.from_arrays(list(fields.values()), list(fields))


def scatter(rows: BlockMatrix, splits: int) -> np.ndarray:
    """The rows' transpose times the rows."""
    # multiply() of the Python class cannot split the middle dimension, the method behind it can
    product = rows.transpose()._java_matrix_wrapper.call("multiply", rows._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(product, rows.colsPerBlock, rows.colsPerBlock).toLocalMatrix().toArray()


def whitening(covariance: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """The eigenvalues of the largest components, and one column for each: its unit eigenvector over the root of its eigenvalue."""
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = np.maximum(values[::-1][:components], 0.0), vectors[:, ::-1][:, :components]
    useful = values > FLAT * values[0]
    return values, vectors * np.where(useful, 1 / np.sqrt(np.where(useful, values, 1.0)), 0.0)


def projected(rows: BlockMatrix, matrix: np.ndarray, spark: SparkSession) -> DataFrame:
    """``index`` (of the row block) and ``block``, the rows times the matrix."""
    parts = [((j // COLS, 0), Matrices.dense(*matrix[j : j + COLS].shape, matrix[j : j + COLS].ravel(order="F"))) for j in range(0, len(matrix), COLS)]
    right = BlockMatrix(spark.sparkContext.parallelize(parts, 1), min(COLS, len(matrix)), matrix.shape[1], *matrix.shape)
    product = rows.multiply(right)
    return callMLlibFunc("getMatrixBlocks", product._java_matrix_wrapper._java_model).select(F.col("_1._1").cast("long").alias("index"), F.col("_2").alias("block"))


def identity_error(rows: DataFrame, n: int, useful: int, width: int) -> float:
    """The largest entry by which the covariance of ``w`` (whitened rows, one after the other) differs from the identity."""

    def sums(centre: np.ndarray | None):
        def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = 0.0
            for batch in batches:
                for w in batch.column(0):
                    values = w.values.to_numpy().reshape(-1, width)[:, :useful]
                    total = total + (values.sum(axis=0) if centre is None else (values - centre).T @ (values - centre))
            if not np.isscalar(total):
                yield pa.record_batch([pa.array(range(total.size)), pa.array(total.ravel())], ["entry", "value"])

        entries = rows.select("w").mapInArrow(added, "entry long, value double").groupBy("entry").agg(F.sum("value").alias("value"))
        return np.array([r.value for r in entries.orderBy("entry").collect()])  # as many as the components, or their square

    centre = sums(None) / n
    covariance = sums(centre).reshape(useful, useful) / n
    return float(np.abs(covariance - np.eye(useful)).max())


def whitened(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, component (from 1, largest eigenvalue first), n, deviation, whitened, explained and identity_error of every vector."""
    spark = vectors.sparkSession
    every = written(packs(vectors, id_col, vector_col))
    dims = every.groupBy("dim").agg(F.sum(F.size("ids")).alias("n")).orderBy(F.desc("n"), F.desc("dim")).limit(1).collect()
    if not dims:
        return spark.createDataFrame([], _OUT)
    dim, n = dims[0].dim, dims[0].n
    packed = every.where(F.col("dim") == dim)
    totals = packed.select(F.posexplode("sums").alias("i", "s")).groupBy("i").agg(F.sum("s").alias("s")).orderBy("i").collect()
    total = np.array([r.s for r in totals], dtype=np.int64)
    mean = np.array([int(s) / n for s in total])  # the quotient of whole numbers, rounded once
    # one number per task that packed, as zipWithIndex has it
    counts = packed.groupBy("part").count().orderBy("part").collect()
    first = dict(zip([r["part"] for r in counts], np.cumsum([0, *(r["count"] for r in counts)]).tolist()))
    row_blocks = sum(r["count"] for r in counts)

    rows = block_matrix(centred_blocks(packed, mean, first), ROWS, min(COLS, dim), row_blocks, dim)
    splits = max(1, min(row_blocks, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    covariance = scatter(rows, splits) / n
    width = min(components, dim)
    values, matrix = whitening(covariance, width)
    useful = int((values > FLAT * values[0]).sum())

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index = [first[p] + q for p, q in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(index, pa.int64()), batch.column(2), batch.column(3)], ["at", "ids", "x"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, x, block in zip(batch.column(0), batch.column(1), batch.column(2)):
                whole = x.values.to_numpy().reshape(-1, dim)
                away = np.abs(whole * n - total) if n < 1 << 31 else whole.astype(object) * n - total.astype(object)
                if away.dtype == object or away.max(initial=0) >= (1 << 31) // int(np.sqrt(dim) + 1):
                    away = [sum(int(v) ** 2 for v in r) for r in away]
                    away = [v if v < 1 << 63 else None for v in away]
                else:
                    away = (away * away).sum(axis=1)
                shape = (block["numRows"].as_py(), block["numCols"].as_py())
                w = block["values"].values.to_numpy()
                w = w.reshape(shape) if block["isTransposed"].as_py() else w.reshape(shape[::-1]).T
                columns = [ids.as_py(), away, np.ascontiguousarray(w[: len(whole)]).ravel()]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(columns, types)], ["ids", "deviation", "w"])

    types = [pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.float64())]
    index = packed.select("part", "place", "ids", "x").mapInArrow(indexed, "at long, ids array<long>, x array<long>")
    both = index.join(projected(rows, matrix, spark), F.col("at") == F.col("index")).select("ids", "x", "block")
    done = written(both.mapInArrow(joined, "ids array<long>, deviation array<long>, w array<double>"))
    error = identity_error(done, n, useful, width) if useful else None
    trace = float(np.trace(covariance))
    explained = [float(v / trace) if trace > 0 else None for v in values]

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, deviation, w in zip(*batch.columns):
                many = len(ids)
                scaled = pa.array(w.values.to_numpy(), mask=np.tile(np.arange(width) >= useful, many))
                each = pa.array(np.repeat(np.arange(many), width))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.values.take(each),
                        pa.array(np.tile(np.arange(1, width + 1, dtype=np.int32), many)),
                        pa.array(np.full(many * width, n)),
                        deviation.values.take(each),
                        scaled,
                        pa.array(explained * many, pa.float64()),
                        pa.array([error] * (many * width), pa.float64()),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return done.mapInArrow(told, _OUT)
