"""Running aggregates in arrival order that no single key can turn into one big task.

A plain ``Window.partitionBy(key)`` sorts all rows of a key in one task. Here the rows of a key are cut into slices. Each
slice is first summarised by an ordinary (map-side combined) ``groupBy``; a window over those few summaries gives every
slice what came before it; that carry is put in front of the slice as one extra row, and the real window then works
inside slices only. One wide shuffle of the rows, on (keys, slice), and no join.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_AGG = {"max": F.max, "min": F.min, "sum": F.sum, "xor": F.bit_xor}


@dataclass(frozen=True)
class Fold:
    """Running ``max``, ``min``, ``sum`` or ``xor`` (of whole numbers, bit by bit) of ``value`` under the name ``out``."""

    out: str
    kind: str
    value: Column

    def over(self, name: str) -> Column:
        return _AGG[self.kind](F.col(name))


def running(
    df: DataFrame,
    keys,
    order: list[Column],
    slice_by: Column,
    folds: list[Fold],
    *,
    inclusive: bool = True,
    unit: Column | None = None,
    keep_slice: str | None = None,
) -> DataFrame:
    """Add the running value of every fold.

    ``slice_by`` must not decrease along ``order``. ``inclusive`` says whether a row sees itself. With ``unit`` given
    (a coarser slice, e.g. an arrival tick) a row sees exactly the rows of earlier units and nothing of its own.
    ``keep_slice`` keeps the slice as a column: windows over (keys, slice) then follow without another shuffle.
    """
    keys = list(keys)
    parts = keys + (["__u", "__s"] if unit is not None else ["__s"])
    lead = "__u" if unit is not None else "__s"
    vals = {f"__v{i}": f for i, f in enumerate(folds)}

    base = df.withColumn("__s", slice_by)
    if unit is not None:
        base = base.withColumn("__u", unit)
    base = base.withColumns({v: f.value for v, f in vals.items()})

    before = Window.partitionBy(*keys).orderBy(lead)
    if unit is None:
        before = before.rowsBetween(Window.unboundedPreceding, -1)
    else:  # the slices of one unit all get what earlier units left
        before = before.rangeBetween(Window.unboundedPreceding, -1)
    carry = (
        base.groupBy(*parts)
        .agg(*[f.over(v).alias(v) for v, f in vals.items()])
        .select(*parts, *[f.over(v).over(before).alias(v) for v, f in vals.items()])
        .where(reduce(or_, [F.col(v).isNotNull() for v in vals]))
        .withColumn("__row", F.lit(0))
    )
    rows = base.withColumn("__row", F.lit(1))
    if unit is not None:
        rows = rows.withColumns({v: F.lit(None).cast(base.schema[v].dataType) for v in vals})

    inside = (
        Window.partitionBy(*parts)
        .orderBy("__row", *order)
        .rowsBetween(Window.unboundedPreceding, 0 if inclusive or unit is not None else -1)
    )
    out = (
        rows.unionByName(carry, allowMissingColumns=True)
        .withColumns({f.out: f.over(v).over(inside) for v, f in vals.items()})
        .where(F.col("__row") == 1)
    )
    if keep_slice is not None:
        out = out.withColumnRenamed("__s", keep_slice)
    return out.drop("__row", "__s", "__u", *vals)
