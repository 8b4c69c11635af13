"""Mixing sources to target weights by the cube method.

A source's target over its size is how often each of its documents should be taken: a whole number of times for all, and a fraction that
is the chance of once more. Which documents are taken once more is settled by the cube method. The flight moves the chances along the
null space of the balancing constraints (how many documents, how many words), one step settling at least one document, until very few
are open. Flights run on blocks of a source's documents side by side; what a block leaves open goes on to the next level in new blocks,
hundreds of times fewer, until one block per source is left. Its last hundred documents or so land on
a choice near the target.

Rows are (id, size, chance) only. A source of any share of the rows is dealt to blocks by a hash of id and text, so that the result does
not depend on partitions. Nulls: a null text has size 0, the null source is a source of its own and comes last, null ids are documents
like others. Rows of equal id, text and source are dealt as one, with their number; each of them gets its part of the copies. A source
without words has target 0. An empty table gives an empty one. Only the three named columns are read.
"""

from __future__ import annotations

import itertools
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyclock.llm.shared import WORD, written

WEIGHTS = (3.0, 1.0, 2.0)
BLOCK = 4096
STAY = 32  # documents of a block that are left to the next level on purpose
LAND = 128  # documents of a source that are left to land
REPEATS = 4096  # rows that one row becomes within a task
_EPS = 1e-9


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``source``, ``source_size``, ``target`` from one row per source (``source``, ``source_size``).

    Shares by weight, of which none may exceed ``most`` times its source, the excess going to the others by weight again and again, end where
    every source has the lesser of its bound and a common level times its weight. Sorted by bound over weight, the level follows from
    running sums. The table has one row per source, whatever the documents."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    n = len(weights)
    row = F.row_number().over(order) - 1
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (row % n + 1).cast("int"))
    rows = sizes.select("source", "source_size", weight.alias("w"), (F.col("source_size") * most).alias("bound"))
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_bound = Window.orderBy(F.col("bound") / F.col("w"), F.col("source").asc_nulls_last())
    rows = rows.select("*", F.sum("source_size").over(everything).alias("all"))
    rows = rows.select("*", F.coalesce(F.sum("bound").over(by_bound.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("full"), F.sum("w").over(by_bound.rowsBetween(0, Window.unboundedFollowing)).alias("open"))
    level = (F.col("all") * share - F.col("full")) / F.col("open")
    rows = rows.select("*", F.max(F.when(level <= F.col("bound") / F.col("w"), level)).over(everything).alias("level"))
    return rows.select("source", "source_size", F.when(F.col("level").isNull(), F.col("bound")).otherwise(F.least("bound", F.col("level") * F.col("w"))).alias("target"))


def flight(chance: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Moves chances to 0 or 1 until at most two are open. Sums of chance over starting chance and of size times it stay as they are."""
    p = chance.tolist()
    mean = float(size.mean()) or 1.0
    # what a document adds to the two constraints as its chance moves; only ratios matter
    x = (size / mean).tolist()
    draws = iter(rng.random(len(p)).tolist())
    held: list[int] = []
    for i in range(len(p)):
        if not _EPS < p[i] < 1 - _EPS:
            p[i] = float(round(p[i]))
            continue
        held.append(i)
        if len(held) < 3:
            continue
        a, b, c = held
        u = (x[c] - x[b], x[a] - x[c], x[b] - x[a])  # orthogonal to (1, 1, 1) and to the sizes
        if u == (0.0, 0.0, 0.0):
            u = (1.0, -1.0, 0.0)
        up = down = float("inf")
        for k, d in zip(held, u):
            if d > 0:
                up, down = min(up, (1 - p[k]) / d), min(down, p[k] / d)
            elif d < 0:
                up, down = min(up, p[k] / -d), min(down, (1 - p[k]) / -d)
        step = up if next(draws) * (up + down) < down else -down
        for k, d in zip(held, u):
            p[k] += step * d
        still = [k for k in held if _EPS < p[k] < 1 - _EPS]
        if len(still) == 3:  # rounding: settle the one that is nearest to an end
            still.remove(min(still, key=lambda k: min(p[k], 1 - p[k])))
        for k in held:
            if k not in still:
                p[k] = float(round(p[k]))
        held = still
    return np.array(p)


def landed(chance: np.ndarray, size: np.ndarray, due: float, every: int = 6) -> np.ndarray:
    """Settles the open documents so that their words come near to ``due`` and their number to its expectation.

    All choices are tried for the few largest; for each, the others are taken in turn as long as one brings the words nearer."""
    open_ = np.flatnonzero((chance > _EPS) & (chance < 1 - _EPS))
    out = np.round(chance)
    if not len(open_):
        return out
    large = open_[np.argsort(-size[open_], kind="stable")[:every]]
    others = open_[~np.isin(open_, large)]
    picks = np.array(list(itertools.product((0.0, 1.0), repeat=len(large))))
    lack, taken = due - picks @ size[large], np.zeros((len(picks), len(others)))
    for j, n in enumerate(size[others].tolist()):
        take = (lack > n / 2) & (n > 0)
        taken[take, j] = 1.0
        lack = lack - n * take
    number = picks.sum(axis=1) + taken.sum(axis=1) - chance[open_].sum()
    best = np.argmin(np.abs(lack) + 0.1 * size[open_].mean() * np.abs(number))
    out[large], out[others] = picks[best], taken[best]
    return out


def _level(rows: DataFrame, last: bool) -> DataFrame:
    """One flight in every (source number, block); with ``last``, landing as well.

    A few documents of evenly spaced sizes do not fly, so that what is left to land has all sizes to choose from."""

    def fly(table: pa.Table) -> pa.Table:
        size, chance, h = (table.column(c).to_numpy() for c in ("size", "chance", "h"))
        number, block, round_ = (int(table.column(c)[0].as_py()) for c in ("number", "block", "round"))
        order = np.lexsort((size, h))  # whatever order the rows arrived in
        size, chance = size[order].astype(np.float64), chance[order]
        falling = np.argsort(-size, kind="stable")
        some = falling[(size[falling] > 0) & (chance[falling] > _EPS) & (chance[falling] < 1 - _EPS)]
        aside = some[np.unique(np.linspace(0, len(some) - 1, LAND if last else STAY).astype(int))] if len(some) else some
        flown = falling[~np.isin(falling, aside)]
        chance[flown] = flight(chance[flown], size[flown], np.random.default_rng([number & 0xFFFFFFFF, block, round_]))
        if last:
            chance = landed(chance, size, table.column("due")[0].as_py() - float(size[chance >= 1 - _EPS].sum()))
        moved = np.empty_like(chance)
        moved[order] = chance
        return table.set_column(table.schema.get_field_index("chance"), "chance", pa.array(moved))

    return rows.groupBy("number", "block").applyInArrow(fly, rows.schema)


def _identity(id_col: str, text_col: str, source_col: str) -> list[Column]:
    """128 bits of what makes rows equal: id, text and source."""
    i, t, s = F.col(id_col).cast("long"), F.coalesce(F.col(text_col), F.lit("")), F.col(source_col).cast("string")
    return [F.xxhash64(F.lit(n), i, i.isNull(), t, s, s.isNull()) for n in (1, 2)]


def repeated(rows: DataFrame, times: Column, place: str, many: bool) -> DataFrame:
    """Every row as often as ``times`` says, numbered from 0 in ``place``. With ``many``, rows of very many repeats are spread over tasks."""
    chunk, n = f"chunk_{uuid.uuid4().hex}", f"n_{uuid.uuid4().hex}"
    zero = F.lit(0).cast("long")
    rows = rows.withColumn(n, times.cast("long")).where(F.col(n) > 0)
    few = rows.where(F.col(n) <= REPEATS) if many else rows
    out = few.withColumn(place, F.explode(F.sequence(zero, F.col(n) - 1)))
    if many:
        some = rows.where(F.col(n) > REPEATS).withColumn(chunk, F.explode(F.sequence(zero, F.floor((F.col(n) - 1) / REPEATS))))
        some = some.repartition(chunk).withColumn(place, F.explode(F.sequence(F.col(chunk) * REPEATS, F.least((F.col(chunk) + 1) * REPEATS, n) - 1)))
        out = out.unionByName(some.drop(chunk))
    return out.drop(n)


def plan_of(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row for each set of equal rows (``h`` and ``h2`` stand for ``doc_id``, text and ``source``): ``size`` of one, how many there are
    (``rows``), ``source_size``, ``target``, and how often all of them together are taken (``copies``).

    Equal rows are added up before anything is dealt, so they never fill a block: whole copies of all of them, and the chance of one more."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    h, h2 = _identity(id_col, text_col, source_col)
    size = F.regexp_count(text, F.lit(WORD)).cast("long").alias("size")
    each = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), h.alias("h"), h2.alias("h2"), size)
    rows = written(each.groupBy("h", "h2").agg(*[F.first(c).alias(c) for c in ("doc_id", "source", "size")], F.count("*").alias("rows")))
    sizes = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.count("*").alias("n"))
    plan = targets(sizes.select("source", "source_size"), weights, share, most)
    times = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = plan.join(sizes.select(F.col("source").alias("s"), "n"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    plan = plan.select(F.col("source").alias("s"), "source_size", "target", "n", times.alias("times"), F.xxhash64("source", F.col("source").isNull()).alias("number"))
    open_ = rows.join(plan, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    open_ = open_.withColumn("whole", F.floor(F.col("times") * F.col("rows") + _EPS))
    open_ = open_.withColumn("chance", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("times") * F.col("rows") - F.col("whole"))))
    open_ = written(open_.drop("times"))
    due = open_.groupBy("number").agg((F.first("target") - F.sum(F.col("whole") * F.col("size"))).alias("due"))
    now = open_.join(due, "number").withColumn("round", F.lit(0))
    settled = []
    while True:
        now = now.withColumn("block", F.pmod(F.xxhash64("h", "h2", "round"), F.ceil(F.col("n") / block).cast("long")))
        many = now.where(F.col("n") > block)
        if not many.limit(1).count():
            settled.append(_level(now, last=True))
            break
        done = written(_level(many, last=False))
        open_ = (F.col("chance") > _EPS) & (F.col("chance") < 1 - _EPS)
        settled.append(done.where(~open_))
        # of each source: how many are open, and how many words the settled ones take
        after = done.groupBy("number").agg(F.sum(open_.cast("long")).alias("m"), F.sum(F.when(F.col("chance") >= 1 - _EPS, F.col("size")).otherwise(0)).alias("got"))
        left = done.where(open_).join(after, "number").withColumns({"n": F.col("m"), "due": F.col("due") - F.col("got"), "round": F.col("round") + 1}).drop("m", "got")
        now = written(left.unionByName(now.where(F.col("n") <= block)).drop("block"))
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    return written(out.select("doc_id", "source", "h", "h2", "size", "rows", "source_size", "target", (F.col("whole") + F.round("chance")).cast("long").alias("copies")))


def mixed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size, source_size, target, taken (words, repeats counted) and copies of every row."""
    plan = plan_of(docs, weights, share, most, block, id_col, text_col, source_col)
    # the copies of equal rows are dealt evenly among them
    copies = (F.floor(F.col("copies") / F.col("rows")) + (F.col("place") < F.col("copies") % F.col("rows")).cast("long")).cast("long")
    every = repeated(plan, F.col("rows"), "place", many=bool(plan.where(F.col("rows") > REPEATS).limit(1).count()))
    return every.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"))


def applied(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken, with all its columns. Rows with equal ids, texts and sources count as
    copies of one, taken as often as they are together; of further columns that differ one row's values are kept."""
    h, h2, copies, place = (f"{name}_{uuid.uuid4().hex}" for name in ("h", "h2", "copies", "place"))
    plan = plan_of(docs, weights, share, most, BLOCK, id_col, text_col, source_col).where("copies > 0")
    many = bool(plan.where(F.col("copies") > REPEATS).limit(1).count())
    plan = plan.select(F.col("h").alias(h), F.col("h2").alias(h2), F.col("copies").alias(copies))
    rows = docs.withColumns(dict(zip((h, h2), _identity(id_col, text_col, source_col)))).dropDuplicates([h, h2])
    return repeated(rows.join(plan, [h, h2]), F.col(copies), place, many).drop(h, h2, copies, place)
