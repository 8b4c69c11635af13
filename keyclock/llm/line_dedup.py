"""Winnowing over line hashes: repeated runs of lines are deleted from where they come later. DataFrame operations only.

A text is its lines with a word, each known by a hash of the line without white space at its ends. From every line on a window reaches as
far as ``least_words`` words take; what a window holds depends on its lines alone, so a run of at least that many words has the same
windows wherever it stands, and the same least line in each. These minima are selected, a few lines of each text; nothing else is joined.

1. Every selected line is joined with the first place, by (id, text hash, line), where that line is selected: one partner each, however
   many copies there are. Neighbours with the same shift are taken together, and extended both ways line by line. If the run has
   ``least_words`` words, it is a repeat.
2. A line that is selected in three places or more can stand elsewhere in other company first. Its windows that no run of step 1 covers
   are looked up once more by all their lines; no other window is.

All lines of a run go from the later place. So every line that lies in a run of ``least_words`` words or more of which a copy stands
earlier is deleted, and no first window ever loses to its own copy. A line of 50 words is a run like any other. Only whole lines can be
equal: a passage inside longer lines, or broken differently, is not seen.

Only hashes are shuffled, never texts. A line in a third of all rows is summed up before the shuffle, and its join is one
that adaptive execution splits. Nulls: null and wordless texts have no lines; null ids come last. Rows with equal ids and texts count as
one document and get the same result. Very long texts are more rows of lines. Empty tables give empty results.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyclock.llm.shared import WORD, written

LEAST_WORDS = 40
_LAST = (1 << 63) - 1


def _key(id_col: str, text_col: str) -> tuple[Column, Column]:
    return F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)), F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def lines_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per distinct document: ``d``, ``h``, and arrays of its worded lines: hashes ``hs``, words ``ns``, numbers ``at``."""
    d, h = _key(id_col, text_col)
    lines = F.transform(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n"), lambda x, i: F.struct(F.xxhash64(F.trim(F.regexp_replace(x, r"^[\x09-\x0D\x20]+|[\x09-\x0D\x20]+$", ""))).alias("h"), F.regexp_count(x, F.lit(WORD)).alias("n"), i.alias("i")))
    rows = docs.select(d.alias("d"), h.alias("h"), F.filter(lines, lambda x: x["n"] > 0).alias("x")).where(F.size("x") > 0)
    return rows.select("d", "h", F.col("x.h").alias("hs"), F.col("x.n").alias("ns"), F.col("x.i").alias("at")).dropDuplicates(["d", "h"])


def _alike(a: Column, b: Column) -> Column:
    """How many of the first entries are equal."""
    equal = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    stop = F.array_position(equal, F.lit(False))
    return F.when(stop > 0, stop - 1).otherwise(F.size(equal)).cast("int")


def _extended(matched: DataFrame, lines: DataFrame) -> DataFrame:
    """``matched`` (``d``, ``h``, ``fd``, ``fh``, ``shift``, ``ms``: places that are equal in both documents, in order) with ``begin`` and
    ``end``, where the equal lines around them reach. Places with unequal lines between them are parted, each with its own."""
    own = lines.select("d", "h", "hs", "ns")
    first = lines.select(F.col("d").alias("fd"), F.col("h").alias("fh"), F.col("hs").alias("fs"))
    both = matched.join(own, ["d", "h"]).join(first, ["fd", "fh"])
    b, e = F.array_min("ms"), F.array_max("ms")
    solid = F.slice("hs", b + 1, e - b + 1) == F.slice("fs", b - F.col("shift") + 1, e - b + 1)
    parts = F.when(solid, F.array(F.col("ms"))).otherwise(F.transform("ms", lambda m: F.array(m)))
    both = both.withColumn("ms", F.explode(parts)).withColumns({"b": F.array_min("ms"), "e": F.array_max("ms")})

    def after(x: str, end: Column) -> Column:
        return F.slice(F.col(x), end + 2, F.greatest(F.lit(0), F.size(x) - end - 1))

    def ahead(x: str, begin: Column) -> Column:
        return F.reverse(F.slice(F.col(x), F.lit(1), begin))

    shift = F.col("shift")
    begin = F.col("b") - _alike(ahead("hs", F.col("b")), ahead("fs", F.col("b") - shift))
    end = F.col("e") + _alike(after("hs", F.col("e")), after("fs", F.col("e") - shift))
    both = both.withColumns({"begin": begin, "end": end})
    words = F.aggregate(F.slice("ns", F.col("begin") + 1, F.col("end") - F.col("begin") + 1), F.lit(0), lambda x, y: x + y)
    return both.withColumn("words", words).drop("hs", "ns", "fs", "b", "e")


def _together(found: DataFrame, place: str) -> DataFrame:
    """Neighbouring matches (``d``, ``h``, place, ``fd``, ``fh``, ``shift``) with one shift to one document as one row, with all its ``ms``."""
    order = Window.partitionBy("d", "h").orderBy(place)
    same = (F.lag("fd").over(order) == F.col("fd")) & (F.lag("fh").over(order) == F.col("fh")) & (F.lag("shift").over(order) == F.col("shift"))
    found = found.withColumn("run", F.sum(F.when(same, 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return found.groupBy("d", "h", "run", "fd", "fh", "shift").agg(F.sort_array(F.collect_list(place)).alias("ms")).drop("run")


def selected_windows(lines: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """Windows of ``least_words`` words: ``d``, ``h``, ``i`` (first line), ``e`` (last), and the least of its lines: ``m`` (place), ``line``."""
    flat = lines.select("d", "h", F.posexplode(F.arrays_zip("hs", "ns")).alias("i", "x")).select("d", "h", "i", F.col("x.hs").alias("line"), F.col("x.ns").alias("n"))
    before = Window.partitionBy("d", "h").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    flat = flat.withColumn("c", F.coalesce(F.sum("n").over(before), F.lit(0)))
    reach = Window.partitionBy("d", "h").orderBy("c").rangeBetween(0, least_words - 1)
    windows = flat.select(
        "d",
        "h",
        "i",
        F.min(F.struct("line", "i")).over(reach).alias("least"),
        F.last("i").over(reach).alias("e"),
        ((F.max(F.col("c") + F.col("n")).over(reach) - F.col("c")) >= least_words).alias("whole"),
    )
    return windows.where("whole").select("d", "h", "i", "e", F.col("least.i").alias("m"), F.col("least.line").alias("line"))


def runs(lines: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """Runs of lines ``begin`` to ``end`` (places in the arrays) of document (``d``, ``h``) that stand at an earlier place, too."""
    windows = written(selected_windows(lines, least_words))
    chosen = windows.select("d", "h", "m", "line").distinct()
    firsts = chosen.groupBy("line").agg(F.min(F.struct("d", "h", "m")).alias("f"), F.count("*").alias("places")).where("places > 1")
    found = chosen.join(firsts, "line").where(F.struct("d", "h", "m") > F.col("f"))
    found = found.select("d", "h", "m", F.col("f.d").alias("fd"), F.col("f.h").alias("fh"), (F.col("m") - F.col("f.m")).alias("shift"))
    around = written(_extended(_together(found, "m"), lines))

    # windows that a line's first place does not explain, where there are other places
    reached = around.select("d", "h", F.explode("ms").alias("m"), "begin", "end")
    often = firsts.where("places > 2").select("line")
    rest = windows.join(often, "line", "left_semi").join(reached, ["d", "h", "m"]).where("i < begin or e > end")
    rest = written(rest.select("d", "h", "i", "e", "line"))
    content = F.xxhash64(F.slice("hs", F.col("i") + 1, F.col("e") - F.col("i") + 1)).alias("content")
    pool = windows.join(rest.select("line").distinct(), "line", "left_semi").join(lines.select("d", "h", "hs"), ["d", "h"]).select("d", "h", "i", "e", "line", content)
    pool = written(pool)
    firsts = pool.groupBy("line", "content").agg(F.min(F.struct("d", "h", "i")).alias("f"), F.count("*").alias("places")).where("places > 1")
    again = pool.join(rest.select("d", "h", "i"), ["d", "h", "i"], "left_semi").join(firsts, ["line", "content"]).where(F.struct("d", "h", "i") > F.col("f"))
    again = again.select("d", "h", "i", F.col("f.d").alias("fd"), F.col("f.h").alias("fh"), (F.col("i") - F.col("f.i")).alias("shift"))
    more = _extended(_together(again, "i"), lines)
    return around.unionByName(more).where(F.col("words") >= least_words).select("d", "h", "begin", "end")


def removals(docs: DataFrame, least_words: int = LEAST_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``d``, ``h`` and ``gone`` (numbers of the lines to be deleted, from 0) of every distinct document that loses a line."""
    lines = written(lines_of(docs, id_col, text_col))
    gone = runs(lines, least_words).select("d", "h", F.explode(F.sequence("begin", "end")).alias("i"))
    gone = gone.groupBy("d", "h").agg(F.sort_array(F.collect_set("i")).alias("i"))
    return gone.join(lines.select("d", "h", "at", "ns"), ["d", "h"]).select(
        "d", "h", F.transform("i", lambda i: F.get(F.col("at"), i)).alias("gone"), F.aggregate(F.transform("i", lambda i: F.get(F.col("ns"), i)), F.lit(0), lambda a, b: a + b).cast("long").alias("words")
    )


def summary(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, removed_lines (numbers, from 0), n_removed and words_removed of every row."""
    d, h = _key("doc_id", "text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), d.alias("d"), h.alias("h")).join(removals(docs, least_words), ["d", "h"], "left")
    gone = F.coalesce("gone", F.array().cast("array<int>"))
    return rows.select("doc_id", gone.alias("removed_lines"), F.size(gone).cast("long").alias("n_removed"), F.coalesce("words", F.lit(0)).cast("long").alias("words_removed"))


def deduplicated(docs: DataFrame, least_words: int = LEAST_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the repeated runs of lines deleted from the text; all other lines, blank ones too, stay as they are."""
    d, h = _key(id_col, text_col)
    keys = [f"{name}_{uuid.uuid4().hex}" for name in ("id", "hash", "gone")]
    gone = removals(docs, least_words, id_col, text_col).select(F.col("d").alias(keys[0]), F.col("h").alias(keys[1]), F.col("gone").alias(keys[2]))
    rows = docs.withColumns({keys[0]: d, keys[1]: h}).join(gone, keys[:2], "left")
    left = F.array_join(F.filter(F.split(F.col(text_col), "\n"), lambda _, i: ~F.array_contains(F.col(keys[2]), i)), "\n")
    return rows.withColumn(text_col, F.when(F.col(keys[2]).isNull(), F.col(text_col)).otherwise(left)).select(*docs.columns)
