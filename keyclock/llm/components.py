"""Connected components of links that no single machine could hold, by alternating large-star and small-star rounds.

Each round is two aggregations and two joins on the links, kept in the shared folder. A node of very many links is summed up before it is
shuffled, and its join is one that adaptive execution can split. The number of rounds grows with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyclock.llm.shared import removed, written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``root``, the least node it is connected with, for every node that has a link and is not the root itself.

    Links with a null end and links of a node with itself say nothing and are left out; repeated links count once."""
    clean = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), F.col(a).alias("a"), F.col(b).alias("b"))
    now = written(clean.where("a is not null and b is not null and u <> v").select("u", "v").distinct())
    said = _sum(now)
    while said[0]:
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = written(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = written(small.unionAll(least.select("u", F.col("m").alias("v"))).distinct())
        removed(large)
        removed(now)
        now, before, said = after, said, _sum(after)
        if said == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _sum(links: DataFrame) -> tuple:
    row = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003), F.sum(F.xxhash64("v", "u") % 998_244_353)).first()
    return tuple(row)
