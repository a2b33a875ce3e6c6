"""Distributed connected components by alternating large-star and small-star steps.

Each step is a map-side-combined minimum per node and a join with it, so neither a component nor the
link list ever meets in one place. Every round is written under the shared checkpoint folder (the
one before it is deleted); rounds grow with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basin.llm._common import drop_stored, stored


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable, for every node that has a link.

    Null ends, self-links and repeated links are ignored; no links give no rows.
    """
    hi, lo = F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")
    now = stored(links.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
                 .select(hi, lo).distinct(), "components")
    before, mark = None, _mark(now)
    while mark != before and mark[0]:
        step = stored(_small_star(_large_star(now)), "components")
        drop_stored(now)
        now, before, mark = step, mark, _mark(step)
    roots = now.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(roots)


def _mark(links):
    row = links.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def _large_star(links):
    ends = links.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(links.select("lo", "hi"))
    least = ends.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return (ends.join(least, "u").filter("v > u AND v <> m")
            .select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct())


def _small_star(links):
    least = links.groupBy("hi").agg(F.min("lo").alias("m"))
    moved = links.join(least, "hi").filter("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return moved.union(least.select("hi", F.col("m").alias("lo"))).distinct()
