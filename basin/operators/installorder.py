"""Install order: topological levels of items and what they need, with a report of cycles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basin.session import scratch_path

ORDERED, WAITS, CYCLE = "ordered", "waits", "cycle"


def _write(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("append").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _peel(edges: DataFrame, items: DataFrame, after: str, before: str, path: str) -> DataFrame:
    """(item, level) of the items that are reached when, round by round, those leave whose ``before`` ends all left.

    A round joins the items that just left with their edges and lowers the number of open edges of the other
    ends; each round's frontier is a table of its own, and open counts are written anew, so a lost executor costs
    a task of one round. Only the emptiness of a frontier reaches the driver.
    """
    spark = edges.sparkSession
    degree = edges.groupBy(F.col(after).alias("item")).agg(F.count("*").alias("open"))
    counts = _write(items.join(degree, "item", "left").select("item", F.coalesce("open", F.lit(0).cast("bigint")).alias("open")),
                    f"{path}/open-0")
    level, frontier = 0, counts.where("open = 0").select("item")
    while True:
        frontier = _write(frontier, f"{path}/levels/level={level}")
        if frontier.isEmpty():
            break
        freed = edges.join(frontier, F.col(before) == F.col("item"), "left_semi").groupBy(F.col(after).alias("item")).agg(
            F.count("*").alias("gone"))
        touched = counts.join(freed, "item", "left").where("open > 0").select(
            "item", (F.col("open") - F.coalesce("gone", F.lit(0))).alias("open"))
        level += 1
        counts = _write(touched, f"{path}/open-{level}")
        frontier = counts.where("open = 0").select("item")
    return spark.read.schema(items.select("item").schema.add("level", "integer")).parquet(f"{path}/levels")


def install_order(needs: DataFrame, items: DataFrame | None = None, item: str = "item", need: str = "needs") -> DataFrame:
    """(item, level, state) of every item.

    ``needs`` has a row for each item and a thing it needs; ``items`` lists further items. What is only
    needed is an item that needs nothing. An item's ``level`` is one more than the highest level of what it
    needs, 0 if that is nothing: all of a level can be installed at once, after the levels below.

    ``state`` is ``ordered``; ``cycle`` for items that lie on a cycle (or between two), an item that needs itself among
    them; and ``waits`` for items that need one of those. The last two have no level. Repeated rows count once, rows with
    a NULL need nothing, NULL items are ignored. Rounds grow with the longest chain of needs, not with the number of items.
    """
    edges = needs.select(F.col(item).alias("item"), F.col(need).alias("needs"))
    known = edges.select("item").union(edges.select("needs"))
    if items is not None:
        known = known.union(items.select(F.col(item)))
    path = scratch_path(needs.sparkSession, "install-order")
    known = _write(known.where("item IS NOT NULL").distinct(), f"{path}/items")
    edges = edges.where("item IS NOT NULL AND needs IS NOT NULL").distinct().select(F.col("item").alias("user"), "needs")
    edges = _write(edges, f"{path}/edges")
    placed = _peel(edges, known, "user", "needs", f"{path}/up")
    stuck = _write(known.join(placed.select("item"), "item", "left_anti"), f"{path}/stuck")
    state = F.lit(ORDERED)
    out = placed.select("item", "level", state.alias("state"))
    if stuck.isEmpty():
        return out
    inner = edges.join(stuck, F.col("user") == F.col("item"), "left_semi").join(stuck, F.col("needs") == F.col("item"), "left_semi")
    free = _peel(_write(inner, f"{path}/inner"), stuck, "needs", "user", f"{path}/down")  # nothing stuck needs these
    waits = free.select("item", F.lit(None).cast("int").alias("level"), F.lit(WAITS).alias("state"))
    cycle = stuck.join(free.select("item"), "item", "left_anti").select(
        "item", F.lit(None).cast("int").alias("level"), F.lit(CYCLE).alias("state"))
    return out.unionByName(waits).unionByName(cycle)
