"""Consecutive numbering in a stated order, without a window over a whole group.

``row_number()`` over ``partitionBy(group)`` sends every row of a group to one task; a group that
holds a third of the data would then be sorted by one task. Instead rows are first put in at most
``slices`` + 1 consecutive slices of the order (group first, so a large group spans many). The slice bounds are a
sample that every evaluation draws alike: of the rows whose hash falls in one of ``slices`` buckets, the
one with the smallest hash, an aggregate combined in each task before the shuffle. Rows are numbered within
(group, slice) and the counts of earlier slices are added; that window runs over the counts, at most one row per
group and slice. Nothing is stored, and no job runs before the result is asked for.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basin.operators._common import all_of, as_list

#: The default number of slices is the session's shuffle partitions, at most this many.
SLICES = 1024


def _sliced(df: DataFrame, group: list, order: list, slices: int):
    """``df`` with its group columns, order columns and ``__slice``; the names of the group and order columns."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    tie = F.xxhash64(*[F.col(f"`{c}`") for c, t in df.dtypes if "map<" not in t and "variant" not in t])
    names = [f"__k{i}" for i in range(len(group) + len(order) + 1)]
    keyed = df.select("*", *[col(c).alias(n) for c, n in zip(group + order + [tie], names)])
    key, h = F.struct(*names), F.xxhash64(*names)
    sample = keyed.select(key.alias("key"), h.alias("h")).groupBy(F.pmod("h", F.lit(slices)).alias("b")).agg(
        F.min(F.struct("h", "key")).alias("one"))
    bounds = sample.agg(F.array_sort(F.collect_list("one.key")).alias("bounds")).scalar()
    tagged = keyed.withColumn("__bounds", bounds)
    steps = F.sequence(F.lit(1), F.lit(ceil(log2(slices)) + 1))

    def halve(s, _):  # how many bounds are below the key, by bisection
        middle = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        below = F.get(F.col("__bounds"), middle) < key
        more = s["lo"] < s["hi"]
        return F.struct(F.when(more & below, middle + 1).otherwise(s["lo"]).alias("lo"),
                        F.when(more & ~below, middle).otherwise(s["hi"]).alias("hi"))

    start = F.struct(F.lit(0).alias("lo"), F.size("__bounds").alias("hi"))
    tagged = tagged.withColumn("__slice", F.aggregate(steps, start, halve, lambda s: s["lo"])).drop("__bounds")
    return tagged, names[:len(group)], names[len(group):]


def dense_index(df: DataFrame, order, group=None, base: int = 0, name: str = "idx",
                slices: int | None = None) -> DataFrame:
    """Add ``name`` = ``base`` + 0, 1, 2, ... in ``order`` within each ``group`` (or overall).

    ``order`` is ascending, NULLs first. Rows with equal group and order values get consecutive numbers by a hash
    of the whole row, so a tie spreads over slices too; only rows equal in everything share one. ``slices`` goes
    with the size of the table: each is sorted by one task, and the bounds are looked through for every row.
    """
    cols = df.columns
    slices = slices or min(SLICES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    tagged, gcols, ocols = _sliced(df, as_list(group), as_list(order), slices)
    counts = tagged.groupBy(*gcols, "__slice").agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy(*gcols).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*[F.col(g).alias(f"_{g}") for g in gcols], F.col("__slice").alias("__at"),
                            F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__off"))
    within = Window.partitionBy(*gcols, "__slice").orderBy(*ocols)
    numbered = tagged.withColumn("__row", F.row_number().over(within))
    same = [F.col("__slice") == F.col("__at")] + [F.col(g).eqNullSafe(F.col(f"_{g}")) for g in gcols]
    joined = numbered.join(offsets, all_of(same))
    index = (F.lit(base) + F.col("__off") + F.col("__row") - 1).cast("long").alias(name)
    return joined.select(*[F.col(f"`{c}`") for c in cols], index)
