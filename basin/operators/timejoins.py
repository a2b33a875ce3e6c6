"""Joins by time: the latest earlier row (as-of), and overlapping intervals.

Neither is an equality, so a plain join would compare every pair of a key. Here rows are brought together by
sorting (as-of) or by the cells of a grid (intervals), and a key that holds a third of all rows is spread over
many tasks in both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basin.operators._common import all_of, as_list, stored

#: Rows of one side in a grid cell from which on the cell is split, and the most cells that can be split.
HOT_ROWS = 50_000
HOT_CELLS = 10_000


def asof_join(left: DataFrame, right: DataFrame, left_ts: str, right_ts: str, by=None, right_by=None, strict: bool = False,
              tolerance: Column | None = None, prefix: str = "right_", slices: int | None = None) -> DataFrame:
    """Every left row with the latest right row of its key that is not later.

    ``by`` (and ``right_by``, where the names differ) are the key columns; without them the whole tables are one
    key. ``strict`` asks for an earlier row, not an equally late one. ``tolerance`` is an interval: an
    older right row is no match. Output: the left columns, then all right columns under ``prefix``, NULL
    without a match. Of right rows with equal key and time the greatest wins (its columns in order), so columns
    of the right must be orderable. Rows with a NULL key or time match nothing; left ones are kept.

    Both sides are united and range-sorted by key and time into slices, so a large key covers many slices.
    Within a slice the last right row is carried forward by a window over the slice; where a slice begins in
    the middle of a key, the last right row before it is carried over: of each slice only its last right row
    is needed, one row for each partition. No window or task holds a whole key. ``slices`` sets their number;
    by default it follows from the shuffle's size.
    """
    by = as_list(by)
    right_by = as_list(right_by) or by
    keys, n = [f"__k{i}" for i in range(len(by))], len(by)
    side = lambda df, cols, ts: [F.col(c).alias(k) for c, k in zip(cols, keys)] + [F.col(ts).alias("__t")]
    row = lambda df: F.struct(*[F.col(f"`{c}`") for c in df.columns])
    usable = lambda cols, ts: all_of([F.col(c).isNotNull() for c in [*cols, ts]])
    none_left, none_right = (F.lit(None).cast(df.select(row(df).alias("r")).schema[0].dataType) for df in (left, right))
    # at equal times a right row stands before the left rows it matches
    ls = left.select(*side(left, by, left_ts), F.lit(1).alias("__side"), row(left).alias("__l"), none_right.alias("__r"))
    rs = right.where(usable(right_by, right_ts)).select(
        *side(right, right_by, right_ts), F.lit(2 if strict else 0).alias("__side"), none_left.alias("__l"), row(right).alias("__r"))
    # the hash spreads left rows that are equal in all else
    both = ls.unionByName(rs).withColumn("__salt", F.when(F.col("__side") == 1, F.xxhash64("__l")))
    order = [*keys, "__t", "__side", "__r", "__salt"]
    ranged = both.repartitionByRange(*order) if slices is None else both.repartitionByRange(slices, *order)
    sliced = stored(ranged.withColumn("__slice", F.spark_partition_id()), "asof")
    place = F.struct(*[F.col(c) for c in [*keys, "__t", "__r"]])
    carried = Window.partitionBy("__slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    within = sliced.withColumn("__own", F.last(F.when(F.col("__r").isNotNull(), place), ignorenulls=True).over(carried))
    tails = sliced.groupBy("__slice").agg(F.max(F.when(F.col("__r").isNotNull(), place)).alias("__tail"))  # a row for each slice
    before = Window.orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    tails = tails.select(F.col("__slice").alias("__at"), F.last("__tail", ignorenulls=True).over(before).alias("__before"))
    rows = within.where("__side = 1").join(F.broadcast(tails), F.col("__slice") == F.col("__at"))
    rows = rows.withColumn("__last", F.coalesce("__own", "__before"))
    fits = all_of([F.col(f"__last.{k}") == F.col(k) for k in keys]) & F.col("__t").isNotNull() & F.col("__last").isNotNull()
    if tolerance is not None:
        fits &= F.col("__last.__t") >= F.col("__t") - tolerance
    return rows.select("__l.*", *[F.when(fits, F.col(f"__last.__r.`{c}`")).alias(f"{prefix}{c}") for c in right.columns])


def _number(c: Column, kind: str) -> Column:
    """A time as microseconds; a number as it is."""
    if kind in ("timestamp", "timestamp_ntz", "date"):
        return F.unix_micros(c.cast("timestamp")).cast("double")
    return c.cast("double")


def interval_join(left: DataFrame, right: DataFrame, left_range, right_range, by=None, right_by=None, width: float | None = None,
                  prefix: str = "right_", hot_rows: int = HOT_ROWS) -> DataFrame:
    """All pairs of a left and a right row with equal keys whose closed intervals have a point in common.

    ``left_range`` and ``right_range`` name the columns of begin and end (times or numbers; the same name twice for a
    point, so a range or BETWEEN join is one of a point and an interval). Rows with a NULL key or bound, or that end
    before they begin, match nothing. Output: the left columns, then all right columns under ``prefix``.

    Intervals are cut over a grid of ``width`` (in the numbers' unit, microseconds for times; by default twice the mean
    length of both sides, so an interval covers about two cells) and joined by key and cell. A pair that meets in several
    cells is kept in the first one both have. Cells with more than ``hot_rows`` rows of a side (never more than
    ``HOT_CELLS`` cells) are split: that side's rows are dealt over parts and the other side's copied to each.
    """
    by = as_list(by)
    right_by = as_list(right_by) or by
    keys = [f"__k{i}" for i in range(len(by))]

    def bounds(df, cols, names):
        kind = df.schema[cols[0]].dataType.simpleString()
        lo, hi = _number(F.col(cols[0]), kind), _number(F.col(cols[1]), df.schema[cols[1]].dataType.simpleString())
        given = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), lo.alias("lo"), hi.alias("hi"),
                          *[F.col(c).alias(k) for c, k in zip(names, keys)])
        return given.where(all_of([F.col(k).isNotNull() for k in keys]) & (F.col("lo") <= F.col("hi"))
                           & ~F.isnan("lo") & ~F.isnan("hi"))

    ls, rs = bounds(left, as_list(left_range), by), bounds(right, as_list(right_range), right_by)
    if width is None:
        size = ls.select("lo", "hi").union(rs.select("lo", "hi")).agg(
            F.avg(F.col("hi") - F.col("lo")).alias("mean"), (F.max("hi") - F.min("lo")).alias("span"), F.count("*").alias("n")).first()
        mean, span, count = size.mean or 0.0, size.span or 0.0, size.n or 1
        width = 2 * mean or span / count or 1.0

    def cut(df, side):
        cells = F.sequence(F.floor(F.col("lo") / width), F.floor(F.col("hi") / width))
        return df.select("*", F.floor(F.col("lo") / width).alias("first"), F.explode(cells).alias("cell")).withColumnsRenamed(
            {c: f"{side}{c}" for c in ("row", "lo", "hi", "first")})

    def parts(df, name):
        """Of each hot cell the number of parts this side is dealt over."""
        at = df.select(F.col("cell").alias("__cell"), *[F.col(k).alias(f"_{k}") for k in keys])
        sizes = at.groupBy("__cell", *[f"_{k}" for k in keys]).agg(F.count("*").alias("n"))
        total = at.select(F.greatest(F.ceil(F.count("*") / HOT_CELLS), F.lit(hot_rows))).scalar()  # fewer than HOT_CELLS exceed it
        return sizes.where(F.col("n") > total).select("__cell", *[f"_{k}" for k in keys], F.ceil(F.col("n") / hot_rows).cast("int").alias(name))

    a, b = cut(ls, "l"), cut(rs, "r")
    hot = parts(a, "__pl"), parts(b, "__pr")
    dealt = []
    for df, own, other, mine, other_part in ((a, "__pl", "__pr", "__i", "__j"), (b, "__pr", "__pl", "__j", "__i")):
        for table in hot:
            same = [F.col("cell") == F.col("__cell")] + [F.col(k) == F.col(f"_{k}") for k in keys]
            df = df.join(F.broadcast(table), all_of(same), "left").drop("__cell", *[f"_{k}" for k in keys])
        spread = F.xxhash64("lrow" if mine == "__i" else "rrow")
        dealt.append(df.withColumn(mine, F.pmod(spread, F.coalesce(own, F.lit(1)).cast("bigint"))).withColumn(
            other_part, F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce(other, F.lit(1)).cast("bigint") - 1))).drop("__pl", "__pr"))
    met = dealt[0].join(dealt[1], [*keys, "cell", "__i", "__j"]).where(
        "llo <= rhi AND rlo <= lhi AND cell = greatest(lfirst, rfirst)")
    return met.select("lrow.*", *[F.col(f"rrow.`{c}`").alias(f"{prefix}{c}") for c in right.columns])
