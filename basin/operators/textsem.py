"""Text semantics: grouping, joining and sorting under a collation; length limits.

See ``basin.functions.collation`` for how the warehouse's MySQL collations map onto Spark's.
Results come back as binary strings so they can be written or compared anywhere; a collation
left on a column travels into file metadata.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basin.functions.collation import binary, collated
from basin.operators.ordering import dense_index


def ci_group(df: DataFrame, col: str, kind: str = "lcase", name: str = "value") -> DataFrame:
    """G1: distinct values of ``col`` under collation ``kind`` with their row counts.

    Each group is represented by its smallest member in binary order (deterministic).
    Output: ``value`` (binary string), ``n``.
    """
    c = collated(col, kind)
    out = df.groupBy(c.alias("__k")).agg(F.min(binary(col)).alias(name), F.count(F.lit(1)).alias("n"))
    return out.select(name, "n")


def ci_join(a: DataFrame, b: DataFrame, on: str, kind: str = "lcase", how: str = "inner",
            b_on: str | None = None) -> DataFrame:
    """Equi join where ``a.on`` equals ``b.b_on`` under collation ``kind``.

    Spark plans a collated equality as a hash/sort-merge join on a collation key, so it shuffles
    like any equi join.
    """
    b_on = b_on or on
    cond = collated(a[on], kind) == collated(b[b_on], kind)
    return a.join(b, on=cond, how=how)


def collated_sort(df: DataFrame, col: str, kind: str = "binary", rank: str | None = None,
                  slices: int | None = None) -> DataFrame:
    """Order rows by ``col`` under ``kind``, ties broken by the binary value, so the order is total.

    Returns the sorted DataFrame, or with ``rank`` a 1-based position column (computed without a
    single-task window; see ``basin.operators.ordering``).
    """
    keys = [collated(col, kind), binary(col)]
    if rank is None:
        return df.orderBy(*keys)
    return dense_index(df, order=keys, base=1, name=rank, slices=slices)


def length_guard(df: DataFrame, limits: dict, truncate: bool = False) -> DataFrame:
    """Check character lengths against ``limits`` (e.g. ``{"comment": 256, "params": 4000}``).

    Adds ``accepted`` and ``reason`` (the first failing rule, e.g. ``comment>256``, else NULL).
    With ``truncate`` over-long values are cut to the limit, the row is accepted and ``reason``
    names the first rule that cut it (``comment>256 truncated``).
    Use ``df.where('accepted')`` / ``df.where('not accepted')`` for the two sides.
    """
    reason = F.lit(None).cast("string")
    for col, limit in reversed(list(limits.items())):
        too_long = F.char_length(F.col(col)) > F.lit(int(limit))
        reason = F.when(too_long, F.lit(f"{col}>{limit}")).otherwise(reason)
    out = df.withColumn("reason", reason)
    if not truncate:
        return out.withColumn("accepted", F.col("reason").isNull())
    for col, limit in limits.items():
        out = out.withColumn(col, F.when(F.char_length(F.col(col)) > int(limit),
                                         F.substring(F.col(col), 1, int(limit))).otherwise(F.col(col)))
    return (out.withColumn("reason", F.when(F.col("reason").isNotNull(), F.concat(F.col("reason"), F.lit(" truncated"))))
            .withColumn("accepted", F.lit(True)))
