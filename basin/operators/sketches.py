"""Mergeable sketches: distinct counts and quantiles kept per cell, merged without the rows.

A sketch table has a row per cell (say day and type) with the number of rows, an HLL sketch of one column and a
KLL sketch of another. Cells of new days are appended; any coarser grouping is a merge of the stored cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basin.operators._common import as_list

#: Logarithm of the HLL's registers, and the KLL's accuracy parameter.
LG_K, KLL_K = 12, 200
#: Bounds that hold with a chance of more than 99 in 100: relative error of a distinct count (three standard errors of
#: a merged sketch, 1.04 / sqrt(2 ** LG_K) each), and rank error of a quantile (normalized, for KLL_K = 200).
DISTINCT_ERROR, RANK_ERROR = 3 * 1.04 / 2 ** (LG_K / 2), 0.0133


def sketch(df: DataFrame, by, distinct: str | None = None, values: str | None = None) -> DataFrame:
    """(by..., n [, distinct_sketch] [, values_sketch]): a row for each cell, combined in each task before the shuffle.

    ``distinct`` is an integer, string or binary column, ``values`` a numeric one; NULLs (and NaN values) are not counted
    in the sketches.
    """
    return df.groupBy(*as_list(by)).agg(*sketched_columns(distinct, values))


def sketched_columns(distinct: str | None, values: str | None) -> list[Column]:
    """The aggregates that make a sketch table's columns of rows."""
    out = [F.count("*").alias("n")]
    if distinct:
        out.append(F.hll_sketch_agg(distinct, F.lit(LG_K)).alias("distinct_sketch"))
    if values:
        number = F.col(values).cast("double")
        out.append(F.kll_sketch_agg_double(F.when(~F.isnan(number), number), F.lit(KLL_K)).alias("values_sketch"))
    return out


def merge(cells: DataFrame, by=None) -> DataFrame:
    """The sketch table of a coarser grouping, from the stored cells alone; merged in each task before the shuffle."""
    return cells.groupBy(*as_list(by)).agg(*merged_columns(cells.columns))


def merged_columns(columns) -> list[Column]:
    """The aggregates that merge a sketch table's columns."""
    how = {"n": "sum(n)", "distinct_sketch": "hll_union_agg(distinct_sketch)", "values_sketch": "kll_merge_agg_double(values_sketch)"}
    return [F.expr(how[c]).alias(c) for c in how if c in columns]


def distinct_estimate(sketch: str = "distinct_sketch") -> Column:
    """Estimated number of distinct values; the true one differs by a share of DISTINCT_ERROR at most, with the bound's chance."""
    return F.hll_sketch_estimate(sketch)


def quantile(share: float, sketch: str = "values_sketch") -> Column:
    """A value whose rank is within RANK_ERROR of ``share``; NULL for a cell without values."""
    empty = F.kll_sketch_get_n_double(sketch) == 0
    return F.when(~empty, F.kll_sketch_get_quantile_double(sketch, F.lit(float(share))))
