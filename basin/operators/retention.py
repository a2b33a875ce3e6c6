"""Retention: keep rows by age, keep the newest N per group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basin.operators._common import as_list

# fixed values: the platform's defaults (log retention seconds, retained applications)
DEFAULT_RETAIN_SECONDS = 604800
DEFAULT_RETAIN_COUNT = 30


def retain_by_age(df: DataFrame, ts: str, seconds: int = DEFAULT_RETAIN_SECONDS, as_of=None) -> DataFrame:
    """drop rows more than ``seconds`` older than ``as_of``; newer rows (even after ``as_of``)
    and rows without a time stay.

    ``as_of`` defaults to the newest ``ts`` in the data, computed once as a scalar subquery (a
    one-value aggregate that Spark evaluates before the filter runs) -- never collected by hand.
    """
    if as_of is None:
        ref = df.select(F.max(ts).alias("m")).scalar()
    else:
        ref = F.lit(as_of).cast(df.schema[ts].dataType)
    cutoff = ref - F.make_interval(secs=F.lit(seconds))
    return df.where(F.col(ts).isNull() | (F.col(ts) >= cutoff))


def retain_latest(df: DataFrame, group, order, n: int = DEFAULT_RETAIN_COUNT, tie=None) -> DataFrame:
    """the newest ``n`` rows per group by ``order`` (descending), ties broken by ``tie`` (descending).

    ``row_number() <= n`` lets Spark cut each group to ``n`` rows inside every task before the
    shuffle (a partial window-group limit), so a huge group ships only ``n`` rows per task.
    """
    keys = [F.col(o).desc() for o in as_list(order)] + [F.col(t).desc() for t in as_list(tie)]
    w = Window.partitionBy(*as_list(group)).orderBy(*keys)
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n).drop("__rn")
