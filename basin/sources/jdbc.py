"""RDBMS tables over JDBC: parallel range import, export, incremental import.

Needs the database's JDBC driver on the classpath. Reads are split into ``parts`` ranges of
``column`` and run as parallel tasks; filters on plain columns are pushed into the database's
WHERE clause.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basin.operators._common import as_list
from basin.operators.dispositions import sync_apply

INCREMENTAL_KINDS = ("append", "lastmodified")


def import_jdbc(spark: SparkSession, url: str, table: str, column: str | None = None, lower=None,
                upper=None, parts: int | None = None, props: dict | None = None,
                fetchsize: int = 10000) -> DataFrame:
    """A4: an RDBMS table (or ``(subquery) alias``) as a DataFrame, read in ``parts`` parallel ranges
    of ``column`` between ``lower`` and ``upper`` (rows outside the bounds still land in the end ranges).

    Without a split column one task reads the whole table; say so with ``parts=1``."""
    if column is None and parts != 1:
        raise ValueError("name a split column with lower, upper and parts, or ask for one task with parts=1")
    r = spark.read.format("jdbc").option("url", url).option("dbtable", table).option("fetchsize", fetchsize)
    if column is not None:
        if lower is None or upper is None or not parts:
            raise ValueError("a split column needs lower, upper and parts")
        r = (r.option("partitionColumn", column).option("lowerBound", str(lower))
             .option("upperBound", str(upper)).option("numPartitions", int(parts)))
    return r.options(**(props or {})).load()


def export_jdbc(df: DataFrame, url: str, table: str, mode: str = "append", props: dict | None = None,
                batchsize: int = 10000, parts: int | None = None, truncate: bool = True) -> None:
    """A5: write ``df`` to an RDBMS table; ``mode`` append or overwrite. An overwrite truncates the
    table (keeping its definition, grants and indexes) unless ``truncate=False``, which drops and
    recreates it. ``parts`` caps concurrent connections (the data is coalesced to that many tasks)."""
    if mode not in ("append", "overwrite"):
        raise ValueError("mode must be append or overwrite")
    w = df.write.format("jdbc").option("url", url).option("dbtable", table).option("batchsize", batchsize)
    if mode == "overwrite":
        w = w.option("truncate", str(truncate).lower())
    if parts:
        w = w.option("numPartitions", int(parts))
    w.options(**(props or {})).mode(mode).save()


@dataclass
class Increment:
    rows: DataFrame       # rows taken from the source this run
    table: DataFrame      # the target after applying them
    watermark: DataFrame  # one row, column ``watermark``: store it for the next run


def import_incremental(src: DataFrame, target: DataFrame, kind: str, check_col: str, key=None,
                       last=None) -> Increment:
    """Take only what is new since the stored high-watermark ``last``.

    ``append``: rows with ``check_col > last`` are appended (check_col grows, e.g. an id).
    ``lastmodified``: rows with ``check_col > last`` (a modification time) replace target rows with
    the same ``key``; other target rows stay. ``last=None`` takes everything; ``last`` may also be a
    Column (e.g. a scalar subquery over the target). The comparison is a
    plain filter, so a JDBC source runs it inside the database. The new watermark is the largest
    ``check_col`` seen (or ``last`` when nothing is new), as a one-row DataFrame. Source rows whose
    ``check_col`` is NULL are never newer than a watermark: they arrive only with ``last=None``.
    """
    if kind not in INCREMENTAL_KINDS:
        raise ValueError(f"kind must be one of {INCREMENTAL_KINDS}")
    bound = last if isinstance(last, Column) else F.lit(last)
    rows = src if last is None else src.where(F.col(check_col) > bound)
    if kind == "append":
        table = target.unionByName(rows.select(*target.columns))
    else:
        if key is None:
            raise ValueError("lastmodified needs a key")
        table = sync_apply(rows.select(*target.columns), target, as_list(key))
    dtype = src.schema[check_col].dataType
    prev = bound.cast(dtype) if last is not None else F.lit(None).cast(dtype)
    wm = rows.agg(F.max(check_col).alias("m")).select(F.coalesce(F.col("m"), prev).alias("watermark"))
    return Increment(rows=rows, table=table, watermark=wm)
