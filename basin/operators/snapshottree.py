"""Snapshot diff by a tree of digests: only ranges of keys that differ are read.

A snapshot is written with its rows partitioned by the top node of their key's hash, and with a tree of digests
beside them: of each leaf (a range of hashes) and each top node the number of rows and two independent
sums over the rows' hashes. To compare two snapshots, the top nodes' digests are compared first, then the leaves of the
nodes that differ; only the partitions of these nodes are read, and only rows of the leaves that differ are joined. What
is read below the top level grows with the changes, not with the snapshots.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from basin.operators._common import all_of, as_list
from basin.operators.dispositions import sync_diff

TOP, LEAF = "basin_top", "basin_leaf"
#: Top nodes (partitions of the rows) and leaves of each: configuration, fixed when a snapshot is written.
TOPS, LEAVES = 64, 1024
_LEAVES = f"{LEAF} int, n decimal(38,0), a decimal(38,0), b decimal(38,0), {TOP} int"
_META = "keys array<string>, cols array<string>, tops int, leaves int, schema string"


def _hash(columns, seed: str) -> Column:
    # NULL and its neighbours told apart: a column's hash alone does not
    return F.xxhash64(F.lit(seed), *[x for c in columns for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))])


def _digest() -> list[Column]:
    """Rows and their hashes, added up: equal for equal sets of rows; sums of 38 digits do not overflow below 10 ** 19 rows."""
    return [F.sum("n").alias("n"), F.sum("a").alias("a"), F.sum("b").alias("b")]


def write_snapshot(df: DataFrame, path: str, keys, compare_cols=None, tops: int = TOPS, leaves: int = LEAVES) -> str:
    """Write ``df`` (keys unique) as a snapshot with its digest tree; returns ``path``.

    ``compare_cols`` decide whether a row changed (default: all but the keys). Keys may hold NULLs. Snapshots compare
    only with others of equal keys, columns and counts of nodes, which are kept beside the rows.
    """
    keys = as_list(keys)
    cols = as_list(compare_cols) or [c for c in df.columns if c not in keys]
    place = _hash(keys, "place")
    rows = df.withColumn(TOP, F.pmod(place, F.lit(tops)).cast("int")).withColumn(
        LEAF, F.pmod(F.floor(place / tops), F.lit(leaves)).cast("int"))
    salt = F.pmod(_hash(keys, "file"), F.lit(8))  # a node is up to eight files and tasks
    rows.repartition(TOP, salt).sortWithinPartitions(TOP, LEAF).write.partitionBy(TOP).parquet(f"{path}/rows")
    saved = _rows(df.sparkSession, path, df.schema)  # digests of what was written
    whole = lambda seed: _hash([*keys, *cols], seed).cast("decimal(38,0)")
    leaf = saved.select(TOP, LEAF, F.lit(1).cast("decimal(38,0)").alias("n"), whole("a").alias("a"),
                        whole("b").alias("b")).groupBy(TOP, LEAF).agg(*_digest())
    leaf.repartition(TOP).write.partitionBy(TOP).parquet(f"{path}/leaves")
    saved_leaves = df.sparkSession.read.schema(_LEAVES).parquet(f"{path}/leaves")
    saved_leaves.groupBy(TOP).agg(*_digest()).coalesce(1).write.parquet(f"{path}/tops")
    meta = [(keys, cols, tops, leaves, df.schema.json())]
    df.sparkSession.createDataFrame(meta, _META).coalesce(1).write.json(f"{path}/_meta")
    return path


def _rows(spark, path, schema):
    return spark.read.schema(StructType([*schema.fields, StructField(LEAF, IntegerType()), StructField(TOP, IntegerType())])).parquet(
        f"{path}/rows")


def _meta(spark, path):
    return spark.read.schema(_META).json(f"{path}/_meta").first()


def _differing(left: DataFrame, right: DataFrame, nodes) -> DataFrame:
    """The nodes whose digests differ, or that only one side has."""
    r = right.select(*[F.col(c).alias(f"__{c}") for c in right.columns])
    joined = left.join(r, all_of([F.col(c) == F.col(f"__{c}") for c in nodes]), "full_outer")
    same = all_of([F.col(c).eqNullSafe(F.col(f"__{c}")) for c in ("n", "a", "b")])
    return joined.where(~same).select(*[F.coalesce(c, f"__{c}").alias(c) for c in nodes])


def differing_ranges(spark: SparkSession, src: str, dst: str) -> DataFrame:
    """(basin_top, basin_leaf) of the ranges in which the snapshots differ."""
    one, two = ((m["keys"], m.cols, m.tops, m.leaves) for m in (_meta(spark, src), _meta(spark, dst)))
    if one != two:
        raise ValueError(f"the snapshots do not compare: {one} and {two}")
    tops = _differing(*[spark.read.schema(_LEAVES).parquet(f"{p}/tops") for p in (src, dst)], [TOP])
    below = [row[TOP] for row in tops.collect()]  # at most the number of top nodes, which the snapshot fixes
    leaves = [spark.read.schema(_LEAVES).parquet(f"{p}/leaves").where(F.col(TOP).isin(below)) for p in (src, dst)]
    return _differing(*leaves, [TOP, LEAF])


def tree_diff(spark: SparkSession, src: str, dst: str) -> DataFrame:
    """Keys, ``status`` (``new``, ``changed``, ``kept``: only in the target) and both sides' values of every row in which
    the snapshot at ``src`` differs from the one at ``dst``, as ``sync_diff`` gives them, without the rows that are the same."""
    meta = _meta(spark, src)
    keys, cols = meta["keys"], meta.cols
    ranges = differing_ranges(spark, src, dst)
    tops = [row[TOP] for row in ranges.select(TOP).distinct().collect()]

    def rows(path):
        table = _rows(spark, path, StructType.fromJson(json.loads(_meta(spark, path).schema))).where(F.col(TOP).isin(tops))
        table = table.join(ranges, [TOP, LEAF], "left_semi")
        # NULL keys are keys: compared through a flag beside the value
        return table.select([F.col(f"`{c}`") for c in [*keys, *cols]] + [F.col(k).isNull().alias(f"__null_{k}") for k in keys])

    flags = [f"__null_{k}" for k in keys]
    plain = lambda df: df.select(*[F.coalesce(k, F.lit(0).cast(df.schema[k].dataType)).alias(f"__{k}") if df.schema[k].dataType.simpleString()
                                   not in ("string", "binary") else F.coalesce(k, F.lit("")).alias(f"__{k}") for k in keys], *flags, *cols)
    diff = sync_diff(plain(rows(src)), plain(rows(dst)), [*[f"__{k}" for k in keys], *flags], cols).where("status <> 'same'")
    return diff.select(*[F.when(~F.col(f"__null_{k}"), F.col(f"__{k}")).alias(k) for k in keys], "status",
                       *[f"src_{c}" for c in cols], *[f"dst_{c}" for c in cols])
