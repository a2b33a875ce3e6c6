"""Keyed upserts from a stream into a partitioned table -- without MERGE.

The table is plain Parquet partitioned by ``basin_bucket_of_<n>`` = ``pmod(xxhash64(keys), n)``. Each micro-batch is
collapsed to the last row per key; the buckets it touches are rewritten, with source-wins semantics, by Spark's
dynamic partition overwrite. Applying a batch twice gives the same table, so a replayed batch is harmless.

An overwrite moves bucket after bucket, so the new buckets are first written whole to ``_pending`` beside them (a
folder Spark's reader passes over). If a crash ends the move half-way, the next batch, whichever stream brings it,
moves them again before it reads the table.

Only one stream may write at a time, and a reader that planned before a batch may find its files gone and has to read
again. NULL keys are keys like any other (matched null-safely). The bucket count is part of the partition column's
name and fixed with the first batch; another one is refused. Empty batches change nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basin.operators._common import all_of, as_list
from basin.operators.dispositions import last_wins

DEFAULT_BUCKETS = 64
BUCKET = "basin_bucket_of_"
#: Tasks that write one bucket of a batch, so a hot bucket is not one task's work.
SALTS = 4


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _exists(spark: SparkSession, pattern: str) -> bool:
    fs, p = _path(spark, pattern)
    return bool(fs.globStatus(p))


def _table(spark: SparkSession, target: str) -> DataFrame | None:
    return spark.read.parquet(target) if _exists(spark, f"{target}/{BUCKET}*") else None


def _move_in(spark: SparkSession, target: str) -> None:
    """Overwrite the buckets of a ``_pending`` that was written to its end, then drop it."""
    pending = f"{target}/_pending"
    if _exists(spark, f"{pending}/_SUCCESS"):
        new = spark.read.parquet(pending)
        (new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy(new.columns[-1]).parquet(target))
    fs, p = _path(spark, pending)
    fs.delete(p, True)


def read_upserted(spark: SparkSession, target: str) -> DataFrame | None:
    """The table's rows, None before the first batch."""
    table = _table(spark, target.rstrip("/"))
    return None if table is None else table.drop(table.columns[-1])


def apply_batch(batch: DataFrame, keys, order, target: str, buckets: int = DEFAULT_BUCKETS) -> None:
    """Apply one micro-batch: its last row per key replaces the table's row of that key."""
    spark, target, keys, bucket = batch.sparkSession, target.rstrip("/"), as_list(keys), f"{BUCKET}{buckets}"
    _move_in(spark, target)
    if batch.isEmpty():
        return
    table = _table(spark, target)
    if table is not None and table.columns[-1] != bucket:
        raise ValueError(f"the table at {target} has {table.columns[-1][len(BUCKET):]} buckets, not {buckets}; "
                         "rewrite it to change the count")
    number = F.pmod(F.xxhash64(*[F.col(k) for k in keys]), F.lit(buckets)).cast("int")
    new = latest = last_wins(batch, keys, as_list(order)).withColumn(bucket, number)
    if table is not None:
        touched = latest.select(bucket).distinct()  # at most ``buckets`` rows: a proven bound for the broadcast
        changed = latest.select(*[F.col(k).alias(f"__{k}") for k in keys])
        kept = table.join(F.broadcast(touched), bucket, "left_semi").select(latest.columns).join(
            changed, all_of([F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]), "left_anti")
        new = latest.unionByName(kept)
    salt = F.pmod(F.xxhash64(*keys, F.lit(1)), F.lit(SALTS))
    new.repartition(F.col(bucket), salt).write.mode("overwrite").partitionBy(bucket).parquet(f"{target}/_pending")
    _move_in(spark, target)


def upsert_stream(df: DataFrame, keys, order, target: str, checkpoint: str, trigger: dict | None = None,
                  buckets: int = DEFAULT_BUCKETS):
    """Start a query that upserts every micro-batch of ``df`` into the table at ``target``.

    ``buckets`` is fixed with the first batch; choose it for the size the table will have (about one bucket
    per few GB). Returns the StreamingQuery; ``read_upserted(spark, target)`` reads it.
    """
    w = df.writeStream.foreachBatch(lambda batch, _: apply_batch(batch, keys, order, target, buckets))
    w = w.option("checkpointLocation", checkpoint)
    if trigger:
        w = w.trigger(**trigger)
    return w.start()
