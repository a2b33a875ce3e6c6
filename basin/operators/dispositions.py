"""Write dispositions: the guarded, idempotent ways a job changes a keyed table.

Every function returns the table *after* the change as a DataFrame (no side effect) except
``write_table``, which writes. Keys are compared by equality; a NULL key never matches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from basin.operators._common import all_of, as_list, pick_one

WRITE_MODES = ("append", "replace", "skip_if_exists")


def write_table(df: DataFrame, name: str, mode: str = "append", fmt: str = "parquet",
                path: str | None = None, partition_by=None) -> str:
    """B1: write ``df`` to catalog table ``name``.

    ``append`` adds rows; ``replace`` empties the table and fills it, keeping its definition (columns,
    partitioning, comments, properties); ``skip_if_exists`` leaves an existing table alone. Returns what
    happened: ``created``, ``appended``, ``replaced`` or ``skipped``. ``fmt``, ``path`` and ``partition_by``
    count only when the table is created. Replacing a table the input reads from is refused by Spark; the
    input is then checkpointed to the shared checkpoint folder first, which cuts the lineage to the old files.
    """
    if mode not in WRITE_MODES:
        raise ValueError(f"mode must be one of {WRITE_MODES}")
    spark = df.sparkSession
    if not spark.catalog.tableExists(name):
        writer = df.write.format(fmt)
        if partition_by:
            writer = writer.partitionBy(*as_list(partition_by))
        if path:
            writer = writer.option("path", path)
        writer.mode("append").saveAsTable(name)
        return "created"
    if mode == "skip_if_exists":
        return "skipped"
    rows = df.select(*spark.table(name).columns)  # insertInto goes by position
    if mode == "append":
        rows.write.insertInto(name, overwrite=False)
        return "appended"
    try:
        rows.write.insertInto(name, overwrite=True)
    except AnalysisException as e:
        if "UNSUPPORTED_OVERWRITE" not in str(e) and "read from" not in str(e):
            raise
        from basin.session import checkpoint_dir
        checkpoint_dir(spark)
        rows.checkpoint(eager=True).write.insertInto(name, overwrite=True)
    return "replaced"


def without_keys(rows: DataFrame, other: DataFrame, keys, null_safe: bool = False) -> DataFrame:
    """``rows`` whose key is not in ``other``. With ``null_safe`` a NULL in a key equals a NULL, else nothing."""
    keys = as_list(keys)
    # distinct keys: a key repeated many times is collapsed in each task before the shuffle, and the join reuses
    # the distinct's partitioning
    seen = other.select(*keys).distinct()
    if not null_safe:
        return rows.join(seen, on=keys, how="left_anti")
    seen = seen.select(*[F.col(k).alias(f"__seen_{k}") for k in keys])
    return rows.join(seen, all_of([F.col(k).eqNullSafe(F.col(f"__seen_{k}")) for k in keys]), "left_anti")


def insert_if_absent(target: DataFrame, batch: DataFrame, keys, order, null_safe: bool = False) -> DataFrame:
    """B2: add batch rows whose key is not in ``target``; never change an existing row.

    Inside the batch the first row per key by ``order`` wins. Applying the same batch twice gives
    the same table as applying it once if no key holds a NULL, which by default equals nothing (as in SQL, such
    rows are added each time), or with ``null_safe``, which makes a NULL a value like any other.
    """
    keys = as_list(keys)
    first = pick_one(batch, keys, order, last=False).select(*target.columns)
    return target.unionByName(without_keys(first, target, keys, null_safe))


def insert_batch_once(target: DataFrame, batch: DataFrame, sentinel: dict) -> DataFrame:
    """All or nothing, guarded by ONE sentinel key.

    If a row with the sentinel key is in ``target`` the whole batch is skipped (even if only part
    of it was written before -- a half-written batch is not repaired); otherwise all of it is
    appended. The guard is an uncorrelated EXISTS: Spark evaluates it once as a one-row subquery
    and filters the batch by the result, without a join.
    """
    if not sentinel:
        raise ValueError("sentinel must name at least one key column")
    hit = target.where(all_of([F.col(k).eqNullSafe(F.lit(v)) for k, v in sentinel.items()]))
    guarded = batch.select(*target.columns).where(~hit.select(F.lit(1).alias("one")).exists())
    return target.unionByName(guarded)


def update_matching(target: DataFrame, batch: DataFrame, keys, cols=None, order=None) -> DataFrame:
    """Replace ``cols`` of target rows whose key is in the batch; other batch keys are ignored.

    A batch row with a NULL new value writes NULL (a marker column tells "matched" apart from
    "no batch row"). If the batch repeats a key, the last row by ``order`` wins (without ``order``
    the largest row wins, so the result is still deterministic). ``cols`` defaults to the batch's
    columns other than keys and order columns. Row count never changes.
    """
    keys = as_list(keys)
    order = as_list(order)
    order_names = [o for o in order if isinstance(o, str)]
    cols = as_list(cols) or [c for c in batch.columns if c not in keys and c not in order_names]
    b = pick_one(batch, keys, order, last=True).select(*keys, *cols)
    b = b.select(*keys, *[F.col(c).alias(f"__new_{c}") for c in cols], F.lit(True).alias("__matched"))
    j = target.join(b, on=keys, how="left")
    out = [F.when(F.col("__matched"), F.col(f"__new_{c}")).otherwise(F.col(c)).alias(c) if c in cols else F.col(c)
           for c in target.columns]
    return j.select(*out)


def last_wins(df: DataFrame, keys, order) -> DataFrame:
    """One row per key, the last by ``order`` (as a sourced settings file: later lines win)."""
    return pick_one(df, keys, order, last=True)


def first_wins(df: DataFrame, keys, order) -> DataFrame:
    """One row per key, the first by ``order``."""
    return pick_one(df, keys, order, last=False)


SYNC_STATES = ("new", "changed", "same", "kept")


def sync_diff(src: DataFrame, dst: DataFrame, keys, compare_cols) -> DataFrame:
    """Compare two snapshots by key (keys are unique within each snapshot).

    ``new`` = only in source, ``kept`` = only in target (nothing is deleted), ``same`` / ``changed``
    = in both, compared NULL-safely on ``compare_cols`` (callers choose content, or size and
    modification time as a file sync does). Output: keys, ``status``, ``src_<c>``, ``dst_<c>``.
    """
    keys = as_list(keys)
    compare_cols = as_list(compare_cols)
    s = src.select(*keys, *[F.col(c).alias(f"src_{c}") for c in compare_cols], F.lit(True).alias("__in_src"))
    d = dst.select(*keys, *[F.col(c).alias(f"dst_{c}") for c in compare_cols], F.lit(True).alias("__in_dst"))
    j = s.join(d, on=keys, how="full_outer")
    same = all_of([F.col(f"src_{c}").eqNullSafe(F.col(f"dst_{c}")) for c in compare_cols])
    status = (F.when(F.col("__in_dst").isNull(), F.lit("new"))
              .when(F.col("__in_src").isNull(), F.lit("kept"))
              .when(same, F.lit("same"))
              .otherwise(F.lit("changed")))
    return j.select(*keys, status.alias("status"),
                    *[F.col(f"src_{c}") for c in compare_cols], *[F.col(f"dst_{c}") for c in compare_cols])


def sync_apply(src: DataFrame, dst: DataFrame, keys, null_safe: bool = False) -> DataFrame:
    """The target after a sync: source rows win, target-only rows stay. Idempotent if no key holds a NULL (it
    equals nothing, so such rows of both sides stay), or with ``null_safe``, which makes a NULL a value like any other."""
    keys = as_list(keys)
    return src.unionByName(without_keys(dst.select(*src.columns), src, keys, null_safe))
