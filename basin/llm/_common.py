"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basin.session import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` under the shared checkpoint folder and read it back: later steps neither
    recompute it nor depend on an executor that held it."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def stored_by(df: DataFrame, key: str, name: str) -> DataFrame:
    """Like ``stored``, in buckets of ``key``: a join or cogroup on the key reads the rows where they lie."""
    spark = df.sparkSession
    name = f"basin_{name}_{uuid.uuid4().hex[:12]}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (df.write.bucketBy(buckets, key).option("path", scratch_path(spark, name)).option("compression", "zstd")
     .saveAsTable(name))
    return spark.table(name)


def pack(numbers) -> bytes:
    """Numbers below 2 ** 32 as compressed bytes, all lowest bytes first."""
    numbers = np.ascontiguousarray(numbers, "<u4")
    planes = numbers.view(np.uint8).reshape(-1, 4).T.tobytes()
    return len(numbers).to_bytes(8, "little") + pa.compress(planes, "zstd", asbytes=True)


def unpack(packed: bytes) -> np.ndarray:
    n = int.from_bytes(packed[:8], "little")
    planes = pa.decompress(packed[8:], 4 * n, "zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, n).T).view("<u4").ravel()


def drop_stored(df: DataFrame) -> None:
    """Delete the files of a ``stored`` frame that nothing will read again."""
    path = getattr(df, "stored_path", None)
    if path:
        jvm = df.sparkSession._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def hash_bucket(col: Column, n: int) -> Column:
    """Stable bucket 0..n-1 of a key."""
    return F.pmod(F.xxhash64(col), F.lit(n)).cast("int")


def held_out(doc_id: str = "doc_id") -> Column:
    """The evaluation fold: crc32 of the id as text divisible by five."""
    return F.crc32(F.col(doc_id).cast("string")) % 5 == 0


def worker_cache(key: str) -> dict:
    """A dict that lives as long as the Python worker process, across the tasks it runs."""
    import sys
    return sys.__dict__.setdefault("_basin_llm_cache", {}).setdefault(key, {})
