"""Skew-safe batch session windows equal Spark's own session_window, also across batch and
partition boundaries and under a key holding most of the events."""

import random

import pytest
from pyspark.sql import functions as F

from basin.streaming.sessions import interval_micros, session_windows


def spark_sessions(df, gap):
    w = df.groupBy("u", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"),
                                                                      F.sum("v").alias("total"))
    return w.select("u", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n", "total")


def rows(df):
    return sorted((r["u"], r["window_start"], r["window_end"], r["n"], None if r["total"] is None else round(r["total"], 6))
                  for r in df.collect())


@pytest.mark.parametrize("batch", [3, 10000])
def test_equals_spark_session_window_with_hot_key(spark, batch):
    rnd = random.Random(7)
    data = []
    for i in range(3000):
        u = 0 if rnd.random() < 0.6 else rnd.randint(1, 30)  # key 0 holds most events
        data.append((u, f"2024-01-01 00:00:00", rnd.randint(0, 6 * 3600), None if rnd.random() < 0.05 else rnd.random()))
    df = (spark.createDataFrame(data, "u long, base string, off long, v double")
          .select("u", (F.col("base").cast("timestamp_ntz") + F.make_interval(secs=F.col("off"))).alias("ts"), "v")
          .repartition(7))
    prev = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        ours = rows(session_windows(df, "ts", "u", "10 minutes", "v"))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", prev)
    assert ours == rows(spark_sessions(df, "10 minutes"))


def test_interval_text():
    assert interval_micros("30 minutes") == 30 * 60 * 10 ** 6
    assert interval_micros("1 hour 30 minutes") == 90 * 60 * 10 ** 6
    assert interval_micros("45 seconds") == 45 * 10 ** 6


def test_session_keys_keep_their_values(spark):
    """A NULL key in the batch must not turn big integers into floats; NULL is a key of its own."""
    big = 9007199254740992
    rows = [(None, 0), (big, 0), (big + 1, 60), (big + 3, 0), (None, 60)]
    df = spark.createDataFrame(rows, "u long, s long").select("u", F.timestamp_seconds("s").alias("ts"), F.lit(1.5).alias("v"))
    got = sorted(((r.u, r.n, r.total) for r in session_windows(df, "ts", "u", "10 minutes", "v").collect()), key=str)
    assert got == sorted([(None, 2, 3.0), (big, 1, 1.5), (big + 1, 1, 1.5), (big + 3, 1, 1.5)], key=str)


def test_session_totals_of_null_and_nan_values(spark):
    rows = [("a", 0, None), ("a", 60, None), ("b", 0, float("nan")), ("b", 60, 1.0), ("c", 0, None), ("c", 60, 2.0)]
    df = spark.createDataFrame(rows, "u string, s long, v double").select("u", F.timestamp_seconds("s").alias("ts"), "v")
    got = {r.u: r.total for r in session_windows(df, "ts", "u", "10 minutes", "v").collect()}
    assert got["a"] is None and got["b"] != got["b"] and got["c"] == 2.0


def test_sessions_over_many_slices_equal_one(spark):
    """Slices cut sessions at every place: more slices than keys, one session over all of them, equal times."""
    df = spark.range(400).selectExpr("CAST(id % 2 AS STRING) AS u", "timestamp_seconds(id DIV 4 * IF(id % 2 = 0, 60, 700)) AS ts", "1.0D AS v")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small data would be one slice
    try:
        got = rows(session_windows(df, "ts", "u", "10 minutes", "v"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert got == rows(spark_sessions(df, "10 minutes")) and len(got) == 101
    plan = session_windows(df, "ts", "u", "10 minutes")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "MapInArrow" not in plan
