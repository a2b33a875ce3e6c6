"""Structured Streaming jobs on the file source: late rows, de-duplication, upserts, topics."""

import os

from pyspark.sql import functions as F

from basin.streaming.dedup import dedup_stream
from basin.streaming.upsert import apply_batch, read_upserted, upsert_stream
from basin.streaming.windows import window_metrics

SMALL = "/root/testdata/sf0.001"


def stage(spark, path):
    """first 900 events, the next 100, then 20 repeated early events (arriving late)."""
    e = spark.read.parquet(f"{SMALL}/events.parquet")
    e.where("event_id < 900").coalesce(1).write.mode("append").parquet(path)
    e.where("event_id >= 900 AND event_id < 1000").coalesce(1).write.mode("append").parquet(path)
    e.where("event_id < 20").coalesce(1).write.mode("append").parquet(path)
    return e


def dropped(q):
    return sum(op.get("numRowsDroppedByWatermark", 0) for p in q.recentProgress for op in p.get("stateOperators", []))


def test_stream_windows_equal_batch_and_drop_late_rows(spark, tmp):
    e = stage(spark, f"{tmp}/in")
    closing = spark.range(1).select(F.lit(-1).cast("long").alias("event_id"),
                                F.lit("2100-01-01 00:00:00").cast("timestamp_ntz").alias("ts"),
                                F.lit(-1).cast("long").alias("user_id"), F.lit("__close__").alias("event_type"),
                                F.lit(0.0).alias("value"), F.lit("{}").alias("props"))
    closing.coalesce(1).write.mode("append").parquet(f"{tmp}/in")
    s = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp}/in")
    agg = window_metrics(s, "ts", "event_type", "tumbling", size="1 hour", lateness="1 hour", value="value")
    q = (agg.writeStream.format("parquet").option("checkpointLocation", f"{tmp}/ck").trigger(availableNow=True)
         .start(f"{tmp}/out"))
    q.awaitTermination()
    got = spark.read.parquet(f"{tmp}/out").where("event_type != '__close__'")
    batch = window_metrics(e, "ts", "event_type", "tumbling", size="1 hour", value="value")
    key = ["event_type", "window_start", "n"]
    assert sorted(map(tuple, got.select(*key).collect())) == sorted(map(tuple, batch.select(*key).collect()))
    # the 20 late events were dropped (the metric counts rows after the map-side partial
    # aggregation, so late events sharing a type and hour count once)
    assert 0 < dropped(q) <= 20


def test_dedup_stream_drops_repeats(spark, tmp):
    e = stage(spark, f"{tmp}/in")
    s = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp}/in")
    q = (dedup_stream(s, "ts", "event_id", "365 days").writeStream.format("parquet")
         .option("checkpointLocation", f"{tmp}/ck").trigger(availableNow=True).start(f"{tmp}/out"))
    q.awaitTermination()
    out = spark.read.parquet(f"{tmp}/out")
    assert out.count() == 1000 and out.select("event_id").distinct().count() == 1000


def test_upsert_stream_is_replay_safe(spark, tmp):
    o = spark.read.parquet(f"{SMALL}/orders.parquet").select(F.col("o_orderkey").alias("k"),
                                                             F.col("o_totalprice").alias("v"), F.lit(1).alias("ver"))
    o.coalesce(1).write.parquet(f"{tmp}/in")
    s = spark.readStream.schema("k long, v double, ver int").parquet(f"{tmp}/in")
    q = upsert_stream(s, "k", "ver", f"{tmp}/t", f"{tmp}/ck", trigger={"availableNow": True})
    q.awaitTermination()
    first = read_upserted(spark, f"{tmp}/t")
    assert first.count() == o.count()
    # the same batch again (a replay after a crash) changes nothing
    apply_batch(o, "k", "ver", f"{tmp}/t")
    assert read_upserted(spark, f"{tmp}/t").exceptAll(o).count() == 0
    assert read_upserted(spark, f"{tmp}/t").count() == o.count()
    # a new batch applies: source rows win, others stay
    apply_batch(o.where("k < 10").withColumn("v", F.lit(0.0)), "k", "ver", f"{tmp}/t")
    assert read_upserted(spark, f"{tmp}/t").where("v = 0").count() == 10
    assert read_upserted(spark, f"{tmp}/t").count() == o.count()


def test_topic_through_file_stand_in(spark, tmp):
    from basin.sources.topic import encode_records, read_topic, write_topic
    e = spark.read.parquet(f"{SMALL}/events.parquet")
    write_topic(e, "event_id", "unused:9092", "events", sink="json", options={"path": f"{tmp}/topic"})
    s = read_topic(spark, "unused:9092", "events", e.schema, source="json",
                   options={"path": f"{tmp}/topic"}, source_schema="key string, value string")
    q = s.writeStream.format("parquet").option("checkpointLocation", f"{tmp}/ck").trigger(availableNow=True) \
        .start(f"{tmp}/out")
    q.awaitTermination()
    got = spark.read.parquet(f"{tmp}/out").drop("key")
    assert got.exceptAll(e).count() == 0 and e.exceptAll(got).count() == 0
    assert encode_records(e, ["event_id", "user_id"]).first()["key"].startswith("{")


def test_stream_session_windows_equal_batch(spark, tmp):
    e = spark.read.parquet(f"{SMALL}/events.parquet")
    path = f"{tmp}/in"
    for lo, hi in ((0, 500), (500, 1000)):
        e.where(f"event_id >= {lo} AND event_id < {hi}").coalesce(1).write.mode("append").parquet(path)
    closing = spark.range(1).select(F.lit(-1).cast("long").alias("event_id"),
                                F.lit("2100-01-01 00:00:00").cast("timestamp_ntz").alias("ts"),
                                F.lit(-1).cast("long").alias("user_id"), F.lit("x").alias("event_type"),
                                F.lit(0.0).alias("value"), F.lit("{}").alias("props"))
    closing.coalesce(1).write.mode("append").parquet(path)
    s = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(path)
    agg = window_metrics(s, "ts", "user_id", "session", gap="30 minutes", lateness="1 day", value="value")
    q = (agg.writeStream.format("parquet").option("checkpointLocation", f"{tmp}/ck").trigger(availableNow=True)
         .start(f"{tmp}/out"))
    q.awaitTermination()
    got = spark.read.parquet(f"{tmp}/out").where("user_id >= 0")
    batch = window_metrics(e, "ts", "user_id", "session", gap="30 minutes", value="value")
    key = ["user_id", "window_start", "window_end", "n"]
    assert sorted(map(tuple, got.select(*key).collect())) == sorted(map(tuple, batch.select(*key).collect()))


def test_write_topic_from_a_stream(spark, tmp):
    from basin.sources.topic import decode_records, write_topic
    e = spark.read.parquet(f"{SMALL}/events.parquet")
    e.write.parquet(f"{tmp}/in")
    s = spark.readStream.schema(e.schema).parquet(f"{tmp}/in")
    q = write_topic(s, "event_id", "unused:9092", "events", sink="json", checkpoint=f"{tmp}/ck",
                    options={"path": f"{tmp}/topic"}, trigger={"availableNow": True})
    q.awaitTermination()
    got = decode_records(spark.read.schema("key string, value string").json(f"{tmp}/topic"), e.schema)
    assert got.drop("key").exceptAll(e).count() == 0 and got.count() == e.count()
    assert got.where(F.col("key") != F.col("event_id").cast("string")).count() == 0


def _batch(spark, lo, hi, v):
    return spark.range(lo, hi).select(F.col("id").alias("k"), F.lit(v).alias("v"), F.lit(1).alias("ver"))


def test_upsert_after_a_restart_with_a_new_checkpoint(spark, tmp):
    _batch(spark, 0, 100, 1.0).write.parquet(f"{tmp}/in")
    s = spark.readStream.schema("k long, v double, ver int").parquet(f"{tmp}/in")
    for i in range(3):  # every checkpoint delivers all files again
        _batch(spark, 100 * i, 100 * i + 150, 2.0 + i).write.mode("append").parquet(f"{tmp}/in")
        upsert_stream(s, "k", "ver", f"{tmp}/t", f"{tmp}/ck{i}", {"availableNow": True}, 8).awaitTermination()
        got = read_upserted(spark, f"{tmp}/t")
        assert got.count() == got.select("k").distinct().count() == 100 * i + 150


def test_upsert_refuses_another_bucket_count(spark, tmp):
    import pytest
    apply_batch(_batch(spark, 0, 1000, 1.0), "k", "ver", f"{tmp}/t", 8)
    with pytest.raises(ValueError, match="8 buckets"):
        apply_batch(_batch(spark, 0, 10, 2.0), "k", "ver", f"{tmp}/t", 16)
    apply_batch(_batch(spark, 0, 10, 2.0), "k", "ver", f"{tmp}/t", 8)
    assert read_upserted(spark, f"{tmp}/t").select("k").distinct().count() == 1000 == read_upserted(spark, f"{tmp}/t").count()


def test_upsert_matches_null_keys_and_takes_empty_batches(spark, tmp):
    batch = spark.createDataFrame([(None, 1.0, 1), (5, 2.0, 1)], "k long, v double, ver int")
    apply_batch(batch.where("false"), "k", "ver", f"{tmp}/t", 8)
    assert read_upserted(spark, f"{tmp}/t") is None
    for i in range(4):
        apply_batch(batch.withColumn("v", F.col("v") + i), "k", "ver", f"{tmp}/t", 8)
        apply_batch(batch.where("false"), "k", "ver", f"{tmp}/t", 8)
    assert sorted(r.v for r in read_upserted(spark, f"{tmp}/t").collect()) == [4.0, 5.0]
    assert not os.path.exists(f"{tmp}/t/_pending")


def test_upsert_ends_a_move_that_a_crash_cut_short(spark, tmp, monkeypatch):
    """After the crash some buckets are gone and the rest is old; the next batch first moves the pending ones in."""
    import pytest
    import shutil
    from basin.streaming import upsert
    apply_batch(_batch(spark, 0, 1000, 1.0), "k", "ver", f"{tmp}/t", 8)
    move = upsert._move_in

    def crash(session, target):
        if os.path.exists(f"{target}/_pending"):
            shutil.rmtree(f"{target}/basin_bucket_of_8=3")
            raise RuntimeError("lost")
        move(session, target)

    monkeypatch.setattr(upsert, "_move_in", crash)
    with pytest.raises(RuntimeError, match="lost"):
        apply_batch(_batch(spark, 500, 1500, 2.0), "k", "ver", f"{tmp}/t", 8)
    monkeypatch.setattr(upsert, "_move_in", move)
    apply_batch(_batch(spark, 1400, 1600, 3.0), "k", "ver", f"{tmp}/t", 8)
    got = {r.k: r.v for r in read_upserted(spark, f"{tmp}/t").collect()}
    assert got == {k: 1.0 if k < 500 else 2.0 if k < 1400 else 3.0 for k in range(1600)}
    # a pending folder that was not written to its end is dropped
    os.makedirs(f"{tmp}/t/_pending/basin_bucket_of_8=1")
    apply_batch(_batch(spark, 0, 1, 9.0), "k", "ver", f"{tmp}/t", 8)
    assert read_upserted(spark, f"{tmp}/t").count() == 1600


def test_a_stream_without_lateness_is_refused(spark, tmp):
    import pytest
    e = spark.read.parquet(f"{SMALL}/events.parquet")
    s = spark.readStream.schema(e.schema).parquet(f"{SMALL}/events.parquet")
    with pytest.raises(ValueError, match="lateness"):
        window_metrics(s, "ts", "event_type", "tumbling", size="1 hour")
