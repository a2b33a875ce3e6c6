"""Registered queries for sources and sinks: file landing, catalog tables, topics, config files,
incremental import and streaming jobs.

Each writes under a fresh folder in the shared checkpoint folder (``spark.checkpoint.dir``),
reads the result back, and is checked against the SQL of the table it started from.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from basin.operators import dispositions as B
from basin.plans import fixtures as X
from basin.plans.jobs import sql_job
from basin.plans.queries import ORACLE, query
from basin.session import DEFAULT_CONF, scratch_path
from basin.sources import catalog as A
from basin.sources.config import read_property_xml, write_property_xml
from basin.sources.eventlog import read_event_log, run_summary
from basin.sources.files import land_files
from basin.sources.jdbc import import_incremental
from basin.sources.topic import JSON_OPTIONS, decode_records, encode_records, read_topic, write_topic
from basin.streaming.dedup import dedup_stream
from basin.streaming.upsert import read_upserted, upsert_stream
from basin.streaming.windows import window_metrics


def _uid() -> str:
    return uuid.uuid4().hex[:10]


@query("land_files_csv_gzip", "SELECT * FROM orders")
def q_land_files_csv_gzip(spark, sf_dir):
    opts = {"header": "true", **JSON_OPTIONS}
    return land_files(spark, f"{sf_dir}/orders.parquet", scratch_path(spark, "land-csv"), "csv", "gzip",
                      src_fmt="parquet", write_options=opts)


@query("land_files_json_bzip2", "SELECT * FROM events")
def q_land_files_json_bzip2(spark, sf_dir):
    return land_files(spark, f"{sf_dir}/events.parquet", scratch_path(spark, "land-json"), "json", "bzip2",
                      src_fmt="parquet", write_options=dict(JSON_OPTIONS))


@query("land_files_parquet_zstd", "SELECT * FROM lineitem")
def q_land_files_parquet_zstd(spark, sf_dir):
    return land_files(spark, f"{sf_dir}/lineitem.parquet", scratch_path(spark, "land-parquet"), "parquet", "zstd")


def _database(spark, prefix: str) -> str:
    db = f"basin_{prefix}_{_uid()}"
    A.ensure_database(spark, db, comment="checks — vérification", location=scratch_path(spark, db))
    return db


@query("publish_table", "SELECT * FROM orders")
def q_publish_table(spark, sf_dir):
    db = _database(spark, "pub")
    return A.publish_table(
        X.table(spark, sf_dir, "orders"), f"{db}.orders", partition_by=["o_orderstatus"],
        comments={"o_orderkey": "order key — 订单编号", "o_orderstatus": "status partition"},
        properties={"data.owner": "platform", "retention.seconds": "604800"}, table_comment="orders, published")


@query("write_table", "SELECT * FROM orders UNION ALL SELECT * FROM orders")
def q_write_table(spark, sf_dir):
    db = _database(spark, "wt")
    name = f"{db}.orders"
    o = X.table(spark, sf_dir, "orders")
    steps = [B.write_table(o, name, "skip_if_exists"),        # created
             B.write_table(o, name, "skip_if_exists"),        # skipped
             B.write_table(o, name, "append"),                # appended: two copies
             B.write_table(spark.table(name), name, "replace")]  # replaced with itself
    if steps != ["created", "skipped", "appended", "replaced"]:
        raise AssertionError(f"unexpected write statuses {steps}")
    return spark.table(name)


@query("topic_roundtrip", "SELECT * FROM events")
def q_topic_roundtrip(spark, sf_dir):
    e = X.table(spark, sf_dir, "events")
    path = scratch_path(spark, "topic")
    # the file source stands in for a topic: (key, value) records written as JSON lines
    encode_records(e, "event_id").write.json(path)
    return decode_records(spark.read.schema("key STRING, value STRING").json(path), e.schema).drop("key")


@query("read_property_xml", """
SELECT c_custkey % 4 AS shard, c_name AS name, CAST(c_custkey AS VARCHAR) AS value FROM customer""")
def q_read_property_xml(spark, sf_dir):
    c = X.table(spark, sf_dir, "customer").withColumn("shard", F.col("c_custkey") % 4)
    path = scratch_path(spark, "xml")
    write_property_xml(c, path, name="c_name", value="c_custkey", partition_by=["shard"])
    shard = F.regexp_extract("file", "shard=([0-9]+)", 1).cast("long")
    return read_property_xml(spark, path).select(shard.alias("shard"), "name", "value")


@query("import_incremental_append", "SELECT * FROM orders")
def q_import_incremental_append(spark, sf_dir):
    o = X.table(spark, sf_dir, "orders")
    half = o.select((F.max("o_orderkey") / 2).cast("long")).scalar()
    loaded = o.where(F.col("o_orderkey") <= half)  # what an earlier run already imported
    return import_incremental(o, loaded, "append", "o_orderkey", last=half).table


@query("import_incremental_watermark", "SELECT max(o_orderkey) AS watermark FROM orders")
def q_import_incremental_watermark(spark, sf_dir):
    o = X.table(spark, sf_dir, "orders")
    half = o.select((F.max("o_orderkey") / 2).cast("long")).scalar()
    loaded = o.where(F.col("o_orderkey") <= half)
    return import_incremental(o, loaded, "append", "o_orderkey", last=half).watermark


@query("import_incremental_lastmodified", """
SELECT o_orderkey, o_orderdate,
       CASE WHEN o_orderdate > TIMESTAMP '1997-01-01 00:00:00' THEN o_totalprice + 1 ELSE o_totalprice END AS v
FROM orders""")
def q_import_incremental_lastmodified(spark, sf_dir):
    o = X.table(spark, sf_dir, "orders")
    old = o.select("o_orderkey", "o_orderdate", F.col("o_totalprice").alias("v"))
    src = o.select("o_orderkey", "o_orderdate",  # the source after later edits: newer rows changed
                   F.when(F.col("o_orderdate") > F.lit("1997-01-01 00:00:00").cast("timestamp_ntz"),
                          F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")).alias("v"))
    last = F.lit("1997-01-01 00:00:00").cast("timestamp_ntz")
    return import_incremental(src, old, "lastmodified", "o_orderdate", key="o_orderkey", last=last).table


def _stage_files(df, path, n_writes: int, key: str) -> None:
    """Write ``df`` once, then hand it to the file source in ``n_writes`` consecutive ranges of the numeric
    ``key``: the source replays files by modification time, so each range is its own append."""
    staged = f"{path}-staged"
    top = df.select(F.max(key).alias("m")).scalar()
    part = F.floor(F.col(key) * F.lit(n_writes) / (top + F.lit(1))).cast("int")
    df.withColumn("__range", part).write.partitionBy("__range").parquet(staged)
    spark = df.sparkSession
    for b in range(n_writes):
        one = spark.read.schema(df.schema).parquet(f"{staged}/__range={b}")
        one.write.mode("append").parquet(path)


#: State partitions and files per micro-batch of the fixtures' streams, whatever the input: configuration, as a
#: deployment would set them for its streams.
STATE_PARTITIONS, FILES_PER_BATCH = 8, 4


def _stream_session(spark, rocksdb: bool = False):
    """A session of its own for a stream: its state partition count is fixed at the first start, and the
    caller's settings stay as they are. ``rocksdb``: state in RocksDB whatever the caller's setting is, for
    streams that need it."""
    own = spark.newSession()
    own.conf.set("spark.sql.shuffle.partitions", str(STATE_PARTITIONS))
    own.conf.set("spark.sql.session.timeZone", "UTC")
    for key in ("spark.sql.streaming.stateStore.providerClass",
                "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled"):
        value = DEFAULT_CONF[key] if rocksdb else spark.conf.get(key, None)
        if value is not None:
            own.conf.set(key, value)
    return own


def _run_available(q):
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))


@query("upsert_stream", """
SELECT o_orderkey AS k, CASE WHEN o_orderstatus = 'F' THEN -1.0 ELSE o_totalprice END AS v FROM orders""")
def q_upsert_stream(spark, sf_dir):
    o = X.table(spark, sf_dir, "orders")
    base = scratch_path(spark, "upsert")
    src = f"{base}/in"
    k, v = F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v")
    o.repartition(FILES_PER_BATCH * 2).select(k, v, F.lit(1).alias("ver")).write.parquet(src)
    # later files repeat the F keys twice; the last delivery wins
    upd = o.where(F.col("o_orderstatus") == "F").repartition(2)
    for ver, price in ((2, -2.0), (3, -1.0)):
        upd.select(k, F.lit(price).alias("v"), F.lit(ver).alias("ver")).write.mode("append").parquet(src)
    own = _stream_session(spark)
    stream = (own.readStream.schema("k BIGINT, v DOUBLE, ver INT").option("maxFilesPerTrigger", FILES_PER_BATCH)
              .parquet(src))
    _run_available(upsert_stream(stream, "k", "ver", f"{base}/table", f"{base}/ckpt", trigger={"availableNow": True}))
    return read_upserted(spark, f"{base}/table").select("k", "v")


def _stream_windows(spark, sf_dir, key, **window):
    """Window metrics of the events as a stream. Files arrive in ranges of a quarter of the data, so rows are
    up to a range late (inside the bound); a closing row moves the watermark past every window, and a
    repeat of the first day arrives after it (outside the bound) and is dropped."""
    e = X.table(spark, sf_dir, "events")
    base = scratch_path(spark, "winstream")
    _stage_files(e, f"{base}/in", 4, "event_id")  # ts never decreases with event_id
    closing = spark.range(1).select(F.lit(-1).cast("long").alias("event_id"),
                                F.lit("2100-01-01 00:00:00").cast("timestamp_ntz").alias("ts"),
                                F.lit(-1).cast("long").alias("user_id"), F.lit("__close__").alias("event_type"),
                                F.lit(0.0).alias("value"), F.lit("{}").alias("props"))
    own = _stream_session(spark)

    def available():
        stream = own.readStream.schema(e.schema).option("maxFilesPerTrigger", FILES_PER_BATCH).parquet(f"{base}/in")
        agg = window_metrics(stream, "ts", key, value="value", lateness="10 days", **window)
        _run_available(agg.writeStream.format("parquet").outputMode("append")
                       .option("checkpointLocation", f"{base}/ckpt").trigger(availableNow=True).start(f"{base}/out"))

    available()
    closing.write.mode("append").parquet(f"{base}/in")  # one row: one file
    available()
    first_day = e.select(F.min("ts").alias("m")).scalar() + F.expr("INTERVAL 1 DAY")
    e.where(F.col("ts") < first_day).write.mode("append").parquet(f"{base}/in")
    available()
    out = spark.read.parquet(f"{base}/out")
    real = F.col(key) != (F.lit("__close__") if key == "event_type" else F.lit(-1))
    return out.where(real).withColumn("total", F.round("total", 2))


@query("window_sliding_stream", ORACLE["window_sliding"])
def q_window_sliding_stream(spark, sf_dir):
    return _stream_windows(spark, sf_dir, "event_type", kind="sliding", size="1 hour", slide="15 minutes")


@query("window_session_stream", ORACLE["window_session"])
def q_window_session_stream(spark, sf_dir):
    return _stream_windows(spark, sf_dir, "user_id", kind="session", gap="30 minutes")


@query("window_tumbling_stream", """
SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS window_start,
       time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end,
       count(*) AS n, round(sum(value), 2) AS total
FROM events GROUP BY 1, 2, 3""")
def q_window_tumbling_stream(spark, sf_dir):
    return _stream_windows(spark, sf_dir, "event_type", kind="tumbling", size="1 hour")


@query("dedup_stream_files", "SELECT * FROM events")
def q_dedup_stream_files(spark, sf_dir):
    e = X.table(spark, sf_dir, "events")
    base = scratch_path(spark, "dedup")
    # every error event is delivered twice, the second time with the next range (inside the bound)
    again = e.where(F.col("event_type") == "error")
    top = e.select(F.max("event_id").alias("m")).scalar()
    sent = e.withColumn("__at", F.col("event_id")).unionByName(again.withColumn(
        "__at", F.least(F.col("event_id") + F.floor(top / 8), top)))
    _stage_files(sent, f"{base}/in", 4, "__at")
    # the events of the first range come once more at the end: older than the bound, dropped as late
    e.where(F.col("event_id") < top / 4).write.mode("append").parquet(f"{base}/in")
    own = _stream_session(spark)
    stream = own.readStream.schema(e.schema).option("maxFilesPerTrigger", FILES_PER_BATCH).parquet(f"{base}/in")
    d = dedup_stream(stream, "ts", "event_id", "12 days")
    _run_available(d.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{base}/ckpt")
                   .trigger(availableNow=True).start(f"{base}/out"))
    return spark.read.schema(e.schema).parquet(f"{base}/out")


@query("topic_stream", "SELECT * FROM events")
def q_topic_stream(spark, sf_dir):
    """write_topic and read_topic end to end; JSON files stand in for the broker's topic."""
    e = X.table(spark, sf_dir, "events")
    base = scratch_path(spark, "topic-stream")
    write_topic(e, "event_id", "unused:9092", "events", sink="json", options={"path": f"{base}/topic"})
    stream = read_topic(_stream_session(spark), "unused:9092", "events", e.schema, source="json",
                        options={"path": f"{base}/topic"}, source_schema="key string, value string")
    _run_available(stream.drop("key").writeStream.format("parquet").option("checkpointLocation", f"{base}/ckpt")
                   .trigger(availableNow=True).start(f"{base}/out"))
    return spark.read.schema(e.schema).parquet(f"{base}/out")


APPS = 16  # a bounded number of applications


def event_log(spark, sf_dir) -> str:
    """Listener event lines of 16 applications under the shared folder: a job per order (failed for status F), a
    task per line item (failed if returned), start and end events, and a broken line per order of status P.

    Each task of the write keeps a gzip file open for every application, so lines are neither shuffled nor sorted
    and an application's log is as many files as the tables have splits."""
    own = spark.newSession()
    own.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    own.conf.set("spark.sql.maxConcurrentOutputFileWriters", str(2 * APPS))
    o, l = X.table(own, sf_dir, "orders"), X.table(own, sf_dir, "lineitem")
    ms = lambda c: F.unix_millis(F.col(c).cast("timestamp"))
    app = lambda k: F.concat(F.lit("app-"), F.pmod(F.col(k), F.lit(APPS)).cast("string"))
    line = lambda name, **cols: F.to_json(F.struct(F.lit(name).alias("Event"), *[
        c.alias(n.replace("_", " ")) for n, c in cols.items()])).alias("value")
    jobs = o.select(app("o_orderkey").alias("app"), line(
        "SparkListenerJobEnd", Job_ID=F.col("o_orderkey"), Completion_Time=ms("o_orderdate"),
        Job_Result=F.struct(F.when(F.col("o_orderstatus") == "F", "JobFailed").otherwise("JobSucceeded").alias("Result"))))
    size = F.floor(F.col("l_extendedprice")).cast("bigint")
    tasks = l.select(app("l_orderkey").alias("app"), line(
        "SparkListenerTaskEnd", Stage_ID=F.col("l_orderkey"),
        Task_Info=F.struct(F.col("l_linenumber").cast("bigint").alias("Task ID"), ms("l_shipdate").alias("Finish Time"),
                           (F.col("l_returnflag") == "R").alias("Failed")),
        Task_Metrics=F.struct(
            F.col("l_quantity").cast("bigint").alias("Executor Run Time"),
            F.lit(0).cast("bigint").alias("Disk Bytes Spilled"), F.col("l_partkey").alias("Memory Bytes Spilled"),
            F.struct(size.alias("Shuffle Bytes Written")).alias("Shuffle Write Metrics"),
            F.struct(F.col("l_suppkey").alias("Remote Bytes Read"), size.alias("Local Bytes Read")).alias(
                "Shuffle Read Metrics"))))
    ends = o.groupBy(app("o_orderkey").alias("app")).agg(F.min(ms("o_orderdate")).alias("lo"), F.max(ms("o_orderdate")).alias("hi"))
    start = ends.select("app", line("SparkListenerApplicationStart", App_ID=F.col("app"), Timestamp=F.col("lo")))
    end = ends.select("app", line("SparkListenerApplicationEnd", Timestamp=F.col("hi")))
    broken = o.where(F.col("o_orderstatus") == "P").select(
        app("o_orderkey").alias("app"), F.concat(F.lit('{"Event":"SparkListenerJobEnd","Job ID":'), "o_orderkey").alias("value"))
    path = scratch_path(spark, "eventlog")
    lines = jobs.unionByName(tasks).unionByName(start).unionByName(end).unionByName(broken)
    lines.write.partitionBy("app").option("zlib.compress.level", "BEST_SPEED").text(path, compression="gzip")
    return path


EVENT_LOG_SQL = """jobs AS (SELECT 'app-' || o_orderkey % 16 AS app, o_orderkey AS k, epoch_ms(o_orderdate) AS t, o_orderstatus AS s
  FROM orders),
tasks AS (SELECT 'app-' || l_orderkey % 16 AS app, l_orderkey AS k, epoch_ms(l_shipdate) AS t, CAST(l_linenumber AS BIGINT) AS id,
    l_returnflag = 'R' AS failed, CAST(floor(l_quantity) AS BIGINT) AS run, l_partkey AS spill,
    CAST(floor(l_extendedprice) AS BIGINT) AS size, l_suppkey AS remote FROM lineitem)"""


@query("read_event_log", f"""
WITH {EVENT_LOG_SQL},
e AS (SELECT app, 'SparkListenerJobEnd' AS event, t AS time_ms, k AS job_id,
    CASE WHEN s = 'F' THEN 'JobFailed' ELSE 'JobSucceeded' END AS job_result FROM jobs
  UNION ALL SELECT app, 'SparkListenerApplicationStart', min(t), NULL, NULL FROM jobs GROUP BY app
  UNION ALL SELECT app, 'SparkListenerApplicationEnd', max(t), NULL, NULL FROM jobs GROUP BY app
  UNION ALL SELECT app, 'Unreadable', NULL, NULL, NULL FROM jobs WHERE s = 'P')
SELECT app, event, time_ms, job_id, job_result, CAST(NULL AS BIGINT) AS stage_id, CAST(NULL AS BIGINT) AS task_id,
  CAST(NULL AS BOOLEAN) AS task_failed, CAST(NULL AS BIGINT) AS run_time_ms, CAST(NULL AS BIGINT) AS disk_spill_bytes,
  CAST(NULL AS BIGINT) AS memory_spill_bytes, CAST(NULL AS BIGINT) AS shuffle_write_bytes,
  CAST(NULL AS BIGINT) AS shuffle_read_bytes FROM e
UNION ALL
SELECT app, 'SparkListenerTaskEnd', t, NULL, NULL, k, id, failed, run, 0, spill, size, remote + size FROM tasks""")
def q_read_event_log(spark, sf_dir):
    return read_event_log(spark, event_log(spark, sf_dir))


@query("run_summary", f"""
WITH {EVENT_LOG_SQL},
j AS (SELECT app, count(*) AS n_jobs, count(*) FILTER (s = 'F') AS n_failed_jobs, max(t) - min(t) AS wall_ms,
    count(*) FILTER (s = 'P') AS n_unreadable FROM jobs GROUP BY app),
k AS (SELECT app, count(*) AS n_tasks, count(*) FILTER (failed) AS n_failed_tasks, CAST(sum(run) AS BIGINT) AS run_time_ms,
    CAST(sum(size) AS BIGINT) AS shuffle_write_bytes, CAST(sum(remote + size) AS BIGINT) AS shuffle_read_bytes,
    CAST(sum(spill) AS BIGINT) AS spill_bytes FROM tasks GROUP BY app)
SELECT app, n_jobs, n_failed_jobs, coalesce(n_tasks, 0) AS n_tasks, coalesce(n_failed_tasks, 0) AS n_failed_tasks, wall_ms,
  run_time_ms, shuffle_write_bytes, shuffle_read_bytes, spill_bytes, n_unreadable
FROM j LEFT JOIN k USING (app)""")
def q_run_summary(spark, sf_dir):
    return run_summary(read_event_log(spark, event_log(spark, sf_dir)))


@query("ensure_database", """
SELECT CAST(count(*) AS BIGINT) AS n_orders, TRUE AS created_first, FALSE AS created_again, 'checks — vérification' AS comment
FROM orders""")
def q_ensure_database(spark, sf_dir):
    name = f"basin_db_{_uid()}"
    where = scratch_path(spark, name)
    first, again = (A.ensure_database(spark, name, comment="checks — vérification", location=where) for _ in range(2))
    orders = A.publish_table(X.table(spark, sf_dir, "orders"), f"{name}.orders", partition_by=["o_orderstatus"])
    return orders.agg(F.count("*").alias("n_orders")).select(
        "n_orders", F.lit(first).alias("created_first"), F.lit(again).alias("created_again"),
        F.lit(spark.catalog.getDatabase(name).description).alias("comment"))


@query("sql_job_published", """
SELECT o_orderstatus, o_orderpriority, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS revenue
FROM orders WHERE o_totalprice >= 1000 GROUP BY ALL""")
def q_sql_job_published(spark, sf_dir):
    """SQL over a catalog table with named parameters, the result published as a partitioned table."""
    db = _database(spark, "job")
    A.publish_table(X.table(spark, sf_dir, "orders"), f"{db}.orders", partition_by=["o_orderstatus"])
    return sql_job(spark, f"""
        SELECT o_orderpriority, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS revenue,
               o_orderstatus
        FROM {db}.orders WHERE o_totalprice >= :least GROUP BY o_orderpriority, o_orderstatus""",
                   args={"least": 1000}, target=f"{db}.revenue", partition_by=["o_orderstatus"],
                   comments={"revenue": "sum of total prices"})


@query("land_files_csv_documents", "SELECT * FROM documents")
def q_land_files_csv_documents(spark, sf_dir):
    return land_files(spark, f"{sf_dir}/documents.parquet", scratch_path(spark, "land-docs"), "csv", "gzip", src_fmt="parquet")


@query("land_files_json_events", "SELECT * FROM events")
def q_land_files_json_events(spark, sf_dir):
    return land_files(spark, f"{sf_dir}/events.parquet", scratch_path(spark, "land-ev"), "json", "gzip", src_fmt="parquet")
