"""Registered queries of the time-aware operators: as-of and interval joins, streams of both, health over time."""

from __future__ import annotations

from pyspark.sql import functions as F

from basin.operators.timejoins import asof_join, interval_join
from basin.plans import fixtures as X
from basin.plans import io_queries as IO
from basin.plans.queries import query
from basin.session import scratch_path
from basin.streaming.health import health_transitions
from basin.streaming.joins import match_streams


@query("asof_join", """
WITH l AS (SELECT o_orderkey, o_custkey % 97 AS host, o_orderdate + INTERVAL 28 YEAR AS at FROM orders),
r AS (SELECT user_id % 97 AS host, ts, event_id, event_type FROM events)
SELECT l.o_orderkey, l.host, l.at, r.event_id, r.event_type, r.ts AS event_ts
FROM l ASOF LEFT JOIN r ON l.host = r.host AND l.at >= r.ts""")
def q_asof_join(spark, sf_dir):
    """Every order with the latest event of its host before it."""
    moved = F.col("o_orderdate") + F.expr("INTERVAL 28 YEAR")
    l = X.table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 97).alias("host"), moved.alias("at"))
    r = X.table(spark, sf_dir, "events").select((F.col("user_id") % 97).alias("host"), "ts", "event_id", "event_type")
    return asof_join(l, r, "at", "ts", "host", prefix="r_").select(
        "o_orderkey", "host", "at", F.col("r_event_id").alias("event_id"), F.col("r_event_type").alias("event_type"),
        F.col("r_ts").alias("event_ts"))


@query("asof_join_hot_key", """
WITH e AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 0 ELSE user_id END AS host, event_type, ts, value FROM events),
r AS (SELECT host, ts, value FROM e WHERE event_type = 'signup')
SELECT l.event_id, l.host, l.ts, CASE WHEN r.ts >= l.ts - INTERVAL 6 HOUR THEN r.ts END AS opened,
  CASE WHEN r.ts >= l.ts - INTERVAL 6 HOUR THEN r.value END AS opened_value
FROM e l ASOF LEFT JOIN r ON l.host = r.host AND l.ts > r.ts""")
def q_asof_join_hot_key(spark, sf_dir):
    """Every process with the last socket its host opened before it, at most six hours ago; one host has a third of all rows."""
    e = X.table(spark, sf_dir, "events").select(
        "event_id", F.when(F.col("event_id") % 3 == 0, 0).otherwise(F.col("user_id")).alias("host"), "event_type", "ts", "value")
    r = e.where(F.col("event_type") == "signup").select("host", "ts", "value")
    return asof_join(e, r, "ts", "ts", "host", strict=True, tolerance=F.expr("INTERVAL 6 HOURS"), prefix="r_").select(
        "event_id", "host", "ts", F.col("r_ts").alias("opened"), F.col("r_value").alias("opened_value"))


@query("interval_join", """
WITH a AS (SELECT o_orderkey AS k, o_custkey AS host, o_orderdate AS b, o_orderdate + to_days(CAST(o_orderkey % 30 AS INTEGER)) AS e FROM orders)
SELECT x.k, x.host, y.k AS other, x.b, x.e, y.b AS other_b, y.e AS other_e
FROM a x JOIN a y ON x.host = y.host AND x.b <= y.e AND y.b <= x.e WHERE x.k < y.k""")
def q_interval_join(spark, sf_dir):
    """Runs of a host that overlap in time: an order is a run of some days on its customer."""
    o = X.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("host"), F.col("o_orderdate").alias("b"),
        (F.col("o_orderdate") + F.make_dt_interval((F.col("o_orderkey") % 30).cast("int"))).alias("e"))
    return interval_join(o, o, ("b", "e"), ("b", "e"), "host", prefix="other_").where("k < other_k").select(
        "k", "host", F.col("other_k").alias("other"), "b", "e", "other_b", "other_e")


@query("range_join", """
WITH r AS (SELECT s_suppkey, s_acctbal - 2 AS lo, s_acctbal + s_suppkey % 5 AS hi FROM supplier)
SELECT c_custkey, c_acctbal, s_suppkey FROM customer JOIN r ON c_acctbal BETWEEN lo AND hi""")
def q_range_join(spark, sf_dir):
    """A join with nothing but BETWEEN: customers whose balance lies in a supplier's range."""
    c = X.table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    s = X.table(spark, sf_dir, "supplier").select(
        "s_suppkey", (F.col("s_acctbal") - 2).alias("lo"), (F.col("s_acctbal") + F.col("s_suppkey") % 5).alias("hi"))
    return interval_join(c, s, ("c_acctbal", "c_acctbal"), ("lo", "hi"), prefix="").select("c_custkey", "c_acctbal", "s_suppkey")


def _files_in_ranges(df, path, key="event_id", n=4):
    IO._stage_files(df, path, n, key)


#: Days a range of a stream's files covers at most: fewer than the lateness the stream allows.
RANGE_DAYS = 10
#: Rows of a state partition, and groups of hosts in one.
STATE_ROWS, STATE_GROUPS = 2_000_000, 32


def _files_by_time(df, path, n=4) -> int:
    """Hand ``df`` to the file source in consecutive ranges of ``ts``, ``n`` or more, each its own append, so rows are late by a
    range at most in whatever order they are stored. Rows without a time go with the first. The number of files."""
    staged, spark = f"{path}-staged", df.sparkSession
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    low, high = (x or 0 for x in df.select(F.min(at), F.max(at)).first())
    width = min(-(-(high - low + 1) // n), RANGE_DAYS * 86_400_000_000)
    part = F.coalesce(F.floor((at - F.lit(low)) / F.lit(width)), F.lit(0))
    df.withColumn("__range", part).write.partitionBy("__range").parquet(staged)
    read = lambda p: spark.read.schema(df.schema).parquet(p)
    for r in sorted(r[0] for r in spark.read.parquet(staged).select("__range").distinct().collect()):
        read(f"{staged}/__range={r}").write.mode("append").parquet(path)
    return len(read(path).inputFiles())


def _closing(spark, schema):
    """One row long after all others: it moves the watermark past them."""
    values = {"event_id": -1, "user_id": -1, "event_type": "__close__", "value": 0.0, "props": "{}"}
    return spark.range(1).select([F.lit("2100-01-01 00:00:00").cast(f.dataType).alias(f.name) if f.name == "ts"
                                  else F.lit(values[f.name]).cast(f.dataType).alias(f.name) for f in schema.fields])


def _run(stream, base, name):
    IO._run_available(stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{base}/{name}-ckpt")
                      .trigger(availableNow=True).start(f"{base}/{name}"))


MATCH_SQL = """
WITH l AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'signup'),
r AS (SELECT event_id, user_id, ts FROM events WHERE event_type <> 'signup')
SELECT l.event_id, l.user_id, l.ts, r.event_id AS other_id, r.ts AS other_ts
FROM l LEFT JOIN r ON l.user_id = r.user_id AND r.ts BETWEEN l.ts - INTERVAL 30 MINUTE AND l.ts + INTERVAL 6 HOUR"""


def _matched(l, r, **lateness):
    out = match_streams(l.where("event_type = 'signup'").select("event_id", "user_id", "ts"),
                        r.where("event_type <> 'signup'").select("event_id", "user_id", "ts"), "user_id", "ts", "ts",
                        "-30 MINUTES", "6 HOURS", how="left", prefix="other_", **lateness)
    return out.select("event_id", "user_id", "ts", F.col("other_event_id").alias("other_id"), "other_ts")


@query("match_streams_batch", MATCH_SQL)
def q_match_streams_batch(spark, sf_dir):
    e = X.table(spark, sf_dir, "events")
    return _matched(e, e)


@query("match_streams", MATCH_SQL)
def q_match_streams(spark, sf_dir):
    """Socket events with the process events around them, as two streams. Files come in ranges, so rows of both are up to
    a range late (inside the bound); after a closing row the first day comes again on both sides, and is dropped."""
    e = X.table(spark, sf_dir, "events")
    base = scratch_path(spark, "match")
    _files_in_ranges(e, f"{base}/in")
    own = IO._stream_session(spark)

    def available():
        l, r = (own.readStream.schema(e.schema).option("maxFilesPerTrigger", IO.FILES_PER_BATCH).parquet(f"{base}/in") for _ in range(2))
        l, r = (s.withColumn("event_type", F.when(F.col("event_type") == "__close__", kind).otherwise(F.col("event_type")))
                for s, kind in ((l, "signup"), (r, "click")))  # the closing row counts on both sides
        _run(_matched(l, r, left_lateness="12 days", right_lateness="12 days"), base, "out")

    available()
    _closing(spark, e.schema).write.mode("append").parquet(f"{base}/in")
    available()
    first_day = e.select(F.min("ts").alias("m")).scalar() + F.expr("INTERVAL 1 DAY")
    e.where(F.col("ts") < first_day).write.mode("append").parquet(f"{base}/in")
    available()
    return spark.read.parquet(f"{base}/out").where("event_id >= 0")


@query("health_transitions", """
WITH o AS (SELECT user_id AS host, ts, bool_or(event_type = 'signup') AS listens FROM events GROUP BY ALL),
s AS (SELECT *, max(CASE WHEN listens THEN ts END) OVER w AS heard, lag(ts) OVER h AS prev, lead(ts) OVER h AS next FROM o
  WINDOW h AS (PARTITION BY host ORDER BY ts), w AS (PARTITION BY host ORDER BY ts ROWS UNBOUNDED PRECEDING)),
t AS (SELECT *, lag(heard) OVER (PARTITION BY host ORDER BY ts) AS prev_heard,
    CASE WHEN ts <= heard + INTERVAL 6 HOUR THEN 'running' ELSE 'no_listener' END AS state FROM s),
b AS (SELECT *, CASE WHEN prev IS NULL THEN 'absent' WHEN ts <= prev_heard + INTERVAL 6 HOUR THEN 'running'
    WHEN ts <= prev + INTERVAL 2 DAY THEN 'no_listener' ELSE 'absent' END AS before FROM t)
SELECT host, ts AS at, state FROM b WHERE state <> before
UNION ALL SELECT host, heard + INTERVAL 6 HOUR, 'no_listener' FROM b
  WHERE state = 'running' AND (next IS NULL OR heard + INTERVAL 6 HOUR < next)
UNION ALL SELECT host, ts + INTERVAL 2 DAY, 'absent' FROM b WHERE next IS NULL OR ts + INTERVAL 2 DAY < next""")
def q_health_transitions(spark, sf_dir):
    """Every change of every host's health. Events are observations of a process, sign-ups of a listening socket; files come
    in ranges (late inside the bound), the query is stopped and started again, and the first day comes late a second time."""
    e = X.table(spark, sf_dir, "events")
    base = scratch_path(spark, "health")
    files = _files_by_time(e, f"{base}/in")
    files = max(IO.FILES_PER_BATCH, -(-files // 4))  # larger micro-batches for more rows, not more of them
    own = IO._stream_session(spark, rocksdb=True)  # transformWithState needs it
    parts = max(IO.STATE_PARTITIONS, e.count() // STATE_ROWS)
    own.conf.set("spark.sql.shuffle.partitions", str(parts))

    def available():
        s = own.readStream.schema(e.schema).option("maxFilesPerTrigger", files).parquet(f"{base}/in")
        s = s.withColumn("listens", F.col("event_type") == "signup")
        _run(health_transitions(s, "user_id", "ts", "listens", "6 HOURS", "2 DAYS", "12 days", groups=STATE_GROUPS * parts), base, "out")

    available()
    _closing(spark, e.schema).write.mode("append").parquet(f"{base}/in")
    available()
    first_day = e.select(F.min("ts").alias("m")).scalar() + F.expr("INTERVAL 1 DAY")
    e.where(F.col("ts") < first_day).write.mode("append").parquet(f"{base}/in")
    available()
    return spark.read.parquet(f"{base}/out").where("user_id >= 0").withColumnRenamed("user_id", "host")
