"""Application event logs (JSON lines, one listener event per line) as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# the listener fields we read; names are Spark's event-log JSON keys
EVENT_SCHEMA = (
    "`Event` STRING, `App ID` STRING, `App Name` STRING, `Timestamp` BIGINT, `Job ID` BIGINT, "
    "`Submission Time` BIGINT, `Completion Time` BIGINT, `Job Result` STRUCT<`Result`: STRING>, "
    "`Stage ID` BIGINT, `Task Info` STRUCT<`Task ID`: BIGINT, `Launch Time`: BIGINT, `Finish Time`: BIGINT, "
    "`Failed`: BOOLEAN>, `Task Metrics` STRUCT<`Executor Run Time`: BIGINT, `Disk Bytes Spilled`: BIGINT, "
    "`Memory Bytes Spilled`: BIGINT, `Shuffle Write Metrics`: STRUCT<`Shuffle Bytes Written`: BIGINT>, "
    "`Shuffle Read Metrics`: STRUCT<`Remote Bytes Read`: BIGINT, `Local Bytes Read`: BIGINT>>"
)


# fixed values: compressions Spark can write event logs in but its text source cannot read
UNREADABLE_SUFFIXES = ("lz4", "lzf", "snappy")
UNREADABLE = "Unreadable"


def event_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(value, file)``: every line of every event log under ``path`` (plain, zstd as Spark writes by default, gzip or bzip2).

    A log in a compression the text source cannot read raises before any work; only file names are listed
    for that, chosen by a glob.
    """
    packed = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
              .option("pathGlobFilter", "*.{" + ",".join(UNREADABLE_SUFFIXES) + "}").load(path).select("path"))
    found = packed.limit(1).collect()
    if found:
        raise ValueError(f"{found[0].path}: unsupported compression; decompress it or set "
                         "spark.eventLog.compress=false for the application")
    file = F.col("_metadata.file_path")
    return (spark.read.option("recursiveFileLookup", "true").text(path)
            .where(~F.substring_index(file, "/", -1).startswith("appstatus"))
            .select(F.col("value"), file.alias("file")))


def read_event_log(spark: SparkSession, path: str) -> DataFrame:
    """One row per line of an event-log directory, searched recursively: single files, rolled
    ``eventlog_v2_<app>/events_<n>_<app>`` folders and ``app=<app>/`` partition folders.

    The application id comes from the path because only the start event carries it. A line that is not a
    listener event comes out with event ``Unreadable`` and no values, so nothing is lost uncounted; blank
    lines are skipped.
    """
    raw = event_lines(spark, path).where(F.trim("value") != "")
    # cut by separators, as this is done for every line: a pattern over the path costs more than parsing the line
    name, folder = (F.substring_index(F.substring_index("file", "/", -n), "/", 1) for n in (1, 2))
    after = lambda prefix: F.when(folder.startswith(prefix), F.nullif(F.substring(folder, len(prefix) + 1, 1 << 30), F.lit("")))
    single = F.regexp_extract(name, "^([^/]+?)(?:\\.(?:inprogress|gz|bz2|zstd|zst))*$", 1)
    app = F.coalesce(after("eventlog_v2_"), after("app="), single)
    e = F.from_json(F.col("value"), EVENT_SCHEMA).alias("e")
    p = raw.select(app.alias("app"), e)
    return p.select(
        "app", F.coalesce(F.col("e.Event"), F.lit(UNREADABLE)).alias("event"),
        F.coalesce(F.col("e.`Completion Time`"), F.col("e.`Submission Time`"), F.col("e.Timestamp"),
                   F.col("e.`Task Info`.`Finish Time`")).alias("time_ms"),
        F.col("e.`Job ID`").alias("job_id"), F.col("e.`Job Result`.Result").alias("job_result"),
        F.col("e.`Stage ID`").alias("stage_id"), F.col("e.`Task Info`.`Task ID`").alias("task_id"),
        F.col("e.`Task Info`.Failed").alias("task_failed"),
        F.col("e.`Task Metrics`.`Executor Run Time`").alias("run_time_ms"),
        F.col("e.`Task Metrics`.`Disk Bytes Spilled`").alias("disk_spill_bytes"),
        F.col("e.`Task Metrics`.`Memory Bytes Spilled`").alias("memory_spill_bytes"),
        F.col("e.`Task Metrics`.`Shuffle Write Metrics`.`Shuffle Bytes Written`").alias("shuffle_write_bytes"),
        (F.col("e.`Task Metrics`.`Shuffle Read Metrics`.`Remote Bytes Read`") +
         F.col("e.`Task Metrics`.`Shuffle Read Metrics`.`Local Bytes Read`")).alias("shuffle_read_bytes"),
    )


def run_summary(events: DataFrame) -> DataFrame:
    """per application: jobs, failed jobs, tasks, failed tasks, wall time, run time, shuffle, spill and
    unreadable lines."""
    ev = F.col("event")
    task = ev == "SparkListenerTaskEnd"
    return events.groupBy("app").agg(
        F.sum(F.when(ev == "SparkListenerJobEnd", 1).otherwise(0)).cast("long").alias("n_jobs"),
        F.sum(F.when((ev == "SparkListenerJobEnd") & (F.col("job_result") != "JobSucceeded"), 1)
              .otherwise(0)).cast("long").alias("n_failed_jobs"),
        F.sum(F.when(task, 1).otherwise(0)).cast("long").alias("n_tasks"),
        F.sum(F.when(task & F.col("task_failed"), 1).otherwise(0)).cast("long").alias("n_failed_tasks"),
        (F.max(F.when(ev == "SparkListenerApplicationEnd", F.col("time_ms"))) -
         F.min(F.when(ev == "SparkListenerApplicationStart", F.col("time_ms")))).alias("wall_ms"),
        F.sum(F.when(task, F.col("run_time_ms"))).cast("long").alias("run_time_ms"),
        F.sum(F.when(task, F.col("shuffle_write_bytes"))).cast("long").alias("shuffle_write_bytes"),
        F.sum(F.when(task, F.col("shuffle_read_bytes"))).cast("long").alias("shuffle_read_bytes"),
        F.sum(F.when(task, F.coalesce("disk_spill_bytes", F.lit(0)) + F.coalesce("memory_spill_bytes", F.lit(0))))
        .cast("long").alias("spill_bytes"),
        F.count_if(ev == UNREADABLE).alias("n_unreadable"),
    )
