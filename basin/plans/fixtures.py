"""Inputs derived from the driver tables, built the same way the SQL check builds them.

Every fixture reads whole tables; modulo tests on keys only decide *which side* a row falls on
(source vs. target snapshot, batch membership), never how much data is read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basin.operators.topology import join_list

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def snapshot_pair(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Source and target ``(k, v)`` snapshots of orders: the source lacks keys divisible by 13, the target
    lacks keys divisible by 10 that the source has, and has price 0 where the key is divisible by 7."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    src = o.where(k % 13 != 0).select(k.alias("k"), F.col("o_totalprice").alias("v"))
    dst = o.where((k % 10 != 0) | (k % 13 == 0)).select(k.alias("k"), F.when(k % 7 == 0, F.lit(0.0))
                                      .otherwise(F.col("o_totalprice")).alias("v"))
    return src, dst


def property_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(owner, text)``: a settings file per customer and month, one line per order in key order:
    ``<priority>=<orderkey>``, commented out (``#``) for status F and quoted for status P."""
    o = table(spark, sf_dir, "orders")
    v = F.col("o_orderkey").cast("string")
    line = F.concat(F.when(F.col("o_orderstatus") == "F", F.lit("#")).otherwise(F.lit("")),
                    F.col("o_orderpriority"), F.lit("="),
                    F.when(F.col("o_orderstatus") == "P", F.concat(F.lit('"'), v, F.lit('"'))).otherwise(v))
    o = o.withColumn("owner", F.concat_ws("/", F.col("o_custkey").cast("string"), F.date_format("o_orderdate", "yyyy-MM")))
    return join_list(o, "owner", "o_orderkey", line, sep="\n", name="text")


PROPERTY_TEXT_SQL = """property_text AS (
  SELECT o_custkey || '/' || strftime(o_orderdate, '%Y-%m') AS owner,
         string_agg(CASE WHEN o_orderstatus = 'F' THEN '#' ELSE '' END || o_orderpriority || '=' ||
                    CASE WHEN o_orderstatus = 'P' THEN '"' || CAST(o_orderkey AS VARCHAR) || '"'
                         ELSE CAST(o_orderkey AS VARCHAR) END, chr(10) ORDER BY o_orderkey) AS text
  FROM orders GROUP BY ALL)"""


def processes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(host, pid, name)``: every event is a process on host ``user_id``."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("host"), (F.col("event_id") % 500).alias("pid"),
                    F.col("event_type").alias("name"))


LISTEN_PORT = 9083


def sockets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(host, pid, port)``: sign-up events own a listening socket on port 9083."""
    e = table(spark, sf_dir, "events").where(F.col("event_type") == "signup")
    return e.select(F.col("user_id").alias("host"), (F.col("event_id") % 500).alias("pid"),
                    F.lit(LISTEN_PORT).alias("port"))


def node_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(owner, list)``: clusters of five hosts (the customers) in key order, comma separated."""
    c = table(spark, sf_dir, "customer").withColumn("owner", F.floor(F.col("c_custkey") / 5).cast("bigint"))
    return join_list(c, "owner", "c_custkey", "c_name", sep=",", name="list")


NODE_LIST_SQL = """node_list AS (
  SELECT CAST(floor(c_custkey / 5) AS BIGINT) AS owner, string_agg(c_name, ',' ORDER BY c_custkey) AS list
  FROM customer GROUP BY ALL)"""


# fixed values: order statuses every customer is required to have
REQUIRED_STATUSES = ("F", "O", "P")


def requirements(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Required ``(item, needs)`` = every customer x statuses F, O, P; present = statuses seen in orders."""
    c = table(spark, sf_dir, "customer")
    req = c.select(F.col("c_custkey").alias("item"),
                   F.explode(F.array(*[F.lit(s) for s in REQUIRED_STATUSES])).alias("needs"))
    o = table(spark, sf_dir, "orders")
    have = o.select(F.col("o_custkey").alias("item"), F.col("o_orderstatus").alias("needs"))
    return req, have
