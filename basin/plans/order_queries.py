"""Registered queries of install order, sketches, cubes, snapshot trees and SQL line functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from basin.operators import sketches as S
from basin.operators.cubes import cube
from basin.operators.installorder import install_order
from basin.operators.snapshottree import tree_diff, write_snapshot
from basin.plans import fixtures as X
from basin.plans import io_queries as IO
from basin.plans.jobs import sql_job
from basin.plans.line_functions import register_line_functions
from basin.plans.queries import query
from basin.session import scratch_path
from basin.sources.catalog import publish_table
from basin.sources.settings import register_settings


@query("install_order", """
WITH RECURSIVE edges(item, needs) AS (SELECT c_custkey, c_custkey // 3 FROM customer WHERE c_custkey > 0
  UNION SELECT c_custkey, c_custkey // 5 FROM customer WHERE c_custkey % 4 = 0 AND c_custkey > 0
  UNION SELECT c_custkey // 3, c_custkey FROM customer WHERE c_custkey % 499 = 498),
reach(a, b) AS (SELECT item, needs FROM edges UNION SELECT reach.a, edges.needs FROM reach JOIN edges ON reach.b = edges.item),
loops AS (SELECT a AS c FROM reach WHERE a = b),
behind AS (SELECT DISTINCT a AS c FROM reach WHERE b IN (SELECT c FROM loops)),
core AS (SELECT c FROM behind WHERE c IN (SELECT c FROM loops) OR c IN (SELECT b FROM reach WHERE a IN (SELECT c FROM loops))),
longest(item, level) AS (SELECT c_custkey, 0 FROM customer WHERE c_custkey NOT IN (SELECT c FROM behind)
  UNION SELECT edges.item, level + 1 FROM longest JOIN edges ON edges.needs = longest.item
    WHERE edges.item NOT IN (SELECT c FROM behind))
SELECT c_custkey AS item, CAST((SELECT max(level) FROM longest WHERE longest.item = c_custkey) AS INTEGER) AS level,
  CASE WHEN c_custkey IN (SELECT c FROM core) THEN 'cycle' WHEN c_custkey IN (SELECT c FROM behind) THEN 'waits' ELSE 'ordered' END AS state
FROM customer""")
def q_install_order(spark, sf_dir):
    """Customers as components that need others of smaller number, a few of them in cycles."""
    c = X.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    edge = lambda item, needs: F.struct(item.cast("bigint").alias("item"), needs.cast("bigint").alias("needs"))
    k, third, fifth = F.col("k"), F.floor(F.col("k") / 3), F.floor(F.col("k") / 5)
    edges = c.select(F.explode(F.array_compact(F.array(
        F.when(k > 0, edge(k, third)), F.when((k % 4 == 0) & (k > 0), edge(k, fifth)),
        F.when(k % 499 == 498, edge(third, k))))).alias("e")).select("e.*")
    return install_order(edges, c.withColumnRenamed("k", "item"))


@query("sketches_merged", """
SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS n_users, TRUE AS users_ok, TRUE AS median_ok, TRUE AS ninety_ok
FROM events GROUP BY event_type""")
def q_sketches_merged(spark, sf_dir):
    """Sketches per day and type are stored, then merged per type; estimates are held against exact figures."""
    e = X.table(spark, sf_dir, "events")
    path = scratch_path(spark, "sketches")
    S.sketch(e.withColumn("day", F.to_date("ts")), ["day", "event_type"], "user_id", "value").write.partitionBy("day").parquet(path)
    merged = S.merge(spark.read.parquet(path), "event_type").select(
        "event_type", "n", S.distinct_estimate().alias("users"), S.quantile(0.5).alias("median"), S.quantile(0.9).alias("ninety"))
    merged = merged.withColumnRenamed("event_type", "type")
    exact = e.join(F.broadcast(merged), e.event_type == F.col("type")).groupBy("event_type").agg(  # a row for each event type
        F.first("n").alias("n"), F.count_distinct("user_id").alias("n_users"), F.first("users").alias("users"),
        *[(F.sum((F.col("value") <= F.col(q)).cast("int")) / F.count("value")).alias(q) for q in ("median", "ninety")],
        *[(F.sum((F.col("value") < F.col(q)).cast("int")) / F.count("value")).alias(f"below_{q}") for q in ("median", "ninety")])
    near = lambda q, share: (F.col(q) >= share - S.RANK_ERROR) & (F.col(f"below_{q}") <= share + S.RANK_ERROR)
    return exact.select("event_type", "n", "n_users",
                        (F.abs(F.col("users") - F.col("n_users")) <= S.DISTINCT_ERROR * F.col("n_users")).alias("users_ok"),
                        near("median", 0.5).alias("median_ok"), near("ninety", 0.9).alias("ninety_ok"))


@query("cube_lattice", """
SELECT l_returnflag, l_linestatus, CAST(year(l_shipdate) AS INTEGER) AS year, CAST(grouping_id(l_returnflag, l_linestatus, year(l_shipdate)) AS BIGINT)
  AS grouping_id, count(*) AS n, CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS DOUBLE) AS revenue, min(l_quantity) AS least,
  max(l_quantity) AS most FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus, year(l_shipdate))""")
def q_cube_lattice(spark, sf_dir):
    l = X.table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", F.year("l_shipdate").alias("year"), "l_quantity",
                                                  F.col("l_extendedprice").cast("decimal(18,2)").alias("price"))
    out = cube(l, ["l_returnflag", "l_linestatus", "year"], sums="price", least="l_quantity", most="l_quantity")
    return out.select("l_returnflag", "l_linestatus", "year", "grouping_id", "n", F.col("sum_price").cast("double").alias("revenue"),
                      F.col("min_l_quantity").alias("least"), F.col("max_l_quantity").alias("most"))


@query("tree_diff", """
WITH s AS (SELECT * FROM orders WHERE o_orderkey % 1511 <> 7),
d AS (SELECT * REPLACE (CASE WHEN o_orderkey % 1201 = 3 THEN -o_totalprice ELSE o_totalprice END AS o_totalprice) FROM orders
  WHERE o_orderkey % 907 <> 5)
SELECT coalesce(s.o_orderkey, d.o_orderkey) AS o_orderkey, CASE WHEN d.o_orderkey IS NULL THEN 'new' WHEN s.o_orderkey IS NULL THEN 'kept'
    ELSE 'changed' END AS status, s.o_totalprice AS src_o_totalprice, d.o_totalprice AS dst_o_totalprice,
  s.o_orderstatus AS src_o_orderstatus, d.o_orderstatus AS dst_o_orderstatus
FROM s FULL JOIN d ON s.o_orderkey = d.o_orderkey
WHERE s.o_totalprice IS DISTINCT FROM d.o_totalprice OR s.o_orderstatus IS DISTINCT FROM d.o_orderstatus""")
def q_tree_diff(spark, sf_dir):
    """Two snapshots of all orders that differ in a few rows."""
    o, k = X.table(spark, sf_dir, "orders"), F.col("o_orderkey")
    price = F.when(k % 1201 == 3, -F.col("o_totalprice")).otherwise(F.col("o_totalprice"))
    paths = [write_snapshot(df, scratch_path(spark, "snapshot"), "o_orderkey", ["o_totalprice", "o_orderstatus"])
             for df in (o.where(k % 1511 != 7), o.where(k % 907 != 5).withColumn("o_totalprice", price))]
    return tree_diff(spark, *paths)


@query("line_functions", r"""
WITH l AS (SELECT doc_id, CAST(generate_subscripts(string_split(text, chr(10)), 1) AS BIGINT) AS line_no,
    unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT lang, doc_id, count(*) AS n_lines, min(line_no) AS first_line,
  arg_min(nullif(regexp_extract(line, '^\s*(?:\S+\s+){1}(\S+)', 1), ''), line_no) AS second_word
FROM l JOIN documents USING (doc_id) WHERE regexp_matches(line, '[0-9]') AND NOT regexp_matches(line, '^#') GROUP BY ALL""")
def q_line_functions(spark, sf_dir):
    """A job written in SQL over a catalog table, with the line operators as functions of that catalog."""
    db = IO._database(spark, "lines")
    publish_table(X.table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), f"{db}.documents")
    register_line_functions(spark, db)
    session = spark.newSession()  # table functions are found by the current database
    session.catalog.setCurrentDatabase(db)
    return sql_job(session, """
        SELECT d.lang, d.doc_id, count(*) AS n_lines, min(g.line_no) AS first_line,
               min_by(word_field(g.line, 2), g.line_no) AS second_word
        FROM documents d, LATERAL grep_lines(d.text, :digits) g
        WHERE count_matching_lines(g.line, '^#') = 0 GROUP BY d.lang, d.doc_id""", args={"digits": "[0-9]"})


@query("settings_source", """
SELECT o_orderkey % 8 AS shard, o_custkey || '.' || o_orderkey AS key, o_orderstatus AS value FROM orders""")
def q_settings_source(spark, sf_dir):
    """Settings files read through the data source: a line for each order, comments between them."""
    o = X.table(spark, sf_dir, "orders")
    path = scratch_path(spark, "settings")
    line = F.concat("o_custkey", F.lit("."), "o_orderkey", F.lit(' = "'), "o_orderstatus", F.lit('"'))
    lines = F.explode(F.array(F.concat(F.lit("# "), "o_orderpriority", F.lit("=x")), line)).alias("value")
    o.select(lines, (F.col("o_orderkey") % 8).alias("shard")).write.partitionBy("shard").text(path)
    register_settings(spark)
    shard = F.regexp_extract("file", "shard=([0-9]+)", 1).cast("long")
    return spark.read.format("settings").load(path).select(shard.alias("shard"), "key", "value")
