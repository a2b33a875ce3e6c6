"""Registered queries: each reads the driver tables under ``sf_dir`` (whole tables) and runs one
operator; ``ORACLE`` holds the same computation as DuckDB SQL over the same parquet files.

Computed columns carry the same names on both sides; floating sums are rounded to 2 decimals;
arrays are compared as joined strings; integer outputs are BIGINT.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basin.functions.text import field
from basin.functions.time import local_date
from basin.operators import dispositions as B
from basin.operators import fleet as E
from basin.operators import lines as C
from basin.operators import retention as R
from basin.operators import textsem as G
from basin.operators import topology as D
from basin.plans import fixtures as X
from basin.plans.jobs import sql_job
from basin.streaming.windows import window_metrics
from basin.streaming.dedup import dedup_stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return register


SNAP_SQL = """src AS (SELECT o_orderkey AS k, o_totalprice AS v FROM orders WHERE o_orderkey % 13 <> 0),
dst AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN 0.0 ELSE o_totalprice END AS v
        FROM orders WHERE o_orderkey % 10 <> 0 OR o_orderkey % 13 = 0)"""

# ---------------------------------------------------------------- B: write dispositions


@query("sync_diff", f"""
WITH {SNAP_SQL}
SELECT coalesce(src.k, dst.k) AS k,
       CASE WHEN dst.k IS NULL THEN 'new' WHEN src.k IS NULL THEN 'kept'
            WHEN src.v IS NOT DISTINCT FROM dst.v THEN 'same' ELSE 'changed' END AS status,
       src.v AS src_v, dst.v AS dst_v
FROM src FULL OUTER JOIN dst ON src.k = dst.k""")
def q_sync_diff(spark, sf_dir):
    src, dst = X.snapshot_pair(spark, sf_dir)
    return B.sync_diff(src, dst, "k", ["v"])


@query("sync_apply", f"""
WITH {SNAP_SQL}
SELECT k, v FROM src UNION ALL SELECT k, v FROM dst WHERE k NOT IN (SELECT k FROM src)""")
def q_sync_apply(spark, sf_dir):
    src, dst = X.snapshot_pair(spark, sf_dir)
    return B.sync_apply(src, dst, "k")


@query("insert_if_absent", f"""
WITH {SNAP_SQL},
batch AS (SELECT o_orderkey AS k, -1.0 AS v, 1 AS ord FROM orders WHERE o_orderkey % 4 = 0 OR o_orderkey % 10 = 0
          UNION ALL SELECT o_orderkey AS k, -2.0 AS v, 0 AS ord FROM orders WHERE o_orderkey % 4 = 0 OR o_orderkey % 10 = 0),
firsts AS (SELECT k, arg_min(v, ord) AS v FROM batch GROUP BY k)
SELECT k, v FROM dst UNION ALL SELECT k, v FROM firsts WHERE k NOT IN (SELECT k FROM dst)""")
def q_insert_if_absent(spark, sf_dir):
    _, dst = X.snapshot_pair(spark, sf_dir)
    o = X.table(spark, sf_dir, "orders").where((F.col("o_orderkey") % 4 == 0) | (F.col("o_orderkey") % 10 == 0))
    o = o.select(F.col("o_orderkey").alias("k"))
    batch = (o.select("k", F.lit(-1.0).alias("v"), F.lit(1).alias("ord"))
             .unionByName(o.select("k", F.lit(-2.0).alias("v"), F.lit(0).alias("ord"))))
    return B.insert_if_absent(dst, batch, "k", "ord")


def _batch_once(spark, sf_dir, sentinel):
    _, dst = X.snapshot_pair(spark, sf_dir)
    o = X.table(spark, sf_dir, "orders").where((F.col("o_orderkey") % 10 == 0) & (F.col("o_orderkey") % 13 != 0))
    batch = o.select(F.col("o_orderkey").alias("k"), F.lit(-1.0).alias("v"))
    return B.insert_batch_once(dst, batch, {"k": sentinel})


@query("insert_batch_once_skip", f"""
WITH {SNAP_SQL}
SELECT k, v FROM dst""")
def q_insert_batch_once_skip(spark, sf_dir):
    # sentinel key 1 is already in the target: the whole batch is skipped
    return _batch_once(spark, sf_dir, 1)


@query("insert_batch_once_apply", f"""
WITH {SNAP_SQL}
SELECT k, v FROM dst UNION ALL SELECT o_orderkey AS k, -1.0 AS v FROM orders WHERE o_orderkey % 10 = 0 AND o_orderkey % 13 <> 0""")
def q_insert_batch_once_apply(spark, sf_dir):
    # sentinel key 10 is not in the target: the whole batch goes in
    return _batch_once(spark, sf_dir, 10)


@query("update_matching", f"""
WITH {SNAP_SQL},
batch AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE -o_totalprice END AS v
          FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 10 = 0)
SELECT dst.k, CASE WHEN batch.k IS NOT NULL THEN batch.v ELSE dst.v END AS v
FROM dst LEFT JOIN batch ON dst.k = batch.k
UNION ALL SELECT k, v FROM batch WHERE k NOT IN (SELECT k FROM dst)""")
def q_update_matching(spark, sf_dir):
    _, dst = X.snapshot_pair(spark, sf_dir)
    o = X.table(spark, sf_dir, "orders").where((F.col("o_orderkey") % 3 == 0) | (F.col("o_orderkey") % 10 == 0))
    batch = o.select(F.col("o_orderkey").alias("k"),
                     F.when(F.col("o_orderkey") % 2 == 0, F.lit(None).cast("double"))
                     .otherwise(-F.col("o_totalprice")).alias("v"))
    rest = batch.join(dst.select("k"), "k", "left_anti")  # what the update ignores, so every order is accounted for
    return B.update_matching(dst, batch, "k", ["v"]).unionByName(rest)


@query("last_wins", """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn
  FROM orders) WHERE rn = 1""")
def q_last_wins(spark, sf_dir):
    return B.last_wins(X.table(spark, sf_dir, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"])


# ---------------------------------------------------------------- D: lists and topology


@query("explode_list", """
SELECT doc_id, CAST(generate_subscripts(l, 1) - 1 AS BIGINT) AS ordinal, unnest(l) AS item
FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)""")
def q_explode_list(spark, sf_dir):
    d = X.table(spark, sf_dir, "documents").select("doc_id", "text")
    return D.explode_list(d, "text", sep="\n")


# fixed values: positional roles of a node list (index 0 hosts the name node and metastore)
ROLES = ("namenode", "resourcemanager", "secondarynamenode", "scheduler")


@query("assign_roles", f"""
WITH {X.NODE_LIST_SQL},
items AS (SELECT owner, CAST(generate_subscripts(string_split(list, ','), 1) - 1 AS BIGINT) AS ordinal,
                 unnest(string_split(list, ',')) AS item FROM node_list)
SELECT owner, ordinal, item,
       (['namenode', 'resourcemanager', 'secondarynamenode', 'scheduler'])[ordinal + 1] AS role
FROM items""")
def q_assign_roles(spark, sf_dir):
    items = D.explode_list(X.node_list(spark, sf_dir), "list", sep=",")
    return D.assign_roles(items, list(ROLES))


@query("assign_ids", """
SELECT c_custkey, c_nationkey,
       CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS BIGINT) AS id
FROM customer""")
def q_assign_ids(spark, sf_dir):
    c = X.table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return D.assign_ids(c, "c_nationkey", "c_custkey", base=1)


@query("join_list", """
SELECT CAST(floor(c_custkey / 5) AS BIGINT) AS owner,
       string_agg(c_name || ':2181', ',' ORDER BY c_custkey) || '/kafka' AS list
FROM customer GROUP BY ALL""")
def q_join_list(spark, sf_dir):
    c = X.table(spark, sf_dir, "customer").withColumn("owner", F.floor(F.col("c_custkey") / 5).cast("bigint"))
    return D.join_list(c, "owner", "c_custkey", F.concat("c_name", F.lit(":2181")), sep=",", suffix="/kafka")


@query("missing_prerequisites", """
WITH req AS (SELECT c_custkey AS item, s.needs FROM customer, (VALUES ('F'), ('O'), ('P')) AS s(needs)),
have AS (SELECT DISTINCT o_custkey AS item, o_orderstatus AS needs FROM orders)
SELECT r.item, CAST(count(*) AS BIGINT) AS n_required,
       CAST(sum(CASE WHEN h.item IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_missing,
       coalesce(string_agg(CASE WHEN h.item IS NULL THEN r.needs END, ',' ORDER BY r.needs), '') AS missing,
       sum(CASE WHEN h.item IS NULL THEN 1 ELSE 0 END) = 0 AS ready
FROM req r LEFT JOIN have h ON r.item = h.item AND r.needs = h.needs
GROUP BY r.item""")
def q_missing_prerequisites(spark, sf_dir):
    req, have = X.requirements(spark, sf_dir)
    out = D.missing_prerequisites(req, have, "item", "needs")
    return out.withColumn("missing", F.array_join("missing", ","))


# ---------------------------------------------------------------- C: lines


@query("grep_lines", """
SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, line FROM (
  SELECT doc_id, generate_subscripts(l, 1) AS line_no, unnest(l) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))
WHERE regexp_matches(line, 'the', 'i') AND NOT regexp_matches(line, 'and', 'i')""")
def q_grep_lines(spark, sf_dir):
    d = X.table(spark, sf_dir, "documents")
    g = C.grep_lines(d, "doc_id", "text", "the", ignore_case=True)
    return g.where(~F.col("line").rlike("(?iu)and")).select("doc_id", F.col("line_no").cast("long"), "line")


@query("count_matching_lines", """
SELECT doc_id, CAST(len(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, 'the'))) AS BIGINT) AS n_lines
FROM documents""")
def q_count_matching_lines(spark, sf_dir):
    return C.count_matching_lines(X.table(spark, sf_dir, "documents"), "doc_id", "text", "the")


@query("field", """
WITH l AS (SELECT doc_id, CAST(generate_subscripts(ls, 1) AS BIGINT) AS line_no, unnest(ls) AS line
           FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
w AS (SELECT *, CASE WHEN trim(line) = '' THEN []::VARCHAR[] ELSE regexp_split_to_array(trim(line), '[ \\t]+') END AS ws
      FROM l)
SELECT doc_id, line_no, coalesce(ws[2], '') AS f2, coalesce(ws[-1], '') AS f_last,
       CASE WHEN strpos(line, ',') = 0 THEN line ELSE coalesce(string_split(line, ',')[2], '') END AS c2
FROM w""")
def q_field(spark, sf_dir):
    d = X.table(spark, sf_dir, "documents")
    rows = d.select("doc_id", F.inline(C.numbered_lines("text")))
    return rows.select("doc_id", F.col("line_no").cast("long"), field("line", 2).alias("f2"),
                       field("line", -1).alias("f_last"), field("line", 2, sep=",").alias("c2"))


SPANS_SQL = """l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
m AS (SELECT doc_id, ls,
             list_filter(range(1, len(ls) + 1), lambda i: regexp_matches(ls[i], '^E')) AS b,
             list_filter(range(1, len(ls) + 1), lambda i: regexp_matches(ls[i], '[.]$')) AS e FROM l)"""


@query("section_spans", f"""
WITH {SPANS_SQL}
SELECT doc_id, CAST(section_no AS BIGINT) AS section_no, CAST(b[section_no] AS BIGINT) AS "begin",
       CAST(e[section_no] AS BIGINT) AS "end"
FROM (SELECT doc_id, b, e, unnest(range(1, greatest(len(b), len(e)) + 1)) AS section_no FROM m)""")
def q_section_spans(spark, sf_dir):
    s = C.section_spans(X.table(spark, sf_dir, "documents"), "doc_id", "text", "^E", "[.]$")
    return s.select("doc_id", *[F.col(c).cast("long") for c in ("section_no", "begin", "end")])


@query("section_replace", """
SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda l, i:
         CASE WHEN i BETWEEN 2 AND 3 THEN regexp_replace(l, '([a-z]+)ion', '\\1ION', 'g') ELSE l END), chr(10)) AS text
FROM documents""")
def q_section_replace(spark, sf_dir):
    d = X.table(spark, sf_dir, "documents").select("doc_id", "text")
    return C.section_replace(d, "doc_id", "text", C.LineSpan(2, 3), "([a-z]+)ion", "$1ION")


@query("section_replace_marker", f"""
WITH {SPANS_SQL},
s AS (SELECT doc_id, ls, list_filter(list_zip(b, e), lambda p: p[1] IS NOT NULL) AS secs FROM m)
SELECT doc_id, array_to_string(list_transform(ls, lambda l, i:
         CASE WHEN len(list_filter(secs, lambda p: i >= p[1] AND i <= CASE WHEN p[2] IS NULL OR p[2] < p[1]
                                                                    THEN len(ls) ELSE p[2] END)) > 0
              THEN regexp_replace(l, '([a-z]+)s([ ,.])', '<\\1>\\2') ELSE l END), chr(10)) AS text
FROM s""")
def q_section_replace_marker(spark, sf_dir):
    d = X.table(spark, sf_dir, "documents").select("doc_id", "text")
    return C.section_replace(d, "doc_id", "text", C.MarkerSpan("^E", "[.]$"), "([a-z]+)s([ ,.])", "<$1>$2",
                             first_only=True)


@query("section_replace_second", f"""
WITH {SPANS_SQL},
s AS (SELECT doc_id, ls, list_filter(list_zip(b, e), lambda p: p[1] IS NOT NULL)[2] AS sec FROM m)
SELECT doc_id, array_to_string(list_transform(ls, lambda l, i:
         CASE WHEN i >= sec[1] AND i <= CASE WHEN sec[2] IS NULL OR sec[2] < sec[1] THEN len(ls) ELSE sec[2] END
              THEN regexp_replace(l, '([a-z]+)s([ ,.])', '<\\1>\\2', 'g') ELSE l END), chr(10)) AS text
FROM s""")
def q_section_replace_second(spark, sf_dir):
    d = X.table(spark, sf_dir, "documents").select("doc_id", "text")
    return C.section_replace(d, "doc_id", "text", C.MarkerSpan("^E", "[.]$", section=2), "([a-z]+)s([ ,.])", "<$1>$2")


@query("insert_before_marker", f"""
WITH {X.PROPERTY_TEXT_SQL}
SELECT owner, array_to_string(flatten(list_transform(string_split(text, chr(10)), lambda l:
         CASE WHEN regexp_matches(l, '^#') THEN ['# disabled below', l] ELSE [l] END)), chr(10)) AS text
FROM property_text""")
def q_insert_before_marker(spark, sf_dir):
    return C.insert_before_marker(X.property_text(spark, sf_dir), "owner", "text", "^#", "# disabled below")


@query("set_property", f"""
WITH {X.PROPERTY_TEXT_SQL}
SELECT owner, array_to_string(list_transform(string_split(text, chr(10)), lambda l:
         CASE WHEN regexp_matches(l, '^[ \\t]*#?[ \\t]*3-MEDIUM[ \\t]*=') THEN '3-MEDIUM=on' ELSE l END), chr(10)) AS text
FROM property_text""")
def q_set_property(spark, sf_dir):
    return C.set_property(X.property_text(spark, sf_dir), "owner", "text", "3-MEDIUM", "on", uncomment=True)


READ_PROPS_SQL = f"""{X.PROPERTY_TEXT_SQL},
l AS (SELECT owner, CAST(generate_subscripts(ls, 1) AS BIGINT) AS line_no, unnest(ls) AS line
      FROM (SELECT owner, string_split(text, chr(10)) AS ls FROM property_text)),
kv AS (SELECT owner, line_no, trim(substr(line, 1, strpos(line, '=') - 1)) AS key,
              trim(substr(line, strpos(line, '=') + 1)) AS raw
       FROM l WHERE NOT regexp_matches(line, '^[ \\t]*(#|$)') AND strpos(line, '=') > 0),
props AS (SELECT owner, line_no, key,
                 CASE WHEN length(raw) >= 2 AND ((raw LIKE '"%' AND raw LIKE '%"') OR (raw LIKE '''%' AND raw LIKE '%'''))
                      THEN substr(raw, 2, length(raw) - 2) ELSE raw END AS value FROM kv)"""


@query("read_properties", f"""
WITH {READ_PROPS_SQL}
SELECT owner, line_no, key, value FROM props""")
def q_read_properties(spark, sf_dir):
    from basin.sources.config import read_properties
    return read_properties(X.property_text(spark, sf_dir), "owner", "text")


@query("read_properties_last", f"""
WITH {READ_PROPS_SQL}
SELECT owner, key, arg_max(line_no, line_no) AS line_no, arg_max(value, line_no) AS value
FROM props GROUP BY owner, key""")
def q_read_properties_last(spark, sf_dir):
    from basin.sources.config import read_properties
    p = read_properties(X.property_text(spark, sf_dir), "owner", "text")
    return B.last_wins(p, ["owner", "key"], "line_no")


# ---------------------------------------------------------------- E: fleet

# fixed values: services watched in the fleet check (name, process-name pattern, port)
SERVICES = (("signup-svc", "SIGNUP", 9083), ("view-svc", "view", 9083),
            ("purchase-svc", "purchase", 19083), ("kafka", "kafka", 9092))


@query("service_health", """
WITH procs AS (SELECT user_id AS host, event_id % 500 AS pid, event_type AS name FROM events),
socks AS (SELECT DISTINCT user_id AS host, event_id % 500 AS pid, 9083 AS port FROM events WHERE event_type = 'signup'),
svc AS (SELECT * FROM (VALUES ('signup-svc', 'signup', 9083), ('view-svc', 'view', 9083),
                              ('purchase-svc', 'purchase', 19083), ('kafka', 'kafka', 9092)) AS t(service, pattern, port)),
hosts AS (SELECT DISTINCT host FROM procs),
m AS (SELECT p.host, s.service, bool_or(k.host IS NOT NULL) AS running
      FROM procs p JOIN svc s ON contains(lower(p.name), s.pattern)
      LEFT JOIN socks k ON k.host = p.host AND k.pid = p.pid AND k.port = s.port
      GROUP BY p.host, s.service)
SELECT h.host, s.service,
       CASE WHEN m.running THEN 'running' WHEN m.running IS NULL THEN 'absent' ELSE 'no_listener' END AS state
FROM hosts h CROSS JOIN svc s LEFT JOIN m ON m.host = h.host AND m.service = s.service""")
def q_service_health(spark, sf_dir):
    return E.service_health(X.processes(spark, sf_dir), X.sockets(spark, sf_dir), SERVICES)


@query("process_inventory", """
WITH procs AS (SELECT user_id AS host, event_type AS name FROM events),
per AS (SELECT host, count(*) AS n, string_agg(DISTINCT name, ',' ORDER BY name) AS names FROM procs GROUP BY host)
SELECT c_custkey AS host, CAST(coalesce(n, 0) AS BIGINT) AS n_procs, coalesce(names, '') AS names
FROM customer LEFT JOIN per ON per.host = c_custkey""")
def q_process_inventory(spark, sf_dir):
    hosts = X.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("host"))
    inv = E.process_inventory(hosts, X.processes(spark, sf_dir))
    return inv.withColumn("names", F.array_join("names", ","))


# ---------------------------------------------------------------- F: retention


@query("retain_by_age", """
SELECT * FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 604800 SECOND""")
def q_retain_by_age(spark, sf_dir):
    return R.retain_by_age(X.table(spark, sf_dir, "events"), "ts", 604800)


@query("retain_latest", """
SELECT event_id, ts, user_id, event_type, value, props FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events)
WHERE rn <= 30""")
def q_retain_latest(spark, sf_dir):
    return R.retain_latest(X.table(spark, sf_dir, "events"), "user_id", "ts", 30, tie="event_id")


# ---------------------------------------------------------------- G: text and time semantics

MIXED_SOURCE_SQL = """mixed AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN upper(source)
                                     WHEN doc_id % 3 = 1 THEN source ELSE 'Src' || substr(source, 4) END AS src
                 FROM documents)"""


def _mixed_source(spark, sf_dir):
    d = X.table(spark, sf_dir, "documents")
    src = (F.when(F.col("doc_id") % 3 == 0, F.upper("source"))
           .when(F.col("doc_id") % 3 == 1, F.col("source"))
           .otherwise(F.concat(F.lit("Src"), F.substring("source", 4, 1 << 20))))
    return d.select("doc_id", src.alias("src"))


@query("ci_group", f"""
WITH {MIXED_SOURCE_SQL}
SELECT min(src) AS value, count(*) AS n FROM mixed GROUP BY lower(src)""")
def q_ci_group(spark, sf_dir):
    return G.ci_group(_mixed_source(spark, sf_dir), "src", "lcase")


@query("ci_group_accents", """
WITH c AS (SELECT CASE c_custkey % 4 WHEN 0 THEN 'Nation_' WHEN 1 THEN 'NATIÓN_' WHEN 2 THEN 'nátion_'
                  ELSE 'nation_' END || CAST(c_nationkey AS VARCHAR) || CASE WHEN c_custkey % 5 = 0 THEN '  ' ELSE '' END
                  AS name FROM customer)
SELECT min(name) AS value, count(*) AS n FROM c GROUP BY lower(strip_accents(rtrim(name)))""")
def q_ci_group_accents(spark, sf_dir):
    # accent, case and trailing-blank variants of one name fall into one group under utf8_general_ci
    c = X.table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    stem = (F.when(k % 4 == 0, F.lit("Nation_")).when(k % 4 == 1, F.lit("NATIÓN_"))
            .when(k % 4 == 2, F.lit("nátion_")).otherwise(F.lit("nation_")))
    name = F.concat(stem, F.col("c_nationkey").cast("string"), F.when(k % 5 == 0, F.lit("  ")).otherwise(F.lit("")))
    return G.ci_group(c.select(name.alias("name")), "name", "utf8_general_ci")


@query("ci_join", """
WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN lower('NATION_' || c_nationkey)
                                  ELSE 'Nation_' || c_nationkey END AS nation_name FROM customer)
SELECT c.c_custkey, n.n_nationkey, n.n_name FROM c JOIN nation n ON lower(c.nation_name) = lower(n.n_name)""")
def q_ci_join(spark, sf_dir):
    c = X.table(spark, sf_dir, "customer")
    name = F.when(F.col("c_custkey") % 2 == 0, F.lower(F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string")))) \
        .otherwise(F.concat(F.lit("Nation_"), F.col("c_nationkey").cast("string")))
    c = c.select("c_custkey", name.alias("nation_name"))
    n = X.table(spark, sf_dir, "nation")
    return G.ci_join(c, n, "nation_name", "lcase", b_on="n_name").select("c_custkey", "n_nationkey", "n_name")


@query("ci_join_accents", """
WITH c AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'Nation_' WHEN 1 THEN 'NATIÓN_' WHEN 2 THEN 'nátion_'
                  ELSE 'nation_' END || CAST(c_nationkey AS VARCHAR) || CASE WHEN c_custkey % 5 = 0 THEN '  ' ELSE '' END
                  AS name FROM customer)
SELECT c.c_custkey, n.n_nationkey, n.n_name
FROM c JOIN nation n ON lower(strip_accents(rtrim(c.name))) = lower(strip_accents(rtrim(n.n_name)))""")
def q_ci_join_accents(spark, sf_dir):
    c = X.table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    stem = (F.when(k % 4 == 0, F.lit("Nation_")).when(k % 4 == 1, F.lit("NATIÓN_"))
            .when(k % 4 == 2, F.lit("nátion_")).otherwise(F.lit("nation_")))
    name = F.concat(stem, F.col("c_nationkey").cast("string"), F.when(k % 5 == 0, F.lit("  ")).otherwise(F.lit("")))
    n = X.table(spark, sf_dir, "nation")
    j = G.ci_join(c.select("c_custkey", name.alias("name")), n, "name", "utf8_general_ci", b_on="n_name")
    return j.select("c_custkey", "n_nationkey", "n_name")


@query("collated_sort", """
WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN upper(c_name) ELSE c_name END AS name FROM customer)
SELECT c_custkey, name, CAST(row_number() OVER (ORDER BY lower(name), name) AS BIGINT) AS pos FROM c""")
def q_collated_sort(spark, sf_dir):
    c = X.table(spark, sf_dir, "customer")
    c = c.select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.upper("c_name")).otherwise(F.col("c_name")).alias("name"))
    return G.collated_sort(c, "name", "lcase", rank="pos")


@query("length_guard", """
SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars,
       CASE WHEN length(text) > 4000 THEN 'text>4000' END AS reason, length(text) <= 4000 AS accepted
FROM documents""")
def q_length_guard(spark, sf_dir):
    d = X.table(spark, sf_dir, "documents").select("doc_id", "text")
    g = G.length_guard(d, {"text": 4000})
    return g.select("doc_id", F.char_length("text").cast("long").alias("n_chars"), "reason", "accepted")


@query("length_guard_cut", """
SELECT doc_id, substr(text, 1, 256) AS text FROM documents""")
def q_length_guard_cut(spark, sf_dir):
    d = X.table(spark, sf_dir, "documents").select("doc_id", "text")
    return G.length_guard(d, {"text": 256}, truncate=True).select("doc_id", "text")


@query("local_date", """
SELECT strftime(CAST(timezone('Asia/Shanghai', timezone('UTC', ts)) AS DATE), '%Y-%m-%d') AS day, count(*) AS n
FROM events GROUP BY 1""")
def q_local_date(spark, sf_dir):
    e = X.table(spark, sf_dir, "events")
    day = local_date("ts", "Asia/Shanghai")
    return e.groupBy(F.date_format(day, "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- H: SQL jobs

# Revenue is summed in exact decimals (prices and discounts have 2 decimals), so the result does not
# depend on the order in which tasks add partial sums; the types keep each product a DECIMAL(16,4),
# held in a long. The big input is aggregated once at the finest grouping and only that small result
# is rolled up: ROLLUP over the raw rows would copy every row once per grouping set first.
ROLLUP_SQL = """
WITH per_status AS (
  SELECT c_mktsegment, o_orderstatus,
         sum(CAST(l_extendedprice AS DECIMAL(18, 4)) * (1 - CAST(l_discount AS DECIMAL(10, 4)))) AS revenue,
         count(*) AS n_lines
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  WHERE l_quantity >= :min_qty
  GROUP BY c_mktsegment, o_orderstatus)
SELECT c_mktsegment, o_orderstatus, CAST(sum(revenue) AS DOUBLE) AS revenue, CAST(sum(n_lines) AS BIGINT) AS n_lines
FROM per_status
GROUP BY ROLLUP (c_mktsegment, o_orderstatus)"""


@query("sql_job", """
WITH sold AS (SELECT c_mktsegment AS s, o_orderstatus AS st,
    CAST(l_extendedprice AS DECIMAL(18, 4)) - CAST(l_extendedprice AS DECIMAL(18, 4)) * CAST(l_discount AS DECIMAL(10, 4)) AS r
  FROM lineitem, orders, customer WHERE l_orderkey = o_orderkey AND o_custkey = c_custkey AND l_quantity >= 1)
SELECT s AS c_mktsegment, st AS o_orderstatus, CAST(sum(r) AS DOUBLE) AS revenue, count(*) AS n_lines FROM sold GROUP BY s, st
UNION ALL SELECT s, NULL, CAST(sum(r) AS DOUBLE), count(*) FROM sold GROUP BY s
UNION ALL SELECT NULL, NULL, CAST(sum(r) AS DOUBLE), count(*) FROM sold""")
def q_sql_job(spark, sf_dir):
    views = {t: X.table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer")}
    return sql_job(spark, ROLLUP_SQL, args={"min_qty": 1}, views=views)


# ---------------------------------------------------------------- I: windows (batch form)


@query("window_tumbling", """
SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS window_start,
       time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end,
       count(*) AS n, round(sum(value), 2) AS total
FROM events GROUP BY 1, 2, 3""")
def q_window_tumbling(spark, sf_dir):
    w = window_metrics(X.table(spark, sf_dir, "events"), "ts", "event_type", "tumbling", size="1 hour", value="value")
    return w.withColumn("total", F.round("total", 2))


@query("window_sliding", """
WITH s AS (SELECT event_type, value, time_bucket(INTERVAL 15 MINUTE, ts) - k * INTERVAL 15 MINUTE AS window_start
           FROM events, range(0, 4) AS r(k))
SELECT event_type, window_start, window_start + INTERVAL 1 HOUR AS window_end,
       count(*) AS n, round(sum(value), 2) AS total
FROM s GROUP BY 1, 2, 3""")
def q_window_sliding(spark, sf_dir):
    w = window_metrics(X.table(spark, sf_dir, "events"), "ts", "event_type", "sliding", size="1 hour",
                       slide="15 minutes", value="value")
    return w.withColumn("total", F.round("total", 2))


@query("window_session", """
WITH g AS (SELECT user_id, ts, value,
                  CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL
                         OR ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 30 MINUTE
                       THEN 1 ELSE 0 END AS starts FROM events),
s AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g)
SELECT user_id, min(ts) AS window_start, max(ts) + INTERVAL 30 MINUTE AS window_end,
       count(*) AS n, round(sum(value), 2) AS total
FROM s GROUP BY user_id, sid""")
def q_window_session(spark, sf_dir):
    w = window_metrics(X.table(spark, sf_dir, "events"), "ts", "user_id", "session", gap="30 minutes", value="value")
    return w.withColumn("total", F.round("total", 2))


@query("dedup_stream", """
SELECT * FROM events""")
def q_dedup_stream(spark, sf_dir):
    e = X.table(spark, sf_dir, "events")
    repeated = e.where(F.col("event_type") == "error")
    return dedup_stream(e.unionByName(repeated), "ts", "event_id", "1 hour")
