"""Hand-written traps: fields, settings files, XML, ports and pids, collations, codecs, catalog rules."""

import os

import pytest
from pyspark.sql import functions as F

from basin.functions import field, lines
from basin.operators import dispositions as B
from basin.operators import fleet as E
from basin.operators import lines as C
from basin.operators import retention as R
from basin.operators import textsem as G
from basin.operators import topology as D
from basin.sources import catalog as A
from basin.sources.config import read_properties_files, read_property_xml
from basin.sources.files import check_codec, land_files


def one(spark, expr, schema="s string", value=None):
    df = spark.createDataFrame([(value,)], schema)
    return df.select(expr.alias("r")).first()["r"]


@pytest.mark.parametrize("text,expected", [
    ("", []), ("a", ["a"]), ("a\n", ["a"]), ("a\n\nb", ["a", "", "b"]), ("\n", [""]), ("a\nb\n\n", ["a", "b", ""]),
])
def test_lines_final_newline_ends_last_line(spark, text, expected):
    assert one(spark, lines("s"), value=text) == expected


@pytest.mark.parametrize("line,n,sep,expected", [
    ("", 2, None, ""), ("", -1, None, ""), ("  a   b  ", 1, None, "a"), ("  a   b  ", 2, None, "b"),
    ("  a   b  ", 3, None, ""), ("  a   b  ", -1, None, "b"), ("one", 2, None, ""), ("one", -1, None, "one"),
    ("a\tb", 2, None, "b"),
    ("1234/java", 1, "/", "1234"), ("a//b", 2, "/", ""), ("abc", 2, "/", "abc"), ("a/b", 3, "/", ""),
    ("x/y/z", -1, "/", "z"), ("a.b", 2, ".", "b"), ("", 1, ",", ""),
])
def test_field_traps(spark, line, n, sep, expected):
    assert one(spark, field("s", n, sep), value=line) == expected


def test_read_properties_file(spark, tmp):
    path = os.path.join(tmp, "conf")
    os.makedirs(path)
    with open(os.path.join(path, "site.conf"), "w") as f:
        f.write('# cluster settings\n\nHOSTS="h1,h2,h3"\n  # indented comment\nJAVA_OPTS=-Da=b -Dc=d\n'
                "NAME='x y'\nHOSTS=\"h9\"\nEMPTY=\nnot an assignment\n  PADDED =  v  \n")
    p = read_properties_files(spark, path)
    rows = [(r["line_no"], r["key"], r["value"]) for r in p.orderBy("line_no").collect()]
    assert rows == [(3, "HOSTS", "h1,h2,h3"), (5, "JAVA_OPTS", "-Da=b -Dc=d"), (6, "NAME", "x y"),
                    (7, "HOSTS", "h9"), (8, "EMPTY", ""), (10, "PADDED", "v")]
    last = {r["key"]: r["value"] for r in B.last_wins(p, ["file", "key"], "line_no").collect()}
    assert last["HOSTS"] == "h9"


def test_read_property_xml_trims_multiline_values(spark, tmp):
    path = os.path.join(tmp, "xml")
    os.makedirs(path)
    with open(os.path.join(path, "core-site.xml"), "w") as f:
        f.write("<?xml version=\"1.0\"?>\n<configuration>\n  <property>\n    <name> fs.defaultFS </name>\n"
                "    <value>\n      hdfs://nn:8020\n    </value>\n  </property>\n  <property>\n"
                "    <name>io.compression.codecs</name>\n    <value>a,b</value>\n    <description>x</description>\n"
                "  </property>\n  <property><name>n</name><value>3</value></property>\n</configuration>\n")
    rows = {r["name"]: r["value"] for r in read_property_xml(spark, path).collect()}
    assert rows == {"fs.defaultFS": "hdfs://nn:8020", "io.compression.codecs": "a,b", "n": "3"}


def test_service_health_ports_and_pids_by_equality(spark):
    procs = spark.createDataFrame([(1, 123, "HiveMetaStore"), (2, 1234, "hivemetastore"), (3, 55, "other")],
                                  "host long, pid long, name string")
    sockets = spark.createDataFrame([(1, 123, 9083), (2, 123, 9083), (2, 1234, 19083)],
                                    "host long, pid long, port int")
    out = {(r["host"], r["service"]): r["state"] for r in
           E.service_health(procs, sockets, [("metastore", "MetaStore", 9083)]).collect()}
    assert out == {(1, "metastore"): "running", (2, "metastore"): "no_listener", (3, "metastore"): "absent"}


def test_process_inventory_lists_empty_hosts(spark):
    hosts = spark.createDataFrame([(1,), (2,)], "host long")
    procs = spark.createDataFrame([(1, 5, "b"), (1, 6, "a"), (1, 7, "a")], "host long, pid long, name string")
    out = {r["host"]: (r["n_procs"], list(r["names"])) for r in E.process_inventory(hosts, procs).collect()}
    assert out == {1: (3, ["a", "b"]), 2: (0, [])}


def test_collation_traps(spark):
    df = spark.createDataFrame([("É",), ("é",), ("e",), ("E",), ("a ",), ("A",)], "s string")
    ci = {r["value"]: r["n"] for r in G.ci_group(df, "s", "ci").collect()}
    assert ci == {"É": 2, "E": 2, "A": 1, "a ": 1}
    ai = {r["value"]: r["n"] for r in G.ci_group(df, "s", "ci_ai").collect()}
    assert ai == {"E": 4, "A": 1, "a ": 1}
    general = {r["value"]: r["n"] for r in G.ci_group(df, "s", "utf8_general_ci").collect()}
    assert general == {"E": 4, "A": 2}
    lcase = {r["value"]: r["n"] for r in G.ci_group(df, "s", "lcase").collect()}
    assert lcase == {"É": 2, "E": 2, "A": 1, "a ": 1}


def test_collated_sort_is_total(spark):
    df = spark.createDataFrame([("b",), ("B",), ("a",), ("A",)], "s string")
    ranked = [r["s"] for r in G.collated_sort(df, "s", "lcase", rank="pos").orderBy("pos").collect()]
    assert ranked == ["A", "a", "B", "b"]


def test_ci_join_matches_case_insensitively(spark):
    a = spark.createDataFrame([(1, "Nation_1"), (2, "NATION_2")], "id long, n string")
    b = spark.createDataFrame([("nation_1", 10), ("nation_2", 20), ("nation_3", 30)], "m string, v long")
    out = sorted((r["id"], r["v"]) for r in G.ci_join(a, b, "n", "lcase", b_on="m").collect())
    assert out == [(1, 10), (2, 20)]


def test_length_guard(spark):
    df = spark.createDataFrame([("x" * 256, "ok"), ("y" * 257, "ok"), ("z", "w" * 4001)], "c string, p string")
    out = [(r["accepted"], r["reason"]) for r in G.length_guard(df, {"c": 256, "p": 4000}).collect()]
    assert out == [(True, None), (False, "c>256"), (False, "p>4000")]
    cut = G.length_guard(df, {"c": 256}, truncate=True).collect()
    assert max(len(r["c"]) for r in cut) == 256
    assert [r["reason"] for r in cut] == [None, "c>256 truncated", None] and all(r["accepted"] for r in cut)


def test_session_gap_tie_extends_session(spark):
    from basin.streaming.windows import window_metrics
    df = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:30:00"), (1, "2024-01-01 01:00:00.000001"),
                                (1, "2024-01-01 01:29:00")],
                               "u long, t string").select("u", F.col("t").cast("timestamp_ntz").alias("ts"))
    out = sorted(r["n"] for r in window_metrics(df, "ts", "u", "session", gap="30 minutes").collect())
    assert out == [2, 2]


def test_codec_matrix(spark, tmp, sf_dir):
    assert check_codec("json", "DefaultCodec") == "deflate"
    for fmt, codec in [("parquet", "deflate"), ("csv", "zstd"), ("text", "lzo"), ("parquet", "lzo")]:
        with pytest.raises(ValueError):
            check_codec(fmt, codec)
    with pytest.raises(ValueError):
        land_files(spark, f"{sf_dir}/region.parquet", os.path.join(tmp, "x"), "parquet", "lzop", src_fmt="parquet")
    out = land_files(spark, f"{sf_dir}/region.parquet", os.path.join(tmp, "r"), "json", "gzip", src_fmt="parquet")
    assert out.count() == 5
    assert any(n.endswith(".gz") for n in os.listdir(os.path.join(tmp, "r")))


def test_catalog_rules(spark, tmp):
    db = "basin_edges_db"
    assert A.ensure_database(spark, db, comment="données", location=os.path.join(tmp, "db")) is True
    assert A.ensure_database(spark, db) is False
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k long, p string")
    with pytest.raises(ValueError):
        A.publish_table(df, f"{db}.t0", comments={"k": "x" * 257})
    t = A.publish_table(df, f"{db}.t1", partition_by=["p"], comments={"k": "clé — 键", "p": "y" * 3000},
                        properties={"retention.seconds": "604800"}, table_comment="tableau")
    assert t.count() == 2
    desc = {r["col_name"]: r["comment"] for r in spark.sql(f"DESCRIBE TABLE {db}.t1").collect()}
    assert desc["k"] == "clé — 键"
    props = {r["key"]: r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES {db}.t1").collect()}
    assert props["retention.seconds"] == "604800"
    # overwrite replaces only the partitions present in the new data
    A.publish_table(spark.createDataFrame([(3, "a")], "k long, p string"), f"{db}.t1", partition_by=["p"])
    assert sorted((r["k"], r["p"]) for r in spark.table(f"{db}.t1").collect()) == [(2, "b"), (3, "a")]
    with pytest.raises(Exception):
        A.publish_table(spark.createDataFrame([(4, "q" * 300)], "k long, p string"), f"{db}.t1", partition_by=["p"])


def test_write_table_modes(spark, tmp):
    name = "default.basin_wt_edges"
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    df = spark.createDataFrame([(1,)], "k long")
    assert B.write_table(df, name, "skip_if_exists") == "created"
    assert B.write_table(df, name, "skip_if_exists") == "skipped"
    assert B.write_table(df, name, "append") == "appended"
    assert B.write_table(spark.table(name).union(df), name, "replace") == "replaced"
    assert spark.table(name).count() == 3


def test_line_edits_keep_final_newline_and_exact_keys(spark):
    df = spark.createDataFrame([(1, "log.dirs=/a\nlog.dirs.extra=/b\n#log.dirs=/c\n")], "id long, t string")
    out = C.set_property(df, "id", "t", "log.dirs", "/z").first()["t"]
    assert out == "log.dirs=/z\nlog.dirs.extra=/b\n#log.dirs=/c\n"
    out = C.set_property(df, "id", "t", "log.dirs", "/z", uncomment=True).first()["t"]
    assert out == "log.dirs=/z\nlog.dirs.extra=/b\nlog.dirs=/z\n"
    out = C.insert_before_marker(df, "id", "t", "^#", "# below").first()["t"]
    assert out == "log.dirs=/a\nlog.dirs.extra=/b\n# below\n#log.dirs=/c\n"


def test_sections_unpaired_and_kth(spark):
    text = "x\nBEGIN\na1\nEND\nBEGIN\na2\nEND\nBEGIN\na3"
    df = spark.createDataFrame([(1, text)], "id long, t string")
    spans = [(r["section_no"], r["begin"], r["end"]) for r in C.section_spans(df, "id", "t", "^BEGIN$", "^END$").collect()]
    assert spans == [(1, 2, 4), (2, 5, 7), (3, 8, None)]
    k2 = C.section_replace(df, "id", "t", C.MarkerSpan("^BEGIN$", "^END$", section=2), "a(\\d)", "b$1").first()["t"]
    assert k2 == "x\nBEGIN\na1\nEND\nBEGIN\nb2\nEND\nBEGIN\na3"
    open_end = C.section_replace(df, "id", "t", C.MarkerSpan("^BEGIN$", "^END$", section=3), "a", "A").first()["t"]
    assert open_end.endswith("BEGIN\nA3")
    first = C.section_replace(df, "id", "t", C.LineSpan(1), "([a-z])", "<$1>", first_only=True).first()["t"]
    assert first.split("\n")[:3] == ["<x>", "BEGIN", "<a>1"]


def test_retention(spark):
    df = spark.createDataFrame([(1, "2024-01-08 00:00:00"), (2, "2024-01-01 00:00:00"), (3, "2023-12-31 23:59:59")],
                               "id long, t string").select("id", F.col("t").cast("timestamp_ntz").alias("ts"))
    assert sorted(r["id"] for r in R.retain_by_age(df, "ts").collect()) == [1, 2]
    assert sorted(r["id"] for r in R.retain_by_age(df, "ts", 86400, as_of="2024-01-01 12:00:00").collect()) == [1, 2, 3]
    g = df.withColumn("g", F.lit(1))
    assert [r["id"] for r in R.retain_latest(g, "g", "ts", 2).orderBy("id").collect()] == [1, 2]


def test_assign_ids_dense_under_a_hot_group(spark):
    rows = [(0, i) for i in range(5000)] + [(g, g * 10) for g in range(1, 50)]
    df = spark.createDataFrame(rows, "g long, k long").repartition(16)
    out = D.assign_ids(df, "g", "k", base=1)
    hot = [r["id"] for r in out.where("g = 0").orderBy("k").collect()]
    assert hot == list(range(1, 5001))
    assert out.where("g > 0").agg(F.max("id")).first()[0] == 1


def test_ties_of_a_hot_name_spread_over_slices(spark):
    from basin.operators.ordering import _sliced
    rows = [("hot", i, {"m": i}) for i in range(3000)] + [(f"n{i}", i, None) for i in range(200)] + [("hot", 1, None)] * 3
    df = spark.createDataFrame(rows, "name string, `a.b` long, m map<string, int>").repartition(8)
    for slices in (1, 64):
        got = [(r["name"], r["pos"]) for r in G.collated_sort(df, "name", rank="pos", slices=slices).orderBy("pos").collect()]
        assert [p for _, p in got] == list(range(1, 3204)) and [n for n, _ in got] == sorted(r[0] for r in rows)
    ids = D.assign_ids(df, "name", F.lit(0), slices=64).where("name = 'hot'")
    assert sorted(r["id"] for r in ids.collect()) == list(range(1, 3004))
    # the rows of the hot name lie in many slices, none of which holds a tenth of them
    tagged = _sliced(df, [], ["name"], 64)[0].where("name = 'hot'").groupBy("__slice").count()
    assert tagged.count() > 30 and tagged.agg(F.max("count")).first()[0] < 300


def test_assign_roles_list_and_table(spark):
    items = D.explode_list(spark.createDataFrame([("c", "h1,h2,h3,")], "owner string, list string"), "list")
    assert [r["item"] for r in items.orderBy("ordinal").collect()] == ["h1", "h2", "h3"]
    roles = {r["item"]: r["role"] for r in D.assign_roles(items, ["nn", "rm"]).collect()}
    assert roles == {"h1": "nn", "h2": "rm", "h3": None}
    rt = spark.createDataFrame([(0, "nn")], "ordinal long, role string")
    roles = {r["item"]: r["role"] for r in D.assign_roles(items, rt).collect()}
    assert roles == {"h1": "nn", "h2": None, "h3": None}
    inner = D.explode_list(spark.createDataFrame([("c", "a,,b")], "owner string, list string"), "list")
    assert inner.count() == 3


def test_missing_prerequisites_division(spark):
    req = spark.createDataFrame([(1, "jdk"), (1, "mysql"), (2, "jdk")], "item long, needs string")
    have = spark.createDataFrame([(1, "jdk"), (2, "jdk"), (2, "extra")], "item long, needs string")
    out = {r["item"]: (r["n_missing"], list(r["missing"]), r["ready"])
           for r in D.missing_prerequisites(req, have).collect()}
    assert out == {1: (1, ["mysql"], False), 2: (0, [], True)}


def test_local_date_shanghai(spark):
    from basin.functions import local_date
    assert str(one(spark, local_date(F.col("s").cast("timestamp_ntz"), "Asia/Shanghai"),
                   value="2024-01-01 16:30:00")) == "2024-01-02"


@pytest.mark.parametrize("fmt", ["text", "csv", "json", "parquet", "orc"])
def test_every_accepted_codec_round_trips(spark, tmp, sf_dir, fmt):
    from basin.sources.files import CODECS
    src = spark.read.parquet(f"{sf_dir}/nation.parquet")
    if fmt == "text":
        src = src.select(F.concat_ws("|", "n_nationkey", "n_name").alias("value"))
    for codec in CODECS[fmt]:
        out = os.path.join(tmp, f"{fmt}-{codec}")
        from basin.sources.files import write_df
        write_df(src, out, fmt, codec)
        reader = spark.read.format(fmt)
        back = reader.schema(src.schema).load(out) if fmt in ("csv", "json", "text") else reader.load(out)
        assert back.count() == src.count(), (fmt, codec)


def test_sql_job_binds_parameters_and_publishes(spark, tmp, sf_dir):
    from basin.plans.jobs import sql_job
    db = "basin_sqljob_db"
    A.ensure_database(spark, db, location=os.path.join(tmp, "db"))
    views = {"nation": spark.read.parquet(f"{sf_dir}/nation.parquet")}
    t = sql_job(spark, "SELECT n_regionkey, count(*) AS n FROM nation WHERE n_name <> :skip GROUP BY n_regionkey",
                args={"skip": "NATION_0' OR '1'='1"}, target=f"{db}.per_region", views=views,
                partition_by=["n_regionkey"], comments={"n": "nations per region"})
    assert sorted((r["n_regionkey"], r["n"]) for r in t.collect()) == [(i, 5) for i in range(5)]


def test_jdbc_argument_checks(spark):
    from basin.sources.jdbc import export_jdbc, import_incremental, import_jdbc
    with pytest.raises(ValueError):
        import_jdbc(spark, "jdbc:none://x", "t", column="id", parts=4)  # bounds missing
    with pytest.raises(ValueError):
        export_jdbc(spark.range(1), "jdbc:none://x", "t", mode="upsert")
    df = spark.range(5).withColumnRenamed("id", "k")
    with pytest.raises(ValueError):
        import_incremental(df, df, "lastmodified", "k")  # key missing
    inc = import_incremental(df, df.where("k <= 2"), "append", "k", last=2)
    assert sorted(r["k"] for r in inc.table.collect()) == [0, 1, 2, 3, 4]
    assert inc.watermark.first()["watermark"] == 4
    none_new = import_incremental(df, df, "append", "k", last=10)
    assert none_new.rows.count() == 0 and none_new.watermark.first()["watermark"] == 10


@pytest.mark.parametrize("line,pattern,repl,expected", [
    ("aXbXc", "X", "-", "a-bXc"), ("abc", "z", "-", "abc"), ("key=1 key=2", "(\\w+)=(\\d)", "$2:$1", "1:key key=2"),
    ("#x #y", "^#", "", "x #y"), ("bbb", "a*", "<>", "<>bbb"), ("a$b", "\\$", "\\$\\$", "a$$b"),
    ("tab\there", "\\s", "_", "tab_here"), ("xay", "(?<=x)a", "A", "xAy"),
])
def test_replace_first(spark, line, pattern, repl, expected):
    assert one(spark, C.replace_first(F.col("s"), pattern, repl), value=line) == expected


def test_service_health_lists_given_hosts(spark):
    procs = spark.createDataFrame([(1, 7, "kafka.Kafka")], "host long, pid long, name string")
    sockets = spark.createDataFrame([(1, 7, 9092)], "host long, pid long, port int")
    hosts = spark.createDataFrame([(1,), (2,)], "host long")
    out = {(r["host"], r["service"]): r["state"] for r in
           E.service_health(procs, sockets, [("kafka", "kafka", 9092), ("zk", "QuorumPeer", 2181)], hosts).collect()}
    assert out == {(1, "kafka"): "running", (1, "zk"): "absent", (2, "kafka"): "absent", (2, "zk"): "absent"}


def test_event_log_written_by_spark_itself(tmp):
    """A log with Spark's default settings (rolled, zstd), written by another application."""
    import subprocess
    import sys
    code = f"""
from pyspark.sql import SparkSession
s = (SparkSession.builder.master("local[1]").appName("logged").config("spark.ui.enabled", "false")
     .config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", "file:{tmp}/log").getOrCreate())
s.range(100).repartition(3).count()
s.stop()"""
    os.makedirs(f"{tmp}/log")
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120, capture_output=True)
    assert any(f.endswith(".zstd") for _, _, files in os.walk(f"{tmp}/log") for f in files)


def test_event_log_of_default_settings_is_read(spark, tmp):
    from basin.sources.eventlog import read_event_log, run_summary
    test_event_log_written_by_spark_itself(tmp)
    events = read_event_log(spark, f"{tmp}/log")
    got = run_summary(events).collect()
    assert len(got) == 1 and got[0].app.startswith("local-") and got[0].n_unreadable == 0
    assert got[0].n_jobs >= 1 and got[0].n_tasks >= 4 and got[0].n_failed_tasks == 0 and got[0].wall_ms > 0


def test_event_log_counts_unreadable_lines_and_refuses_unknown_compression(spark, tmp):
    import gzip

    from basin.sources.eventlog import read_event_log, run_summary
    os.makedirs(f"{tmp}/log/eventlog_v2_local-2")
    start = '{"Event":"SparkListenerApplicationStart","Timestamp":5}'
    job = '{"Event":"SparkListenerJobEnd","Job ID":1,"Completion Time":9,"Job Result":{"Result":"JobFailed"}}'
    with open(f"{tmp}/log/local-1", "w") as f:
        f.write(f"{start}\n{job}\n{{broken\n\n")
    with gzip.open(f"{tmp}/log/eventlog_v2_local-2/events_1_local-2.gz", "wt") as f:
        f.write(f"{start}\n")
    open(f"{tmp}/log/eventlog_v2_local-2/appstatus_local-2", "w").close()
    got = {r.app: r for r in run_summary(read_event_log(spark, f"{tmp}/log")).collect()}
    assert set(got) == {"local-1", "local-2"} and got["local-1"].n_unreadable == 1 and got["local-1"].n_failed_jobs == 1
    with open(f"{tmp}/log/local-3.lz4", "w") as f:
        f.write("packed")
    with pytest.raises(ValueError, match="unsupported compression"):
        read_event_log(spark, f"{tmp}/log")


def test_event_log_fixture_is_packed_and_not_shuffled(spark, tmp):
    from datetime import datetime

    from basin.plans.io_queries import event_log
    d = datetime(1995, 1, 2)
    spark.createDataFrame([(1, d, "F"), (17, d, "P"), (2, d, "O")], "o_orderkey long, o_orderdate timestamp_ntz, o_orderstatus string") \
        .coalesce(1).write.parquet(f"{tmp}/orders.parquet")
    spark.createDataFrame([(1, n, 3, 4, 5.0, 6.5, "R", d) for n in range(3)], (
        "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, "
        "l_returnflag string, l_shipdate timestamp_ntz")).coalesce(1).write.parquet(f"{tmp}/lineitem.parquet")
    path = event_log(spark, tmp).removeprefix("file:")
    parts = [(os.path.basename(at), f) for at, _, files in os.walk(path) for f in files if f.startswith("part-")]
    assert {at for at, _ in parts} == {"app=app-1", "app=app-2"} and all(f.endswith(".gz") for _, f in parts)
    assert len({f for at, f in parts if at == "app=app-1"}) >= 4  # jobs, tasks, ends and broken lines: each where it was read


def test_event_log_paths_are_read_without_patterns_on_every_line(spark, tmp):
    from basin.sources.eventlog import read_event_log
    job = '{"Event":"SparkListenerJobEnd","Job ID":1}\n'
    places = {"local-1": "local-1", "local-2.inprogress": "local-2", "app=x/y": "x", "app=/z": "z", "eventlog_v2_r/events_1_r": "r",
              "eventlog_v2_/s.inprogress": "s", "eventlog_v2_q/app=p/o": "p"}
    for place in places:
        os.makedirs(os.path.dirname(f"{tmp}/log/{place}"), exist_ok=True)
        with open(f"{tmp}/log/{place}", "w") as f:
            f.write(job)
    events = read_event_log(spark, f"{tmp}/log")
    assert sorted(r.app for r in events.collect()) == sorted(places.values())
    plan = events._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract(") == 1  # the suffixes of a single file's name


def test_landing_round_trips_without_options(spark, tmp):
    from datetime import datetime
    rows = [(1, "a\nb\n", datetime(2020, 1, 2, 3, 4, 5, 678901)), (2, 'q"u,o\\te', None), (3, "", None), (4, None, None), (5, " x ", None)]
    df = spark.createDataFrame(rows, "id long, s string, t timestamp_ntz")
    df.write.parquet(f"{tmp}/src")
    for fmt in ("csv", "json"):
        back = land_files(spark, f"{tmp}/src", f"{tmp}/{fmt}", fmt, "gzip", src_fmt="parquet")
        assert sorted(map(tuple, back.collect())) == sorted(rows), fmt
    spark.createDataFrame([([1],)], "a array<int>").write.parquet(f"{tmp}/arr")
    with pytest.raises(ValueError, match="cannot hold"):
        land_files(spark, f"{tmp}/arr", f"{tmp}/x", "csv", "gzip", src_fmt="parquet")


def test_replace_keeps_the_table_definition(spark):
    import uuid
    name = f"basin_replace_{uuid.uuid4().hex[:8]}"
    spark.sql(f"CREATE TABLE {name} (a INT COMMENT 'first', b STRING, p INT) USING parquet PARTITIONED BY (p) "
              "COMMENT 'kept' TBLPROPERTIES ('note' = 'me')")
    df = spark.createDataFrame([(1, 7, "x"), (2, 8, "y")], "a int, p int, b string")
    assert B.write_table(df, name, "append") == "appended"
    before = spark.sql(f"SHOW CREATE TABLE {name}").first()[0]
    assert B.write_table(df.where("a = 1"), name, "replace") == "replaced"
    assert B.write_table(spark.table(name), name, "replace") == "replaced"
    assert spark.sql(f"SHOW CREATE TABLE {name}").first()[0] == before
    assert [tuple(r) for r in spark.table(name).collect()] == [(1, "x", 7)]
    spark.sql(f"DROP TABLE {name}")


@pytest.mark.parametrize("line,expected", [("xaab bb", "xXb bb"), ("ab", "ab")])
def test_replace_first_with_a_reference_in_the_pattern(spark, line, expected):
    assert one(spark, C.replace_first(F.col("s"), r"([a-z])\1", "X"), value=line) == expected


def test_overlapping_sections_are_edited_once(spark):
    df = spark.createDataFrame([(1, "B\na\nB\na\nE\na\nE\na\n"), (2, "a\n"), (3, ""), (4, None)], "id long, t string")
    out = {r.id: r.t for r in C.section_replace(df, "id", "t", C.MarkerSpan("^B", "^E"), "a", "aa").collect()}
    assert out == {1: "B\naa\nB\naa\nE\naa\nE\na\n", 2: "a\n", 3: "", 4: None}
