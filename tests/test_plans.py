"""Plan shape: the properties that decide behaviour at scale, read from the physical plan."""

from pyspark.sql import functions as F

from basin.operators import dispositions as B
from basin.operators import lines as C
from basin.operators import retention as R
from basin.operators import topology as D
from basin.plans import fixtures as X


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_last_wins_combines_before_the_shuffle(spark, sf_dir):
    p = plan(B.last_wins(X.table(spark, sf_dir, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"]))
    assert "partial_max" in p


def test_retain_latest_limits_each_group_before_the_shuffle(spark, sf_dir):
    p = plan(R.retain_latest(X.table(spark, sf_dir, "events"), "user_id", "ts", 30))
    assert "WindowGroupLimit" in p and "Partial" in p


def test_line_operators_do_not_shuffle_and_prune_columns(spark, sf_dir):
    d = X.table(spark, sf_dir, "documents")
    for df in (C.count_matching_lines(d, "doc_id", "text", "the"),
               C.section_replace(d.select("doc_id", "text"), "doc_id", "text", C.MarkerSpan("^E", "[.]$"), "a", "b"),
               C.grep_lines(d, "doc_id", "text", "the")):
        p = plan(df)
        assert "Exchange" not in p
        assert "lang" not in p.split("ReadSchema:")[1].split("\n")[0]


def test_batch_guard_is_a_subquery_not_a_join(spark, sf_dir):
    src, dst = X.snapshot_pair(spark, sf_dir)
    p = plan(B.insert_batch_once(dst, src, {"k": 1}))
    assert "Join" not in p and "Subquery" in p


def test_dense_ids_do_not_window_whole_groups(spark, sf_dir):
    c = X.table(spark, sf_dir, "customer")
    p = plan(D.assign_ids(c, "c_nationkey", "c_custkey"))
    # rows are numbered within slices of a group, the counts of earlier slices are added; nothing is stored
    assert "ExistingRDD" not in p
    windows = [line for line in p.splitlines() if "Window [" in line]
    assert len(windows) == 2 and all("__slice" in w for w in windows)


def test_filters_reach_the_scan(spark, sf_dir):
    e = X.table(spark, sf_dir, "events").where(F.col("event_type") == "signup").select("user_id")
    p = plan(e)
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,signup)]" in p
