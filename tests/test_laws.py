"""Algebraic laws of the write dispositions and line operators."""

from pyspark.sql import functions as F

from basin.operators import dispositions as B
from basin.operators import lines as C
from basin.operators import topology as D
from basin.plans import fixtures as X


def same_rows(a, b):
    return sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_sync_apply_idempotent(spark, sf_dir):
    src, dst = X.snapshot_pair(spark, sf_dir)
    once = B.sync_apply(src, dst, "k")
    twice = B.sync_apply(src, once, "k")
    assert same_rows(once, twice)


def test_sync_diff_states_cover_both_sides(spark, sf_dir):
    src, dst = X.snapshot_pair(spark, sf_dir)
    d = {r["status"]: r["count"] for r in B.sync_diff(src, dst, "k", ["v"]).groupBy("status").count().collect()}
    assert d["new"] + d["changed"] + d["same"] == src.count()
    assert d["kept"] + d["changed"] + d["same"] == dst.count()


def test_insert_if_absent_idempotent_and_never_changes(spark, sf_dir):
    src, dst = X.snapshot_pair(spark, sf_dir)
    batch = src.withColumn("v", F.lit(-5.0)).withColumn("ord", F.lit(1))
    once = B.insert_if_absent(dst, batch, "k", "ord")
    twice = B.insert_if_absent(once, batch, "k", "ord")
    assert same_rows(once, twice)
    kept = once.join(dst, "k", "left_semi")
    assert same_rows(kept, dst)


def test_insert_batch_once_all_or_nothing(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    # half-written batch: the sentinel (3) made it in, key 4 did not; it is not repaired
    half = target.unionByName(spark.createDataFrame([(3, "c")], "k long, v string"))
    batch = spark.createDataFrame([(3, "c"), (4, "d")], "k long, v string")
    assert same_rows(B.insert_batch_once(half, batch, {"k": 3}), half)
    assert B.insert_batch_once(target, batch, {"k": 3}).count() == 4


def test_update_matching_keeps_count_and_honours_null(spark):
    target = spark.createDataFrame([(1, 10.0), (2, 20.0), (3, 30.0)], "k long, v double")
    batch = spark.createDataFrame([(2, None, 1), (3, 33.0, 1), (3, 34.0, 2), (9, 99.0, 1)], "k long, v double, o int")
    out = {r["k"]: r["v"] for r in B.update_matching(target, batch, "k", ["v"], order="o").collect()}
    assert out == {1: 10.0, 2: None, 3: 34.0}


def test_explode_then_join_is_identity(spark, sf_dir):
    nl = X.node_list(spark, sf_dir)
    items = D.explode_list(nl, "list", ",")
    back = D.join_list(items, "owner", "ordinal", "item", sep=",")
    assert same_rows(back.select("owner", "list"), nl.select("owner", "list"))


def test_count_equals_grep_rows(spark, sf_dir):
    d = X.table(spark, sf_dir, "documents")
    counts = C.count_matching_lines(d, "doc_id", "text", "the").where("n_lines > 0")
    g = C.grep_lines(d, "doc_id", "text", "the").groupBy("doc_id").agg(F.count(F.lit(1)).cast("long").alias("n_lines"))
    assert same_rows(counts, g)


def test_last_wins_one_row_per_key(spark, sf_dir):
    o = X.table(spark, sf_dir, "orders")
    lw = B.last_wins(o, "o_custkey", ["o_orderdate", "o_orderkey"])
    assert lw.count() == o.select("o_custkey").distinct().count()


def test_sync_diff_compares_nulls_safely(spark):
    src = spark.createDataFrame([(1, None), (2, 1.0), (3, None)], "k long, v double")
    dst = spark.createDataFrame([(1, None), (2, None), (4, 4.0)], "k long, v double")
    out = {r["k"]: r["status"] for r in B.sync_diff(src, dst, "k", ["v"]).collect()}
    assert out == {1: "same", 2: "changed", 3: "new", 4: "kept"}


def test_last_wins_nulls_sort_lowest_and_ties_are_deterministic(spark):
    df = spark.createDataFrame([(1, None, "a"), (1, 1, "b"), (2, 5, "x"), (2, 5, "y"), (3, None, "z")],
                               "k long, o int, v string")
    out = {r["k"]: r["v"] for r in B.last_wins(df, "k", "o").collect()}
    assert out == {1: "b", 2: "y", 3: "z"}
    first = {r["k"]: r["v"] for r in B.first_wins(df, "k", "o").collect()}
    assert first == {1: "a", 2: "x", 3: "z"}


def test_insert_if_absent_null_keys_never_match(spark):
    target = spark.createDataFrame([(None, "t")], "k long, v string")
    batch = spark.createDataFrame([(None, "b", 1)], "k long, v string, o int")
    out = sorted((r["k"], r["v"]) for r in B.insert_if_absent(target, batch, "k", "o").collect())
    assert out == [(None, "b"), (None, "t")]


def test_grep_and_inverted_grep_partition_the_lines(spark, sf_dir):
    d = X.table(spark, sf_dir, "documents").where("doc_id < 200")
    hit = C.grep_lines(d, "doc_id", "text", "the", ignore_case=True)
    miss = C.grep_lines(d, "doc_id", "text", "the", ignore_case=True, invert=True)
    every = d.select("doc_id", F.inline(C.numbered_lines("text")))
    assert hit.join(miss, ["doc_id", "line_no"], "inner").count() == 0
    assert same_rows(hit.unionByName(miss), every)


def test_null_safe_keys_are_values(spark):
    table = spark.createDataFrame([(1, "a"), (None, "b")], "k int, v string")
    batch = spark.createDataFrame([(None, "new"), (2, "c")], "k int, v string")
    once = B.insert_if_absent(table, batch, "k", "v", null_safe=True)
    assert sorted(map(tuple, once.collect()), key=repr) == sorted([(1, "a"), (None, "b"), (2, "c")], key=repr)
    assert sorted(map(tuple, B.insert_if_absent(once, batch, "k", "v", null_safe=True).collect()), key=repr) == sorted(map(tuple, once.collect()), key=repr)
    synced = B.sync_apply(batch, table, "k", null_safe=True)
    assert sorted(map(tuple, synced.collect()), key=repr) == sorted([(None, "new"), (2, "c"), (1, "a")], key=repr)
    assert sorted(map(tuple, B.sync_apply(batch, synced, "k", null_safe=True).collect()), key=repr) == sorted(map(tuple, synced.collect()), key=repr)


def test_malformed_records_are_kept_apart_or_raise(spark):
    import pytest

    from basin.sources.topic import decode_records
    raw = spark.createDataFrame([("1", '{"a": 1}'), ("2", "{broken"), ("3", None), ("4", '{"a": "x"}')], "key string, value string")
    got = {r.key: (r.a, r.bad) for r in decode_records(raw, "a int", malformed="bad").collect()}
    assert got == {"1": (1, None), "2": (None, "{broken"), "3": (None, None), "4": (None, '{"a": "x"}')}
    with pytest.raises(Exception, match="not a record"):
        decode_records(raw, "a int").collect()
    assert decode_records(raw.filter("key IN ('1', '3')"), "a int").count() == 2
