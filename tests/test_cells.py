"""Sketches, cubes, snapshot trees and SQL line functions on small odd tables."""

import random
import re

import pytest
from pyspark.sql import functions as F

from basin.operators import sketches as S
from basin.operators.cubes import cube
from basin.operators.dispositions import sync_diff
from basin.operators.snapshottree import differing_ranges, tree_diff, write_snapshot
from basin.plans.line_functions import register_line_functions


def key(rows):
    return sorted(map(tuple, rows), key=repr)


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["x", "y", None]), rng.choice([1, 2, 3]), rng.randrange(5000),
             rng.choice([None, float("nan"), rng.gauss(0, 10), rng.gauss(0, 10)])) for _ in range(20_000)]
    return spark.createDataFrame(rows, "a string, b int, user long, v double").repartition(7).cache()


def test_merged_sketches_are_within_their_bounds_and_reread_no_rows(spark, data, tmp):
    S.sketch(data, ["a", "b"], "user", "v").write.parquet(f"{tmp}/cells")
    cells = spark.read.parquet(f"{tmp}/cells")
    for by in (["a"], ["b"], []):
        merged = S.merge(cells, by).select(*by, "n", S.distinct_estimate().alias("d"), S.quantile(0.25).alias("q"))
        exact = {tuple(r[c] for c in by): r for r in data.groupBy(*by).agg(
            F.count("*").alias("n"), F.count_distinct("user").alias("d"), F.sort_array(F.collect_list(
                F.when(~F.isnan("v"), F.col("v")))).alias("v")).collect()}
        for r in merged.collect():
            want = exact[tuple(r[c] for c in by)]
            assert r.n == want.n and abs(r.d - want.d) <= S.DISTINCT_ERROR * want.d
            below, upto = sum(x < r.q for x in want.v) / len(want.v), sum(x <= r.q for x in want.v) / len(want.v)
            assert below - S.RANK_ERROR <= 0.25 <= upto + S.RANK_ERROR
    plan = S.merge(cells, "a")._jdf.queryExecution().executedPlan().toString()
    assert "partial_hll_union_agg" in plan and "partial_kll_merge_agg" in plan
    direct = {r.a: r.d for r in S.sketch(data, "a", "user").select("a", S.distinct_estimate().alias("d")).collect()}
    for r in S.merge(cells, "a").select("a", S.distinct_estimate().alias("d")).collect():
        assert abs(r.d - direct[r.a]) <= S.DISTINCT_ERROR * direct[r.a]


def test_sketches_of_nothing(spark, data):
    nothing = data.selectExpr("a", "CAST(NULL AS BIGINT) AS u", "CAST(NULL AS DOUBLE) AS v")
    got = S.merge(S.sketch(nothing, "a", "u", "v")).select(S.distinct_estimate().alias("d"), S.quantile(0.5).alias("q"), "n").first()
    assert (got.d, got.q, got.n) == (0, None, 20_000)
    assert S.sketch(data.filter("false"), "a", "user", "v").count() == 0


def test_cube_equals_group_by_cube_with_one_scan(spark, data, tmp):
    data.write.parquet(f"{tmp}/t")
    t = spark.read.parquet(f"{tmp}/t").withColumn("w", F.col("user").cast("decimal(18,2)"))
    got = cube(t, ["a", "b"], sums="w", least="user", most="user", distinct="user")
    want = t.cube("a", "b").agg(F.grouping_id().alias("g"), F.count("*").alias("n"), F.sum("w").alias("s"), F.min("user").alias("lo"),
                                F.max("user").alias("hi"), F.count_distinct("user").alias("d"))
    assert key(got.select("a", "b", "grouping_id", "n", "sum_w", "min_user", "max_user").collect()) == key(want.drop("d").collect())
    estimates = {(r.a, r.b, r.grouping_id): r.d for r in got.select("a", "b", "grouping_id", S.distinct_estimate().alias("d")).collect()}
    assert all(abs(estimates[r.a, r.b, r.g] - r.d) <= S.DISTINCT_ERROR * r.d for r in want.collect())
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert f"{tmp}/t" not in plan  # the rows were read once, for the finest grouping
    assert key(cube(t.filter("false"), ["a", "b"], sums="w").collect()) == key(
        t.filter("false").groupBy().agg(F.count("*").alias("n")).selectExpr("CAST(NULL AS STRING) a", "CAST(NULL AS INT) b",
                                                                         "3L AS g", "n", "CAST(NULL AS DECIMAL(28,2)) s").collect())


def pairs(spark, change):
    rng = random.Random(change)
    base = [(i, f"k{i % 7}", rng.random(), rng.choice(["u", None])) for i in range(5000)] + [(None, "n", 1.0, "u"), (None, None, 2.0, None)]
    other = [r for i, r in enumerate(base) if rng.random() >= change]
    other = [(*r[:2], r[2] + (rng.random() < change), r[3] if rng.random() >= change else "w") for r in other]
    other += [(10_000 + i, "new", 0.0, None) for i in range(round(change * 1000))]
    schema = "k long, j string, v double, w string"
    return spark.createDataFrame(base, schema), spark.createDataFrame(other, schema)


@pytest.mark.parametrize("change", [0.0, 0.001, 0.3])
def test_tree_diff_equals_the_full_comparison(spark, tmp, change):
    src, dst = pairs(spark, change)
    paths = [write_snapshot(df, f"{tmp}/{n}", ["k", "j"], tops=16, leaves=64) for n, df in (("s", src), ("d", dst))]
    got = tree_diff(spark, *paths)
    flag = lambda df: df.select(F.coalesce("k", F.lit(-1)).alias("k"), F.coalesce("j", F.lit("?")).alias("j"), "v", "w")
    want = sync_diff(flag(src), flag(dst), ["k", "j"], ["v", "w"]).where("status <> 'same'")
    named = got.select(F.coalesce("k", F.lit(-1)).alias("k"), F.coalesce("j", F.lit("?")).alias("j"), *got.columns[2:])
    assert got.columns == ["k", "j", "status", "src_v", "src_w", "dst_v", "dst_w"] and key(named.collect()) == key(want.collect())
    ranges = differing_ranges(spark, *paths).count()
    assert ranges <= max(want.count(), 0) and (change or ranges == 0)


def test_only_partitions_that_differ_are_read(spark, tmp):
    src = spark.range(4000).selectExpr("id AS k", "id * 2 AS v")
    dst = src.withColumn("v", F.expr("IF(k = 77, -1, v)"))
    paths = [write_snapshot(df, f"{tmp}/{n}", "k", tops=16, leaves=64) for n, df in (("s", src), ("d", dst))]
    got = tree_diff(spark, *paths)
    assert key(got.collect()) == [(77, "changed", 154, -1)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    plan = plan[plan.index("Final Plan"):].split("Initial Plan")[0]
    scans = [line for line in plan.splitlines() if "FileScan" in line and "ReadSchema: struct<k:" in line]
    assert len(scans) == 2 and all(re.search(r"PartitionFilters: \[.*basin_top#\d+ = \d+\)\]", line) for line in scans)


def test_snapshots_of_other_shape_do_not_compare(spark, tmp):
    df = spark.range(10).selectExpr("id AS k", "id AS v")
    a, b = write_snapshot(df, f"{tmp}/a", "k", tops=4), write_snapshot(df, f"{tmp}/b", "k", tops=8)
    with pytest.raises(ValueError, match="do not compare"):
        tree_diff(spark, a, b)
    empty = write_snapshot(df.filter("false"), f"{tmp}/e", "k", tops=4)
    assert tree_diff(spark, a, empty).count() == 10 and tree_diff(spark, empty, empty).count() == 0


def test_line_functions_of_a_session(spark):
    own = spark.newSession()
    assert set(register_line_functions(own)) >= {"grep_lines", "set_property"}
    one = lambda q: [tuple(r) for r in own.sql(q).collect()]
    assert one(r"SELECT * FROM lines_of('a\n\nb')") == [(1, "a"), (2, ""), (3, "b")]
    assert one("SELECT * FROM lines_of(NULL)") == []
    assert one(r"SELECT t.id, g.* FROM VALUES (1, 'a x\nb\nax'), (2, NULL) t(id, body), LATERAL grep_lines(t.body, '^a') g ORDER BY 2") == [
        (1, 1, "a x"), (1, 3, "ax")]
    assert one(r"SELECT line FROM grep_lines('a\nb', 'a', true)") == [("b",)]
    assert one(r"SELECT count_matching_lines('a\nb\na', 'a'), count_matching_lines(NULL, 'a'), word_field('  a b  c', 3), word_field('a', 2)") == [
        (2, 0, "c", None)]
    assert one("SELECT delimited_field('a|b|', '|', 3), delimited_field('a.b', '.', 2), delimited_field('a', '|', 2)") == [("", "b", None)]
    assert one(r"""SELECT * FROM settings_of('a=1\n#b=2\n c = "x y"\nz\n=5\nd=')""") == [(1, "a", "1"), (3, "c", "x y"), (6, "d", "")]
    assert one(r"SELECT set_property('a=1\nb = 2\n#b=3\nbb=4', 'b', '9'), set_property(NULL, 'b', '9')") == [("a=1\nb=9\n#b=3\nbb=4", None)]
    plan = own.sql("SELECT count_matching_lines(t, 'a') FROM VALUES ('x') v(t)")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
