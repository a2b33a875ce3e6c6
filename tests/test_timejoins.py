"""As-of and interval joins against plain loops, with ties, nulls, hot keys and the shape of the plan."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from basin.operators import timejoins
from basin.operators.timejoins import asof_join, interval_join

T0 = dt.datetime(2024, 1, 1)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def minutes(n):
    return None if n is None else T0 + dt.timedelta(minutes=n)


def sides(spark, seed, keys, n=400, times=60):
    rng = random.Random(seed)
    one = lambda i: (rng.choice(keys), minutes(rng.choice([None] + list(range(times)) * 3)), i)
    l, r = [one(i) for i in range(n)], [one(i) for i in range(n // 2)]
    schema = "k string, t timestamp, v long"
    return l, r, spark.createDataFrame(l, schema).repartition(4), spark.createDataFrame(r, schema).repartition(3)


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("tolerance", [None, 5])
def test_asof_equals_a_loop(spark, strict, tolerance):
    l, r, left, right = sides(spark, 1, ["a", "b", None, "c"])
    want = []
    for k, t, v in l:
        fit = [x for x in r if None not in (k, t, x[1]) and x[0] == k and (x[1] < t or x[1] == t and not strict)]
        best = max(fit, key=lambda x: (x[1], x[2]), default=None)
        if best and tolerance is not None and best[1] < t - dt.timedelta(minutes=tolerance):
            best = None
        want.append((k, t, v, *(best or (None,) * 3)))
    interval = None if tolerance is None else F.expr(f"INTERVAL {tolerance} MINUTES")
    for slices in (None, 1, 9, 40):
        assert rows(asof_join(left, right, "t", "t", "k", strict=strict, tolerance=interval, slices=slices)) == sorted(want, key=repr)


def test_asof_without_key_or_rows(spark):
    l, r, left, right = sides(spark, 2, ["a"], n=50)
    got = rows(asof_join(left, right, "t", "t", slices=6))
    assert got == rows(asof_join(left, right, "t", "t"))
    assert len(got) == 50 and sum(x[5] is not None for x in got) > 30
    assert rows(asof_join(left.filter("false"), right, "t", "t", "k")) == []
    assert all(x[3:] == (None,) * 3 for x in rows(asof_join(left, right.filter("false"), "t", "t", "k")))
    assert asof_join(left, right, "t", "t", "k").columns == ["k", "t", "v", "right_k", "right_t", "right_v"]


def test_asof_spreads_a_hot_key_and_uses_no_window_over_it(spark):
    left = spark.range(30_000).selectExpr("0 AS k", "timestamp_micros(id * 7) AS t", "id AS v")
    right = spark.range(3_000).selectExpr("0 AS k", "timestamp_micros(id * 70) AS t", "id AS w")
    out = asof_join(left, right, "t", "t", "k")
    assert out.where("right_w <> floor(v / 10)").count() == 0 and out.count() == 30_000
    plan = out._jdf.queryExecution().executedPlan().toString()
    window = [line for line in plan.splitlines() if "Window [last" in line and "__own" in line]
    assert window and all("[__slice#" in line for line in window) and "NestedLoop" not in plan
    both = left.select("k", "t").repartitionByRange(8, "k", "t")  # one key, dealt over the slices evenly
    sizes = [r["count"] for r in both.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 30_000 / 3
    assert rows(asof_join(left, right, "t", "t", "k", slices=8)) == rows(out)


def intervals(spark, seed, keys, n=250, top=300, length=20):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        b = rng.choice([None, float("nan")] + [float(rng.randrange(top))] * 20)
        out.append((rng.choice(keys), b, None if b is None else b + rng.choice([0, 0, 1, length, length * 9, -1, 0.5]), i))
    return out, spark.createDataFrame(out, "k string, b double, e double, v long").repartition(3)


def overlapping(l, r, key=True):
    ok = lambda x: x[1] is not None and x[2] is not None and x[1] <= x[2]
    return sorted([(*x, *y) for x in l for y in r if ok(x) and ok(y) and (not key or None not in (x[0], y[0]) and x[0] == y[0])
                   and x[1] <= y[2] and y[1] <= x[2]], key=repr)


@pytest.mark.parametrize("width", [None, 1.0, 7.5, 10_000.0])
@pytest.mark.parametrize("hot", [timejoins.HOT_ROWS, 3])
def test_interval_join_equals_a_loop(spark, monkeypatch, width, hot):
    l, left = intervals(spark, 3, ["a", "b", None])
    r, right = intervals(spark, 4, ["a", "b", "z"])
    got = interval_join(left, right, ("b", "e"), ("b", "e"), "k", width=width, hot_rows=hot)
    assert got.columns == ["k", "b", "e", "v", "right_k", "right_b", "right_e", "right_v"]
    assert rows(got) == overlapping(l, r)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_points_times_and_no_key(spark):
    l, left = intervals(spark, 5, ["a"], n=120)
    r, right = intervals(spark, 6, ["b"], n=120)
    assert rows(interval_join(left, right, ("b", "e"), ("b", "e"))) == overlapping(l, r, key=False)
    points = rows(interval_join(left, right, ("b", "b"), ("b", "e")).select("v", "right_v"))
    assert points == rows(left.alias("l").join(right.alias("r"), F.expr("NOT isnan(l.b) AND l.b BETWEEN r.b AND r.e")).select("l.v", "r.v"))
    at = left.where("NOT isnan(b)").selectExpr("k", "timestamp_seconds(b) AS b", "timestamp_seconds(e) AS e", "v")
    times = rows(interval_join(at, at, ("b", "e"), ("b", "e"), "k").select("v", "right_v"))
    keep = [x for x in l if x[1] is not None and x[1] == x[1]]
    assert times == sorted([(x[3], x[7]) for x in overlapping(keep, keep)], key=repr)
    assert rows(interval_join(left.filter("false"), right, ("b", "e"), ("b", "e"))) == []


def test_a_hot_cell_is_split(spark):
    many = spark.range(2_000).selectExpr("'a' AS k", "cast(id % 5 AS double) AS b", "cast(id % 5 AS double) AS e", "id AS v")
    few = spark.range(20).selectExpr("'a' AS k", "cast(id AS double) AS b", "cast(id + 1 AS double) AS e", "id AS w")
    whole = interval_join(many, few, ("b", "e"), ("b", "e"), "k", width=100.0)
    split = interval_join(many, few, ("b", "e"), ("b", "e"), "k", width=100.0, hot_rows=100)
    assert rows(split) == rows(whole) and split.count() > 2_000
