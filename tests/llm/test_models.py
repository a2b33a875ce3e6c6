"""Toxicity, quality and mixing: held-out accuracy, exact parts against brute force, odd rows."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from basin.llm import mixing, quality, queries, toxicity
from tests.llm.helpers import empty, odd_documents, rows, with_extra_columns

SF = "/root/testdata/sf0.1"


def known(spark, label):
    return {r.doc_id: r[label] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}


def area(scores, labels):
    order = np.argsort(scores, kind="stable")
    rank = np.empty(len(order))
    rank[order] = np.arange(len(order))
    good = labels == 1
    return (rank[good].mean() - (good.sum() - 1) / 2) / (~good).sum()


@pytest.mark.parametrize("name,label,threshold,accuracy", [
    ("op7_toxicity", "toxic", 0.5, 0.95), ("op4_quality", "quality", 0.3, 0.97)])
def test_held_out_accuracy(spark, name, label, threshold, accuracy):
    got = queries.QUERIES[name](spark, SF).collect()
    labels = known(spark, label)
    assert len(got) == 10_000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= threshold) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    test = [r for r in got if r.held_out and r.doc_id in labels]
    truth = np.array([labels[r.doc_id] for r in test])
    assert np.mean(truth == np.array([r.predicted for r in test])) > accuracy
    assert area(np.array([r.score for r in test]), truth) > 0.95


def test_pairwise_term_equals_the_double_sum():
    rng = np.random.default_rng(0)
    slots = np.array([3, 9, 20, 77])
    model = toxicity.Weights(slots, 0.3, rng.normal(size=4), rng.normal(size=(4, toxicity.FACTORS)))
    rows_ = [np.array([0, 2, 3]), np.array([], int), np.array([1])]
    want = [0.3 + model.w[r].sum() + sum(model.v[i] @ model.v[j] for i in r for j in r if i < j) for r in rows_]
    assert np.allclose(model.margins(rows_)[0], want)
    again = toxicity.Weights.of(slots, model.numbers())
    assert np.allclose(again.margins(rows_)[0], want)


def test_interaction_is_learned():
    """Labels that are an exclusive-or of two terms: no additive weights can rank them."""
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2, (800, 2))
    terms = [np.flatnonzero(np.append(r, 1)) for r in x]
    y = (x[:, 0] != x[:, 1]).astype(float)
    model = toxicity.Weights([1, 2, 3])
    for r in range(60):
        model = toxicity._train(model, terms, y, np.ones(len(y)), r)
    assert np.mean((model.margins(terms)[0] > 0) == (y == 1)) > 0.95


@pytest.fixture(scope="module")
def labelled(spark):
    good, bad = "the calm river went by the old mill", "you stupid clown what an idiot thing"
    texts = [f"{good if i % 2 else bad} number{i}" for i in range(120)]
    docs = odd_documents(spark, texts)
    labels = spark.createDataFrame([(100 + i, i % 2, 1 - i % 2) for i in range(120)] + [
        (1, None, None), (2, 1, 0), (3, 1, 0), (None, 1, 0), (9999, 1, 0), (101, 0, 0)], "doc_id long, quality int, toxic int")
    return with_extra_columns(docs), labels


def test_toxicity_odd_rows(spark, labelled):
    docs, labels = labelled
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == docs.count()
    assert all(r.score is not None and 0 <= r.score <= 1 for r in got)
    assert rows(toxicity.toxicity(empty(docs), labels)) == []
    unlearned = toxicity.toxicity(docs, empty(labels)).collect()
    assert {r.score for r in unlearned} == {0.5}
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns
    left = [r.doc_id for r in kept.collect()]
    assert None in left and left.count(6) == 2 and all(i % 2 for i in left if i and i >= 100)


def test_toxic_rows_go_by_text_not_by_id(spark, labelled):
    docs, labels = labelled
    bad, good = "you stupid clown what an idiot thing number7", "the calm river went by the old mill number8"
    more = spark.createDataFrame([(7001, bad), (7001, good), (None, bad), (None, good)], "doc_id long, text string")
    kept = toxicity.drop_toxic(docs.unionByName(more, allowMissingColumns=True), labels)
    left = [(r.doc_id, r.text) for r in kept.collect()]
    assert (7001, good) in left and (None, good) in left and bad not in [t for _, t in left]


def test_quality_odd_rows(spark, labelled):
    docs, labels = labelled
    got = quality.quality(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert rows(quality.quality(empty(docs), labels)) == []
    assert {r.score for r in quality.quality(docs, empty(labels)).collect()} == {0.5}
    ones = labels.withColumn("quality", F.lit(1))
    assert {r.score for r in quality.quality(docs, ones).collect()} == {1.0}


def test_pooling_is_isotonic_regression():
    rng = np.random.default_rng(2)
    bins = [(i / 50, int(rng.integers(1, 9)), 0.0) for i in range(50)]
    bins = [(a, n, float(rng.binomial(n, a))) for a, n, _ in bins]
    at, value = quality._pool(bins)
    assert (np.diff(value) > 0).all() and (np.diff(at) > 0).all()
    n, y = np.array([b[1] for b in bins]), np.array([b[2] / b[1] for b in bins])
    # the value of a place is the largest over starts of the smallest weighted mean over ends
    want = [max(min(np.average(y[s:e], weights=n[s:e]) for e in range(i + 1, 51)) for s in range(i + 1)) for i in range(50)]
    assert np.allclose(np.unique(np.round(want, 12)), np.round(value, 12))


def test_rates_match_brute_force_least_squares(spark):
    rng = np.random.default_rng(4)
    p = rng.dirichlet([0.3, 0.3, 0.3], 400).round(4)
    n = rng.integers(1, 500, 400)
    groups = spark.createDataFrame([(x.tolist(), int(m)) for x, m in zip(p, n)], "p array<double>, n long")
    targets = [0.2, 0.5, 0.3]
    rate, fitted = mixing.fit_rates(groups, targets)
    r = np.array([x.r for x in groups.select("p", "n", rate.alias("r")).collect()])
    mass = n @ p
    budget = mass[1] / 0.5  # the largest target keeps its tokens
    goal = np.array(targets) * budget
    assert (r >= 0).all() and np.allclose(fitted["goal"], goal)
    assert np.allclose(np.array(fitted["total"]), goal, rtol=1e-2)
    brute = np.ones(400)  # plain projected gradient, many steps
    for _ in range(5000):
        brute = np.maximum(0, brute - p @ (((n * brute) @ p - goal) / mass))
    assert np.allclose((n * brute) @ p, goal, rtol=1e-4)


def test_mixing_query_reaches_its_targets(spark):
    got = queries.QUERIES["op5_mixing"](spark, SF).toPandas()
    assert len(got) == 10_000 and (got.rate >= 0).all()
    domains = sorted(queries.TARGETS)
    totals = np.array([(got.n_tokens * got.rate * got[f"p_{d}"]).sum() for d in domains])
    assert np.allclose(totals / totals.sum(), [queries.TARGETS[d] for d in domains], atol=2e-3)
    assert np.allclose(got[[f"p_{d}" for d in domains]].sum(axis=1), 1, atol=1e-3)


def test_a_domain_with_little_mass_does_not_shrink_the_corpus(spark):
    groups = spark.createDataFrame([([1.0, 0.0], 10_000), ([0.0, 1.0], 10)], "p array<double>, n long")
    rate, fitted = mixing.fit_rates(groups, [0.9, 0.1])
    got = {tuple(r.p): r.r for r in groups.select("p", rate.alias("r")).collect()}
    assert abs(got[1.0, 0.0] - 1) < 1e-2 and abs(got[0.0, 1.0] - 111.1) < 2


def test_mixing_odd_rows(spark, labelled):
    docs, labels = labelled
    domains = queries.labelled_domains(labels)
    got = mixing.document_rates(docs, domains, queries.TARGETS).collect()
    assert len(got) == docs.count() and all(r.rate >= 0 for r in got)
    assert {r.doc_id: r.n_tokens for r in got if r.doc_id in (2, 3, 4)} == {2: 0, 3: 0, 4: 0}
    assert rows(mixing.document_rates(empty(docs), domains, queries.TARGETS)) == []
    plain = mixing.document_rates(docs, empty(domains), queries.TARGETS).collect()
    assert len({r.rate for r in plain}) == 1
    kept = mixing.thin(docs, domains, queries.TARGETS)
    assert kept.columns == docs.columns and 0 < kept.count() <= docs.count()


@pytest.mark.parametrize("spread,targets", [(30, [0.2, 0.5, 0.3]), (3, [0.1, 0.8, 0.1])])
def test_overlapping_domains_meet_targets_that_can_be_met(spark, spread, targets):
    rng = np.random.default_rng(0)
    p, n = rng.dirichlet([spread] * 3, 5000).round(4), rng.integers(1, 500, 5000)
    groups = spark.createDataFrame([(x.tolist(), int(m)) for x, m in zip(p, n)], "p array<double>, n long").coalesce(2).cache()
    rate, fitted = mixing.fit_rates(groups, targets)
    r = np.array([x.r for x in groups.select(rate.alias("r")).collect()])
    assert fitted["met"] and (r >= 0).all()
    assert np.allclose((n * r) @ p, fitted["goal"], rtol=1e-3) and fitted["steps"] < 100


def test_targets_that_cannot_be_met_are_told_and_approached(spark):
    p, n = np.array([[0.6, 0.4], [0.5, 0.5]]), np.array([10_000, 10])
    odd = [([0.0, 1.0], 0)]  # a document without tokens cannot help
    groups = spark.createDataFrame([(x.tolist(), int(m)) for x, m in zip(p, n)] + odd, "p array<double>, n long")
    _, fitted = mixing.fit_rates(groups, [0.9, 0.1])
    mass, goal = n @ p, np.array([0.9, 0.1]) * (n @ p)[0] / 0.9
    r = np.ones(2)
    for _ in range(20_000):
        r = np.maximum(0, r - p @ (((n * r) @ p - goal) / mass))
    assert not fitted["met"] and np.allclose(fitted["goal"], goal) and np.allclose(fitted["total"], (n * r) @ p, rtol=1e-3)


@pytest.mark.parametrize("draw", [mixing.mix, mixing.thin])
def test_token_shares_after_the_draw_with_a_domain_below_its_target(spark, draw):
    texts = [f"the calm river went by the old mill {i}" for i in range(2000)]
    texts += [f"BUY NOW!!! $$$ CHEAP *** {i} <CLICK> HERE $$$ || {i}" for i in range(40)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    labelled = spark.createDataFrame([(i, "clean" if i < 2000 else "low") for i in range(len(texts))], "doc_id long, domain string")
    kept = draw(docs, labelled, queries.PIPELINE_TARGETS).groupBy("doc_id").agg(
        F.count("*").alias("copies"), F.min(F.size(F.split("text", " "))).alias("n")).toPandas()
    tokens, low = kept.copies * kept.n, kept.doc_id >= 2000
    assert tokens[low].sum() / tokens.sum() == pytest.approx(queries.PIPELINE_TARGETS["low"], abs=0.01)
    assert (kept.copies[low].max() > 1) == (draw is mixing.mix) and (kept.copies[~low] == 1).all()


def test_systematic_copies_follow_the_running_sum(spark):
    rng = np.random.default_rng(9)
    data = [(int(i), float(r), int(n)) for i, r, n in zip(rng.permutation(700), rng.uniform(0, 2.5, 700), rng.integers(1, 9, 700))]
    df = spark.createDataFrame(data, "row long, rate double, n long").repartition(5)
    got = {r.row: r.copies for r in mixing.systematic(df, 3).collect()}
    start, total, want = __import__("random").Random(3).randrange(1_000_000), 0, {}
    for i, r, _ in sorted(data, key=lambda d: (d[2], d[0])):
        before, total = total, total + round(r * 1_000_000)
        want[i] = (total + start) // 1_000_000 - (before + start) // 1_000_000
    assert got == want and all(abs(got[i] - r) < 1 for i, r, _ in data)
    assert mixing.systematic(df.filter("false"), 3).count() == 0


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_drawn_token_shares_keep_near_the_targets(spark, sf):
    folder = f"/root/testdata/{sf}"
    labelled = queries.labelled_quality(spark.read.parquet(f"{folder}/labels.parquet"))
    rates = mixing.document_rates(spark.read.parquet(f"{folder}/documents.parquet"), labelled, queries.PIPELINE_TARGETS)
    members = rates.filter("n_tokens > 0").select(
        F.col("doc_id").alias("row"), "rate", mixing.coarse(F.array("p_clean", "p_low")), "n_tokens", "p_clean", "p_low").cache()
    for seed in range(20):
        drawn = mixing.systematic(members.drop("p_clean", "p_low"), seed).join(members, "row")
        share = drawn.selectExpr("sum(copies * n_tokens * p_low) / sum(copies * n_tokens * (p_clean + p_low))").first()[0]
        assert share == pytest.approx(queries.PIPELINE_TARGETS["low"], abs=0.01), seed
