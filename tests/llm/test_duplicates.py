"""SimHash, embedding near-duplicates, nearest neighbours and components against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from basin.llm import ann, embedding_dedup, queries, simhash
from basin.llm.components import components
from tests.llm.helpers import empty, odd_documents, rows, with_extra_columns


def union(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_components_of_chains_stars_and_self_links(spark):
    rng = random.Random(3)
    pairs = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 40)] + [(7, 7), (300, 301), (301, 300)]
    pairs += [(rng.randint(500, 600), rng.randint(500, 600)) for _ in range(60)]
    rng.shuffle(pairs)
    df = spark.createDataFrame([*pairs, (None, 3), (4, None)], "a long, b long")
    want = union(pairs, {n for p in pairs for n in p if p[0] != p[1]})
    assert {r.node: r.component for r in components(df).collect()} == want
    assert rows(components(empty(df))) == []


def plain_fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) if hashes else 0


def test_fingerprints(spark):
    docs = with_extra_columns(odd_documents(spark, ["A b", "É É a\x0bb\x85c", "x " * 50]))
    want = [(r.doc_id, signed(plain_fingerprint(r.text))) for r in docs.collect()]
    assert rows(simhash.fingerprints(docs)) == sorted(want, key=repr)


@pytest.mark.parametrize("distance,route_rows", [(3, 16_384), (3, 50), (2, 50), (4, 16_384), (1, 16_384), (0, 16_384)])
def test_links_connect_exactly_the_near_ones(spark, distance, route_rows):
    rng = random.Random(1)
    prints = []
    for _ in range(25):
        x = rng.getrandbits(64)
        for _ in range(rng.randint(1, 20)):
            y = x
            for _ in range(rng.randint(0, 3)):
                y ^= 1 << rng.randrange(64)
            prints.append(y)
            x = y if rng.random() < 0.5 else x
    prints += [rng.getrandbits(64) for _ in range(150)] + [0, 0]
    df = spark.createDataFrame([(signed(x),) for x in prints], "fp long")
    reach = {r.node: r.component for r in components(simhash.links(df, distance, route_rows)).collect()}
    nodes = sorted({signed(x) for x in prints})
    near = [(a, b) for i, a in enumerate(nodes) for b in nodes[i + 1:] if ((a ^ b) & (2 ** 64 - 1)).bit_count() <= distance]
    want = union(near, nodes)
    assert all(reach.get(n, n) == want[n] for n in nodes)


def test_collisions_in_passes_are_the_same(monkeypatch):
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2 ** 63, 60, dtype=np.uint64)
    prints = np.unique(np.concatenate([base, base ^ np.uint64(5), base ^ np.uint64(1 << 40 | 3)]))
    flips = np.zeros(len(prints), np.int32)
    whole = simhash._collisions(prints, flips, 0, 3)
    monkeypatch.setattr(simhash, "PASS_VARIANTS", 20_000)
    cut = simhash._collisions(prints, flips, 0, 3)
    assert (whole[0] == cut[0]).all() and (whole[1] == cut[1]).all() and len(whole[0])


def test_simhash_query_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    prints = {r.doc_id: plain_fingerprint(r.text) for r in docs}
    ids = sorted(prints)
    near = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1:] if (prints[a] ^ prints[b]).bit_count() <= 3]
    want = union(near, ids)
    got = queries.QUERIES["op10_simhash"](spark, sf_dir)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got.collect()} == {
        i: (f"{prints[i]:016x}", want[i]) for i in ids}


def test_simhash_odd_rows(spark):
    docs = with_extra_columns(odd_documents(spark))
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert got[1] == got[6] == 1 and got[2] == got[3] == got[4] == 2 and got[5] == 5
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {1, 2, 5, 7, None}
    assert rows(simhash.near_duplicates(empty(docs))) == []


def test_near_duplicates_go_by_row_not_by_id(spark):
    a, b = "one two three four five six", "nothing like the other text at all here"
    rows_ = [(1, a), (2, a), (2, b), (None, a), (None, b + " indeed it is quite another"), (None, b + " indeed it is quite another"),
             (3, None), (None, None), (3, None), (4, "   ")]
    docs = with_extra_columns(spark.createDataFrame(rows_, "doc_id long, text string"))
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert rows(kept.select("doc_id", "text")) == sorted([(1, a), (2, b), (None, rows_[4][1]), (3, None)], key=repr)


VECTORS = "vec_id long, embedding array<float>, label int"


def odd_vectors(spark, n=60, dim=16):
    rng = np.random.default_rng(5)
    rows_ = []
    for k in range(n):
        v = rng.normal(size=dim)
        rows_.append((k, v.tolist(), k % 3))
        rows_.append((1000 + k, (v + rng.normal(size=dim) * 0.05).tolist(), k % 3))
        rows_.append((2000 + k, (v * 2).tolist(), (k + k % 2) % 3))
    rows_ += [(5000, None, 1), (5001, [0.0] * dim, 1), (5002, [float("nan")] * dim, 1), (5003, [None] * dim, 1), (5004, [], 1),
              (5005, [float("inf")] + [1.0] * (dim - 1), 1), (5006, rows_[0][1], None), (5007, [1.0, 2.0], 1), (5008, [2.0, 4.0], 1),
              (5009, rows_[3][1], rows_[3][2]), (5009, rows_[3][1], rows_[3][2]), (5020, [3.0], 2)]
    return spark.createDataFrame(rows_, VECTORS)


def usable(v):
    return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)


def brute_links(data, threshold=0.98):
    ok = [usable(r.embedding) and r.label is not None for r in data]
    n, pairs = [0] * len(data), []
    for i, a in enumerate(data):
        for j in range(i + 1, len(data)):
            b = data[j]
            if ok[i] and ok[j] and a.label == b.label and len(a.embedding) == len(b.embedding):
                x, y = np.array(a.embedding, float), np.array(b.embedding, float)
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                    n[i], n[j] = n[i] + 1, n[j] + 1
                    pairs.append((a.vec_id, b.vec_id))
    root = union(pairs, {r.vec_id for r in data})
    return sorted((r.vec_id, n[i], root[r.vec_id], r.vec_id == root[r.vec_id]) for i, r in enumerate(data))


@pytest.mark.parametrize("block", [2048, 3])
def test_embedding_links_against_brute_force(spark, block):
    df = with_extra_columns(odd_vectors(spark).drop("label")).drop("label").join(
        odd_vectors(spark).select("vec_id", "label").distinct(), "vec_id")
    got = embedding_dedup.near_duplicates(df, block=block)
    assert rows(got) == sorted(brute_links(df.collect()), key=repr)
    assert rows(embedding_dedup.near_duplicates(empty(df))) == []


def test_embedding_query_against_brute_force(spark, sf_dir):
    data = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    assert rows(queries.QUERIES["op9_embedding_dedup"](spark, sf_dir)) == sorted(brute_links(data), key=repr)


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(0).normal(size=(5, 32))
    assert np.allclose(np.linalg.norm(embedding_dedup._hadamard(x), axis=1), np.linalg.norm(x, axis=1))
    assert np.allclose(embedding_dedup._hadamard(embedding_dedup._hadamard(x)), x)


def test_nearest_recall_and_exact_scores(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    data = {r.vec_id: np.array(r.embedding, float) for r in df.collect()}
    ids = np.array(sorted(data))
    x = np.stack([data[i] for i in ids])
    got = {}
    for r in queries.QUERIES["op3_ann"](spark, sf_dir).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == {i for i in data if i % 20 == 0}
    recalls = []
    for q, found in got.items():
        found.sort()
        scores = x @ data[q]
        scores[ids == q] = -np.inf
        best = set(ids[np.argsort(-scores)[:20]].tolist())
        recalls.append(len(best & {v for _, v, _ in found}) / 20)
        assert [k for k, _, _ in found] == list(range(1, 21))
        assert all(abs(s - data[q] @ data[v]) < 1e-9 for _, v, s in found)
        assert [(-s, v) for _, v, s in found] == sorted((-s, v) for _, v, s in found)
    assert np.mean(recalls) >= 0.9


@pytest.mark.parametrize("n, most", [(500, 0.9), (2000, 0.65), (8000, 0.5)])
def test_nearest_recall_and_share_scored_without_direction(n, most):
    """Uniform directions, the worst case: recall holds while the share of the rows scored falls with their number."""
    x = np.random.default_rng(3).normal(size=(n, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    found = ann._candidates(x, x[:60], ann.WANTED * n ** -ann.FALL, ann.TREES, ann.TREES * 21)
    scores = x[:60] @ x.T
    scores[np.arange(60), np.arange(60)] = -np.inf
    best = np.argsort(-scores, axis=1)[:, :20]
    assert np.take_along_axis(found, best, 1).mean() >= 0.9 and found.mean() <= most


def test_nearest_fills_k_on_small_tables(spark):
    x = np.random.default_rng(4).normal(size=(25, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.nearest(df, F.col("vec_id") % 5 == 0, k=20).groupBy("query_id").count().collect()
    assert {(r["query_id"], r["count"]) for r in got} == {(i, 20) for i in range(0, 25, 5)}


def test_nearest_odd_rows(spark):
    df = with_extra_columns(odd_vectors(spark))
    got = ann.nearest(df, F.col("vec_id") % 20 == 0, k=3, reach=100.0)
    data = df.collect()
    for q in (r for r in data if r.vec_id % 20 == 0 and usable(r.embedding)):
        mine = [r for r in got.collect() if r.query_id == q.vec_id]
        others = [r for r in data if r.vec_id != q.vec_id and usable(r.embedding) and len(r.embedding) == len(q.embedding)]
        want = sorted((-np.dot(q.embedding, r.embedding), r.vec_id) for r in others)[:3]
        assert [r.vec_id for r in sorted(mine, key=lambda r: r.rank)] == [v for _, v in want]
        break
    assert {r.query_id for r in got.collect()} == {r.vec_id for r in data if r.vec_id % 20 == 0 and usable(r.embedding)} - {5020}
    assert rows(ann.nearest(empty(df), F.lit(True))) == []
