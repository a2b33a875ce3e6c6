"""Approximate nearest neighbours by a forest of hash-prefix trees.

Each tree gives a vector a string of ``BITS`` sign bits of random rotations and holds its rows as one
sorted array of those strings. A query descends every tree to its longest matching prefix, a run of
neighbours in the sorted array, and then ascends all trees together, one bit at a time, tree after tree, until the
runs hold ``reach`` of the rows (counted with repeats). These candidates, and only these, are scored.
Unless given, ``reach`` falls as the table grows, since the nearest rows of a larger table stand out more:
``WANTED * n ** -0.2`` of n rows. Over all blocks the runs hold k + 1 rows a tree at least.

Largest inner product becomes largest cosine by one more coordinate, sqrt(m^2 - |x|^2) for rows (m the
largest length) and 0 for queries. Scores are inner products of the original vectors in double precision.

Rows are dealt into blocks by a hash of the id, each with its forest over every row it holds; the queries
are dealt into chunks, and a task meets one chunk with one block. Rows and queries per task are fixed, so the memory of a
task is too; a query's best from all blocks are merged by rank, cut to k per task before the shuffle. Equal vectors get
equal strings and always come together.

The candidates a query needs to find its nearest rows depend on how far they stand out: on
directionless data, such as uniform random vectors, the nearest are barely nearer than the rest, hence
the wide ``reach``. README gives the measured recall and the share of rows scored.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components, and rows without an id,
take no part; a query meets only vectors of its own length; rows that repeat an id are all returned, but none is
returned for its own id; fewer than k candidates are all returned; no queries give no rows.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basin.llm._common import hash_bucket
from basin.llm.embedding_dedup import usable

TREES = 64
BITS = 32
#: Candidates (with repeats) are this times rows ** (1 - FALL): 1.25 of the rows at 500, 0.5 at 50,000.
WANTED, FALL = 4.33, 0.2
BLOCK_ROWS = 8192
CHUNK_QUERIES = 4096
SEED = 41


def _strings(x: np.ndarray, tree: int) -> np.ndarray:
    """Hash strings of one tree as integers, the first bit highest."""
    n = x.shape[1]
    rng = np.random.default_rng([SEED, tree, n])
    planes = np.concatenate([np.linalg.qr(rng.normal(size=(n, n)))[0] for _ in range(ceil(BITS / n))])[:BITS]
    return ((x @ planes.T > 0) @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))).astype(np.int64)


def _candidates(rows: np.ndarray, queries: np.ndarray, reach: float, trees: int, least: float = 1):
    """Boolean (query, row): the row is in a run of the query when its ascent ends, with at least ``least`` held."""
    wanted = ceil(max(least, reach * len(rows)))
    forest = []
    for t in range(trees):
        strings = _strings(rows, t)
        order = np.argsort(strings, kind="stable")
        forest.append((strings[order], order, _strings(queries, t)))
    low, high = np.zeros(len(queries), np.int64), np.full(len(queries), BITS)

    def runs(length):  # the run of rows that share the first ``length`` bits, in each tree
        rest = (BITS - length).astype(np.int64)
        for strings, order, q in forest:
            first = q >> rest << rest
            yield np.searchsorted(strings, first), np.searchsorted(strings, first + (np.int64(1) << rest)), order

    while (low < high).any():  # the longest common length whose runs hold enough, by bisection over the ascent
        middle = (low + high + 1) // 2
        held = sum(b - a for a, b, _ in runs(middle))
        enough = held >= wanted
        low, high = np.where(enough, middle, low), np.where(enough, high, middle - 1)
    found = np.zeros((len(queries), len(rows)), bool)
    below = list(runs(np.minimum(low + 1, BITS)))  # one bit before, where no query has enough yet
    held = sum(b - a for a, b, _ in below)
    for (a, b, order), (a_below, b_below, _) in zip(runs(low), below):
        done = held >= wanted  # the last step up ends at the tree that brings enough
        held += np.where(done, 0, (b - a) - (b_below - a_below))
        a, b = np.where(done, a_below, a), np.where(done, b_below, b)
        for i in np.flatnonzero(b > a):
            found[i, order[a[i]:b[i]]] = True
    return found


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector: str = "embedding",
            trees: int = TREES, reach: float | None = None) -> DataFrame:
    """(query_id, rank, <id>, score): the k best rows found for each query, best first, ties by smaller id."""
    single = vectors.schema[vector].dataType.simpleString() == "array<float>"  # moved as they are, scored in doubles
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector).cast("array<float>" if single else "array<double>").alias("v"),
                          F.coalesce(is_query, F.lit(False)).alias("is_query"))
    rows = rows.filter(F.col("id").isNotNull() & usable("v"))
    longest = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    n, queries, largest = rows.agg(F.count("*"), F.count_if("is_query"), F.max(longest)).first()
    blocks, chunks = max(1, ceil(n / BLOCK_ROWS)), max(1, ceil(queries / CHUNK_QUERIES))
    largest = float(largest or 0.0)
    reach = WANTED * max(n, 1) ** -FALL if reach is None else reach
    left = rows.filter("is_query").select("id", "v", hash_bucket(F.struct("id", F.lit(1)), chunks).alias("chunk"),
                                          F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    right = rows.select("id", "v", hash_bucket(F.col("id"), blocks).alias("block"),
                        F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"))
    kind = vectors.schema[id_col].dataType.simpleString()

    def search(q: pa.Table, r: pa.Table) -> pa.Table:
        out = [([], [], [])]
        mine, theirs = _by_length(q), _by_length(r)
        for length in mine.keys() & theirs.keys():
            out.append(_search(*mine[length], *theirs[length], k, largest, reach, trees, trees * (k + 1) / blocks))
        a, b, c = (np.concatenate([np.asarray(x[i]) for x in out]) for i in range(3))
        return pa.table({"query_id": pa.array(a).cast(q.schema.field("id").type),
                         "id": pa.array(b).cast(q.schema.field("id").type), "score": pa.array(c, pa.float64())})

    best = left.groupBy("block", "chunk").cogroup(right.groupBy("block", "chunk")).applyInArrow(
        search, f"query_id {kind}, id {kind}, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")


def _by_length(t: pa.Table):
    ids = t["id"].to_numpy()
    vectors = [v.values.to_numpy(zero_copy_only=False) for v in t["v"]]
    lengths = np.array([len(v) for v in vectors], np.int64)
    return {int(n): (ids[lengths == n], np.stack([vectors[i] for i in np.flatnonzero(lengths == n)]).astype(np.float64))
            for n in np.unique(lengths)}


def _search(query_ids, queries, ids, rows, k, largest, reach, trees, least):
    order = np.argsort(ids, kind="stable")
    ids, rows = ids[order], rows[order]
    scale = np.sqrt(largest) if largest > 0 else 1.0
    tail = np.sqrt(np.maximum(0.0, 1.0 - ((rows / scale) ** 2).sum(1)))
    found = _candidates(np.column_stack([rows / scale, tail]),
                        np.column_stack([queries / scale, np.zeros(len(queries))]), reach, trees, least)
    out = ([], [], [])
    for i, q in enumerate(queries):
        at = np.flatnonzero(found[i])
        at = at[ids[at] != query_ids[i]]
        if len(at) > k:  # rows about as good as the k-th stay, the exact scores and the smaller ids decide below
            rough = rows[at] @ q
            at = at[rough >= np.partition(rough, len(at) - k)[len(at) - k] - 1e-9 * scale * np.linalg.norm(q)]
        scores = (rows[at] * q).sum(1)  # summed alike for equal vectors, wherever they stand
        best = np.lexsort((ids[at], -scores))[:k]
        out[0].append(np.full(len(best), query_ids[i]))
        out[1].append(ids[at[best]])
        out[2].append(scores[best])
    return tuple(np.concatenate(x) if x else np.zeros(0) for x in out)
