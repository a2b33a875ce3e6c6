"""Embedding near-duplicates by cross-polytope hashing.

A vector is rotated by three rounds of random signs and fast Hadamard transforms; its hash is the
signed axis nearest to the result. ``ROTATIONS`` hashes make a bucket of one table, in each of
``tables`` tables; a vector is put in its own bucket and, multiprobe, in those that replace one hash by
the runner-up axis. Vectors that share a bucket of a table are compared by cosine in double precision.

The number of tables follows from the threshold: it is set so that a pair at the threshold is missed
with a chance below ``MISS``, by the collision rate measured on random pairs at that cosine.

Copies are one class: rows with equal vectors and labels are hashed once, with their number. A pair found in
several buckets counts in the first only (a row carries its buckets), so link counts need no second
shuffle of pairs. Crowded buckets are cut into blocks and every pair of blocks is a group of its own;
a group sends on one row per class (number of links, smallest class it reaches), never its pairs.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor
do rows without a label; vectors of different lengths are not compared; rows that repeat an id count
as rows of their own but share the component of that id.
"""

from __future__ import annotations

from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basin.llm._common import stored
from basin.llm.components import components

ROTATIONS = 2
MISS = 1e-8
BLOCK = 2048
SEED = 20_240


def _hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row, whose length is a power of two."""
    n, h = x.shape[1], 1
    while h < n:
        x = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.concatenate([x[:, :, :1] + x[:, :, 1:], x[:, :, :1] - x[:, :, 1:]], axis=2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def _axes(x: np.ndarray, table: int, rotation: int):
    """Nearest and second nearest signed axis of each row after a random rotation."""
    n = 1 << max(0, (x.shape[1] - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, n - x.shape[1])))
    signs = np.random.default_rng([SEED, table, rotation, n]).choice([-1.0, 1.0], (3, n))
    for s in signs:
        x = _hadamard(x * s)
    size = np.abs(x)
    first = size.argmax(1)
    rows = np.arange(len(x))
    size[rows, first] = -1
    second = size.argmax(1) if n > 1 else first
    code = lambda axis: 2 * axis + (x[rows, axis] < 0)
    return code(first), code(second), 2 * n


def _buckets(x: np.ndarray, tables: int) -> np.ndarray:
    """Row by (table, probe): own bucket, then one probe for each hash."""
    out = np.zeros((len(x), tables, 1 + ROTATIONS), np.int64)
    for t in range(tables):
        axes = [_axes(x, t, r) for r in range(ROTATIONS)]
        for p in range(1 + ROTATIONS):
            for r, (first, second, n) in enumerate(axes):
                out[:, t, p] = out[:, t, p] * n + (second if p == r + 1 else first)
    return out


def tables_needed(dim: int, threshold: float, miss: float = MISS, pairs: int = 4000) -> int:
    """Tables for which a pair at the threshold is missed with a chance below ``miss``."""
    rng = np.random.default_rng(SEED)
    a, b = rng.normal(size=(2, pairs, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.maximum(np.linalg.norm(b, axis=1, keepdims=True), 1e-300)
    b = threshold * a + np.sqrt(1 - threshold ** 2) * b
    x, y = _buckets(a, 4), _buckets(b, 4)
    met = (x[:, :, :, None] == y[:, :, None, :]).any((2, 3)).mean()
    return max(1, ceil(log(miss) / log(1 - min(max(met - 0.03, 0.01), 0.999999))))


def usable(vector: str) -> Column:
    """True for vectors with finite components that are not all zero."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce((F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vector: str = "embedding",
                    label: str = "label", block: int = BLOCK) -> DataFrame:
    """(id, n_links, component_id, kept) of every row."""
    single = vectors.schema[vector].dataType.simpleString() == "array<float>"  # exact in double, half the bytes on the way
    rows = vectors.select(F.col(id_col).alias("_id"), F.col(vector).cast("array<float>" if single else "array<double>").alias("_v"),
                          F.col(label).alias("_label"))
    rows = rows.withColumn("_ok", usable("_v") & F.col("_label").isNotNull() & F.col("_id").isNotNull())
    classes = stored(rows.filter("_ok").groupBy("_label", "_v").agg(
        F.min("_id").alias("_class"), F.count("*").alias("_copies")), "vector-classes")
    if classes.isEmpty():
        return rows.select(F.col("_id").alias(id_col), F.lit(0).cast("bigint").alias("n_links"),
                           F.col("_id").alias("component_id"), F.lit(True).alias("kept"))
    dims = [r.d for r in classes.select(F.size("_v").alias("d")).distinct().collect()]  # lengths, not vectors
    tables = max(tables_needed(d, threshold) for d in dims)
    found = stored(_links(classes, dims, threshold, tables, block), "vector-links")
    degree = found.groupBy("c").agg(F.sum("links").alias("links"))
    reach = components(found.select(F.col("c").alias("a"), F.col("root").alias("b")))
    least = classes.select("_class", "_copies", "_label", "_v").join(degree, F.col("_class") == F.col("c"), "left").join(
        reach, F.col("_class") == F.col("node"), "left").select(
        "_label", "_v", (F.col("_copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        F.coalesce("component", "_class").alias("component_id"))
    joined = rows.filter("_ok").join(least, ["_label", "_v"]).select("_id", "n_links", "component_id")
    rest = rows.filter("NOT _ok").select("_id", F.lit(0).cast("bigint").alias("n_links"), F.col("_id").alias("component_id"))
    return joined.unionByName(rest).select(
        F.col("_id").alias(id_col), F.col("n_links").cast("bigint"), "component_id",
        F.col("_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _links(classes, dims, threshold, tables, block):
    """(c, links, root): verified links of each class, counted, and the smallest class it meets."""
    probes = 1 + ROTATIONS
    kind = classes.schema["_class"].dataType.simpleString()
    vector_kind = classes.schema["_v"].dataType.simpleString()
    axes = 2 << max(0, (max(dims) - 1).bit_length())
    small = axes ** ROTATIONS < 2 ** 31  # codes go along with every vector that is sent
    code_kind, code_type = (pa.int32(), "int") if small else (pa.int64(), "bigint")

    def hashed(batches):
        for b in batches:
            x = _matrix(b.column("_v"))
            for rows in _by_length(x):
                m = np.stack([x[i] for i in rows])
                codes = pa.array(_buckets(m.astype(float), tables).reshape(len(rows), -1).tolist(), pa.list_(code_kind))
                at = pa.array(rows)
                yield pa.RecordBatch.from_arrays([*(b.column(k).take(at) for k in ("_class", "_copies", "_label", "_v")),
                                                  codes], ["_class", "_copies", "_label", "_v", "codes"])

    label_kind = classes.schema["_label"].dataType.simpleString()
    rows = stored(classes.select("_class", "_copies", "_label", "_v").mapInArrow(
        hashed, f"_class {kind}, _copies bigint, _label {label_kind}, _v {vector_kind}, codes array<{code_type}>"), "vector-codes")
    keys = ["_label", "dim", "table", "bucket"]
    spread = rows.select("_class", "_label", F.size("_v").alias("dim"), F.posexplode("codes").alias("at", "bucket")).withColumn(
        "table", F.floor(F.col("at") / probes).cast("int")).drop("at")
    sizes = spread.groupBy(*keys).agg(F.count("*").alias("size")).filter("size > 1")
    sizes = sizes.withColumn("blocks", F.ceil(F.col("size") / block).cast("int"))
    own = F.pmod(F.xxhash64("_class"), F.col("blocks")).cast("int")
    other = F.sequence(F.lit(0), F.col("blocks") - 1)
    # ids meet first; a vector is sent only to the buckets that hold another one
    met = spread.join(sizes, keys).withColumn("own", own).withColumn("other", F.explode(other)).select(
        F.col("_class").alias("_id"), *keys, "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
    grouped = met.join(rows.select("_class", "_copies", "_v", "codes"), F.col("_id") == F.col("_class")).select(
        "_class", "_copies", "_v", "codes", *keys, "own", "lo", "hi")

    def verify(batches):
        for key, part in _groups(batches, [*keys, "lo", "hi"]):
            got = _verified(part, key[2], probes, threshold, key[4], key[5])
            if got is not None:
                yield pa.RecordBatch.from_arrays([pa.array(got[0]).cast(out_kind), pa.array(got[1]),
                                                  pa.array(got[2]).cast(out_kind)], ["c", "links", "root"])

    from pyspark.sql.pandas.types import to_arrow_type
    out_kind = to_arrow_type(classes.schema["_class"].dataType)
    order = [*keys, "lo", "hi"]
    dealt = grouped.repartition(*order).sortWithinPartitions(*order)
    part = dealt.mapInArrow(verify, f"c {kind}, links bigint, root {kind}")
    return part.groupBy("c", "root").agg(F.sum("links").alias("links"))


def _matrix(column) -> list[np.ndarray]:
    return [x.values.to_numpy(zero_copy_only=False) for x in column]


def _by_length(x):
    lengths = np.array([len(v) for v in x])
    for n in np.unique(lengths):
        yield np.flatnonzero(lengths == n)


def _groups(batches, names):
    """(key, table) of each run of equal keys in sorted batches; a run may span batches."""
    held, held_key = [], None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(n).to_pylist() for n in names]
        keys = list(zip(*cols))
        start = 0
        for i in range(1, len(keys) + 1):
            if i < len(keys) and keys[i] == keys[start]:
                continue
            if held_key is not None and keys[start] != held_key:
                yield held_key, pa.Table.from_batches(held)
                held = []
            held_key = keys[start]
            held.append(b.slice(start, i - start))
            start = i
    if held:
        yield held_key, pa.Table.from_batches(held)


def _verified(part, table, probes, threshold, lo, hi):
    """Links first met in this group: classes, their link counts, and the smallest class of their local component."""
    if part.num_rows < 2:
        return None
    ids, copies = part["_class"].to_numpy(), part["_copies"].to_numpy()
    x = np.stack([v.values.to_numpy(zero_copy_only=False) for v in part["_v"]]).astype(float)
    codes = np.stack([v.values.to_numpy(zero_copy_only=False) for v in part["codes"]]).reshape(len(ids), -1, probes)
    bucket, own = part["bucket"][0].as_py(), part["own"].to_numpy()
    ids, first = np.unique(ids, return_index=True)  # a class may reach a bucket by two probes
    copies, x, codes, own = copies[first], x[first], codes[first], own[first]
    if len(ids) < 2:
        return None
    with np.errstate(over="ignore", under="ignore"):
        scale = np.abs(x).max(1, keepdims=True)
        unit = x / scale
        unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    near = np.triu(unit @ unit.T >= threshold, 1)
    if lo != hi:
        near &= own[:, None] != own[None, :]
    a, b = np.nonzero(near)
    if not len(a):
        return None
    mine = np.ones(len(a), bool)
    for at in range(0, len(a), 200_000):  # keep pairs whose first common bucket is this one
        i, j = a[at:at + 200_000], b[at:at + 200_000]
        keep = mine[at:at + 200_000]
        for t in range(table):
            u, v = codes[i, t], codes[j, t]
            for p in range(probes):
                keep &= ~(u[:, p, None] == v).any(1)
        u, v = codes[i, table], codes[j, table]
        common = np.where((u[:, :, None] == v[:, None, :]).any(2), u, np.iinfo(u.dtype).max)
        keep &= common.min(1) == bucket
    a, b = a[mine], b[mine]
    if not len(a):
        return None
    links = np.bincount(a, copies[b], len(ids)) + np.bincount(b, copies[a], len(ids))
    root = np.arange(len(ids))
    while True:  # label propagation with pointer jumping
        low = root.copy()
        np.minimum.at(low, a, root[b])
        np.minimum.at(low, b, root[a])
        low = low[low]
        if (low == root).all():
            break
        root = low
    used = np.flatnonzero(links > 0)
    return ids[used], links[used].astype(np.int64), ids[root[used]]
