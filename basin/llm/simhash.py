"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two 64-bit fingerprints within d bits of each other have a common variant within half of d of both.
Every distinct fingerprint emits its variants, variants meet in a shuffle, colliding fingerprints
are deduplicated, verified and linked; connected components follow.

For an odd d the halves are uneven: (d-1)/2 and (d+1)/2 flips. Fingerprints exactly d apart differ
in the parity of their set bits, so only those with even parity emit the larger half; and of any d
flipped bits (d+1)/2 lie in the same half of the word, so only flips within a half are needed.

Variants are shuffled by their leading bits: a fingerprint is sent once to each leading-bits value
that any of its variants has, and the task lists the variants that fall there. All equal variants
meet, at a twelfth of the rows (for d = 3). The number of leading bits follows the number of distinct
fingerprints, and crowded values are split by further bits.

A variant's members within (d-1)/2 (d/2) flips are within d of all its members, so each other member is
linked to the first of these: as many links as members, never all pairs, and the same components.
"""

from __future__ import annotations

from itertools import combinations
from math import ceil, log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from basin.llm._common import stored
from basin.llm.components import components

#: Rows aimed at for each value of the leading bits; a value with four times as many is split.
ROUTE_ROWS = 16_384
SPLIT_BITS = 10
#: Variants laid out at once in a task (about 20 bytes each); more are done in passes.
PASS_VARIANTS = 6_000_000
SHINGLE_SLICE = 200_000


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """(id, fp): 64-bit SimHash over word shingles of the whole text, A-Z lower-cased.

    A bit is set if more than half of the shingles' XXH64 values have it. Texts of fewer words than
    a shingle hash their whole word sequence; texts without words (null, empty, blank) have fp 0.
    """
    def run(batches):
        for batch in batches:
            found = [_fingerprint(t.as_py(), shingle, seed) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], [id_col, "fp"])

    return docs.select(id_col, text_col).mapInArrow(run, StructType([docs.schema[id_col], StructField("fp", LongType())]))


def _fingerprint(text, shingle, seed):
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, size = b" ".join(words), min(shingle, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - size + 1].tolist()
    ends = ends[size - 1:].tolist()
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(starts), SHINGLE_SLICE):
        hashes = np.array([digest(joined[s:e], seed) for s, e in
                           zip(starts[at:at + SHINGLE_SLICE], ends[at:at + SHINGLE_SLICE])], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, np.int64)
    return int(np.packbits(counts * 2 > len(starts), bitorder="little").view("<i8")[0])


def links(prints: DataFrame, distance: int = 3, route_rows: int = ROUTE_ROWS) -> DataFrame:
    """(a, b) links over the distinct values of ``fp`` that connect exactly those within ``distance`` bits."""
    near, far = distance // 2, (distance + 1) // 2
    distinct = prints.select("fp").distinct()
    even = F.bit_count("fp") % 2 == 0
    n = distinct.count()
    bits = min(16, max(0, ceil(log2(max(1, n * 30 / route_rows)))))
    routed = distinct.select("fp", F.explode(
        F.when(even, _masks(64 - bits, bits, far)).otherwise(_masks(64 - bits, bits, near))).alias("m")).select(
        F.shiftrightunsigned(F.col("fp").bitwiseXOR(F.col("m.mask")), 64 - bits).alias("route") if bits
        else F.lit(0).cast("bigint").alias("route"), "fp", F.col("m.flips").alias("flips"), F.lit(bits).alias("bits"))
    crowded = stored(routed.groupBy("route").count().filter(F.col("count") > 4 * route_rows).select("route"),
                     "simhash-crowded")  # at most 2 ** 16 routes
    if not crowded.isEmpty():
        deeper = min(32, bits + SPLIT_BITS)
        rest = F.when(even, F.lit(far)).otherwise(F.lit(near)) - F.col("flips")
        split = (routed.join(F.broadcast(crowded), "route", "left_semi").select("route", "fp", "flips", F.explode(
            F.filter(_masks(64 - deeper, deeper - bits, far), lambda m: m["flips"] <= rest)).alias("m")).select(
            (F.shiftleft("route", deeper - bits) + F.shiftrightunsigned(
                F.col("fp").bitwiseXOR(F.col("m.mask")), 64 - deeper) % (1 << (deeper - bits))).alias("route"),
            "fp", (F.col("flips") + F.col("m.flips")).alias("flips"), F.lit(deeper).alias("bits")))
        routed = routed.join(F.broadcast(crowded), "route", "left_anti").select(*split.columns).unionByName(split)

    def meet(group: pa.Table) -> pa.Table:
        a, b = _collisions(group["fp"].to_numpy().view("u8"), group["flips"].to_numpy(),
                           int(group["bits"][0].as_py()), distance)
        return pa.table({"a": a.view("i8"), "b": b.view("i8")})

    return routed.groupBy("bits", "route").applyInArrow(meet, "a bigint, b bigint")


def _masks(low, count, flips):
    """All masks of up to ``flips`` of the ``count`` bits from bit ``low`` up, as a literal array."""
    rows = [(sum(1 << (low + k) for k in c), len(c)) for j in range(flips + 1) for c in combinations(range(count), j)]
    return F.array(*[F.struct(F.lit(m - (1 << 64) if m >> 63 else m).cast("bigint").alias("mask"),
                              F.lit(j).alias("flips")) for m, j in rows])


def _low_masks(bits, flips, distance):
    """Masks below the leading bits for a member with ``flips`` flips there: near ones, then far ones."""
    near, far, free = distance // 2, (distance + 1) // 2, 64 - bits
    pick = lambda positions, k: [sum(1 << p for p in c) for c in combinations(positions, k)] if k >= 0 else []
    a = [m for k in range(near - flips + 1) for m in pick(range(free), k)]
    b = []
    if far > near:
        b = pick(range(32, free), far - flips)
        if not flips:
            b += pick(range(32), far)
    return np.array(a, "u8"), np.array(b, "u8")


def _collisions(fps, flips, bits, distance):
    """Links between the fingerprints of one route that share a variant."""
    blocks = []  # members, their low masks, whether those are near
    even = np.bitwise_count(fps) % 2 == 0
    for j in np.unique(flips):
        near, far = _low_masks(bits, int(j), distance)
        blocks.append((fps[flips == j], near, True))
        blocks.append((fps[(flips == j) & even], far, False))
    blocks = [(f, m, k) for f, m, k in blocks if len(f) and len(m)]
    passes = max(1, ceil(sum(len(f) * len(m) for f, m, _ in blocks) / PASS_VARIANTS))
    top = np.uint64(2 ** 64 - 2 ** (64 - bits)) if bits else np.uint64(0)
    out = [np.zeros((0, 2), "u8")]
    for k in range(passes):
        variants, members, close = [], [], []
        for f, masks, is_near in blocks:
            for at in range(0, len(f), max(1, PASS_VARIANTS // len(masks))):
                part = f[at:at + max(1, PASS_VARIANTS // len(masks))]
                v = ((part & ~top)[:, None] ^ masks[None, :]).ravel()  # the leading bits are the route's
                m = np.repeat(part, len(masks))
                if passes > 1:
                    mine = (v * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(passes) == k
                    v, m = v[mine], m[mine]
                variants.append(v)
                members.append(m)
                close.append(np.full(len(v), is_near))
        if not variants:
            break
        v, m, c = map(np.concatenate, (variants, members, close))
        order = np.argsort(v)
        v = v[order]
        same = np.zeros(len(v) + 1, bool)
        same[1:-1] = v[1:] == v[:-1]
        hit = same[1:] | same[:-1]
        v, m, c = v[hit], m[order[hit]], c[order[hit]]
        order = np.lexsort((m, ~c, v))
        v, m, c = v[order], m[order], c[order]
        first = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]])[: len(v)])
        head = np.repeat(first, np.diff(np.append(first, len(v))))
        pairs = np.stack([m[head], m], 1)[c[head] & (m[head] != m)]
        pairs = pairs[np.bitwise_count(pairs[:, 0] ^ pairs[:, 1]) <= distance]
        out.append(np.unique(pairs, axis=0))
    pairs = np.unique(np.concatenate(out), axis=0)
    return np.ascontiguousarray(pairs[:, 0]), np.ascontiguousarray(pairs[:, 1])


def near_duplicates(docs: DataFrame, shingle: int = 3, distance: int = 3, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """(id, fp, component_id): the smallest id reachable by links of at most ``distance`` bits.

    Null and empty texts share fingerprint 0 and link like any other. A row is judged by its own text: rows that
    share an id may lie in different components, and repeated rows get the same result. Null ids come after all others:
    only a component without any other has a null component id. Ties do not occur: the component id is a minimum. An empty table gives no rows.
    """
    prints = stored(fingerprints(docs, shingle, id_col=id_col, text_col=text_col), "simhash-fp")
    reach = components(links(prints, distance))
    classes = prints.groupBy("fp").agg(F.min(id_col).alias("first"))
    classes = classes.join(reach, classes.fp == reach.node, "left").select(
        "fp", "first", F.coalesce("component", "fp").alias("component"))
    least = classes.groupBy("component").agg(F.min("first").alias("component_id"))
    classes = classes.join(least, "component").select("fp", "component_id")
    return prints.join(classes, "fp").select(id_col, "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, shingle: int = 3, distance: int = 3) -> DataFrame:
    """One row of each component, with all its columns: the one with the smallest id (then hash of the text).

    Rows are told apart by id and text, so a row goes only if it is near the one that stays, whatever ids the two have;
    a null id comes after all others. Rows equal in both count as one; which of them stays is open.
    """
    row = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", F.xxhash64("text").alias("text")).alias("row")
    found = near_duplicates(docs.select(row, "text"), shingle, distance, "row")
    first = found.filter("row = component_id").select("row").distinct()
    whole = docs.select(row, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    whole = whole.groupBy("row").agg(F.first("doc").alias("doc"))  # equal rows meet before the shuffle
    return whole.join(first, "row", "left_semi").select("doc.*")
