"""Toxicity scores by a factorization machine over hashed terms.

A text's terms are its distinct words and the words' five-letter beginnings (inflected insults share
them), hashed into ``2 ** BITS`` slots. Its score is

    sigmoid(b + sum_i w_i + 1/2 (|sum_i v_i|^2 - sum_i |v_i|^2)),

so a pair of terms, such as an insult and a mention of a group, weighs v_i . v_j more than its
parts. Weights are fitted by rounds of proximal AdaGrad: every partition of the training rows makes
a few passes from the shared weights, and the driver averages the partitions' weights (a fixed size).
Only slots whose share of documents differs between the labels by at least ``SCREEN`` standard errors
in the training rows (counted by Spark) have weights, so the many other words of a long text add no
noise.

A round's state is the intercept and the screened slots' weights, whatever the number of tasks.

Training rows: at most ``max_rows`` of the labelled rows outside the held-out fold for each label
(``MAX_ROWS``), picked by a hash of the id, weighted back to the label's share. Scoring covers every
text whole, in the task that scans it, without a shuffle.

Edge cases: null and empty texts have no terms and get the score of the intercept; labels that are
null are ignored; a document labelled twice counts with its larger label; without labelled rows all
scores are 0.5, with rows of one label only all lean to it; other columns are ignored, and id, language and source are never inputs.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from basin.llm._common import hash_bucket, held_out, stored, worker_cache

BITS = 18
FACTORS = 6
MAX_ROWS = 12_000
ROUNDS = 12
PARTS = 6
PASSES = 3
BATCH = 64
RATE, L1, L1_PAIRS = 0.3, 2e-4, 1e-4
SCREEN = 4.0
PREFIX = 5
CACHE_WORDS = 200_000


class _Slots(dict):
    """Word -> its slots."""

    def __missing__(self, word):
        if len(self) > CACHE_WORDS:
            self.clear()
        found = [zlib.crc32(word.encode("utf-8", "surrogatepass")) & (1 << BITS) - 1]
        if len(word) > PREFIX:
            found.append(zlib.crc32(b"^" + word[:PREFIX].encode("utf-8", "surrogatepass")) & (1 << BITS) - 1)
        got = self[word] = tuple(found)
        return got


def _terms(text, slots, words=re.compile(r"\w+")) -> np.ndarray:
    """Distinct slots of a whole text, ascending."""
    found: set = set()
    for w in set(words.findall((text or "").lower())):
        found.update(slots[w])
    return np.fromiter(sorted(found), np.int32, len(found))


class Weights:
    """Intercept, and linear weight and factors of the screened slots."""

    def __init__(self, slots, b=0.0, w=None, v=None):
        n = len(slots)
        self.slots, self.b = np.asarray(slots, np.int32), float(b)
        self.w = np.zeros(n) if w is None else w
        self.v = np.random.default_rng(7).normal(0, 0.05, (n, FACTORS)) if v is None else v
        self.place = np.full(1 << BITS, -1, np.int32)
        self.place[self.slots] = np.arange(n)

    def numbers(self) -> np.ndarray:
        return np.concatenate([[self.b], self.w, self.v.ravel()])

    @classmethod
    def of(cls, slots, numbers: np.ndarray) -> Weights:
        n = len(slots)
        return cls(slots, numbers[0], numbers[1:n + 1].copy(), numbers[n + 1:].reshape(n, FACTORS).copy())

    def places(self, slots: np.ndarray) -> np.ndarray:
        """Places of a row's screened slots."""
        found = self.place[slots]
        return found[found >= 0]

    def margins(self, rows: list[np.ndarray]):
        """b + linear + pairwise part of each row of places, and what the gradient needs."""
        lens = np.array([len(r) for r in rows], np.int64)
        at = np.concatenate([[0], np.cumsum(lens)])
        places = np.concatenate([np.zeros(0, np.int32), *rows])
        add = lambda x: np.diff(np.concatenate([np.zeros((1, *x.shape[1:])), np.cumsum(x, 0)])[at], axis=0)
        v = self.v[places]
        sums = add(v)
        return self.b + add(self.w[places]) + 0.5 * ((sums ** 2).sum(1) - add((v ** 2).sum(1))), lens, places, sums, v


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _train(weights: Weights, rows, labels, importance, seed) -> Weights:
    """Passes of proximal AdaGrad over one part of the training rows."""
    gw, gv, gb = np.full(len(weights.w), 1e-2), np.full(weights.v.shape, 1e-2), 1e-2
    shuffled = np.random.default_rng(seed)
    order = np.concatenate([shuffled.permutation(len(rows)) for _ in range(PASSES)])
    for at in range(0, len(order), BATCH):
        k = order[at:at + BATCH]
        margin, lens, places, sums, v = weights.margins([rows[i] for i in k])
        err = importance[k] * (_sigmoid(margin) - labels[k]) / importance.mean()
        e = np.repeat(err, lens)
        touched, inverse = np.unique(places, return_inverse=True)
        grad = np.bincount(inverse, e, len(touched)) / len(k)
        pair = e[:, None] * (np.repeat(sums, lens, axis=0) - v) / len(k)
        pairs = np.stack([np.bincount(inverse, pair[:, f], len(touched)) for f in range(FACTORS)], 1)
        gw[touched] += grad ** 2
        gv[touched] += pairs ** 2
        step, steps = RATE / np.sqrt(gw[touched]), RATE / np.sqrt(gv[touched])
        w = weights.w[touched] - step * grad
        weights.w[touched] = np.sign(w) * np.maximum(0, np.abs(w) - step * L1)
        x = weights.v[touched] - steps * np.clip(pairs, -1, 1)
        weights.v[touched] = np.sign(x) * np.maximum(0, np.abs(x) - steps * L1_PAIRS)
        g = err.mean()
        gb += g * g
        weights.b -= RATE / np.sqrt(gb) * g
    return weights


def training_rows(docs: DataFrame, labels: DataFrame, label: str, max_rows: int = MAX_ROWS) -> DataFrame:
    """(doc_id, text, label, importance): at most about ``max_rows`` rows of each label."""
    known = (labels.filter(~held_out() & F.col(label).isNotNull()).groupBy("doc_id")
             .agg(F.max(F.col(label).cast("int")).alias("label")))
    shares = {r.label: min(1.0, max_rows / r["count"]) for r in known.groupBy("label").count().collect()}
    share = F.lit(0.0)
    for value, kept in shares.items():
        share = F.when(F.col("label") == value, F.lit(kept)).otherwise(share)
    pick = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    picked = known.withColumn("share", share).filter(pick < F.col("share")).select(
        F.col("doc_id").alias("labelled_id"), "label", (1 / F.nullif(F.col("share"), F.lit(0.0))).alias("importance"))
    return docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("labelled_id")).select(
        "doc_id", "text", "label", "importance")


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: int = MAX_ROWS,
        rounds: int = ROUNDS) -> Weights:
    """The fitted weights."""
    def hashed(batches):
        cache = _Slots()
        for b in batches:
            terms = pa.array([_terms(t.as_py(), cache) for t in b.column(1)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), terms, b.column(2), b.column(3)],
                                             ["doc_id", "slots", "label", "importance"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = stored(training_rows(docs, labels, label, max_rows).mapInArrow(
        hashed, f"doc_id {kind}, slots array<int>, label int, importance double"), "toxicity-rows")
    sizes = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    if not sizes:
        return Weights([])
    if len(sizes) < 2:
        return Weights([], b=10.0 if 1 in sizes else -10.0)
    weights = Weights(_screened(rows, sizes))
    sc = rows.sparkSession.sparkContext
    slots = weights.slots

    def screened(batches):
        model = Weights(slots)
        for b in batches:
            places = pa.array([model.places(x.values.to_numpy(zero_copy_only=False)) for x in b.column(1)],
                              pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), places, b.column(2), b.column(3)],
                                             ["doc_id", "places", "label", "importance"])

    rows = stored(rows.mapInArrow(screened, f"doc_id {kind}, places array<int>, label int, importance double")
                  .withColumn("part", hash_bucket(F.col("doc_id"), PARTS)), "toxicity-places")
    for r in range(rounds):
        fitted = rows.groupBy("part").applyInArrow(_round(sc.broadcast((slots, weights.numbers())), r),
                                                   "part int, n bigint, numbers binary")
        parts = sorted(fitted.collect())  # PARTS rows, each the size of the weights
        total = sum(p.n for p in parts)
        weights = Weights.of(slots, sum(np.frombuffer(p.numbers) * (p.n / total) for p in parts))
    return weights


def _round(start, seed):
    def one_round(part: pa.Table) -> pa.Table:
        part = part.sort_by("doc_id")
        places = [x.values.to_numpy(zero_copy_only=False) for x in part["places"]]
        fitted = _train(Weights.of(*start.value), places, part["label"].to_numpy(), part["importance"].to_numpy(), seed)
        return pa.table({"part": part["part"][:1], "n": pa.array([len(places)], pa.int64()),
                         "numbers": pa.array([fitted.numbers().tobytes()], pa.binary())})
    return one_round


def _screened(rows, sizes) -> list[int]:
    """Slots whose document share differs between the labels; there are 2 ** BITS slots in all."""
    (n0, n1), pos = (sizes[0], sizes[1]), F.sum("label")
    share0, share1 = (F.count("*") - pos) / n0, pos / n1
    both = F.count("*") / (n0 + n1)
    error = F.sqrt(both * (1 - both) * (1 / n0 + 1 / n1) + 1e-12)
    found = rows.select("label", F.explode("slots").alias("slot")).groupBy("slot").agg(
        (F.abs(share1 - share0) / error).alias("z")).filter(F.col("z") >= SCREEN).select("slot").collect()
    return sorted(r.slot for r in found)


def score(docs: DataFrame, weights: Weights, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every whole text."""
    sent = docs.sparkSession.sparkContext.broadcast((weights.slots, weights.numbers()))

    def run(batches):
        model, slots = Weights.of(*sent.value), worker_cache("toxicity").setdefault("slots", _Slots())
        for b in batches:
            rows = [model.places(_terms(t.as_py(), slots)) for t in b.column(1)]
            scores = _sigmoid(model.margins(rows)[0])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64())], [id_col, "score"])

    out = StructType([docs.schema[id_col], StructField("score", DoubleType())])
    return docs.select(id_col, text_col).mapInArrow(run, out)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    return score(docs, fit(docs, labels)).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows predicted clean, with all their columns, in the order they are read. Each row is judged by its own
    text, whatever its id; ids that are null or repeated make no difference."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    scored = score(docs.select(whole.alias("doc"), "text"), fit(docs, labels), "doc")
    return scored.filter(F.col("score") < threshold).select("doc.*")
