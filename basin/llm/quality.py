"""Quality scores: random Fourier features of document statistics, ridge regression, isotonic calibration.

Every document is described once by ``STATISTICS`` numbers over its whole text. cos(W x + b), with W drawn from a
normal distribution, approximates a Gaussian kernel over the standardised statistics. Each partition
of the training rows adds up its part of the normal equations (a matrix of fixed size); the driver sums the parts
and solves them. Raw scores of the training rows are counted in ``BINS`` equal bins by Spark and made
monotone by pooling adjacent violators; scores between bins are interpolated, so their order survives.

Training rows: at most about ``MAX_ROWS`` labelled rows outside the held-out fold, picked by a hash of the id. All
documents are scored. Only the statistics, not texts, are written and joined with labels.

Edge cases: null and empty texts have all-zero statistics and get that point's score; null labels are
ignored; a document labelled twice counts with its larger label; without labelled rows, or with one label
only, every score is the mean label (0.5 without rows); other columns are ignored, and id, language
and source are never inputs.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basin.llm._common import held_out, stored

STATISTICS = 18
FOURIER = 320
WIDTH = 5.0
RIDGE = 1e-4
MAX_ROWS = 60_000
PARTS = 8
BINS = 400
SEED = 17
CHARS_PER_SLICE = 2_000_000
_SYMBOLS = np.frombuffer(b"#$%&*!|<>{}=@^~\\", np.uint8)
_STOPS = np.frombuffer(b".,;:?", np.uint8)


def describe(text: str | None) -> np.ndarray:
    """The statistics of one whole text."""
    out = np.zeros(STATISTICS)
    if not text:
        return out
    raw = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    chars, words = len(text), text.split()
    n = max(1, len(words))
    counts = Counter(words)
    lines = [s for s in text.split("\n") if s.strip()]
    many = Counter(lines)
    repeats = sum(a == b for a, b in zip(words, words[1:]))
    pairs = len(set(zip(words, words[1:])))
    top = max(counts.values(), default=0)
    ends = sum(not w[-1].isalnum() for w in words)
    out[:] = [np.log1p(chars), np.log1p(len(words)), chars / n, raw[65:91].sum() / chars, raw[48:58].sum() / chars,
              raw[_SYMBOLS].sum() / chars, raw[_STOPS].sum() / n, np.log1p(raw[10]), len(counts) / n, top / n,
              repeats / n, pairs / n, ends / n, np.log1p(len(words) / max(1, len(lines))),
              1 - len(many) / max(1, len(lines)), sum(1 for w in counts if len(w) > 15) / n,
              raw[124] / n, raw[33] / n]
    return out


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, x): the statistics of every document."""
    def run(batches):
        for b in batches:
            rows = [describe(t.as_py()) for t in b.column(1)]
            flat = np.concatenate(rows) if rows else np.zeros(0)
            x = pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, STATISTICS, dtype=np.int32), flat)
            yield pa.RecordBatch.from_arrays([b.column(0), x], [id_col, "x"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, x array<double>")


def _table(column) -> np.ndarray:
    """The rows of a list column of equal lengths as a matrix."""
    return np.stack([r.values.to_numpy(zero_copy_only=False) for r in column])


class Features:
    """Standardised random Fourier features, with a constant."""

    def __init__(self, mean, std):
        rng = np.random.default_rng(SEED)
        self.mean, self.std = mean, np.where(std > 1e-12, std, 1.0)
        self.w = rng.normal(size=(STATISTICS, FOURIER)) / WIDTH
        self.b = rng.uniform(0, 2 * np.pi, FOURIER)

    def __call__(self, x):
        z = np.clip((x - self.mean) / self.std, -6, 6)
        return np.column_stack([np.ones(len(x)), np.sqrt(2 / FOURIER) * np.cos(z @ self.w + self.b)])


def fit(stats: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_ROWS):
    """A function from a matrix of statistics to scores in 0..1."""
    known = (labels.filter(~held_out() & F.col(label).isNotNull()).groupBy("doc_id")
             .agg(F.max(F.col(label).cast("double")).alias("y")))
    n = known.count()
    share = min(1.0, max_rows / max(1, n))
    picked = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30) < share)
    rows = stored(stats.join(picked, "doc_id").select("doc_id", "x", "y").repartition(PARTS, "doc_id"), "quality-rows")
    each = [F.element_at("x", i + 1) for i in range(STATISTICS)]
    sums = rows.agg(F.count("*").alias("n"), F.avg("y").alias("y"), *[F.avg(c) for c in each],
                    *[F.stddev_pop(c) for c in each]).first()
    mean_y = 0.5 if sums.y is None else float(sums.y)
    if mean_y in (0.0, 1.0) or sums.y is None:
        return lambda x: np.full(len(x), mean_y)
    features = Features(np.array(sums[2:2 + STATISTICS]), np.array(sums[2 + STATISTICS:]))

    def add_up(batches):
        gram, right = np.zeros((FOURIER + 1, FOURIER + 1)), np.zeros(FOURIER + 1)
        for b in batches:
            if b.num_rows:
                phi = features(_table(b.column("x")))
                gram += phi.T @ phi
                right += phi.T @ b.column("y").to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array([gram.tobytes()], pa.binary()), pa.array([right.tobytes()], pa.binary())],
                                         ["gram", "right"])

    parts = rows.mapInArrow(add_up, "gram binary, right binary").collect()  # one matrix per partition
    gram = sum(np.frombuffer(p.gram).reshape(FOURIER + 1, -1) for p in parts)
    right = sum(np.frombuffer(p.right) for p in parts)
    penalty = RIDGE * sums.n * np.eye(FOURIER + 1)
    penalty[0, 0] = 0
    beta = np.linalg.solve(gram + penalty, right)

    def raw(batches):
        for b in batches:
            if b.num_rows:
                s = np.clip(features(_table(b.column("x"))) @ beta, -0.5, 1.5)
                bins = np.minimum(BINS - 1, ((s + 0.5) / 2 * BINS).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(bins), b.column("y")], ["bin", "y"])

    counted = rows.mapInArrow(raw, "bin int, y double").groupBy("bin").agg(
        F.count("*").alias("n"), F.sum("y").alias("good")).orderBy("bin").collect()  # at most BINS rows
    at, value = _pool([(-0.5 + 2 * (r.bin + 0.5) / BINS, r.n, r.good) for r in counted])

    def scores(x):
        s = features(x) @ beta
        # the small slope keeps the order of raw scores inside a pooled stretch
        return np.clip(np.interp(s, at, value) * 0.999 + 0.001 * np.clip((s + 0.5) / 2, 0, 1), 0.0, 1.0)

    return scores


def _pool(bins):
    """Isotonic regression of bin means by pooling adjacent violators: places and values of the pools."""
    pools: list = []
    for at, n, good in bins:
        pools.append([at * n, n, good])
        while len(pools) > 1 and pools[-2][2] * pools[-1][1] >= pools[-1][2] * pools[-2][1]:
            a, n, good = pools.pop()
            pools[-1] = [pools[-1][0] + a, pools[-1][1] + n, pools[-1][2] + good]
    return np.array([p[0] / p[1] for p in pools]), np.array([p[2] / p[1] for p in pools])


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    stats = stored(statistics(docs), "quality-statistics")
    scores = fit(stats, labels)

    def run(batches):
        for b in batches:
            s = scores(_table(b.column(1))) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s)], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return stats.mapInArrow(run, f"doc_id {kind}, score double").select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
