"""Soft-membership mixing of a corpus to target domain weights.

DataFrame operations only. A naive Bayes classifier kept as a table of log-likelihoods (domain,
feature, bin), learned by Spark aggregations from the labelled rows, gives every document its domain
posteriors p_dk. Document rates r_d >= 0 are then fitted by least squares so that the expected token
total of each domain, sum_d n_d r_d p_dk, matches its target T_k:

    minimise  sum_k (sum_d n_d r_d p_dk - T_k)^2 / (2 M_k),   M_k = sum_d n_d p_dk.

By projected gradient with lazy projection: the gradient of a rate is n_d sum_k p_dk (total_k - T_k) / M_k, a
combination of the document's posteriors, so the steps of all documents add up in one vector v with a number for each
domain, and the rates are the projection of the moved ones to zero and more: r_d = max(0, 1 + sum_k p_dk v_k). A step is taken in the
metric of the K x K Gram matrix of the documents with a rate above zero, as far as the line search along v allows (a form
that projects each step by itself had not ended after 80 steps of two sums where this one takes 16 sums). It is one
map-side combined sum of the domains' totals and the Gram matrix, the only things that reach the driver. Of the rates that
reach the targets these are the nearest to one (token-weighted squares). A rate depends on its document's
posteriors only, so documents are first added up by equal posteriors; posteriors are rounded to four decimals.

The fit ends when every total is within ``CLOSE`` of its target, or, where targets cannot be met, when the
distance left is proven to be within ``CLOSE`` of the least possible: for y with sum_k p_dk y_k >= 0 for all
documents no rates come nearer than -sum_k T_k y_k / sqrt(sum_k M_k y_k^2). What was reached is returned
(``fitted``), and unmet targets give a warning. A fit that reaches neither raises.

Features: bins of length, word length, symbols, upper case, distinct words, line breaks, and, per domain,
of the number of its telling word beginnings the text has (chosen from a bounded sample: at most ``sample_rows``
labelled documents of each domain). Tokens are blank-separated words.

Edge cases: null and empty texts have no tokens, do not count in any total and still get a rate; null labels and
labels of unknown documents are ignored; a document with several labels counts for each; without
labelled rows posteriors equal the targets' shares and rates are equal; a domain without mass cannot
be raised (its residual stays); targets are scaled to sum to one.
"""

from __future__ import annotations

import math
import random
import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basin.llm._common import drop_stored, stored

SAMPLE_ROWS = 3_000
LEXICON = 150
STEM = 5
CLOSE = 1e-4
#: Sums of a fit; one that needs more raises.
MAX_STEPS = 1_000
#: Weight of the proximal term that keeps a step bounded, at first and at last.
NEAR, NEAREST = 1e-8, 1e-12
BINS = 12


def _stems(text: str) -> Column:
    """Distinct word beginnings, lower case."""
    words = F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), "[ \t\n\r]+")
    return F.array_distinct(F.transform(words, lambda w: F.substring(w, 1, STEM)))


def statistics(docs: DataFrame, lexicons: dict[str, list[str]], id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_tokens, bins): one bin 0..BINS-1 for each feature of the whole text."""
    t = F.coalesce(F.col(text), F.lit(""))
    without = lambda letters: F.length(F.translate(t, letters, ""))
    base = docs.select(
        F.col(id_col).alias(id_col), F.length(t).alias("chars"), _stems(text).alias("stems"),
        F.size(F.filter(F.split(t, "[ \t\n\r]+"), lambda w: w != "")).alias("words"),
        without("#$%&*!|<>{}=").alias("plain"), without("ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("not_upper"),
        without("\n").alias("not_breaks"))
    chars, words = F.greatest(F.col("chars"), F.lit(1)), F.greatest(F.col("words"), F.lit(1))
    share = lambda part: 1 - F.col(part) / chars
    steps = lambda x, scale: F.least(F.lit(BINS - 1), F.greatest(F.lit(0), F.floor(x * scale))).cast("int")
    log = lambda x: F.log2(1 + x)
    features = [steps(log(F.col("chars")), 0.7), steps(F.col("chars") / words, 1.0),
                steps(log(share("plain") * 1000), 1.2), steps(log(share("not_upper") * 1000), 1.2),
                steps(F.size("stems") / words, 11.0), steps(log(share("not_breaks") * 1000), 1.2)]
    features += [steps(F.size(F.array_intersect("stems", F.array(*map(F.lit, stems)).cast("array<string>"))), 1.0)
                 for _, stems in sorted(lexicons.items())]
    return base.select(id_col, F.col("words").cast("bigint").alias("n_tokens"), F.array(*features).alias("bins"))


def lexicons(docs: DataFrame, labelled: DataFrame, domains: list[str], id_col: str = "doc_id", text: str = "text",
             sample_rows: int = SAMPLE_ROWS) -> dict[str, list[str]]:
    """For each domain its LEXICON word beginnings with the largest share difference to the other domains."""
    counts = {r.domain: r["count"] for r in labelled.groupBy("domain").count().collect()}
    share = F.lit(0.0)
    for d, n in counts.items():
        share = F.when(F.col("domain") == d, F.lit(min(1.0, sample_rows / n))).otherwise(share)
    picked = labelled.filter(F.pmod(F.xxhash64(id_col), F.lit(1 << 30)) / float(1 << 30) < share)
    rows = docs.select(F.col(id_col).alias("_id"), text).join(
        F.broadcast(picked.select(F.col(id_col).alias("_id"), "domain")), "_id").select("domain", _stems(text).alias("s"))
    rows = stored(rows, "mixing-sample")
    sizes = {r.domain: r["count"] for r in rows.groupBy("domain").count().collect()}
    by_stem = rows.select("domain", F.explode("s").alias("stem")).filter("stem <> ''").groupBy("stem").agg(
        *[F.sum((F.col("domain") == d).cast("int")).alias(f"n{k}") for k, d in enumerate(domains)])
    by_stem = stored(by_stem, "mixing-stems")
    out = {}
    for k, d in enumerate(domains):
        rest = [(j, sizes.get(o, 0)) for j, o in enumerate(domains) if j != k and sizes.get(o)]
        if not sizes.get(d) or not rest:
            out[d] = []
            continue
        own = F.col(f"n{k}") / sizes[d]
        others = F.greatest(*[F.col(f"n{j}") / n for j, n in rest], F.lit(0.0))
        score = (own - others) / F.sqrt((own + others) / sizes[d] + 1e-9)
        found = by_stem.select("stem", score.alias("z")).filter("z > 4").orderBy(F.desc("z"), "stem").limit(LEXICON)
        out[d] = sorted(r.stem for r in found.collect())
    return out


def classifier(stats: DataFrame, labelled: DataFrame, domains: list[str], id_col: str = "doc_id") -> list[Column]:
    """Posterior of each domain as a Column over ``bins``, from the labelled rows."""
    rows = stats.join(labelled.select(id_col, "domain"), id_col).select("domain", "bins")
    seen = rows.select("domain", F.posexplode("bins").alias("feature", "bin")).groupBy(
        "domain", "feature", "bin").count().collect()  # features x bins x domains rows at most
    totals: dict = {}
    table: dict = {}
    for r in seen:
        table[r.domain, r.feature, r.bin] = r["count"]
        if r.feature == 0:
            totals[r.domain] = totals.get(r.domain, 0) + r["count"]
    everyone = sum(totals.values())
    if not everyone:
        return [F.lit(1.0 / len(domains)) for _ in domains]
    n_features = 1 + max(r.feature for r in seen)
    logs = []
    for d in domains:
        n = totals.get(d, 0)
        if not n:
            logs.append(None)
            continue
        score = F.lit(math.log(n / everyone))
        for f in range(n_features):
            row = [math.log((table.get((d, f, b), 0) + 0.5) / (n + 0.5 * BINS)) for b in range(BINS)]
            score = score + F.element_at(F.array(*map(F.lit, row)), F.element_at("bins", f + 1) + 1)
        logs.append(score)
    top = F.greatest(*[s for s in logs if s is not None], F.lit(-1e9)) if len(logs) > 1 else logs[0]
    weights = [F.exp(s - top) if s is not None else F.lit(0.0) for s in logs]
    total = sum(weights[1:], weights[0])
    return [F.round(w / total, 4) for w in weights]


def _rate(v: list[float]) -> Column:
    """The rate at ``v`` of a document with posteriors ``p``."""
    return F.greatest(F.lit(0.0), sum((F.element_at("p", j + 1) * F.lit(float(x)) for j, x in enumerate(v)), F.lit(1.0)))


def _solve(a: list[list[float]], b: list[float]) -> list[float]:
    """x with a x = b, by elimination with row exchanges."""
    n, rows = len(b), [[*r, x] for r, x in zip(a, b)]
    for i in range(n):
        j = max(range(i, n), key=lambda j: abs(rows[j][i]))
        rows[i], rows[j] = rows[j], rows[i]
        for j in range(i + 1, n):
            m = rows[j][i] / rows[i][i]
            rows[j] = [x - m * y for x, y in zip(rows[j], rows[i])]
    x = [0.0] * n
    for i in reversed(range(n)):
        x[i] = (rows[i][n] - sum(rows[i][j] * x[j] for j in range(i + 1, n))) / rows[i][i]
    return x


def _dot(a, b) -> float:
    return sum(x * y for x, y in zip(a, b))


def fit_rates(groups: DataFrame, targets: list[float], budget: float | None = None,
              max_steps: int = MAX_STEPS) -> tuple[Column, dict]:
    """The rate as a Column over ``p``, and what was fitted: ``mass``, ``goal`` and ``total`` of every domain,
    ``met``, and ``steps``, the sums made.

    ``groups`` has (p, n). ``budget`` is the wanted total in tokens; by default the total at which the domain
    with the largest target keeps what it has, so its documents stay near rate one, domains above their
    target are thinned and domains below it are repeated.
    """
    shares = [t / sum(targets) for t in targets]
    groups = groups.filter("n > 0")  # others count in no total
    steps = 0

    def sums(*columns):
        nonlocal steps
        steps += 1
        if steps > max_steps:
            raise RuntimeError(f"rates not fitted in {max_steps} sums: totals {total}, goals {goal}")
        return [float(x or 0.0) for x in groups.agg(*columns).first()]

    def at(v):
        """Totals of all domains, and the Gram matrix of those with mass."""
        r = _rate(v)
        p = [F.element_at("p", j + 1) for j in range(len(shares))]
        on = F.col("n") * (r > 0).cast("double")
        pairs = [(i, j) for i in live for j in live if j <= i]
        got = sums(*[F.sum(F.col("n") * r * x) for x in p], *[F.sum(on * p[i] * p[j]) for i, j in pairs])
        gram = {**dict(zip(pairs, got[len(p):])), **{(j, i): x for (i, j), x in zip(pairs, got[len(p):])}}
        return got[:len(p)], [[gram[i, j] for j in live] for i in live]

    live, total, goal = [], None, None
    v, mass = [0.0] * len(shares), sums(*[F.sum(F.col("n") * F.element_at("p", j + 1)) for j in range(len(shares))])
    live = [j for j, m in enumerate(mass) if m > 0]
    if budget is None:
        budget = max(((shares[j], mass[j] / shares[j]) for j in live if shares[j] > 0), default=(0.0, 0.0))[1]
    goal = [s * budget for s in shares]
    scale = [math.sqrt(mass[j]) for j in live]
    near, centre = NEAR, v
    total, gram = at(v) if live else (mass, [])
    while live and not all(abs(total[j] - goal[j]) <= CLOSE * max(goal[j], CLOSE * budget) for j in live):
        gradient = lambda total, v: [
            (total[j] - goal[j] + near * mass[j] * (v[j] - centre[j])) / m for j, m in zip(live, scale)]
        down = gradient(total, v)
        if sum(abs(x) * m for x, m in zip(down, scale)) <= 0.01 * CLOSE * sum(abs(total[j] - goal[j]) for j in live):
            y = [(total[j] - goal[j]) / mass[j] for j in live]
            far = math.sqrt(sum(mass[j] * x * x for j, x in zip(live, y)))
            least, ones = sums(F.min(sum((F.element_at("p", j + 1) * x for j, x in zip(live, y)), F.lit(0.0))),
                               F.min(sum((F.element_at("p", j + 1) for j in live), F.lit(0.0))))
            y = [x + max(0.0, -least) / max(ones, 1e-9) for x in y]
            if far <= (1 + CLOSE) * -_dot([goal[j] for j in live], y) / math.sqrt(sum(mass[j] * x * x for j, x in zip(live, y))):
                break  # no rates come nearer
            centre, near = v, max(near / 10, NEAREST)
            down = gradient(total, v)
        step = _solve([[x / scale[i] / scale[j] + near * (i == j) for j, x in enumerate(row)] for i, row in enumerate(gram)],
                      [-x for x in down])
        ahead = lambda t: [x + t * step[live.index(j)] / math.sqrt(mass[j]) if j in live else x  # noqa: B023, E731
                           for j, x in enumerate(v)]
        before, (found, found_gram) = _dot(down, step), at(ahead(1.0))
        after = _dot(gradient(found, ahead(1.0)), step)
        if after > 0.1 * abs(before):  # beyond the lowest point of the line: the slopes along it, in one sum
            parts = [2.0 ** -k for k in range(16, 0, -1)]
            along = sum((F.element_at("p", j + 1) * (x / m) for j, x, m in zip(live, step, scale)), F.lit(0.0))
            fixed = [_dot([-goal[j] + near * mass[j] * (ahead(t)[j] - centre[j]) for j in live],
                          [x / m for x, m in zip(step, scale)]) for t in parts]
            slopes = [before, *[x + c for x, c in zip(sums(*[F.sum(F.col("n") * _rate(ahead(t)) * along) for t in parts]), fixed)], after]
            parts = [0.0, *parts, 1.0]
            k = next(k for k, x in enumerate(slopes) if x > 0)
            t = parts[k - 1] + (parts[k] - parts[k - 1]) * slopes[k - 1] / (slopes[k - 1] - slopes[k])
            v = ahead(t)
            total, gram = at(v)
        else:
            v, total, gram = ahead(1.0), found, found_gram
    met = all(abs(a - g) <= CLOSE * max(g, CLOSE * budget) for a, g in zip(total, goal))
    return _rate(v), {"mass": mass, "goal": goal, "total": total, "met": met, "steps": steps}


def _fitted(stats, known, domains, targets, budget, id_col, *keep):
    """(id, n_tokens, p) of every document with the columns ``keep``, the rate over ``p``, and what was fitted."""
    posteriors = F.array(*classifier(stats, known, domains, id_col))
    members = stored(stats.select(id_col, "n_tokens", posteriors.alias("p"), *keep), "mixing-posteriors")
    groups = stored(members.groupBy("p").agg(F.sum("n_tokens").alias("n")), "mixing-groups")
    rate, fitted = fit_rates(groups, [targets[d] for d in domains], budget)
    drop_stored(groups)
    if not fitted["met"]:
        warnings.warn("targets cannot be met: " + ", ".join(
            f"{d} {a:.0f} of {g:.0f} tokens" for d, a, g in zip(domains, fitted["total"], fitted["goal"])), stacklevel=3)
    return members, rate, fitted


def _labelled(labelled, targets, id_col):
    domains = sorted(targets)
    return domains, labelled.filter(F.col("domain").isin(domains)).select(id_col, "domain").distinct()


def document_rates(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], budget: float | None = None,
                   id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_tokens, p_<domain>..., rate) of every document.

    ``labelled`` has (id, domain); ``targets`` maps each domain to its weight. The frame's ``fitted`` tells the
    totals wanted and reached (domains in order of their names).
    """
    domains, known = _labelled(labelled, targets, id_col)
    words = lexicons(docs, known, domains, id_col, text)
    stats = stored(statistics(docs, words, id_col, text), "mixing-stats")
    members, rate, fitted = _fitted(stats, known, domains, targets, budget, id_col)
    drop_stored(stats)
    out = members.select(id_col, "n_tokens", *[
        F.element_at("p", j + 1).alias(f"p_{d}") for j, d in enumerate(sorted(targets))], rate.alias("rate"))
    out.fitted = fitted
    return out


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], seed: int = 11, repeat: bool = True) -> DataFrame:
    """The documents drawn with their whole rates: floor(rate) copies, or one more. Without ``repeat`` all rates
    are divided by the largest, which keeps the shares and repeats nothing. Documents without tokens are kept once.

    Each row is drawn with the rate of its own text, by ``systematic``: along the rows in the order of their
    (coarse) posteriors and tokens, copies keep step with the sum of rates, so the drawn tokens of a domain differ from the fitted
    ones by no more than about one document. The draw follows from ``seed`` and the order in which equal rows
    (posteriors and tokens) are read. Documents are written once with their statistics, and joined to their draws.
    """
    domains, known = _labelled(labelled, targets, "doc_id")
    words = lexicons(docs, known, domains)
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), "text")
    stats = stored(statistics(whole, words, "doc").select("*", F.monotonically_increasing_id().alias("row")), "mixing-docs")
    members, rate, _ = _fitted(stats.select(F.col("doc.doc_id").alias("doc_id"), "n_tokens", "bins", "row"), known, domains,
                               targets, None, "doc_id", "row")
    most = 1.0 if repeat else max(1.0, members.filter("n_tokens > 0").agg(F.max(rate)).first()[0] or 1.0)
    draws = systematic(members.filter("n_tokens > 0").select("row", (rate / most).alias("rate"), coarse(F.col("p")), "n_tokens"), seed)
    draws = draws.union(members.filter("n_tokens = 0").select("row", F.lit(1).cast("bigint")))
    copies = F.array_repeat(F.lit(0), F.col("copies").cast("int"))
    return stats.select("row", "doc").join(draws.filter("copies > 0"), "row").select("doc", F.explode(copies)).select("doc.*")


def coarse(p: Column) -> Column:
    """Posteriors to one decimal: documents that are nearly of the same domains stand together, ordered by tokens."""
    return F.transform(p, lambda x: F.round(x, 1)).alias("p")


def systematic(rows: DataFrame, seed: int) -> DataFrame:
    """(row, copies) of (row, rate, order...): along the rows in the given order, copies = floor(S + u) - floor(S' + u),
    where S is the sum of rates up to the row, S' the one before it, and u a draw of the seed.

    Rates are taken in millionths, so sums are exact. Rows are numbered by ``row``; they are cut into slices of the order,
    so no task sees more than a slice, and the slices' sums (one row for each) are added up first.
    """
    order = [c for c in rows.columns if c not in ("row", "rate")] + ["row"]
    sliced = stored(rows.select("*", F.round(F.col("rate") * 1_000_000).cast("bigint").alias("r"))
                    .repartitionByRange(*order).withColumn("slice", F.spark_partition_id()), "mixing-slices")
    sums = sliced.groupBy("slice").agg(F.sum("r").alias("r"))
    before = sums.select("slice", F.coalesce(F.sum("r").over(Window.orderBy("slice").rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    upto = F.sum("r").over(Window.partitionBy("slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    start = random.Random(seed).randrange(1_000_000)
    placed = sliced.withColumn("upto", upto).join(F.broadcast(before), "slice").select(  # a row for each partition
        "row", "r", (F.col("before") + F.col("upto") + start).alias("s"))
    return placed.select("row", F.expr("s div 1000000 - (s - r) div 1000000").alias("copies"))


def thin(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], seed: int = 11) -> DataFrame:
    """``mix`` at the largest budget at which no rate exceeds one: documents are dropped, none is repeated."""
    return mix(docs, labelled, targets, seed, repeat=False)
