"""Cubes from one pass: the finest grouping is aggregated once, coarser ones are derived along the lattice."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basin.operators._common import as_list
from basin.operators.sketches import merged_columns, sketched_columns
from basin.session import scratch_path


def cube(df: DataFrame, dims, sums=(), least=(), most=(), distinct: str | None = None, values: str | None = None) -> DataFrame:
    """Every grouping of ``GROUP BY CUBE (dims)``: the dims (NULL where a grouping leaves them out), ``grouping_id`` (as Spark's
    and SQL's: the first dim is the highest bit, 1 where it is left out), ``n`` and the aggregates.

    ``sums``, ``least`` and ``most`` name columns to add up or take the minimum or maximum of (``sum_<c>``, ``min_<c>``,
    ``max_<c>``); ``distinct`` and ``values`` columns to keep sketches of, since distinct counts and quantiles of a coarser
    grouping do not follow from finer ones. Sum decimals where the result must not depend on the order of adding.

    The rows are read once, for the finest grouping. Each other grouping is an aggregate of the smallest
    grouping that has one dim more. Groupings are written under the shared scratch folder, so none is
    evaluated twice; what is read shrinks on the way down. A grouping's cells are combined in each task before the
    shuffle, so a cell with a third of all rows is no hot key. As in SQL, an empty table has only the grand total, with n 0.
    """
    dims = as_list(dims)
    base = scratch_path(df.sparkSession, "cube")
    renamed = [(F.sum, "sum_", c) for c in as_list(sums)] + [(F.min, "min_", c) for c in as_list(least)] + [
        (F.max, "max_", c) for c in as_list(most)]
    first = [f(c).alias(f"{name}{c}") for f, name, c in renamed]
    again = [f(f"{name}{c}").alias(f"{name}{c}") for f, name, c in renamed]

    def write(rows, group):
        path = f"{base}/{'-'.join(map(str, group)) or 'all'}"
        rows.write.parquet(path)
        table = df.sparkSession.read.schema(rows.schema).parquet(path)
        return table, table.count()  # from the files' footers

    finest = df.groupBy(*dims).agg(*first, *sketched_columns(distinct, values))
    made = {tuple(range(len(dims))): write(finest, tuple(range(len(dims))))}
    for size in range(len(dims) - 1, -1, -1):
        for group in combinations(range(len(dims)), size):
            parents = [made[p] for p in made if len(p) == size + 1 and set(group) < set(p)]
            parent = min(parents, key=lambda p: p[1])[0]
            made[group] = write(parent.groupBy(*[dims[i] for i in group]).agg(*again, *merged_columns(parent.columns)), group)

    def shaped(group, table):
        out = sum(1 << (len(dims) - 1 - i) for i in range(len(dims)) if i not in group)
        n = F.coalesce("n", F.lit(0).cast("bigint")).alias("n")
        rest = [c for c in table.columns if c not in dims and c != "n"]
        return table.select(*[F.col(d) if i in group else F.lit(None).cast(df.schema[d].dataType).alias(d) for i, d in enumerate(dims)],
                            F.lit(out).cast("bigint").alias("grouping_id"), n, *rest)

    return reduce(DataFrame.unionByName, [shaped(g, t) for g, (t, _) in made.items()])

