"""Small shared helpers for operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basin.session import scratch_path


def as_list(x) -> list:
    if x is None:
        return []
    if isinstance(x, (list, tuple)):
        return list(x)
    return [x]


def all_of(conds: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conds) if conds else F.lit(True)


def pick_one(df: DataFrame, keys, order, last: bool) -> DataFrame:
    """One row per ``keys``: the first (``last=False``) or last row by ``order``.

    Implemented as ``min``/``max`` of a struct whose leading fields are the order values and whose
    remaining fields are the other columns. A struct compares field by field, so ties on ``order``
    are broken by the row's own values and the result is deterministic. Being an aggregate, it is
    combined map-side before the shuffle: a key holding a third of all rows costs one small buffer
    per task, not one task holding a third of the data.
    Nulls in ``order`` sort lowest.
    """
    keys, order = as_list(keys), as_list(order)
    named, fields = [], []
    for i, o in enumerate(order):  # an order column travels once, as the leading field
        if isinstance(o, str) and o not in keys and o not in named:
            named.append(o)
            fields.append(F.col(o))
        else:
            fields.append((F.col(o) if isinstance(o, str) else o).alias(f"__o{i}"))
    rest = named + [c for c in df.columns if c not in keys and c not in named]
    s = F.struct(*fields, *[F.col(c) for c in rest[len(named):]])
    agg = (F.max(s) if last else F.min(s)).alias("__w")
    out = df.groupBy(*keys).agg(agg)
    return out.select(*[F.col(k) for k in keys], *[F.col("__w")[c].alias(c) for c in rest]).select(*df.columns)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written under the shared scratch folder: evaluated once, whoever reads it how often."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
