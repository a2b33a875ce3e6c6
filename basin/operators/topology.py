"""Lists and topology: comma lists, positional roles, ids, joined lists, prerequisites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basin.functions.text import quote_regex, to_col
from basin.operators._common import as_list
from basin.operators.ordering import dense_index


def split_list(col, sep: str = ",") -> Column:
    """``array<string>`` of the items of a delimited list.

    A trailing empty item (``'a,b,'``) is dropped, inner empty items stay (``'a,,b'`` has 3), and
    an empty string has no items -- as a shell splits a list into an array.
    """
    c = to_col(col)
    body = F.when(c.endswith(F.lit(sep)), c.substr(F.lit(1), F.length(c) - len(sep))).otherwise(c)
    return F.when(c == F.lit(""), F.array().cast("array<string>")).otherwise(F.split(body, quote_regex(sep), -1))


def explode_list(df: DataFrame, col: str, sep: str = ",", ordinal: str = "ordinal", item: str = "item") -> DataFrame:
    """One row per list item with its 0-based ordinal; other columns are kept."""
    keep = [c for c in df.columns if c != col]
    return df.select(*keep, F.posexplode(split_list(col, sep)).alias(ordinal, item)).withColumn(
        ordinal, F.col(ordinal).cast("long"))


def assign_roles(items: DataFrame, roles, ordinal: str = "ordinal", role: str = "role") -> DataFrame:
    """Role of each item by its ordinal; items beyond the role table get NULL.

    ``roles`` is a list of role names (index = ordinal) -- looked up in a literal array, no join --
    or a DataFrame ``(ordinal, role)``, joined left on the ordinal.
    """
    if isinstance(roles, (list, tuple)):
        arr = F.array(*[F.lit(r) for r in roles]).cast("array<string>")
        return items.withColumn(role, F.get(arr, F.col(ordinal).cast("int")))
    r = roles.select(F.col(ordinal).cast(items.schema[ordinal].dataType).alias(ordinal), F.col(role))
    return items.join(r, on=ordinal, how="left")


def assign_ids(df: DataFrame, group, order, base: int = 1, name: str = "id", slices: int | None = None) -> DataFrame:
    """D3: consecutive ids per group in ``order``, starting at ``base`` (1 for broker ids, 0 for suffixes)."""
    return dense_index(df, order=order, group=group, base=base, name=name, slices=slices)


def join_list(df: DataFrame, group, order, item, sep: str = ",", suffix: str = "", name: str = "list") -> DataFrame:
    """Per group, the items in ``order`` joined by ``sep``, with ``suffix`` after the last item only.

    ``item`` is a column name or a Column (e.g. ``concat(host, lit(':2181'))``). The whole group's
    list is built by one aggregate buffer, so use it for grouped lists of bounded length.
    """
    group = as_list(group)
    order = as_list(order)
    it = to_col(item)
    s = F.struct(*[(F.col(o) if isinstance(o, str) else o).alias(f"__o{i}") for i, o in enumerate(order)],
                 it.alias("__item"))
    items = F.transform(F.array_sort(F.collect_list(s)), lambda x: x["__item"])
    joined = F.array_join(items, sep)
    if suffix:
        joined = F.when(F.size(items) > 0, F.concat(joined, F.lit(suffix))).otherwise(joined)
    return df.groupBy(*group).agg(joined.alias(name))


def missing_prerequisites(requirements: DataFrame, present: DataFrame, item: str = "item",
                          need: str = "needs", with_list: bool = True) -> DataFrame:
    """For each item, how many required things are missing, which ones, and whether it is ready.

    Relational division: ``ready`` holds when every requirement of the item is present.
    ``present`` has the same two columns. A NULL need asks for nothing: it is not counted, and an item whose
    only needs are NULL is ready. Output: item, n_required, n_missing, [missing], ready.
    No join: both inputs are tagged and unioned, reduced per (item, need), then per item -- two
    aggregations Spark combines in each task before shuffling, so an item with a huge share of
    the rows is pre-reduced too. ``missing`` lists distinct needs, bounded by the requirement
    vocabulary.
    """
    req = requirements.select(F.col(item), F.col(need), F.lit(1).alias("__req"), F.lit(0).alias("__have"))
    have = present.select(F.col(item), F.col(need), F.lit(0).alias("__req"), F.lit(1).alias("__have"))
    have = have.where(F.col(need).isNotNull())
    pairs = (req.unionByName(have)
             .groupBy(item, need).agg(F.max("__req").alias("__req"), F.max("__have").alias("__have"))
             .where(F.col("__req") == 1))
    miss = (F.col("__have") == 0) & F.col(need).isNotNull()
    aggs = [F.count(need).alias("n_required"),
            F.sum(F.when(miss, 1).otherwise(0)).cast("long").alias("n_missing")]
    if with_list:
        aggs.append(F.array_sort(F.collect_set(F.when(miss, F.col(need)))).alias("missing"))
    out = pairs.groupBy(item).agg(*aggs)
    return out.withColumn("ready", F.col("n_missing") == 0)
