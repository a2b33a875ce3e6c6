"""H1: parameterised SQL jobs over catalog tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from basin.sources.catalog import publish_table


def _is_view(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name) and spark.catalog.getTable(name).isTemporary


def sql_job(spark: SparkSession, sql: str, args: dict | None = None, target: str | None = None,
            views: dict | None = None, **publish) -> DataFrame:
    """Run ``sql`` with named parameters (``:name`` markers bound from ``args``, never pasted into
    the text) and optionally publish the result as table ``target`` (see ``publish_table``).

    ``views`` maps names to DataFrames the SQL reads as tables. They are temporary views only while the query
    is analysed: a view of the session with such a name is never replaced (that raises), none is left behind.
    """
    made = []
    try:
        for name, df in (views or {}).items():
            if _is_view(spark, name):
                raise ValueError(f"the session has a temporary view {name!r}; give the input another name")
            df.createTempView(name)
            made.append(name)
        result = spark.sql(sql, args=args or {})
    finally:
        for name in made:
            spark.catalog.dropTempView(name)
    if target:
        return publish_table(result, target, **publish)
    return result
