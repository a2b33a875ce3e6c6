"""Catalog tables: databases, published tables with comments, properties and partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basin.operators._common import as_list

# fixed values: metastore column widths the warehouse schema declares
COLUMN_COMMENT_MAX = 256
PARTITION_VALUE_MAX = 256
PARTITION_KEY_COMMENT_MAX = 4000
DATABASE_COMMENT_MAX = 4000
PROPERTY_VALUE_MAX = 4000


def sql_string(s: str) -> str:
    """A Spark SQL string literal."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def quote_ident(name: str) -> str:
    return ".".join("`" + p.replace("`", "``") + "`" for p in name.split("."))


def ensure_database(spark: SparkSession, name: str, comment: str | None = None,
                    location: str | None = None) -> bool:
    """A3: create database ``name`` only if it is not there. Returns True when it was created."""
    if comment is not None and len(comment) > DATABASE_COMMENT_MAX:
        raise ValueError(f"database comment longer than {DATABASE_COMMENT_MAX} characters")
    if spark.catalog.databaseExists(name):
        return False
    ddl = f"CREATE DATABASE IF NOT EXISTS {quote_ident(name)}"
    if comment is not None:
        ddl += f" COMMENT {sql_string(comment)}"
    if location is not None:
        ddl += f" LOCATION {sql_string(location)}"
    spark.sql(ddl)
    return True


def _plain_type(dt) -> str:
    """DDL type of a column, with collations dropped at any depth (a collation would travel into the files)."""
    from pyspark.sql import types as T
    if isinstance(dt, T.StringType):
        return "string"
    if isinstance(dt, T.ArrayType):
        return f"array<{_plain_type(dt.elementType)}>"
    if isinstance(dt, T.MapType):
        return f"map<{_plain_type(dt.keyType)},{_plain_type(dt.valueType)}>"
    if isinstance(dt, T.StructType):
        return "struct<" + ",".join(f"{quote_ident(f.name)}:{_plain_type(f.dataType)}" for f in dt.fields) + ">"
    return dt.simpleString()


def publish_table(df: DataFrame, name: str, partition_by=None, comments: dict | None = None,
                  properties: dict | None = None, table_comment: str | None = None,
                  path: str | None = None, fmt: str = "parquet", mode: str = "overwrite") -> DataFrame:
    """A2: write ``df`` as catalog table ``name`` with partitions, comments and properties.

    The table is declared once (``CREATE TABLE ... COMMENT ... PARTITIONED BY ... TBLPROPERTIES``)
    and filled with ``insertInto``. Length rules of the metastore are enforced: column comments
    <= 256 characters (4000 for a partition key), property values <= 4000, partition values <= 256
    -- the last one by the write itself (``raise_error`` in the projection), so no separate pass
    over the data runs. Non-ASCII comments are stored as they are. ``mode='overwrite'`` on a
    partitioned table replaces only the partitions present in ``df``; ``append`` adds rows. Spark has no
    such choice for one ``insertInto``, so ``spark.sql.sources.partitionOverwriteMode`` is set for the write and
    put back after it: publish from concurrent threads in sessions of their own (``spark.newSession()``).
    Returns the table.
    """
    spark = df.sparkSession
    parts = as_list(partition_by)
    comments = comments or {}
    properties = dict(properties or {})
    if mode not in ("overwrite", "append"):
        raise ValueError("mode must be overwrite or append")
    for c, text in comments.items():
        if c not in df.columns:
            raise ValueError(f"comment for unknown column {c!r}")
        limit = PARTITION_KEY_COMMENT_MAX if c in parts else COLUMN_COMMENT_MAX
        if len(text) > limit:
            raise ValueError(f"comment on {c!r} longer than {limit} characters")
    for k, v in properties.items():
        if len(str(v)) > PROPERTY_VALUE_MAX:
            raise ValueError(f"property {k!r} longer than {PROPERTY_VALUE_MAX} characters")
    if table_comment is not None and len(table_comment) > PROPERTY_VALUE_MAX:
        raise ValueError(f"table comment longer than {PROPERTY_VALUE_MAX} characters")
    data_cols = [c for c in df.columns if c not in parts]
    ordered = data_cols + parts  # insertInto is positional: partition columns last
    out = df.select(*[F.col(c).cast(_plain_type(df.schema[c].dataType)).alias(c) for c in ordered])
    for p in parts:
        too_long = F.char_length(F.col(p).cast("string")) > PARTITION_VALUE_MAX
        out = out.withColumn(p, F.when(too_long, F.raise_error(
            F.lit(f"partition value of {p} longer than {PARTITION_VALUE_MAX} characters"))).otherwise(F.col(p)))
    if parts:  # a partition's rows meet in few tasks, a hot one is split: no tasks x partitions files
        out = out.hint("rebalance", *[F.col(p) for p in parts])
    ident = quote_ident(name)
    if not spark.catalog.tableExists(name):
        cols = []
        for c in ordered:
            col = f"{quote_ident(c)} {_plain_type(df.schema[c].dataType)}"
            if c in comments:
                col += f" COMMENT {sql_string(comments[c])}"
            cols.append(col)
        ddl = f"CREATE TABLE {ident} ({', '.join(cols)}) USING {fmt}"
        if parts:
            ddl += f" PARTITIONED BY ({', '.join(quote_ident(p) for p in parts)})"
        if table_comment is not None:
            ddl += f" COMMENT {sql_string(table_comment)}"
        if path:
            ddl += f" LOCATION {sql_string(path)}"
        if properties:
            ddl += " TBLPROPERTIES (" + ", ".join(
                f"{sql_string(str(k))} = {sql_string(str(v))}" for k, v in properties.items()) + ")"
        spark.sql(ddl)
    else:
        for c, text in comments.items():
            if c not in parts:
                spark.sql(f"ALTER TABLE {ident} ALTER COLUMN {quote_ident(c)} COMMENT {sql_string(text)}")
        if table_comment is not None:
            properties["comment"] = table_comment
        if properties:
            kv = ", ".join(f"{sql_string(str(k))} = {sql_string(str(v))}" for k, v in properties.items())
            spark.sql(f"ALTER TABLE {ident} SET TBLPROPERTIES ({kv})")
    key = "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(key, None)
    if parts:
        spark.conf.set(key, "dynamic")
    try:
        out.write.insertInto(name, overwrite=(mode == "overwrite"))
    finally:
        if parts:
            if before is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, before)
    return spark.table(name)
