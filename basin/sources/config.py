"""Configuration files as tables: ``KEY="value"`` settings files and ``<property>`` XML files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basin.functions.text import strip_quotes
from basin.operators.lines import numbered_lines

PROPERTY_XML_SCHEMA = T.StructType([T.StructField("name", T.StringType()), T.StructField("value", T.StringType())])


def read_properties(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A10: ``(id, line_no, key, value)`` from settings texts.

    Blank lines and ``#`` comment lines are dropped, as are lines without ``=``. A line splits at
    its FIRST ``=``; the key is trimmed; the value is trimmed and one pair of surrounding quotes is
    removed. Repeated keys are all returned -- ``basin.operators.dispositions.last_wins`` by
    ``line_no`` gives what a shell that sources the file would see.
    """
    rows = df.select(F.col(id_col), F.inline(numbered_lines(text_col)))
    line = F.col("line")
    keep = ~line.rlike("^[ \\t]*(#|$)") & (F.instr(line, "=") > 0)
    eq = F.instr(line, "=")
    key = F.trim(line.substr(F.lit(1), eq - 1))
    value = strip_quotes(F.trim(line.substr(eq + 1, F.length(line) + 1)))
    return rows.where(keep).select(F.col(id_col), F.col("line_no").cast("long").alias("line_no"),
                                   key.alias("key"), value.alias("value"))


def read_properties_files(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """A10 over files: ``(file, line_no, key, value)``. Each settings file is read whole (one row per
    file), which suits many small files; files are spread over tasks."""
    df = (spark.read.option("recursiveFileLookup", str(recursive).lower())
          .text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value")))
    return read_properties(df, "file", "value")


def read_property_xml(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """``(file, name, value)`` from ``<configuration><property><name/><value/></property>`` files.

    Names and values are trimmed (multi-line and padded values included). Read with a fixed
    string schema, so ``<value>3</value>`` stays the string ``'3'``.
    """
    df = (spark.read.format("xml").option("rowTag", "property").option("recursiveFileLookup", str(recursive).lower())
          .schema(PROPERTY_XML_SCHEMA).load(path))
    return df.select(F.col("_metadata.file_path").alias("file"), F.trim(F.col("name")).alias("name"),
                     F.trim(F.col("value")).alias("value"))


def write_property_xml(df: DataFrame, path: str, name: str = "name", value: str = "value",
                       partition_by=None, mode: str = "errorifexists") -> None:
    """Write ``(name, value)`` rows as property XML files (one ``<configuration>`` per file)."""
    cols = [F.col(name).cast("string").alias("name"), F.col(value).cast("string").alias("value")]
    extra = [F.col(p) for p in (partition_by or [])]
    w = (df.select(*cols, *extra).write.format("xml").option("rootTag", "configuration")
         .option("rowTag", "property").mode(mode))
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)
