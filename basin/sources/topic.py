"""Topics: rows to key/value JSON records and back.

Spark's Kafka source/sink gives ``(key, value, topic, partition, offset, timestamp)`` rows; the
connector jar is not bundled here, so the source/sink name is an argument and the encode/decode
steps are usable (and tested) on their own, e.g. with the file source standing in for a topic.
Timestamps are written with microseconds (the JSON default keeps only milliseconds).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType, _parse_datatype_string

from basin.operators._common import as_list

# fixed values: timestamp formats that keep microseconds through JSON
JSON_OPTIONS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
                "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def encode_records(df: DataFrame, key, value_cols=None) -> DataFrame:
    """A8 encode step: ``(key string, value string)`` with the row as a JSON object in ``value``."""
    keys = as_list(key)
    vals = as_list(value_cols) or df.columns
    k = F.col(keys[0]).cast("string") if len(keys) == 1 else F.to_json(F.struct(*keys), JSON_OPTIONS)
    return df.select(k.alias("key"), F.to_json(F.struct(*vals), JSON_OPTIONS).alias("value"))


def decode_records(df: DataFrame, schema, keep=("key",), malformed: str | None = None) -> DataFrame:
    """A7 decode step: parse ``value`` (string or bytes) with ``schema`` into columns; ``keep`` columns stay.

    A null value (a deletion mark) gives a row of NULLs. A value that is no record of the schema does too, with its
    text in a column named by ``malformed``; without that name it is an error, so no record is lost unseen.
    """
    kept = [c for c in keep if c in df.columns]
    cols = [F.col(c).cast("string").alias(c) if c == "key" else F.col(c) for c in kept]
    text, own = F.col("value").cast("string"), "__malformed"
    schema = _parse_datatype_string(schema) if isinstance(schema, str) else schema
    fields = [f.name for f in schema.fields]
    with_raw = StructType([*schema.fields, StructField(own, StringType())])
    parsed = F.from_json(text, with_raw, JSON_OPTIONS | {"columnNameOfCorruptRecord": own}).alias("__v")
    rows = df.select(*cols, parsed).select(*kept, *[F.col(f"__v.`{c}`") for c in fields], F.col(f"__v.{own}"))
    if malformed:
        return rows.withColumnRenamed(own, malformed)
    bad = F.concat(F.lit("not a record of the topic's schema: "), F.substring(own, 1, 200))
    return rows.filter(F.when(F.col(own).isNotNull(), F.raise_error(bad).cast("boolean")).otherwise(True)).drop(own)


def read_topic(spark: SparkSession, servers: str, topic: str, schema, source: str = "kafka",
               stream: bool = True, options: dict | None = None, source_schema=None,
               malformed: str | None = None) -> DataFrame:
    """Subscribe to ``topic`` and decode values by ``schema``; ``key`` is kept. Values that cannot be parsed are an
    error, or go to the column ``malformed`` (see ``decode_records``).

    ``source_schema`` is for sources that need one (a file source standing in for a topic reads
    ``key string, value string`` records from ``options['path']``).
    """
    r = spark.readStream if stream else spark.read
    r = r.format(source).option("kafka.bootstrap.servers", servers).option("subscribe", topic)
    if source_schema is not None:
        r = r.schema(source_schema)
    df = r.options(**(options or {})).load()
    return decode_records(df, schema, malformed=malformed)


def write_topic(df: DataFrame, key, servers: str, topic: str, sink: str = "kafka",
                checkpoint: str | None = None, options: dict | None = None, trigger: dict | None = None):
    """Publish rows as key/value JSON records. Returns the StreamingQuery for a stream, else None."""
    out = encode_records(df, key)
    if df.isStreaming:
        w = (out.writeStream.format(sink).option("kafka.bootstrap.servers", servers).option("topic", topic)
             .options(**(options or {})))
        if checkpoint:
            w = w.option("checkpointLocation", checkpoint)
        if trigger:
            w = w.trigger(**trigger)
        return w.start()
    (out.write.format(sink).option("kafka.bootstrap.servers", servers).option("topic", topic)
     .options(**(options or {})).save())
    return None
