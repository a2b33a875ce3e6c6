"""Landing files under a chosen compression codec."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# fixed values: codecs each writer honours in stock Spark (checked by writing and reading back)
CODECS = {
    "text": ("none", "uncompressed", "gzip", "deflate", "bzip2", "snappy", "lz4"),
    "csv": ("none", "uncompressed", "gzip", "deflate", "bzip2", "snappy", "lz4"),
    "json": ("none", "uncompressed", "gzip", "deflate", "bzip2", "snappy", "lz4"),
    "parquet": ("none", "uncompressed", "snappy", "gzip", "zstd", "lz4", "lz4_raw"),
    "orc": ("none", "uncompressed", "snappy", "zlib", "zstd", "lz4"),
}
# fixed values: codec names used by Hadoop configs and what Spark calls them
CODEC_ALIASES = {"default": "deflate", "defaultcodec": "deflate", "gzipcodec": "gzip", "bzip2codec": "bzip2",
                 "snappycodec": "snappy", "deflatecodec": "deflate"}
NEEDS_EXTRA_JAR = ("lzo", "lzop")


def check_codec(fmt: str, codec: str) -> str:
    """Spark's name for ``codec`` if ``fmt`` can write it; a ValueError otherwise (before any work)."""
    f = fmt.lower()
    c = CODEC_ALIASES.get(codec.lower(), codec.lower())
    if c in NEEDS_EXTRA_JAR:
        raise ValueError(f"codec {codec!r} needs a codec library that stock Spark does not ship")
    if f not in CODECS:
        raise ValueError(f"unknown format {fmt!r}; expected one of {sorted(CODECS)}")
    if c not in CODECS[f]:
        raise ValueError(f"format {fmt!r} cannot be written with codec {codec!r}; use one of {CODECS[f]}")
    return c


# fixed values: options with which a format gives back what was written: microseconds, and values that hold
# line breaks, quotes, backslashes or nothing at all (NULL and the empty string stay apart)
ROUND_TRIP = {
    "csv": {"header": "true", "multiLine": "true", "quoteAll": "true", "escape": '"', "nullValue": "\\N",
            "emptyValue": "", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false",
            "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"},
    "json": {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
             "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"},
}


def check_types(df: DataFrame, fmt: str) -> None:
    """A ValueError for columns that the text format cannot give back as they are."""
    from pyspark.sql import types as T
    nested = (T.ArrayType, T.MapType, T.StructType, T.BinaryType)
    if fmt == "csv":
        bad = [f.name for f in df.schema if isinstance(f.dataType, nested)]
    elif fmt == "text":
        bad = [] if [f.dataType for f in df.schema] == [T.StringType()] else df.columns
    else:
        bad = []
    if bad:
        raise ValueError(f"format {fmt!r} cannot hold the columns {bad}; use json, parquet or orc")


def land_files(spark: SparkSession, src: str, dst: str, fmt: str, codec: str, src_fmt: str | None = None,
               schema=None, read_options: dict | None = None, write_options: dict | None = None,
               mode: str = "errorifexists") -> DataFrame:
    """A1: read files of ``src_fmt`` (default ``fmt``) at ``src`` and rewrite them at ``dst`` as ``fmt``
    compressed with ``codec``. Returns the landed data read back from ``dst``, equal to what was read.

    csv and json are written with options that keep microseconds, line breaks, quotes, NULL and the empty
    string (``ROUND_TRIP``); ``write_options`` override them, and read options among them are used to
    read back. Columns a format cannot hold are refused before any work. Multi-line csv is read by one
    task per file, so land large texts as json or parquet.

    Gzip and bzip2 text are read by one task per file (gzip is not splittable); prefer splittable
    columnar output (parquet + snappy/zstd) for anything read again.
    """
    c = check_codec(fmt, codec)
    reader = spark.read.format(src_fmt or fmt).options(**(read_options or {}))
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.load(src)
    check_types(df, fmt)
    options = {**ROUND_TRIP.get(fmt, {}), **(write_options or {})}
    write_df(df, dst, fmt, c, options, mode)
    back = spark.read.format(fmt).options(**options)
    return back.schema(df.schema).load(dst) if fmt in ("csv", "json", "text") else back.load(dst)


def write_df(df: DataFrame, dst: str, fmt: str, codec: str, options: dict | None = None,
             mode: str = "errorifexists", partition_by=None) -> None:
    """Write ``df`` as ``fmt`` with a checked ``codec``."""
    c = check_codec(fmt, codec)
    w = df.write.format(fmt).mode(mode).option("compression", c).options(**(options or {}))
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(dst)
