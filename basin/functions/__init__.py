"""Column functions: each takes and returns a ``pyspark.sql.Column`` built from Spark expressions."""

from basin.functions.text import (field, lines, quote_regex, strip_quotes, to_col,
                                  unlines)
from basin.functions.collation import collated, collation_name, binary
from basin.functions.time import local_date, local_time

__all__ = ["field", "lines", "quote_regex", "strip_quotes", "to_col", "unlines",
           "collated", "collation_name", "binary", "local_date", "local_time"]
