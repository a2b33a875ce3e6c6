"""basin: table and stream jobs for a data platform, written as DataFrame functions.

Every public operator takes DataFrames (or Columns) and returns a DataFrame (or Column);
the work is Spark's own expressions, joins, aggregates and windows, so Catalyst plans it.
"""

__version__ = "0.1.0"
