"""Time-zone functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from basin.functions.text import to_col


def local_time(col, zone: str, source_zone: str = "UTC") -> Column:
    """Wall-clock time in ``zone`` of an instant stored as a ``TIMESTAMP_NTZ`` in ``source_zone``."""
    c = to_col(col)
    return F.convert_timezone(F.lit(source_zone), F.lit(zone), c.cast("timestamp_ntz"))


def local_date(col, zone: str, source_zone: str = "UTC") -> Column:
    """Calendar day in ``zone`` of a UTC instant (e.g. ``Asia/Shanghai`` instead of the default zone)."""
    return local_time(col, zone, source_zone).cast("date")
