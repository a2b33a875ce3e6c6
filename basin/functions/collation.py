"""Collation names and helpers.

The MySQL collations a warehouse metastore is set up with map onto Spark's ICU collations:
``utf8_bin`` is a binary compare; ``utf8_general_ci`` / ``utf8_unicode_ci`` ignore case, accents and
trailing blanks. MySQL's own weight tables are *not* reproduced -- Spark's ICU root collation
decides equality, so rare characters may compare differently than in MySQL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from basin.functions.text import to_col

# fixed values: accepted collation kinds and the Spark collation each one means
COLLATIONS = {
    "binary": "UTF8_BINARY",
    "utf8_bin": "UTF8_BINARY",
    "lcase": "UTF8_LCASE",
    "ci": "UNICODE_CI",
    "ci_ai": "UNICODE_CI_AI",
    "ci_ai_rtrim": "UNICODE_CI_AI_RTRIM",
    "utf8_general_ci": "UNICODE_CI_AI_RTRIM",
    "utf8_unicode_ci": "UNICODE_CI_AI_RTRIM",
}


def collation_name(kind: str) -> str:
    k = kind.strip()
    if k.lower() in COLLATIONS:
        return COLLATIONS[k.lower()]
    # Spark collation names pass through (validated by Spark itself)
    return k.upper()


def collated(col, kind: str) -> Column:
    """``col`` as a string under collation ``kind``."""
    return F.collate(to_col(col), collation_name(kind))


def binary(col) -> Column:
    """Back to a plain (binary) string, e.g. before writing or returning results."""
    return F.collate(to_col(col), "UTF8_BINARY")
