"""Line and field functions over a text column.

A text holds lines separated by ``\\n``; a final ``\\n`` ends the last line instead of starting
an empty one, as line tools read files. Lines are numbered from 1. All functions stay inside
one row (higher-order array functions), so they never shuffle; the lambdas run interpreted,
outside whole-stage codegen.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def quote_regex(s: str) -> str:
    """Escape a literal for use inside a Java (and RE2) regular expression."""
    return re.escape(s)


def _ends_with_newline(t: Column) -> Column:
    return t.endswith(F.lit("\n"))


def lines(text) -> Column:
    """``array<string>`` of the lines of ``text``: '' -> [], 'a\\n' -> ['a'], 'a\\n\\nb' -> ['a', '', 'b']."""
    t = to_col(text)
    body = F.when(_ends_with_newline(t), t.substr(F.lit(1), F.length(t) - 1)).otherwise(t)
    return F.when(t == F.lit(""), F.array().cast("array<string>")).otherwise(F.split(body, "\n", -1))


def unlines(arr: Column, like_text=None) -> Column:
    """Join lines with ``\\n``; re-append the final newline when ``like_text`` had one (and was not only that)."""
    joined = F.array_join(arr, "\n")
    if like_text is None:
        return joined
    t = to_col(like_text)
    # one use of ``arr``: an edit under it is evaluated once
    return F.concat(joined, F.when(_ends_with_newline(t), F.lit("\n")).otherwise(F.lit("")))


def field(col, n: int, sep: str | None = None) -> Column:
    """The n-th field (1-based) of a line; ``n=-1`` is the last field.

    Whitespace mode (``sep=None``, like awk's default): leading and trailing blanks are ignored,
    runs of blanks (spaces, tabs) separate fields, a missing field is ''.
    Delimiter mode (like ``cut -d``): empty fields are kept; a line without the delimiter is
    returned whole; a missing field is ''.
    No array of fields is built: whitespace mode is one anchored regex that stops after the n-th
    word, delimiter mode uses ``substring_index`` and a delimiter count.
    """
    if n == 0 or n < -1:
        raise ValueError("n is 1-based; use -1 for the last field")
    c = to_col(col)
    if sep is None:
        if n == -1:
            # the last field is the first field of the reversed line: a start-anchored match
            out = F.reverse(F.regexp_extract(F.reverse(c), "^[ \\t]*([^ \\t]+)", 1))
        else:
            out = F.regexp_extract(c, "^[ \\t]*(?:[^ \\t]+[ \\t]+){%d}([^ \\t]+)" % (n - 1), 1)
        return out
    if sep == "":
        raise ValueError("sep must not be empty")
    if n == -1:
        picked = F.substring_index(c, sep, -1)
    else:
        n_delims = F.floor((F.length(c) - F.length(F.replace(c, F.lit(sep), F.lit("")))) / len(sep))
        picked = F.when(n_delims < n - 1, F.lit("")).otherwise(
            F.substring_index(F.substring_index(c, sep, n), sep, -1))
    # cut prints a line that has no delimiter whole, whatever field was asked for
    return F.when(F.instr(c, sep) == 0, c).otherwise(picked)


def strip_quotes(col) -> Column:
    """Remove one pair of matching surrounding double or single quotes."""
    c = to_col(col)
    dq = c.startswith('"') & c.endswith('"') & (F.length(c) >= 2)
    sq = c.startswith("'") & c.endswith("'") & (F.length(c) >= 2)
    inner = c.substr(F.lit(2), F.length(c) - 2)
    return F.when(dq | sq, inner).otherwise(c)
