"""Line operators over a text column: grep, count, sections, in-place edits.

Each text is split into lines inside its own row with higher-order array functions
(``transform`` / ``filter`` / ``zip_with``), edited, and joined again. Nothing explodes unless
the output is one row per line, nothing shuffles, and no Python runs per row. Regular
expressions are Java's; keep to the subset Java and RE2 share if results are compared with
another engine. Replacement strings use ``$1`` for back-references.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basin.functions.text import lines, quote_regex, to_col, unlines


def _ci(pattern: str, ignore_case: bool) -> str:
    return f"(?iu){pattern}" if ignore_case else pattern


def numbered_lines(text) -> Column:
    """``array<struct<line_no:int, line:string>>`` of a text."""
    return F.transform(lines(text), lambda l, i: F.struct((i + 1).alias("line_no"), l.alias("line")))


def grep_lines(df: DataFrame, id_col: str, text_col: str, pattern: str,
               ignore_case: bool = False, invert: bool = False) -> DataFrame:
    """Rows ``(id, line_no, line)`` of the lines matching ``pattern`` (or not, with ``invert``).

    Lines are filtered inside the row first, so only matching lines are turned into rows.
    """
    pat = _ci(pattern, ignore_case)

    def keep(s):
        m = s["line"].rlike(pat)
        return ~m if invert else m

    picked = F.filter(numbered_lines(text_col), keep)
    return df.select(F.col(id_col), F.inline(picked))


def count_matching_lines(df: DataFrame, id_col: str, text_col: str, pattern: str,
                         ignore_case: bool = False) -> DataFrame:
    """Number of matching *lines* (not matches) per id; 0 when none. One output row per input row."""
    pat = _ci(pattern, ignore_case)
    n = F.size(F.filter(lines(text_col), lambda l: l.rlike(pat)))
    return df.select(F.col(id_col), F.coalesce(n, F.lit(0)).cast("long").alias("n_lines"))


def _marker_positions(ls: Column, pattern: str) -> Column:
    hits = F.transform(ls, lambda l, i: F.when(l.rlike(pattern), i + 1))
    return F.filter(hits, lambda x: x.isNotNull())


def _pairs(ls: Column, begin: str, end: str | None) -> Column:
    """``array<struct<begin:int, end:int>>``: the i-th begin marker paired with the i-th end marker.

    An unpaired begin has ``end`` NULL; an unpaired end has ``begin`` NULL. With ``end=None`` each
    section runs from its begin marker to the last line. ``ls`` must be a column reference (it is
    used inside lambdas).
    """
    begins = _marker_positions(ls, begin)
    if end is None:
        return F.transform(begins, lambda b: F.struct(b.alias("begin"), F.size(ls).alias("end")))
    ends = _marker_positions(ls, end)
    return F.zip_with(begins, ends, lambda b, e: F.struct(b.alias("begin"), e.alias("end")))


# Helper columns. Anything a per-line lambda needs (the line array, the line count, the section
# list) is computed once per row as a column first: an expression written inside the lambda would
# be evaluated again for every line -- quadratic in the number of lines.
_LINES, _SECS = "__basin_lines", "__basin_secs"


def section_spans(df: DataFrame, id_col: str, text_col: str, begin: str, end: str | None = None) -> DataFrame:
    """C4: ``(id, section_no, begin, end)`` line numbers of paired markers; unpaired ones are kept."""
    x = df.select(F.col(id_col), lines(text_col).alias(_LINES))
    spans = _pairs(F.col(_LINES), begin, end)
    return x.select(F.col(id_col), F.posexplode(spans).alias("pos", "s")).select(
        F.col(id_col), (F.col("pos") + 1).alias("section_no"),
        F.col("s.begin").alias("begin"), F.col("s.end").alias("end"))


@dataclass(frozen=True)
class LineSpan:
    """Lines ``first``..``last`` (1-based, inclusive); ``last=None`` means to the end of the text."""
    first: int
    last: int | None = None


@dataclass(frozen=True)
class MarkerSpan:
    """Sections between ``begin`` and ``end`` markers (paired as in ``section_spans``).

    ``section=None`` edits every section, else only the k-th (1-based). ``end=None`` means from the
    marker to the end of the text. A section whose end marker is missing (or comes before its
    begin marker) runs to the end of the text.
    """
    begin: str
    end: str | None = None
    section: int | None = None


def _inside(span: LineSpan):
    """Predicate of a 0-based line index."""
    if span.last is None:
        return lambda i: i + 1 >= F.lit(span.first)
    return lambda i: (i + 1 >= F.lit(span.first)) & (i + 1 <= F.lit(span.last))


def _sections(ls: Column, span: MarkerSpan) -> Column:
    """``array<struct<begin,end>>`` of the sections of ``span``, ends filled in."""
    secs = F.filter(_pairs(ls, span.begin, span.end), lambda s: s["begin"].isNotNull())
    secs = F.transform(secs, lambda s: F.struct(
        s["begin"].cast("int").alias("begin"),
        F.when(s["end"].isNull() | (s["end"] < s["begin"]), F.size(ls)).otherwise(s["end"]).cast("int").alias("end")))
    if span.section is None:
        return secs
    one = F.get(secs, span.section - 1)
    return F.when(one.isNull(), F.array().cast("array<struct<begin:int,end:int>>")).otherwise(F.array(one))


def _merged(secs: Column) -> Column:
    """Sections in order, those that touch or overlap made one."""
    def add(acc, s):
        last = F.try_element_at(acc, F.lit(-1))
        joined = F.struct(last["begin"].alias("begin"), F.greatest(last["end"], s["end"]).alias("end"))
        return F.when((F.size(acc) > 0) & (s["begin"] <= last["end"] + 1), F.concat(
            F.slice(acc, 1, F.size(acc) - 1), F.array(joined))).otherwise(F.concat(acc, F.array(s)))
    return F.aggregate(F.array_sort(secs), F.array().cast("array<struct<begin:int,end:int>>"), add)


def _edit_segments(ls: Column, secs: Column, new) -> Column:
    """``ls`` with ``new`` applied to the lines of the merged sections: every line is visited once."""
    def segment(s, i):
        after = F.when(i == 0, 0).otherwise(F.get(secs, i - 1)["end"])
        return F.concat(F.slice(ls, after + 1, s["begin"] - after - 1),
                        F.transform(F.slice(ls, s["begin"], s["end"] - s["begin"] + 1), new))
    last = F.coalesce(F.get(secs, F.size(secs) - 1)["end"], F.lit(0))
    return F.concat(F.flatten(F.transform(secs, segment)), F.slice(ls, last + 1, F.greatest(F.size(ls) - last, F.lit(0))))


def _shift_backrefs(repl: str, n_groups: int) -> str | None:
    """``repl`` with every ``$n`` turned into ``$(n+1)``; None when the result could be misread."""
    out, i = [], 0
    while i < len(repl):
        ch = repl[i]
        if ch == "\\" and i + 1 < len(repl):
            out.append(repl[i:i + 2])
            i += 2
            continue
        if ch == "$" and i + 1 < len(repl) and repl[i + 1].isdigit():
            j = i + 1
            num = int(repl[j])
            j += 1
            # as Java does: more digits belong to the reference while they name an existing group
            while j < len(repl) and repl[j].isdigit() and num * 10 + int(repl[j]) <= n_groups:
                num = num * 10 + int(repl[j])
                j += 1
            if j < len(repl) and repl[j].isdigit() and (num + 1) * 10 + int(repl[j]) <= n_groups + 1:
                return None
            out.append(f"${num + 1}")
            i = j
            continue
        out.append(ch)
        i += 1
    return "".join(out)


def _shift_pattern_refs(pattern: str, n_groups: int) -> str | None:
    """``pattern`` with every back-reference ``\\n`` turned into ``\\(n+1)``; None when it could be misread."""
    out, i, in_class = [], 0, False
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\" and i + 1 < len(pattern):
            nxt = pattern[i + 1]
            if nxt == "Q":
                return None
            if nxt in "123456789" and not in_class:
                j = i + 2
                num = int(nxt)
                while j < len(pattern) and pattern[j].isdigit() and num * 10 + int(pattern[j]) <= n_groups:
                    num = num * 10 + int(pattern[j])
                    j += 1
                if j < len(pattern) and pattern[j].isdigit():
                    return None
                out.append(f"\\{num + 1}")
                i = j
                continue
            out.append(pattern[i:i + 2])
            i += 2
            continue
        in_class = (in_class or ch == "[") and not (in_class and ch == "]")
        out.append(ch)
        i += 1
    return "".join(out)


def replace_first(line: Column, pattern: str, repl: str) -> Column:
    """Replace only the first match of ``pattern`` in ``line`` (sed ``s///`` without ``g``).

    One regex pass: a lazy prefix group anchored at the start (``^((?s:.*?))(?:pattern)``) finds the
    first match, and the back-references of ``repl`` and of the pattern itself are shifted by one. When that
    rewrite is not safe (a pattern Python cannot parse to count groups, quoted or ambiguous references), the
    match is located, extracted and replaced separately (three regex passes); look-around that reaches
    beyond the match is refused there, because the extracted match has lost its surroundings.
    """
    try:
        groups = re.compile(pattern).groups
    except re.error:
        groups = None
    shifted = None if groups is None else _shift_backrefs(repl, groups)
    body = None if groups is None else _shift_pattern_refs(pattern, groups)
    if shifted is not None and body is not None:
        return F.regexp_replace(line, F.lit(f"^((?s:.*?))(?:{body})"), F.lit("$1" + shifted))
    if re.search(r"\(\?<?[=!]|\\[bB]", pattern):
        raise ValueError("this pattern mixes look-around with references that cannot be renumbered; "
                         "name its groups or use all matches")
    pos = F.regexp_instr(line, F.lit(pattern))
    m = F.regexp_extract(line, pattern, 0)
    head = line.substr(F.lit(1), pos - 1)
    tail = line.substr(pos + F.length(m), F.length(line) + 1)
    whole = F.regexp_replace(m, F.lit(f"^(?:{pattern})$"), F.lit(repl))
    return F.when(pos > 0, F.concat(head, whole, tail)).otherwise(line)


def section_replace(df: DataFrame, id_col: str, text_col: str, span, pattern: str, repl: str,
                    first_only: bool = False, out_col: str | None = None) -> DataFrame:
    """Regex replace with back-references, only on lines inside ``span``.

    ``first_only`` replaces the first match per line (sed ``s///``), else all matches (``s///g``).
    Returns the input with ``out_col`` (default: ``text_col``) rewritten.
    """
    x = df.withColumn(_LINES, lines(text_col))

    def new(l):
        return replace_first(l, pattern, repl) if first_only else F.regexp_replace(l, F.lit(pattern), F.lit(repl))

    if isinstance(span, MarkerSpan):
        x = x.withColumn(_SECS, _merged(_sections(F.col(_LINES), span)))
        edited = _edit_segments(F.col(_LINES), F.col(_SECS), new)
    elif isinstance(span, LineSpan):
        inside = _inside(span)
        edited = F.transform(F.col(_LINES), lambda l, i: F.when(inside(i), new(l)).otherwise(l))
    elif span is None:
        edited = F.transform(F.col(_LINES), new)
    else:
        raise TypeError("span must be LineSpan, MarkerSpan or None")
    rewritten = unlines(edited, text_col)
    return x.withColumn(out_col or text_col, rewritten).drop(_LINES, _SECS)


def insert_before_marker(df: DataFrame, id_col: str, text_col: str, marker: str, line: str,
                         out_col: str | None = None) -> DataFrame:
    """Insert ``line`` before every line matching ``marker`` (sed ``/marker/i\\line``)."""
    t = to_col(text_col)
    new = F.flatten(F.transform(lines(text_col),
                                lambda l: F.when(l.rlike(marker), F.array(F.lit(line), l)).otherwise(F.array(l))))
    return df.withColumn(out_col or text_col, unlines(new, t))


def set_property(df: DataFrame, id_col: str, text_col: str, key: str, value: str,
                 uncomment: bool = False, sep: str = "=", out_col: str | None = None) -> DataFrame:
    """Replace every whole line that sets ``key`` with ``key<sep>value``.

    A line sets the key when it starts with the key, optional blanks, then ``sep``; with
    ``uncomment`` a leading ``#`` is accepted too, so ``#key=old`` becomes ``key=value``. Keys are
    compared exactly: ``log.dirs`` does not match ``log.dirs.extra``. No match leaves the text as it is.
    """
    t = to_col(text_col)
    prefix = "^[ \\t]*" + ("#?[ \\t]*" if uncomment else "")
    pat = prefix + quote_regex(key) + "[ \\t]*" + quote_regex(sep)
    new = F.transform(lines(text_col), lambda l: F.when(l.rlike(pat), F.lit(f"{key}{sep}{value}")).otherwise(l))
    return df.withColumn(out_col or text_col, unlines(new, t))
