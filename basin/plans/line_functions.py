"""The line operators as SQL functions, for jobs that are written in SQL.

Each is a ``CREATE FUNCTION`` over Spark's own expressions: no Python worker, and the optimizer sees through it. Table
functions are joined with ``LATERAL``; Spark finds them by plain name only, so a job uses the database they are in (or has
them as temporary functions).
"""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Name and parameters, what it returns, and its body.
FUNCTIONS = {
    "lines_of": ("(body STRING)", "TABLE (line_no BIGINT, line STRING)",
                 "SELECT pos + 1, col FROM posexplode(split(body, '\\n'))"),
    "grep_lines": ("(body STRING, pattern STRING, inverted BOOLEAN DEFAULT false)", "TABLE (line_no BIGINT, line STRING)",
                   "SELECT pos + 1, col FROM posexplode(split(body, '\\n')) WHERE (col RLIKE pattern) <> inverted"),
    "count_matching_lines": ("(body STRING, pattern STRING)", "BIGINT",
                             "RETURN coalesce(size(filter(split(body, '\\n'), l -> l RLIKE pattern)), 0)"),
    "word_field": ("(line STRING, n INT)", "STRING", "RETURN nullif(regexp_extract(line, concat('^\\\\s*(?:\\\\S+\\\\s+){', n - 1, '}(\\\\S+)'), 1), '')"),
    "delimited_field": ("(line STRING, delimiter STRING, n INT)", "STRING", "RETURN get(split(line, concat('\\\\Q', delimiter, '\\\\E'), -1), n - 1)"),
    "settings_of": ("(body STRING)", "TABLE (line_no BIGINT, name STRING, value STRING)",
                    """SELECT pos + 1, trim(substring_index(col, '=', 1)), trim(BOTH '"' FROM trim(substr(col, instr(col, '=') + 1)))
                       FROM posexplode(split(body, '\\n')) WHERE NOT ltrim(col) LIKE '#%' AND instr(col, '=') > 1"""),
    "set_property": ("(body STRING, name STRING, value STRING)", "STRING",
                     """RETURN array_join(transform(split(body, '\\n'), l -> CASE WHEN trim(substring_index(l, '=', 1)) = name AND instr(l, '=') > 0
                        THEN concat(name, '=', value) ELSE l END), '\\n')"""),
}


def register_line_functions(spark: SparkSession, database: str | None = None) -> list[str]:
    """Create the functions (temporary, or in a database for every session) and return their names.

    A pattern is a Java regular expression and matches anywhere in the line; a NULL text has no lines, counts 0 and stays
    NULL under ``set_property``. ``word_field`` and ``delimited_field`` count from 1 and give NULL beyond the last.
    """
    names = []
    for name, (parameters, returns, body) in FUNCTIONS.items():
        full = f"{database}.{name}" if database else name
        kind = "OR REPLACE FUNCTION" if database else "OR REPLACE TEMPORARY FUNCTION"
        body = body if body.startswith("RETURN") else f"RETURN {body}"
        spark.sql(f"CREATE {kind} {full}{parameters} RETURNS {returns} {body}")
        names.append(full)
    return names
