"""Line and field operators against brute-force Python on generated texts (one Spark job per batch)."""

import re

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from basin.functions import field, lines
from basin.operators import lines as C

ALPHABET = st.sampled_from(list("ab \t=#,.\n1é"))
TEXTS = st.lists(st.text(ALPHABET, max_size=40), min_size=1, max_size=25)


def py_lines(t):
    if t == "":
        return []
    return (t[:-1] if t.endswith("\n") else t).split("\n")


def py_field_ws(line, n):
    parts = line.replace("\t", " ").split()
    if n == -1:
        return parts[-1] if parts else ""
    return parts[n - 1] if len(parts) >= n else ""


def py_field_delim(line, n, sep):
    if sep not in line:
        return line
    parts = line.split(sep)
    if n == -1:
        return parts[-1]
    return parts[n - 1] if len(parts) >= n else ""


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, t string")


@settings(max_examples=15, deadline=None)
@given(TEXTS)
def test_lines_and_counts(spark, texts):
    df = frame(spark, texts)
    got = {r["id"]: (r["ls"], r["n"]) for r in df.select(
        "id", lines("t").alias("ls"), F.size(F.filter(lines("t"), lambda l: l.rlike("a"))).alias("n")).collect()}
    for i, t in enumerate(texts):
        assert got[i][0] == py_lines(t)
        assert got[i][1] == sum(1 for l in py_lines(t) if "a" in l)


@settings(max_examples=15, deadline=None)
@given(TEXTS)
def test_fields(spark, texts):
    one_line = [t.replace("\n", " ") for t in texts]
    df = frame(spark, one_line)
    cols = [field("t", 1).alias("w1"), field("t", 2).alias("w2"), field("t", -1).alias("wl"),
            field("t", 2, ",").alias("d2"), field("t", -1, ",").alias("dl"), field("t", 3, "=").alias("e3")]
    got = {r["id"]: r for r in df.select("id", *cols).collect()}
    for i, t in enumerate(one_line):
        r = got[i]
        assert r["w1"] == py_field_ws(t, 1) and r["w2"] == py_field_ws(t, 2) and r["wl"] == py_field_ws(t, -1)
        assert r["d2"] == py_field_delim(t, 2, ",") and r["dl"] == py_field_delim(t, -1, ",")
        assert r["e3"] == py_field_delim(t, 3, "=")


@settings(max_examples=10, deadline=None)
@given(TEXTS)
def test_line_edits(spark, texts):
    df = frame(spark, texts)
    ins = {r["id"]: r["t"] for r in C.insert_before_marker(df, "id", "t", "^#", "NEW").collect()}
    setp = {r["id"]: r["t"] for r in C.set_property(df, "id", "t", "a", "v", uncomment=True).collect()}
    rep = {r["id"]: r["t"] for r in C.section_replace(df, "id", "t", C.LineSpan(2, 3), "a", "A", first_only=True).collect()}
    for i, t in enumerate(texts):
        ls = py_lines(t)
        tail = "\n" if t.endswith("\n") and ls else ""
        exp = []
        for l in ls:
            exp += ["NEW", l] if l.startswith("#") else [l]
        assert ins[i] == "\n".join(exp) + tail
        exp = ["a=v" if re.match(r"^[ \t]*#?[ \t]*a[ \t]*=", l) else l for l in ls]
        assert setp[i] == "\n".join(exp) + tail
        exp = [l.replace("a", "A", 1) if 2 <= k + 1 <= 3 else l for k, l in enumerate(ls)]
        assert rep[i] == "\n".join(exp) + tail
