"""Small tables with the awkward rows every operator must take: nulls, empty and long texts, repeats, extra columns."""

from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def odd_documents(spark, texts=()):
    long = "word " * 30_000 + "end"
    rows = [(1, "One two three four."), (2, None), (3, ""), (4, "   \n\t "), (5, long), (6, "One two three four."),
            (6, "One two three four."), (7, "Ünï côdé 日本 <|endoftext|> it's"), (None, "no id here at all")]
    rows += [(100 + i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)


def with_extra_columns(df):
    """Columns named like the operators' own intermediate and result columns."""
    names = ["fp", "score", "label", "word", "ids", "n", "p", "rate", "node", "component", "bins", "x", "copy", "found", "doc",
             "n_entities", "part", "share", "stems", "host", "path", "table", "bucket", "own", "size", "row", "slice", "text.raw", "a.b"]
    return df.select("*", *[F.lit("clash").alias(c) for c in names if c not in df.columns])


def empty(df):
    return df.filter("false")


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)
