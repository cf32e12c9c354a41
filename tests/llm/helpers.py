"""Tables of awkward rows, and small helpers."""

from pyspark.sql import functions as F

LONG = "der lange text " * 40_000


def awkward(spark, extra=()):
    """Null and empty texts, null and repeated ids, repeated rows, a long text, and columns named like results."""
    rows = [(5, "Alpha beta gamma delta epsilon zeta"), (5, "Alpha beta gamma delta epsilon zeta"), (5, "another text of this id"), (1, None), (2, ""), (3, "  \n\t "), (None, "no id here"), (None, None),
            (7, LONG), (8, "alpha BETA gamma delta epsilon zeta"), (9, "Ünïcödé 😀 tëxt\r\nwith  spaces\tand more"), *extra]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("fp", "score", "base", "spans", "piece", "start", "length", "ids", "part", "number", "contaminated", "n_words", "h", "place", "c0", "c1"):
        df = df.withColumn(name, F.lit("mine"))
    return df


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def rows(df, *by):
    return [tuple(r) for r in df.orderBy(*[F.col(c).asc_nulls_first() for c in by]).collect()]
