"""CSV files with inferred types and a quarantine for rows that don't fit.

A column's type is the narrowest of long, double, boolean and timestamp that at
least ``agree`` of its values fit, counted over all rows in one scan, else
string.  A row with a value that its column's type can't hold, or with too few
or too many fields, goes to the quarantine with its text and the reason; the
good rows never hold a value that was turned to null.  Empty fields are null.
Records end with their line.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stored

CANDIDATES = ["bigint", "double", "boolean", "timestamp"]


class EmptyFileError(ValueError):
    """The file has no line at all."""


def _column(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def header(spark: SparkSession, path: str) -> list[str]:
    try:
        names = spark.read.option("header", True).csv(path).columns
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise FileNotFoundError(path) from e
        raise
    if not names:
        raise EmptyFileError(path)
    return names


def infer_types(rows: DataFrame, names: list[str], agree: float) -> dict[str, str]:
    fits = [F.struct(*[F.count(F.expr(f"try_cast({_column(n)} AS {t})")).alias(t) for t in CANDIDATES], F.count(F.col(_column(n))).alias("n")).alias(f"c{i}")
            for i, n in enumerate(names)]
    seen = rows.agg(*fits).first()
    return {n: next((t for t in CANDIDATES if seen[i]["n"] and seen[i][t] >= agree * seen[i]["n"]), "string") for i, n in enumerate(names)}


def read_csv(spark: SparkSession, path: str, types: dict[str, str] | None = None, agree: float = 0.95) -> tuple[DataFrame, DataFrame]:
    """The good rows, typed, and the quarantine (``record``, ``reason``).  ``types`` (SQL names by column) spares the
    inference.  A missing path raises FileNotFoundError, a file without a line EmptyFileError; a header alone gives no rows."""
    names = header(spark, path)
    text = "_record"
    while text in names:
        text = "_" + text
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, text]])
    rows = spark.read.schema(schema).option("header", True).option("columnNameOfCorruptRecord", text).csv(path)
    rows = stored(rows, "csv-rows")  # parsed once, all columns, so a broken record is known whatever is read later
    types = types or infer_types(rows.where(F.col(text).isNull()), names, agree)
    misfit = [F.when(F.col(_column(n)).isNotNull() & F.expr(f"try_cast({_column(n)} AS {types[n]})").isNull(), F.lit(f"{n} is no {types[n]}")) for n in names if types[n] != "string"]
    reason = F.when(F.col(text).isNotNull(), F.lit("number of fields"))
    reason = reduce(lambda a, b: F.coalesce(a, b), misfit, reason)
    good = rows.where(reason.isNull()).select(*[F.expr(f"try_cast({_column(n)} AS {types[n]})").alias(n) for n in names])
    whole = F.coalesce(F.col(text), F.to_csv(F.struct(*[F.col(_column(n)) for n in names])))
    return good, rows.where(reason.isNotNull()).select(whole.alias("record"), reason.alias("reason"))
