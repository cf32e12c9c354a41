"""Cleaning and the basic temporal/amount features.

Every step is a no-op when its column is absent (schema-time check, free).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TSLT = "time_since_last_transaction"


def clean_abs(df: DataFrame, col: str = TSLT) -> DataFrame:
    """Absolute value of the signed time-since-last column."""
    if col not in df.columns:
        return df
    return df.withColumn(col, F.abs(col))


def clean_fill_label(df: DataFrame, col: str = "fraud_type",
                     fill: str = "Legitimate") -> DataFrame:
    """Null fraud type → ``fill``."""
    if col not in df.columns:
        return df
    return df.withColumn(col, F.coalesce(F.col(col), F.lit(fill)))


def parse_timestamp(col: str, mode: str = "strict", fallback: str | None = None):
    """Timestamp parse modes: ``strict`` raises on bad text (ANSI cast),
    ``coerce`` gives null, ``fallback`` replaces a failed parse by the
    ``fallback`` column (e.g. an arrival-time column)."""
    c = F.col(col)
    if mode == "strict":
        return F.to_timestamp(c)
    parsed = F.try_to_timestamp(c)
    if mode == "coerce":
        return parsed
    if mode == "fallback":
        return F.coalesce(parsed, F.col(fallback))
    raise ValueError(mode)


def feat_time_basic(df: DataFrame, ts: str = "ts", parse: bool = False) -> DataFrame:
    """hour, day_of_week (Monday = 0) and is_weekend; a text column is parsed
    strictly so a malformed value fails the job (as the reference does)."""
    if ts not in df.columns:
        return df
    t = F.to_timestamp(F.col(ts)) if parse else F.col(ts)
    if parse:
        df = df.withColumn(ts, t)
        t = F.col(ts)
    dow = F.weekday(t)
    return df.withColumns({
        "hour": F.hour(t),
        "day_of_week": dow,
        "is_weekend": dow.isin(5, 6).cast("int"),
    })


def feat_log_amount(df: DataFrame, col: str = "amount", out: str = "amount_log") -> DataFrame:
    if col not in df.columns:
        return df
    return df.withColumn(out, F.log1p(col))


def baseline_chain(df: DataFrame, ts: str = "ts") -> DataFrame:
    """The four cleaning steps in their fixed order (one projection after
    Catalyst's CollapseProject)."""
    return (df.transform(clean_abs)
              .transform(clean_fill_label)
              .transform(feat_time_basic, ts=ts)
              .transform(feat_log_amount))
