"""Scalar feature families (stateless, one projection each)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .clean import TSLT


def flag(cond: Column) -> Column:
    """Boolean → 0/1 where a null comparison counts as 0 (pandas ``astype(int)``)."""
    return F.coalesce(cond, F.lit(False)).cast("int")


def feat_time_ext(df: DataFrame, ts: str = "ts") -> DataFrame:
    t = F.col(ts)
    dow = F.weekday(t)
    return df.withColumns({
        "hour": F.hour(t),
        "day_of_week": dow,
        "month": F.month(t),
        "is_weekend": dow.isin(5, 6).cast("int"),
        "is_night": F.hour(t).between(0, 5).cast("int"),
    })


def feat_tslt_flags(df: DataFrame, col: str = TSLT, keep_raw: bool = False) -> DataFrame:
    c = F.col(col)
    out = {
        "tslt_is_missing": c.isNull().cast("int"),
        "tslt_is_negative": flag(c < 0),
        "tslt_abs": F.abs(c),
    }
    if keep_raw:
        out["tslt_raw"] = c
    return df.withColumns(out)


# Column sets of the four time-since-last strategies (A drop, B raw + flags,
# C abs + flags, D flags only).
TSLT_STRATEGIES = {
    "A": [],
    "B": ["tslt_raw", "tslt_is_missing", "tslt_is_negative"],
    "C": ["tslt_abs", "tslt_is_missing", "tslt_is_negative"],
    "D": ["tslt_is_missing", "tslt_is_negative"],
}


def tslt_strategy(df: DataFrame, strategy: str, base_cols: list[str]) -> DataFrame:
    """Select ``base_cols`` plus the strategy's time-since-last columns."""
    df = feat_tslt_flags(df, keep_raw=True)
    return df.select(*base_cols, *TSLT_STRATEGIES[strategy])


def feat_interactions(df: DataFrame, log_amount: str = "log_amount") -> DataFrame:
    """Five numeric products; null scores count as 0, amount in log space."""
    if log_amount not in df.columns:
        df = df.withColumn(log_amount, F.log1p("amount"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    la = F.col(log_amount)
    return df.withColumns({
        "amount_x_velocity": la * z("velocity_score"),
        "geo_x_velocity": z("geo_anomaly_score") * z("velocity_score"),
        "deviation_x_amount": z("spending_deviation_score") * la,
        "geo_x_deviation": z("geo_anomaly_score") * z("spending_deviation_score"),
        "velocity_x_deviation": z("velocity_score") * z("spending_deviation_score"),
    })


CROSSES = [("transaction_type", "payment_channel"), ("payment_channel", "device_used"),
           ("merchant_category", "payment_channel"), ("location", "payment_channel"),
           ("transaction_type", "merchant_category")]


def feat_crosses(df: DataFrame, pairs=CROSSES, null_token: str = "None") -> DataFrame:
    """Categorical crosses ``a_b``; a null side becomes ``null_token``."""
    s = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(null_token))
    return df.withColumns({f"{a}__{b}": F.concat_ws("_", s(a), s(b)) for a, b in pairs})


def feat_high_amount(df: DataFrame, cuts: Column, col: str = "amount") -> DataFrame:
    """≥ p95 / ≥ p99 flags; ``cuts`` holds the two percentiles (an array, fitted
    on the train prefix)."""
    return df.withColumns({
        "is_high_amount_p95": flag(F.col(col) >= cuts[0]),
        "is_high_amount_p99": flag(F.col(col) >= cuts[1]),
    })


def feat_base(df: DataFrame, ts: str = "ts") -> DataFrame:
    """The nine-column base set: log_amount, hour, day_of_week, month,
    is_weekend, is_night, tslt_is_missing, tslt_is_negative, tslt_abs."""
    df = df.withColumn("log_amount", F.log1p("amount"))
    return feat_tslt_flags(feat_time_ext(df, ts))


def feat_ratio(df: DataFrame, unique_col: str, index_col: str, out: str) -> DataFrame:
    """Familiarity ratio = distinct-so-far / (running index + 1)."""
    return df.withColumn(out, F.col(unique_col) / (F.col(index_col) + 1))


LEAK_COLUMNS = ["transaction_id", "fraud_type", "ts", "timestamp",
                "time_since_last_transaction", "sender_account", "receiver_account",
                "ip_address", "device_hash"]


def project_features(df: DataFrame, numeric: list[str], categorical: list[str],
                     label: str | None = "is_fraud") -> DataFrame:
    """Keep the model columns, never the leakage ones."""
    bad = [c for c in numeric + categorical if c in LEAK_COLUMNS]
    if bad:
        raise ValueError(f"leakage columns requested: {bad}")
    cols = numeric + categorical + ([label] if label else [])
    return df.select(*cols)


def serve_defaults(df: DataFrame, numeric: list[str], categorical: list[str],
                   ts: str = "ts") -> DataFrame:
    """Serving-side defaults: numeric null/absent → 0.0, categorical →
    'unknown'; absent time parts → hour 12, weekday 0, month 1."""
    out = {}
    for c in numeric:
        out[c] = (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in df.columns
                  else F.lit(0.0))
    for c in categorical:
        out[c] = (F.coalesce(F.col(c).cast("string"), F.lit("unknown")) if c in df.columns
                  else F.lit("unknown"))
    has_ts = ts in df.columns
    t = F.col(ts) if has_ts else None
    out["hour"] = F.coalesce(F.hour(t), F.lit(12)) if has_ts else F.lit(12)
    out["day_of_week"] = F.coalesce(F.weekday(t), F.lit(0)) if has_ts else F.lit(0)
    out["month"] = F.coalesce(F.month(t), F.lit(1)) if has_ts else F.lit(1)
    return df.withColumns(out)


# Column-role rules, first match wins, in the reference's order:
# "score" in name → behavioral score; "account" in name or ip_address /
# device_hash → high-cardinality id; timestamp; is_fraud → target;
# fraud_type → target leak; numeric dtype → numeric; else categorical.
ROLE_ID_COLUMNS = ["ip_address", "device_hash"]
NUMERIC_TYPES = ["tinyint", "smallint", "int", "bigint", "float", "double"]


def column_role_expr(name: Column, dtype: Column) -> Column:
    return (F.when(name.contains("score"), "behavioral score")
             .when(name.contains("account") | name.isin(*ROLE_ID_COLUMNS),
                   "High-cardinality ID (Leakage Risk)")
             .when((name == "timestamp") | (dtype == "timestamp"), "timestamp")
             .when(name == "is_fraud", "target")
             .when(name == "fraud_type", "Leakage Risk (Target Leak)")
             .when(dtype.isin(*NUMERIC_TYPES), "numeric")
             .otherwise("categorical"))


# Feature-family rules; a later rule overrides an earlier one.
FAMILY_RULES = [("tx_count|amount_sum", "Historical"), ("__|_x_", "Interaction"),
                ("amount|log_amount", "Amount"), ("tslt", "Time-Since"),
                ("score", "Behavioral")]


def feature_family_expr(name: Column) -> Column:
    expr = F.lit("Other")
    for pattern, fam in FAMILY_RULES:
        expr = F.when(name.rlike(pattern), F.lit(fam)).otherwise(expr)
    return expr
