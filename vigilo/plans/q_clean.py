"""Registered queries: cleaning, scalar features, filters (§2.2, §2.3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clean as C
from ..functions import features as FT
from ..operators.order import global_index, split_flag, trailing
from ..operators.profile import r6
from ..operators.ranks import quantile_list
from ..sources.adapters import txn_events
from .registry import ev_sql, register

DOW = "(isodow(ts) - 1)"


@register("clean_abs", ev_sql("""
SELECT transaction_id, abs(time_since_last_transaction) AS time_since_last_transaction
FROM txn_events"""))
def q_clean_abs(spark, sf):
    return C.clean_abs(txn_events(spark, sf)).select("transaction_id", C.TSLT)


@register("clean_fill_label", ev_sql("""
SELECT transaction_id, coalesce(fraud_type, 'Legitimate') AS fraud_type FROM txn_events"""))
def q_clean_fill_label(spark, sf):
    return C.clean_fill_label(txn_events(spark, sf)).select("transaction_id", "fraud_type")


@register("feat_time_basic", ev_sql(f"""
SELECT transaction_id, hour(ts) AS hour, {DOW} AS day_of_week,
       CAST({DOW} IN (5, 6) AS INTEGER) AS is_weekend
FROM txn_events"""))
def q_feat_time_basic(spark, sf):
    return C.feat_time_basic(txn_events(spark, sf)).select(
        "transaction_id", "hour", "day_of_week", "is_weekend")


@register("feat_log_amount", ev_sql("""
SELECT transaction_id, round(ln(1 + amount), 6) AS amount_log FROM txn_events"""))
def q_feat_log_amount(spark, sf):
    return C.feat_log_amount(txn_events(spark, sf)).select(
        "transaction_id", r6("amount_log").alias("amount_log"))


@register("baseline_chain", ev_sql(f"""
SELECT transaction_id, abs(time_since_last_transaction) AS time_since_last_transaction,
       coalesce(fraud_type, 'Legitimate') AS fraud_type, hour(ts) AS hour,
       {DOW} AS day_of_week, CAST({DOW} IN (5, 6) AS INTEGER) AS is_weekend,
       round(ln(1 + amount), 6) AS amount_log
FROM txn_events"""))
def q_baseline_chain(spark, sf):
    df = C.baseline_chain(txn_events(spark, sf))
    return df.select("transaction_id", C.TSLT, "fraud_type", "hour", "day_of_week",
                     "is_weekend", r6("amount_log").alias("amount_log"))


@register("feat_time_ext", ev_sql(f"""
SELECT transaction_id, hour(ts) AS hour, {DOW} AS day_of_week, month(ts) AS month,
       CAST({DOW} IN (5, 6) AS INTEGER) AS is_weekend,
       CAST(hour(ts) BETWEEN 0 AND 5 AS INTEGER) AS is_night
FROM txn_events"""))
def q_feat_time_ext(spark, sf):
    return FT.feat_time_ext(txn_events(spark, sf)).select(
        "transaction_id", "hour", "day_of_week", "month", "is_weekend", "is_night")


TSLT_FLAGS_SQL = """CAST(time_since_last_transaction IS NULL AS INTEGER) AS tslt_is_missing,
       CAST(coalesce(time_since_last_transaction < 0, false) AS INTEGER) AS tslt_is_negative,
       abs(time_since_last_transaction) AS tslt_abs"""


@register("feat_tslt_flags", ev_sql(f"""
SELECT transaction_id, {TSLT_FLAGS_SQL}, time_since_last_transaction AS tslt_raw FROM txn_events"""))
def q_feat_tslt_flags(spark, sf):
    return FT.feat_tslt_flags(txn_events(spark, sf), keep_raw=True).select(
        "transaction_id", "tslt_is_missing", "tslt_is_negative", "tslt_abs", "tslt_raw")


@register("tslt_strategy", ev_sql("""
SELECT 'C' AS strategy, transaction_id, amount, abs(time_since_last_transaction) AS tslt_abs,
       CAST(time_since_last_transaction IS NULL AS INTEGER) AS tslt_is_missing,
       CAST(coalesce(time_since_last_transaction < 0, false) AS INTEGER) AS tslt_is_negative,
       NULL::DOUBLE AS tslt_raw
FROM txn_events
UNION ALL
SELECT 'B', transaction_id, amount, NULL, CAST(time_since_last_transaction IS NULL AS INTEGER),
       CAST(coalesce(time_since_last_transaction < 0, false) AS INTEGER), time_since_last_transaction
FROM txn_events"""))
def q_tslt_strategy(spark, sf):
    df = txn_events(spark, sf)
    base = ["transaction_id", "amount"]
    c = FT.tslt_strategy(df, "C", base).withColumn("tslt_raw", F.lit(None).cast("double"))
    b = FT.tslt_strategy(df, "B", base).withColumn("tslt_abs", F.lit(None).cast("double"))
    return (c.withColumn("strategy", F.lit("C"))
             .unionByName(b.withColumn("strategy", F.lit("B"))))


INTER_SQL = """round(ln(1 + amount) * coalesce(velocity_score, 0), 6) AS amount_x_velocity,
       round(coalesce(geo_anomaly_score, 0) * coalesce(velocity_score, 0), 6) AS geo_x_velocity,
       round(coalesce(spending_deviation_score, 0) * ln(1 + amount), 6) AS deviation_x_amount,
       round(coalesce(geo_anomaly_score, 0) * coalesce(spending_deviation_score, 0), 6) AS geo_x_deviation,
       round(coalesce(velocity_score, 0) * coalesce(spending_deviation_score, 0), 6) AS velocity_x_deviation"""
INTER_COLS = ["amount_x_velocity", "geo_x_velocity", "deviation_x_amount", "geo_x_deviation",
              "velocity_x_deviation"]


@register("feat_interactions", ev_sql(f"SELECT transaction_id, {INTER_SQL} FROM txn_events"))
def q_feat_interactions(spark, sf):
    df = FT.feat_interactions(txn_events(spark, sf))
    return df.select("transaction_id", *[r6(c).alias(c) for c in INTER_COLS])


@register("feat_crosses", ev_sql("""
SELECT transaction_id,
  concat_ws('_', coalesce(transaction_type, 'None'), coalesce(payment_channel, 'None')) AS transaction_type__payment_channel,
  concat_ws('_', coalesce(payment_channel, 'None'), coalesce(device_used, 'None')) AS payment_channel__device_used,
  concat_ws('_', coalesce(merchant_category, 'None'), coalesce(payment_channel, 'None')) AS merchant_category__payment_channel,
  concat_ws('_', coalesce(location, 'None'), coalesce(payment_channel, 'None')) AS location__payment_channel,
  concat_ws('_', coalesce(transaction_type, 'None'), coalesce(merchant_category, 'None')) AS transaction_type__merchant_category
FROM txn_events"""))
def q_feat_crosses(spark, sf):
    df = FT.feat_crosses(txn_events(spark, sf))
    return df.select("transaction_id", *[f"{a}__{b}" for a, b in FT.CROSSES])


GI_SQL = """gi AS (SELECT *, row_number() OVER (ORDER BY ts, transaction_id) - 1 AS global_index,
                  COUNT(*) OVER () AS _total FROM txn_events)"""


@register("feat_high_amount", ev_sql("""
SELECT transaction_id, CAST(amount >= p95 AS INTEGER) AS is_high_amount_p95,
       CAST(amount >= p99 AS INTEGER) AS is_high_amount_p99
FROM txn_events, cut""", GI_SQL, """cut AS (
  SELECT quantile_cont(amount, 0.95) AS p95, quantile_cont(amount, 0.99) AS p99
  FROM gi WHERE global_index < floor(_total * 0.8))"""))
def q_feat_high_amount(spark, sf):
    df = txn_events(spark, sf)
    gi = global_index(df.select("ts", "transaction_id", "amount"), ["ts", "transaction_id"])
    fit = gi.where(split_flag(F.col("global_index"), F.col("_total")) == 1)
    return FT.feat_high_amount(df, quantile_list(fit, "amount", [0.95, 0.99])).select("transaction_id", "is_high_amount_p95",
                                               "is_high_amount_p99")


BASE_SQL = f"""round(ln(1 + amount), 6) AS log_amount, hour(ts) AS hour, {DOW} AS day_of_week,
       month(ts) AS month, CAST({DOW} IN (5, 6) AS INTEGER) AS is_weekend,
       CAST(hour(ts) BETWEEN 0 AND 5 AS INTEGER) AS is_night, {TSLT_FLAGS_SQL}"""
BASE_COLS = ["log_amount", "hour", "day_of_week", "month", "is_weekend", "is_night",
             "tslt_is_missing", "tslt_is_negative", "tslt_abs"]


def base_select(df):
    return [r6(c).alias(c) if c == "log_amount" else c for c in BASE_COLS]


@register("feat_base", ev_sql(f"SELECT transaction_id, {BASE_SQL} FROM txn_events"))
def q_feat_base(spark, sf):
    df = FT.feat_base(txn_events(spark, sf))
    return df.select("transaction_id", *base_select(df))


PROJ_NUM = ["amount", "velocity_score", "geo_anomaly_score"]
PROJ_CAT = ["transaction_type", "payment_channel"]


@register("project_features", ev_sql("""
SELECT amount, velocity_score, geo_anomaly_score, transaction_type, payment_channel, is_fraud
FROM txn_events"""))
def q_project_features(spark, sf):
    return FT.project_features(txn_events(spark, sf), PROJ_NUM, PROJ_CAT)


@register("serve_defaults", ev_sql("""
SELECT transaction_id,
       coalesce(CAST(time_since_last_transaction AS DOUBLE), 0.0) AS time_since_last_transaction,
       coalesce(CAST(velocity_score AS DOUBLE), 0.0) AS velocity_score,
       0.0 AS spending_velocity_ratio,
       coalesce(CAST(location AS VARCHAR), 'unknown') AS location,
       coalesce(CAST(fraud_type AS VARCHAR), 'unknown') AS fraud_type,
       'unknown' AS merchant_region,
       coalesce(hour(ts), 12) AS hour, coalesce(isodow(ts) - 1, 0) AS day_of_week,
       coalesce(month(ts), 1) AS month
FROM txn_events"""))
def q_serve_defaults(spark, sf):
    num = ["time_since_last_transaction", "velocity_score", "spending_velocity_ratio"]
    cat = ["location", "fraud_type", "merchant_region"]
    df = FT.serve_defaults(txn_events(spark, sf), num, cat)
    return df.select("transaction_id", *num, *cat, "hour", "day_of_week", "month")


# ---- filters (§2.3) -------------------------------------------------------

@register("filter_label", ev_sql("""
SELECT is_fraud, COUNT(*) AS tx_count, round(avg(amount), 6) AS mean_amount
FROM txn_events GROUP BY is_fraud"""))
def q_filter_label(spark, sf):
    df = txn_events(spark, sf)
    pos = df.where(F.col("is_fraud") == 1)
    neg = df.where(~(F.col("is_fraud") == 1))
    agg = lambda d: d.groupBy("is_fraud").agg(F.count(F.lit(1)).alias("tx_count"),
                                              r6(F.avg("amount")).alias("mean_amount"))
    return agg(pos).unionByName(agg(neg))


@register("filter_hard", ev_sql("""
SELECT transaction_id, amount, time_since_last_transaction FROM txn_events
WHERE time_since_last_transaction IS NOT NULL"""))
def q_filter_hard(spark, sf):
    df = FT.feat_tslt_flags(txn_events(spark, sf))
    return df.where(F.col("tslt_is_missing") == 0).select(
        "transaction_id", "amount", C.TSLT)


@register("filter_isin", ev_sql("""
SELECT t.transaction_id, t.amount FROM txn_events t
WHERE t.transaction_id IN (SELECT transaction_id FROM txn_events WHERE is_fraud = 1 AND velocity_score > 18)"""))
def q_filter_isin(spark, sf):
    """Membership in an id list derived from the data: a left-semi join
    (broadcast or shuffled by AQE from its runtime size, never collected)."""
    df = txn_events(spark, sf)
    ids = df.where((F.col("is_fraud") == 1) & (F.col("velocity_score") > 18)).select("transaction_id")
    return df.join(ids, "transaction_id", "left_semi").select("transaction_id", "amount")


@register("lookup_by_id", ev_sql("""
SELECT transaction_id, amount, location FROM txn_events
WHERE transaction_id = (SELECT max(transaction_id) FROM txn_events WHERE is_fraud = 1)"""))
def q_lookup_by_id(spark, sf):
    df = txn_events(spark, sf)
    target = df.where(F.col("is_fraud") == 1).agg(F.max("transaction_id")).scalar()
    return df.where(F.col("transaction_id") == target).select("transaction_id", "amount", "location")


@register("filter_trailing", ev_sql("""
SELECT transaction_id, amount FROM gi WHERE global_index >= _total - 1000""", GI_SQL))
def q_filter_trailing(spark, sf):
    df = txn_events(spark, sf).select("transaction_id", "ts", "amount")
    gi = global_index(df, ["ts", "transaction_id"])
    return gi.where(trailing(F.col("global_index"), F.col("_total"), 1000)).select(
        "transaction_id", "amount")


@register("src_head", ev_sql("""
SELECT transaction_id, amount FROM txn_events ORDER BY ts, transaction_id LIMIT 500"""))
def q_src_head(spark, sf):
    from ..operators.order import head
    return head(txn_events(spark, sf), ["ts", "transaction_id"], 500).select("transaction_id", "amount")
