"""Registered queries: profiling / lift / drift aggregates (§2.5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import features as FT
from ..operators import profile as P
from ..operators.order import global_index, split_flag
from ..sources.adapters import CATEGORICALS, txn_events, txn_lineitem
from .registry import ev_sql, li_sql, register


def _cat_union(cols, extra="is_fraud"):
    return "\n  UNION ALL ".join(
        f"SELECT '{c}' AS feature, CAST({c} AS VARCHAR) AS value, {extra} FROM txn_events"
        for c in cols)


LIFT_SQL = f"""
u AS ({_cat_union(CATEGORICALS)}),
g AS (SELECT feature, value, COUNT(*) AS tx_count, CAST(SUM(is_fraud) AS BIGINT) AS fraud_count
      FROM u GROUP BY feature, value),
h AS (SELECT *, SUM(fraud_count) OVER (PARTITION BY feature) / SUM(tx_count) OVER (PARTITION BY feature) AS grate
      FROM g)"""


@register("agg_lift_segment", ev_sql("""
SELECT feature, value, tx_count, fraud_count, round(fraud_count / tx_count * 100, 6) AS fraud_rate,
       round(fraud_count / tx_count / grate, 6) AS lift
FROM h WHERE value IS NOT NULL""", LIFT_SQL))
def q_agg_lift_segment(spark, sf):
    return P.lift_table(txn_events(spark, sf), CATEGORICALS)


@register("agg_rate_minmax", ev_sql("""
SELECT feature, max(fraud_rate) AS max_rate, min(fraud_rate) AS min_rate, max(lift) AS max_lift,
       min(lift) AS min_lift, COUNT(*) AS n_values FROM t GROUP BY feature""", LIFT_SQL,
    """t AS (SELECT feature, round(fraud_count / tx_count * 100, 6) AS fraud_rate,
               round(fraud_count / tx_count / grate, 6) AS lift FROM h WHERE value IS NOT NULL)"""))
def q_agg_rate_minmax(spark, sf):
    return P.rate_minmax(txn_events(spark, sf), CATEGORICALS)


PAIRS = [("transaction_type", "payment_channel"), ("transaction_type", "device_used"),
         ("merchant_category", "payment_channel")]


@register("agg_lift_pair", ev_sql("""
SELECT pair, v1, v2, tx_count, fraud_count, round(fraud_count / tx_count * 100, 6) AS fraud_rate,
       round(lift, 6) AS lift, CAST(rnk AS INTEGER) AS rnk
FROM (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY lift DESC, v1, v2) AS rnk
      FROM (SELECT *, fraud_count / tx_count / grate AS lift FROM h2
            WHERE v1 IS NOT NULL AND v2 IS NOT NULL AND tx_count >= 100) x) y
WHERE rnk <= 10""", "u2 AS (" + "\n  UNION ALL ".join(
    f"SELECT '{a}|{b}' AS pair, CAST({a} AS VARCHAR) AS v1, CAST({b} AS VARCHAR) AS v2, is_fraud FROM txn_events"
    for a, b in PAIRS) + ")",
    """g2 AS (SELECT pair, v1, v2, COUNT(*) AS tx_count, CAST(SUM(is_fraud) AS BIGINT) AS fraud_count
       FROM u2 GROUP BY pair, v1, v2)""",
    """h2 AS (SELECT *, SUM(fraud_count) OVER (PARTITION BY pair) / SUM(tx_count) OVER (PARTITION BY pair) AS grate
       FROM g2)"""))
def q_agg_lift_pair(spark, sf):
    return P.lift_pairs(txn_events(spark, sf), PAIRS, min_support=100, top=10)


@register("agg_summary", ev_sql("""
SELECT COUNT(*) AS rows, epoch_us(min(ts)) AS min_ts_us, epoch_us(max(ts)) AS max_ts_us,
       CAST(SUM(is_fraud) AS BIGINT) AS fraud_count, COUNT(*) - CAST(SUM(is_fraud) AS BIGINT) AS legit_count,
       round(SUM(is_fraud) / COUNT(*) * 100, 6) AS fraud_rate
FROM txn_events"""))
def q_agg_summary(spark, sf):
    return P.summary(txn_events(spark, sf))


# Spark type names of the txn_events columns, in column order.
EVENT_TYPES = [("transaction_id", "bigint"), ("ts", "timestamp"), ("sender_account", "bigint"),
               ("receiver_account", "bigint"), ("amount", "double"), ("transaction_type", "string"),
               ("merchant_category", "string"), ("location", "string"), ("device_used", "string"),
               ("is_fraud", "int"), ("fraud_type", "string"), ("time_since_last_transaction", "double"),
               ("spending_deviation_score", "double"), ("velocity_score", "int"),
               ("geo_anomaly_score", "double"), ("payment_channel", "string"), ("ip_address", "bigint"),
               ("device_hash", "bigint"), ("k", "int")]

ROLE_SQL = """CASE WHEN contains(col, 'score') THEN 'behavioral score'
     WHEN contains(col, 'account') OR col IN ('ip_address', 'device_hash') THEN 'High-cardinality ID (Leakage Risk)'
     WHEN col = 'timestamp' OR dtype = 'timestamp' THEN 'timestamp'
     WHEN col = 'is_fraud' THEN 'target'
     WHEN col = 'fraud_type' THEN 'Leakage Risk (Target Leak)'
     WHEN dtype IN ('tinyint', 'smallint', 'int', 'bigint', 'float', 'double') THEN 'numeric'
     ELSE 'categorical' END"""

AUDIT_SQL = "a AS (" + "\n UNION ALL ".join(
    f"SELECT '{c}' AS col, '{t}' AS dtype, CAST(COUNT(*) - COUNT({c}) AS BIGINT) AS missing, "
    f"COUNT(*) AS n, CAST(COUNT(DISTINCT {c}) AS BIGINT) AS unique_count FROM txn_events"
    for c, t in EVENT_TYPES) + ")"


@register("agg_schema_audit", ev_sql(f"""
SELECT col AS "column", dtype, missing, round(missing / n * 100, 6) AS missing_pct, unique_count,
       {ROLE_SQL} AS role FROM a""", AUDIT_SQL))
def q_agg_schema_audit(spark, sf):
    return P.schema_audit(txn_events(spark, sf))


@register("column_role", ev_sql(f"""
SELECT col AS "column", dtype, {ROLE_SQL} AS role FROM a""", AUDIT_SQL))
def q_column_role(spark, sf):
    return P.schema_audit(txn_events(spark, sf)).select("column", "dtype", "role")


@register("agg_imbalance", ev_sql("""
SELECT round((1 - p) * 100, 6) AS majority_accuracy,
       round(CASE WHEN p > 0 THEN (1 - p) / p ELSE 0.0 END, 6) AS imbalance_ratio
FROM (SELECT avg(is_fraud) AS p FROM txn_events)"""))
def q_agg_imbalance(spark, sf):
    return P.imbalance(txn_events(spark, sf))


@register("agg_rate_by_hour", ev_sql("""
SELECT hour(ts) AS hour, COUNT(*) AS tx_count, round(avg(is_fraud) * 100, 6) AS fraud_rate
FROM txn_events GROUP BY 1"""))
def q_agg_rate_by_hour(spark, sf):
    return P.rate_by(txn_events(spark, sf), F.hour("ts"), "hour")


def _describe_sql(col, pcts, src="txn_events", by="is_fraud"):
    arr = "[" + ", ".join(str(p) for p in pcts) + "]"
    cols = ", ".join(f"round(q[{i + 1}], 6) AS p{int(round(p * 100))}" for i, p in enumerate(pcts))
    return f"""
SELECT {by}, count, mean, std, min, {cols}, max FROM (
  SELECT {by}, COUNT({col}) AS count, round(avg({col}), 6) AS mean, round(stddev_samp({col}), 6) AS std,
         min({col}) AS min, quantile_cont({col}, {arr}) AS q, max({col}) AS max
  FROM {src} GROUP BY {by})"""


@register("agg_describe_by_label", ev_sql(_describe_sql("amount", P.DESCRIBE_PCTS)))
def q_agg_describe_by_label(spark, sf):
    return P.describe_by(txn_events(spark, sf), "amount")


@register("agg_describe_by_label_li", li_sql(_describe_sql("amount", [.25, .5, .75, .9, .99],
                                                           "txn_lineitem")))
def q_agg_describe_by_label_li(spark, sf):
    return P.describe_by(txn_lineitem(spark, sf), "amount", pcts=[.25, .5, .75, .9, .99])


MED_COLS = ["time_since_last_transaction", "spending_deviation_score", "velocity_score",
            "geo_anomaly_score"]


@register("agg_median_by_label", ev_sql("SELECT is_fraud, " + ", ".join(
    f"round(median({c}), 6) AS median_{c}" for c in MED_COLS) + " FROM txn_events GROUP BY is_fraud"))
def q_agg_median_by_label(spark, sf):
    return P.median_by(txn_events(spark, sf), MED_COLS)


_T = "time_since_last_transaction"


@register("agg_sign_audit", ev_sql(f"""
SELECT CAST(count_if({_T} IS NULL) AS BIGINT) AS null_count, CAST(count_if({_T} < 0) AS BIGINT) AS negative_count,
       CAST(count_if({_T} = 0) AS BIGINT) AS zero_count, CAST(count_if({_T} > 0) AS BIGINT) AS positive_count,
       min({_T}) AS min, max({_T}) AS max, round(avg({_T}), 6) AS mean, round(median({_T}), 6) AS median,
       """ + ", ".join(f"round(quantile_cont({_T}, {p}), 6) AS p{int(round(p * 100))}" for p in P.DESCRIBE_PCTS) + f""",
       round(count_if({_T} < 0 AND is_fraud = 1) / count_if(is_fraud = 1) * 100, 6) AS neg_rate_fraud,
       round(count_if({_T} < 0 AND is_fraud = 0) / count_if(is_fraud = 0) * 100, 6) AS neg_rate_legit
FROM txn_events"""))
def q_agg_sign_audit(spark, sf):
    return P.sign_audit(txn_events(spark, sf), _T)


@register("agg_lift_flag", ev_sql("""
SELECT tslt_is_missing, tx_count, fraud_count, median_amount,
       round(fraud_count / tx_count * 100, 6) AS fraud_rate,
       round(fraud_count / tx_count / (SUM(fraud_count) OVER () / SUM(tx_count) OVER ()), 6) AS lift
FROM (SELECT CAST(time_since_last_transaction IS NULL AS INTEGER) AS tslt_is_missing,
             COUNT(*) AS tx_count, CAST(SUM(is_fraud) AS BIGINT) AS fraud_count,
             round(median(amount), 6) AS median_amount
      FROM txn_events GROUP BY 1)"""))
def q_agg_lift_flag(spark, sf):
    return P.lift_by_flag(FT.feat_tslt_flags(txn_events(spark, sf)), "tslt_is_missing")


def _bucket_sql(col, q):
    probs = "[" + ", ".join(repr(i / q) for i in range(q + 1)) + "]"
    return f"""
, e AS (SELECT list_sort(list_distinct(quantile_cont({col}, {probs}))) AS edges FROM txn_events)
, b AS (SELECT len(list_filter(edges[2:len(edges) - 1], lambda x: x < {col})) AS bucket, is_fraud, edges
        FROM txn_events, e)
, g AS (SELECT bucket, COUNT(*) AS tx_count, CAST(SUM(is_fraud) AS BIGINT) AS fraud_count,
               any_value(edges) AS edges FROM b GROUP BY bucket)
SELECT CAST(bucket AS INTEGER) AS bucket, round(edges[bucket + 1], 6) AS lower,
       round(edges[bucket + 2], 6) AS upper, tx_count, fraud_count,
       round(fraud_count / tx_count * 100, 6) AS fraud_rate,
       round(fraud_count / tx_count / (SUM(fraud_count) OVER () / SUM(tx_count) OVER ()), 6) AS lift
FROM g"""


def _ctes_body(body):
    """Split a ', x AS (...)' prefixed body into extra CTEs + final SELECT."""
    parts = body.strip().lstrip(",").strip()
    i = parts.rindex("\nSELECT ")
    return parts[:i], parts[i + 1:]


def _ev_with(body):
    ctes, sel = _ctes_body(body)
    return ev_sql(sel, ctes.replace("\n, ", ",\n"))


@register("agg_lift_bucket", _ev_with(_bucket_sql("amount", 10)))
def q_agg_lift_bucket(spark, sf):
    return P.lift_buckets(txn_events(spark, sf), "amount", 10)


@register("agg_lift_bucket_velocity", _ev_with(_bucket_sql("velocity_score", 5)))
def q_agg_lift_bucket_velocity(spark, sf):
    return P.lift_buckets(txn_events(spark, sf), "velocity_score", 5)


ENTITIES = ["sender_account", "receiver_account", "device_hash", "ip_address"]


@register("agg_entity_top", ev_sql("""
SELECT entity_col, 'fraud_count' AS ranking, entity, tx_count, fraud_count, NULL::DOUBLE AS fraud_rate,
       CAST(rnk AS INTEGER) AS rnk
FROM (SELECT *, row_number() OVER (PARTITION BY entity_col ORDER BY fraud_count DESC, entity) AS rnk FROM eg)
WHERE rnk <= 5
UNION ALL
SELECT entity_col, 'fraud_rate', entity, tx_count, fraud_count, fraud_rate, CAST(rnk AS INTEGER)
FROM (SELECT *, row_number() OVER (PARTITION BY entity_col ORDER BY fraud_rate DESC, entity) AS rnk
      FROM (SELECT *, round(fraud_count / tx_count * 100, 6) AS fraud_rate FROM eg WHERE tx_count >= 20))
WHERE rnk <= 5""", "eu AS (" + "\n UNION ALL ".join(
    f"SELECT '{e}' AS entity_col, CAST({e} AS VARCHAR) AS entity, is_fraud FROM txn_events"
    for e in ENTITIES) + ")",
    """eg AS (SELECT entity_col, entity, COUNT(*) AS tx_count, CAST(SUM(is_fraud) AS BIGINT) AS fraud_count
       FROM eu GROUP BY entity_col, entity)"""))
def q_agg_entity_top(spark, sf):
    return P.entity_top(txn_events(spark, sf), ENTITIES)


@register("agg_customer_stats", ev_sql("""
SELECT sender_account, round(avg(amount), 6) AS amount_mean, max(amount) AS amount_max,
       COUNT(amount) AS amount_count, CAST(SUM(is_fraud) AS BIGINT) AS fraud_sum,
       round(avg(is_fraud), 6) AS fraud_rate
FROM txn_events GROUP BY sender_account"""))
def q_agg_customer_stats(spark, sf):
    return P.customer_stats(txn_events(spark, sf))


@register("agg_consistency", ev_sql("""
SELECT value, value_count, CAST(SUM(a) OVER () AS BIGINT) AS missing_in_positive,
       CAST(SUM(b) OVER () AS BIGINT) AS present_in_negative
FROM (SELECT fraud_type AS value, COUNT(*) AS value_count,
             count_if(is_fraud = 1 AND fraud_type IS NULL) AS a,
             count_if(is_fraud = 0 AND fraud_type IS NOT NULL) AS b
      FROM txn_events GROUP BY fraud_type)"""))
def q_agg_consistency(spark, sf):
    return P.consistency(txn_events(spark, sf))


@register("agg_value_counts", ev_sql("""
SELECT value, value_count, round(value_count / SUM(value_count) OVER (), 6) AS share
FROM (SELECT transaction_type AS value, COUNT(*) AS value_count FROM txn_events GROUP BY 1)"""))
def q_agg_value_counts(spark, sf):
    return P.value_counts(txn_events(spark, sf), "transaction_type", normalize=True)


@register("agg_graph_stats", _ev_with("""
, deg AS (SELECT sender_account, COUNT(*) AS deg FROM txn_events GROUP BY 1)
, dev AS (SELECT device_hash, COUNT(DISTINCT sender_account) AS ns FROM txn_events GROUP BY 1)
, pr AS (SELECT sender_account, receiver_account, COUNT(*) AS c FROM txn_events GROUP BY 1, 2)
, x AS (
SELECT (SELECT COUNT(*) FROM txn_events) AS edges,
       (SELECT COUNT(DISTINCT sender_account) FROM txn_events) AS senders,
       (SELECT COUNT(DISTINCT receiver_account) FROM txn_events) AS receivers,
       (SELECT COUNT(DISTINCT device_hash) FROM txn_events) AS devices,
       (SELECT round(avg(deg), 6) FROM deg) AS degree_avg,
       (SELECT round(median(deg), 6) FROM deg) AS degree_p50,
       (SELECT round(quantile_cont(deg, 0.99), 6) FROM deg) AS degree_p99,
       (SELECT CAST(max(deg) AS BIGINT) FROM deg) AS degree_max,
       (SELECT round(avg(CAST(ns > 1 AS DOUBLE)) * 100, 6) FROM dev) AS pct_devices_shared,
       (SELECT round(avg(CAST(c > 1 AS DOUBLE)) * 100, 6) FROM pr) AS pct_pairs_repeated)
SELECT *, CASE WHEN pct_devices_shared < 5 AND pct_pairs_repeated < 5 THEN 'sparse' ELSE 'dense' END AS density
FROM x"""))
def q_agg_graph_stats(spark, sf):
    return P.graph_stats(txn_events(spark, sf))


GI_SQL = """gi AS (SELECT *, row_number() OVER (ORDER BY ts, transaction_id) - 1 AS global_index,
                  COUNT(*) OVER () AS _total FROM txn_events)"""


@register("agg_drift_split", ev_sql("""
SELECT split, COUNT(*) AS tx_count, round(avg(is_fraud) * 100, 6) AS fraud_rate,
       max(cutoff_us) AS cutoff_us
FROM (SELECT CASE WHEN global_index < floor(_total * 0.8) THEN 'train_inner' ELSE 'validation' END AS split,
             is_fraud,
             max(CASE WHEN global_index = floor(_total * 0.8) THEN epoch_us(ts) END) OVER () AS cutoff_us
      FROM gi) GROUP BY split""", GI_SQL))
def q_agg_drift_split(spark, sf):
    from ..operators.profile import drift_split
    df = txn_events(spark, sf).select("transaction_id", "ts", "is_fraud")
    return drift_split(global_index(df, ["ts", "transaction_id"]))


@register("agg_flag_audit_splits", ev_sql("""
SELECT dataset, CAST(SUM(m) AS BIGINT) AS tslt_missing, CAST(SUM(ng) AS BIGINT) AS tslt_negative,
       COUNT(*) AS tx_count
FROM (SELECT CAST(time_since_last_transaction IS NULL AS INTEGER) AS m,
             CAST(coalesce(time_since_last_transaction < 0, false) AS INTEGER) AS ng,
             unnest(['all', CASE WHEN global_index < floor(_total * 0.8) THEN 'train' ELSE 'val' END]) AS dataset
      FROM gi) GROUP BY dataset""", GI_SQL))
def q_agg_flag_audit_splits(spark, sf):
    from ..operators.profile import flag_audit_splits
    df = FT.feat_tslt_flags(txn_events(spark, sf)).select(
        "transaction_id", "ts", "tslt_is_missing", "tslt_is_negative")
    gi = global_index(df, ["ts", "transaction_id"])
    gi = gi.withColumn("split", F.when(split_flag(F.col("global_index"), F.col("_total")) == 1,
                                       "train").otherwise("val"))
    return flag_audit_splits(gi, ["tslt_is_missing", "tslt_is_negative"],
                             names=["tslt_missing", "tslt_negative"])
