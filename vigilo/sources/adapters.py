"""Transaction views over the driver tables.

Both adapters are plain projections/joins, so every query that starts from
them keeps its scan pruned to the columns it needs.  ``EVENTS_CTE`` /
``LINEITEM_CTE`` are the same views as DuckDB CTE text for the oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import read_table

# Category domains of the transaction schema (the reference's
# published census), in their natural (sorted) order.
MERCHANT_CATEGORIES = ["entertainment", "grocery", "online", "other",
                       "restaurant", "retail", "travel", "utilities"]
LOCATIONS = ["Berlin", "Dubai", "London", "New York", "Singapore", "Sydney",
             "Tokyo", "Toronto"]
PAYMENT_CHANNELS = ["ACH", "UPI", "card", "wire_transfer"]
DEVICES = ["atm", "mobile", "pos", "web"]

CATEGORICALS = ["transaction_type", "merchant_category", "payment_channel",
                "device_used", "location"]
SCORES = ["spending_deviation_score", "velocity_score", "geo_anomaly_score"]


def _pick(values: list[str], idx: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), idx + F.lit(1))


def txn_events(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """``events`` re-read as a transactions table (one row per event); ``events`` may
    be a stream of the table."""
    ev = read_table(spark, sf_dir, "events") if events is None else events
    k = F.get_json_object("props", "$.k").cast("int")
    eid, uid = F.col("event_id"), F.col("user_id")
    is_fraud = (F.col("event_type") == "error").cast("int")
    return ev.select(
        eid.alias("transaction_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        uid.alias("sender_account"),
        ((uid * 7 + k) % 97).alias("receiver_account"),
        F.col("value").alias("amount"),
        F.when(F.col("event_type") == "error", F.lit("view"))
         .otherwise(F.col("event_type")).alias("transaction_type"),
        _pick(MERCHANT_CATEGORIES, F.floor(k / 8).cast("int") % 8).alias("merchant_category"),
        _pick(LOCATIONS, k % 8).alias("location"),
        _pick(DEVICES, (eid % 4).cast("int")).alias("device_used"),
        is_fraud.alias("is_fraud"),
        F.when(is_fraud == 1, F.lit("account_takeover")).alias("fraud_type"),
        F.when(eid % 6 == 0, F.lit(None).cast("double"))
         .otherwise(((eid * 7919) % 15778 - 8777).cast("double"))
         .alias("time_since_last_transaction"),
        ((k - 50) / 25).alias("spending_deviation_score"),
        (k % 20 + 1).alias("velocity_score"),
        ((k % 101) / 100).alias("geo_anomaly_score"),
        _pick(PAYMENT_CHANNELS, k % 4).alias("payment_channel"),
        (eid % 5000).alias("ip_address"),
        (uid * 31 + k % 5).alias("device_hash"),
        k.alias("k"),
    )


def txn_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem ⋈ orders ⋈ customer ⋈ nation ⋈ part as transactions.

    Day-granular ship dates give many timestamp ties per customer.  Only
    ``nation`` (25 rows, a fixed size) is hinted for broadcast; the other
    joins are left to AQE, which picks broadcast vs sort-merge from runtime
    sizes.  Orders meet their customers first, so line items are shuffled for
    orders and parts only.
    """
    li = read_table(spark, sf_dir, "lineitem")
    o = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    p = read_table(spark, sf_dir, "part").select("p_partkey", "p_type")
    oc = o.join(c, o.o_custkey == c.c_custkey).join(F.broadcast(n), c.c_nationkey == n.n_nationkey)
    j = li.join(p, li.l_partkey == p.p_partkey).join(oc, li.l_orderkey == oc.o_orderkey)
    tid = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                      F.date_format("l_shipdate", "yyyyMMdd"),
                      F.round(F.col("l_extendedprice") * 100).cast("bigint"))
    return j.select(
        tid.alias("transaction_id"),
        F.col("l_shipdate").cast("timestamp").alias("ts"),
        F.col("o_custkey").alias("sender_account"),
        F.col("l_suppkey").alias("receiver_account"),
        F.col("l_extendedprice").alias("amount"),
        F.col("o_orderstatus").alias("transaction_type"),
        F.col("p_type").alias("merchant_category"),
        F.col("n_name").alias("location"),
        F.col("l_linestatus").alias("device_used"),
        (F.col("l_returnflag") == "R").cast("int").alias("is_fraud"),
        F.col("o_orderpriority").alias("payment_channel"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_discount").alias("discount"),
    )


def _sql_list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


EVENTS_CTE = f"""txn_events AS (
  SELECT event_id AS transaction_id,
         CAST(ts AS TIMESTAMP) AS ts,
         user_id AS sender_account,
         (user_id * 7 + k) % 97 AS receiver_account,
         value AS amount,
         CASE WHEN event_type = 'error' THEN 'view' ELSE event_type END AS transaction_type,
         {_sql_list(MERCHANT_CATEGORIES)}[((k // 8) % 8) + 1] AS merchant_category,
         {_sql_list(LOCATIONS)}[(k % 8) + 1] AS location,
         {_sql_list(DEVICES)}[CAST(event_id % 4 AS INTEGER) + 1] AS device_used,
         CAST(event_type = 'error' AS INTEGER) AS is_fraud,
         CASE WHEN event_type = 'error' THEN 'account_takeover' END AS fraud_type,
         CASE WHEN event_id % 6 = 0 THEN NULL
              ELSE CAST((event_id * 7919) % 15778 - 8777 AS DOUBLE) END AS time_since_last_transaction,
         (k - 50) / 25 AS spending_deviation_score,
         k % 20 + 1 AS velocity_score,
         (k % 101) / 100 AS geo_anomaly_score,
         {_sql_list(PAYMENT_CHANNELS)}[(k % 4) + 1] AS payment_channel,
         event_id % 5000 AS ip_address,
         user_id * 31 + k % 5 AS device_hash,
         k
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events) e
)"""

LINEITEM_CTE = """txn_lineitem AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey,
                   strftime(l_shipdate, '%Y%m%d'),
                   CAST(round(l_extendedprice * 100) AS BIGINT)) AS transaction_id,
         CAST(l_shipdate AS TIMESTAMP) AS ts,
         o_custkey AS sender_account,
         l_suppkey AS receiver_account,
         l_extendedprice AS amount,
         o_orderstatus AS transaction_type,
         p_type AS merchant_category,
         n_name AS location,
         l_linestatus AS device_used,
         CAST(l_returnflag = 'R' AS INTEGER) AS is_fraud,
         o_orderpriority AS payment_channel,
         l_quantity AS quantity,
         l_discount AS discount
  FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey
  JOIN part ON l_partkey = p_partkey
)"""
