"""Flagship: leakage-safe novelty features on the events transactions and
the lift of each novelty flag (windows + one-scan grouped lift)."""

from __future__ import annotations

from ..functions import features as FT
from ..operators import past as P
from ..operators import profile as PR
from ..sources.adapters import txn_events
from .registry import ev_sql, register

S = "sender_account"
NOV = ["location", "payment_channel", "device_used", "transaction_type"]
FLAGS = [f"is_new_{v}_for_sender" for v in NOV] + ["tslt_is_missing", "is_night"]


def flagship(spark, sf):
    d = FT.feat_base(txn_events(spark, sf)).select("transaction_id", "ts", S, *NOV, "tslt_is_missing", "is_night", "is_fraud")
    d = P.novelties(d, S, {f"is_new_{v}_for_sender": v for v in NOV})
    return PR.lift_table(d, FLAGS)


_U = "\n  UNION ALL ".join(f"SELECT '{c}' AS feature, CAST({c} AS VARCHAR) AS value, is_fraud FROM f" for c in FLAGS)


@register("flagship_novelty_lift", ev_sql("""
SELECT feature, value, tx_count, fraud_count, round(fraud_count / tx_count * 100, 6) AS fraud_rate,
       round(fraud_count / tx_count / grate, 6) AS lift
FROM h WHERE value IS NOT NULL""",
    "f AS (SELECT *, " + ", ".join(
        f"CAST(rank() OVER (PARTITION BY {S}, {v} ORDER BY ts) = 1 AS INTEGER) AS is_new_{v}_for_sender" for v in NOV)
    + ", CAST(time_since_last_transaction IS NULL AS INTEGER) AS tslt_is_missing,"
      " CAST(hour(ts) BETWEEN 0 AND 5 AS INTEGER) AS is_night FROM txn_events)",
    f"u AS ({_U})",
    """g AS (SELECT feature, value, COUNT(*) AS tx_count, CAST(SUM(is_fraud) AS BIGINT) AS fraud_count
      FROM u GROUP BY feature, value)""",
    """h AS (SELECT *, SUM(fraud_count) OVER (PARTITION BY feature) / SUM(tx_count) OVER (PARTITION BY feature) AS grate
      FROM g)"""))
def q_flagship_novelty_lift(spark, sf):
    return flagship(spark, sf)
