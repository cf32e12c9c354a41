"""Review queue and analyst feedback as append logs + derived views.

The queue is an append-only log of writes (transaction_id, written_at,
risk_score, risk_band, raw_json); "insert or replace" becomes *latest write
per id*, computed with ``max_by`` (a grouped aggregate with partial combine,
so a hot id cannot stall one task).  Feedback is a second append log; a
queue row's status is REVIEWED_<decision> when its latest feedback is not
older than its latest write, else PENDING (a replacement resets it).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Analyst decisions and their training labels.
DECISION_LABEL = {"CONFIRM_FRAUD": 1, "FALSE_ALARM": 0, "ESCALATE": -1}


def latest(log: DataFrame, key: str, version: str) -> DataFrame:
    """The newest row of each key; of equal versions the one with the larger hash."""
    cols = [c for c in log.columns if c != key]
    agg = log.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(F.col(version), F.xxhash64(*cols))).alias("_r"))
    return agg.select(key, "_r.*")


def queue_state(queue_log: DataFrame, feedback_log: DataFrame) -> DataFrame:
    q = latest(queue_log, "transaction_id", "written_at")
    fb = latest(feedback_log.select("transaction_id", "reviewed_at", "analyst_decision"),
                "transaction_id", "reviewed_at")
    j = q.join(fb, "transaction_id", "left")
    reviewed = F.col("reviewed_at").isNotNull() & (F.col("reviewed_at") >= F.col("written_at"))
    return j.withColumn("status", F.when(reviewed, F.concat(F.lit("REVIEWED_"), F.col("analyst_decision")))
                        .otherwise(F.lit("PENDING")))


def pending(state: DataFrame, limit: int = 100, payload_schema: str | None = None) -> DataFrame:
    p = state.where(F.col("status") == "PENDING").orderBy(F.desc("risk_score"), "transaction_id").limit(limit)
    if payload_schema:
        p = p.withColumn("_p", F.from_json("raw_json", payload_schema)).select(
            "*", "_p.*").drop("_p")
    return p


def feedback_label(decision) -> F.Column:
    e = F.lit(None).cast("int")
    for d, v in DECISION_LABEL.items():
        e = F.when(decision == d, F.lit(v)).otherwise(e)
    return e


def queue_stats(state: DataFrame, feedback_log: DataFrame) -> DataFrame:
    by_status = state.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    total_fb = feedback_log.agg(F.count(F.lit(1)).alias("n")).select(F.lit("TOTAL_FEEDBACK").alias("status"), "n")
    return by_status.unionByName(total_fb)


def override_rate(feedback_log: DataFrame) -> DataFrame:
    """Daily monitor: reviews, analyst override (false-alarm) share, escalations."""
    d = feedback_log.withColumn("day", F.to_date("reviewed_at"))
    return d.groupBy("day").agg(
        F.count(F.lit(1)).alias("reviews"),
        F.avg((F.col("analyst_decision") == "FALSE_ALARM").cast("double")).alias("override_rate"),
        F.count_if(F.col("analyst_decision") == "ESCALATE").alias("escalations"))
