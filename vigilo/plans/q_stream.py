"""Registered queries: streaming operators (§2.12), with their batch twins as SQL
where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ml as ML
from ..streaming import job as SJ
from .q_metrics import SCORED_SQL, scored
from .registry import ev_sql, register

S = "sender_account"
PAST = f"OVER (PARTITION BY {S} ORDER BY ts, transaction_id)"


def _stream(spark, sf):
    return scored(spark, sf, SJ.event_stream(spark, sf))


def _features(spark, sf, history=None, since_us=None):
    """The table replayed in several batches of bounded size."""
    rows = scored(spark, sf)
    if since_us is not None:
        rows = rows.where(F.unix_micros("ts") >= since_us)
    tables, _ = SJ.run_to_end(SJ.stateful_features(rows, history), "features", {"features": lambda b: b}, conf=SJ.STATE_CONF)
    return tables["features"].drop("epoch")


@register("src_stream", ev_sql("""
SELECT transaction_id, sender_account, epoch_us(ts) AS ts_us, amount, is_fraud FROM txn_events"""))
def q_src_stream(spark, sf):
    cols = ["transaction_id", S, F.unix_micros("ts").alias("ts_us"), "amount", "is_fraud"]
    tables, _ = SJ.run_to_end(_stream(spark, sf).select(*cols), "source", {"rows": lambda b: b})
    return tables["rows"].drop("epoch")


TSLT_SQL = f"""CASE WHEN row_number() {PAST} = 1 THEN time_since_last_transaction
            ELSE (epoch_us(ts) - lag(epoch_us(ts)) {PAST}) / 1e6 END"""
NEW_SQL = ", ".join(f"CAST(row_number() OVER (PARTITION BY {S}, {v} ORDER BY ts, transaction_id) = 1 AS INTEGER) AS is_new_{v}_for_sender" for v in SJ.VALUES)


@register("stream_features", ev_sql(f"""
SELECT transaction_id, round(t, 6) AS stream_tslt, CAST(coalesce(t < 0, false) AS INTEGER) AS tslt_is_negative, history_len,
       hour(ts) AS hour, (dayofweek(ts) + 6) % 7 AS day_of_week, month(ts) AS month, {", ".join(f"is_new_{v}_for_sender" for v in SJ.VALUES)}
FROM (SELECT *, {TSLT_SQL} AS t, CAST(least(row_number() {PAST} - 1, 50) AS INTEGER) AS history_len, {NEW_SQL} FROM txn_events)"""))
def q_stream_features(spark, sf):
    f = _features(spark, sf)
    return f.select("transaction_id", F.round("stream_tslt", 6).alias("stream_tslt"), "tslt_is_negative", "history_len", "hour",
                    F.col("day_of_week").cast("long").alias("day_of_week"), "month", *[f"is_new_{v}_for_sender" for v in SJ.VALUES])


@register("stream_tslt", ev_sql(f"""
SELECT transaction_id, round(t, 6) AS stream_tslt, CAST(coalesce(t < 0, false) AS INTEGER) AS tslt_is_negative
FROM (SELECT *, {TSLT_SQL} AS t FROM txn_events)"""))
def q_stream_tslt(spark, sf):
    return _features(spark, sf).select("transaction_id", F.round("stream_tslt", 6).alias("stream_tslt"), "tslt_is_negative")


@register("stream_history", ev_sql(f"""
SELECT transaction_id, CAST(least(row_number() {PAST} - 1, 50) AS INTEGER) AS history_len FROM txn_events"""))
def q_stream_history(spark, sf):
    return _features(spark, sf).select("transaction_id", "history_len")


# the stream starts after two thirds of the time; the rows before are its history
CUT_SQL = "cut AS (SELECT min(epoch_us(ts)) + (max(epoch_us(ts)) - min(epoch_us(ts))) // 3 * 2 AS c FROM txn_events)"


@register("stream_novelty", ev_sql(f"""
SELECT transaction_id, {", ".join(f"is_new_{v}_for_sender" for v in SJ.VALUES)}
FROM (SELECT *, {NEW_SQL} FROM txn_events), cut WHERE epoch_us(ts) >= c""", CUT_SQL))
def q_stream_novelty(spark, sf):
    events = scored(spark, sf)
    r = events.agg(F.min(F.unix_micros("ts")).alias("a"), F.max(F.unix_micros("ts")).alias("b")).first()
    cut = None if r.a is None else r.a + (r.b - r.a) // 3 * 2
    f = _features(spark, sf, events.where(F.unix_micros("ts") < F.lit(cut)), cut)
    return f.select("transaction_id", *[f"is_new_{v}_for_sender" for v in SJ.VALUES])


ROUTE_SQL = """CASE WHEN score >= 0.80 THEN 'AUTO_BLOCKED' WHEN score >= 0.02 THEN 'REVIEW_QUEUED' ELSE 'PASSED' END"""


@register("stream_route", ev_sql(f"SELECT transaction_id, {ROUTE_SQL} AS route FROM scored", SCORED_SQL))
def q_stream_route(spark, sf):
    tables, _ = SJ.decisions(_stream(spark, sf), "score")
    return tables["decisions"].select("transaction_id", "route")


@register("stream_score")
def q_stream_score(spark, sf):
    """A pipeline fitted on the batch features is saved, loaded and applied inside the stream."""
    model = ML.stream_model(spark, sf)
    tables, _ = SJ.decisions(SJ.model_score(SJ.stateful_features(scored(spark, sf)), model), conf=SJ.STATE_CONF)
    return tables["decisions"].select("transaction_id", "risk_score", "risk_band", "route")


@register("agg_route_stats", ev_sql(f"SELECT {ROUTE_SQL} AS route, COUNT(*) AS n FROM scored GROUP BY 1", SCORED_SQL))
def q_agg_route_stats(spark, sf):
    tables, _ = SJ.decisions(_stream(spark, sf), "score")
    return tables["decisions"].groupBy("route").agg(F.count(F.lit(1)).alias("n"))


@register("stream_metrics")
def q_stream_metrics(spark, sf):
    tables, progress = SJ.decisions(_stream(spark, sf), "score")
    return SJ.batch_metrics(tables["decisions"], progress)


@register("stream_window_tumbling", ev_sql("""
SELECT epoch_us(ts) // 3600000000 * 3600000000 AS start_us, COUNT(*) AS n, CAST(SUM(is_fraud) AS BIGINT) AS frauds
FROM txn_events GROUP BY 1"""))
def q_stream_window_tumbling(spark, sf):
    w, _ = SJ.stream_windows(scored(spark, sf), "tumbling")
    return w.select(F.unix_micros("window.start").alias("start_us"), "n", "frauds")


@register("stream_window_sliding", ev_sql("""
SELECT sender_account, (epoch_us(ts) // 3600000000 - i) * 3600000000 AS start_us, COUNT(*) AS n, round(SUM(amount), 6) AS amount_sum
FROM txn_events, range(24) r(i) GROUP BY 1, 2"""))
def q_stream_window_sliding(spark, sf):
    w, _ = SJ.stream_windows(scored(spark, sf), "sliding")
    return w.select(S, F.unix_micros("window.start").alias("start_us"), "n", F.round("amount_sum", 6).alias("amount_sum"))


@register("stream_session", ev_sql(f"""
SELECT sender_account, min(t) AS start_us, COUNT(*) AS n
FROM (SELECT *, SUM(new) OVER (PARTITION BY {S} ORDER BY t ROWS UNBOUNDED PRECEDING) AS session
      FROM (SELECT {S}, epoch_us(ts) AS t,
                   CAST(coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY {S} ORDER BY ts) > 1800000000, true) AS INTEGER) AS new
            FROM txn_events))
GROUP BY sender_account, session"""))
def q_stream_session(spark, sf):
    w, _ = SJ.stream_windows(scored(spark, sf), "session")
    return w.select(S, F.unix_micros("session_window.start").alias("start_us"), "n")


@register("stream_dedup", ev_sql("SELECT DISTINCT transaction_id FROM txn_events"))
def q_stream_dedup(spark, sf):
    rows = scored(spark, sf)
    found, _ = SJ.stream_windows(rows.unionByName(rows), "dedup")
    return found.select("transaction_id")


# every fiftieth event comes behind all others; those whose window has closed by then are dropped
@register("stream_window_late", ev_sql("""
SELECT start_us, COUNT(*) AS n, CAST(SUM(is_fraud) AS BIGINT) AS frauds
FROM (SELECT *, epoch_us(ts) // 3600000000 * 3600000000 AS start_us, transaction_id % 50 = 0 AS late FROM txn_events),
     (SELECT max(epoch_us(ts)) // 1000 * 1000 - 7200000000 AS mark FROM txn_events WHERE transaction_id % 50 <> 0)
WHERE NOT late OR start_us + 3600000000 > mark GROUP BY 1"""))
def q_stream_window_late(spark, sf):
    w, _ = SJ.stream_windows(scored(spark, sf), "tumbling", late="transaction_id % 50 = 0")
    return w.where("n > 0").select(F.unix_micros("window.start").alias("start_us"), "n", "frauds")
