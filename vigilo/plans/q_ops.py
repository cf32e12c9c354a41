"""Registered queries: joins, sets, queue/feedback, text, bands, cascades,
JSON/CSV sources and sinks (§2.1, §2.4, §2.8, §2.11 subset, §2.13, §2.14)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import bands as BD
from ..functions import features as FT
from ..functions import text as TX
from ..operators import joins as J
from ..operators import knn as K
from ..operators import ml as ML
from ..operators import monitors as MO
from ..operators import past as P
from ..operators import profile as PR
from ..operators import queue as QU
from ..operators.order import global_index, sample_stratified, split_flag
from ..operators.profile import r6
from ..operators.ranks import quantile_list
from ..session import stored
from ..sources.adapters import CATEGORICALS, txn_events
from ..sources.tables import read_table
from .q_metrics import SCORED_SQL, scored
from .q_profile import _ev_with
from .registry import ev_sql, register

S = "sender_account"
GI_SQL = """gi AS (SELECT *, row_number() OVER (ORDER BY ts, transaction_id) - 1 AS global_index,
                  COUNT(*) OVER () AS _total FROM txn_events)"""


def _split(spark, sf, *cols):
    d = txn_events(spark, sf).select("transaction_id", "ts", *cols)
    g = global_index(d, ["ts", "transaction_id"])
    return g.withColumn("is_train", split_flag(F.col("global_index"), F.col("_total")))


# ---- joins ---------------------------------------------------------------

@register("join_left_equi", ev_sql(f"""
SELECT t.transaction_id, round(s.amount_mean, 6) AS amount_mean, round(s.fraud_rate, 6) AS fraud_rate
FROM txn_events t LEFT JOIN (SELECT {S}, avg(amount) AS amount_mean, avg(is_fraud) AS fraud_rate
                             FROM txn_events GROUP BY {S}) s USING ({S})"""))
def q_join_left_equi(spark, sf):
    d = txn_events(spark, sf)
    stats = d.groupBy(S).agg(F.avg("amount").alias("amount_mean"), F.avg("is_fraud").alias("fraud_rate"))
    j = J.left_equi(d.select("transaction_id", S), stats, S)
    return j.select("transaction_id", r6("amount_mean").alias("amount_mean"), r6("fraud_rate").alias("fraud_rate"))


@register("join_map_encode", ev_sql("""
SELECT v.transaction_id, round(coalesce(r.rate, g.rate), 6) AS merchant_category_fraud_rate
FROM gi v LEFT JOIN (SELECT merchant_category, avg(is_fraud) AS rate FROM gi
                     WHERE global_index < floor(_total * 0.8) GROUP BY 1) r USING (merchant_category),
     (SELECT avg(is_fraud) AS rate FROM gi WHERE global_index < floor(_total * 0.8)) g
WHERE v.global_index >= floor(v._total * 0.8)""", GI_SQL))
def q_join_map_encode(spark, sf):
    g = _split(spark, sf, "merchant_category", "is_fraud")
    out = J.map_encode(g.where(F.col("is_train") == 0), g.where(F.col("is_train") == 1), "merchant_category")
    return out.select("transaction_id", r6("merchant_category_fraud_rate").alias("merchant_category_fraud_rate"))


@register("join_membership", ev_sql(f"""
SELECT v.transaction_id, CAST(h.{S} IS NULL AS INTEGER) AS is_new_location_for_sender
FROM gi v LEFT JOIN (SELECT DISTINCT {S}, location FROM gi WHERE global_index < floor(_total * 0.8)) h
  USING ({S}, location)
WHERE v.global_index >= floor(v._total * 0.8)""", GI_SQL))
def q_join_membership(spark, sf):
    g = _split(spark, sf, S, "location")
    hist = g.where(F.col("is_train") == 1)
    out = J.membership(g.where(F.col("is_train") == 0), hist, [S, "location"], "is_new_location_for_sender")
    return out.select("transaction_id", "is_new_location_for_sender")


@register("join_membership_anti", ev_sql(f"""
SELECT transaction_id FROM gi v WHERE global_index >= floor(_total * 0.8) AND NOT EXISTS (
  SELECT 1 FROM gi h WHERE h.global_index < floor(h._total * 0.8) AND h.{S} = v.{S} AND h.device_used = v.device_used)"""
                                       , GI_SQL))
def q_join_membership_anti(spark, sf):
    g = _split(spark, sf, S, "device_used")
    out = J.membership(g.where(F.col("is_train") == 0), g.where(F.col("is_train") == 1),
                       [S, "device_used"], "x", how="anti")
    return out.select("transaction_id")


NOVELTY4 = ["location", "device_used", "payment_channel", "transaction_type"]


def _ev_flags(spark, sf, *columns, running=()):
    """``columns`` of the transactions with their base features, and the novelty flags and other running measures of the sender."""
    d = FT.feat_base(txn_events(spark, sf)).select(*dict.fromkeys(["transaction_id", "ts", S, *NOVELTY4, *columns]))
    flags = {f"is_new_{v}_for_sender": v for v in NOVELTY4}
    d = P.together(d, [S], [([S, v], {o: ("count", None)}, "strict") for o, v in flags.items()] + [([S], m, "strict") for m in running])
    return d.withColumns({o: (F.col(o) == 0).cast("int") for o in flags})


NOV_SQL = "nov AS (SELECT *, " + ", ".join(
    f"CAST(rank() OVER (PARTITION BY {S}, {v} ORDER BY ts) = 1 AS INTEGER) AS is_new_{v}_for_sender"
    for v in NOVELTY4) + ", CAST(hour(ts) BETWEEN 0 AND 5 AS INTEGER) AS is_night, " \
    "CAST(time_since_last_transaction IS NULL AS INTEGER) AS tslt_is_missing FROM txn_events)"


LEH = "(((transaction_id % 2147483647) * 48271 + 42) % 2147483647 * 48271 + 42) % 2147483647"


CASES_PER_LABEL = 3000
CASE_NUM = ["amount", "log_amount", "spending_deviation_score", "velocity_score", "geo_anomaly_score", "hour", "day_of_week", "month",
            "is_weekend", "is_night", "tslt_abs", "tslt_is_negative", *[f"is_new_{v}_for_sender" for v in NOVELTY4]]
CASE_SHOWN = ["amount", "payment_channel", "device_used", "transaction_type"]
# Vectors as the models see them: nulls to the median (most frequent value), numbers scaled, a place per known category; all
# fitted on the rows with a time since the last transaction.  Two known categories that differ are 2 apart, squared.
NEAR_SQL = f"""
, {NOV_SQL}
, feats AS (SELECT *, ln(1 + amount) AS log_amount, hour(ts) AS hour, isodow(ts) - 1 AS day_of_week, month(ts) AS month,
                   CAST(isodow(ts) >= 6 AS INTEGER) AS is_weekend, abs(time_since_last_transaction) AS tslt_abs,
                   CAST(coalesce(time_since_last_transaction < 0, false) AS INTEGER) AS tslt_is_negative FROM nov)
, fitted AS (SELECT * FROM feats WHERE tslt_is_missing = 0)
, med AS (SELECT {", ".join(f"median({c}) AS m_{c}" for c in CASE_NUM)}, {", ".join(f"list_sort(list(DISTINCT {c})) AS known_{c}" for c in CATEGORICALS)} FROM fitted)
, usual AS (SELECT {", ".join(f"(SELECT {c} FROM fitted WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY COUNT(*) DESC, 1 LIMIT 1) AS u_{c}" for c in CATEGORICALS)})
, imp AS (SELECT transaction_id, tslt_is_missing, {", ".join(f"coalesce({c}, m_{c}) AS {c}" for c in CASE_NUM)},
                 {", ".join(f"CASE WHEN list_contains(known_{c}, coalesce({c}, u_{c})) THEN coalesce({c}, u_{c}) END AS {c}" for c in CATEGORICALS)}
          FROM feats, med, usual)
, st AS (SELECT {", ".join(f"avg({c}) AS m_{c}, CASE WHEN stddev_pop({c}) > 0 THEN stddev_pop({c}) ELSE 1 END AS s_{c}" for c in CASE_NUM)} FROM imp WHERE tslt_is_missing = 0)
, vecs AS (SELECT transaction_id, [{", ".join(f"({c} - m_{c}) / s_{c}" for c in CASE_NUM)}]::DOUBLE[{len(CASE_NUM)}] AS v, {", ".join(CATEGORICALS)} FROM imp, st)
, corpus AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY is_fraud ORDER BY {LEH}, transaction_id) AS rn
                           FROM txn_events) WHERE rn <= {CASES_PER_LABEL})
, cv AS (SELECT vecs.* FROM vecs SEMI JOIN corpus USING (transaction_id))
, d AS (SELECT q.transaction_id AS query_id, c.transaction_id AS match_id, sqrt(pow(array_distance(q.v, c.v), 2)
               {"".join(f" + CASE WHEN q.{c} = c.{c} THEN 0 ELSE CAST(q.{c} IS NOT NULL AS INTEGER) + CAST(c.{c} IS NOT NULL AS INTEGER) END" for c in CATEGORICALS)}) AS dist
        FROM vecs q, cv c)
, t AS (SELECT query_id, arg_min({{'m': match_id, 'd': dist}}, (round(dist, 9), match_id), 3) AS top FROM d GROUP BY query_id)
, nn AS (SELECT query_id, top[i].m AS match_id, round(top[i].d, 6) AS score, CAST(i AS INTEGER) AS rank
         FROM t, range(1, 4) r(i) WHERE top[i].m IS NOT NULL)"""


def _case_rows(spark, sf):
    """Every transaction with the columns of the case search, written once."""
    own = [c for c in CASE_NUM if not c.startswith("is_new_")]
    d = _ev_flags(spark, sf, "is_fraud", "tslt_is_missing", *own, *CATEGORICALS).select("transaction_id", "is_fraud", "tslt_is_missing", *[F.col(c).cast("double").alias(c) for c in CASE_NUM], *CATEGORICALS)
    return stored(d, "case-rows")


def _nearest_cases(d):
    """The three nearest cases of every transaction in a sample of 3000 for each label, by the whole preprocessed vector."""
    corpus = stored(sample_stratified(d, "is_fraud", CASES_PER_LABEL, "transaction_id"), "cases")
    vectors = stored(ML.case_vectors(d, d.where("tslt_is_missing = 0"), CASE_NUM, CATEGORICALS, "transaction_id"), "case-vectors")
    found = K.nearest(vectors, vectors.join(corpus.select("transaction_id"), "transaction_id", "left_semi"), 3, q_id="transaction_id", c_id="transaction_id")
    return corpus, found.select("query_id", "match_id", "score", "rank")


@register("join_knn", _ev_with(NEAR_SQL + "\nSELECT query_id, match_id, score, rank FROM nn"))
def q_join_knn(spark, sf):
    _, nn = _nearest_cases(_case_rows(spark, sf))
    return nn.select("query_id", "match_id", r6("score").alias("score"), "rank")


@register("join_cosine_topk", """
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings),
d AS (SELECT q.vec_id AS query_id, c.vec_id AS match_id, list_cosine_similarity(q.v, c.v) AS sim
      FROM e q, e c WHERE c.label = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, match_id, round(sim, 6) AS score, CAST(rk AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 9) DESC, match_id) AS rk FROM d) WHERE rk <= 3""")
def q_join_cosine_topk(spark, sf):
    e = read_table(spark, sf, "embeddings").withColumn("vec", J.l2_normalize("embedding"))
    out = J.topk_similar(e, e.where(F.col("label") == 0), 3, "ip", q_id="vec_id", c_id="vec_id",
                         exclude_self=True)
    return out.select("query_id", "match_id", r6("score").alias("score"), "rank")


@register("join_self_past_label", ev_sql(f"""
SELECT transaction_id, CAST(coalesce(SUM(is_fraud) OVER (PARTITION BY receiver_account ORDER BY epoch_us(ts)
       RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 0 AS INTEGER) AS receiver_had_fraud_before
FROM txn_events"""))
def q_join_self_past_label(spark, sf):
    d = P.running(txn_events(spark, sf).select("transaction_id", "ts", "receiver_account", "is_fraud"),
                  ["receiver_account"], {"_p": ("sum", F.col("is_fraud"))}, ties="strict")
    return d.select("transaction_id", FT.flag(F.col("_p") > 0).alias("receiver_had_fraud_before"))


# ---- sets ----------------------------------------------------------------

@register("union_tagged", ev_sql(f"""
SELECT transaction_id, CAST(global_index >= floor(_total * 0.8) AS INTEGER) AS is_test,
       row_number() OVER (PARTITION BY {S} ORDER BY ts, transaction_id) - 1 AS sender_tx_index
FROM gi""", GI_SQL))
def q_union_tagged(spark, sf):
    g = _split(spark, sf, S)
    train = g.where(F.col("is_train") == 1).withColumn("is_test", F.lit(0))
    test = g.where(F.col("is_train") == 0).withColumn("is_test", F.lit(1))
    u = train.unionByName(test)
    u = P.seq_index(u.select("transaction_id", "ts", S, "is_test"), S, "sender_tx_index")
    return u.select("transaction_id", "is_test", "sender_tx_index")


@register("union_weighted", ev_sql("""
SELECT is_fraud, CAST(SUM(w) AS BIGINT) AS weighted_rows FROM (
  SELECT is_fraud, 1 AS w FROM txn_events
  UNION ALL SELECT is_fraud, 3 FROM txn_events WHERE velocity_score >= 18) GROUP BY is_fraud"""))
def q_union_weighted(spark, sf):
    d = txn_events(spark, sf)
    fb = d.where(F.col("velocity_score") >= 18).select("is_fraud").withColumn(
        "_rep", F.explode(F.sequence(F.lit(1), F.lit(3)))).drop("_rep")
    u = d.select("is_fraud").unionByName(fb)
    return u.groupBy("is_fraud").agg(F.count(F.lit(1)).alias("weighted_rows"))


@register("union_cases", ev_sql(f"""
SELECT transaction_id, is_fraud FROM (
  SELECT *, row_number() OVER (PARTITION BY is_fraud ORDER BY {LEH}, transaction_id) AS rn FROM txn_events)
WHERE (is_fraud = 1 AND rn <= 20) OR (is_fraud = 0 AND rn <= 30)"""))
def q_union_cases(spark, sf):
    d = txn_events(spark, sf)
    pos = sample_stratified(d.where(F.col("is_fraud") == 1), "is_fraud", 20, "transaction_id")
    neg = sample_stratified(d.where(F.col("is_fraud") == 0), "is_fraud", 30, "transaction_id")
    return pos.unionByName(neg).select("transaction_id", "is_fraud")


# ---- review queue / feedback --------------------------------------------

QUEUE_SQL = """qlog AS (
  SELECT transaction_id, epoch_us(ts) AS written_at, score AS risk_score,
         CASE WHEN score >= 0.9 THEN 'High' ELSE 'Review' END AS risk_band, amount, location
  FROM scored WHERE score >= 0.8
  UNION ALL
  SELECT transaction_id, epoch_us(ts) + 86400000000, score_fine,
         CASE WHEN score_fine >= 0.95 THEN 'High' ELSE 'Review' END, amount, location
  FROM scored WHERE score_fine >= 0.9),
q AS (SELECT transaction_id, arg_max(written_at, written_at) AS written_at,
             arg_max(risk_score, written_at) AS risk_score, arg_max(risk_band, written_at) AS risk_band,
             arg_max(amount, written_at) AS amount, arg_max(location, written_at) AS location
      FROM qlog GROUP BY transaction_id),
fb AS (SELECT q.transaction_id, q.written_at + 7200000000 AS reviewed_at,
              CASE WHEN s.is_fraud = 1 THEN 'CONFIRM_FRAUD' WHEN s.velocity_score >= 15 THEN 'ESCALATE'
                   ELSE 'FALSE_ALARM' END AS analyst_decision
       FROM (SELECT transaction_id, min(written_at) AS written_at FROM qlog GROUP BY 1) q
       JOIN scored s USING (transaction_id) WHERE hour(s.ts) < 12),
st AS (SELECT q.*, f.reviewed_at, f.analyst_decision,
              CASE WHEN f.reviewed_at >= q.written_at THEN 'REVIEWED_' || f.analyst_decision ELSE 'PENDING' END AS status
       FROM q LEFT JOIN fb f USING (transaction_id))"""


def _queue_logs(spark, sf):
    s = scored(spark, sf)
    t = F.unix_micros("ts")
    w1 = s.where(F.col("score") >= 0.8).select(
        "transaction_id", t.alias("written_at"), F.col("score").alias("risk_score"),
        F.when(F.col("score") >= 0.9, "High").otherwise("Review").alias("risk_band"), "amount", "location")
    w2 = s.where(F.col("score_fine") >= 0.9).select(
        "transaction_id", (t + F.lit(P.DAY_US)).alias("written_at"), F.col("score_fine").alias("risk_score"),
        F.when(F.col("score_fine") >= 0.95, "High").otherwise("Review").alias("risk_band"), "amount", "location")
    qlog = w1.unionByName(w2)
    first = qlog.groupBy("transaction_id").agg(F.min("written_at").alias("written_at"))
    fb = (first.join(s.select("transaction_id", "ts", "is_fraud", "velocity_score"), "transaction_id")
          .where(F.hour("ts") < 12)
          .select("transaction_id", (F.col("written_at") + F.lit(7_200_000_000)).alias("reviewed_at"),
                  F.when(F.col("is_fraud") == 1, "CONFIRM_FRAUD").when(F.col("velocity_score") >= 15, "ESCALATE")
                  .otherwise("FALSE_ALARM").alias("analyst_decision")))
    return qlog, fb


@register("queue_upsert", ev_sql("""
SELECT transaction_id, written_at, round(risk_score, 6) AS risk_score, risk_band FROM q""", SCORED_SQL, QUEUE_SQL))
def q_queue_upsert(spark, sf):
    qlog, _ = _queue_logs(spark, sf)
    q = QU.latest(qlog, "transaction_id", "written_at")
    return q.select("transaction_id", "written_at", r6("risk_score").alias("risk_score"), "risk_band")


@register("queue_compaction", ev_sql("""
SELECT transaction_id, written_at, round(risk_score, 6) AS risk_score, risk_band FROM q""", SCORED_SQL, QUEUE_SQL))
def q_queue_compaction(spark, sf):
    """The log in three batches, compacted after two, one of them replayed: the latest rows are those of the whole log."""
    from ..operators import queue_log as QL
    from ..session import scratch_path
    qlog, _ = _queue_logs(spark, sf)
    base, part = scratch_path(spark, "queue"), F.col("transaction_id") % 3
    QL.append(base, 0, qlog.where(part == 0))
    QL.append(base, 1, qlog.where(part == 1))
    QL.compact(spark, base, "transaction_id", "written_at")
    QL.append(base, 1, qlog.where(part == 1))
    QL.append(base, 2, qlog.where(part == 2))
    q = QU.latest(QL.log(spark, base), "transaction_id", "written_at")
    return q.select("transaction_id", "written_at", r6("risk_score").alias("risk_score"), "risk_band")


@register("sink_queue_upsert", ev_sql("""
SELECT transaction_id, written_at, round(risk_score, 6) AS risk_score, risk_band, status FROM st""",
                                      SCORED_SQL, QUEUE_SQL))
def q_sink_queue_upsert(spark, sf):
    qlog, fb = _queue_logs(spark, sf)
    st = QU.queue_state(qlog, fb)
    return st.select("transaction_id", "written_at", r6("risk_score").alias("risk_score"), "risk_band", "status")


@register("feedback_submit", ev_sql("""
SELECT f.transaction_id, f.analyst_decision, st.status, round(st.amount, 6) AS amount, coalesce(st.transaction_id IS NOT NULL, false) AS known
FROM (SELECT transaction_id, analyst_decision FROM fb UNION ALL SELECT -transaction_id - 1, analyst_decision FROM fb) f
LEFT JOIN st ON f.transaction_id = st.transaction_id""", SCORED_SQL, QUEUE_SQL))
def q_feedback_submit(spark, sf):
    """Feedback with the queue's payload; ids the queue doesn't know (here: negative ones) stay, without payload."""
    qlog, fb = _queue_logs(spark, sf)
    st = QU.queue_state(qlog, fb).select("transaction_id", "status", "amount", F.lit(True).alias("known"))
    own = fb.select("transaction_id", "analyst_decision")
    unknown = own.select((-F.col("transaction_id") - 1).alias("transaction_id"), "analyst_decision")
    j = own.unionByName(unknown).join(st, "transaction_id", "left")
    return j.select("transaction_id", "analyst_decision", "status", r6("amount").alias("amount"), F.coalesce("known", F.lit(False)).alias("known"))


@register("join_queue_feedback", ev_sql("""
SELECT q.transaction_id, q.risk_band, f.analyst_decision FROM q JOIN fb f USING (transaction_id)""",
                                        SCORED_SQL, QUEUE_SQL))
def q_join_queue_feedback(spark, sf):
    qlog, fb = _queue_logs(spark, sf)
    q = QU.latest(qlog, "transaction_id", "written_at")
    return q.join(fb, "transaction_id").select("transaction_id", "risk_band", "analyst_decision")


@register("queue_pending", ev_sql("""
SELECT transaction_id, round(risk_score, 6) AS risk_score, risk_band, amount, location FROM st
WHERE status = 'PENDING' ORDER BY risk_score DESC, transaction_id LIMIT 100""", SCORED_SQL, QUEUE_SQL))
def q_queue_pending(spark, sf):
    qlog, fb = _queue_logs(spark, sf)
    qlog = qlog.withColumn("raw_json", F.to_json(F.struct("amount", "location"))).drop("amount", "location")
    st = QU.queue_state(qlog, fb)
    p = QU.pending(st, 100, payload_schema="amount DOUBLE, location STRING")
    return p.select("transaction_id", r6("risk_score").alias("risk_score"), "risk_band", "amount", "location")


@register("queue_topn", ev_sql("""
SELECT transaction_id, round(risk_score, 6) AS risk_score FROM st
WHERE status = 'PENDING' ORDER BY risk_score DESC, transaction_id LIMIT 200""", SCORED_SQL, QUEUE_SQL))
def q_queue_topn(spark, sf):
    qlog, fb = _queue_logs(spark, sf)
    p = QU.pending(QU.queue_state(qlog, fb), 200)
    return p.select("transaction_id", r6("risk_score").alias("risk_score"))


@register("queue_get", ev_sql("""
SELECT transaction_id, round(risk_score, 6) AS risk_score, risk_band FROM q
WHERE transaction_id = (SELECT max(transaction_id) FROM q)""", SCORED_SQL, QUEUE_SQL))
def q_queue_get(spark, sf):
    qlog, _ = _queue_logs(spark, sf)
    q = QU.latest(qlog, "transaction_id", "written_at")
    target = q.agg(F.max("transaction_id")).scalar()
    return q.where(F.col("transaction_id") == target).select(
        "transaction_id", r6("risk_score").alias("risk_score"), "risk_band")


@register("feedback_all", ev_sql("""
SELECT transaction_id, reviewed_at, analyst_decision FROM fb""", SCORED_SQL, QUEUE_SQL))
def q_feedback_all(spark, sf):
    _, fb = _queue_logs(spark, sf)
    return fb.orderBy(F.desc("reviewed_at"), "transaction_id").select(
        "transaction_id", "reviewed_at", "analyst_decision")


@register("queue_stats", ev_sql("""
SELECT status, COUNT(*) AS n FROM st GROUP BY status
UNION ALL SELECT 'TOTAL_FEEDBACK', COUNT(*) FROM fb""", SCORED_SQL, QUEUE_SQL))
def q_queue_stats(spark, sf):
    qlog, fb = _queue_logs(spark, sf)
    return QU.queue_stats(QU.queue_state(qlog, fb), fb)


@register("agg_queue_stats", ev_sql("""
SELECT status, COUNT(*) AS n FROM st GROUP BY status
UNION ALL SELECT 'TOTAL_FEEDBACK', COUNT(*) FROM fb""", SCORED_SQL, QUEUE_SQL))
def q_agg_queue_stats(spark, sf):
    return q_queue_stats(spark, sf)


@register("feedback_label", ev_sql("""
SELECT transaction_id, CASE analyst_decision WHEN 'CONFIRM_FRAUD' THEN 1 WHEN 'FALSE_ALARM' THEN 0 ELSE -1 END AS label
FROM fb WHERE analyst_decision <> 'ESCALATE'""", SCORED_SQL, QUEUE_SQL))
def q_feedback_label(spark, sf):
    _, fb = _queue_logs(spark, sf)
    d = fb.withColumn("label", QU.feedback_label(F.col("analyst_decision")))
    return d.where(F.col("label").isin(0, 1)).select("transaction_id", "label")


@register("override_rate", ev_sql("""
SELECT strftime(make_timestamp(reviewed_at), '%Y-%m-%d') AS day, COUNT(*) AS reviews,
       round(avg(CAST(analyst_decision = 'FALSE_ALARM' AS DOUBLE)), 6) AS override_rate,
       count_if(analyst_decision = 'ESCALATE') AS escalations FROM fb GROUP BY 1""", SCORED_SQL, QUEUE_SQL))
def q_override_rate(spark, sf):
    _, fb = _queue_logs(spark, sf)
    o = QU.override_rate(fb.withColumn("reviewed_at", F.timestamp_micros("reviewed_at")))
    return o.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "reviews", r6("override_rate").alias("override_rate"), "escalations")


# the rendered transaction stands for a generated brief; phrases that occur in it stand for forbidden ones
RENDER_PHRASES = ["tokyo", "travel"]
MONITOR_SQL = [
    SCORED_SQL, QUEUE_SQL,
    """g AS (SELECT *, row_number() OVER (ORDER BY ts, transaction_id) - 1 AS global_index, COUNT(*) OVER () AS _total,
                   strftime(ts, '%Y-%m-%d') AS day, score_fine AS s,
                   (merchant_category = 'travel' OR location = 'Tokyo') AS violated, CAST(transaction_id % 10 = 0 AS BOOLEAN) AS unparsed FROM scored)""",
    "ref AS (SELECT * FROM g WHERE global_index < floor(_total * 0.8))", "cur AS (SELECT * FROM g WHERE global_index >= floor(_total * 0.8))",
    "cuts AS (SELECT quantile_cont(s, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS c FROM ref)",
    "bins AS (SELECT CAST(unnest(range(10)) AS BIGINT) AS b)",
    "rb AS (SELECT len(list_filter(c, lambda x: s > x)) AS b, COUNT(*) / (SELECT COUNT(*) FROM ref) AS r FROM ref, cuts GROUP BY 1)",
    "cb AS (SELECT day, len(list_filter(c, lambda x: s > x)) AS b, COUNT(*) AS k FROM cur, cuts GROUP BY 1, 2)",
    "days AS (SELECT day, COUNT(*) AS n FROM cur GROUP BY 1)",
    """psi AS (SELECT day, n, SUM((p - r) * ln(p / r)) AS value FROM (
         SELECT day, n, greatest(coalesce(k, 0) / n, 1e-4) AS p, greatest(coalesce(rb.r, 0), 1e-4) AS r
         FROM days CROSS JOIN bins LEFT JOIN rb USING (b) LEFT JOIN cb USING (day, b)) GROUP BY 1, 2)""",
    """ks AS (SELECT day, any_value(n) AS n, max(abs(fc - fr)) AS value FROM (
         SELECT day, n, SUM(o) OVER w / n AS fc, SUM(1 - o) OVER w / (SELECT COUNT(*) FROM ref) AS fr
         FROM (SELECT day, s, 1 AS o FROM cur UNION ALL SELECT x.day, ref.s, 0 FROM ref CROSS JOIN days x) JOIN days USING (day)
         WINDOW w AS (PARTITION BY day ORDER BY s RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) GROUP BY 1)""",
]


@register("monitor_drift", ev_sql("""
SELECT day, monitor, CAST(n AS BIGINT) AS n, round(value, 6) AS value FROM (
  SELECT day, 'score_psi' AS monitor, n, value FROM psi
  UNION ALL SELECT day, 'score_ks', n, value FROM ks
  UNION ALL SELECT day, 'fraud_rate_drift', COUNT(*), avg(is_fraud) - (SELECT avg(is_fraud) FROM ref) FROM cur GROUP BY 1
  UNION ALL SELECT day, 'tslt_missing_drift', COUNT(*), avg(CAST(time_since_last_transaction IS NULL AS INTEGER))
            - (SELECT avg(CAST(time_since_last_transaction IS NULL AS INTEGER)) FROM ref) FROM cur GROUP BY 1
  UNION ALL SELECT day, 'guardrail_failure_rate', COUNT(*), avg(CAST(violated AS INTEGER)) FROM cur GROUP BY 1
  UNION ALL SELECT day, 'fallback_rate', COUNT(*), avg(CAST(violated OR unparsed AS INTEGER)) FROM cur GROUP BY 1
  UNION ALL SELECT strftime(make_timestamp(written_at), '%Y-%m-%d'), 'queue_volume', COUNT(*), COUNT(*) FROM q GROUP BY 1
  UNION ALL SELECT strftime(make_timestamp(reviewed_at), '%Y-%m-%d'), 'override_rate', COUNT(*), avg(CAST(analyst_decision = 'FALSE_ALARM' AS INTEGER)) FROM fb GROUP BY 1)""",
                                  *MONITOR_SQL))
def q_monitor_drift(spark, sf):
    """One row per day and monitor.  The reference of the drifts is the first 80 % of the rows by time, the days are those
    after it; queue volume and overrides cover every day of the logs."""
    d = scored(spark, sf)
    text = F.concat_ws(" ", "merchant_category", "location", "device_used")
    violated = F.size(TX.guardrail_violations(text, RENDER_PHRASES)) > 0
    payload = F.to_json(F.struct("transaction_id", "amount"))
    payload = F.when(F.col("transaction_id") % 10 == 0, F.substring(payload, 2, 10)).otherwise(payload)
    unparsed = F.from_json(payload, "transaction_id LONG, amount DOUBLE")["transaction_id"].isNull()
    d = d.select("transaction_id", "ts", "is_fraud", "score_fine", F.date_format("ts", "yyyy-MM-dd").alias("day"),
                 F.col("time_since_last_transaction").isNull().alias("tslt_missing"), violated.alias("violated"), (violated | unparsed).alias("fallback"))
    g = global_index(d, ["ts", "transaction_id"])
    split = split_flag(F.col("global_index"), F.col("_total"))
    ref, cur = g.where(split == 1), g.where(split == 0)
    drift = MO.rates(cur, {"fraud_rate_drift": F.col("is_fraud"), "tslt_missing_drift": F.col("tslt_missing")}, reference=ref)
    plain = MO.rates(cur, {"guardrail_failure_rate": F.col("violated"), "fallback_rate": F.col("fallback")})
    qlog, fb = _queue_logs(spark, sf)
    day = lambda c: F.date_format(F.timestamp_micros(c), "yyyy-MM-dd").alias("day")
    volume = QU.latest(qlog, "transaction_id", "written_at").groupBy(day("written_at")).agg(F.count(F.lit(1)).alias("n")).select("day", F.lit("queue_volume").alias("monitor"), "n", F.col("n").cast("double").alias("value"))
    over = MO.rates(fb.select(day("reviewed_at"), "analyst_decision"), {"override_rate": F.col("analyst_decision") == "FALSE_ALARM"})
    parts = [f(cur, ref, "score_fine").select("day", F.lit(name).alias("monitor"), "n", "value") for name, f in (("score_psi", MO.psi), ("score_ks", MO.ks))]
    out = parts[0]
    for p in [parts[1], drift, plain, volume, over]:
        out = out.unionByName(p)
    return out.select("day", "monitor", "n", r6("value").alias("value"))


# ---- text / briefs -------------------------------------------------------

# phrases that occur in the synthetic documents (the reference list never does)
DOC_PHRASES = ["the", "tion", "eau", "ung", "ç", "sch"]


@register("text_guardrail", f"""
SELECT doc_id, array_to_string(v, '|') AS violations, CAST(len(v) = 0 AS INTEGER) AS is_valid
FROM (SELECT doc_id, list_filter({[p for p in DOC_PHRASES]}, lambda p: instr(lower(text), p) > 0) AS v
      FROM documents)""")
def q_text_guardrail(spark, sf):
    d = read_table(spark, sf, "documents")
    v = TX.guardrail_violations(F.col("text"), DOC_PHRASES)
    return d.select("doc_id", F.array_join(v, "|").alias("violations"), (F.size(v) == 0).cast("int").alias("is_valid"))


@register("text_guardrail_reference", f"""
SELECT conv_id, turn, CAST(len(list_filter({[p for p in TX.FORBIDDEN_PHRASES]},
       lambda p: instr(lower(text), p) > 0)) = 0 AS INTEGER) AS is_valid FROM conversations""")
def q_text_guardrail_reference(spark, sf):
    d = read_table(spark, sf, "conversations")
    return d.select("conv_id", "turn", (F.size(TX.guardrail_violations(F.col("text"), TX.FORBIDDEN_PHRASES)) == 0)
                    .cast("int").alias("is_valid"))


@register("text_strip_think", """
SELECT page_id, length(trim(regexp_replace(html, '(?s)<script>.*?</script>', '', 'g'))) AS stripped_len FROM pages""")
def q_text_strip_think(spark, sf):
    d = read_table(spark, sf, "pages")
    return d.select("page_id", F.length(TX.strip_block(F.col("html"), "script")).alias("stripped_len"))


@register("text_extract_pred", """
SELECT conv_id, turn, CASE regexp_extract(upper(text), 'PREDICTION:\\s*(NON FRAUDE|FRAUDE)', 1)
       WHEN 'FRAUDE' THEN 1 WHEN 'NON FRAUDE' THEN 0 END AS llm_prediction FROM conversations""")
def q_text_extract_pred(spark, sf):
    d = read_table(spark, sf, "conversations")
    return d.select("conv_id", "turn", TX.extract_label(F.col("text")).alias("llm_prediction"))


@register("text_eval", """
SELECT COUNT(*) AS n, count_if(p = y) AS correct, round(count_if(p = y) / COUNT(*), 6) AS accuracy FROM (
  SELECT CAST(regexp_matches(lower(text), 'the') AS INTEGER) AS p, quality AS y
  FROM documents JOIN labels USING (doc_id))""")
def q_text_eval(spark, sf):
    """Parsed text predictions (here: a keyword rule) against labels."""
    d = read_table(spark, sf, "documents").join(read_table(spark, sf, "labels"), "doc_id")
    d = d.select(F.lower("text").contains("the").cast("int").alias("p"), F.col("quality").alias("y"))
    return d.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("p") == F.col("y")).alias("correct"),
                 r6(F.count_if(F.col("p") == F.col("y")) / F.count(F.lit(1))).alias("accuracy"))


@register("filter_parsed", """
SELECT conv_id, turn FROM conversations
WHERE regexp_extract(upper(text), 'PREDICTION:\\s*(NON FRAUDE|FRAUDE)', 1) <> ''""")
def q_filter_parsed(spark, sf):
    d = read_table(spark, sf, "conversations").withColumn("p", TX.extract_label(F.col("text")))
    return d.dropna(subset=["p"]).select("conv_id", "turn")


@register("text_tx_render", ev_sql("""
SELECT transaction_id, concat('Transaction:', chr(10), '- Montant: ', printf('%.2f', amount), ' USD', chr(10),
       '- Categorie: ', merchant_category, chr(10), '- Localisation: ', location, chr(10),
       '- Device: ', device_used) AS doc FROM txn_events"""))
def q_text_tx_render(spark, sf):
    d = txn_events(spark, sf)
    return d.select("transaction_id", F.format_string(
        "Transaction:\n- Montant: %.2f USD\n- Categorie: %s\n- Localisation: %s\n- Device: %s",
        "amount", "merchant_category", "location", "device_used").alias("doc"))


def _ev_sql_lines():
    lines = [f"CASE WHEN tslt_is_missing = 1 THEN '{TX.EVIDENCE['tslt_is_missing']}' END"]
    for v in ["location", "device_used", "payment_channel", "transaction_type"]:
        lines.append(f"CASE WHEN is_new_{v}_for_sender = 1 THEN '{TX.EVIDENCE[f'is_new_{v}_for_sender']}' END")
    lines.append("CASE WHEN is_night = 1 THEN 'Transaction occurred at night (' || hour(ts) || 'h).' END")
    lines.append("printf('Amount: $%.2f via %s (%s)', amount, payment_channel, transaction_type)")
    return "list_filter([" + ", ".join(lines) + "], lambda x: x IS NOT NULL)"


@register("evidence_build", ev_sql(f"""
SELECT transaction_id, array_to_string(CASE WHEN len(ev) <= 2 AND tslt_is_missing = 0
       THEN list_append(ev, '{TX.EVIDENCE['no_anomaly']}') ELSE ev END, '|') AS evidence
FROM (SELECT *, {_ev_sql_lines()} AS ev FROM nov)""", NOV_SQL))
def q_evidence_build(spark, sf):
    d = _ev_flags(spark, sf, "hour", "amount", "tslt_is_missing", "is_night")
    flags = {k: F.col(k) for k in ["tslt_is_missing", "is_night"] + [f"is_new_{v}_for_sender" for v in NOVELTY4]}
    ev = TX.evidence(flags, F.col("hour"), F.col("amount"), F.col("payment_channel"),
                     F.col("transaction_type"), F.col("tslt_is_missing"))
    return d.select("transaction_id", F.array_join(ev, "|").alias("evidence"))


@register("rule_flags", ev_sql(f"""
SELECT transaction_id, r1, r2, r3, r4, r5, r1 + r2 + r3 + r4 + r5 AS rule_score FROM (
  SELECT transaction_id,
    CAST(amount > 5 * avg(amount) OVER (PARTITION BY {S}) AS INTEGER) AS r1,
    is_new_location_for_sender AS r2,
    CAST(coalesce(SUM(is_fraud) OVER (PARTITION BY {S} ORDER BY epoch_us(ts)
         RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) >= 1 AS INTEGER) AS r3,
    CAST(amount > 5000 AS INTEGER) AS r4, is_night AS r5 FROM nov)""", NOV_SQL))
def q_rule_flags(spark, sf):
    d = _ev_flags(spark, sf, "amount", "is_fraud", "is_night", running=[{"_pf": ("sum", F.col("is_fraud"))}])
    mean = txn_events(spark, sf).groupBy(S).agg(F.avg("amount").alias("_m"))
    d = d.join(mean, S)
    r = {"r1": FT.flag(F.col("amount") > 5 * F.col("_m")), "r2": F.col("is_new_location_for_sender"),
         "r3": FT.flag(F.col("_pf") >= 1), "r4": FT.flag(F.col("amount") > 5000), "r5": F.col("is_night")}
    d = d.withColumns(r)
    return d.select("transaction_id", *r.keys(),
                    (F.col("r1") + F.col("r2") + F.col("r3") + F.col("r4") + F.col("r5")).alias("rule_score"))


BAND_SCORE = "score_fine * 0.1"


@register("band_fixed", ev_sql(f"""
SELECT transaction_id,
  CASE WHEN s >= 0.02 THEN 'High Risk' WHEN s >= 0.005 THEN 'Review Needed' ELSE 'Low Risk' END AS band_inference,
  CASE WHEN s >= 0.02 THEN 'High' WHEN s >= 0.005 THEN 'Review' ELSE 'Low' END AS band_stream,
  CASE WHEN s >= 0.08 THEN 'High' WHEN s >= 0.04 THEN 'Review' WHEN s >= 0.01 THEN 'Medium' ELSE 'Low' END AS band_dashboard,
  CASE WHEN s >= 0.08 THEN 'Escalate' WHEN s >= 0.04 THEN 'Manual review' WHEN s >= 0.01 THEN 'Monitor'
       ELSE 'No action' END AS action
FROM (SELECT *, {BAND_SCORE} AS s FROM scored)""", SCORED_SQL))
def q_band_fixed(spark, sf):
    d = scored(spark, sf).withColumn("s", F.col("score_fine") * 0.1)
    return d.select("transaction_id", BD.band(F.col("s"), BD.BANDS_INFERENCE).alias("band_inference"),
                    BD.band(F.col("s"), BD.BANDS_STREAM).alias("band_stream"),
                    BD.band(F.col("s"), BD.BANDS_DASHBOARD).alias("band_dashboard"),
                    BD.action(BD.band(F.col("s"), BD.BANDS_DASHBOARD)).alias("action"))


@register("stream_route_batch", ev_sql("""
SELECT CASE WHEN score_fine >= 0.80 THEN 'AUTO_BLOCKED' WHEN score_fine >= 0.02 THEN 'REVIEW_QUEUED'
            ELSE 'PASSED' END AS route, COUNT(*) AS n FROM scored GROUP BY 1""", SCORED_SQL))
def q_stream_route_batch(spark, sf):
    d = scored(spark, sf)
    return d.groupBy(BD.band(F.col("score_fine"), BD.ROUTES).alias("route")).agg(F.count(F.lit(1)).alias("n"))


@register("band_percentile", ev_sql("""
SELECT band, COUNT(*) AS n FROM (SELECT CASE WHEN score_fine >= p999 THEN 'High' WHEN score_fine >= p99 THEN 'Review'
       WHEN score_fine >= p95 THEN 'Medium' ELSE 'Low' END AS band
  FROM scored, (SELECT quantile_cont(score_fine, 0.999) AS p999, quantile_cont(score_fine, 0.99) AS p99,
                       quantile_cont(score_fine, 0.95) AS p95 FROM scored)) GROUP BY band""", SCORED_SQL))
def q_band_percentile(spark, sf):
    d = scored(spark, sf)
    p = quantile_list(d, "score_fine", [0.999, 0.99, 0.95])
    b = BD.band_percentile(F.col("score_fine"), p[0], p[1], p[2])
    return d.groupBy(b.alias("band")).agg(F.count(F.lit(1)).alias("n"))


@register("filter_band", ev_sql("""
SELECT band, transaction_id FROM (
  SELECT *, row_number() OVER (PARTITION BY band ORDER BY transaction_id) AS rn FROM (
    SELECT transaction_id, CASE WHEN score_fine >= p999 THEN 'High' WHEN score_fine >= p99 THEN 'Review'
           WHEN score_fine >= p95 THEN 'Medium' ELSE 'Low' END AS band
    FROM scored, (SELECT quantile_cont(score_fine, 0.999) AS p999, quantile_cont(score_fine, 0.99) AS p99,
                         quantile_cont(score_fine, 0.95) AS p95 FROM scored))) WHERE rn <= 2""", SCORED_SQL))
def q_filter_band(spark, sf):
    d = scored(spark, sf)
    p = quantile_list(d, "score_fine", [0.999, 0.99, 0.95])
    d = d.withColumn("band", BD.band_percentile(F.col("score_fine"), p[0], p[1], p[2]))
    w = Window.partitionBy("band").orderBy("transaction_id")
    return d.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= 2).select("band", "transaction_id")


@register("cascade_ab", ev_sql("""
SELECT transaction_id, CASE WHEN time_since_last_transaction IS NULL THEN 1e-6 ELSE score_fine END AS cascade_score
FROM scored""", SCORED_SQL))
def q_cascade_ab(spark, sf):
    d = FT.feat_tslt_flags(scored(spark, sf))
    return d.select("transaction_id", BD.cascade_ab(F.col("tslt_is_missing"), F.col("score_fine")).alias("cascade_score"))


@register("cascade_c", ev_sql("""
SELECT transaction_id, CASE WHEN time_since_last_transaction IS NULL THEN least(score, 1e-3) ELSE score_fine END
       AS cascade_score FROM scored""", SCORED_SQL))
def q_cascade_c(spark, sf):
    d = FT.feat_tslt_flags(scored(spark, sf))
    return d.select("transaction_id", BD.cascade_c(F.col("tslt_is_missing"), F.col("score"), F.col("score_fine"))
                    .alias("cascade_score"))


@register("cascade_d", ev_sql("""
SELECT transaction_id, round(CASE WHEN score >= p80 THEN score_fine ELSE score - 1.0 END, 6) AS cascade_score
FROM scored, (SELECT quantile_cont(score, 0.8) AS p80 FROM scored)""", SCORED_SQL))
def q_cascade_d(spark, sf):
    d = scored(spark, sf)
    p80 = quantile_list(d, "score", [0.8])[0]
    return d.select("transaction_id", r6(BD.cascade_d(F.col("score"), F.col("score_fine"), p80)).alias("cascade_score"))


def _chosen(column, texts):
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in texts.items()) + " END"


BRIEF_SQL = f"""
, {SCORED_SQL}
, shown AS (SELECT query_id, list(printf('%s: distance %.6f, $%.2f via %s (%s, %s)', CASE WHEN is_fraud = 1 THEN 'Fraud' ELSE 'Legitimate' END,
                   score, amount, payment_channel, transaction_type, device_used) ORDER BY rank) AS cases
            FROM nn JOIN corpus ON match_id = transaction_id GROUP BY 1)
, ev AS (SELECT transaction_id, CASE WHEN len(ev) <= 2 AND tslt_is_missing = 0 THEN list_append(ev, '{TX.EVIDENCE['no_anomaly']}') ELSE ev END AS lines
         FROM (SELECT *, {_ev_sql_lines()} AS ev FROM nov))
, banded AS (SELECT transaction_id, CASE WHEN s >= 0.08 THEN 'High' WHEN s >= 0.04 THEN 'Review' WHEN s >= 0.01 THEN 'Medium' ELSE 'Low' END AS band
             FROM (SELECT *, score_fine * 0.1 AS s FROM scored))
, titled AS (SELECT *, {_chosen("band", {b: t for b, (t, _) in TX.BRIEF.items()})} AS title FROM banded)
SELECT transaction_id, band, title, concat_ws(chr(10), title, {_chosen("title", TX.EXPLANATION)}, 'Evidence', array_to_string(list_transform(lines, lambda x: '- ' || x), chr(10)),
       'Similar Historical Cases', array_to_string(list_transform(cases, lambda x: '- ' || x), chr(10)), '{TX.NEXT_STEP_TITLE}',
       {_chosen("band", {b: n for b, (_, n) in TX.BRIEF.items()})}, '{TX.CAVEATS_TITLE}', {", ".join(f"'{c}'" for c in TX.CAVEATS)}) AS brief
FROM titled JOIN ev USING (transaction_id) JOIN shown ON query_id = transaction_id"""


@register("brief_render", _ev_with(NEAR_SQL + BRIEF_SQL))
def q_brief_render(spark, sf):
    """The report of every transaction with its evidence and its three nearest cases as text."""
    d = _case_rows(spark, sf)
    corpus, nn = _nearest_cases(d)
    cases = corpus.select(F.col("transaction_id").alias("match_id"), "is_fraud", *CASE_SHOWN)
    line = F.format_string("%s: distance %.6f, $%.2f via %s (%s, %s)", F.when(F.col("is_fraud") == 1, "Fraud").otherwise("Legitimate"),
                           r6("score"), "amount", "payment_channel", "transaction_type", "device_used")
    shown = nn.join(cases, "match_id").groupBy(F.col("query_id").alias("transaction_id")).agg(F.sort_array(F.collect_list(F.struct("rank", line.alias("line")))).alias("cases"))
    flags = {k: F.col(k) for k in ["tslt_is_missing", "is_night"] + [f"is_new_{v}_for_sender" for v in NOVELTY4]}
    lines = TX.evidence(flags, F.col("hour").cast("int"), F.col("amount"), F.col("payment_channel"), F.col("transaction_type"), F.col("tslt_is_missing"))
    scores = scored(spark, sf).select("transaction_id", BD.band(F.col("score_fine") * 0.1, BD.BANDS_DASHBOARD).alias("band"))
    d = d.select("transaction_id", lines.alias("lines")).join(shown, "transaction_id", "left").join(scores, "transaction_id")
    return d.select("transaction_id", "band", TX.brief_title(F.col("band")).alias("title"), TX.brief(F.col("band"), F.col("lines"), F.col("cases.line")).alias("brief"))


@register("case_retrieval", _ev_with(NEAR_SQL + """
SELECT query_id, rank, match_id, score AS distance, CASE WHEN is_fraud = 1 THEN 'Fraud' ELSE 'Legitimate' END AS label,
       amount, payment_channel, device_used, transaction_type
FROM nn JOIN corpus ON match_id = transaction_id"""))
def q_case_retrieval(spark, sf):
    corpus, nn = _nearest_cases(_case_rows(spark, sf))
    cases = corpus.select(F.col("transaction_id").alias("match_id"), "is_fraud", *CASE_SHOWN)
    j = nn.join(cases, "match_id")
    return j.select("query_id", "rank", "match_id", r6("score").alias("distance"),
                    F.when(F.col("is_fraud") == 1, "Fraud").otherwise("Legitimate").alias("label"), "amount", "payment_channel", "device_used", "transaction_type")


# ---- JSON / CSV / timestamps --------------------------------------------

@register("json_unpack", """
SELECT event_id, event_id % 10 <> 0 AS parsed, user_id, round(value, 6) AS value, k FROM (
  SELECT *, CASE WHEN event_id % 10 <> 0 THEN CAST(json_extract_string(props, '$.k') AS INTEGER) END AS k FROM events)""")
def q_json_unpack(spark, sf):
    """Payloads parsed back; one that can't be parsed (here: every tenth is cut short) falls back to the flat row."""
    d = read_table(spark, sf, "events")
    whole = F.to_json(F.struct("event_id", "user_id", "value", F.get_json_object("props", "$.k").cast("int").alias("k")))
    payload = F.when(F.col("event_id") % 10 == 0, F.substring(whole, 2, 10)).otherwise(whole)
    d = d.withColumn("p", F.from_json(payload, "event_id LONG, user_id LONG, value DOUBLE, k INT", {"mode": "PERMISSIVE"}))
    return d.select("event_id", F.col("p.event_id").isNotNull().alias("parsed"), F.coalesce("p.user_id", "user_id").alias("user_id"),
                    r6(F.coalesce("p.value", "value")).alias("value"), F.col("p.k").alias("k"))


@register("json_pack", ev_sql("""
SELECT transaction_id, to_json({'transaction_id': transaction_id, 'location': location, 'velocity_score': velocity_score})
       AS raw_json FROM txn_events"""))
def q_json_pack(spark, sf):
    d = txn_events(spark, sf)
    return d.select("transaction_id", F.to_json(F.struct("transaction_id", "location", "velocity_score")).alias("raw_json"))


@register("parse_ts", ev_sql("""
SELECT transaction_id, CASE WHEN k = 0 THEN NULL WHEN transaction_id % 2 = 0 THEN epoch_us(ts)
       ELSE epoch_us(date_trunc('second', ts)) END AS parsed_us FROM txn_events"""))
def q_parse_ts(spark, sf):
    from ..functions.clean import parse_timestamp
    d = txn_events(spark, sf)
    txt = (F.when(F.col("k") == 0, F.lit("not-a-time"))
            .when(F.col("transaction_id") % 2 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
            .otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")))
    d = d.withColumn("ts_text", txt).withColumn("parsed", parse_timestamp("ts_text", "coerce"))
    return d.select("transaction_id", F.unix_micros("parsed").alias("parsed_us"))


def _roundtrip(spark, sf, fmt):
    from ..session import scratch_path
    d = txn_events(spark, sf).select("transaction_id", "ts", "amount", "location", "is_fraud")
    path = scratch_path(spark, f"txn-{fmt}")
    if fmt == "csv":
        fmt_ts = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
        d.write.mode("overwrite").option("header", True).option("timestampFormat", fmt_ts).csv(path)
        back = (spark.read.schema(d.schema).option("header", True)
                .option("timestampFormat", fmt_ts).csv(path))
    else:
        d.write.mode("overwrite").parquet(path)
        back = spark.read.parquet(path)
    return back


RT_SQL = ev_sql("SELECT transaction_id, epoch_us(ts) AS ts_us, amount, location, is_fraud FROM txn_events")


@register("src_csv", RT_SQL)
def q_src_csv(spark, sf):
    b = _roundtrip(spark, sf, "csv")
    return b.select("transaction_id", F.unix_micros("ts").alias("ts_us"), "amount", "location", "is_fraud")


@register("src_csv_typed", ev_sql("""
SELECT transaction_id, epoch_us(ts) AS ts_us, hour(ts) AS hour FROM txn_events"""))
def q_src_csv_typed(spark, sf):
    b = _roundtrip(spark, sf, "csv")
    return b.select("transaction_id", F.unix_micros("ts").alias("ts_us"), F.hour("ts").alias("hour"))


@register("src_csv_quarantine", ev_sql("""
SELECT transaction_id, CASE WHEN transaction_id % 50 > 1 THEN amount END AS amount,
       CASE transaction_id % 50 WHEN 0 THEN 'amount is no double' WHEN 1 THEN 'ts is no timestamp' ELSE 'good' END AS state FROM txn_events"""))
def q_src_csv_quarantine(spark, sf):
    """Files of which one row in 50 has no number for its amount and one no time: the good rows typed by inference, the
    others quarantined."""
    from ..session import scratch_path
    from ..sources.csv_files import read_csv
    path, kind = scratch_path(spark, "csv-mixed"), F.col("transaction_id") % 50
    d = txn_events(spark, sf).select("transaction_id", F.when(kind == 1, "soon").otherwise(F.col("ts").cast("string")).alias("ts"),
                                     F.when(kind == 0, "n/a").otherwise(F.col("amount").cast("string")).alias("amount"), "location")
    d.write.option("header", True).csv(path)
    good, bad = read_csv(spark, path)
    out = good.select("transaction_id", "amount", F.lit("good").alias("state"))
    first = F.split("record", ",")[0].cast("long")
    return out.unionByName(bad.select(first.alias("transaction_id"), F.lit(None).cast("double").alias("amount"), F.col("reason").alias("state")))


@register("sink_csv", RT_SQL)
def q_sink_csv(spark, sf):
    return q_src_csv(spark, sf)


@register("sink_predictions", ev_sql(f"""
SELECT transaction_id, {BAND_SCORE.replace('score_fine', '(((transaction_id * 7919) % 10007) / 10007.0)')} AS fraud_probability
FROM txn_events"""))
def q_sink_predictions(spark, sf):
    from ..session import scratch_path
    p = scored(spark, sf).select("transaction_id", (F.col("score_fine") * 0.1).alias("fraud_probability"))
    path = scratch_path(spark, "predictions")
    p.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


HISTORY = [S, "location", "payment_channel", "device_used", "transaction_type"]


def _exported(spark, sf):
    """What scoring needs, saved as one version and loaded again: preprocessor, pairs seen, cases, feature list, rows."""
    from pyspark.ml import Pipeline

    from ..session import scratch_path
    from ..sources import artifact
    d = txn_events(spark, sf)
    num = ["amount", "velocity_score", "geo_anomaly_score"]
    tables = {"rows": d.select("transaction_id", "ts", "amount", "location", "is_fraud"), "history": d.select(*HISTORY).distinct(),
              "cases": sample_stratified(d, "is_fraud", CASES_PER_LABEL, "transaction_id")}
    base = scratch_path(spark, "artifact")
    artifact.save(spark, base, tables, {"preprocessor": Pipeline(stages=ML.assembler(num, CATEGORICALS)).fit(d)}, {"features": num + CATEGORICALS})
    return artifact.load(spark, base)


@register("sink_artifact", RT_SQL)
def q_sink_artifact(spark, sf):
    b = _exported(spark, sf).tables["rows"]
    return b.select("transaction_id", F.unix_micros("ts").alias("ts_us"), "amount", "location", "is_fraud")


@register("sink_artifact_cases", _ev_with(f"""
, corpus AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY is_fraud ORDER BY {LEH}, transaction_id) AS rn
                           FROM txn_events) WHERE rn <= {CASES_PER_LABEL})
, history AS (SELECT DISTINCT {", ".join(HISTORY)} FROM txn_events)
SELECT transaction_id, is_fraud, 1 + 1 + 1 + 5 AS features, CAST(COUNT(*) AS BIGINT) AS pairs_of_sender FROM corpus JOIN history USING ({S}) GROUP BY 1, 2"""))
def q_sink_artifact_cases(spark, sf):
    """The loaded cases that the loaded preprocessor takes, with the number of pairs that the loaded history holds of their sender."""
    a = _exported(spark, sf)
    cases = a.models["preprocessor"].transform(a.tables["cases"]).where(F.col("features").isNotNull())
    pairs = a.tables["history"].groupBy(S).agg(F.count(F.lit(1)).alias("pairs_of_sender"))
    return cases.join(pairs, S).select("transaction_id", "is_fraud", F.lit(len(a.values["features"])).alias("features"), "pairs_of_sender")


# ---- remaining profiling that needs curves --------------------------------

@register("agg_spearman", ev_sql("""
SELECT round(corr(rs, ry), 6) AS spearman FROM (
  SELECT rank() OVER (ORDER BY x) + (COUNT(*) OVER (PARTITION BY x) - 1) / 2.0 AS rs,
         rank() OVER (ORDER BY is_fraud) + (COUNT(*) OVER (PARTITION BY is_fraud) - 1) / 2.0 AS ry
  FROM (SELECT coalesce(spending_deviation_score, 0) AS x, is_fraud FROM txn_events))"""))
def q_agg_spearman(spark, sf):
    from ..operators.metrics import spearman
    d = txn_events(spark, sf).select(F.coalesce("spending_deviation_score", F.lit(0.0)).alias("x"), "is_fraud")
    return spearman(d, "x", "is_fraud").select(r6("spearman").alias("spearman"))


DIAG = ["velocity_score", "geo_anomaly_score", "spending_deviation_score", "time_since_last_transaction"]


def _diag_sql():
    u = "\n UNION ALL ".join(f"SELECT '{c}' AS feature, {c} AS raw, is_fraud FROM txn_events" for c in DIAG)
    ap = lambda name, expr: f"""{name} AS (SELECT feature, SUM(pos / P * (cp / cn)) AS ap FROM (
      SELECT *, SUM(n) OVER (PARTITION BY feature ORDER BY s DESC) AS cn, SUM(pos) OVER (PARTITION BY feature ORDER BY s DESC) AS cp,
             SUM(pos) OVER (PARTITION BY feature) AS P FROM (
        SELECT feature, {expr} AS s, COUNT(*) AS n, SUM(is_fraud) AS pos FROM u GROUP BY feature, s)) GROUP BY feature)"""  # noqa: E731
    return [f"u AS ({u})", ap("apos", "coalesce(raw, 0)"), ap("aneg", "-coalesce(raw, 0)"),
            """st AS (SELECT feature, avg(CAST(raw IS NULL AS DOUBLE)) AS null_rate,
                   avg(CAST(coalesce(raw, 0) = 0 AS DOUBLE)) AS zero_rate,
                   avg(CASE WHEN coalesce(raw, 0) = 0 THEN is_fraud END) AS rate_zero,
                   avg(CASE WHEN coalesce(raw, 0) <> 0 THEN is_fraud END) AS rate_nonzero,
                   avg(is_fraud) AS base FROM u GROUP BY feature)"""]


@register("agg_feature_diag", ev_sql("""
SELECT st.feature, round(null_rate, 6) AS null_rate, round(zero_rate, 6) AS zero_rate,
       round(rate_zero, 6) AS rate_zero, round(rate_nonzero, 6) AS rate_nonzero,
       round(greatest(apos.ap, aneg.ap), 6) AS best_ap,
       CASE WHEN apos.ap >= aneg.ap THEN 'higher' ELSE 'lower' END AS direction,
       round(greatest(apos.ap, aneg.ap) / base, 6) AS rel_lift,
       CAST(greatest(apos.ap, aneg.ap) / base > 1.02 AS INTEGER) AS keep
FROM st JOIN apos USING (feature) JOIN aneg USING (feature)""", *_diag_sql()))
def q_agg_feature_diag(spark, sf):
    from ..operators.metrics import feature_diagnostics
    return feature_diagnostics(txn_events(spark, sf), DIAG)


HIST = [("sender_account", "24h", "sender_tx_count_past_24h"), ("sender_account", "7d", "sender_tx_count_past_7d"),
        ("receiver_account", "7d", "receiver_tx_count_past_7d")]


def _hist_sql():
    from .q_past import _roll_sql
    u = "\n UNION ALL ".join(
        f"SELECT '{o}' AS feature, CAST({_roll_sql(e, P.duration_us(w))} AS BIGINT) AS v, is_fraud FROM txn_events"
        for e, w, o in HIST)
    return f"""
SELECT feature, round(avg(CAST(v = 0 AS DOUBLE)), 6) AS zero_rate, round(avg(v), 6) AS mean,
       round(median(v), 6) AS median, round(quantile_cont(v, 0.99), 6) AS p99, max(v) AS max,
       round(avg(CASE WHEN v = 0 THEN is_fraud END), 6) AS rate_zero,
       round(avg(CASE WHEN v > 0 THEN is_fraud END), 6) AS rate_positive
FROM ({u}) GROUP BY feature"""


@register("agg_history_diag", ev_sql(_hist_sql()))
def q_agg_history_diag(spark, sf):
    d = txn_events(spark, sf).select("transaction_id", "ts", S, "receiver_account", "is_fraud")
    d = P.beside(d, [([e], lambda rows, e=e, w=w, o=o: P.rolling(rows, [e], w, {o: ("count", None)})) for e, w, o in HIST], keep=["is_fraud"])
    from ..operators.metrics import history_diagnostics
    return history_diagnostics(d, [o for _, _, o in HIST])


INTERACTIONS = {"geo_x_velocity": "geo_anomaly_score * velocity_score", "geo_x_deviation": "geo_anomaly_score * spending_deviation_score",
                "velocity_x_deviation": "velocity_score * spending_deviation_score"}
INTERACTION_SQL = [
    GI_SQL,
    "u AS (" + " UNION ALL ".join(f"SELECT '{n}' AS feature, round({e}, 6) AS x, is_fraud, global_index < floor(_total * 0.8) AS tr FROM gi" for n, e in INTERACTIONS.items()) + ")",
    "p AS (SELECT feature, quantile_cont(x, 0.9) AS p90 FROM u WHERE tr GROUP BY feature)",
    """c0 AS (SELECT feature, way, x * way AS s, COUNT(*) AS n, SUM(is_fraud) AS pos FROM u, (VALUES (1), (-1)) w(way) WHERE NOT tr GROUP BY 1, 2, 3)""",
    """c AS (SELECT *, SUM(n) OVER o AS cn, SUM(pos) OVER o AS cp, SUM(pos) OVER (PARTITION BY feature, way) AS P FROM c0
           WINDOW o AS (PARTITION BY feature, way ORDER BY s DESC))""",
    "ap AS (SELECT feature, max(a) AS best_ap FROM (SELECT feature, way, SUM(pos / P * (cp / cn)) AS a FROM c GROUP BY 1, 2) GROUP BY feature)"]


@register("agg_interaction_diag", ev_sql("""
SELECT u.feature, round(any_value(best_ap), 6) AS best_ap, round(quantile_cont(x, 0.99), 6) AS p99, max(x) AS max,
       round(avg(CASE WHEN x >= p90 THEN is_fraud END), 6) AS top_decile_rate
FROM u JOIN p USING (feature) JOIN ap USING (feature) WHERE NOT tr GROUP BY u.feature""", *INTERACTION_SQL))
def q_agg_interaction_diag(spark, sf):
    """Of each interaction on the validation rows: the better direction's average precision, p99, max, and the
    label rate at or above the train rows' 90th percentile."""
    from ..operators import metrics as M
    from ..operators.ranks import quantiles
    d = _split(spark, sf, "geo_anomaly_score", "velocity_score", "spending_deviation_score", "is_fraud")
    u = d.select("is_train", "is_fraud", F.inline(F.array(*[F.struct(F.lit(n).alias("feature"), r6(F.expr(e)).alias("x")) for n, e in INTERACTIONS.items()])))
    p90 = quantiles(u.where("is_train = 1"), ["x"], [0.9], ["feature"]).select("feature", F.col("q")[0].alias("p90"))
    u = stored(u.where("is_train = 0"), "interactions")
    ways = u.withColumn("way", F.explode(F.array(F.lit(1), F.lit(-1)))).withColumn("s", F.col("x") * F.col("way"))
    ap = M.ap_auc(M.score_curve(ways, "s", by=["feature", "way"]), ["feature", "way"]).groupBy("feature").agg(r6(F.max("ap")).alias("best_ap"))
    p99 = quantiles(u, ["x"], [0.99], ["feature"]).select("feature", r6(F.col("q")[0]).alias("p99"))
    g = u.join(p90, "feature").groupBy("feature").agg(F.max("x").alias("max"), r6(F.avg(F.when(F.col("x") >= F.col("p90"), F.col("is_fraud")))).alias("top_decile_rate"))
    return g.join(ap, "feature").join(p99, "feature").select("feature", "best_ap", "p99", "max", "top_decile_rate")
