"""Registered queries: score evaluation (§2.10) and ordering/sampling (§2.7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators.order import global_index, sample_n, sample_stratified, time_blocks
from ..operators.profile import r6
from ..operators.ranks import quantile_list
from ..sources.adapters import txn_events
from .registry import ev_sql, register

# Deterministic pseudo-scores (no model needed): a coarse one with heavy ties
# and a fine one.
SCORE = "(k * 37 % 101) / 101.0"
FINE = "((transaction_id * 7919) % 10007) / 10007.0"
SCORED_SQL = f"""scored AS (SELECT *, {SCORE} AS score, {FINE} AS score_fine FROM txn_events)"""


def scored(spark, sf, events=None):
    d = txn_events(spark, sf, events)
    return d.withColumns({"score": (F.col("k") * 37 % 101) / F.lit(101.0),
                          "score_fine": (F.col("transaction_id") * 7919 % 10007) / F.lit(10007.0)})


def _curve_sql(score, by=""):
    part = f"PARTITION BY {by}" if by else ""
    sel = f"{by}, " if by else ""
    return f"""
SELECT {sel}{score} AS score, COUNT(*) AS n, SUM(is_fraud) AS pos FROM scored GROUP BY {sel}{score}"""


def _ap_sql(score, by=""):
    part = f"PARTITION BY {by}" if by else ""
    sel = f"{by}, " if by else ""
    return f"""c0 AS ({_curve_sql(score, by)}),
c AS (SELECT *, SUM(n) OVER ({part} ORDER BY score DESC) AS cn, SUM(pos) OVER ({part} ORDER BY score DESC) AS cp,
             SUM(pos) OVER ({part}) AS P, SUM(n) OVER ({part}) AS T FROM c0),
m AS (SELECT {sel}SUM(pos / P * (cp / cn)) AS ap,
             SUM((n - pos) * (cp - pos + pos / 2)) / any_value(P * (T - P)) AS roc_auc,
             any_value(P / T) AS base_rate FROM c {"GROUP BY " + by if by else ""})"""


@register("metric_ap", ev_sql("SELECT round(ap, 6) AS ap FROM m", SCORED_SQL, _ap_sql("score")))
def q_metric_ap(spark, sf):
    return M.ap_auc(M.score_curve(scored(spark, sf))).select(r6("ap").alias("ap"))


@register("metric_roc_auc", ev_sql("SELECT round(roc_auc, 6) AS roc_auc FROM m", SCORED_SQL,
                                   _ap_sql("score_fine")))
def q_metric_roc_auc(spark, sf):
    c = M.score_curve(scored(spark, sf), "score_fine")
    return M.ap_auc(c).select(r6("roc_auc").alias("roc_auc"))


@register("metric_lift", ev_sql("""
SELECT round(ap, 6) AS ap, round(base_rate, 6) AS base_rate, round(ap - base_rate, 6) AS abs_lift,
       round(ap / base_rate, 6) AS rel_lift FROM m""", SCORED_SQL, _ap_sql("score")))
def q_metric_lift(spark, sf):
    m = M.ap_auc(M.score_curve(scored(spark, sf)))
    return m.select(r6("ap").alias("ap"), r6("base_rate").alias("base_rate"),
                    r6(F.col("ap") - F.col("base_rate")).alias("abs_lift"),
                    r6(F.col("ap") / F.col("base_rate")).alias("rel_lift"))


# a score with gaps, filled with its own median
FILLED_SQL = [SCORED_SQL.replace("scored AS", "scored0 AS"),
              """scored AS (SELECT *, coalesce(gap, (SELECT median(CASE WHEN transaction_id % 7 <> 0 THEN score END) FROM scored0)) AS filled
                 FROM (SELECT *, CASE WHEN transaction_id % 7 <> 0 THEN score END AS gap FROM scored0))"""]


@register("metric_ap_bidir", ev_sql("""
SELECT round(greatest(a.ap, b.ap), 6) AS best_ap, CASE WHEN a.ap >= b.ap THEN 'higher' ELSE 'lower' END AS direction
FROM m a, m2 b""", *FILLED_SQL, _ap_sql("filled"),
    _ap_sql("-filled").replace("c0 AS", "d0 AS").replace("FROM c0", "FROM d0").replace("c AS (", "d AS (")
    .replace("FROM c ", "FROM d ").replace("m AS (", "m2 AS (")))
def q_metric_ap_bidir(spark, sf):
    """The better direction's average precision of a score whose nulls take its own median."""
    d = scored(spark, sf).withColumn("gap", F.when(F.col("transaction_id") % 7 != 0, F.col("score")))
    d = d.withColumn("filled", F.coalesce("gap", quantile_list(d, "gap", [0.5])[0])).withColumn("neg", -F.col("filled"))
    a = M.ap_auc(M.score_curve(d, "filled")).select(F.col("ap").alias("a"))
    b = M.ap_auc(M.score_curve(d, "neg")).select(F.col("ap").alias("b")).scalar()
    return a.select(r6(F.greatest("a", b)).alias("best_ap"),
                    F.when(F.col("a") >= b, "higher").otherwise("lower").alias("direction"))


@register("metric_pr_curve", ev_sql("""
SELECT score, n, CAST(cp AS BIGINT) AS cum_pos, cn AS cum_n, round(cp / cn, 6) AS precision,
       round(cp / P, 6) AS recall FROM c""", SCORED_SQL, _ap_sql("score")))
def q_metric_pr_curve(spark, sf):
    c = M.pr_curve(M.score_curve(scored(spark, sf)))
    return c.select("score", "n", c.cum_pos.cast("bigint").alias("cum_pos"), "cum_n",
                    r6("precision").alias("precision"), r6("recall").alias("recall"))


@register("metric_best_f1_curve", ev_sql("""
SELECT round(max(f1), 6) AS best_f1, arg_max(score, (f1, score)) AS best_threshold
FROM (SELECT score, 2 * (cp / cn) * (cp / P) / ((cp / cn) + (cp / P) + 1e-9) AS f1 FROM c)""",
    SCORED_SQL, _ap_sql("score_fine")))
def q_metric_best_f1_curve(spark, sf):
    c = M.score_curve(scored(spark, sf), "score_fine").withColumnRenamed("score_fine", "score")
    return M.best_f1_curve(c).select(r6("best_f1").alias("best_f1"), "best_threshold")


GRID = [round(0.01 + 0.02 * i, 2) for i in range(50)]


def _tt_sql():
    vals = ", ".join(f"({t})" for t in GRID)
    return f"""thr(t) AS (VALUES {vals}),
tt AS (SELECT t AS threshold, count_if(score >= t) AS predicted, count_if(score >= t AND is_fraud = 1) AS tp,
              COUNT(*) AS n, count_if(is_fraud = 1) AS p FROM scored, thr GROUP BY t),
tt2 AS (SELECT *, predicted - tp AS fp, p - tp AS fn, n - p - (predicted - tp) AS tn,
               CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS prec,
               CASE WHEN p > 0 THEN tp / p ELSE 0.0 END AS rec FROM tt),
tt3 AS (SELECT CAST(threshold AS DOUBLE) AS threshold, predicted, round(predicted / n, 6) AS predicted_rate, tp, fp, fn, tn,
               round(prec, 6) AS precision, round(rec, 6) AS recall,
               round(CASE WHEN prec + rec > 0 THEN 2 * prec * rec / (prec + rec) ELSE 0.0 END, 6) AS f1,
               round(CASE WHEN fp + tn > 0 THEN fp / (fp + tn) ELSE 0.0 END, 6) AS fpr,
               round(CASE WHEN fn + tp > 0 THEN fn / (fn + tp) ELSE 0.0 END, 6) AS fnr FROM tt2)"""


@register("metric_threshold_table", ev_sql("SELECT * FROM tt3", SCORED_SQL, _tt_sql()))
def q_metric_threshold_table(spark, sf):
    return M.threshold_table(scored(spark, sf), GRID)


@register("metric_best_f1_grid", ev_sql("""
SELECT max(f1) AS best_f1, arg_max(threshold, (f1, -threshold)) AS best_threshold FROM tt3""",
    SCORED_SQL, _tt_sql()))
def q_metric_best_f1_grid(spark, sf):
    return M.best_f1_grid(M.threshold_table(scored(spark, sf), GRID))


@register("metric_confusion", ev_sql("""
SELECT count_if(p AND y) AS tp, count_if(p AND NOT y) AS fp, count_if(NOT p AND y) AS fn,
       count_if(NOT p AND NOT y) AS tn, round(count_if(p = y) / COUNT(*), 6) AS accuracy,
       round(count_if(p AND y) / count_if(p), 6) AS precision, round(count_if(p AND y) / count_if(y), 6) AS recall,
       round(2 * (count_if(p AND y) / count_if(p)) * (count_if(p AND y) / count_if(y))
             / ((count_if(p AND y) / count_if(p)) + (count_if(p AND y) / count_if(y))), 6) AS f1
FROM (SELECT score >= 0.5 AS p, is_fraud = 1 AS y FROM scored)""", SCORED_SQL))
def q_metric_confusion(spark, sf):
    return M.confusion(scored(spark, sf), F.col("score") >= 0.5)


@register("metric_brier", ev_sql("""
SELECT round(avg(pow(score - is_fraud, 2)), 6) AS brier FROM scored""", SCORED_SQL))
def q_metric_brier(spark, sf):
    return M.brier(scored(spark, sf))


@register("metric_score_describe", ev_sql("""
SELECT subset, COUNT(score) AS count, round(avg(score), 6) AS mean, round(stddev_samp(score), 6) AS std,
       min(score) AS min, """ + ", ".join(
    f"round(quantile_cont(score, {p}), 6) AS p{int(round(p * 100))}" for p in M.SCORE_PCTS) + """, max(score) AS max
FROM (SELECT unnest(['all', CAST(is_fraud AS VARCHAR)]) AS subset, score FROM scored) GROUP BY subset""",
    SCORED_SQL))
def q_metric_score_describe(spark, sf):
    return M.score_describe(scored(spark, sf))


def _topk_sql(by=""):
    part = f"PARTITION BY {by}" if by else ""
    sel = f"{by}, " if by else ""
    return f"""r AS (SELECT *, row_number() OVER ({part} ORDER BY score DESC, transaction_id) - 1 AS i,
                  COUNT(*) OVER ({part}) AS gn, SUM(is_fraud) OVER ({part}) AS gp FROM src),
pk(pct) AS (VALUES (0.01), (0.05), (0.1)),
tk AS (SELECT {sel}CAST(pct AS DOUBLE) AS pct, CAST(greatest(floor(gn * pct), 1) AS BIGINT) AS k,
              CAST(coalesce(SUM(CASE WHEN i < greatest(floor(gn * pct), 1) THEN is_fraud END), 0) AS BIGINT) AS captured,
              min(CASE WHEN i < greatest(floor(gn * pct), 1) THEN score END) AS min_score, any_value(gp) AS gp
       FROM r, pk GROUP BY {sel}pct, gn)"""


@register("topk_pct", ev_sql("""
SELECT pct, k, captured, round(captured / k, 6) AS precision, round(captured / gp, 6) AS recall, min_score FROM tk""",
    SCORED_SQL, "src AS (SELECT * FROM scored)", _topk_sql()))
def q_topk_pct(spark, sf):
    return M.topk(scored(spark, sf), [0.01, 0.05, 0.1])


@register("topk_table", ev_sql("""
SELECT pct, k, captured, round(CASE WHEN k > 0 THEN captured / k ELSE 0.0 END, 6) AS precision,
       round(captured / gp, 6) AS recall,
       round(CASE WHEN k > 0 THEN captured / k ELSE 0.0 END / (gp / gn), 6) AS lift
FROM (SELECT CAST(pct AS DOUBLE) AS pct, CAST(floor(gn * pct) AS BIGINT) AS k,
             CAST(coalesce(SUM(CASE WHEN i < floor(gn * pct) THEN is_fraud END), 0) AS BIGINT) AS captured,
             any_value(gp) AS gp, gn
      FROM r, (VALUES (0.0001), (0.001), (0.01), (0.05), (0.1)) pk(pct) GROUP BY pct, gn)""",
    SCORED_SQL, "src AS (SELECT * FROM scored)", _topk_sql().split(",\npk(pct)")[0]))
def q_topk_table(spark, sf):
    d = scored(spark, sf)
    t = M.topk(d, [0.0001, 0.001, 0.01, 0.05, 0.1], min_one=False)
    rate = d.agg(F.avg("is_fraud")).scalar()
    return t.select("pct", "k", "captured", "precision", "recall",
                    r6(F.col("precision") / rate).alias("lift"))


GI_SQL = """gi AS (SELECT *, row_number() OVER (ORDER BY ts, transaction_id) - 1 AS global_index,
                  COUNT(*) OVER () AS _total FROM scored)"""
BLK_SQL = "src AS (SELECT *, CAST(least(floor(global_index / greatest(floor(_total / 4), 1)), 3) AS INTEGER) AS block FROM gi)"


def _blocks_spark(spark, sf):
    d = scored(spark, sf).select("transaction_id", "ts", "score", "is_fraud")
    g = global_index(d, ["ts", "transaction_id"])
    return g.withColumn("block", time_blocks(F.col("global_index"), F.col("_total"))).drop(
        "global_index", "_total")


@register("metric_blocks", ev_sql("""
SELECT m.block, round(m.base_rate, 6) AS fraud_rate, round(m.ap, 6) AS ap,
       round(t1.captured / t1.k, 6) AS p_at_1, round(t5.captured / t5.k, 6) AS p_at_5,
       round(t1.captured / t1.gp, 6) AS r_at_1, round(t5.captured / t5.gp, 6) AS r_at_5,
       round(max(m.ap) OVER () - min(m.ap) OVER (), 6) AS ap_range,
       CAST(max(m.ap) OVER () - min(m.ap) OVER () < 0.005 AS INTEGER) AS stable
FROM m JOIN tk t1 ON t1.block = m.block AND t1.pct = 0.01 JOIN tk t5 ON t5.block = m.block AND t5.pct = 0.05""",
    SCORED_SQL, GI_SQL, BLK_SQL, _ap_sql("score", "block").replace("FROM scored", "FROM src"),
    _topk_sql("block")))
def q_metric_blocks(spark, sf):
    from ..operators.metrics import blocks_report
    return blocks_report(_blocks_spark(spark, sf))


@register("metric_generalization", ev_sql("""
SELECT round(v.ap, 6) AS val_ap, round(t.ap, 6) AS test_ap,
       CASE WHEN t.ap > v.ap * 0.9 THEN 'Good' ELSE 'Drop' END AS generalization
FROM m v, m2 t""", SCORED_SQL, GI_SQL,
    "src AS (SELECT *, CASE WHEN global_index < floor(_total * 0.8) THEN 'val' ELSE 'test' END AS part FROM gi)",
    _ap_sql("score").replace("FROM scored", "FROM src WHERE part = 'val'"),
    _ap_sql("score").replace("FROM scored", "FROM src WHERE part = 'test'").replace("c0 AS", "d0 AS")
    .replace("FROM c0", "FROM d0").replace("c AS (", "d AS (").replace("FROM c ", "FROM d ")
    .replace("m AS (", "m2 AS (")))
def q_metric_generalization(spark, sf):
    d = scored(spark, sf).select("transaction_id", "ts", "score", "is_fraud")
    g = global_index(d, ["ts", "transaction_id"])
    g = g.withColumn("part", F.when(F.col("global_index") < F.floor(F.col("_total") * 0.8), "val")
                     .otherwise("test"))
    m = M.ap_auc(M.score_curve(g, by=["part"]), by=["part"])
    v = m.where(F.col("part") == "val").select(F.col("ap").alias("val_ap"))
    t = m.where(F.col("part") == "test").select("ap").scalar()
    return v.select(r6("val_ap").alias("val_ap"), r6(t).alias("test_ap"),
                    M.generalization(F.col("val_ap"), t).alias("generalization"))


@register("metric_signal_level", ev_sql("""
SELECT round(ap, 6) AS ap, CASE WHEN ap < 0.05 THEN 'WEAK' WHEN ap < 0.07 THEN 'WEAK-TO-MODERATE'
       WHEN ap < 0.10 THEN 'MODERATE' ELSE 'STRONG' END AS signal,
       CAST(ap / base_rate > 1.1 AS INTEGER) AS feature_signal,
       CAST(ap < 1.5 * base_rate AS INTEGER) AS negligible FROM m""", SCORED_SQL, _ap_sql("score")))
def q_metric_signal_level(spark, sf):
    m = M.ap_auc(M.score_curve(scored(spark, sf)))
    return m.select(r6("ap").alias("ap"), M.signal_level(F.col("ap")).alias("signal"),
                    (F.col("ap") / F.col("base_rate") > 1.1).cast("int").alias("feature_signal"),
                    (F.col("ap") < 1.5 * F.col("base_rate")).cast("int").alias("negligible"))


def _p_at_sql(score, pct):
    return (f"(SELECT SUM(is_fraud) / COUNT(*) FROM (SELECT is_fraud, row_number() OVER (ORDER BY {score} DESC, transaction_id) AS i, "
            f"COUNT(*) OVER () AS n FROM scored) WHERE i <= greatest(floor(n * {pct}), 1))")


@register("metric_material", ev_sql(f"""
SELECT round(da, 6) AS delta_ap, round(d1, 6) AS delta_p_at_1, round(d5, 6) AS delta_p_at_5,
       CAST(da >= 0.002 OR round(d1, 6) >= 0.005 OR round(d5, 6) >= 0.005 AS INTEGER) AS material
FROM (SELECT b.ap - a.ap AS da, {_p_at_sql("score_fine", 0.01)} - {_p_at_sql("score", 0.01)} AS d1,
             {_p_at_sql("score_fine", 0.05)} - {_p_at_sql("score", 0.05)} AS d5 FROM m a, m2 b)""", SCORED_SQL, _ap_sql("score"),
    _ap_sql("score_fine").replace("c0 AS", "d0 AS").replace("FROM c0", "FROM d0").replace("c AS (", "d AS (")
    .replace("FROM c ", "FROM d ").replace("m AS (", "m2 AS (")))
def q_metric_material(spark, sf):
    d = scored(spark, sf)
    a = M.ap_auc(M.score_curve(d, "score")).select(F.col("ap").alias("a"))
    b = M.ap_auc(M.score_curve(d, "score_fine")).select("ap").scalar()
    p = []
    for score in ("score_fine", "score"):
        t = M.topk(d, [0.01, 0.05], score)
        p.append([t.agg(F.max(F.when(F.col("pct") == x, F.col("captured") / F.col("k")))).scalar() for x in (0.01, 0.05)])
    delta, d1, d5 = b - F.col("a"), r6(p[0][0] - p[1][0]), r6(p[0][1] - p[1][1])
    return a.select(r6(delta).alias("delta_ap"), d1.alias("delta_p_at_1"), d5.alias("delta_p_at_5"), M.material(delta, d1, d5).alias("material"))


CLASSES_SQL = "(VALUES (0), (1)) k(class)"


@register("metric_class_report", ev_sql(f"""
SELECT CAST(class AS INTEGER) AS class, count_if(p = class AND y = class) AS hits, count_if(y = class) AS support,
       round(count_if(p = class AND y = class) / nullif(count_if(p = class), 0), 6) AS precision,
       round(count_if(p = class AND y = class) / nullif(count_if(y = class), 0), 6) AS recall
FROM (SELECT CAST(score >= 0.5 AS INTEGER) AS p, is_fraud AS y FROM scored), {CLASSES_SQL} GROUP BY class""", SCORED_SQL))
def q_metric_class_report(spark, sf):
    """Precision, recall and support of each class at 0.5."""
    d = scored(spark, sf).select((F.col("score") >= 0.5).cast("int").alias("p"), F.col("is_fraud").alias("y"))
    g = d.groupBy("p", "y").agg(F.count(F.lit(1)).alias("n")).withColumn("class", F.explode(F.array(F.lit(0), F.lit(1))))
    hit, said, own = (F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)) for c in ((F.col("p") == F.col("class")) & (F.col("y") == F.col("class")), F.col("p") == F.col("class"), F.col("y") == F.col("class")))
    g = g.groupBy("class").agg(hit.alias("hits"), own.alias("support"), said.alias("said"))
    return g.select("class", "hits", "support", r6(F.try_divide("hits", "said")).alias("precision"), r6(F.try_divide("hits", "support")).alias("recall"))


# ---- sampling / ordering (§2.7) -----------------------------------------

def _lehmer_sql(seed):
    return f"(((transaction_id % 2147483647) * 48271 + {seed}) % 2147483647 * 48271 + {seed}) % 2147483647"


@register("sample_stratified", ev_sql(f"""
SELECT transaction_id, is_fraud FROM (
  SELECT *, row_number() OVER (PARTITION BY is_fraud ORDER BY {_lehmer_sql(42)}, transaction_id) AS rn
  FROM txn_events) WHERE rn <= 300"""))
def q_sample_stratified(spark, sf):
    d = sample_stratified(txn_events(spark, sf), "is_fraud", 300, "transaction_id")
    return d.select("transaction_id", "is_fraud")


@register("sample_n", ev_sql(f"""
SELECT transaction_id, amount FROM txn_events ORDER BY {_lehmer_sql(42)}, transaction_id LIMIT 200"""))
def q_sample_n(spark, sf):
    return sample_n(txn_events(spark, sf), 200, "transaction_id").select("transaction_id", "amount")


@register("top_n", ev_sql("""
SELECT transaction_id, amount FROM txn_events ORDER BY amount DESC, transaction_id LIMIT 10"""))
def q_top_n(spark, sf):
    return txn_events(spark, sf).orderBy(F.desc("amount"), "transaction_id").limit(10).select(
        "transaction_id", "amount")


@register("sort_time", ev_sql("SELECT transaction_id, global_index FROM gi",
                              "gi AS (SELECT *, row_number() OVER (ORDER BY ts, transaction_id) - 1 "
                              "AS global_index FROM txn_events)"))
def q_sort_time(spark, sf):
    """Global time order as an explicit index column (the order survives any
    later shuffle, unlike an ``orderBy`` whose order a join would lose)."""
    return global_index(txn_events(spark, sf).select("transaction_id", "ts"),
                        ["ts", "transaction_id"], total=None).select("transaction_id", "global_index")


@register("shuffle_labels", ev_sql("""
SELECT r.transaction_id, r.ts, r.amount, l.is_fraud
FROM (SELECT *, row_number() OVER (ORDER BY ts, transaction_id) AS i FROM txn_events) r
JOIN (SELECT is_fraud, row_number() OVER (ORDER BY (((transaction_id % 2147483647) * 48271 + 7) % 2147483647 * 48271 + 7) % 2147483647, transaction_id) AS i FROM txn_events) l
  ON r.i = l.i"""))
def q_shuffle_labels(spark, sf):
    from ..operators.order import shuffle_labels
    d = txn_events(spark, sf).select("transaction_id", "ts", "amount", "is_fraud")
    return shuffle_labels(d, "is_fraud", ["ts", "transaction_id"], "transaction_id")
