"""Registered queries: model preparation, training, scoring (§2.11),
permutation / ablation (§2.10).  Models are rows-only checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import features as FT
from ..operators import boosting as B
from ..operators import metrics as M
from ..operators import ml as ML
from ..operators import past as P
from ..operators.order import global_index, shuffle_labels, split_flag
from ..operators.profile import r6
from ..session import stored
from ..sources.adapters import txn_events
from .registry import ev_sql, register

S = "sender_account"
GI_SQL = """gi AS (SELECT *, row_number() OVER (ORDER BY ts, transaction_id) - 1 AS global_index,
                  COUNT(*) OVER () AS _total FROM txn_events)"""
TRAIN = "global_index < floor(_total * 0.8)"

NUM = ["amount", "log_amount", "spending_deviation_score", "velocity_score", "geo_anomaly_score", "hour",
       "day_of_week", "month", "is_weekend", "is_night", "tslt_abs", "tslt_is_negative", "tslt_is_missing"]
NOVELTY = ["location", "payment_channel", "transaction_type", "device_used"]
CATS = ["transaction_type", "merchant_category", "payment_channel", "device_used", "location"]


def fs1(spark, sf):
    """FS1-style table: base features + four strict novelty flags, split by time; stored, since every fit and each of
    its statistics reads some of the columns."""
    d = FT.feat_base(txn_events(spark, sf))
    d = P.novelties(d, S, {f"is_new_{v}_for_sender": v for v in NOVELTY})
    d = d.withColumn("tslt_abs", F.coalesce("tslt_abs", F.lit(0.0)))
    g = global_index(d, ["ts", "transaction_id"])
    return stored(g.withColumn("is_train", split_flag(F.col("global_index"), F.col("_total"))), "fs1")


FS1_NUM = NUM + [f"is_new_{v}_for_sender" for v in NOVELTY]


@register("prep_impute_num", ev_sql(f"""
SELECT transaction_id, coalesce(time_since_last_transaction,
       (SELECT median(time_since_last_transaction) FROM gi WHERE {TRAIN})) AS time_since_last_transaction
FROM txn_events""", GI_SQL))
def q_prep_impute_num(spark, sf):
    d = txn_events(spark, sf).select("transaction_id", "ts", "time_since_last_transaction")
    g = global_index(d, ["ts", "transaction_id"])
    fit = g.where(split_flag(F.col("global_index"), F.col("_total")) == 1)
    return ML.impute_median(d, fit, ["time_since_last_transaction"]).select(
        "transaction_id", "time_since_last_transaction")


@register("prep_impute_cat", ev_sql("""
SELECT transaction_id, coalesce(fraud_type, (SELECT mode() WITHIN GROUP (ORDER BY fraud_type) FROM txn_events
       WHERE fraud_type IS NOT NULL)) AS fraud_type FROM txn_events"""))
def q_prep_impute_cat(spark, sf):
    d = txn_events(spark, sf)
    return ML.impute_mode(d, d, ["fraud_type"]).select("transaction_id", "fraud_type")


@register("prep_scale", ev_sql(f"""
SELECT transaction_id, round((amount - m) / CASE WHEN s > 0 THEN s ELSE 1.0 END, 6) AS amount_z
FROM txn_events, (SELECT avg(amount) AS m, stddev_pop(amount) AS s FROM gi WHERE {TRAIN})""", GI_SQL))
def q_prep_scale(spark, sf):
    d = txn_events(spark, sf).select("transaction_id", "ts", "amount")
    g = global_index(d, ["ts", "transaction_id"])
    fit = g.where(split_flag(F.col("global_index"), F.col("_total")) == 1)
    return ML.scale_pop(d, fit, ["amount"], "_z").select("transaction_id", r6("amount_z").alias("amount_z"))


@register("prep_onehot", ev_sql(f"""
SELECT transaction_id, """ + ", ".join(
    f"CAST(location = '{v}' AS INTEGER) AS \"location_{v}\"" for v in
    ["Berlin", "Dubai", "London", "New York", "Singapore", "Sydney", "Tokyo", "Toronto"]) + """
FROM txn_events"""))
def q_prep_onehot(spark, sf):
    d = txn_events(spark, sf)
    out = ML.onehot_columns(d.select("transaction_id", "location"), d, "location")
    return out.drop("location")


@register("imbalance_weight", ev_sql("""
SELECT is_fraud, round(avg(w), 6) AS weight FROM (
  SELECT is_fraud, CASE WHEN is_fraud = 1 THEN sqrt(r) ELSE 1.0 END AS w FROM txn_events,
  (SELECT count_if(is_fraud = 0) / count_if(is_fraud = 1) AS r FROM txn_events)) GROUP BY is_fraud"""))
def q_imbalance_weight(spark, sf):
    d = txn_events(spark, sf)
    r = d.agg(F.count_if(F.col("is_fraud") == 0) / F.count_if(F.col("is_fraud") == 1)).scalar()
    w = ML.imbalance_weight(F.col("is_fraud"), r, "sqrt")
    return d.select("is_fraud", w.alias("w")).groupBy("is_fraud").agg(r6(F.avg("w")).alias("weight"))


@register("model_dummy", ev_sql(f"""
SELECT round(ap, 6) AS ap FROM m""", GI_SQL, f"""c0 AS (SELECT (SELECT avg(is_fraud) FROM gi WHERE {TRAIN}) AS score,
   COUNT(*) AS n, SUM(is_fraud) AS pos FROM gi WHERE NOT ({TRAIN}))""",
    """m AS (SELECT SUM(pos / pos * (pos / n)) AS ap FROM c0)"""))
def q_model_dummy(spark, sf):
    """Prior-probability model: every validation row scores the train rate."""
    g = fs1(spark, sf)
    rate = g.where(F.col("is_train") == 1).agg(F.avg("is_fraud")).scalar()
    v = g.where(F.col("is_train") == 0).withColumn("score", rate)
    return M.ap_auc(M.score_curve(v)).select(r6("ap").alias("ap"))


def _fit_eval(spark, sf, kind, balanced=False, **params):
    g = fs1(spark, sf)
    tr, va = g.where(F.col("is_train") == 1), g.where(F.col("is_train") == 0)
    weight = None
    if balanced:  # both labels weigh the same
        rate = tr.agg(F.avg("is_fraud")).first()[0] or 0.5
        weight = "_w"
        tr = tr.withColumn("_w", F.when(F.col("is_fraud") == 1, F.lit(0.5 / max(rate, 1e-9))).otherwise(F.lit(0.5 / max(1 - rate, 1e-9))))
    model = ML.fit_pipeline(tr, FS1_NUM, CATS, kind, weight=weight, **params)
    sc = ML.score(model, va, "score")
    m = M.ap_auc(M.score_curve(sc), [])
    return m.select(F.lit(kind).alias("model"), r6("ap").alias("ap"), r6("roc_auc").alias("roc_auc"),
                    r6("base_rate").alias("base_rate"))


@register("model_logreg")
def q_model_logreg(spark, sf):
    return _fit_eval(spark, sf, "logreg", balanced=True, maxIter=1000)


@register("model_rf")
def q_model_rf(spark, sf):
    return _fit_eval(spark, sf, "rf", numTrees=50, maxDepth=10)


def matrix(spark, sf, num=None, keep=("transaction_id",), g=None):
    """The feature table assembled once, with its fitted encoder."""
    return B.assembled(fs1(spark, sf) if g is None else g, num or FS1_NUM, CATS, keep=keep)


@register("model_gbt")
def q_model_gbt(spark, sf):
    """The reference's comparison: 100 rounds, and 300 and 500 with early stop; the rounds kept, AP and AUC on the later split."""
    m, _ = matrix(spark, sf)
    configs = list(B.COMPARISON.items())
    models = B.fit_all(m, [c for _, c in configs])
    names = [{"model": f"gbt_{n}", "rounds": n, "rounds_kept": x.getNumTrees} for (n, _), x in zip(configs, models)]
    found = B.compared(m, models, names)
    return found.select("model", "rounds", "rounds_kept", r6("ap").alias("ap"), r6("roc_auc").alias("roc_auc"), r6("base_rate").alias("base_rate"))


@register("prep_assemble", ev_sql("SELECT transaction_id, CAST((SELECT " + str(len(FS1_NUM)) + " + "
    + " + ".join(f"COUNT(DISTINCT {c})" for c in CATS) + f" FROM gi WHERE {TRAIN}) AS INTEGER) AS n_features FROM txn_events", GI_SQL))
def q_prep_assemble(spark, sf):
    from pyspark.ml import Pipeline
    g = fs1(spark, sf)
    model = Pipeline(stages=ML.assembler(FS1_NUM, CATS)).fit(g.where(F.col("is_train") == 1))
    from pyspark.ml.functions import vector_to_array
    return model.transform(g).select("transaction_id", F.size(vector_to_array("features")).alias("n_features"))


@register("score_batch")
def q_score_batch(spark, sf):
    """The later split scored by the comparison's model of 100 rounds."""
    m, _ = matrix(spark, sf)
    return B.probability(B.fit(m, B.COMPARISON[100]), m.where("is_train = 0"), "fraud_probability").select("transaction_id", "fraud_probability")


@register("model_calibrate")
def q_model_calibrate(spark, sf):
    """Platt scaling in three folds of the comparison's model of 100 rounds."""
    m, _ = matrix(spark, sf)
    return B.calibrated(m, B.COMPARISON[100], folds=3).select("transaction_id", "calibrated")


@register("model_grid")
def q_model_grid(spark, sf):
    """All 64 configurations of the reference's grid, 500 rounds with early stop each, on one stored matrix; best by AP."""
    grid = B.tuning_grid()
    m, _ = matrix(spark, sf)
    models = B.fit_all(m, grid)  # bounds on leaves and on depth often come to the same depth: such configurations share a fit
    names = [{"leaves": c.leaves, "depth": c.depth, "step": c.step, "min_rows": c.min_rows, "penalty": c.penalty, "weight": c.weight, "rounds_kept": x.getNumTrees} for c, x in zip(grid, models)]
    rows = stored(B.compared(m, models, names), "grid").withColumn("ap", r6("ap"))
    return rows.select("config", *names[0], "ap", (F.col("ap") == rows.agg(F.max("ap")).scalar()).alias("best"))


@register("experiment_runner")
def q_experiment_runner(spark, sf):
    """Feature set x model table; the best row is the one with the largest AP."""
    g = fs1(spark, sf)
    sets, configs = {"FS0": NUM, "FS1": FS1_NUM}, list(B.COMPARISON.values())
    tables = [m for m, _ in B.side_by_side([lambda c=c: matrix(spark, sf, c, g=g) for c in sets.values()])]
    work = [f for m in tables for f in B.fits(m, configs)]
    each = len(work) // len(tables)
    for m in tables:
        balanced = B.weighted(m, "ratio", "is_fraud", "is_train").where("is_train = 1")
        work += [lambda t=balanced: ML.make_model("logreg", weight="_w", maxIter=1000).fit(t),
                 lambda t=balanced: ML.make_model("rf", weight="_w", numTrees=50, maxDepth=10).fit(t)]
    done = B.side_by_side(work, max(B.at_once(tables[0]), B.boosted_at_once(tables[0])))
    rows = None
    for i, (name, m) in enumerate(zip(sets, tables)):
        boosted = {k: x for part in done[i * each:(i + 1) * each] for k, x in part.items()}
        models = [*done[len(tables) * each + 2 * i:][:2], *[boosted[k] for k in range(len(configs))]]
        kinds = ["logreg", "rf", *[f"gbt_{n}" for n in B.COMPARISON]]
        r = B.compared(m, models, [{"feature_set": name, "model": kind} for kind in kinds])
        rows = r if rows is None else rows.unionByName(r)
    rows = stored(rows.select("feature_set", "model", r6("ap").alias("ap")), "experiments")
    return rows.withColumn("best", F.col("ap") == rows.agg(F.max("ap")).scalar())


@register("feature_importance")
def q_feature_importance(spark, sf):
    m, _ = matrix(spark, sf)
    return ML.importance_table(B.fit(m, B.COMPARISON[100]), m, top=20)


@register("feature_importance_family")
def q_feature_importance_family(spark, sf):
    """Importances of the forest summed by feature family."""
    g = fs1(spark, sf)
    model = ML.fit_pipeline(g.where(F.col("is_train") == 1), FS1_NUM, CATS, "rf", numTrees=50, maxDepth=10)
    rows = ML.feature_importance(model, g, top=10_000)
    return rows.groupBy(F.col("family")).agg(r6(F.sum("importance")).alias("importance"), F.count(F.lit(1)).alias("features"))


@register("metric_permutation")
def q_metric_permutation(spark, sf):
    """(AP_real - AP_shuffled) / AP_shuffled of the audit's model of 100 rounds, with the labels permuted by seed."""
    m, _ = matrix(spark, sf, NUM, keep=("transaction_id", "ts"))
    tr, va = m.where("is_train = 1"), m.where("is_train = 0")
    sh = shuffle_labels(tr, "is_fraud", ["ts", "transaction_id"], "transaction_id")
    sh = stored(sh.select(*m.columns).unionByName(va), "shuffled")
    models = B.side_by_side([lambda x=x: B.fit(x, B.AUDIT) for x in (m, sh)])
    found = B.compared(m, models, [{"labels": "real"}, {"labels": "shuffled"}])
    at = lambda name: F.max(F.when(F.col("labels") == name, F.col("ap")))
    gap = (F.col("ap_real") - F.col("ap_shuffled")) / F.col("ap_shuffled") * 100
    return found.agg(at("real").alias("ap_real"), at("shuffled").alias("ap_shuffled")).select(
        r6("ap_real").alias("ap_real"), r6("ap_shuffled").alias("ap_shuffled"), r6(gap).alias("gap_pct"),
        F.when(gap > 20, "real signal").when(gap > 5, "weak signal").otherwise("no signal").alias("verdict"))


@register("metric_ablation")
def q_metric_ablation(spark, sf):
    """ΔAP vs the full set for each removed feature group, by the audit's model."""
    g = fs1(spark, sf)
    groups = {"none": [], "novelty": [f"is_new_{v}_for_sender" for v in NOVELTY],
              "time": ["hour", "day_of_week", "month", "is_weekend", "is_night"],
              "tslt": ["tslt_abs", "tslt_is_negative", "tslt_is_missing"]}
    tables = [matrix(spark, sf, [c for c in FS1_NUM if c not in cols], g=g)[0] for cols in groups.values()]
    models = B.side_by_side([lambda m=m: B.fit(m, B.AUDIT) for m in tables])
    rows = None
    for name, m, model in zip(groups, tables, models):
        r = B.compared(m, [model], [{"removed": name}]).select("removed", "ap")
        rows = r if rows is None else rows.unionByName(r)
    rows = stored(rows, "ablation")
    full = rows.where("removed = 'none'").agg(F.max("ap")).scalar()
    d = F.col("delta_ap")
    return rows.where("removed <> 'none'").select("removed", r6(F.col("ap") - full).alias("delta_ap")).withColumn(
        "impact", F.when(d < -0.003, "high").when(d < -0.0005, "medium").otherwise("none"))


@register("retrain_feedback")
def q_retrain_feedback(spark, sf):
    """Feedback payloads → labels (ESCALATE dropped) → serving defaults →
    base ∪ feedback × 3 → encode and refit 300 rounds → score validation."""
    from ..operators.queue import feedback_label
    from .q_ops import _queue_logs
    g = fs1(spark, sf)
    qlog, fb = _queue_logs(spark, sf)
    lab = fb.select("transaction_id", feedback_label(F.col("analyst_decision")).alias("fb_label")).where(
        F.col("fb_label").isin(0, 1))
    # feedback on rows of the scored split stays out of training
    fbrows = (g.where(F.col("is_train") == 1).join(lab, "transaction_id").drop("is_fraud").withColumnRenamed("fb_label", "is_fraud"))
    fbrows = FT.serve_defaults(fbrows, FS1_NUM, CATS).withColumn(
        "_rep", F.explode(F.sequence(F.lit(1), F.lit(3)))).drop("_rep")
    cols = ["transaction_id", *FS1_NUM, *CATS, "is_fraud"]
    rows = g.select(*cols, "is_train").unionByName(fbrows.select(*cols, F.lit(1).alias("is_train")))
    m, _ = matrix(spark, sf, g=rows)
    return B.probability(B.fit(m, B.RETRAIN), m.where("is_train = 0")).select("transaction_id", "score")
