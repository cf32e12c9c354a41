"""Rank metrics of scores without a single-partition sort.

``score_curve`` is the shared primitive: one row per (group, distinct score)
with the cumulative true/false positives at threshold ``score >= s``.  Rows are
first grouped by score (a hot score value is one row) and distinct scores get
their running sums from ``ranks.prefix``.  AP, ROC AUC, PR curve and best-F1 are
aggregates over this curve; top-K takes its cut-off score from it and ranks
only the rows tied at the cut-off, by id.

Null and NaN scores rank below all others and count in every total; an empty
table gives an empty curve.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .profile import r6
from .ranks import prefix, quantiles


def ranked_score(score: str) -> Column:
    """A score for ranking: null and NaN are lowest."""
    c = F.col(score).cast("double")
    return F.when(c.isNull() | F.isnan(c), F.lit(float("-inf"))).otherwise(c)


def score_curve(df: DataFrame, score: str = "score", label: str = "is_fraud",
                by: list[str] | None = None) -> DataFrame:
    """Columns: by…, score, n, pos, cum_n, cum_pos, total_n, total_pos."""
    by = list(by or [])
    g = df.select(*by, ranked_score(score).alias(score), F.col(label).cast("long").alias("_y")).groupBy(*by, score).agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("_y"), F.lit(0)).alias("pos"))
    c = prefix(g, by, [F.desc(score)], {"n": "n", "pos": "pos"})
    return c.select(*by, score, "n", "pos", "cum_n", "cum_pos", "total_n", "total_pos")


def ap_auc(curve: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Average precision over distinct thresholds and tie-aware ROC AUC."""
    by = list(by or [])
    P, N = F.col("total_pos"), F.col("total_n") - F.col("total_pos")
    neg = F.col("n") - F.col("pos")
    pos_above = F.col("cum_pos") - F.col("pos")
    return curve.groupBy(*by).agg(
        F.sum(F.col("pos") / P * (F.col("cum_pos") / F.col("cum_n"))).alias("ap"),
        (F.sum(neg * (pos_above + F.col("pos") / 2)) / F.first(P * N)).alias("roc_auc"),
        F.first(P / F.col("total_n")).alias("base_rate"))


def pr_curve(curve: DataFrame) -> DataFrame:
    return curve.select("*", (F.col("cum_pos") / F.col("cum_n")).alias("precision"),
                        (F.col("cum_pos") / F.col("total_pos")).alias("recall"))


def best_f1_curve(curve: DataFrame, by: list[str] | None = None, eps: float = 1e-9) -> DataFrame:
    """F1 argmax over every distinct threshold (ties → the higher threshold,
    i.e. fewer predicted positives)."""
    c = pr_curve(curve)
    f1 = 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + eps)
    c = c.withColumn("f1", f1)
    return c.groupBy(*(by or [])).agg(
        F.max("f1").alias("best_f1"),
        F.max_by(F.col(c.columns[len(by or [])]), F.struct(F.col("f1"), F.col(c.columns[len(by or [])])))
        .alias("best_threshold"))


def threshold_table(df: DataFrame, thresholds: list[float], score: str = "score",
                    label: str = "is_fraud") -> DataFrame:
    """Confusion counts and rates at each threshold — all thresholds as
    conditional sums of ONE aggregation (no row explosion), then unpivoted."""
    y = F.col(label) == 1
    aggs = [F.count(F.lit(1)).alias("_n"), F.count_if(y).alias("_p")]
    for i, t in enumerate(thresholds):
        pr = F.col(score) >= F.lit(t)
        aggs += [F.count_if(pr).alias(f"_pred{i}"), F.count_if(pr & y).alias(f"_tp{i}")]
    one = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"_pred{i}").alias("predicted"),
                              F.col(f"_tp{i}").alias("tp")) for i, t in enumerate(thresholds)])
    x = one.select("_n", "_p", F.inline(rows))
    tp, pred, n, p = F.col("tp"), F.col("predicted"), F.col("_n"), F.col("_p")
    fp, fn = pred - tp, p - tp
    tn = n - p - fp
    div = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    prec, rec = div(tp, pred), div(tp, p)
    return x.select("threshold", "predicted", r6(pred / n).alias("predicted_rate"),
                    tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), tn.alias("tn"),
                    r6(prec).alias("precision"), r6(rec).alias("recall"),
                    r6(div(2 * prec * rec, prec + rec)).alias("f1"),
                    r6(div(fp, fp + tn)).alias("fpr"), r6(div(fn, fn + tp)).alias("fnr"))


def best_f1_grid(table: DataFrame) -> DataFrame:
    """First maximum of F1 over the grid (lowest threshold wins ties)."""
    return table.agg(F.max("f1").alias("best_f1"),
                     F.max_by("threshold", F.struct(F.col("f1"), -F.col("threshold")))
                     .alias("best_threshold"))


def topk(df: DataFrame, pcts: list[float], score: str = "score", label: str = "is_fraud",
         id_col: str = "transaction_id", min_one: bool = True, by: str | None = None) -> DataFrame:
    """Precision / recall / captured for the top ``max(1, int(n * pct))`` rows by
    score (desc), ties broken by id (asc); per ``by`` group if given."""
    keys = [by] if by else []
    d = df.select(*keys, ranked_score(score).alias("_s"), F.col(label).alias("_y"), F.col(id_col).alias("_id"))
    k = F.floor(F.col("total_n") * F.col("pct"))
    k = (F.greatest(k, F.lit(1)) if min_one else k).cast("long")
    c = score_curve(d, "_s", "_y", keys).withColumn("pct", F.explode(F.array(*[F.lit(float(p)) for p in pcts]))).withColumn("k", k)
    above = F.col("cum_n") < F.col("k")
    cut = c.groupBy(*keys, "pct").agg(
        F.first("k").alias("k"), F.first("total_pos").alias("_gp"),
        F.max(F.when(F.col("k") > 0, F.when(~above, F.col("_s")))).alias("_cut"),
        F.coalesce(F.max(F.when(above, F.col("cum_n"))), F.lit(0)).alias("_n_above"),
        F.coalesce(F.max(F.when(above, F.col("cum_pos"))), F.lit(0)).alias("_pos_above"))
    tied = d.join(cut.select(*keys, "pct", F.col("_cut").alias("_s"), (F.col("k") - F.col("_n_above")).alias("_need")), [*keys, "_s"])
    tied = prefix(tied, [*keys, "pct"], ["_id"], {"n": F.lit(1).cast("long")})
    tied = tied.where(F.col("cum_n") <= F.col("_need")).groupBy(*keys, "pct").agg(F.sum("_y").alias("_pos_tied"))
    g = cut.join(tied, [*keys, "pct"], "left")
    cap = (F.when(F.col("k") > 0, F.col("_pos_above")).otherwise(0) + F.coalesce("_pos_tied", F.lit(0))).cast("long")
    return g.select(*keys, "pct", "k", cap.alias("captured"),
                    r6(F.when(F.col("k") > 0, cap / F.col("k")).otherwise(0.0)).alias("precision"),
                    r6(F.when(F.col("_gp") > 0, cap / F.col("_gp")).otherwise(0.0)).alias("recall"),
                    F.col("_cut").cast(df.schema[score].dataType).alias("min_score"))


def confusion(df: DataFrame, pred: Column, label: str = "is_fraud") -> DataFrame:
    y = F.col(label) == 1
    c = df.agg(F.count_if(pred & y).alias("tp"), F.count_if(pred & ~y).alias("fp"),
               F.count_if(~pred & y).alias("fn"), F.count_if(~pred & ~y).alias("tn"))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    div = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    prec, rec = div(tp, tp + fp), div(tp, tp + fn)
    return c.select("tp", "fp", "fn", "tn", r6((tp + tn) / (tp + fp + fn + tn)).alias("accuracy"),
                    r6(prec).alias("precision"), r6(rec).alias("recall"),
                    r6(div(2 * prec * rec, prec + rec)).alias("f1"))


def brier(df: DataFrame, score: str = "score", label: str = "is_fraud") -> DataFrame:
    return df.agg(r6(F.avg(F.pow(F.col(score) - F.col(label), 2))).alias("brier"))


SCORE_PCTS = [0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99]


def score_describe(df: DataFrame, score: str = "score", label: str = "is_fraud") -> DataFrame:
    """count / mean / std / min / 9 percentiles / max for all rows and each
    label, one pass (each row counted under 'all' and its label)."""
    x = df.select(F.explode(F.array(F.lit("all"), F.col(label).cast("string"))).alias("subset"), score)
    g = x.groupBy("subset").agg(F.count(score).alias("count"), r6(F.avg(score)).alias("mean"),
                                r6(F.stddev_samp(score)).alias("std"), F.min(score).alias("min"), F.max(score).alias("max"))
    g = g.join(quantiles(x, [score], SCORE_PCTS, ["subset"]).withColumnRenamed("q", "_p"), "subset", "left")
    return g.select("subset", "count", "mean", "std", "min",
                    *[r6(F.col("_p")[i]).alias(f"p{int(round(p * 100))}") for i, p in enumerate(SCORE_PCTS)],
                    "max")


def signal_level(ap: Column) -> Column:
    """Verdict bands of the reference (AP < .05 / < .07 / < .10 / else)."""
    return (F.when(ap < 0.05, "WEAK").when(ap < 0.07, "WEAK-TO-MODERATE")
             .when(ap < 0.10, "MODERATE").otherwise("STRONG"))


def generalization(val: Column, test: Column) -> Column:
    """'Good' if the test value exceeds 0.9 × the validation value."""
    return F.when(test > val * 0.9, "Good").otherwise("Drop")


def material(d_ap: Column, d_p1: Column, d_p5: Column) -> Column:
    """Improvement is material if ΔAP ≥ .002 or ΔP@1% ≥ .005 or ΔP@5% ≥ .005
    (precision compared with precision)."""
    return ((d_ap >= 0.002) | (d_p1 >= 0.005) | (d_p5 >= 0.005)).cast("int")


def blocks_report(df: DataFrame, score: str = "score", label: str = "is_fraud",
                  block: str = "block", id_col: str = "transaction_id",
                  stable_range: float = 0.005) -> DataFrame:
    """Per time block: rate, AP, P@1%, P@5%, R@1%, R@5%, plus the AP range
    across blocks and the stability verdict."""
    m = ap_auc(score_curve(df, score, label, by=[block]), by=[block])
    t = topk(df, [0.01, 0.05], score, label, id_col, by=block)
    t1 = t.where(F.col("pct") == 0.01).select(block, F.col("precision").alias("p_at_1"),
                                               F.col("recall").alias("r_at_1"))
    t5 = t.where(F.col("pct") == 0.05).select(block, F.col("precision").alias("p_at_5"),
                                               F.col("recall").alias("r_at_5"))
    j = m.join(t1, block).join(t5, block)   # ≤ k blocks each side
    w = Window.partitionBy()               # over the k block rows only
    rng = F.max("ap").over(w) - F.min("ap").over(w)
    return j.select(block, r6("base_rate").alias("fraud_rate"), r6("ap").alias("ap"),
                    "p_at_1", "p_at_5", "r_at_1", "r_at_5", r6(rng).alias("ap_range"),
                    (rng < stable_range).cast("int").alias("stable"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Spearman correlation with average ranks on ties, from grouped counts:
    (x, y) pairs are counted, each distinct value gets its average rank from
    a prefix over the distinct values (score-curve machinery), and the
    Pearson correlation of the ranks is a weighted one-row aggregate."""
    g = df.groupBy(x, y).agg(F.count(F.lit(1)).alias("w"))

    def avg_rank(col):
        c = score_curve(df.select(F.col(col).alias("_s"), F.lit(0).alias("_l")), "_s", "_l")
        # cum_n counts rows >= value; rows below = total - cum_n
        return c.select(F.col("_s").alias(col), (F.col("total_n") - F.col("cum_n") + (F.col("n") + 1) / 2.0)
                        .alias(f"_r_{col}"))

    j = g.join(avg_rank(x), x).join(avg_rank(y), y)
    w, a, b = F.col("w"), F.col(f"_r_{x}"), F.col(f"_r_{y}")
    s = j.agg(F.sum(w).alias("n"), F.sum(w * a).alias("sa"), F.sum(w * b).alias("sb"),
              F.sum(w * a * a).alias("saa"), F.sum(w * b * b).alias("sbb"), F.sum(w * a * b).alias("sab"))
    n = F.col("n")
    cov = F.col("sab") - F.col("sa") * F.col("sb") / n
    va = F.col("saa") - F.col("sa") * F.col("sa") / n
    vb = F.col("sbb") - F.col("sb") * F.col("sb") / n
    return s.select((cov / F.sqrt(va * vb)).alias("spearman"))


def feature_diagnostics(df: DataFrame, features: list[str], label: str = "is_fraud",
                        keep_lift: float = 1.02) -> DataFrame:
    """Per feature (unpivoted, one grouped pass): null / zero rates, label
    rate at zero / non-zero, AP in both directions (null → 0), relative lift
    and the keep flag."""
    u = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("raw"))
                                     for c in features])), label)
    u = u.withColumn("x", F.coalesce("raw", F.lit(0.0))).withColumn("nx", -F.col("x"))
    st = u.groupBy("feature").agg(
        F.avg(F.col("raw").isNull().cast("double")).alias("null_rate"),
        F.avg((F.col("x") == 0).cast("double")).alias("zero_rate"),
        F.avg(F.when(F.col("x") == 0, F.col(label))).alias("rate_zero"),
        F.avg(F.when(F.col("x") != 0, F.col(label))).alias("rate_nonzero"),
        F.avg(label).alias("base"))
    ap_p = ap_auc(score_curve(u, "x", label, by=["feature"]), by=["feature"]).select("feature", F.col("ap").alias("ap_p"))
    ap_n = ap_auc(score_curve(u, "nx", label, by=["feature"]), by=["feature"]).select("feature", F.col("ap").alias("ap_n"))
    j = st.join(ap_p, "feature").join(ap_n, "feature")   # one row per feature each
    best = F.greatest("ap_p", "ap_n")
    return j.select("feature", r6("null_rate").alias("null_rate"), r6("zero_rate").alias("zero_rate"),
                    r6("rate_zero").alias("rate_zero"), r6("rate_nonzero").alias("rate_nonzero"),
                    r6(best).alias("best_ap"),
                    F.when(F.col("ap_p") >= F.col("ap_n"), "higher").otherwise("lower").alias("direction"),
                    r6(best / F.col("base")).alias("rel_lift"),
                    (best / F.col("base") > keep_lift).cast("int").alias("keep"))


def history_diagnostics(df: DataFrame, features: list[str], label: str = "is_fraud") -> DataFrame:
    u = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("v"))
                                     for c in features])), label)
    g = u.groupBy("feature").agg(
        r6(F.avg((F.col("v") == 0).cast("double"))).alias("zero_rate"), r6(F.avg("v")).alias("mean"),
        F.max("v").alias("max"), r6(F.avg(F.when(F.col("v") == 0, F.col(label)))).alias("rate_zero"),
        r6(F.avg(F.when(F.col("v") > 0, F.col(label)))).alias("rate_positive"))
    q = quantiles(u, ["v"], [0.5, 0.99], ["feature"])
    return g.join(q, "feature", "left").select("feature", "zero_rate", "mean", r6(F.col("q")[0]).alias("median"), r6(F.col("q")[1]).alias("p99"),
                                               "max", "rate_zero", "rate_positive")
