"""Prefix sums and quantiles: ties, nulls, NaN, empty tables, hot values, any number of ranges."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigilo.operators import metrics as M
from vigilo.operators.ranks import prefix, quantiles

PROBS = [0.0, 0.01, 0.25, 0.5, 0.9, 0.99, 1.0]


@pytest.mark.parametrize("ranges", [1, 3, 20])
def test_prefix(spark, ranges):
    rows = [(g, i, (i * 7) % 5) for g in ("a", "b") for i in range(60 if g == "a" else 3)]
    df = spark.createDataFrame(rows, "g string, i long, v long")
    for r in prefix(df, ["g"], ["i"], {"v": "v"}, ranges).collect():
        own = [v for g, i, v in rows if g == r.g]
        assert r.cum_v == sum(own[:r.i + 1]) and r.total_v == sum(own)


def test_quantiles_are_numpys(spark):
    pick = np.random.default_rng(1)
    for values in ([3.0], [1.0, 2.0], pick.normal(size=101).tolist() + [0.5] * 300, [2.0] * 50):
        df = spark.createDataFrame([(v, "x") for v in values] + [(None, "x"), (None, "empty")], "v double, g string")
        (r,) = quantiles(df, ["v"], PROBS, ["g"]).collect()
        assert r.g == "x" and np.allclose(r.q, np.quantile(values, PROBS), atol=1e-12)
    assert quantiles(df.limit(0), ["v"], PROBS).count() == 0


def test_null_and_nan_scores_are_lowest_and_counted(spark):
    df = spark.createDataFrame([(0.9, 1), (None, 1), (0.1, 0), (float("nan"), 0)], "score double, is_fraud int")
    r = M.ap_auc(M.score_curve(df)).first()
    assert abs(r.base_rate - 0.5) < 1e-12 and abs(r.ap - (0.5 * 1 + 0.5 * 0.5)) < 1e-12
    assert M.score_curve(df.limit(0)).count() == 0
    assert M.ap_auc(M.score_curve(df.limit(0))).first().ap is None


def test_topk_ranks_only_ties_by_id(spark):
    rows = [(i, 0.9 if i < 3 else 0.5 if i < 90 else None, int(i % 2 == 0)) for i in range(100)]
    df = spark.createDataFrame(rows, "transaction_id long, score double, is_fraud int")
    got = {r.pct: r for r in M.topk(df.repartition(7), [0.02, 0.1, 0.95, 0.0001]).collect()}
    for pct, k in ((0.02, 2), (0.1, 10), (0.95, 95), (0.0001, 1)):
        assert got[pct].k == k and got[pct].captured == sum(y for _, _, y in rows[:k])
    assert got[0.02].min_score == 0.9 and got[0.1].min_score == 0.5
    assert M.topk(df, [0.001], min_one=False).first().captured == 0
    by = M.topk(df.withColumn("b", F.col("transaction_id") % 2), [0.1], by="b").collect()
    assert {(r.b, r.k, r.captured) for r in by} == {(0, 5, 5), (1, 5, 0)}
