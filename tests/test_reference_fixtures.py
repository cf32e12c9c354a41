"""Reference-style example tests: cleaning fixture (FIXTURES F1), quantile
buckets (F8) and tie-aware metrics (F9)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from vigilo.functions import clean as C
from vigilo.operators import metrics as M
from vigilo.operators import profile as PR


@pytest.fixture
def f1(spark):
    rows = [(-10.0, "Card", "2023-07-06T21:04:01", 100.0), (5.0, None, "2023-07-07T10:00:00", 50.0),
            (-3.0, "Identity", "2023-07-08T08:30:00.123", 0.0), (0.0, None, "2023-07-09T14:45:00", 1000.0)]
    return spark.createDataFrame(rows, "time_since_last_transaction double, fraud_type string, "
                                       "timestamp string, amount double").withColumn("i", F.monotonically_increasing_id())


def test_clean_abs(f1):
    assert [r[0] for r in C.clean_abs(f1).orderBy("i").select(C.TSLT).collect()] == [10, 5, 3, 0]


def test_fill_label(f1):
    got = [r[0] for r in C.clean_fill_label(f1).orderBy("i").select("fraud_type").collect()]
    assert got == ["Card", "Legitimate", "Identity", "Legitimate"]


def test_temporal(f1):
    d = C.feat_time_basic(f1, ts="timestamp", parse=True).orderBy("i").collect()
    assert [r.hour for r in d] == [21, 10, 8, 14]
    assert [r.day_of_week for r in d] == [3, 4, 5, 6]
    assert [r.is_weekend for r in d] == [0, 0, 1, 1]


def test_log(f1):
    d = C.feat_log_amount(f1).orderBy("i").collect()
    assert d[2].amount_log == 0 and d[0].amount_log > 0


def test_strict_parse_fails_on_bad_text(spark):
    bad = spark.createDataFrame([("not a time",)], "timestamp string")
    with pytest.raises(Exception):
        C.feat_time_basic(bad, ts="timestamp", parse=True).collect()


def test_quantile_buckets(spark):
    d = spark.createDataFrame([(float(x), 0) for x in [1, 1, 1, 1, 2, 3, 4, 5, 6, 7]], "x double, is_fraud int")
    t = PR.lift_buckets(d, "x", 5).orderBy("bucket").collect()
    assert [r.tx_count for r in t] == [4, 2, 2, 2]
    assert [r.upper for r in t] == [1.6, 3.4, 5.2, 7.0]


def test_ap_auc_ties(spark):
    d = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.8, 1), (0.4, 0), (0.2, 1), (0.2, 0)], "score double, is_fraud int")
    r = M.ap_auc(M.score_curve(d)).first()
    assert abs(r.ap - 0.7222222222) < 1e-9
    assert abs(r.roc_auc - 6 / 9) < 1e-9


def test_topk_tie_break_by_id(spark):
    d = spark.createDataFrame([(i, 0.5, int(i % 2 == 0)) for i in range(10)],
                              "transaction_id long, score double, is_fraud int")
    r = M.topk(d, [0.2]).first()
    assert r.k == 2 and r.captured == 1   # ids 0 and 1 among the tied scores
