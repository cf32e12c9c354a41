"""Daily drift monitors against brute force, and the rendered brief."""

import numpy as np
from pyspark.sql import functions as F

from vigilo.functions import text as TX
from vigilo.operators import monitors as MO

ROWS = "day string, s double, f boolean"


def clean(rows, day=None):
    return np.array([s for d, s, _ in rows if s is not None and not np.isnan(s) and day in (None, d)])


def test_psi_and_ks(spark):
    pick = np.random.default_rng(5)
    ref = [("r", float(round(x, 1)), None) for x in pick.normal(0, 1, 400)] + [("r", None, None), ("r", float("nan"), None)]
    cur = [("a", float(round(x, 1)), True) for x in pick.normal(0.5, 1, 150)] + [("b", 9.0, False)] * 70 + [("a", None, None), ("c", None, None), ("c", float("nan"), True)]
    cd, rd = spark.createDataFrame(cur, ROWS), spark.createDataFrame(ref, ROWS)
    psi = {r.day: (r.n, r.value) for r in MO.psi(cd, rd, "s").collect()}
    ks = {r.day: (r.n, r.value) for r in MO.ks(cd, rd, "s").collect()}
    base = clean(ref)
    cuts = np.quantile(base, np.arange(1, 10) / 10)
    share = lambda v: np.maximum(np.bincount((v[:, None] > cuts).sum(axis=1), minlength=10) / len(v), MO.FLOOR)
    assert set(psi) == set(ks) == {"a", "b"}
    for day in "ab":
        v, r = clean(cur, day), share(base)
        p = share(v)
        assert psi[day][0] == ks[day][0] == len(v)
        assert abs(psi[day][1] - ((p - r) * np.log(p / r)).sum()) < 1e-9
        at = np.union1d(v, base)
        assert abs(ks[day][1] - max(abs((v <= x).mean() - (base <= x).mean()) for x in at)) < 1e-12
    assert MO.psi(cd.limit(0), rd, "s").count() == MO.ks(cd.limit(0), rd, "s").count() == 0


def test_rates(spark):
    d = spark.createDataFrame([("a", 1.0, True), ("a", 1.0, False), ("a", 1.0, None), ("b", 1.0, None)], ROWS)
    ref = spark.createDataFrame([("r", 1.0, True), ("r", 1.0, False), ("r", 1.0, False), ("r", 1.0, False)], ROWS)
    got = {(r.day, r.monitor): (r.n, r.value) for r in MO.rates(d, {"x": F.col("f")}, reference=ref).collect()}
    assert got == {("a", "x"): (2, 0.25), ("b", "x"): (0, None)}
    got = {(r.day, r.monitor): (r.n, r.value) for r in MO.rates(d, {"x": F.col("f"), "y": ~F.col("f")}).collect()}
    assert got["a", "x"] == got["a", "y"] == (2, 0.5)


def test_brief(spark):
    d = spark.createDataFrame([("High", ["one", "two"], ["case"]), ("Low", None, []), ("Other", [], [])], "band string, e array<string>, c array<string>")
    high, low, other = [r[0] for r in d.select(TX.brief(F.col("band"), F.col("e"), F.col("c"))).collect()]
    assert high.split("\n") == ["Why This Was Flagged", TX.EXPLANATION["Why This Was Flagged"], "Evidence", "- one", "- two", "Similar Historical Cases", "- case",
                                TX.NEXT_STEP_TITLE, TX.BRIEF["High"][1], TX.CAVEATS_TITLE, *TX.CAVEATS]
    assert low.split("\n")[2:4] == ["Evidence", "Similar Historical Cases"] and other is None
