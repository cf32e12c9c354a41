"""Tie semantics of the window core (FIXTURES F7) and skew-path equivalence."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from vigilo.operators import past as P

ROWS = [(1, "a", dt.datetime(2024, 1, 1, 0), 1.0), (2, "a", dt.datetime(2024, 1, 1, 12), 2.0),
        (3, "a", dt.datetime(2024, 1, 1, 12), 3.0), (4, "a", dt.datetime(2024, 1, 2, 0), 4.0),
        (5, "a", dt.datetime(2024, 1, 2, 0), 5.0)]



@pytest.fixture
def f7(spark):
    return spark.createDataFrame(ROWS, "transaction_id long, k string, ts timestamp, x double")


def col(df, c):
    return [r[c] for r in df.orderBy("transaction_id").collect()]


@pytest.mark.parametrize("chunks", [1, 2, 7])
def test_counts(f7, chunks):
    d = P.running(f7, ["k"], {"pos": ("count", None)}, ties="positional", chunks=chunks)
    assert col(d, "pos") == [0, 1, 2, 3, 4]
    d = P.running(f7, ["k"], {"st": ("count", None)}, ties="strict", chunks=chunks)
    assert col(d, "st") == [0, 1, 1, 3, 3]


@pytest.mark.parametrize("chunks", [1, 2, 7])
def test_rolling(f7, chunks):
    m = {"n": ("count", None), "s": ("sum", F.col("x"))}
    d = P.rolling(f7, ["k"], "24h", m, ties="positional", chunks=chunks)
    assert col(d, "n") == [0, 1, 2, 2, 3]
    assert col(d, "s") == [0, 1, 3, 5, 9]
    d = P.rolling(f7, ["k"], "24h", {"n": ("count", None)}, ties="strict", chunks=chunks)
    assert col(d, "n") == [0, 1, 1, 2, 2]


@pytest.mark.parametrize("chunks", [1, 2, 7])
def test_expanding(f7, chunks):
    d = P.expanding(f7, "k", "x", "e", chunks=chunks)
    assert col(d, "e_sum") == [None, 1, 3, 6, 10]
    assert col(d, "e_count") == [0, 1, 2, 3, 4]
    std = col(d, "e_std")
    assert std[0] is None and std[1] == 0
    assert abs(std[4] - 1.118033988749895) < 1e-12
    d = P.expanding_median(f7, "k", "x", "med")
    assert col(d, "med") == [None, 1, 1.5, 2, 2.5]


def test_results_do_not_depend_on_chunks(spark):
    from vigilo.sources import txn_events
    df = txn_events(spark, "/root/testdata/sf0.001")
    df = df.withColumn("sender_account", F.when(F.col("transaction_id") % 3 == 0, F.lit(-1)).when(F.col("transaction_id") % 5 == 1, F.lit(None)).otherwise(F.col("sender_account")))

    def feats(chunks):
        d = P.unique_so_far(df, "sender_account", "location", "u", ties="strict", chunks=chunks)
        d = P.expanding(d, "sender_account", "amount", "amt", chunks=chunks)
        d = P.rolling_many(d, ["sender_account"], {"7d": {"r": ("count", None)}, "24h": {"s": ("sum", F.col("amount"))}}, chunks=chunks)
        d = P.rolling(d, ["sender_account"], "24h", {"q": ("count", None)}, ties="strict", chunks=chunks)
        d = P.past_label_neighbors(d, "sender_account", "receiver_account", "pln", chunks=chunks)
        return {r["transaction_id"]: (r["u"], r["amt_sum"] and round(r["amt_sum"], 6),
                                      r["amt_std"] and round(r["amt_std"], 6), r["amt_max"], r["r"], round(r["s"], 6), r["q"], r["pln"])
                for r in d.collect()}

    want = feats(1)
    assert len(want) == df.count()
    assert feats(5) == want and feats(40) == want


def test_std_of_a_large_offset(spark):
    df = spark.range(200).selectExpr("id as transaction_id", "'k' as k", "timestamp_seconds(id) as ts", "1e9 + id % 3 as x")
    for chunks in (1, 9):
        d = P.expanding(df, "k", "x", "e", chunks=chunks)
        last = d.where("transaction_id = 199").first()
        assert abs(last["e_std"] - 0.8175) < 1e-3
    a, b = (col(P.expanding(df, "k", "x", "e", chunks=c), "e_std") for c in (1, 9))
    assert all((x is None and y is None) or abs(x - y) < 1e-6 for x, y in zip(a, b))


def hot(spark):
    """One entity with many rows of one time and of no time, and some small entities, null among them."""
    rows = spark.range(400).selectExpr("id as transaction_id", "case when id % 5 = 0 then id % 3 when id % 31 = 1 then null else 7 end as e", "id % 11 as a", "case when id % 13 = 0 then null else id % 4 end as b",
                                       "case when id % 9 = 0 then null when id % 3 = 0 then timestamp_seconds(id) else timestamp_seconds(1000) end as ts", "id * 0.5 as x")
    return rows


def test_ties_of_one_time_lie_in_several_ranges(spark):
    d = P.placed(hot(spark), ["e"], chunks=12, order=["transaction_id"])
    assert d.where("e = 7 and ts = timestamp_seconds(1000)").select("_c").distinct().count() > 3

    def feats(chunks):
        d = P.expanding(hot(spark), "e", "x", "s", chunks=chunks)
        d = P.unique_so_far(d, "e", "a", "u", chunks=chunks)
        return {r["transaction_id"]: (r["s_sum"], r["s_count"], r["s_max"], None if r["s_std"] is None else round(r["s_std"], 9), r["u"]) for r in d.collect()}

    want = {}
    past = {}
    for r in sorted(hot(spark).collect(), key=lambda r: (r["ts"] is not None, r["ts"] or 0, r["transaction_id"])):
        seen = past.setdefault(r["e"], [])
        xs = [float(s["x"]) for s in seen]
        mean = sum(xs) / len(xs) if xs else None
        std = None if not xs else round((sum((x - mean) ** 2 for x in xs) / len(xs)) ** 0.5, 9)
        want[r["transaction_id"]] = (sum(xs) if xs else None, len(xs), max(xs) if xs else None, std, len({s["a"] for s in seen}))
        seen.append(r)
    for chunks in (1, 12):
        got = {k: (v[0] if v[0] is None else float(v[0]), v[1], v[2] if v[2] is None else float(v[2]), v[3], v[4]) for k, v in feats(chunks).items()}
        for k, w in want.items():
            g = got[k]
            assert (g[0], g[1], g[2], g[4]) == (w[0], w[1], w[2], w[4])
            assert g[3] == w[3] or abs(g[3] - w[3]) < 1e-6


@pytest.mark.parametrize("chunks", [1, 12])
def test_together_equals_one_by_one(spark, chunks):
    d = hot(spark)
    many = P.together(d, ["e"], [(["e", "a"], {"na": ("count", None)}, "strict"), (["e", "b"], {"nb": ("count", None), "mb": ("max", F.col("x"))}, "positional"),
                                 (["e"], {"s": ("sum", F.col("x")), "v": ("var", F.col("x"))}, "strict")], chunks=chunks)
    one = P.running(d, ["e", "a"], {"na": ("count", None)}, ties="strict")
    one = P.running(one, ["e", "b"], {"nb": ("count", None), "mb": ("max", F.col("x"))})
    one = P.running(one, ["e"], {"s": ("sum", F.col("x")), "v": ("var", F.col("x"))}, ties="strict")
    cut = lambda df: {r["transaction_id"]: (r["na"], r["nb"], r["mb"], r["s"], None if r["v"] is None else round(r["v"], 6)) for r in df.collect()}
    assert set(many.columns) == set(one.columns) and cut(many) == cut(one)


def test_beside_equals_a_chain(spark):
    d = hot(spark)
    got = P.beside(d, [(["e"], lambda r: P.seq_index(r, "e", "n")), (["a", "b"], lambda r: P.novelties(r, "a", {"new": "b"}))], keep=["x"])
    want = P.novelty(P.seq_index(d, "e", "n"), "a", "b", "new").select(got.columns)
    assert sorted(got.collect()) == sorted(want.collect())


def test_later_steps_carry_reads_spanning_entities_only(spark):
    """A filter on ``_span`` passes below the windows of the step before."""
    d = P.placed(hot(spark), ["e"], chunks=6)
    d = P.running(d, ["e", "a"], {"n": ("count", None)})
    plan = d.where("_span")._jdf.queryExecution().optimizedPlan().toString()
    above = plan[:plan.index("Window")].splitlines()
    assert not [line for line in above if "Filter" in line and "_span" in line]


def test_small_entities_are_shuffled_once(spark, monkeypatch):
    """Without a hot entity no placement is stored and each entity's windows share one shuffle; results are those of ranges."""
    def feats(chunks=None):
        d = P.uniques_so_far(hot(spark), "e", {"u": "a", "v": "b"}, ties="strict", chunks=chunks)
        d = P.expanding(d, "e", "x", "s", chunks=chunks)
        return P.rolling(d, ["e"], "24h", {"n": ("count", None), "w": ("sum", F.col("x"))}, chunks=chunks)

    def cut(d):
        return {r["transaction_id"]: (r["u"], r["v"], r["s_sum"], r["s_count"], r["s_max"], None if r["s_std"] is None else round(r["s_std"], 6), r["n"], r["w"]) for r in d.collect()}

    want = cut(feats(7))
    asked = []
    place = P.placed
    monkeypatch.setattr(P, "placed", lambda *a, **kw: asked.append(1) or place(*a, **kw))
    d = P.uniques_so_far(hot(spark), "e", {"u": "a"}, ties="strict")
    assert d._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert cut(feats()) == want and not asked
    monkeypatch.setattr(P, "HOT_ROWS", 50)
    assert cut(feats()) == want and asked
