import time
from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import functions as F

from vigilo.plans.q_metrics import scored
from vigilo.session import scratch_path
from vigilo.streaming import job as SJ
from vigilo.streaming import sender_state as SS

SF = "/root/testdata/sf0.001"

PER_SENDER = ["stream_tslt", "tslt_is_negative", "history_len", *[f"is_new_{v}_for_sender" for v in SS.VALUES]]


def rows_of(stream, **kw):
    tables, progress = SJ.run_to_end(stream, "t", {"f": lambda b: b}, conf=SJ.STATE_CONF, **kw)
    return {r.transaction_id: tuple(r[c] for c in PER_SENDER) for r in tables["f"].collect()}, progress


@pytest.fixture(scope="module")
def events(spark):
    """The given events, a third of them of one sender."""
    rows = scored(spark, SF).select(*SS.INPUT)
    return rows.withColumn("sender_account", F.when(F.col("transaction_id") % 3 == 0, F.lit(-1).cast("long")).otherwise(F.col("sender_account")))


def test_several_batches_equal_one(spark, events):
    one, _ = rows_of(SS.sender_features(SS.replay(events, 1)))
    many, progress = rows_of(SS.sender_features(SS.replay(events, 5)))
    assert one == many and len(one) == events.count()
    got = [p["numInputRows"] for p in progress if p["numInputRows"]]
    assert len(got) == 5 and max(got) < 0.5 * len(one)  # what a task may hold of a sender
    assert max(r[2] for r in many.values()) == SS.HISTORY


def test_batches_are_bounded_by_rows(spark, events, monkeypatch):
    monkeypatch.setattr(SS, "BATCH_ROWS", 100)
    stream = SS.replay(events)
    _, progress = rows_of(SS.sender_features(stream))
    assert max(p["numInputRows"] for p in progress) <= 200 and sum(p["numInputRows"] for p in progress) == events.count()


def landed(spark, events, path, cut, part):
    """The rows of one part of the time, as a file that arrives."""
    rows = events.where(F.col("ts") < cut) if part == 0 else events.where(F.col("ts") >= cut)
    rows.coalesce(1).write.parquet(f"{path}/part={part}")
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/part=*")


def test_state_survives_a_restart(spark, events):
    path, ckpt, out = scratch_path(spark, "landing"), scratch_path(spark, "ckpt"), {"f": scratch_path(spark, "out")}
    cut = events.agg(F.percentile_approx("ts", 0.5)).first()[0]
    first, _ = rows_of(SS.sender_features(landed(spark, events, path, cut, 0)), checkpoint=ckpt, out=out)
    both, _ = rows_of(SS.sender_features(landed(spark, events, path, cut, 1)), checkpoint=ckpt, out=out)
    whole, _ = rows_of(SS.sender_features(SS.replay(events, 1)))
    assert 0 < len(first) < len(both) and both == whole


def test_state_expires(spark, events):
    path, ckpt, out = scratch_path(spark, "landing"), scratch_path(spark, "ckpt"), {"f": scratch_path(spark, "out")}
    cut = events.agg(F.percentile_approx("ts", 0.5)).first()[0]
    rows_of(SS.sender_features(landed(spark, events, path, cut, 0), idle_ms=1000), checkpoint=ckpt, out=out)
    time.sleep(2)
    both, _ = rows_of(SS.sender_features(landed(spark, events, path, cut, 1), idle_ms=1000), checkpoint=ckpt, out=out)
    apart, _ = rows_of(SS.sender_features(SS.replay(events.where(F.col("ts") >= F.lit(cut)), 1)))
    assert {i: both[i] for i in apart} == apart


def test_history_is_the_state_to_start_from(spark, events):
    cut = events.agg(F.percentile_approx("ts", 0.7)).first()[0]
    early, late = events.where(F.col("ts") < F.lit(cut)), events.where(F.col("ts") >= F.lit(cut))
    whole, _ = rows_of(SS.sender_features(SS.replay(events, 1)))
    begun, _ = rows_of(SS.sender_features(SS.replay(late, 3), SS.initial_state(early)))
    assert begun == {i: whole[i] for i in begun} and len(begun) == late.count()


def test_late_rows_are_dropped_and_counted(spark):
    """Rows behind the watermark are left out of closed windows; the windows close while the stream runs."""
    rows = scored(spark, SF)
    late = "transaction_id % 10 = 0"
    w, progress = SJ.stream_windows(rows, "tumbling", batches=4, late=late)
    w = w.where("n > 0")
    mark = rows.where(f"not ({late})").agg((F.floor(F.max(F.unix_micros("ts")) / 1000) * 1000 - 7_200_000_000).alias("m")).first().m
    start = F.floor(F.unix_micros("ts") / 3_600_000_000) * 3_600_000_000
    twin = rows.where(f"not ({late})").unionByName(rows.where(late).where(start + 3_600_000_000 > mark))
    want = {r.s: r.n for r in twin.groupBy(start.alias("s")).agg(F.count("*").alias("n")).collect()}
    assert {r.s: r.n for r in w.select(F.unix_micros("window.start").alias("s"), "n").collect()} == want
    assert SJ.dropped(progress) > 0 and sum(want.values()) < rows.count()
    assert w.select("epoch").distinct().count() > 1

    d, progress = SJ.stream_windows(rows, "dedup", batches=4, late=late)
    assert SJ.dropped(progress) == rows.count() - d.count() > 0


class MapOfStates:
    def __init__(self):
        self.rows, self.calls = {}, 0

    def getValue(self, key):
        self.calls += 1
        return self.rows.get(key)

    def updateValue(self, key, value):
        self.calls += 1
        self.rows[key] = value


def test_a_call_serves_many_senders():
    """The senders of a bucket share a call, a frame and an output; each costs a read and a write of its state."""
    made, state = SS.SenderFeatures(), MapOfStates()
    made.init(SimpleNamespace(getMapState=lambda *a: state))
    times = SimpleNamespace(getCurrentProcessingTimeInMs=lambda: 10)

    def batch(rows):
        df = pd.DataFrame([(i, True, s or 0, s is not None, t, 1.0, loc) for i, s, t, loc in rows], columns=["transaction_id", "id_known", "sender_account", "sender_known", "ts_us", "amount", "location"])
        for c in [*SS.VALUES[1:], *SS.BASE]:
            df[c] = None
        df["time_since_last_transaction"], df["bucket"] = 7.0, 0
        (out,) = made.handleInputRows((0,), iter([df.iloc[:2], df.iloc[2:]]), times)
        return {r.transaction_id: (r.stream_tslt, r.history_len, r.is_new_location_for_sender) for r in out.itertuples()}

    assert batch([(1, 5, 3_000_000, "a"), (2, None, 0, "a"), (3, 5, 1_000_000, "a"), (4, 0, 0, "b")]) == {1: (2.0, 1, 0), 2: (7.0, 0, 1), 3: (7.0, 0, 1), 4: (7.0, 0, 1)}
    assert state.calls == 2 * 3
    assert batch([(5, 5, 4_000_000, "b"), (6, None, 1_000_000, "a")]) == {5: (1.0, 2, 1), 6: (1.0, 1, 0)}
    assert state.calls == 2 * 3 + 2 * 2
