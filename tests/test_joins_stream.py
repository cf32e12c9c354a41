"""Top-k similarity: broadcast and blocked paths agree; the stream replay
equals the batch twins."""

from pyspark.sql import functions as F

from vigilo.operators import joins as J
from vigilo.operators import past as P
from vigilo.sources import read_table, txn_events

SF = "/root/testdata/sf0.001"


def test_topk_paths_agree(spark):
    e = read_table(spark, SF, "embeddings").withColumn("vec", J.l2_normalize("embedding"))
    corpus = e.where(F.col("label") <= 3)
    a = J.topk_similar(e, corpus, 3, "ip", q_id="vec_id", c_id="vec_id", exclude_self=True)
    b = J.topk_similar(e, corpus, 3, "ip", q_id="vec_id", c_id="vec_id", exclude_self=True,
                       broadcast_bytes=0, block_rows=7, query_chunk_rows=13)
    norm = lambda df: sorted((r.query_id, r.match_id, r.rank, round(r.score, 9)) for r in df.collect())
    assert norm(a) == norm(b)


def test_topk_with_an_offset_and_ties(spark):
    import numpy as np
    pick = np.random.default_rng(1)
    for offset in (0.0, 1e6):
        c, q = pick.uniform(0, 0.01, (400, 4)) + offset, pick.uniform(0, 0.01, (50, 4)) + offset
        cd = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(c)], "id long, vec array<double>")
        qd = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "id long, vec array<double>")
        for kw in ({}, {"broadcast_bytes": 0, "block_rows": 90}):
            got = {(r.query_id, r["rank"]): r.match_id for r in J.topk_similar(qd, cd, 3, "l2", **kw).collect()}
            for i in range(50):
                d = np.round(np.sqrt(((q[i] - c) ** 2).sum(axis=1)) * 1e9)
                assert [got[i, k] for k in (1, 2, 3)] == np.lexsort((np.arange(400), d))[:3].tolist()
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(1000)], "id long, vec array<double>")
    got = J.topk_similar(same.limit(100), same, 3, "l2", exclude_self=True).collect()
    assert len(got) == 300 and {r.match_id for r in got} == {0, 1, 2, 3}


def _split(spark, n):
    """The events table as a folder of n files."""
    from vigilo.session import scratch_path
    base = scratch_path(spark, "test-events")
    ev = spark.read.parquet(f"{SF}/events.parquet")
    ev.repartitionByRange(n, "ts").write.parquet(f"{base}/events.parquet")
    return base


def test_stream_equals_batch_twin(spark):
    from vigilo.plans.q_metrics import scored
    from vigilo.streaming import job as SJ
    tables, progress = SJ.run_to_end(SJ.stateful_features(scored(spark, SF)), "t", {"f": lambda b: b}, conf=SJ.STATE_CONF)
    assert sum(p["numInputRows"] > 0 for p in progress) == 4
    st = {r.transaction_id: r for r in tables["f"].collect()}
    d = txn_events(spark, SF).select("transaction_id", "ts", "sender_account", "location")
    d = P.novelty(d, "sender_account", "location", "nov", ties="positional")
    for r in d.collect():
        assert st[r.transaction_id].is_new_location_for_sender == r.nov
    assert len(st) == d.count()


def test_batches_run_again_leave_rows_once(spark):
    """A restart from a checkpoint that has lost its last commit writes the same epochs again."""
    import os
    import shutil

    from vigilo.plans.q_metrics import scored
    from vigilo.session import scratch_path
    from vigilo.streaming import job as SJ
    base = _split(spark, 4)
    ckpt, out = scratch_path(spark, "ckpt"), {"d": scratch_path(spark, "out")}
    run = lambda: SJ.run_to_end(SJ.routed(scored(spark, SF, SJ.event_stream(spark, base, 1)), "score").select("transaction_id", "route"), "t", {"d": lambda b: b}, ckpt, out)
    first = run()[0]["d"].count()
    assert first == txn_events(spark, SF).count()
    commits = f"{ckpt.removeprefix('file:')}/commits"
    last = max(int(x) for x in os.listdir(commits) if x.isdigit())
    assert last >= 3
    for x in (str(last), f".{last}.crc"):
        if os.path.exists(f"{commits}/{x}"):
            shutil.move(f"{commits}/{x}", f"{scratch_path(spark, 'gone').removeprefix('file:')}-{x.strip('.')}")
    again = run()[0]["d"]
    assert again.count() == first == again.select("transaction_id").distinct().count()


def test_windows_are_complete_and_history_seeds_state(spark):
    from vigilo.plans.q_metrics import scored
    from vigilo.streaming import job as SJ
    n = txn_events(spark, SF).count()
    for kind in ("tumbling", "session", "dedup"):
        w, progress = SJ.stream_windows(scored(spark, SF), kind)
        assert SJ.dropped(progress) == 0
        assert (w.count() if kind == "dedup" else w.agg(F.sum("n")).first()[0]) == n
    tables, _ = SJ.run_to_end(SJ.stateful_features(scored(spark, SF), scored(spark, SF)), "t", {"f": lambda b: b}, conf=SJ.STATE_CONF)
    assert tables["f"].where("is_new_location_for_sender = 1").count() == 0


def test_tasks_of_windows_are_bounded(spark):
    """A batch's file isn't one task of the sliding windows, and state has few partitions however many the session has."""
    from vigilo.streaming import job as SJ
    from vigilo.streaming.sender_state import replay
    rows = spark.range(400).selectExpr("id as transaction_id", "timestamp_seconds(1700000000 + id * 60) as ts", "id % 7 as sender_account", "1.0D as amount", "0 as is_fraud")
    src = replay(rows, 2).withWatermark("ts", "2 hours")
    assert "RepartitionByExpression [sender_account" in SJ.windowed(src, "sliding")._jdf.queryExecution().analyzed().toString()
    with SJ.configured(spark, {"spark.sql.shuffle.partitions": "48"}):
        w, progress = SJ.stream_windows(rows.unionByName(rows), "dedup", 2)
    assert {op["numShufflePartitions"] for p in progress for op in p["stateOperators"]} == {SJ.STATE_PARTS}
    assert w.count() == 400 == w.select("transaction_id").distinct().count()
