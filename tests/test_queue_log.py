"""Compaction of the queue's log: same latest rows, replays, a reader meanwhile, unfinished batches."""

import shutil

from vigilo.operators import queue as QU
from vigilo.operators import queue_log as QL

ROWS = "transaction_id long, written_at long, risk_band string"


def rows(spark, *r):
    return spark.createDataFrame(list(r), ROWS)


def state(df):
    return sorted((tuple(r) for r in QU.latest(df, "transaction_id", "written_at").collect()), key=str)


def test_compaction_keeps_the_latest_rows(spark, tmp_path):
    base = str(tmp_path)
    assert QL.log(spark, base) is None and QL.compact(spark, base, "transaction_id", "written_at") == -1
    first, second = rows(spark, (1, 10, "High"), (2, 10, "Low"), (None, 5, "Low")), rows(spark, (1, 20, "Low"), (1, 20, "Review"), (3, 5, "High"))
    QL.append(base, 0, first)
    QL.append(base, 1, second)
    before = QL.log(spark, base)
    want = state(before)
    assert QL.compact(spark, base, "transaction_id", "written_at") == 1
    assert state(QL.log(spark, base)) == want == state(before)  # a reader from before still reads its own version
    assert QL.log(spark, base).count() == 4  # one row for each id, null included
    QL.append(base, 1, second)  # replayed
    assert QL.log(spark, base).count() == 4
    QL.append(base, 2, rows(spark, (2, 30, "High"), (3, 1, "Low")))
    QL.append(base, 2, rows(spark, (2, 30, "High"), (3, 1, "Low")))
    assert QL.log(spark, base).count() == 6
    want = state(QL.log(spark, base))
    assert (2, 30, "High") in want and (3, 5, "High") in want
    assert QL.compact(spark, base, "transaction_id", "written_at") == 2
    assert state(QL.log(spark, base)) == want and QL.log(spark, base).count() == 4


def test_unfinished_batches_wait(spark, tmp_path):
    base = str(tmp_path)
    for i in range(3):
        QL.append(base, i, rows(spark, (i, i, "Low")))
    marker = tmp_path / "deltas" / "batch-000000000001" / "_SUCCESS"
    shutil.copy(marker, tmp_path / "kept")
    marker.unlink()
    assert sorted(r[0] for r in QL.log(spark, base).collect()) == [0, 2]
    assert QL.compact(spark, base, "transaction_id", "written_at") == 0
    shutil.copy(tmp_path / "kept", marker)
    assert sorted(r[0] for r in QL.log(spark, base).collect()) == [0, 1, 2]
    assert QL.compact(spark, base, "transaction_id", "written_at") == 2
