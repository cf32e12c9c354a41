"""Per-sender state of the event stream, kept by Spark's state store.

``transformWithStateInPandas`` holds a map from sender to its state: the last arrival time, the last 50 events and the
values used so far, so a sender's state is bounded by these and never a frame of its rows.  An entry of the map has a
time to live, and so has each value used; a sender that is silent for longer starts anew.  The state lives in RocksDB,
so it may be larger than an executor's memory.

Senders are grouped in a fixed number of buckets by hash, and a bucket's rows are worked on at once: a call of the
function, a frame and an Arrow batch cost some milliseconds, which each sender of each micro-batch would pay otherwise.  What
is left for a sender is one read and one write of its entry.

What a task holds is a bucket's rows of one micro-batch, which the source's limit bounds (``replay``, or
``maxFilesPerTrigger`` on a landing folder).  Rows of a batch are put in the order of (ts, id); a later batch goes
on from the state, so several batches give what one gives as long as files come in the order of time.

A stream may start from a history table: its senders' last time, last events and used values are the initial state.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..session import scratch_path

HISTORY = 50
IDLE_MS = 90 * 86_400_000  # a state variable goes after so long without being written
VALUES = ["location", "payment_channel", "device_used", "transaction_type"]
BASE = ["merchant_category", "spending_deviation_score", "velocity_score", "geo_anomaly_score", "is_fraud", "score"]
INPUT = ["transaction_id", "sender_account", "ts", "amount", "time_since_last_transaction", *VALUES, *BASE]
OUT = ["transaction_id", "sender_account", "ts", "amount", *VALUES, *BASE]
NEW = [f"is_new_{v}_for_sender" for v in VALUES]
# within the function a time is a number, and an id that may be null a number and whether it is known
CARRIED_SCHEMA = ("transaction_id long, id_known boolean, sender_account long, sender_known boolean, ts_us long, amount double, "
                  + ", ".join(f"{v} string" for v in VALUES)
                  + ", merchant_category string, spending_deviation_score double, velocity_score double, geo_anomaly_score double, is_fraud int, score double")
OUT_SCHEMA = f"{CARRIED_SCHEMA}, stream_tslt double, tslt_is_negative int, history_len int, " + ", ".join(f"{n} int" for n in NEW)
SENDER = "sender_account long, sender_known boolean"
SENDER_STATE = "last_us long, history_us array<long>, history_amount array<double>, feature array<string>, value array<string>, since_ms array<long>"
NO_TIME = -2**63
BUCKETS = 512  # of senders; a running stream's state is bound to it
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # states expire when they are asked for, so no batch need run for time alone (a finite replay would never end)
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}
BATCH_ROWS = 1_000_000  # at most, and so of a sender in a task at once
FAR = "2200-01-01"


class SenderFeatures(StatefulProcessor):
    """Time since the last event, length of the history and first uses, for every event of a bucket's senders."""

    def __init__(self, idle_ms: int = IDLE_MS):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.senders = handle.getMapState("senders", SENDER, SENDER_STATE, self.idle_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        batch = pd.concat(list(rows), ignore_index=True)  # of one micro-batch
        sender, known, t, ids = (batch[c].to_numpy() for c in ("sender_account", "sender_known", "ts_us", "transaction_id"))
        order = np.lexsort((ids, ~batch["id_known"].to_numpy(bool), t, sender, known))
        batch = batch.iloc[order].reset_index(drop=True)
        sender, known, t = sender[order], known[order], t[order]
        head = np.concatenate([[True], (sender[1:] != sender[:-1]) | (known[1:] != known[:-1])])
        starts = np.flatnonzero(head)
        ends = np.append(starts[1:], len(batch))
        of = np.cumsum(head) - 1  # the row's sender, by place
        keys = [(int(sender[i]), bool(known[i])) for i in starts.tolist()]
        states = [self.senders.getValue(k) for k in keys]

        last = np.array([s[0] if s is not None and s[0] is not None else t[i] for s, i in zip(states, starts.tolist())], dtype=np.int64)
        before = np.concatenate([t[:1], t[:-1]])
        before[starts] = last
        gap = (t - before) / 1e6
        never = np.array([s is None or s[0] is None for s in states])
        first = starts[never]  # the first event ever of a sender: its own value
        gap[first] = batch["time_since_last_transaction"].to_numpy(dtype=float)[first]
        out = batch.drop(columns=["time_since_last_transaction", "bucket"])
        out["stream_tslt"] = gap  # a missing number is null
        out["tslt_is_negative"] = (np.nan_to_num(gap, nan=0.0) < 0).astype("int32")
        past = np.array([0 if s is None else len(s[1]) for s in states], dtype=np.int64)
        out["history_len"] = np.minimum(past[of] + np.arange(len(batch)) - starts[of], HISTORY).astype("int32")

        used = [{} if s is None else {(f, v): at for f, v, at in zip(s[3], s[4], s[5]) if now - at < self.idle_ms} for s in states]
        for v, name in zip(VALUES, NEW):
            value = batch[v].astype(str)
            new = np.zeros(len(batch), np.int32)
            for i in np.flatnonzero(~pd.DataFrame({"of": of, "value": value}).duplicated().to_numpy()).tolist():  # as many as senders have values
                seen, at = used[of[i]], (v, value.iat[i])
                if at not in seen:
                    seen[at] = now
                    new[i] = 1
            out[name] = new

        amount = batch["amount"].to_numpy(dtype=float)
        for k, s, seen, a, b in zip(keys, states, used, starts.tolist(), ends.tolist()):
            recent = max(a, b - HISTORY)
            times, amounts = ([], []) if s is None else (list(s[1]), list(s[2]))
            times, amounts = (times + t[recent:b].tolist())[-HISTORY:], (amounts + amount[recent:b].tolist())[-HISTORY:]
            self.senders.updateValue(k, (int(t[b - 1]), times, amounts, [f for f, _ in seen], [x for _, x in seen], list(seen.values())))
        yield out

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        now = timerValues.getCurrentProcessingTimeInMs()
        some = lambda x: [] if x is None else list(x)
        cols = ("sender_account", "sender_known", "last_us", "history_us", "history_amount", "feature", "value")
        for sender, known, last, times, amounts, feature, value in zip(*[initialState[c] for c in cols]):
            if last == NO_TIME:
                last, times, amounts = None, None, None
            self.senders.updateValue((int(sender), bool(known)), (None if last is None else int(last), [int(x) for x in some(times)], [float("nan") if x is None else float(x) for x in some(amounts)],
                                                                  some(feature), some(value), [now] * len(some(value))))

    def close(self) -> None:
        pass


def keyed(rows: DataFrame) -> DataFrame:
    """``rows`` with the sender's number, whether it is known, and its bucket."""
    return rows.withColumns({"sender_known": F.col("sender_account").isNotNull(), "sender_account": F.coalesce(F.col("sender_account").cast("long"), F.lit(0)),
                             "bucket": F.pmod(F.xxhash64(F.col("sender_account").cast("long")), F.lit(BUCKETS)).cast("int")})


def initial_state(history: DataFrame, with_times: bool = True) -> DataFrame:
    """A row for each sender with the values it used, its last time and its last events.

    The last events are the top rows of an order, so no sender's rows are gathered."""
    pairs = F.explode(F.array(*[F.struct(F.lit(v).alias("feature"), F.col(v).cast("string").alias("value")) for v in VALUES])).alias("p")
    used = history.select("sender_account", pairs).where("p.value is not null").select("sender_account", "p.*").distinct()
    used = used.groupBy("sender_account").agg(F.collect_list(F.struct("feature", "value")).alias("u"))
    used = used.select("sender_account", F.col("u.feature").alias("feature"), F.col("u.value").alias("value"))
    if not with_times:
        none = [F.lit(None).cast(t).alias(c) for c, t in (("last_us", "long"), ("history_us", "array<long>"), ("history_amount", "array<double>"))]
        return used.select("*", *none)
    place = F.row_number().over(Window.partitionBy("sender_account").orderBy(F.desc("ts"), F.desc("transaction_id")))
    last = history.select("sender_account", "ts", "transaction_id", "amount").withColumn("place", place).where(F.col("place") <= HISTORY)
    last = last.groupBy("sender_account").agg(F.max(F.unix_micros("ts")).alias("last_us"), F.array_sort(F.collect_list(F.struct(F.unix_micros("ts").alias("t"), "transaction_id", "amount"))).alias("h"))
    return used.join(last, "sender_account").select("sender_account", "feature", "value", "last_us", F.col("h.t").alias("history_us"), F.col("h.amount").alias("history_amount"))


def sender_features(events: DataFrame, history: DataFrame | None = None, idle_ms: int = IDLE_MS) -> DataFrame:
    """The stream with its per-sender columns; ``history`` is a table as ``initial_state`` makes it.  To be run with the
    settings in ``STATE_CONF``."""
    no_time = F.lit(NO_TIME)
    begin = None if history is None else keyed(history).withColumn("last_us", F.coalesce("last_us", no_time)).groupBy("bucket")
    rows = keyed(events.select(*INPUT)).withColumns({"id_known": F.col("transaction_id").isNotNull(), "transaction_id": F.coalesce(F.col("transaction_id").cast("long"), F.lit(0)),
                                                     "ts_us": F.coalesce(F.unix_micros("ts"), no_time)})
    schema = StructType.fromDDL(CARRIED_SCHEMA)
    rows = rows.select("bucket", *[F.col(f.name).cast(f.dataType) for f in schema], F.col("time_since_last_transaction").cast("double"))
    made = rows.groupBy("bucket").transformWithStateInPandas(SenderFeatures(idle_ms), OUT_SCHEMA, "Append", "ProcessingTime", begin)
    made = made.withColumns({"transaction_id": F.when(F.col("id_known"), F.col("transaction_id")), "sender_account": F.when(F.col("sender_known"), F.col("sender_account")),
                             "ts": F.when(F.col("ts_us") != no_time, F.timestamp_micros("ts_us"))})
    return made.select(*OUT, F.nanvl("stream_tslt", F.lit(None).cast("double")).alias("stream_tslt"), "tslt_is_negative", "history_len", *NEW)


def replay(events: DataFrame, batches: int | None = None, late: str | None = None, closing: bool = False) -> DataFrame:
    """A stream that gives a table's rows in the order of time, a file of at most about ``BATCH_ROWS`` rows for each micro-batch
    (``batches``: so many files).

    Rows that fulfil ``late`` come in files behind all others, whatever their time.  With ``closing`` a last file holds one event, all
    null but its time, that moves the watermark past all windows.  The files are ranges of the order in the shared folder;
    their times are set in their order, since the file source takes the oldest first."""
    spark = events.sparkSession
    path = scratch_path(spark, "stream-replay")
    batches = batches or max(4, -(-events.count() // BATCH_ROWS))
    delayed = F.lit(False) if late is None else F.coalesce(F.expr(late), F.lit(False))

    def one(ts: str | None) -> DataFrame:
        return spark.range(1).select(*[F.lit(ts if f.name == "ts" else None).cast(f.dataType).alias(f.name) for f in events.schema])

    parts = [(events.where(~delayed), batches)]
    if late:
        # a batch drops what lies behind the watermark of the batch before, so one without a time comes in between
        parts += [(one(None), 1), (events.where(delayed), max(1, batches // 4))]
    if closing:
        parts.append((one(FAR), 1))
    for i, (rows, n) in enumerate(parts):
        rows.repartitionByRange(n, "ts", "transaction_id").sortWithinPartitions("ts", "transaction_id").write.parquet(f"{path}/part={i}")
    set_file_times(spark, path)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/part=*")


def set_file_times(spark: SparkSession, path: str) -> None:
    """Give the Parquet files below a folder times a second apart, in the order of their folders and names."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    files = [f.getPath() for part in fs.listStatus(folder) for f in fs.listStatus(part.getPath()) if f.getPath().getName().endswith(".parquet")]
    files.sort(key=lambda p: (p.getParent().getName(), p.getName()))
    newest = spark._jvm.java.lang.System.currentTimeMillis()
    for i, f in enumerate(files):
        fs.setTimes(f, newest - 1000 * (len(files) - i), -1)
