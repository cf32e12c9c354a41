"""Structured Streaming: per-sender stateful features, scoring, routing.

The given events table is read as a file stream.  Per-sender features come from keyed state (``sender_state``), in
micro-batches of bounded size; the batch twins are the positional window features.

Every sink writes a folder per epoch and overwrites it, so a batch that is run again
after a failure leaves its rows once.  The query checkpoints into the session's
shared checkpoint folder, so a restarted job resumes with its state.

Event-time windows are written in append mode when the watermark passes them, which happens while the stream runs; rows that
come behind the watermark are dropped and counted.  A finite replay ends with one closing event far
behind the watermark, so the last windows are written too; a running stream needs none.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bands as BD
from ..functions.features import feat_time_ext
from ..session import scratch_path
from ..sources.tables import read_table
from .sender_state import BATCH_ROWS, INPUT, STATE_CONF, VALUES, initial_state, replay, sender_features

#: Numeric inputs of the stream's model, in order.
MODEL_COLUMNS = ["amount", "log_amount", "spending_deviation_score", "velocity_score", "geo_anomaly_score", "hour", "day_of_week", "month", "is_weekend",
                 "is_night", "tslt_abs", "tslt_is_negative", *[f"is_new_{v}_for_sender" for v in VALUES]]
MISSING_TSLT_SCORE = 1e-6
#: Rows that a task of the sliding windows takes before they are copied into their 24 windows.
SLIDING_ROWS = 62_500
#: Partitions of the windows' state at most: batches have bounded rows, and each partition costs a commit in every batch.
STATE_PARTS = 32


def event_stream(spark: SparkSession, sf_dir: str, files_per_trigger: int | None = None) -> DataFrame:
    """The events table as a stream of its files."""
    schema = read_table(spark, sf_dir, "events").schema
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    # a pattern, since the file source takes a plain path for a folder and the table may be a file
    return reader.parquet(f"{sf_dir.rstrip('/')}/events.parque[t]")


def stateful_features(events: DataFrame, history: DataFrame | None = None, batches: int | None = None) -> DataFrame:
    """The table's events as a stream with their per-sender columns and the base features; values that senders used
    in ``history``, a table of earlier events, are not new."""
    before = None if history is None else initial_state(history, with_times=False)
    out = sender_features(replay(events.select(*INPUT), batches), before)
    return feat_time_ext(out, "ts").withColumns({"log_amount": F.log1p("amount"), "tslt_abs": F.coalesce(F.abs("stream_tslt"), F.lit(0.0))})


def model_score(features: DataFrame, model: PipelineModel) -> DataFrame:
    """``features`` with ``risk_score`` from a fitted pipeline; without a time since the last transaction the
    score is the fixed low one, as in batch scoring."""
    filled = features.fillna(0.0, MODEL_COLUMNS)
    p = vector_to_array("probability")[1]
    scored = model.transform(filled).withColumn("risk_score", F.when(F.col("stream_tslt").isNull(), F.lit(MISSING_TSLT_SCORE)).otherwise(p))
    return scored.drop("features", "rawPrediction", "probability", "prediction")


def routed(df: DataFrame, score: str | Column = "risk_score") -> DataFrame:
    c = F.col(score) if isinstance(score, str) else score
    return df.withColumns({"route": BD.band(c, BD.ROUTES), "risk_band": BD.band(c, BD.BANDS_STREAM)})


@contextmanager
def configured(spark: SparkSession, conf: dict | None):
    """Settings of the session for the time of a query."""
    before = {k: spark.conf.get(k, None) for k in conf or {}}
    try:
        for k, v in (conf or {}).items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def run_to_end(stream: DataFrame, name: str, sinks: dict[str, Callable[[DataFrame], DataFrame]], checkpoint: str | None = None, out: dict[str, str] | None = None, conf: dict | None = None):
    """Run over all that is there now; the written tables and the query's progress reports.

    A batch is kept while its sinks are written, and each sink overwrites the batch's own folder."""
    spark = stream.sparkSession
    out = out or {k: scratch_path(spark, f"stream-{name}-{k}") for k in sinks}

    def write(batch: DataFrame, epoch: int) -> None:
        batch.persist()
        try:
            for k, part in sinks.items():
                part(batch).write.mode("overwrite").parquet(f"{out[k]}/epoch={epoch}")
        finally:
            batch.unpersist()

    with configured(spark, conf):
        q = (stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint or scratch_path(spark, f"stream-{name}-ckpt"))
             .trigger(availableNow=True).start())
        q.awaitTermination()
    return {k: spark.read.parquet(v) for k, v in out.items()}, q.recentProgress


def decisions(stream: DataFrame, score: str = "risk_score", conf: dict | None = None):
    """Routing with its two sinks, all decisions and the review queue, and the progress reports."""
    cols = ["transaction_id", F.col(score).alias("risk_score"), "risk_band"]
    return run_to_end(routed(stream, score), "decisions", {
        "decisions": lambda b: b.select(*cols, "route"),
        "queue": lambda b: b.where("route = 'REVIEW_QUEUED'").select(*cols)}, conf=conf)


def batch_metrics(decided: DataFrame, progress: list) -> DataFrame:
    """Counters for each epoch with its latency per event (ms) and throughput (events a second)."""
    spark = decided.sparkSession
    times = [(int(p["batchId"]), float(p["batchDuration"]), float(p["numInputRows"])) for p in progress]
    t = spark.createDataFrame(times, "epoch int, ms double, rows double")
    g = decided.groupBy("epoch").agg(F.count(F.lit(1)).alias("processed"), *[F.count_if(F.col("route") == r).alias(n) for r, n in (("AUTO_BLOCKED", "blocked"), ("REVIEW_QUEUED", "queued"), ("PASSED", "passed"))])
    return g.join(F.broadcast(t), "epoch").select("epoch", "processed", "blocked", "queued", "passed", (F.col("ms") / F.greatest("rows", F.lit(1.0))).alias("latency_ms"),
                                                  (F.col("rows") * 1000 / F.greatest("ms", F.lit(1.0))).alias("events_per_second"))


def windowed(src: DataFrame, kind: str) -> DataFrame:
    """The aggregation of ``stream_windows`` over a stream of at most ``BATCH_ROWS`` rows a batch."""
    n = F.count(F.lit(1)).alias("n")
    if kind == "tumbling":
        return src.groupBy(F.window("ts", "1 hour")).agg(n, F.sum("is_fraud").alias("frauds"))
    if kind == "sliding":
        # a file is one task otherwise, which would hold a group for nearly every row and window; a sender's rows share theirs
        return src.repartition(-(-BATCH_ROWS // SLIDING_ROWS), "sender_account").groupBy("sender_account", F.window("ts", "24 hours", "1 hour")).agg(n, F.sum("amount").alias("amount_sum"))
    if kind == "session":
        return src.groupBy("sender_account", F.session_window("ts", "30 minutes")).agg(n)
    if kind == "dedup":
        return src.dropDuplicatesWithinWatermark(["transaction_id"]).where("transaction_id is not null")
    raise ValueError(kind)


def stream_windows(events: DataFrame, kind: str, batches: int | None = None, late: str | None = None) -> tuple[DataFrame, list]:
    """Event-time twins: tumbling 1 h rate, sliding 24 h / 1 h per sender, 30-minute sessions per sender, de-duplication of
    transaction ids within the watermark of 2 h.

    The table's rows come in several batches in the order of time, those that fulfil ``late`` behind all others.  Gives the written
    result, with the batch that wrote each row, and the progress reports, which count the dropped rows."""
    src = replay(events.select("transaction_id", "ts", "sender_account", "amount", "is_fraud"), batches, late, closing=True).withWatermark("ts", "2 hours")
    agg = windowed(src, kind)
    # an empty batch after the last file writes the windows that the closing event has passed
    conf = {"spark.sql.streaming.noDataMicroBatches.enabled": "true"}
    if kind != "sliding":  # its groups are many times the rows
        parts = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
        conf["spark.sql.shuffle.partitions"] = str(min(parts, STATE_PARTS))
    tables, progress = run_to_end(agg, kind, {"rows": lambda b: b}, conf=conf)
    return tables["rows"], progress


def dropped(progress: list) -> int:
    """Rows (of aggregations: groups of a task's rows) that came behind the watermark."""
    return sum(op["numRowsDroppedByWatermark"] for p in progress for op in p["stateOperators"])
