"""Exact running medians of keys of any size.

Rows lie in ranges of (key, time) as ``past.placed`` stores them.  Of a key that covers several ranges, a range with m
values needs the earlier ranges' values only as far as the median can move: by m ranks at most.  These are
found without sorting any range's whole past: the key's values are stored in blocks by value, a table of counts
by (block, range) gives the ranks that every block has among the values before a range, and only the blocks that hold ranks near
the median are read.  So a range is handed about as many values as it has itself, and a task holds one range.

Within a range the median is followed backwards in time: all values are sorted and linked once, and as values are
taken out the median moves by a step at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .past import placed, unplaced


def running_medians(own: np.ndarray, carry: np.ndarray, base: int, before: int) -> np.ndarray:
    """The median of all values before each of ``own`` (NaN: no value), with ``before`` earlier values of which ``carry`` (sorted) holds
    those from rank ``base`` on as far as they are needed.  NaN where there are no values."""
    out = np.full(len(own), np.nan)
    real = np.flatnonzero(~np.isnan(own))
    values = np.concatenate([carry, own[real]])
    order = np.argsort(values, kind="stable")
    place = np.empty(len(values), np.int64)
    place[order] = np.arange(len(values))
    value = values[order].tolist()
    n = len(value)
    after, prior = list(range(1, n + 1)), list(range(-1, n - 1))
    mine = np.full(len(own), -1, np.int64)
    mine[real] = place[len(carry):]
    total = before + len(real)
    at, rank = 0, base  # the first value's rank among all
    for i, p in zip(range(len(own) - 1, -1, -1), mine[::-1].tolist()):
        if p >= 0:
            total -= 1
            a, b = prior[p], after[p]
            if a >= 0:
                after[a] = b
            if b < n:
                prior[b] = a
            if p < at:
                rank -= 1
            elif p == at:
                if b < n:
                    at = b
                else:
                    at, rank = a, rank - 1
        if total:
            low = (total - 1) // 2
            while rank < low:
                at, rank = after[at], rank + 1
            while rank > low:
                at, rank = prior[at], rank - 1
            out[i] = value[at] if total % 2 else (value[at] + value[after[at]]) / 2
    return out


def values_near(d: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, _c, _v, _n, _base, _before``: for every range of a key that covers several, the earlier values (and how often each
    occurs) that the medians of the range's rows may meet."""
    k = F.to_json(F.struct(*keys)).alias("_k")  # null keys join too
    rows = d.where("_span").select(*keys, k, "_c", "_v")
    n = int(d.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    counted = rows.where("_v is not null").groupBy(*keys, "_k", "_c", "_v").agg(F.count(F.lit(1)).alias("_n"))
    counted = stored(counted.repartitionByRange(n, "_k", "_v", "_c").withColumn("_b", F.spark_partition_id()), "median-values")
    whole = Window.partitionBy("_k").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    ranges = rows.groupBy("_k", "_c").agg(F.count("_v").alias("_m")).withColumn("_before", F.coalesce(F.sum("_m").over(whole), F.lit(0)))
    cells = counted.groupBy("_k", "_b", "_c").agg(F.sum("_n").alias("_n"))
    # blocks x ranges of one key: at most the square of the number of partitions
    grid = cells.select("_k", "_b").distinct().join(ranges, "_k").join(cells, ["_k", "_b", "_c"], "left")
    earlier = F.coalesce(F.sum("_n").over(Window.partitionBy("_k", "_b").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    grid = grid.withColumn("_e", earlier)
    start = F.coalesce(F.sum("_e").over(Window.partitionBy("_k", "_c").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    low, high = F.floor((F.col("_before") - 1) / 2) - F.col("_m"), F.floor(F.col("_before") / 2) + F.col("_m")
    near = grid.withColumn("_start", start).where((F.col("_e") > 0) & (F.col("_start") + F.col("_e") > low) & (F.col("_start") <= high))
    near = near.withColumn("_base", F.min("_start").over(Window.partitionBy("_k", "_c"))).select("_k", "_b", F.col("_c").alias("_at"), "_base", "_before")
    met = counted.join(near, ["_k", "_b"]).where(F.col("_c") < F.col("_at"))
    return met.groupBy(*keys, "_at", "_v", "_base", "_before").agg(F.sum("_n").alias("_n")).withColumnRenamed("_at", "_c")


def running_median(df: DataFrame, keys: list[str], value: str, out: str, ts: str = "ts", order: list[str] = ("transaction_id",), chunks: int | None = None) -> DataFrame:
    """``df`` with ``out``, the median of the key's values before each row in the order of (ts, ``order``); null values don't
    count, and without values before it is null."""
    keys, order = list(keys), list(order)
    ours = "_c" not in df.columns
    d = placed(df, keys, ts, chunks, order) if ours else df
    kept = d.columns
    d = d.withColumn("_v", F.col(value).cast("double"))
    none = {c: F.lit(None).cast("long") for c in ("_n", "_base", "_before")}
    both = d.withColumns(none).withColumn("_own", F.lit(1)).unionByName(values_near(d, keys).withColumn("_own", F.lit(0)), allowMissingColumns=True)
    both = both.withColumn("_k", F.to_json(F.struct(*keys)))
    # a range's rows, and before them what it is handed, in one task
    both = both.repartition("_c").sortWithinPartitions("_c", "_k", "_own", F.when(F.col("_own") == 0, F.col("_v")), "_t", *order)

    def medians(t: pa.Table) -> pa.RecordBatch:
        b = t.combine_chunks().to_batches()[0]
        own, v = b.column("_own").to_numpy(), b.column("_v").to_numpy(zero_copy_only=False)
        cuts = edges(b)
        got = np.full(len(own), np.nan)
        for lo, hi in zip(cuts, [*cuts[1:], len(own)]):
            mid = lo + int(np.searchsorted(own[lo:hi], 1))
            carry, base, before = np.zeros(0), 0, 0
            if mid > lo:
                carry = np.repeat(v[lo:mid], b.column("_n").slice(lo, mid - lo).to_numpy())
                base, before = b.column("_base")[lo].as_py(), b.column("_before")[lo].as_py()
            got[mid:hi] = running_medians(v[mid:hi], carry, base, before)
        rows = np.flatnonzero(own == 1)
        b = b.take(pa.array(rows))
        return pa.record_batch([*[b.column(c) for c in kept], pa.array(got[rows], from_pandas=True)], names=[*kept, out])

    def edges(b: pa.RecordBatch) -> list[int]:
        """Where a new (range, key) starts."""
        key = b.column("_k").dictionary_encode().indices.to_numpy(zero_copy_only=False)
        c = b.column("_c").to_numpy()
        return [0, *(np.flatnonzero((key[1:] != key[:-1]) | (c[1:] != c[:-1])) + 1).tolist()]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            lo = edges(b)[-1]
            first = held[-1].slice(held[-1].num_rows - 1) if held else None
            goes_on = first is not None and first.column("_k")[0] == b.column("_k")[0] and first.column("_c")[0] == b.column("_c")[0]
            if lo == 0 and (goes_on or not held):
                held.append(b)
                continue
            done = pa.Table.from_batches([*held, b.slice(0, lo)])
            if done.num_rows:
                yield medians(done)
            held = [b.slice(lo)]
        if held:
            yield medians(pa.Table.from_batches(held))

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in d.select(*kept).schema]
    result = both.mapInArrow(task, ", ".join([*fields, f"`{out}` double"]))
    return unplaced(result) if ours else result
