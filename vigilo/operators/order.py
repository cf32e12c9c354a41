"""Global order without a single-partition sort.

``global_index`` is the distributed zip-with-index: a range-partitioned sort
(Spark samples the full sort key, so even a timestamp holding a third of all
rows is split across tasks because the tie-break keeps keys unique), the
row position inside each sorted partition from
``monotonically_increasing_id`` (its low 33 bits), and per-partition
offsets from a table with one row per partition (bounded by the partition
count, so broadcasting it is safe).

Spark's range sampler is seeded by RDD id, so two evaluations of the same
sort may cut partitions differently.  The sorted, position-tagged rows are
therefore materialised once with a reliable ``checkpoint()`` into the
session's shared checkpoint folder; counts and positions are then read from
the same files, and a lost executor re-reads them instead of re-sampling.
Callers should project the narrow columns they need first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_POS_MASK = (1 << 33) - 1


def _n_parts(df: DataFrame, n: int | None) -> int:
    if n:
        return n
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def global_index(df: DataFrame, order: list[str | Column], out: str = "global_index",
                 total: str | None = "_total", num_partitions: int | None = None) -> DataFrame:
    """0-based position of each row in the order ``order`` (must be unique),
    plus the table's row count in ``total``."""
    n = _n_parts(df, num_partitions)
    from ..session import ensure_checkpoint_dir
    ensure_checkpoint_dir(df.sparkSession)
    s = (df.repartitionByRange(n, *order).sortWithinPartitions(*order)
           .withColumn("_pid", F.spark_partition_id())
           .withColumn("_pos", F.monotonically_increasing_id().bitwiseAND(F.lit(_POS_MASK)))
           .checkpoint(eager=True))
    counts = s.groupBy("_pid").agg(F.count(F.lit(1)).alias("_cnt"))
    w = Window.orderBy("_pid")  # over one row per partition only
    offs = counts.select(
        "_pid",
        F.coalesce(F.sum("_cnt").over(w.rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("_off"),
        F.sum("_cnt").over(Window.partitionBy()).alias("_tot"))
    j = s.join(F.broadcast(offs), "_pid")
    j = j.withColumn(out, F.col("_off") + F.col("_pos"))
    if total:
        j = j.withColumn(total, F.col("_tot"))
    return j.drop("_pid", "_pos", "_off", "_tot")


def split_flag(idx: Column, total: Column, frac: float = 0.8) -> Column:
    """1 for the first ``floor(total * frac)`` rows (the train prefix)."""
    return (idx < F.floor(total * F.lit(frac))).cast("int")


def time_blocks(idx: Column, total: Column, k: int = 4) -> Column:
    """``k`` contiguous equal chunks; the remainder goes to the LAST block
    (unlike ``ntile``, which hands it to the first ones)."""
    size = F.greatest(F.floor(total / F.lit(k)), F.lit(1))
    return F.least(F.floor(idx / size), F.lit(k - 1)).cast("int")


def trailing(idx: Column, total: Column, n: int) -> Column:
    """Last ``n`` rows in time order."""
    return idx >= total - F.lit(n)


def head(df: DataFrame, order: list[str | Column], n: int) -> DataFrame:
    """Deterministic first ``n`` rows (TakeOrderedAndProject: per-partition
    heaps of size n, no full sort)."""
    return df.orderBy(*order).limit(n)


def lehmer_hash(col: Column | str, seed: int = 42) -> Column:
    """Seeded arithmetic hash of a numeric id (two MINSTD steps: one keeps the
    order of ids below 44,488), reproducible in any SQL engine; intermediate
    values stay below 2^47."""
    c = F.col(col) if isinstance(col, str) else col
    m = F.lit(2147483647)
    once = (F.pmod(c, m) * F.lit(48271) + F.lit(seed)) % m
    return (once * F.lit(48271) + F.lit(seed)) % m


SALTS = 64


def sample_stratified(df: DataFrame, label: str, n_per_label: int, id_col: str,
                      seed: int = 42) -> DataFrame:
    """Exactly ``n_per_label`` rows per label value in seeded hash order.

    Rows are ranked in ``SALTS`` parts of a label first, so the part that ranks
    the winners of a label gets at most n × SALTS rows, whatever the label's
    share of the table."""
    h = lehmer_hash(id_col, seed)
    part = Window.partitionBy(label, "_salt").orderBy(h, F.col(id_col))
    w = Window.partitionBy(label).orderBy(h, F.col(id_col))
    d = df.withColumn("_salt", F.pmod(F.xxhash64(id_col), F.lit(SALTS)))
    d = d.withColumn("_rn", F.row_number().over(part)).where(F.col("_rn") <= n_per_label)
    return d.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n_per_label).drop("_rn", "_salt")


def sample_n(df: DataFrame, n: int, id_col: str, seed: int = 42) -> DataFrame:
    return df.orderBy(lehmer_hash(id_col, seed), F.col(id_col)).limit(n)


def shuffle_labels(df: DataFrame, label: str, order: list[str], id_col: str,
                   seed: int = 7) -> DataFrame:
    """Seeded label permutation: row i (time order) receives the label of
    the i-th row in hash order — two distributed indexes and one equi-join
    on the index, so nothing gathers on one task."""
    rows = global_index(df.drop(label), order, out="_i", total=None)
    labs = global_index(df.select(F.col(id_col).alias("_lid"), F.col(label),
                                  lehmer_hash(id_col, seed).alias("_h")),
                        ["_h", "_lid"], out="_i", total=None).select("_i", label)
    return rows.join(labs, "_i").drop("_i")
