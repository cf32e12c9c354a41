"""The queue's append log as a base plus deltas.

Each batch is a folder named by its number, so a replayed batch replaces itself.
Compaction folds the base and the deltas up to some batch into a new base (the
latest row of each key), committed by the artifact store's manifest together
with that batch number.  A reader takes one manifest and the whole deltas after
its number, so it sees the log either before or after a compaction; a batch that
the base holds already is not read again, replayed or not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources import artifact
from .queue import latest


def append(base: str, batch: int, rows: DataFrame) -> None:
    """Write batch ``batch`` (ascending numbers from 0, e.g. a stream's epoch)."""
    rows.write.mode("overwrite").parquet(f"{base}/deltas/batch-{batch:012d}")


def _base(spark: SparkSession, base: str) -> tuple[DataFrame | None, int]:
    try:
        a = artifact.load(spark, f"{base}/base")
    except FileNotFoundError:
        return None, -1
    return a.tables["rows"], a.values["upto"]


def _deltas(spark: SparkSession, base: str, after: int) -> dict[int, str]:
    """The whole deltas after a batch, by number."""
    found = {}
    for name in artifact.children(spark, f"{base}/deltas"):
        number = int(name.removeprefix("batch-"))
        if number > after and "_SUCCESS" in artifact.children(spark, f"{base}/deltas/{name}"):
            found[number] = f"{base}/deltas/{name}"
    return found


def log(spark: SparkSession, base: str) -> DataFrame | None:
    """Base and later deltas; null before the first batch.  The keys' latest rows are those of the whole log."""
    rows, upto = _base(spark, base)
    paths = _deltas(spark, base, upto)
    if not paths:
        return rows
    new = spark.read.parquet(*paths.values())
    return new if rows is None else rows.unionByName(new)


def compact(spark: SparkSession, base: str, key: str, version: str) -> int:
    """Fold the deltas so far into a new base and return the last batch in it.  Stops before a gap in the numbers, as a
    batch still being written must not be passed over.  One compaction runs at a time."""
    rows, upto = _base(spark, base)
    paths = _deltas(spark, base, upto)
    last = upto
    while last + 1 in paths:
        last += 1
    if last == upto:
        return upto
    new = spark.read.parquet(*[paths[i] for i in range(upto + 1, last + 1)])
    artifact.save(spark, f"{base}/base", {"rows": latest(new if rows is None else rows.unionByName(new), key, version)}, values={"upto": last})
    return last
