"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """``(node, root)`` for every node of ``links``; the root is the smallest node reachable.

    Alternating large-star and small-star steps: every node's neighbours are linked to the smallest of
    them until only stars remain, in a number of rounds that grows with the logarithm of the longest path.
    Minima are pre-aggregated before the shuffle and written to the shared folder, so the joins that follow
    read two plain exchanges and adaptive execution can split a node with very many links.  Links from a node
    to itself and null ends are ignored; an empty table gives no rows."""
    pairs = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    now = materialise(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    state = _state(now)
    for _ in range(rounds):
        if not state[0]:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialise(both.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("w")), "links-min")
        large = materialise(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("w").alias("v")).distinct(), "links-large")
        least = materialise(large.groupBy("u").agg(F.min("v").alias("w")), "links-min")
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("w").alias("v")), F.struct("u", F.col("w").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        now = materialise(small, "links")
        before, state = state, _state(now)
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = now.select("v").distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select(F.col("v").alias("node"), F.col("v").alias("root")))


def _state(links: DataFrame) -> tuple:
    """Size and an order-free checksum of the links."""
    h = F.xxhash64("u", "v")
    return tuple(links.agg(F.count("*"), F.sum(h.bitwiseAND(0xFFFFFFFF)), F.sum(F.shiftrightunsigned(h, 32))).first())
