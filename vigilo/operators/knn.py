"""Exact k nearest corpus rows (Euclidean), pruned by pivots.

Every corpus row belongs to its nearest pivot's cell and, by its distance r to
that pivot, to a ring of the cell.  A ring whose distances span [lo, hi] holds
nothing nearer to a query at distance d from the pivot than
max(0, d - hi, lo - d) (triangle inequality), so it is passed over once this
exceeds the query's k-th distance so far.

* A corpus of at most ``broadcast_bytes`` is sent whole, in the order of its
  rings; each task takes its queries by nearest pivot, scores the nearest rings
  and then at once all that their k-th distances leave.  A task has all rows of
  its queries, so they are ranked there, unless a query's id comes twice.
* A larger one is written by blocks, parts of a ring of about ``block_rows``
  rows.  A first pass over the rings next to a query gives a bound of its k-th
  distance, a second one sends it to those blocks alone that the bound can't
  exclude.  Blocks that many queries want are met in chunks of queries.

Pivots come from at most ``SAMPLE`` corpus rows, those with the smallest hash
of their id; every row is in the index, and the answer is exact whichever
pivots are drawn.  Rows whose vector is null or holds a null or non-finite
component take no part: such a corpus row is never found, such a query gets no
rows.  Equal distances (to nine decimals) rank by id.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .joins import _topk_rows

SAMPLE = 20_000
PIVOTS = 256
RINGS = 16
#: Pivots of a corpus that is sent whole: where most rings must be scored, bounds have to cost less than scores.
LOCAL_PIVOTS = 64
#: Queries that a task searches at once.
TOGETHER = 50_000
FOUND = "query_id long, match_id long, score double, n_scored long"


def usable(vec: Column) -> Column:
    """Is the vector there, with finite components only?"""
    return vec.isNotNull() & F.forall(vec, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))


def _vectors(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.float64).reshape(len(column), -1)


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Rows of the sample, each the farthest one from those chosen before; fewer where rows coincide."""
    if not len(sample):
        return sample
    chosen, far = [0], np.full(len(sample), np.inf)
    while len(chosen) < count:
        far = np.minimum(far, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
        if far.max() <= 0:
            break
        chosen.append(int(far.argmax()))
    return sample[chosen]


def distances(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.stack([((rows - p) ** 2).sum(axis=1) for p in pivots], axis=1))


def lower_bounds(to_pivots: np.ndarray, cell: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The least distance from each query to any row of each ring; a little less, for rounding."""
    d = to_pivots[:, cell]
    return np.maximum(0, np.maximum(d - hi, lo - d)) - 1e-9 - 1e-12 * (d + hi)


def local_index(ids: np.ndarray, rows: np.ndarray) -> dict:
    """Index of a corpus that one task holds: rows sorted by cell and distance, cut into small rings."""
    pivots = choose_pivots(rows[:SAMPLE], min(LOCAL_PIVOTS, max(1, len(rows) // 16)))
    cell, r = np.zeros(len(rows), np.int64), np.zeros(len(rows))
    for s in range(0, len(rows), 100_000):
        d = distances(rows[s:s + 100_000], pivots)
        cell[s:s + 100_000], r[s:s + 100_000] = d.argmin(axis=1), d.min(axis=1)
    order = np.lexsort((ids, r, cell))
    ids, rows, cell, r = ids[order], rows[order], cell[order], r[order]
    size = max(16, len(rows) // (4 * len(pivots)))
    place = np.arange(len(rows)) - np.searchsorted(cell, cell)
    first = np.nonzero(place % size == 0)[0]
    last = np.append(first[1:], len(rows))
    return {"ids": ids, "rows": rows, "pivots": pivots, "first": first, "last": last, "cell": cell[first], "lo": r[first], "hi": r[last - 1]}


def local_search(qids: np.ndarray, q: np.ndarray, ix: dict, k: int, exclude_self: bool) -> pd.DataFrame:
    """The k nearest rows of each query with their ranks (from 1) and ``n_scored``, the rows scored for the query."""
    to_pivots = distances(q, ix["pivots"])
    home, out = to_pivots.argmin(axis=1), []
    for h in np.unique(home):
        mine = np.nonzero(home == h)[0]
        least = lower_bounds(to_pivots[mine], ix["cell"], ix["lo"], ix["hi"])
        score, match = np.full((len(mine), k), np.inf), np.full((len(mine), k), -1, np.int64)
        scored, rings, size = np.zeros(len(mine), np.int64), np.lexsort((to_pivots[mine][:, ix["cell"]].mean(axis=0), least.min(axis=0))), max(16 * k, len(ix["ids"]) // 32)
        while len(rings := rings[(least[:, rings] <= score[:, k - 1:]).any(axis=0)]):
            # the nearest rings, then all that are left, for those queries that need any of them
            held = (ix["last"] - ix["first"])[rings]
            now, rings, size = rings[held.cumsum() - held < size], rings[held.cumsum() - held >= size], np.inf
            near = np.nonzero((least[:, now] <= score[:, k - 1:]).any(axis=1))[0]
            take = np.concatenate([np.arange(ix["first"][i], ix["last"][i]) for i in now])
            ids, rows = ix["ids"][take], ix["rows"][take]
            got = _without_self(near, qids[mine[near]], q[mine[near]], ids, rows, k) if exclude_self else _topk_rows(near, q[mine[near]], ids, rows, k, "l2", False)
            scored[near] += len(take)
            row = np.concatenate([got["query_id"].to_numpy(np.int64), np.repeat(near, k)])
            sc = np.concatenate([got["score"].to_numpy(), score[near].ravel()])
            ident = np.concatenate([got["match_id"].to_numpy(np.int64), match[near].ravel()])
            best = np.lexsort((ident, np.round(sc * 1e9), row))
            best = best[np.arange(len(best)) - np.searchsorted(row[best], row[best]) < k]
            score[near], match[near] = sc[best].reshape(-1, k), ident[best].reshape(-1, k)
        at, rank = np.nonzero(np.isfinite(score))
        out.append(pd.DataFrame({"query_id": qids[mine[at]], "match_id": match[at, rank], "score": score[at, rank],
                                 "n_scored": scored[at], "rank": (rank + 1).astype(np.int32)}))
    return pd.concat(out, ignore_index=True)


def _without_self(place: np.ndarray, qids: np.ndarray, q: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> pd.DataFrame:
    """As ``_topk_rows``, keyed by place, but no query finds its own id."""
    got = _topk_rows(place, q, ids, rows, k + 1, "l2", False)
    own = dict(zip(place.tolist(), qids.tolist(), strict=True))
    return got[got["match_id"].to_numpy() != got["query_id"].map(own).to_numpy()]


def _batches(batches, size: int):
    held, rows = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            rows += b.num_rows
        if rows >= size:
            yield pa.Table.from_batches(held).combine_chunks()
            held, rows = [], 0
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def _within_tasks(qd: DataFrame, cd: DataFrame, k: int, exclude_self: bool) -> DataFrame:
    """``FOUND`` and the rank among what the query's row found."""
    pc = cd.toPandas()  # within broadcast_bytes, checked by the caller
    index = local_index(pc["match_id"].to_numpy(np.int64), _vectors(pc["cv"]))
    sent = qd.sparkSession.sparkContext.broadcast(index)

    def search(batches):
        for t in _batches(batches, TOGETHER):
            q = t.column("qv").chunk(0).flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)
            got = local_search(t.column("query_id").to_pandas().to_numpy(np.int64), q, sent.value, k, exclude_self)
            yield from pa.Table.from_pandas(got, preserve_index=False).to_batches()

    return qd.mapInArrow(search, f"{FOUND}, rank int")


def _by_blocks(qd: DataFrame, cd: DataFrame, k: int, exclude_self: bool, block_rows: int, chunk_rows: int) -> DataFrame:
    spark = qd.sparkSession
    sample = cd.orderBy(F.xxhash64("match_id"), "match_id").limit(SAMPLE).toPandas()
    pivots = spark.sparkContext.broadcast(choose_pivots(_vectors(sample["cv"]), PIVOTS))

    def to_cells(frames):
        for f in frames:
            if len(f):
                d = distances(_vectors(f["cv"]), pivots.value)
                yield f.assign(cell=d.argmin(axis=1), r=d.min(axis=1))

    placed = stored(cd.mapInPandas(to_cells, "match_id long, cv array<double>, cell long, r double"), "knn-cells")
    widest = placed.groupBy("cell").agg(F.max("r").alias("widest"))  # at most PIVOTS rows
    ring = F.when(F.col("widest") > 0, F.least(F.lit(RINGS - 1), F.floor(F.col("r") * RINGS / F.col("widest")))).otherwise(0).cast("long")
    placed = placed.join(F.broadcast(widest), "cell").withColumn("ring", F.col("cell") * RINGS + ring).drop("widest")
    # at most PIVOTS x RINGS rows
    rings = placed.groupBy("ring").agg(F.min("r").alias("lo"), F.max("r").alias("hi"), F.count(F.lit(1)).alias("n")).orderBy("ring").toPandas()
    rings["parts"] = -(-rings["n"] // block_rows)
    rings["first"] = rings["parts"].cumsum() - rings["parts"]
    known = spark.createDataFrame(rings[["ring", "parts", "first"]], "ring long, parts long, first long")
    blocks = placed.join(F.broadcast(known), "ring").select(
        (F.col("first") + F.pmod(F.xxhash64("match_id"), F.col("parts"))).alias("block"), "match_id", "cv")
    blocks = stored(blocks, "knn-blocks")
    table = spark.sparkContext.broadcast({c: rings[c].to_numpy() for c in rings.columns})
    sent = "query_id long, qv array<double>, block long"

    def first_pass(frames):
        """Each query with a block of each of the nearest rings that together hold more than k rows, if parts are even."""
        t = table.value
        for f in frames:
            if not len(f):
                continue
            to_pivots = distances(_vectors(f["qv"]), pivots.value)
            order = np.argsort(lower_bounds(to_pivots, t["ring"] // RINGS, t["lo"], t["hi"]) + 1e-6 * to_pivots[:, t["ring"] // RINGS], axis=1)
            held = (t["n"] // t["parts"])[order]
            row, at = np.nonzero(held.cumsum(axis=1) - held <= k)
            yield pd.DataFrame({"query_id": f["query_id"].to_numpy()[row], "qv": f["qv"].to_numpy()[row], "block": t["first"][order[row, at]]})

    def second_pass(frames):
        """Each query with every block whose bound doesn't exceed the query's k-th distance of the first pass."""
        t = table.value
        for f in frames:
            step = max(1, 1_000_000 // int(t["parts"].sum()))  # at most a million rows at once, however many blocks
            for s in range(0, len(f), step):
                g = f.iloc[s:s + step]
                least = lower_bounds(distances(_vectors(g["qv"]), pivots.value), t["ring"] // RINGS, t["lo"], t["hi"])
                row, at = np.nonzero(least <= g["reach"].to_numpy()[:, None])
                parts = t["parts"][at]
                block = np.repeat(t["first"][at], parts) + np.arange(parts.sum()) - np.repeat(parts.cumsum() - parts, parts)
                row = np.repeat(row, parts)
                yield pd.DataFrame({"query_id": g["query_id"].to_numpy()[row], "qv": g["qv"].to_numpy()[row], "block": block})

    def meet(wanted: DataFrame, name: str) -> DataFrame:
        wanted = stored(wanted, name)
        chunks = wanted.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / chunk_rows).alias("chunks"))
        left = wanted.join(chunks, "block").withColumn("chunk", F.pmod(F.xxhash64("query_id"), F.col("chunks")).cast("long")).drop("chunks")
        right = blocks.join(chunks, "block").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))).drop("chunks")

        def score(a, b):
            if not len(a) or not len(b):
                return pd.DataFrame({"query_id": [], "match_id": [], "score": [], "n_scored": []})
            got = _topk_rows(a["query_id"].to_numpy(np.int64), _vectors(a["qv"]), b["match_id"].to_numpy(np.int64), _vectors(b["cv"]), k, "l2", exclude_self)
            first = ~got["query_id"].duplicated()
            return got.assign(n_scored=np.where(first, len(b), 0))

        keys = ["block", "chunk"]
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(score, FOUND)

    near = meet(qd.mapInPandas(first_pass, sent), "knn-first")
    # the k-th distance; unknown (infinite) where the first blocks held fewer rows
    reach = near.groupBy("query_id").agg(F.sort_array(F.collect_list("score")).alias("s")).select(
        "query_id", F.when(F.size("s") >= k, F.get("s", F.lit(k - 1))).alias("reach"))
    qd = qd.join(reach, "query_id", "left").withColumn("reach", F.coalesce("reach", F.lit(float("inf"))))
    return meet(qd.mapInPandas(second_pass, sent), "knn-second")


def nearest(queries: DataFrame, corpus: DataFrame, k: int, q_id: str = "id", c_id: str = "id", vec: str = "vec",
            exclude_self: bool = False, broadcast_bytes: int = 64 << 20, block_rows: int = 50_000, chunk_rows: int = 20_000) -> DataFrame:
    """The k nearest corpus rows of each query: query_id, match_id, score, rank (1..k), n_scored (corpus rows whose distance
    to the query was computed).  Ids are unique on either side; an empty side gives no rows."""
    qd = queries.select(F.col(q_id).cast("long").alias("query_id"), F.col(vec).cast("array<double>").alias("qv")).where(usable(F.col("qv")))
    cd = corpus.select(F.col(c_id).cast("long").alias("match_id"), F.col(vec).cast("array<double>").alias("cv")).where(usable(F.col("cv")))
    size = cd.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("cv")).alias("dim")).first()
    if not size.n:
        found = qd.select("query_id", F.lit(0).cast("long").alias("match_id"), F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("n_scored")).limit(0)
    elif size.n * (size.dim + 6) * 8 <= broadcast_bytes:
        found = _within_tasks(qd, cd, k, exclude_self)
        if qd.groupBy("query_id").count().where("count > 1").isEmpty():
            return found.select("query_id", "match_id", "score", "rank", "n_scored")
        found = found.withColumn("n_scored", F.when(F.col("rank") == 1, F.col("n_scored")).otherwise(0)).drop("rank")
    else:
        found = _by_blocks(qd, cd, k, exclude_self, block_rows, chunk_rows)
    w = Window.partitionBy("query_id")
    ranked = found.withColumn("rank", F.row_number().over(w.orderBy(F.round(F.col("score") * F.lit(1e9)), "match_id"))).withColumn("n_scored", F.sum("n_scored").over(w))
    return ranked.where(F.col("rank") <= k).select("query_id", "match_id", "score", F.col("rank").cast("int"), "n_scored")
