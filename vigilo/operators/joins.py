"""Joins: equi / membership joins left to Catalyst + AQE, and exact top-k
similarity joins that never emit all pairs.

``topk_similar`` computes, for every query row, the k nearest corpus rows
(Euclidean distance or inner product).  Work is done by numpy inside tasks:

* corpus ≤ ``broadcast_rows`` (a counted, checked bound): the corpus matrix
  is broadcast once and each query partition is scored with ``mapInPandas``
  — no shuffle of the queries at all;
* larger corpus: corpus rows are hashed into B blocks of ≈ ``block_rows``,
  queries into Q chunks; each (block, chunk) group is scored by
  ``cogroup().applyInPandas`` and keeps only its local top-k per query; a
  final rank over the ≤ k·B candidates per query gives the exact answer.

Only k candidates per (query, block) ever leave a task.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def left_equi(df: DataFrame, stats: DataFrame, key: str) -> DataFrame:
    """Left join of per-key statistics back onto the rows (AQE picks
    broadcast or sort-merge from the runtime size of ``stats``)."""
    return df.join(stats, key, "left")


def map_encode(df: DataFrame, fit: DataFrame, col: str, label: str = "is_fraud",
               out: str | None = None) -> DataFrame:
    """Category → fraud rate fitted on ``fit``; unseen categories get the
    global fitted rate (a scalar subquery)."""
    out = out or f"{col}_fraud_rate"
    rates = fit.groupBy(col).agg(F.avg(label).alias(out))
    g = fit.agg(F.avg(label)).scalar()
    return df.join(rates, col, "left").withColumn(out, F.coalesce(F.col(out), g))


def membership(df: DataFrame, history: DataFrame, keys: list[str], out: str,
               how: str = "flag") -> DataFrame:
    """Is the (keys) tuple present in ``history``?  ``flag`` adds a 0/1
    novelty column (1 = unseen); ``semi`` / ``anti`` return seen / unseen rows."""
    h = history.select(*keys).distinct()
    if how == "semi":
        return df.join(h, keys, "left_semi")
    if how == "anti":
        return df.join(h, keys, "left_anti")
    h = h.withColumn("_seen", F.lit(1))
    return df.join(h, keys, "left").withColumn(out, F.col("_seen").isNull().cast("int")).drop("_seen")


#: Size of a block of similarities in a task, in numbers.
BLOCK_CELLS = 1_000_000


def _kth_at_least(sim: np.ndarray, k: int) -> np.ndarray:
    """A bound of each row's k-th largest number from below: the k-th largest of the greatest numbers of groups of columns."""
    groups = max(64, 8 * k)
    if sim.shape[1] >= 4 * groups:
        deep = sim.shape[1] // groups
        sim = sim[:, :deep * groups].reshape(len(sim), deep, groups).max(axis=1)
    return -np.partition(-sim, k - 1, axis=1)[:, k - 1]


def _topk_rows(qids, q, cids, c, k, metric, exclude_self):
    """The k best corpus rows of each query by (score to nine decimals, id).  A matrix product finds candidates
    with a margin for its rounding error; their scores are summed anew, pair by pair."""
    found = []
    if len(cids) and len(qids):
        centre = c.mean(axis=0) if metric == "l2" else np.zeros(c.shape[1])  # a common offset would cancel digits
        cc = c - centre
        c2 = np.sum(cc * cc, axis=1)
        kk = min(k + (1 if exclude_self else 0), len(cids))
        # less the query's own square, a squared distance is a product of longer vectors
        table = np.hstack([2 * cc, -c2[:, None]]).T.copy() if metric == "l2" else cc.T
        step = max(1, BLOCK_CELLS // len(cids))
        for s in range(0, len(qids), step):
            qq, qi = q[s:s + step] - centre, qids[s:s + step]
            q2 = np.sum(qq * qq, axis=1)
            sim = (np.hstack([qq, np.ones((len(qq), 1))]) if metric == "l2" else qq) @ table
            own = q2 if metric == "l2" else np.zeros(len(qq))
            if exclude_self:
                sim[qi[:, None] == cids[None, :]] = -np.inf
            margin = 1e-14 * c.shape[1] * (q2 + c2.max(initial=0)) + 1e-18
            kth = _kth_at_least(sim, kk) - own
            least = np.where(np.isfinite(kth), kth + own - np.sqrt(np.maximum(-kth, 0)) * 4e-9 - 4e-9 - margin, -np.finfo(float).max)
            rows, cols = np.divmod(np.flatnonzero(sim >= least[:, None]), sim.shape[1])
            if metric == "l2":
                score = np.sqrt(np.sum((q[s + rows] - c[cols]) ** 2, axis=1))
            else:
                score = np.sum(q[s + rows] * c[cols], axis=1)
            key = np.round(score * 1e9) * (1 if metric == "l2" else -1)
            order = np.lexsort((cids[cols], key, rows))
            rows, cols, score = rows[order], cols[order], score[order]
            first = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
            found.append((qi[rows[first]], cids[cols[first]], score[first]))
    cat = lambda i, t: np.concatenate([f[i] for f in found]) if found else np.zeros(0, t)
    return pd.DataFrame({"query_id": cat(0, np.int64), "match_id": cat(1, np.int64), "score": cat(2, float)})


def topk_similar(queries: DataFrame, corpus: DataFrame, k: int, metric: str = "l2",
                 q_id: str = "id", q_vec: str = "vec", c_id: str = "id", c_vec: str = "vec",
                 exclude_self: bool = False, broadcast_bytes: int = 64 << 20,
                 block_rows: int = 50_000, query_chunk_rows: int = 200_000) -> DataFrame:
    """Exact k nearest corpus rows per query.  Output: query_id, match_id,
    score (distance for ``l2``, inner product for ``ip``), rank (1..k, scores
    equal to nine decimals by match id).

    Every query leaves a task with k rows for each corpus block at most, ties
    included.  A corpus of up to ``broadcast_bytes`` is sent whole; a larger one meets
    the queries in blocks."""
    spark = queries.sparkSession
    qd = queries.select(F.col(q_id).cast("long").alias("query_id"),
                        F.col(q_vec).cast("array<double>").alias("qv"))
    cd = corpus.select(F.col(c_id).cast("long").alias("match_id"),
                       F.col(c_vec).cast("array<double>").alias("cv"))
    schema = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("match_id", T.LongType()),
                           T.StructField("score", T.DoubleType())])
    size = cd.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("cv")).alias("dim")).first()
    n_corpus = size.n
    if n_corpus * (size.dim or 0) * 8 <= broadcast_bytes:
        # bounded by the check above; collected once and shipped as a broadcast
        pc = cd.toPandas()
        cids = pc["match_id"].to_numpy(np.int64)
        cmat = np.array(pc["cv"].tolist(), dtype=np.float64).reshape(len(pc), -1)
        bc = spark.sparkContext.broadcast((cids, cmat))

        def score(it):
            ids, mat = bc.value
            for pdf in it:
                if len(pdf) == 0:
                    continue
                qm = np.array(pdf["qv"].tolist(), dtype=np.float64)
                yield _topk_rows(pdf["query_id"].to_numpy(np.int64), qm, ids, mat, k, metric, exclude_self)

        cand = qd.mapInPandas(score, schema)
    else:
        B = max(1, math.ceil(n_corpus / block_rows))
        n_q = qd.count()
        Q = max(1, math.ceil(n_q / query_chunk_rows))
        # both sides' group keys must have the same type (long), or the
        # co-grouping hashes them differently
        cb = cd.withColumn("_blk", F.pmod(F.xxhash64("match_id"), F.lit(B)).cast("long")).withColumn(
            "_qc", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(Q - 1).cast("long"))))
        qb = qd.withColumn("_qc", F.pmod(F.xxhash64("query_id"), F.lit(Q)).cast("long")).withColumn(
            "_blk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(B - 1).cast("long"))))

        def score_group(qpdf, cpdf):
            if len(qpdf) == 0 or len(cpdf) == 0:
                return _topk_rows([], None, [], None, k, metric, exclude_self)
            qm = np.array(qpdf["qv"].tolist(), dtype=np.float64)
            cm = np.array(cpdf["cv"].tolist(), dtype=np.float64)
            return _topk_rows(qpdf["query_id"].to_numpy(np.int64), qm,
                              cpdf["match_id"].to_numpy(np.int64), cm, k, metric, exclude_self)

        cand = (qb.groupBy("_blk", "_qc").cogroup(cb.groupBy("_blk", "_qc"))
                  .applyInPandas(score_group, schema))
    # equal scores up to float noise rank by match id (deterministic ties)
    key = F.round(F.col("score") * F.lit(1e9)) / F.lit(1e9)
    w = Window.partitionBy("query_id").orderBy(key.asc() if metric == "l2" else key.desc(), "match_id")
    ranked = cand.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select("query_id", "match_id", "score", F.col("rank").cast("int"))


def l2_normalize(col: str):
    """Array column divided by its L2 norm (JVM higher-order functions)."""
    c = F.col(col).cast("array<double>")
    norm = F.sqrt(F.aggregate(c, F.lit(0.0), lambda acc, x: acc + x * x))
    return F.transform(c, lambda x: x / norm)
