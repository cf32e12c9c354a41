"""Pruned nearest-row search against brute force: both paths, ties at the k-th distance, unusable vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigilo.operators import knn

SCHEMA = "id long, vec array<double>"
PATHS = [{}, {"broadcast_bytes": 0, "block_rows": 50, "chunk_rows": 40}]


def table(spark, rows, first=0):
    return spark.createDataFrame([(first + i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in enumerate(rows)], SCHEMA)


def brute(q, c, k, exclude_self=False):
    out = {}
    for i, v in enumerate(q):
        key = np.round(np.sqrt(((v - c) ** 2).sum(axis=1)) * 1e9)
        if exclude_self:
            key[i] = np.inf
        out[i] = [int(j) for j in np.lexsort((np.arange(len(c)), key))[:k] if np.isfinite(key[j])]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append(r.match_id)
    return out


@pytest.mark.parametrize("kw", PATHS)
def test_clusters_and_a_hot_third(spark, kw):
    pick = np.random.default_rng(3)
    centres = pick.normal(0, 20, (8, 6))
    c = np.vstack([centres[i % 8] + pick.normal(0, 1, 6) for i in range(600)] + [np.full(6, 7.0)] * 300)
    q = np.vstack([c[::9], pick.normal(0, 20, (30, 6))])
    got = knn.nearest(table(spark, q), table(spark, c), 4, **kw)
    assert found(got) == brute(q, c, 4)
    share = got.where("rank = 1").agg(F.sum("n_scored")).first()[0] / (len(q) * len(c))
    assert share < 0.7


@pytest.mark.parametrize("kw", PATHS)
def test_ties_at_the_last_place(spark, kw):
    grid = np.array([[x, y] for x in range(20) for y in range(20)], float)
    assert found(knn.nearest(table(spark, grid), table(spark, grid), 3, exclude_self=True, **kw)) == brute(grid, grid, 3, True)
    same = np.ones((200, 3))
    assert found(knn.nearest(table(spark, same[:5]), table(spark, same), 3, **kw)) == {i: [0, 1, 2] for i in range(5)}


@pytest.mark.parametrize("kw", PATHS)
def test_unusable_and_few(spark, kw):
    c = table(spark, [[0, 0], None, [1, None], [float("nan"), 1], [float("inf"), 0], [3, 4]])
    q = table(spark, [[0, 0], None, [float("nan"), 0], [6, 8]])
    assert found(knn.nearest(q, c, 3, **kw)) == {0: [0, 5], 3: [5, 0]}
    assert knn.nearest(q, c.limit(0), 3, **kw).count() == 0
    assert knn.nearest(q.limit(0), c, 3, **kw).count() == 0


def test_unique_queries_are_ranked_where_they_are_searched(spark):
    """No shuffle of what was found, also with more corpus rows than groups of columns; an id that comes twice is ranked as one."""
    pick = np.random.default_rng(5)
    c = pick.normal(0, 1, (2000, 12))
    q = np.vstack([c[::40], np.repeat(c[:1], 3, axis=0)])
    got = knn.nearest(table(spark, q), table(spark, c), 3)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert found(got) == brute(q, c, 3)
    twice = knn.nearest(table(spark, q).union(table(spark, q[:1])), table(spark, c), 3)
    one = {r["rank"]: r.match_id for r in twice.where("query_id = 0").collect()}
    near = brute(q, c, 2)[0]
    assert one == {1: near[0], 2: near[0], 3: near[1]}
