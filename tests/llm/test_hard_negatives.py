import math
import random

import numpy as np
from pyspark.sql import functions as F

from vigilo.llm import hard_negatives as H
from vigilo.llm.common import bound_batches
from vigilo.llm.hard_negatives import Index, hard_negatives, tail_norms

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, every=50, scale=256):
    sound = [(k, i, [math.floor(scale * float(np.float32(x))) for x in v], c) for k, (i, v, c) in enumerate(rows)
             if i is not None and c is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for k, i, v, c in sound:
        if i % every:
            continue
        scored = sorted(((-sum(map(int.__mul__, v, w)), j, m, d) for m, j, w, d in sound if m != k and len(w) == len(v)))
        for p, pid, _, _ in [s for s in scored if s[3] == c][:5]:
            near = [(n, j) for n, j, _, d in scored if d != c and 50 * -p <= 100 * -n <= 95 * -p][:3]
            out += [(i, pid, rank, j, -p, -n) for rank, (n, j) in enumerate(near, 1)]
    return sorted(out)


def result(spark, rows):
    bound_batches(spark)
    return sorted(tuple(r) for r in hard_negatives(spark.createDataFrame(rows, SCHEMA)).collect())


def vectors(n, dim, labels, seed, spread=1.0):
    rng = np.random.default_rng(seed)
    centre = rng.standard_normal((labels, dim))
    out = []
    for i in range(n):
        c = int(rng.integers(labels))
        x = centre[int(rng.integers(labels))] + spread * rng.standard_normal(dim)
        out.append((i, (x / np.linalg.norm(x)).astype(np.float32).tolist(), c))
    return out


def test_against_brute_force(spark):
    for dim, seed in ((40, 1), (3, 2)):
        rows = vectors(600, dim, 4, seed)
        got = result(spark, rows)
        assert got == brute(rows) and got


def test_several_blocks_and_copies(spark, monkeypatch):
    """Blocks of few rows, anchors in several blocks, and a third of all rows alike: ties go by id."""
    rows = vectors(500, 20, 3, 5)
    rows = [(i, rows[0][1], c) if i % 3 == 0 else (i, v, c) for i, v, c in rows]
    want = brute(rows)
    assert result(spark, rows) == want
    monkeypatch.setattr(H, "BLOCK_ROWS", 60)
    monkeypatch.setattr(H, "ANCHOR_ROWS", 3)
    assert result(spark, rows) == want


def test_search_is_exact_and_prunes():
    """The index leaves dimensions out and pairs are dropped early, and no row at the threshold is lost."""
    rng = np.random.default_rng(3)
    x = np.floor(256 * rng.standard_normal((4000, 96)) * np.geomspace(1, 0.01, 96))
    q = x[:40] + np.floor(rng.standard_normal((40, 96)) * 5)
    least = 0.7 * (q * q).sum(axis=1)
    index = Index(np.arange(4000), np.arange(4000), np.zeros(4000, np.int64), x)
    index.post(tail_norms(q[:, index.order]).max(axis=0), float(least.min()))
    assert index.posted[-1] < 4000
    for a, rows, score in index.search(q, least):
        want = np.flatnonzero(x @ q[a] >= least[a])
        assert sorted(index.key[rows].tolist()) == want.tolist()
        assert score.tolist() == (index.x[rows] @ q[a, index.order]).astype(np.int64).tolist()
    assert index.products < 0.9 * index.pairs * 6  # of six strips of dimensions


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = vectors(200, 4, 2, 7)
    rows += [(50, rows[50][1], rows[50][2]), (300, None, 1), (301, [1.0, None, 0.0, 0.0], 1), (302, [nan, 0.0, 0.0, 0.0], 0), (303, [inf, 0.0, 0.0, 0.0], 0), (304, [1.0, 1.0, 1.0, 1.0], None),
             (None, [1.0, 0.0, 0.0, 0.0], 1), (350, [0.0] * 4, 0), (400, [1.0, 2.0], 0), (401, [1.0, 2.0], 0), (402, [0.9, 1.5], 1), (450, [], 0), (451, [], 0), (452, [], 1), (500, [0.5, 0.5, 0.5, 0.5], 9)]
    got = result(spark, rows)
    assert got == brute(rows)
    assert {r[0] for r in got} >= {400, 450}
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("mine") for c in ("key", "score", "rank", "anchor", "positive", "vector")})
    bound_batches(spark)
    assert hard_negatives(df).count() == len(got)
    assert hard_negatives(df.limit(0)).count() == 0


def test_very_large_components(spark):
    """Sums beyond 2^53 are exact."""
    rng = random.Random(1)
    rows = [(i, [float(np.float32(rng.uniform(1e6, 2e6))) for _ in range(3)], i % 2) for i in range(60)]
    assert result(spark, rows) == brute(rows)
