import numpy as np
from pyspark.sql import functions as F

from vigilo.llm.vector_dups import all_links, chance_missed, codes, linked, log_shared, near_duplicate_vectors, passes_for, shared_bits, window_links

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, least):
    """Links and components by comparing all pairs."""
    def sound(r):
        return r[2] is not None and r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])

    parent, links = list(range(len(rows))), [0] * len(rows)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(rows):
        for j, b in enumerate(rows[:i]):
            if sound(a) and sound(b) and a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1], np.float32).astype(float), np.array(b[1], np.float32).astype(float)
                if x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= least:
                    links[i] += 1
                    links[j] += 1
                    p, q = sorted((root(i), root(j)))
                    parent[q] = p
    own = [root(i) for i in range(len(rows))]
    least_id = {o: min((r[0] for r, x in zip(rows, own) if x == o and r[0] is not None), default=None) for o in set(own)}
    return [(r[0], n, least_id[o], r[0] == least_id[o]) for r, n, o in zip(rows, links, own)]


def test_against_all_pairs(spark):
    pick = np.random.default_rng(1)
    base = pick.standard_normal((300, 32))
    x = np.concatenate([base, base[:150] + pick.normal(0, 0.25, (150, 32)), base[7] * 3 + pick.normal(0, 0.3, (400, 32)), base[:20]])
    rows = [(int(i), v.astype(np.float32).tolist(), int(i) % 2 if i < 450 else 1) for i, v in enumerate(x)]
    got = near_duplicate_vectors(spark.createDataFrame(rows, SCHEMA), window=16).collect()
    want = plain(rows, 0.93)
    assert sum(r.n_links for r in got) >= 0.99 * sum(w[1] for w in want)
    assert sum(tuple(r) == w for r, w in zip(sorted(got, key=lambda r: r.vec_id), want)) >= 0.99 * len(want)


def test_awkward_rows(spark):
    v, w = [1.0, 2.0, 3.0], [1.0, 2.0, 3.01]
    rows = [(1, v, 0), (2, w, 0), (2, w, 0), (3, v, None), (4, None, 0), (5, [0.0, 0.0, 0.0], 0), (6, [1.0, None, 2.0], 0), (7, [float("nan"), 1.0, 1.0], 0), (8, [float("inf"), 1.0, 1.0], 0),
            (9, v + [0.0], 0), (10, [1.0], 1), (11, [1.0], 1), (12, [-1.0], 1), (None, v, 0), (None, None, 0), (13, [], 0), (14, [3e38, 3e38], 2), (15, [1e-38, 1e-38], 2)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("cid", F.lit("mine")).withColumn("root", F.lit("mine"))
    got = near_duplicate_vectors(df).collect()
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted((tuple(r) for r in got), key=key) == sorted(plain(rows, 0.93), key=key)
    assert near_duplicate_vectors(df.limit(0)).count() == 0


def test_threshold_and_passes():
    u = np.array([[1.0, 0.0]])
    assert linked(u, np.array([[0.93, np.sqrt(1 - 0.93 ** 2)]]), 0.93)[0, 0]
    assert not linked(u, np.array([[0.9299, np.sqrt(1 - 0.9299 ** 2)]]), 0.93)[0, 0]
    assert passes_for(10, 128, 0.93, 0.005) == 8 < passes_for(10 ** 6, 128, 0.93, 0.005) < passes_for(10 ** 9, 128, 0.93, 0.005) < 200


def test_crowded_label_loses_no_links(spark):
    """A label in a narrow cone, and one whose third is a hot group, with planted pairs just above the threshold."""
    pick = np.random.default_rng(3)
    unit = lambda x: x / np.sqrt((x * x).sum(axis=-1, keepdims=True))
    n, pairs, dim = 6000, 200, 64
    spread = unit(pick.standard_normal((2 * n, dim)))
    narrow = lambda x, c: unit(np.sqrt(c) * unit(pick.standard_normal(dim)) + np.sqrt(1 - c) * x)
    x = np.concatenate([narrow(spread[:n], 0.8), narrow(spread[n:n + n // 3], 0.85), spread[n + n // 3:]])
    label = np.repeat([0, 1], n)
    at = np.concatenate([pick.choice(n, pairs, False), n + pick.choice(n // 3, pairs, False)])
    aside = pick.standard_normal((2 * pairs, dim))
    aside = unit(aside - (aside * x[at]).sum(axis=1, keepdims=True) * x[at])
    x, label = np.concatenate([x, 0.94 * x[at] + np.sqrt(1 - 0.94 ** 2) * aside]).astype(np.float32), np.concatenate([label, label[at]])
    classes = spark.createDataFrame([(str(s), i, v.tolist()) for i, (s, v) in enumerate(zip(label, x))], "label string, cid long, vector array<float>").cache()
    u = unit(x.astype(float))
    want = {(i, j) for i, j in zip(*np.nonzero(np.triu(u @ u.T >= 0.93, 1))) if label[i] == label[j]}
    parent = list(range(len(x)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    def recall(links):
        parent[:] = range(len(x))
        for r in links.collect():
            parent[root(r.a)] = root(r.b)
        return np.mean([root(i) == root(j) for i, j in want])

    assert recall(all_links(classes, 0.93, 16, 0.005, 7, block=256)) >= 0.995
    assert recall(all_links(classes, 0.93, 16, 0.005, 7, block=1 << 14)) == 1
    passes = passes_for(n, 16, 0.93, 0.005)
    once = window_links(codes(classes.withColumn("dim", F.size("vector")), passes, 7), passes, 7, 0.93, 16)
    assert recall(once.where("b is not null")) < 0.97  # passes by size alone are not enough here


def test_chance_missed_follows_the_codes():
    code = np.sort(np.random.default_rng(5).integers(-(1 << 63), 1 << 63, 4096))
    shared = np.tile(np.arange(1, 65) * np.log(0.88), (4096, 1))
    even = chance_missed(code, shared, 16, (True, True))
    hot = chance_missed(np.sort(code >> 20), shared, 16, (True, True))
    assert (even < 0).all() and even.mean() < 10 * hot.mean() and (chance_missed(code[:10], shared[:10], 16, (True, True)) < -20).all()
    cut = chance_missed(code, shared, 16, (False, False))
    assert (cut[:17] == 0).all() and (cut[-17:] == 0).all() and (cut[17:-17] == even[17:-17]).all()
    assert shared_bits(np.array([0, -1, 5]), np.array([0, 0, 4])).tolist() == [64, 0, 63]
    u = np.array([[1.0, 0.0, 0.0]])
    z = np.random.default_rng(2).standard_normal((4000, 3)) * [0, 1, 1]
    near = 0.93 * u + np.sqrt(1 - 0.93 ** 2) * z / np.sqrt((z * z).sum(axis=1, keepdims=True))
    sides = np.random.default_rng(4).standard_normal((3, 4000))
    own = np.mean((near * sides.T).sum(axis=1) * sides[0] > 0)
    assert abs(own - np.mean([np.exp(log_shared(u, sides[:, i:i + 1], 0.93)[0, 0]) for i in range(4000)])) < 0.02
