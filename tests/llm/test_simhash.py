import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from vigilo.llm.components import components
from vigilo.llm.simhash import allocate, choose_parts, fingerprint, links_of, near_duplicates, near_pairs, probe_keys

from .helpers import awkward, empty


def plain(text, k=4):
    words = text.encode().lower().split()
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(words[i:i + k]), 42) for i in range(max(1, len(words) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def linked_sets(prints, most):
    parent = list(range(len(prints)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (int(prints[i]) ^ int(prints[j])).bit_count() <= most:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [root(i) for i in range(len(prints))]


def test_fingerprint():
    pick = random.Random(1)
    for text in ["", "  ", "one", "One two  three", "a b c d", *(" ".join(pick.choice("ab cd\n é Ü zz".split(" ")) for _ in range(n)) for n in (5, 50, 3000))]:
        assert fingerprint(text.encode()) == plain(text)
    words = " ".join(str(i % 977) for i in range(400_000))  # longer than a run
    assert fingerprint(words.encode()) == fingerprint(words.encode().replace(b" ", b"\n", 7))


def test_thresholds_cover_the_radius():
    cost = [[0, 5, 9, 30], [0, 2, 4, 8], [0, 7, 8, 9]]
    total, ts = allocate(cost, 5)
    assert sum(t + 1 for t in ts) == 5
    assert total == min(sum(c[k] for c, k in zip(cost, ks)) for ks in np.ndindex(4, 4, 4) if sum(ks) == 5)


def test_links_against_all_pairs(spark):
    pick = np.random.default_rng(4)
    base = pick.integers(0, 1 << 63, 60, dtype=np.uint64)
    flips = np.uint64(1) << pick.integers(0, 64, (60, 9), dtype=np.uint64)
    prints = np.unique(np.concatenate([base, *(np.bitwise_xor.accumulate(np.concatenate([base[:, None], flips[:, :k]], axis=1), axis=1)[:, -1] for k in range(1, 10))]))
    hot = np.unique(prints[0] ^ np.uint64(3 << 20) ^ (np.uint64(1) << pick.integers(0, 24, 300, dtype=np.uint64)) ^ (np.uint64(1) << pick.integers(0, 24, 300, dtype=np.uint64)))
    prints = np.unique(np.concatenate([prints, hot]))
    df = spark.createDataFrame([(int(x),) for x in prints.view(np.int64)], "fp long")
    parts, ts = choose_parts(df, len(prints), 4)
    assert sorted(b for p in parts for b in p) == list(range(64)) and sum(t + 1 for t in ts) == 5
    want = linked_sets(prints, 4)
    for parts, ts in ((parts, ts), ([list(range(0, 32)), list(range(32, 64))], [1, 2]), ([list(range(22)), list(range(22, 43)), list(range(43, 64))], [0, 1, 1])):
        found = {r.node: r.root for r in components(near_pairs(probe_keys(df, parts, ts), 4, block=20)).collect()}
        got = [found.get(int(x), int(x)) for x in prints.view(np.int64)]
        assert len(set(zip(got, want))) == len(set(got)) == len(set(want))


def test_spanning_of_large_groups():
    pick = np.random.default_rng(5)
    x = pick.integers(0, 1 << 12, 500, dtype=np.uint64)
    zeros = np.zeros(len(x), bool)
    b = links_of(np.zeros(len(x), np.int64), zeros, zeros, x.view(np.int64), 1)
    at = {int(v): i for i, v in enumerate(np.unique(x))}
    parent = list(range(len(at)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
        p, q = sorted((root(at[a]), root(at[c])))
        parent[q] = p
    want = linked_sets(np.unique(x), 1)
    got = [root(i) for i in range(len(at))]
    assert len(set(zip(got, want))) == len(set(got)) == len(set(want))


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + k) for k in range(1, 80)] + [(300, 300), (None, 4)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(61)}, **{100 + k: 100 for k in range(80)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_awkward_rows(spark):
    docs = awkward(spark)
    got = near_duplicates(docs).collect()
    texts = [(r.doc_id, r.text or "") for r in docs.collect()]
    prints = [plain(t) for _, t in texts]
    own = linked_sets(prints, 4)
    want = []
    for i, (doc_id, _) in enumerate(texts):
        ids = [d for (d, _), o in zip(texts, own) if o == own[i] and d is not None]
        want.append((doc_id, int(np.array([prints[i]], np.uint64).view(np.int64)[0]), min(ids, default=None)))
    key = lambda r: tuple((v is None, v or 0) for v in r)
    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)
    assert near_duplicates(empty(spark)).count() == 0
    assert near_duplicates(docs.where(F.col("doc_id") == 2)).count() == 1
