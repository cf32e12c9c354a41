import random
import re

import numpy as np

from vigilo.llm.decontaminate import Block, Shard, benchmark_hits, decontaminate, longest_matches, suffix_array

from .helpers import awkward, empty

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(SMALL))


def plain(text, items, window):
    w = words(text)
    hit, found = [False] * len(w), set()
    for item_id, item in items:
        v = words(item)
        k = min(window, len(v))
        for j in range(len(v) - k + 1) if k else []:
            for i in range(len(w) - k + 1):
                if w[i:i + k] == v[j:j + k]:
                    hit[i:i + k] = [True] * k
                    found.add("null" if item_id is None else str(item_id))
    return len(w), sum(hit), sorted(found), any(hit)


def made(seed, n, size):
    pick = random.Random(seed)
    return [" ".join(pick.choice(["a", "B", "c,", "d", "É", "x9"]) for _ in range(pick.randint(0, size))) for _ in range(n)]


def test_suffix_array_is_sorted():
    pick = np.random.default_rng(1)
    for least in (1, 3):
        w = pick.integers(0, 4, 400).astype(np.int32)
        runs = [(m.start(), m.end()) for m in re.finditer("1+", "".join("1" if x else "0" for x in w)) if m.end() - m.start() >= least]
        want = sorted((w[i:b].tolist(), i) for a, b in runs for i in range(a, b))
        got = [(w[i:next(b for a, b in runs if a <= i < b)].tolist(), int(i)) for i in suffix_array(w, least, 400)]
        assert [g[0] for g in got] == [x[0] for x in want] and sorted(g[1] for g in got) == sorted(x[1] for x in want)


def test_hits_against_plain_search(spark):
    texts = made(1, 60, 40) + ["a b c d a b", None, "", "... !"]
    items = [(i, t) for i, t in enumerate(made(2, 12, 25))] + [(3, "a B"), (None, "x9 x9 x9"), (50, ""), (51, None), (52, "É"), (52, "É")]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] * 2, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for window, shard, block in ((3, 1 << 20, 1 << 20), (3, 200, 60), (1, 1 << 20, 100), (10, 50, 1 << 20)):
        got = benchmark_hits(docs, bench, window, shard_bytes=shard, block_bytes=block).collect()
        assert len(got) == 2 * len(texts)
        for r in got:
            assert (r.n_words, r.n_hit, r.item_ids, r.contaminated) == plain(texts[r.doc_id], items, window), (window, r)


def test_longest_matches_and_places(spark):
    docs = spark.createDataFrame([(1, "u v one two three four five w"), (2, "three four five six")], "doc_id long, text string")
    bench = spark.createDataFrame([("q", "Zero one two three, four five six seven")], "item_id string, text string")
    got = {tuple(r) for r in longest_matches(docs.coalesce(1), bench, 3).collect()}
    assert got == {(1, 2, "q", 1, 5), (1, 3, "q", 2, 4), (2, 0, "q", 3, 4), (2, 1, "q", 4, 3)}
    shard = Shard([b"a b a b a b a"])
    list(shard.meet(Block.of(["i"], [b"a b a"], 3)))
    assert shard.n_hit().tolist() == [7]


def test_awkward_rows(spark):
    docs = awkward(spark)
    bench = spark.createDataFrame([(1, "lange text der lange text der lange text der lange"), (2, "ünïcödé tëxt with spaces")], "item_id long, text string")
    kept = decontaminate(docs, bench, 4)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {5, 1, 2, 3, None, 8, 9}
    assert kept.count() == docs.count() - 1
    assert decontaminate(docs, bench.limit(0)).count() == docs.count()
    assert benchmark_hits(empty(spark), bench).count() == 0
