import random
import zlib
from hashlib import sha256

import numpy as np
from pyspark.sql import functions as F

from vigilo.llm.common import bound_batches
from vigilo.llm.merkle import ARITY, documents_manifest, missing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def h(text):
    return sha256(text.encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(row, lower=False):
    doc, text, lang, source, n = row
    if lower and text is not None:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    return h("".join(map(field, (doc, source, lang, n, text))))


def tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        now = levels[-1]
        levels.append([h("".join(now[i:i + ARITY])) for i in range(0, len(now), ARITY)])
    return levels


def path(levels, i, claim):
    proof = ""
    for now in levels[:-1]:
        lo = i // ARITY * ARITY
        run = now[lo:lo + ARITY]
        proof += "".join(x for k, x in enumerate(run) if k != i - lo)
        claim = h("".join(claim if k == i - lo else x for k, x in enumerate(run)))
        i //= ARITY
    return proof, claim


def brute(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append(row)
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = []
    for name in names:
        own = sorted(groups[name], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees.append((own, tree([leaf(r) for r in own])))
    top = tree([t[-1][0] for _, t in trees])
    root, out = top[-1][0], []
    for g, (own, levels) in enumerate(trees):
        for i, r in enumerate(own):
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            a, claim = path(levels, i, leaf(r, tampered))
            b, folded = path(top, g, claim)
            out.append((r[0], leaf(r), levels[-1][0], root, h(a + b), folded, folded == root))
    return sorted(out, key=repr)


def result(spark, rows, chunk):
    bound_batches(spark)
    df = spark.createDataFrame(rows, SCHEMA)
    return sorted((tuple(r) for r in documents_manifest(df, chunk=chunk).collect()), key=repr)


def table(n, langs, seed):
    rng = random.Random(seed)
    return [(i, rng.choice(["Abc d", "déf", "", None, "x"]) or None, rng.choice(langs), rng.choice(["s", None]), rng.choice([3, None])) for i in range(n)]


def test_against_brute_force(spark):
    rows = table(700, ["en"] * 8 + [None, "de", "é", "z"], 1)
    for chunk in (64, 13):  # whole subtrees, and parts that cut them
        got = result(spark, rows, chunk)
        assert got == brute(rows)
        assert {r[-1] for r in got} == {True, False}


def test_small_trees(spark):
    for n in (1, 8, 9, 65):
        rows = table(n, ["en"], n)
        assert result(spark, rows, 64) == brute(rows)
    rows = [(i, "A", f"l{i:03d}", None, None) for i in range(100)]  # a leaf for each tree
    assert result(spark, rows, 64) == brute(rows)


def test_awkward_rows(spark):
    rows = [(5, "Same", "en", "s", 4)] * 3 + [(5, "other", "en", "s", 5), (None, None, None, None, None), (None, "A", "en", None, 1), (6, "B" * 200_000, "en", None, 1)]
    assert result(spark, rows, 64) == brute(rows)
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("mine") for c in ("leaf", "root", "tree", "chunk", "idx", "c0", "verified")})
    bound_batches(spark)
    assert documents_manifest(df).count() == len(rows)
    assert documents_manifest(df.limit(0)).count() == 0


def test_minimal_coordinates():
    """Every fetched node is needed: no leaf or known node lies below it, and proofs of single leaves need their siblings only."""
    rng = np.random.default_rng(2)
    for size in (1, 7, 64, 300, 1000):
        for leaves in (np.arange(size), rng.choice(size, min(size, 5), replace=False), np.arange(size // 3, size // 2 + 1).clip(max=size - 1)):
            got = missing(leaves, size)
            assert len(set(got)) == len(got)
            for level, i in got:
                assert not any(leaf // ARITY**level == i for leaf in leaves.tolist())
                assert any(leaf // ARITY**(level + 1) == i // ARITY for leaf in leaves.tolist())
    assert missing(np.arange(300), 300) == []
