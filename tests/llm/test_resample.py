import random

import numpy as np

from vigilo.llm.resample import grams, gram_counts, kth_largest, log_ratios, resample

from .helpers import awkward, empty


def test_grams_are_those_of_whole_texts():
    pick = random.Random(2)
    texts = [" ".join(pick.choice(["ab", "c", "dEf", "x\ny", "", " ", "\t z"]) for _ in range(pick.randint(0, 200))).encode() for _ in range(100)] + [b"", b"  ", b"a"]
    seen = []
    for size in (50, 500, 1 << 20):
        n, count = np.zeros(len(texts), int), np.zeros(1000, int)
        for doc, bucket in grams(iter(texts), 1000, size):
            n += np.bincount(doc, minlength=len(texts))
            count += np.bincount(bucket, minlength=1000)
        words = [len(t.split()) for t in texts]
        assert n.tolist() == [w + max(0, w - 1) for w in words]
        seen.append(count.tolist())
    assert seen[0] == seen[1] == seen[2]


def test_kth_largest(spark):
    pick = np.random.default_rng(1)
    values = [int(x) for x in pick.integers(-(1 << 63), (1 << 63) - 1, 400)] + [5] * 50 + [-1, 0, 1, -(1 << 63), (1 << 63) - 1]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    ranked = sorted(values, reverse=True)
    for k in (1, 2, 200, 210, 230, len(values)):
        assert kth_largest(df, "v", k) == ranked[k - 1]
    assert kth_largest(df, "v", len(values) + 1) is None


def test_good_text_is_taken(spark):
    pick = random.Random(3)
    good, bad = [f"good{i}" for i in range(60)], [f"bad{i}" for i in range(60)]
    texts = [" ".join(pick.choice(good if i % 3 else bad) for _ in range(60)) for i in range(300)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    ids = spark.createDataFrame([(i,) for i in range(300) if i % 3 and i < 100], "doc_id long")
    got = resample(docs, ids, 2 / 3).collect()
    assert len(got) == 200 and sum(r.doc_id % 3 > 0 for r in got) == 200 and all(r.kept for r in got)
    again = resample(docs.repartition(5), ids, 2 / 3).collect()
    assert {r.doc_id for r in again} == {r.doc_id for r in got}
    counts = gram_counts(docs, 512)
    assert counts.sum() == 300 * 119
    ratios = log_ratios(gram_counts(docs.where("doc_id % 3 > 0"), 512), counts)
    weights = {r.doc_id: r.log_weight for r in resample(docs, docs.where("doc_id % 3 > 0").select("doc_id"), 1.0, buckets=512).collect()}
    for i in (0, 1, 2, 50):
        own = sum(np.bincount(b, ratios[b] * 0 + ratios[b], minlength=512).sum() for _, b in grams(iter([texts[i].encode()]), 512))
        assert abs(own - weights[i]) < 1e-9


def test_awkward_rows(spark):
    docs = awkward(spark)
    ids = docs.select("doc_id")
    assert resample(docs, ids, 1.0).count() == docs.count()
    assert resample(docs, ids, 0.0).count() == 0
    half = resample(docs, ids, 0.5).collect()
    assert len(half) >= round(0.5 * docs.count())
    assert all(r.log_weight == 0 for r in resample(docs, ids.limit(0), 1.0).collect())
    assert resample(empty(spark), ids, 0.5).count() == 0
