import zlib
import random

import numpy as np

from vigilo.llm.toxicity import Landmarks, fit, fold, harmless, padded, score, subsequences, train, units
from vigilo.llm import toxicity

from .helpers import awkward, empty

INSULTS = ["idiot", "moron", "stupid", "worthless"]


def made(n, seed=1):
    pick = random.Random(seed)
    syllables = ["th", "er", "on", "an", "re", "sh", "ing", "ed", "tion", "ble"]
    word = lambda: "".join(pick.choice(syllables) for _ in range(pick.randint(1, 4)))
    out = []
    for i in range(n):
        toxic = i % 5 == 0
        sentences = [[word() for _ in range(pick.randint(4, 12))] for _ in range(pick.randint(2, 6))]
        for _ in range(2 if toxic else 0):
            pick.choice(sentences).insert(1, pick.choice(INSULTS))
        out.append((i, ". ".join(" ".join(s).capitalize() for s in sentences) + ".", int(toxic)))
    return out


def brute_kernel(s, t):
    """Gap-weighted kernel by listing the places of all subsequences."""
    from itertools import combinations
    n, total = toxicity.LENGTH, 0.0
    for a in combinations(range(len(s)), n):
        for b in combinations(range(len(t)), n):
            if all(s[i] == t[j] for i, j in zip(a, b)):
                total += toxicity.DECAY ** (a[-1] - a[0] + b[-1] - b[0] + 2)
    return total


def test_kernel():
    for a, b in ((b"idiot", b"idiot"), (b"ixdiot", b"idiot"), (b"abc", b"xyz"), (b"aaaa", b"aa"), (b"clown", b"colon"), ("é1x".encode(), "éx".encode())):
        assert abs(subsequences(padded([a, b"zzzzzzzzz"]), padded([b, b"q"]))[0] - brute_kernel(a, b)) < 1e-9
    marks = Landmarks([b"idiot", b"worthless"])
    k = marks.kernel([b"idiot", b"idxiot", b"ixdxixoxt", b"nothing", b"xx" * 30 + b"idiot", b"", b"a"])
    assert abs(k[0, 0] - 1) < 1e-9 and k[1, 0] > 0.4 and k[2, 0] > 0.005 and (k[3] == 0).all() and k[4, 0] > 0 and (k[5:] == 0).all()


def test_units():
    text = b"He is i.d.i.o.t! W o r t h less. Ok\nnext, one"
    found = [(d, w) for doc, _, words in units([b"", text, b"  "]) for d, w in zip(doc.tolist(), words)]
    assert (1, b"idiot") in found and (1, b"worth") in found and (1, b"next") in found and {d for d, _ in found} == {1}
    sentences = {w: s for _, sentence, words in units([text]) for s, w in zip(sentence.tolist(), words)}
    assert sentences[b"he"] == sentences[b"idiot"] < sentences[b"less"] < sentences[b"ok"] < sentences[b"next"] == sentences[b"one"]
    cut = [w for _, _, words in units([b"word " * 1000], size=100) for w in words]
    assert cut == [b"word"] * 1000


def test_held_out_accuracy(spark):
    rows = made(1500)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], 1, r[2]) for r in rows], "doc_id long, quality int, toxic int")
    out = {1: set(r.doc_id for r in docs.where(fold(docs.doc_id) == 1).collect())}
    got = {r.doc_id: r.score for r in score(docs, fit(docs, labels)).collect()}
    held = [r for r in rows if r[0] in out[1]]
    assert np.mean([(got[i] >= 0.7) == bool(t) for i, _, t in held]) > 0.95
    # labels of held-out documents have no part in it
    flipped = labels.withColumn("toxic", labels.toxic * 0 + (1 - labels.toxic) * (fold(labels.doc_id) == 1).cast("int") + labels.toxic * (fold(labels.doc_id) != 1).cast("int"))
    again = {r.doc_id: r.score for r in score(docs, fit(docs, flipped)).collect()}
    assert again == got
    kept = harmless(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, s in got.items() if s < 0.7}


def test_gapped_and_inserted_insults():
    rows = made(1500, 4)
    model = train([t.encode() for _, t, _ in rows], np.array([x == 1 for _, _, x in rows]))
    s = model.scores([b"The rering. You i.d.i.o.t and m o r o n are.", b"The rering. You idxiot stupxid are. An moxron. Be wortxhless.", b"The rering. You tion and er are.", b""])
    assert s[0] > 0.7 and s[1] > 5 * s[2] and s[2] < 0.1 and s[3] < 0.1


def test_spaced_insults_pass_the_cheap_test():
    near = Landmarks([b"idiot", b"worthless"]).near
    for text in (b"i d i o t", b"i - d - i - o - t", b"i  d  i  o  t", b"id - io - t", b"I, - D , I  - ot", b"w o r - th - le - ss", b"i\td\ti\to\tt"):
        found = [w for _, _, words in units([b"The rering " + text + b" tion."], near) for w in words]
        assert found == [bytes(c for c in text.lower() if 97 <= c <= 122)], text
    assert [w for _, _, words in units([b"a - b - c - d", b"- - - -", b"to be or"], near) for w in words] == []
    rows = made(1500, 4)
    model = train([t.encode() for _, t, _ in rows], np.array([x == 1 for _, _, x in rows]))
    plain, *spaced = model.scores([b"The rering. You idiot and moron are.", b"The rering. You i - d - i - o - t and m  o  r  o  n are.", b"The rering. You id - io - t and mo - ro - n are."])
    assert plain > 0.7 and all(s > 0.7 for s in spaced)


def test_awkward_rows(spark):
    docs = awkward(spark)
    labels = spark.createDataFrame([(5, None, 1), (1, 1, 0), (None, 1, 1), (2, 0, None)], "doc_id long, quality int, toxic int")
    assert {r.score for r in score(docs, fit(docs, labels)).collect()} == {0.0}
    assert fit(docs, labels.limit(0)) is None and harmless(docs, labels).count() == docs.count()
    model = train([t.encode() for _, t, _ in made(300)], np.array([x == 1 for _, _, x in made(300)]))
    got = score(docs, model, ("doc_id", "score"))
    assert got.count() == docs.count() and score(empty(spark), model).count() == 0


def test_the_sample_is_bounded_in_bytes(spark):
    from vigilo.llm.toxicity import labelled_sample
    docs = spark.range(60).selectExpr("id as doc_id", "repeat('word ', 100 * cast(1 + id % 7 as int)) as text")
    labels = spark.range(60).selectExpr("id as doc_id", "cast(id % 2 as int) as toxic")
    whole, few = (labelled_sample(docs, labels, 50, n) for n in (1 << 20, 8000))
    assert len(whole) == sum(1 for i in range(60) if zlib.crc32(str(i).encode()) % 3 != 1)
    assert 0 < len(few) < len(whole) and set(few) <= set(whole)
    for label in (0, 1):
        assert sum(len(t) for t, y in few if y == label) <= 4000
