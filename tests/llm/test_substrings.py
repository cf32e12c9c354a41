import random

import pytest
from pyspark.sql import functions as F

from vigilo.llm import substrings as S
from vigilo.llm.common import bound_batches
from vigilo.llm.substrings import Shard, deduplicate, runs_of, slices

from .helpers import awkward, empty


def brute(docs, window):
    """(doc_id, words, removed, kept text) of every row, by a table of all windows' first places."""
    first, rows = {}, []
    order = lambda d: (d is None, d or 0)
    for doc, text in docs:
        words = (text or "").encode().split()
        rows.append((doc, words))
        for i in range(len(words) - window + 1):
            key = tuple(words[i:i + window])
            here = (order(doc), i)
            first[key] = min(first.get(key, here), here)
    out = []
    for doc, words in rows:
        gone = set()
        for i in range(len(words) - window + 1):
            if first[tuple(words[i:i + window])] < (order(doc), i):
                gone.update(range(i, i + window))
        out.append((doc, len(words), len(gone), b" ".join(w for i, w in enumerate(words) if i not in gone).decode()))
    return sorted(out, key=repr)


def result(spark, docs, window=20):
    bound_batches(spark)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    return sorted((tuple(r) for r in deduplicate(df, window).collect()), key=repr)


def corpus(seed, n=120, words=400):
    """Documents with shared passages, copies, near copies, inner repeats, and a short line that very many have."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(words)}"
    text = lambda k: [word() for _ in range(k)]
    line, passages = text(9), [text(rng.randrange(15, 60)) for _ in range(6)]
    docs = []
    for i in range(n):
        body = text(rng.randrange(0, 90))
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(body) + 1)
            body[at:at] = rng.choice(passages)
        if rng.random() < 0.5:
            body += line + text(12)
        if rng.random() < 0.2:
            body += body[: rng.randrange(len(body) + 1)]
        if docs and rng.random() < 0.25:
            body = list(rng.choice(docs)[1])
            if body and rng.random() < 0.5:
                body[rng.randrange(len(body))] = word()
        docs.append((i, body))
    return [(i, rng.choice([" ", "  ", "\n"]).join(b)) for i, b in docs]


@pytest.mark.parametrize("window", [6, 20])
def test_against_brute_force(spark, window):
    docs = corpus(window)
    got = result(spark, docs, window)
    assert got == brute(docs, window)
    assert sum(r[2] for r in got) > 0


def test_hot_anchors_and_small_shards(spark, monkeypatch):
    """Anchors beyond the bound send their windows one by one; shards of few passages change nothing."""
    docs = corpus(3)
    want = brute(docs, 20)
    monkeypatch.setattr(S, "HOT", 5)
    monkeypatch.setattr(S, "SHARD", 7)
    assert result(spark, docs) == want


def test_automaton_gives_matching_statistics(spark):
    rng = random.Random(9)
    passages = [(b" ".join(str(rng.randrange(3)).encode() for _ in range(rng.randrange(4, 14))), i // 2, 20 * (i % 2)) for i in range(12)]
    shard, made = Shard.of(passages, 4)
    import io
    sink = io.BytesIO()
    shard.write(made, sink)
    sink.seek(0)
    shard = Shard.read(sink)
    where = {}
    for words, doc, at in passages:
        words = words.split()
        for i in range(len(words) - 3):
            where[tuple(words[i:i + 4])] = min(where.get(tuple(words[i:i + 4]), (99, 0)), (doc, at + i))
    for _ in range(200):
        text = [str(rng.randrange(4)).encode() for _ in range(15)]
        found = {start: shard.first[state] for start, state in shard.window_states(b" ".join(text), 4)}
        assert found == {i: where[tuple(text[i:i + 4])] for i in range(12) if tuple(text[i:i + 4]) in where}


def test_parts_of_long_texts(monkeypatch):
    """Windows of a text read in parts are those of the whole text, each once."""
    rng = random.Random(4)
    text = " ".join(f"w{rng.randrange(50)}" for _ in range(3000)).encode()
    whole = [(int(a), int(n)) for r in runs_of([text], 20) for a, n in zip(r.at, r.size)]
    monkeypatch.setattr(S, "SLICE", 700)
    assert sum(len(p.split()) for _, p in slices(text, 20)) > 3000
    cut = [(int(a) + j, 1) for r in runs_of([text], 20) for a, n in zip(r.at, r.size) for j in range(n)]
    assert cut == [(a + j, 1) for a, n in whole for j in range(n)] == [(i, 1) for i in range(2981)]


def test_awkward_rows(spark):
    passage = " ".join(f"p{i}" for i in range(25))
    extra = [(30, passage), (30, passage), (31, passage), (32, "x " + passage + " y"), (None, passage), (33, passage + " " + passage), (30, "q " + passage)]
    docs = awkward(spark, extra)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    bound_batches(spark)
    got = deduplicate(docs, 20, carry=("doc_id", "n_words", "c0"))
    assert got.columns == ["doc_id", "n_words", "c0", "n_words", "n_removed", "kept"]
    found = sorted((tuple(r)[0], *tuple(r)[3:]) for r in got.collect() if r[0] is not None)
    assert found == sorted(r for r in brute(rows, 20) if r[0] is not None)
    assert deduplicate(empty(spark)).count() == 0
    assert deduplicate(docs).where(F.col("doc_id").isNull()).count() == 3
