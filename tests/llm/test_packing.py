import random
from functools import lru_cache

import numpy as np
import pytest

from vigilo.llm.packing import Reduction, best_fit, look_up, pack, plan, sequences

from .helpers import awkward, empty

public_tokenizers = pytest.importorskip("public_tokenizers")


def fewest(items, capacity):
    """Least number of bins, by search."""
    items = tuple(sorted(items, reverse=True))

    @lru_cache(None)
    def fits(left, rooms):
        if not left:
            return True
        for room in sorted(set(rooms), reverse=True):
            if room >= left[0]:
                rest = list(rooms)
                rest.remove(room)
                if fits(left[1:], tuple(sorted([*rest, room - left[0]]))):
                    return True
        return False

    n = max(1, -(-sum(items) // capacity)) if items else 0
    while not fits(items, (capacity,) * n):
        n += 1
    return n


def used(found):
    return sum(n for n, _ in found)


def test_reduction_keeps_the_optimum():
    pick = random.Random(1)
    for _ in range(250):
        capacity = pick.choice([10, 20, 30])
        low = pick.choice([1, capacity // 5, capacity // 4])
        items = [pick.randint(low, capacity) for _ in range(pick.randint(1, 9))]
        reduction = Reduction(np.bincount(items, minlength=capacity + 1))
        reduction.run()
        left = [x for x in range(capacity + 1) for _ in range(reduction.left[x])]
        assert used(reduction.fixed) + fewest(left, capacity) == fewest(items, capacity), (capacity, items, reduction.fixed)
        assert all(sum(x * k for x, k in p) <= capacity for _, p in reduction.fixed)


def test_best_fit_is_that_of_single_items():
    pick = random.Random(2)
    for _ in range(150):
        items = sorted((pick.randint(1, 40) for _ in range(pick.randint(0, 60))), reverse=True)
        rooms = []
        for x in items:
            room = min((r for r in rooms if r >= x), default=None)
            if room is None:
                rooms.append(40 - x)
            else:
                rooms[rooms.index(room)] -= x
        found = best_fit(np.bincount(items, minlength=41))
        assert sorted(r for n, p in found for r in [40 - sum(x * k for x, k in p)] * n) == sorted(rooms)


def test_plan_places_every_rank_once_without_gaps():
    pick = np.random.default_rng(3)
    counts = np.bincount(pick.integers(1, 65, 5000), minlength=65)
    counts[7] += 20_000  # a length that many share
    slots = plan(counts)
    length = np.repeat(np.arange(65), counts)
    rank = np.concatenate([np.arange(c) for c in counts])
    sequence, offset = look_up(slots, length, rank)
    order = np.lexsort((offset, sequence))
    length, sequence, offset = length[order], sequence[order], offset[order]
    start = np.concatenate([[True], sequence[1:] != sequence[:-1]])
    assert (offset[start] == 0).all()
    assert (offset[1:][~start[1:]] == (offset + length)[:-1][~start[1:]]).all()
    assert (offset + length).max() <= 64
    assert sequence.max() + 1 == len(set(sequence.tolist())) <= -(-length.sum() // 64) * 1.01 + 1


def test_pack_awkward_rows(spark):
    from tokenizers import Tokenizer
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    docs = awkward(spark)
    packed = pack(docs, public_tokenizers.path("word_bpe_49k.json"), 0, capacity=32, carry=("doc_id", "piece"))
    got = packed.toDF("doc_id", "mine", *packed.columns[2:]).collect()
    assert {r.mine for r in got} == {"mine"}
    want = []
    for r in docs.collect():
        ids = whole.encode(r.text or "", add_special_tokens=False).ids + [0]
        want += [(r.doc_id, k, lo, tuple(ids[lo:lo + 32])) for k, lo in enumerate(range(0, len(ids), 32))]
    key = lambda x: tuple(-1 if v is None else v for v in x)
    assert sorted(((r.doc_id, r.piece, r.start, tuple(np.frombuffer(r.ids, "<u2").tolist())) for r in got), key=key) == sorted(want, key=key)
    whole_sequences = {r.sequence_id: r for r in sequences(packed).collect()}
    for r in got:
        own = np.frombuffer(whole_sequences[r.sequence_id].ids, "<u2")
        assert len(own) <= 32 and own[r.offset:r.offset + r.length].tobytes() == r.ids
    assert sum(len(r.ids) for r in whole_sequences.values()) == sum(len(r.ids) for r in got)


def test_empty_table(spark):
    assert pack(empty(spark), public_tokenizers.path("word_bpe_49k.json")).count() == 0
