"""Toxicity by a support vector machine on a subsequence string kernel with Nyström landmarks.

A text is cut into sentences, and a sentence into units: its words without punctuation, and runs of at least
three very short words joined, so ``i.d.i.o.t`` and ``i d i o t`` are units like ``idiot``.  Units meet landmarks in
the gap-weighted subsequence kernel, normalised and raised to a power, which tolerates inserted characters.  A
unit counts as unlike a landmark if it has too few of its pairs of neighbouring characters, next to each other or
with one between; this test runs on hashed pair sets of all units at once, so the kernel is computed for few.

A sentence's kernel with a landmark is the sum over its units, so the machine's decision is a sum of unit scores
and a bias.  A document's score is a logistic curve over the decisions of its three worst sentences.  The machine is trained on sentences: those of harmless
documents are negative, and of a toxic document the sentence scored worst is the positive one, found by
training a few times over.  Landmarks are units that tell toxic from harmless training documents, each chosen
for the toxic ones that the earlier leave unexplained, and the harmless units most like them.

The fit uses at most ``rows`` labelled documents of each label, those with the smallest hash, and of them only as many whole
ones as come to ``most_bytes`` together.  A unit must occur in ``least`` toxic documents of the sample to be a landmark: in
one of 60, but 2 at least and 5 at most.  Defined results:
null and empty texts have the bias as their only evidence; a missing sentence counts as one without units;
repeated rows are scored alike; without labels of both kinds every score is 0; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import byte_rows, materialise, text_of
from .resample import SPACE, pieces

DECAY, LENGTH, POWER = 0.9, 2, 4
LONGEST = 24
SHARE = 0.6  # of a landmark's neighbouring pairs that a unit like it has at least
#: Bytes that belong to a unit: letters, digits and all beyond ASCII, in lower case.
KEPT = np.array([48 <= c <= 57 or 97 <= c <= 122 or c >= 128 for c in range(256)])
DROPPED = bytes(c for c in range(256) if not KEPT[c])
PUNCTUATION = bytes(c for c in DROPPED if not SPACE[c])
#: A number for each kept byte (0 for others), for pairs of characters.
CLASS = np.array([c - 96 if 97 <= c <= 122 else c - 21 if 48 <= c <= 57 else 37 + c % 27 if c >= 128 else 0 for c in range(256)], np.uint16)
_PAIR = np.arange(1 << 12, dtype=np.uint64)
PAIR_BITS = [np.where((_PAIR >> np.uint64(6) > 0) & (_PAIR % np.uint64(64) > 0), np.uint64(1) << ((_PAIR * np.uint64(k)) >> np.uint64(58)), np.uint64(0)) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]
ENDS = np.zeros(256, bool)
ENDS[[33, 46, 63]] = True


def pair_sets(raw: np.ndarray, start: np.ndarray, gaps: tuple = (1, 2)) -> list[np.ndarray]:
    """Two hashed sets of the character pairs of each stretch of bytes that begins at a place of ``start``."""
    kind = np.concatenate([CLASS[raw], np.zeros(2, np.uint16)])
    codes = [kind[:-2] * np.uint16(64) + kind[g:len(kind) - 2 + g] for g in gaps]
    out = []
    for bits in PAIR_BITS:
        sets = bits[codes[0]]
        for c in codes[1:]:
            sets |= bits[c]
        out.append(np.bitwise_or.reduceat(sets, start))
    return out


def pair_sets_of(units: list[bytes], gaps: tuple = (1, 2)) -> list[np.ndarray]:
    """The same for single units."""
    size = np.array([len(u) + 2 for u in units])
    return pair_sets(np.frombuffer(b"  ".join([*units, b""]), np.uint8), np.cumsum(size) - size, gaps) if units else [np.zeros(0, np.uint64)] * 2


def padded(units: list[bytes]) -> np.ndarray:
    out = np.zeros((len(units), max(map(len, units), default=1)), np.uint8)
    for i, u in enumerate(units):
        out[i, :len(u)] = np.frombuffer(u, np.uint8)
    return out


def subsequences(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Gap-weighted kernel of common subsequences of LENGTH characters, row by row; rows are padded by zeros."""
    n, q = t.shape
    decay = np.tril(DECAY ** np.subtract.outer(np.arange(q), np.arange(q)).clip(0)).T
    before = [np.ones((n, q + 1))] + [np.zeros((n, q + 1)) for _ in range(LENGTH - 1)]
    out = np.zeros(n)
    for i in range(s.shape[1]):
        same = (s[:, i:i + 1] == t) & (t > 0)
        hit = [same * DECAY ** 2 * before[k][:, :-1] for k in range(LENGTH)]
        out += hit[-1].sum(axis=1)
        for k in range(1, LENGTH):
            before[k] *= DECAY
            before[k][:, 1:] += hit[k - 1] @ decay
    return out


def self_kernel(units: list[bytes]) -> np.ndarray:
    s = padded(units)
    return subsequences(s, s)


def windows(unit: bytes) -> list[bytes]:
    """A long unit in overlapping parts."""
    return [unit] if len(unit) <= LONGEST else [unit[i:i + LONGEST] for i in range(0, len(unit) - LONGEST // 2, LONGEST // 2)]


@dataclass
class Landmarks:
    units: list[bytes]
    sets: list[np.ndarray] = field(init=False)
    need: np.ndarray = field(init=False)
    own: np.ndarray = field(init=False)

    def __post_init__(self):
        self.sets = pair_sets_of(self.units, (1,))
        self.need = [np.ceil(SHARE * np.bitwise_count(x)).astype(np.uint8).clip(min=2) for x in self.sets]
        self.own = self_kernel(self.units)

    def like(self, j: int, sets: list[np.ndarray]) -> np.ndarray:
        """Places of units, given by their pair sets, that may be like landmark j."""
        at = np.flatnonzero(np.bitwise_count(sets[0] & self.sets[0][j]) >= self.need[0][j])
        return at[np.bitwise_count(sets[1][at] & self.sets[1][j]) >= self.need[1][j]]

    def near(self, sets: list[np.ndarray]) -> np.ndarray:
        """Which units may be like any landmark."""
        out = np.zeros(len(sets[0]), bool)
        for j in range(len(self.units)):
            out[self.like(j, sets)] = True
        return out

    def kernel(self, units: list[bytes], block: int = 4000) -> np.ndarray:
        """Power of the normalised kernel of each unit with each landmark: for long units, of their closest part."""
        parts = [(i, w) for i, u in enumerate(units) for w in windows(u)]
        out = np.zeros((len(units), len(self.units)))
        for lo in range(0, len(parts), block):
            owner = np.array([i for i, _ in parts[lo:lo + block]])
            words = [w for _, w in parts[lo:lo + block]]
            s, sets = padded(words), pair_sets_of(words)
            pairs = [(j, at) for j in range(len(self.units)) if len(at := self.like(j, sets))]
            used = np.unique(np.concatenate([at for _, at in pairs])) if pairs else np.zeros(0, np.int64)
            own = np.ones(len(words))
            own[used] = subsequences(s[used], s[used])
            for j, at in pairs:
                t = np.broadcast_to(np.frombuffer(self.units[j], np.uint8), (len(at), len(self.units[j])))
                scale = own[at] * self.own[j]
                value = np.divide(subsequences(s[at], t) ** 2, scale, out=np.zeros(len(at)), where=scale > 0) ** (POWER / 2)
                np.maximum.at(out[:, j], owner[at], value)
        return out


def units(texts: Iterable[bytes], near=None, size: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
    """Document, sentence number and text of units; ``near(pair sets)`` picks the ones that are given.

    Sentences are numbered on from buffer to buffer.  A text longer than ``size`` bytes is read in parts, and a
    sentence that a part's end cuts counts as two."""
    done = 0
    for _, data, docs, at in pieces(iter(texts), size):
        data = data.lower()
        raw = np.frombuffer(data, np.uint8)
        if not len(raw):
            continue
        gap = SPACE[raw]
        edge = np.diff(np.concatenate([[True], gap, [True]]).view(np.int8))
        start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        if not len(start):
            continue
        stop = ENDS[raw] & np.append(gap[1:], True) | (raw == 10)
        sentence = done + np.concatenate([[0], np.cumsum(stop)])[start]
        done = int(sentence[-1]) + 1
        doc = np.array(docs)[np.searchsorted(at, start, side="right") - 1]
        held = np.concatenate([[0], np.cumsum(KEPT[raw])])
        compact = np.frombuffer(data.translate(None, PUNCTUATION) + b" ", np.uint8)
        sets = pair_sets(compact, (held + np.concatenate([[0], np.cumsum(gap)]))[start])
        short = held[end] - held[start] <= 2
        same = np.concatenate([[False], (sentence[1:] == sentence[:-1]) & short[1:] & short[:-1]])
        first = np.flatnonzero(~same)
        stretch = np.diff(np.append(first, len(same)))
        run, stretch = first[stretch >= 3], stretch[stretch >= 3]
        # runs are tested as the kernel sees them, without the blanks and marks between their letters
        letters = data.translate(None, DROPPED)
        spelled = [letters[a:b] for a, b in zip(held[start[run]].tolist(), held[end[run + stretch - 1]].tolist())]
        joined = pair_sets_of(spelled)
        pick = np.flatnonzero(near(sets) if near else np.ones(len(start), bool))
        runs = np.flatnonzero(near(joined) if near else np.ones(len(run), bool))
        words = [data[a:b].translate(None, DROPPED) for a, b in zip(start[pick].tolist(), end[pick].tolist())]
        words += [spelled[i] for i in runs.tolist()]
        where = np.concatenate([pick, run[runs]])
        yield doc[where], sentence[where], words


WORST = 3


def worst(doc: np.ndarray, strength: np.ndarray, n: int, bias: float) -> np.ndarray:
    """The strongest sentences of each of n documents, strongest first; ``bias`` where there are fewer."""
    out = np.full((n, WORST), bias)
    order = np.lexsort((-strength, doc))
    doc, strength = doc[order], strength[order]
    rank = np.arange(len(doc)) - np.searchsorted(doc, doc)
    for k in range(WORST):
        at = rank == k
        out[doc[at], k] = np.maximum(strength[at], bias)
    return -np.sort(-out, axis=1)


@dataclass
class Model:
    landmarks: Landmarks
    weight: np.ndarray  # of the kernel with each landmark: the machine's vector times the Nyström matrix
    bias: float
    curve: np.ndarray  # of the three worst sentences, and a constant
    memo: dict = field(default_factory=dict)

    def unit_scores(self, words: list[bytes], most: int = 300_000) -> np.ndarray:
        """The units' parts in the decision; known units are remembered, up to ``most`` of them."""
        if len(self.memo) > most:
            self.memo.clear()
        new = [w for w in dict.fromkeys(words) if w not in self.memo]
        if new:
            self.memo.update(zip(new, (self.landmarks.kernel(new) @ self.weight).tolist()))
        return np.fromiter(map(self.memo.__getitem__, words), np.float64, len(words))

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Probability-like score of each text."""
        top = np.full((len(texts), WORST), self.bias)
        for doc, sentence, words in units(texts, self.landmarks.near):
            if not len(words):
                continue
            kinds, at = np.unique(sentence, return_inverse=True)
            total = np.bincount(at, self.unit_scores(words), minlength=len(kinds)) + self.bias
            of = np.zeros(len(kinds), np.int64)
            of[at] = doc
            top = -np.sort(-np.concatenate([top, worst(of, total, len(texts), self.bias)], axis=1), axis=1)[:, :WORST]
        return 1 / (1 + np.exp(-np.clip(top @ self.curve[:-1] + self.curve[-1], -60, 60)))


def choose_landmarks(texts: list[bytes], toxic: np.ndarray, most: int, least: int, background: int) -> tuple[list[bytes], int]:
    """Units that explain toxic documents, best first, then harmless ones; and the number of the former."""
    held: list[set] = [set() for _ in texts]
    same: dict[bytes, bytes] = {}  # one object for each unit
    for doc, _, words in units(texts):
        for d, w in zip(doc.tolist(), words):
            if LENGTH <= len(w) <= LONGEST:
                held[d].add(same.setdefault(w, w))
    del same
    bad, good = Counter(), Counter()
    for d, words in enumerate(held):
        (bad if toxic[d] else good).update(words)
    ratio = max(1, toxic.sum()) / max(1, (~toxic).sum())
    worth = {w for w, n in bad.items() if n >= least and n > 3 * ratio * good[w]}
    held = [words & worth for words in held]
    weight, out = {d: 1.0 for d in range(len(texts)) if toxic[d]}, []
    while len(out) < most and worth:
        gain: dict[bytes, float] = dict.fromkeys(worth, 0.0)
        for d, x in weight.items():
            for w in held[d]:
                if w in gain:
                    gain[w] += x
        best = max(gain, key=lambda w: (gain[w] - 3 * ratio * good[w], w))
        if gain[best] - 3 * ratio * good[best] < least / 2:
            break
        out.append(best)
        worth.discard(best)
        for d in weight:  # what is explained counts half
            weight[d] *= 0.5 if best in held[d] else 1
    explaining = len(out)
    if out:  # harmless units that are most like the chosen ones
        marks, rest = Landmarks(out), sorted(w for w, n in good.items() if n >= least and w not in out)
        at = np.flatnonzero(marks.near(pair_sets_of(rest)))
        likeness = marks.kernel([rest[i] for i in at]).max(axis=1, initial=0) if len(at) else np.zeros(0)
        out = out + [rest[at[i]] for i in np.argsort(-likeness, kind="stable")[:background] if likeness[i] > 0]
    return out, explaining


def train_machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1e-4, steps: int = 50) -> tuple[np.ndarray, float]:
    """Linear support vector machine with squared hinge loss, by Newton steps over the rows within the
    margin; the bias is an unpenalised column."""
    w, n = weight / weight.sum(), x.shape[1] + 1
    ridge = np.diag(np.append(np.full(n - 1, penalty), 1e-9))
    blocks = [slice(lo, lo + 8192) for lo in range(0, len(x), 8192)]
    wide = lambda s: np.concatenate([x[s], np.ones((len(x[s]), 1))], axis=1, dtype=np.float64)
    v, inside = np.zeros(n), np.ones(len(x), bool)
    for _ in range(steps):
        left, right = ridge.copy(), np.zeros(n)
        for s in blocks:
            a = wide(s) * inside[s, None]
            aw = a * w[s, None]
            left += aw.T @ a
            right += aw.T @ y[s]
        v = np.linalg.solve(left, right)
        now = np.concatenate([y[s] * (wide(s) @ v) < 1 for s in blocks])
        if (now == inside).all():
            break
        inside = now
    return v[:-1], float(v[-1])


def train(texts: list[bytes], toxic: np.ndarray, most: int = 64, least: int | None = None, background: int = 16, rounds: int = 3) -> Model | None:
    """Fit on labelled documents; None if nothing tells the labels apart."""
    least = least or max(2, min(5, int(toxic.sum()) // 60))
    chosen, explaining = choose_landmarks(texts, toxic, most, least, background)
    if not chosen or toxic.all() or not toxic.any():
        return None
    marks = Landmarks(chosen)
    gram = marks.kernel(marks.units)
    value, vector = np.linalg.eigh((gram + gram.T) / 2)
    sound = value > 1e-6
    nystroem = vector[:, sound] / np.sqrt(value[sound])  # kernel with landmarks times this is the feature map
    rows: dict[tuple[int, int], np.ndarray] = {}
    for doc, sentence, words in units(texts, marks.near):
        kinds, at = np.unique(np.array(words, object), return_inverse=True) if words else ([], [])
        known = marks.kernel(list(kinds)).astype(np.float32)
        for key, i in zip(zip(doc.tolist(), sentence.tolist()), at):
            if known[i].any():
                rows[key] = rows.get(key, 0) + known[i]
    owner = np.array([d for d, _ in rows] + list(range(len(texts))))  # every document has a sentence without evidence
    x = np.zeros((len(owner), nystroem.shape[1]), np.float32)
    for i, k in enumerate(rows.values()):
        x[i] = k @ nystroem
    rows.clear()
    mark = toxic[owner]
    strength = x @ (nystroem.T @ gram[:, :explaining].sum(axis=1))
    for _ in range(rounds):
        strongest = _strongest(owner, strength, len(texts))
        used = np.concatenate([strongest[toxic], np.flatnonzero(~mark)])
        y = np.where(mark[used], 1.0, -1.0)
        # harmless documents count alike however many sentences they have, and both labels weigh the same
        size = np.bincount(owner[used], minlength=len(texts))[owner[used]]
        w = np.where(y > 0, 1 / toxic.sum(), 1 / size / (~toxic).sum())
        v, bias = train_machine(x[used], y, w)
        strength = x @ v + bias
    return Model(marks, nystroem @ v, bias, calibrate(worst(owner, strength, len(texts), bias), toxic))


def _strongest(owner: np.ndarray, strength: np.ndarray, n: int) -> np.ndarray:
    """The row of each document's strongest sentence."""
    order = np.lexsort((strength, owner))
    last = np.searchsorted(owner[order], np.arange(n), side="right") - 1
    return order[last]


def calibrate(level: np.ndarray, toxic: np.ndarray, steps: int = 300) -> np.ndarray:
    """Coefficients of a logistic curve over the levels, by Newton steps on smoothed labels."""
    p, n = toxic.sum(), (~toxic).sum()
    y = np.where(toxic, (p + 1) / (p + 2), 1 / (n + 2))
    a, b = np.concatenate([level, np.ones((len(level), 1))], axis=1), np.zeros(level.shape[1] + 1)
    for _ in range(steps):
        z = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        step = np.linalg.solve((a * (z * (1 - z))[:, None]).T @ a + 1e-3 * np.eye(len(b)), a.T @ (y - z) - 1e-3 * b)
        b = b + step * min(1, 2 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-9:
            break
    return b


def fold(doc_id):
    """The fold of a document: 1 is held out."""
    return F.crc32(doc_id.cast("string")) % 3


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int, most_bytes: int) -> list:
    """Texts and labels to learn from, at most ``rows`` of each label and half of ``most_bytes``, none of them held out."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1) and doc_id is not null")
    own = own.where(fold(F.col("doc_id")) != 1).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    take = [own.where(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for t in (0, 1)]
    chosen = materialise(take[0].unionByName(take[1]), "toxic-sample")
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text")).join(F.broadcast(chosen), "doc_id")
    texts = materialise(texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")), "toxic-texts")
    # sizes of the bounded sample alone are ranked
    earlier = Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    few = texts.select("doc_id", "toxic", F.octet_length("text").alias("size")).withColumn("all", F.sum("size").over(earlier)).where(F.col("all") <= most_bytes // 2).select("doc_id")
    return sorted((r.text, r.toxic) for r in texts.join(few, "doc_id").select("text", "toxic").toLocalIterator())


def fit(docs: DataFrame, labels: DataFrame, rows: int = 2000, most_bytes: int = 32 << 20) -> Model | None:
    """Learn from at most ``rows`` labelled documents of each label and ``most_bytes``; equal texts count once."""
    sample: dict[str, int] = {}
    for text, toxic in labelled_sample(docs, labels, rows, most_bytes):
        sample[text] = max(toxic, sample.get(text, 0))
    return train([t.encode() for t in sample], np.array(list(sample.values()), bool).reshape(-1)) if sample else None


def score(docs: DataFrame, model: Model | None, carry: tuple = ("doc_id",)) -> DataFrame:
    """The ``carry`` columns and ``score``, from 0 to 1."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # some dozen landmarks

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [bytes(t) for t in byte_rows(b.column(0))]
            out = sent.value.scores(texts) if sent.value is not None else np.zeros(len(texts))
            yield pa.record_batch([*b.columns[1:], pa.array(out)], names=[*b.schema.names[1:], "score"])

    rows = docs.select(text_of(docs).alias("text"), *[docs[c].alias(f"c{i}") for i, c in enumerate(carry)])
    kinds = [f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(carry)]
    return rows.mapInArrow(task, ", ".join([*kinds, "score double"])).toDF(*carry, "score")


def harmless(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, rows: int = 2000) -> DataFrame:
    """``docs`` without those scored ``threshold`` or more; all columns stay."""
    found = score(docs, fit(docs, labels, rows), tuple(docs.columns)).toDF(*[f"c{i}" for i in range(len(docs.columns))], "s")
    return found.where(F.col("s") < threshold).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
