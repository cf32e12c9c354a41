"""Substring deduplication with suffix automata of reference shards.

A window is a number of consecutive words; a window whose words also start earlier (in a document of smaller id, or before it in
the same document) is a copy, and all words that copies cover are removed.

* Texts of several documents are one class: all but the first of them are copies as a whole, and only the
  first is looked at further.
* Every window has an anchor, the least of its hashed word grams, so equal windows have equal anchors.  Anchors that
  occur only once can't lie in a copy; counting them leaves the passages that may repeat.
* Passages of one anchor meet in one reference shard.  An anchor with very many passages is too hot for that: its
  windows go to shards one by one, by a hash of the whole window.  So shards have a bounded number of passages.
* Each shard's distinct passages become a suffix automaton, written to the shared folder, so that every task which streams
  passages past the shard reads the same one.  The state that holds the last ``window`` words of the matching statistic
  knows where these words start first.  What starts later is a copy; maximal spans of copies are removed.

Automata run on the words themselves; hashes only decide what meets where.

Defined results: null and empty texts have no words; documents with fewer words than a window lose none; rows of one id
are one document, so windows at the same place of equal texts of one id are not copies of each other, while equal
windows at different places, also of different texts of one id, are; null ids are one document behind
all others; rows come out as often as they came; an empty table gives no rows.
"""

from __future__ import annotations

import gc
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import byte_rows, filesystem, materialise, shared_dir, text_of, write_whole

GRAM = 6
HOT = 2000  # passages of an anchor that may meet in one shard
SHARD = 2000  # distinct passages of a shard, on average
SLICE = 1 << 20  # bytes of text that are numbered together
BLANK = re.compile(rb"[\x20\x09-\x0D]")
FACTOR = np.uint64(0x9E3779B97F4A7C15)
NO_ID = (1 << 63) - 1  # null ids come last


def slices(data: bytes, window: int) -> Iterator[tuple[int, bytes]]:
    """Bounded parts of a text, each with its first word's place; a part starts with the last ``window - 1`` words
    of the one before."""
    at, lo, before = 0, 0, b""
    while lo < len(data):
        cut = BLANK.search(data, lo + SLICE) if lo + SLICE < len(data) else None
        hi = cut.start() if cut else len(data)
        yield at, before + data[lo:hi]
        if hi < len(data):
            words = (before + data[lo:hi]).split()
            keep = min(len(words), window - 1)
            at, before = at + len(words) - keep, b"".join(w + b" " for w in words[len(words) - keep:])
        lo = hi


_POWERS: list = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of ``FACTOR`` and of its inverse modulo 2^64."""
    if len(_POWERS[0]) < n:
        for i, base in enumerate((int(FACTOR), pow(int(FACTOR), -1, 1 << 64))):
            steps = np.full(2 * n, base, np.uint64)
            steps[0] = 1
            _POWERS[i] = np.multiply.accumulate(steps)
    return _POWERS[0][:n], _POWERS[1][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(29))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


def run_hashes(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Numbers of the runs ``values[lo:hi]``, alike for equal runs wherever they are."""
    up, down = powers(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values.astype(np.uint64) * up[1:], out=total[1:])
    return mixed((total[hi] - total[lo]) * down[lo] + (hi - lo).astype(np.uint64))


#: The bytes that part words.
PARTS = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def least_places(g: np.ndarray, width: int) -> np.ndarray:
    """For every place the first place of the least of ``width`` numbers from there on (fewer at the end)."""
    value, place, have = g.copy(), np.arange(len(g), dtype=np.int32), 1
    while have < width:
        step = min(have, width - have)
        n = max(0, len(value) - step)
        take = value[step:] < value[:n]
        value[:n] = np.where(take, value[step:], value[:n])
        place[:n] = np.where(take, place[step:], place[:n])
        have += step
    return place


@dataclass
class Runs:
    """Runs of windows that share an anchor, of a part of some texts: for each its text, its first window's place there, its
    anchor's number, its first word in ``data`` and the number of its windows.  ``start`` and ``end`` are the words' bytes."""
    data: bytes
    start: np.ndarray
    end: np.ndarray
    hashes: np.ndarray
    text: np.ndarray
    at: np.ndarray
    anchor: np.ndarray
    first: np.ndarray
    size: np.ndarray

    def words(self, lo: int, n: int) -> bytes:
        return b" ".join(self.data[self.start[lo]:self.end[lo + n - 1]].split())


def runs_of(texts: list[bytes], window: int) -> Iterator[Runs]:
    parts, size = [], 0
    for k, text in enumerate(texts):
        for at, part in slices(text, window):
            parts.append((k, at, part))
            size += len(part)
            if size >= SLICE:
                yield _runs(parts, window)
                parts, size = [], 0
    if parts:
        yield _runs(parts, window)


def _runs(parts: list[tuple], window: int) -> Runs:
    data = b" ".join(p[2] for p in parts)
    byte = np.frombuffer(data, np.uint8)
    blank = PARTS[byte]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]])))
    start, end = edge[::2], edge[1::2]
    hashes = run_hashes(byte, start, end)
    size = np.array([len(p[2]) + 1 for p in parts])
    owner = np.searchsorted(np.cumsum(size), start, side="right")
    place = np.arange(len(start))
    grams = run_hashes(hashes, place, np.minimum(place + GRAM, len(start)))
    least = least_places(grams, window - GRAM + 1)
    whole = max(0, len(start) - window + 1)
    sound = np.flatnonzero(owner[:whole] == owner[window - 1:])
    edge = np.flatnonzero(np.concatenate([[True], least[sound][1:] != least[sound][:-1]])) if len(sound) else sound
    first = sound[edge]
    count = np.diff(np.concatenate([edge, [len(sound)]]))
    mine = owner[first]
    before = np.searchsorted(owner, mine)  # the first word of the part
    return Runs(data, start, end, hashes, np.array([p[0] for p in parts])[mine], np.array([p[1] for p in parts])[mine] + first - before, grams[least[first]].view(np.int64), first, count)


class Automaton:
    """A suffix automaton of passages (lists of word numbers).  ``origin`` holds for every state the passage and the end
    there of the first match that led to it."""

    def __init__(self):
        self.length, self.link, self.next, self.origin = [0], [-1], [{}], [(0, 0)]

    def _split(self, p: int, word: int, q: int) -> int:
        following, link = self.next, self.link
        clone = len(self.length)
        self.length.append(self.length[p] + 1)
        link.append(link[q])
        following.append(following[q].copy())
        self.origin.append(self.origin[q])
        link[q] = clone
        while p >= 0 and following[p].get(word) == q:
            following[p][word] = clone
            p = link[p]
        return clone

    def add(self, number: int, passage: list[int]) -> None:
        length, link, following, origin = self.length, self.link, self.next, self.origin
        last = 0
        for end, word in enumerate(passage):
            q = following[last].get(word)
            if q is not None:  # known from another passage
                last = q if length[q] == length[last] + 1 else self._split(last, word, q)
                continue
            state = len(length)
            length.append(length[last] + 1)
            link.append(0)
            following.append({})
            origin.append((number, end))
            p = last
            while p >= 0:
                q = following[p].get(word)
                if q is not None:
                    link[state] = q if length[q] == length[p] + 1 else self._split(p, word, q)
                    break
                following[p][word] = state
                p = link[p]
            last = state


class Shard:
    """An automaton for matching statistics, its vocabulary, and for each state of a window's words the first
    (document, word) where these start."""

    def __init__(self, vocabulary: dict, length: list, link: list, moves: dict, first: dict):
        self.vocabulary, self.length, self.link, self.moves, self.first = vocabulary, length, link, moves, first

    def window_states(self, words: bytes, window: int) -> Iterator[tuple[int, int]]:
        """Matching statistics: ``(start, state)`` for every place where the longest match has a window's length; the state
        is the one of the window's words alone."""
        moves, link, length, wide = self.moves.get, self.link, self.length, len(self.vocabulary)
        state, matched = 0, 0
        for end, word in enumerate(map(self.vocabulary.get, words.split(b" "))):
            if word is None:
                state = matched = 0
                continue
            to = moves(state * wide + word)
            while to is None and state:
                state = link[state]
                matched = length[state]
                to = moves(state * wide + word)
            if to is None:
                continue
            state = to
            matched += 1
            if matched >= window:
                while length[link[state]] >= window:
                    state = link[state]
                    matched = length[state]
                yield end - window + 1, state

    def copies(self, words: bytes, doc: int, at: int, window: int) -> int:
        """Bits of the windows of a passage at this place that start earlier elsewhere."""
        bits, first = 0, self.first
        for start, state in self.window_states(words, window):
            if first[state] < (doc, at + start):
                bits |= 1 << start
        return bits

    @classmethod
    def of(cls, passages: list[tuple[bytes, int, int]], window: int) -> tuple[Shard, Automaton]:
        """``passages``: words joined by blanks, the document's id and the place there, in the order of document and place."""
        vocabulary: dict[bytes, int] = {}
        made = Automaton()
        for i, (words, _, _) in enumerate(passages):
            made.add(i, [vocabulary.setdefault(w, len(vocabulary)) for w in words.split(b" ")])
        wide, length, link = len(vocabulary), made.length, made.link
        size, shorter = np.array(length), np.array(link)
        first = {}
        for state in np.flatnonzero((size >= window) & (size[shorter] < window)).tolist():
            i, end = made.origin[state]
            _, doc, at = passages[i]
            first[state] = doc, at + end - window + 1
        out = cls(vocabulary, length, link, {}, first)
        # texts of one id may overlap; then what was added first needn't start first
        late = [i for i in range(1, len(passages)) if passages[i][1] == passages[i - 1][1] and passages[i][2] < passages[i - 1][2] + window]
        if late:
            docs = {passages[i][1] for i in late}
            out.moves = {state * wide + word: to for state, following in enumerate(made.next) for word, to in following.items()}
            for words, doc, at in passages:
                if doc in docs:
                    for start, state in out.window_states(words, window):
                        first[state] = min(first[state], (doc, at + start))
        return out, made

    def write(self, made: Automaton, sink) -> None:
        """Transitions, states, words and first places as Arrow streams.  Most transitions lead to the next state, so
        differences are small numbers that compress well."""
        n = np.fromiter(map(len, made.next), np.int32, len(made.next))
        source = np.repeat(np.arange(len(n), dtype=np.int32), n)
        flat = lambda values: np.fromiter(chain.from_iterable(map(values, made.next)), np.int32, len(source))
        state = np.fromiter(self.first, np.int32, len(self.first))
        doc, at = (np.fromiter((x[i] for x in self.first.values()), np.int64, len(state)) for i in (0, 1))
        for t in (pa.table({"word": flat(dict.keys), "step": flat(dict.values) - source}), pa.table({"moves": n, "grown": np.diff(np.array(self.length, np.int32), prepend=np.int32(0)), "link": np.array(self.link, np.int32)}),
                  pa.table({"word": pa.array(list(self.vocabulary), pa.binary())}), pa.table({"state": np.diff(state, prepend=np.int32(0)), "doc": np.diff(doc, prepend=np.int64(0)), "at": np.diff(at, prepend=np.int64(0))})):
            buffer = pa.BufferOutputStream()
            with pa.ipc.new_stream(buffer, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_table(t)
            body = buffer.getvalue()
            sink.write(len(body).to_bytes(8, "little"))
            sink.write(body)

    @classmethod
    def read(cls, source) -> Shard:
        tables = []
        for _ in range(4):
            size = int.from_bytes(source.read(8), "little")
            tables.append(pa.ipc.open_stream(pa.py_buffer(source.read(size))).read_all())
        moves, states, words, first = tables
        vocabulary = {w: i for i, w in enumerate(words["word"].to_pylist())}
        n = states["moves"].to_numpy()
        state = np.repeat(np.arange(len(n)), n)
        key, target = state * len(vocabulary) + moves["word"].to_numpy(), state + moves["step"].to_numpy()
        at, doc, place = (np.cumsum(first[c].to_numpy()).tolist() for c in ("state", "doc", "at"))
        return cls(vocabulary, np.cumsum(states["grown"].to_numpy()).tolist(), states["link"].to_numpy().tolist(), dict(zip(key.tolist(), target.tolist())), dict(zip(at, zip(doc, place))))


def batch_of(columns: list, names: list[str]) -> pa.RecordBatch:
    return pa.record_batch([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names)


def anchors(texts: DataFrame, window: int) -> DataFrame:
    """``h, k, n``: the anchors of each text and how often it has them; of one that it has twice, there is a
    second row of a text ``~k``, so that an anchor is repeated where its texts differ."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = b.column(0).to_numpy()
            for found in runs_of([bytes(t) for t in byte_rows(b.column(1))], window):
                order = np.lexsort((found.anchor, found.text))
                h, k = found.anchor[order], found.text[order]
                edge = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (k[1:] != k[:-1])])) if len(h) else np.zeros(0, np.int64)
                n = np.diff(np.concatenate([edge, [len(h)]]))
                h, k = h[edge], key[k[edge]]
                twice = n > 1
                h, k, n = np.concatenate([h, h[twice]]), np.concatenate([k, ~k[twice]]), np.concatenate([n, np.zeros(int(twice.sum()), np.int64)])
                for lo in range(0, len(h), 65_536):
                    s = slice(lo, lo + 65_536)
                    yield batch_of([h[s], k[s], n[s]], ["h", "k", "n"])

    return texts.select("k", "text").mapInArrow(task, "h long, k long, n long")


def passages(texts: DataFrame, window: int) -> DataFrame:
    """``g, d, size, words, doc, k, k1, at`` of ``texts(k, k1, doc, text, anchors, hot)``: every run of windows of a repeated
    anchor.  ``g`` says with whom it meets, ``d`` is a digest of its words; a task gives the words of a passage once."""

    def chosen(found: Runs, lists: list) -> np.ndarray:
        """The runs whose anchor is in their text's list."""
        text = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        flat = np.concatenate([*lists, np.zeros(0, np.int64)])
        wanted = np.unique(run_pairs(text, flat))
        mine = run_pairs(found.text, found.anchor)
        return np.flatnonzero(wanted[np.searchsorted(wanted, mine).clip(0, len(wanted) - 1)] == mine) if len(wanted) else np.zeros(0, np.int64)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given: set = set()
        for b in batches:
            key, key1, doc = (b.column(i).to_numpy() for i in range(3))
            some, hot = ([np.array(x or [], np.int64) for x in b.column(i).to_pylist()] for i in (4, 5))
            for found in runs_of([bytes(t) for t in byte_rows(b.column(3))], window):
                i, j = chosen(found, some), chosen(found, hot)
                step = np.arange(found.size[j].sum()) - np.repeat(np.cumsum(found.size[j]) - found.size[j], found.size[j])
                j = np.repeat(j, found.size[j])
                lo = np.concatenate([found.first[i], found.first[j] + step])
                size = np.concatenate([found.size[i], np.ones(len(j), np.int64)])
                at = np.concatenate([found.at[i], found.at[j] + step])
                text = np.concatenate([found.text[i], found.text[j]])
                d = run_hashes(found.hashes, lo, lo + size + window - 1).view(np.int64)
                g = np.concatenate([found.anchor[i], d[len(i):]])
                words = []
                for a, n, pair in zip(lo.tolist(), size.tolist(), zip(g.tolist(), d.tolist())):
                    new = pair not in given
                    if new:
                        if len(given) >= 1 << 19:
                            given.clear()
                        given.add(pair)
                    words.append(found.words(a, n + window - 1) if new else None)
                for s in (slice(x, x + 20_000) for x in range(0, len(lo), 20_000)):
                    yield batch_of([g[s], d[s], size[s].astype(np.int32), pa.array(words[s], pa.binary()), key[text[s]], key1[text[s]], doc[text[s]], at[s]], ["g", "d", "size", "words", "k", "k1", "doc", "at"])

    return texts.select("k", "k1", "doc", "text", "anchors", "hot").mapInArrow(task, "g long, d long, size int, words binary, k long, k1 long, doc long, at long")


def run_pairs(text: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Numbers of (text of a batch, anchor)."""
    return mixed(anchor.view(np.uint64) + text.astype(np.uint64) * FACTOR)


def by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """Batches sorted by their first column, the shard, cut into shards."""
    held, key = [], None
    for b in batches:
        if not b.num_rows:
            continue
        shard = b.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(shard[1:] != shard[:-1]) + 1).tolist(), len(shard)]
        for lo, hi in pairwise(cuts):
            if held and shard[lo] != key:
                yield int(key), held
                held = []
            key = shard[lo]
            held.append(b.slice(lo, hi - lo))
    if held:
        yield int(key), held


def write_automata(reference: DataFrame, window: int) -> DataFrame:
    """``shard, file``: the automata of ``reference(shard, words, doc, at)``."""
    folder = shared_dir(reference.sparkSession, "automata")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # automata hold no cycles
        for shard, parts in by_shard(batches):
            rows = [row for b in parts for row in zip(map(bytes, byte_rows(b.column(1))), b.column(2).to_pylist(), b.column(3).to_pylist())]
            file = f"{folder}/{shard % 1000:03d}/{shard}.arrow"
            made, automaton = Shard.of(rows, window)
            write_whole(file, lambda sink, made=made, automaton=automaton: made.write(automaton, sink))
            yield batch_of([pa.array([shard], pa.int64()), pa.array([file])], ["shard", "file"])

    rows = reference.select("shard", "words", "doc", "at").repartition("shard").sortWithinPartitions("shard", "doc", "at", "words")
    return rows.mapInArrow(task, "shard long, file string")


def stream(rows: DataFrame, window: int) -> DataFrame:
    """``g, d, doc, at, bits`` of ``rows(shard, file, g, d, words, doc, at)``: which windows of a passage are copies where it occurs first."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()
        held, name = None, None
        for b in batches:
            bits = []
            for file, words, doc, at in zip(b.column(1).to_pylist(), byte_rows(b.column(4)), b.column(5).to_pylist(), b.column(6).to_pylist()):
                if file != name:
                    fs, path = filesystem(file)
                    with fs.open_input_stream(path) as source:
                        held, name = Shard.read(source), file
                bits.append(held.copies(bytes(words), doc, at, window))
            yield batch_of([b.column(2), b.column(3), b.column(5), b.column(6), pa.array(bits, pa.int64())], ["g", "d", "doc", "at", "bits"])

    # a shard met by very many passages may be split; each part reads its automaton
    rows = rows.select("shard", "file", "g", "d", "words", "doc", "at").hint("rebalance", "shard").sortWithinPartitions("shard")
    return rows.mapInArrow(task, "g long, d long, doc long, at long, bits long")


def copied_spans(docs: DataFrame, window: int) -> DataFrame:
    """``k, k1, doc, spans``: of each text that has copied windows or several documents, its first document's id (``NO_ID``:
    null) and there the copied windows' runs as (first word, number of windows)."""
    classes = materialise(docs.groupBy("k", "k1").agg(F.min("doc").alias("doc"), F.max("doc").alias("last")), "substring-classes")
    texts = docs.select("k", "text")
    anchored = materialise(anchors(texts, window), "substring-anchored")
    counted = anchored.groupBy("h").agg(F.min("k").alias("a"), F.max("k").alias("b"), F.sum("n").alias("n"))
    repeated = materialise(counted.where("a <> b").select("h", (F.col("n") > HOT).alias("hot")), "substring-anchors")
    lists = anchored.where("n > 0").select("h", "k").join(repeated, "h").groupBy("k").agg(
        F.collect_set(F.when(~F.col("hot"), F.col("h"))).alias("anchors"), F.collect_set(F.when(F.col("hot"), F.col("h"))).alias("hot"))
    lists = materialise(lists, "substring-lists").join(classes.select("k", F.col("k1").alias("_k1"), F.col("doc").alias("_doc")), "k")
    first = docs.join(lists.hint("merge"), "k").where("k1 = _k1 and doc = _doc")
    found = materialise(passages(first, window), "substring-passages")

    where = F.min(F.struct("doc", "at"))
    distinct = found.groupBy("g", "d").agg(where.alias("first"), F.max("words").alias("words"), F.count("*").alias("n"))
    # single windows of a hot anchor may turn out to occur once
    met = F.sum("n").over(Window.partitionBy("g"))
    distinct = materialise(distinct.select("g", "d", "words", "first.doc", "first.at", met.alias("met")).where("met > 1").drop("met"), "substring-reference")
    shards = max(1, -(-distinct.count() // SHARD))
    reference = distinct.withColumn("shard", F.pmod(F.xxhash64("g"), F.lit(shards)))
    files = materialise(write_automata(reference, window), "substring-automata")
    copies = materialise(stream(reference.join(files, "shard"), window), "substring-copies")

    met = found.select("g", "d", "size", "k", "k1", "doc", "at").join(copies.select("g", "d", F.col("doc").alias("_doc"), F.col("at").alias("_at"), "bits"), ["g", "d"])
    # a passage that occurs before is copied as a whole
    bits = F.when((F.col("doc") == F.col("_doc")) & (F.col("at") == F.col("_at")), F.col("bits")).otherwise(F.expr("shiftleft(1L, size) - 1"))
    met = met.select("k", "k1", "doc", "at", bits.alias("bits")).where("bits <> 0").groupBy("k", "k1").agg(F.collect_set(F.struct("at", "bits")).alias("spans"))
    several = classes.where("last <> doc")
    told = classes.select("k", "k1", "doc").join(met, ["k", "k1"]).unionByName(several.select("k", "k1", "doc").join(met.select("k", "k1"), ["k", "k1"], "left_anti"), allowMissingColumns=True)
    return materialise(told, "substring-spans")


def deduplicate(docs: DataFrame, window: int = 20, carry: tuple = ("doc_id",), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The ``carry`` columns, ``n_words``, ``n_removed`` and ``kept``, the words that are left, joined by one blank."""
    if not GRAM <= window <= 50:
        raise ValueError(f"a window has {GRAM} to 50 words")
    kept = [f"c{i}" for i in range(len(carry))]
    rows = docs.select(F.coalesce(docs[doc_id].cast("long"), F.lit(NO_ID)).alias("doc"), text_of(docs, text).alias("text"), *[docs[c].alias(k) for c, k in zip(carry, kept)])
    rows = rows.withColumns({"k": F.xxhash64("text"), "k1": F.xxhash64(F.lit(1), "text")})
    spans = copied_spans(rows.select("doc", "text", "k", "k1"), window).withColumnRenamed("doc", "_doc")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total, removed, left = [], [], []
            for text_, doc, first, found in zip(byte_rows(b.column(0)), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                words = bytes(text_).split()
                gone = np.zeros(len(words) + 1, np.int64)
                if first is not None and doc != first:  # a later document of the same text
                    gone[0] = len(words) >= window
                for span in found or [] if doc == first else []:
                    at, bits = span["at"], span["bits"]
                    for i in range(bits.bit_length()):
                        if bits >> i & 1:
                            gone[at + i] += 1
                            gone[at + i + window] -= 1
                drop = np.cumsum(gone[:-1]) > 0
                total.append(len(words))
                removed.append(int(drop.sum()))
                left.append(b" ".join(words[i] for i in np.flatnonzero(~drop).tolist()) if removed[-1] else b" ".join(words))
            yield batch_of([*b.columns[4:], pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(left, pa.binary()).cast(pa.string())], [*b.schema.names[4:], "n_words", "n_removed", "kept"])

    told = rows.join(spans.hint("merge"), ["k", "k1"], "left").select("text", "doc", "_doc", "spans", *kept)
    kinds = [f"{k} {docs.schema[c].dataType.simpleString()}" for k, c in zip(kept, carry)]
    out = told.mapInArrow(task, ", ".join([*kinds, "n_words long, n_removed long, kept string"]))
    return out.select(*[F.col(k).alias(c) for k, c in zip(kept, carry)], "n_words", "n_removed", "kept")
