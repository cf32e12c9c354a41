"""Benchmark decontamination with suffix arrays over shards of the training text.

Every task cuts its documents into shards, builds a suffix array of each shard's words and binary-searches
every suffix of the benchmark items in it, word by word.  That gives each suffix's longest verbatim match and
all its places; a match of at least a window's length (``window`` words, or the whole of a shorter item) hits
the document.  Words no item of the block has are one number that matches nothing, so suffixes that meet such a
word before a window could end are left out of the array.

The benchmark is written once to the shared folder and each task reads it in blocks of bounded size: nothing is
broadcast or collected, and documents are not shuffled.

Defined results: null and empty texts have no words and no hits; an item without words has no window; equal
item_ids are one item, null ids count as the id ``null``; repeated documents all come out; empty tables work.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.dataset as pads
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_rows, filesystem, shared_dir, text_of

#: Lower-cases A-Z and blanks every ASCII byte that is no letter or digit.
WORD_BYTES = bytes((c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32) for c in range(256))


def word_lists(data: bytes, size: int = 1 << 20) -> Iterator[list]:
    """The words of a text, in bounded lists."""
    data = data.translate(WORD_BYTES)
    lo = 0
    while lo < len(data):
        hi = data.find(b" ", lo + size)
        hi = len(data) if hi < 0 else hi
        yield data[lo:hi].split()
        lo = hi


@dataclass
class Block:
    """Benchmark items of bounded size.  ``words`` holds the items' word numbers (from 1), each item
    followed by a 0; ``room`` is the number of words from a place to its item's end."""
    ids: list[str]
    vocabulary: dict
    words: np.ndarray
    item: np.ndarray
    room: np.ndarray
    need: np.ndarray

    @classmethod
    def of(cls, ids: list[str], texts: list[bytes], window: int) -> Block:
        vocabulary: dict = {}
        parts, item, room, need = [], [], [], []
        for k, text in enumerate(texts):
            found = [vocabulary.setdefault(w, len(vocabulary) + 1) for part in word_lists(text) for w in part]
            n = len(found)
            parts.append(np.array([*found, 0], np.int32))
            item.append(np.full(n + 1, k, np.int32))
            room.append(np.arange(n, -1, -1))
            # words that a window starting here has: none where it would pass the item's end
            need.append(np.where(np.arange(n, -1, -1) >= min(window, max(n, 1)), min(window, n), 0))
        cat = lambda x, t: np.concatenate(x).astype(t) if x else np.zeros(0, t)
        return cls(ids, vocabulary, cat(parts, np.int32), cat(item, np.int32), cat(room, np.int64), cat(need, np.int64))


_BLOCKS: dict = {}


def blocks(folder: str, window: int, block_bytes: int) -> Iterator[Block]:
    """The benchmark in blocks; a worker keeps the last block it has read."""
    fs, path = filesystem(folder)
    ids, texts, size, k = [], [], 0, 0

    def made():
        key = (folder, window, k)
        if key not in _BLOCKS:
            _BLOCKS.clear()
            _BLOCKS[key] = Block.of(ids, texts, window)
        return _BLOCKS[key]

    for batch in pads.dataset(path, filesystem=fs, format="parquet").to_batches(columns=["item_id", "text"], batch_size=1000, fragment_readahead=1, batch_readahead=1):
        for i, t in zip(batch.column(0).to_pylist(), byte_rows(batch.column(1))):
            ids.append(i)
            texts.append(bytes(t))
            size += len(t)
            if size >= block_bytes:
                yield made()
                ids, texts, size, k = [], [], 0, k + 1
    if ids:
        yield made()


def suffix_array(words: np.ndarray, least: int, depth: int) -> np.ndarray:
    """Places of ``words`` that lie in a run of at least ``least`` non-zero words, in the order of
    the words from there to the run's end (as far as ``depth`` words), by prefix doubling."""
    known = words > 0
    edge = np.flatnonzero(np.diff(np.concatenate([[0], known.view(np.int8), [0]])))
    start, end = edge[::2], edge[1::2]
    long = end - start >= least
    start, end = start[long], end[long]
    size = end - start
    place = np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())
    if not len(place):
        return place
    rest = np.repeat(end, size) - place
    rank = words[place].astype(np.int64)
    k = 1
    while True:
        order = np.argsort(rank, kind="stable")
        ranked = rank[order]
        dense = np.cumsum(np.concatenate([[1], ranked[1:] != ranked[:-1]]))
        rank = np.empty(len(place), np.int64)
        rank[order] = dense
        if dense[-1] == len(place) or k >= depth:
            return place[order]
        follow = np.where(rest > k, rank[np.minimum(np.arange(len(place)) + k, len(place) - 1)], 0)
        rank = rank * (len(place) + 1) + follow
        k *= 2


def search(words: np.ndarray, array: np.ndarray, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For every place of the block's items: length and range in ``array`` of its longest match, and the
    range of its window's matches (empty: none)."""
    n = len(block.words)
    lo, hi = np.zeros(n, np.int64), np.full(n, len(array))
    best, window_lo, window_hi = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    active, depth = np.flatnonzero(block.room > 0) if len(array) else np.zeros(0, np.int64), 0
    padded = np.concatenate([words, [0]])

    def bound(a, b, target, after):
        """First place in [a, b) whose word at this depth is at least (after: over) the target."""
        a, b = a.copy(), b.copy()
        while True:
            open_ = a < b
            if not open_.any():
                return a
            mid = (a + b) >> 1
            w = padded[np.minimum(array[np.minimum(mid, len(array) - 1)] + depth, len(words))]
            up = open_ & ((w <= target) if after else (w < target))
            a = np.where(up, mid + 1, a)
            b = np.where(open_ & ~up, mid, b)

    while len(active):
        target = block.words[active + depth]
        a = bound(lo[active], hi[active], target, False)
        b = bound(a, hi[active], target, True)
        found = a < b
        active, a, b = active[found], a[found], b[found]
        lo[active], hi[active] = a, b
        depth += 1
        best[active] = depth
        whole = block.need[active] == depth
        window_lo[active[whole]], window_hi[active[whole]] = a[whole], b[whole]
        active = active[block.room[active] > depth]
    return best, lo, hi, window_lo, window_hi


def spread(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the range and place in it, for all places of the ranges."""
    size = hi - lo
    owner = np.repeat(np.arange(len(lo)), size)
    return owner, np.repeat(lo - np.cumsum(size) + size, size) + np.arange(size.sum())


class Shard:
    """Some documents; hits of all blocks are gathered in it."""

    def __init__(self, texts: list[bytes]):
        self.texts = texts
        self.n_words = np.zeros(len(texts), np.int64)
        self.hit: np.ndarray | None = None
        self.items: list[set] = [set() for _ in texts]

    def numbers(self, block: Block) -> np.ndarray:
        """The words' numbers, each document followed by a 0."""
        get, parts = block.vocabulary.get, []
        for k, text in enumerate(self.texts):
            n = 0
            for words in word_lists(text):
                parts.append(np.fromiter(map(get, words, repeat(0)), np.int32, len(words)))
                n += len(words)
            self.n_words[k] = n
            parts.append(np.zeros(1, np.int32))
        return np.concatenate(parts) if parts else np.zeros(0, np.int32)

    def meet(self, block: Block) -> Iterator[tuple]:
        """Search a block; afterwards ``hit`` and ``items`` include it.  Gives the longest matches as
        (document, word, item, item word, length) with one place each."""
        words = self.numbers(block)
        end = np.cumsum(self.n_words + 1)
        if self.hit is None:
            self.hit = np.zeros(len(words), bool)
        need = block.need[block.need > 0]
        if not len(need):
            return
        array = suffix_array(words, int(need.min()), int(block.room.max()))
        best, lo, hi, window_lo, window_hi = search(words, array, block)
        with_hits = np.flatnonzero(window_hi > window_lo)
        if len(with_hits):
            a, b, need, item = window_lo[with_hits], window_hi[with_hits], block.need[with_hits], block.item[with_hits]
            kinds = np.unique(np.stack([a, b, need]), axis=1)  # windows with equal words are marked once
            owner, at = spread(kinds[0], kinds[1])
            cover = np.zeros(len(words) + 1, np.int64)
            np.add.at(cover, array[at], 1)
            np.add.at(cover, array[at] + kinds[2][owner], -1)
            self.hit |= np.cumsum(cover[:-1]) > 0
            for lo_, hi_ in zip(*(x.tolist() for x in self._chunks(b - a))):
                owner, at = spread(a[lo_:hi_], b[lo_:hi_])
                doc = np.searchsorted(end, array[at], side="right")
                for d, i in np.unique(np.stack([doc, item[lo_:hi_][owner]]), axis=1).T.tolist():
                    self.items[d].add(block.ids[i])
        for j in np.flatnonzero((best > 0) & (best >= np.where(block.need > 0, block.need, best.max() + 1))).tolist():
            p = int(array[lo[j]])
            d = int(np.searchsorted(end, p, side="right"))
            first = int(np.searchsorted(block.item, block.item[j]))
            yield d, p - int(end[d] - self.n_words[d] - 1), block.ids[block.item[j]], j - first, int(best[j])

    @staticmethod
    def _chunks(size: np.ndarray, most: int = 4_000_000) -> tuple[np.ndarray, np.ndarray]:
        """Stretches of ranges with about ``most`` places together."""
        cut = np.flatnonzero(np.diff(np.cumsum(size) // most, prepend=0)) if len(size) else np.zeros(0, np.int64)
        cut = np.unique(np.concatenate([[0], cut, [len(size)]]))
        return cut[:-1], cut[1:]

    def n_hit(self) -> np.ndarray:
        if self.hit is None:
            return np.zeros(len(self.texts), np.int64)
        total = np.concatenate([[0], np.cumsum(self.hit)])
        end = np.cumsum(self.n_words + 1)
        return total[end] - total[end - self.n_words - 1]


def benchmark_folder(benchmark: DataFrame) -> str:
    """The benchmark's items as a table in the shared folder."""
    folder = shared_dir(benchmark.sparkSession, "benchmark")
    rows = benchmark.select(F.coalesce(benchmark["item_id"].cast("string"), F.lit("null")).alias("item_id"), text_of(benchmark).alias("text"))
    rows.write.option("compression", "zstd").parquet(folder)
    return folder


def _shards(batches: Iterator[pa.RecordBatch], column: int, shard_bytes: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of batches with texts of about ``shard_bytes``; a longer text is alone."""
    for b in batches:
        texts, size, lo = [], 0, 0
        for i, t in enumerate(byte_rows(b.column(column))):
            if texts and size + len(t) > shard_bytes:
                yield b.slice(lo, i - lo), texts
                texts, size, lo = [], 0, i
            texts.append(bytes(t))
            size += len(t)
        if texts:
            yield b.slice(lo), texts


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, window: int = 10, carry: tuple = ("doc_id",), shard_bytes: int = 16 << 20, block_bytes: int = 16 << 20) -> DataFrame:
    """A row per document: the ``carry`` columns, ``n_words``, ``n_hit`` (words inside an occurrence of a
    window), ``item_ids`` (sorted strings of the items with occurring windows) and ``contaminated``."""
    folder = benchmark_folder(benchmark)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts in _shards(batches, 0, shard_bytes):
            shard = Shard(texts)
            seen = False
            for block in blocks(folder, window, block_bytes):
                seen = True
                for _ in shard.meet(block):
                    pass
            if not seen:
                shard.numbers(Block.of([], [], window))
            hit = shard.n_hit()
            yield pa.record_batch([*b.columns[1:], pa.array(shard.n_words), pa.array(hit), pa.array([sorted(x) for x in shard.items], pa.list_(pa.string())), pa.array(hit > 0)],
                                  names=[*b.schema.names[1:], "n_words", "n_hit", "item_ids", "contaminated"])

    return _mapped(docs, task, carry, ["n_words long", "n_hit long", "item_ids array<string>", "contaminated boolean"])


def longest_matches(docs: DataFrame, benchmark: DataFrame, window: int = 10, carry: tuple = ("doc_id",), shard_bytes: int = 16 << 20, block_bytes: int = 16 << 20) -> DataFrame:
    """For every shard and benchmark suffix whose window occurs in it: a row with a place of its longest
    verbatim match there (``doc_word``, ``item_id``, ``item_word``, ``length``), with the ``carry`` columns."""
    folder = benchmark_folder(benchmark)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts in _shards(batches, 0, shard_bytes):
            shard = Shard(texts)
            for block in blocks(folder, window, block_bytes):
                if found := list(shard.meet(block)):
                    doc, at, item, item_at, length = zip(*found)
                    rows = b.take(pa.array(doc))
                    yield pa.record_batch([*rows.columns[1:], pa.array(at, pa.int64()), pa.array(item), pa.array(item_at, pa.int64()), pa.array(length, pa.int64())],
                                          names=[*b.schema.names[1:], "doc_word", "item_id", "item_word", "length"])

    return _mapped(docs, task, carry, ["doc_word long", "item_id string", "item_word long", "length long"])


def _mapped(docs: DataFrame, task, carry: tuple, more: list[str]) -> DataFrame:
    """Run a task over the text and the carried columns; names that clash with the results' are kept apart."""
    rows = docs.select(text_of(docs).alias("text"), *[docs[c].alias(f"c{i}") for i, c in enumerate(carry)])
    kinds = [f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(carry)]
    out = rows.mapInArrow(task, ", ".join(kinds + more))
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)], *[m.split()[0] for m in more])


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """``docs`` without the documents in which a benchmark window occurs; all columns stay."""
    found = benchmark_hits(docs, benchmark, window, tuple(docs.columns))
    found = found.toDF(*[f"c{i}" for i in range(len(found.columns))])  # a document column may be called as a result
    kept = found.where(~F.col(f"c{len(found.columns) - 1}"))
    return kept.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
