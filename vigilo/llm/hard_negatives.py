"""Hard-negative mining by threshold joins over inverted indexes with suffix-norm bounds.

Anchors are a stated query set; they are written once to the shared folder and stream past every block of vectors.  A block
holds an inverted index of its vectors: dimensions in the order of their weight in the block, and of each vector only the
leading ones.  The suffix that is left out is the longest one whose norm, times the largest norm that an anchor has
there, stays below the least threshold asked for: without an indexed dimension no vector reaches it.  A search
adds up partial scores over the index, strip of dimensions by strip, and drops a pair as soon as its partial score
and the product of the norms that remain on both sides are below the anchor's threshold.  What is left gets its exact
score.

Thresholds start high and are lowered in rounds until the windows are full: first until every anchor has its
positives, then until every (anchor, positive) has its negatives or its window's lower end is reached.  A round takes only
anchors whose windows are open.  A block gives at most the first few rows for each window, so what is shuffled is
bounded by the blocks, whatever the number of ties or copies.

Scores are integer inner products, exact at any size: blocks whose sums could pass 2^53 are added up as whole numbers
without bounds; scores beyond a long are cut to its ends.

Defined results: rows take no part that have a null id, a null label, a null vector or a null or non-finite component;
vectors of different lengths don't meet; rows that repeat an id are rows of their own (each may be an anchor, a
positive of the other, or a negative), ties beyond score and id in an order fixed by the stored rows; an anchor without
positives, or without rows in a window, gives no rows for it; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.dataset as pads
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import filesystem, materialise, shared_dir

STRIP = 16  # dimensions added up between two tests
BLOCK_ROWS = 32_768
ANCHOR_ROWS = 512
TILE = 64  # anchors that are searched together
EXACT = float(1 << 53)
LONG = (1 << 63) - 1
#: Thresholds of the rounds: shares of an anchor's own squared norm for positives; for negatives of the way from the
#: upper to the lower end of the lowest open window.
POSITIVE_ROUNDS = (0.8, 0.4, 0.1, None)
NEGATIVE_ROUNDS = (0.25, 1.0)


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length of whole numbers given as doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def tail_norms(x: np.ndarray) -> np.ndarray:
    """Norms of the rows' suffixes at the strips' starts, and 0 behind the last."""
    sums = np.add.reduceat(x * x, np.arange(0, x.shape[1], STRIP), axis=1) if x.shape[1] else np.zeros((len(x), 0))
    return np.sqrt(np.concatenate([np.cumsum(sums[:, ::-1], axis=1)[:, ::-1], np.zeros((len(x), 1))], axis=1))


@dataclass
class Index:
    """Some vectors of one length.  Rows are sorted by how many strips of them are indexed, most first, so a strip's
    posting list is the first ``posted[strip]`` rows."""
    key: np.ndarray
    vec_id: np.ndarray
    label: np.ndarray
    x: np.ndarray
    order: np.ndarray = field(init=False)
    norms: np.ndarray = field(init=False)
    pairs: int = 0
    products: int = 0

    def __post_init__(self):
        weight = (self.x * self.x).sum(axis=0)
        self.order = np.argsort(-weight, kind="stable")
        self.x = np.ascontiguousarray(self.x[:, self.order])
        self.norms = tail_norms(self.x)

    def post(self, largest: np.ndarray, least: float) -> None:
        """Index for searches of thresholds from ``least`` on by anchors whose suffixes have norms up to ``largest``."""
        needed = self.norms * largest >= least if np.isfinite(least) else np.ones_like(self.norms, bool)
        strips = np.where(needed.any(axis=1), needed.shape[1] - np.argmax(needed[:, ::-1], axis=1), 0).clip(0, self.norms.shape[1] - 1)
        rows = np.argsort(-strips, kind="stable")
        for name in ("key", "vec_id", "label", "x", "norms"):
            setattr(self, name, getattr(self, name)[rows])
        strips = strips[rows]
        self.strips = strips
        self.posted = np.array([int((strips > s).sum()) for s in range(self.norms.shape[1] - 1)], np.int64)

    def search(self, q: np.ndarray, least: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each anchor the rows whose score is at least its threshold, and their scores as whole numbers."""
        q = q[:, self.order]
        bound = float(np.abs(q).max(initial=0)) * float(np.abs(self.x).max(initial=0)) * max(1, q.shape[1])
        if not bound < EXACT:
            whole = [[int(v) for v in row] for row in self.x.tolist()]
            for a in range(len(q)):
                mine = [int(v) for v in q[a].tolist()]
                score = np.array([min(LONG, max(-LONG - 1, sum(map(int.__mul__, mine, row)))) for row in whole], object)
                near = np.array([s >= least[a] for s in score.tolist()], bool)
                yield a, np.flatnonzero(near), score[near]
            return
        self.pairs += len(q) * len(self.x)
        norms = tail_norms(q)
        part = np.zeros((len(q), len(self.x)))
        alive = np.ones(part.shape, bool)
        slack = 1e-9 * bound + 1e-9
        for s, n in enumerate(self.posted.tolist()):
            rows = np.flatnonzero(alive[:, :n].any(axis=0))
            if len(rows):
                at = slice(s * STRIP, (s + 1) * STRIP)
                part[:, rows] += q[:, at] @ self.x[rows, at].T
                self.products += len(q) * len(rows)
            # rows whose indexed part ends before have nothing but their suffix left
            seen = slice(0, n)
            alive[:, seen] &= part[:, seen] + norms[:, s + 1:s + 2] * self.norms[seen, s + 1] >= least[:, None] - slack
        for a in range(len(q)):
            rows = np.flatnonzero(alive[a] & (part[a] + norms[a, self.strips] * self.norms[np.arange(len(self.x)), self.strips] >= least[a] - slack))
            score = self.x[rows] @ q[a]
            near = score >= least[a]
            yield a, rows[near], score[near].astype(np.int64)


def first_rows(score: np.ndarray, vec_id: np.ndarray, key: np.ndarray, most: int) -> np.ndarray:
    """The first ``most`` by score, then id, then row."""
    if len(score) > 4 * most and score.dtype != object:
        worst = np.partition(-score, most - 1)[most - 1]
        few = np.flatnonzero(-score <= worst)
    else:
        few = np.arange(len(score))
    return few[np.lexsort((key[few], vec_id[few], -score[few].astype(object) if score.dtype == object else -score[few]))[:most]]


def blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[Index]:
    """Indexes of bounded numbers of rows, each of vectors of one length."""

    def made(parts: list[pa.RecordBatch]) -> Iterator[Index]:
        whole = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        dims = whole.column(3).value_lengths().to_numpy()
        for d in np.unique(dims):
            b = whole.take(pa.array(np.flatnonzero(dims == d)))
            yield Index(b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy(), matrix(b.column(3)))

    held, n = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            n += b.num_rows
        if n >= BLOCK_ROWS:
            yield from made(held)
            held, n = [], 0
    if held:
        yield from made(held)


def anchor_blocks(folder: str) -> Iterator[pa.RecordBatch]:
    fs, path = filesystem(folder)
    for b in pads.dataset(path, filesystem=fs, format="parquet").to_batches(batch_size=ANCHOR_ROWS, fragment_readahead=1, batch_readahead=1):
        if b.num_rows:
            yield b


def threshold_join(vectors: DataFrame, anchors: DataFrame, windows: bool, most: int) -> DataFrame:
    """Of every anchor, and block of vectors, the first ``most`` rows at its threshold ``least`` or above.

    Without windows these are other rows of the anchor's label: ``anchor, score, key, vec_id``.  With them ``anchors`` has arrays
    ``positive, low, high``, and rows of other labels are given for each positive whose window they lie in."""
    folder = shared_dir(vectors.sparkSession, "anchors")
    columns = ["key", "label", "least", "vector", *(["positive", "low", "high"] if windows else [])]
    anchors.select(*columns).write.option("compression", "zstd").parquet(folder)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for index in blocks_of(batches):
            dim = index.x.shape[1]
            for block in anchor_blocks(folder):
                block = block.filter(pa.array(block.column("vector").value_lengths().to_numpy() == dim))
                if not block.num_rows:
                    continue
                out = []
                q, least = matrix(block.column("vector")), block.column("least").to_numpy(zero_copy_only=False)
                key, label = block.column("key").to_numpy(), block.column("label").to_numpy()
                wanted = list(zip(*(block.column(c).to_pylist() for c in ("positive", "low", "high")))) if windows else None
                index.post(tail_norms(q[:, index.order]).max(axis=0), float(least.min()))
                for lo in range(0, len(q), TILE):
                    for a, rows, score in index.search(q[lo:lo + TILE], least[lo:lo + TILE]):
                        a += lo
                        if not windows:
                            fit = (index.label[rows] == label[a]) & (index.key[rows] != key[a])
                            found = [(key[a], 0, fit)]
                        else:
                            other = index.label[rows] != label[a]
                            found = [(key[a], p, other & (score >= low).astype(bool) & (score <= high).astype(bool)) for p, low, high in zip(*wanted[a])]
                        for k, p, fit in found:
                            at = np.flatnonzero(fit)
                            at = at[first_rows(score[at], index.vec_id[rows[at]], index.key[rows[at]], most)]
                            if len(at):
                                out.append((np.full(len(at), k), np.full(len(at), p), score[at].astype(np.int64), index.key[rows[at]], index.vec_id[rows[at]]))
                if out:
                    yield pa.record_batch([pa.array(np.concatenate(c)) for c in zip(*out)], names=["anchor", "positive", "score", "key", "vec_id"])

    found = vectors.select("key", "vec_id", "label", "vector").mapInArrow(task, "anchor long, positive long, score long, key long, vec_id long")
    place = Window.partitionBy("anchor", "positive").orderBy(F.desc("score"), "vec_id", "key")
    return found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= most)


def whole_vectors(rows: DataFrame, vec_id: str, label: str, vector: str, scale: int) -> DataFrame:
    """``key, vec_id, label, vector``: the rows that take part, their components floor(scale * x) as doubles."""
    sound = "vec_id is not null and label is not null and vector is not null and not exists(vector, x -> x is null or isnan(x) or abs(x) = double('infinity'))"
    out = rows.select(rows[vec_id].cast("long").alias("vec_id"), rows[label].cast("long").alias("label"), rows[vector].cast("array<double>").alias("vector")).where(sound)
    # floor(double) is a long in SQL, so numbers beyond one (whole already) stay as they are
    whole = F.transform("vector", lambda x: F.when(F.abs(x * scale) < float(1 << 53), F.floor(x * scale).cast("double")).otherwise(x * scale))
    return materialise(out.select(F.monotonically_increasing_id().alias("key"), "vec_id", "label", whole.alias("vector")), "negative-vectors")


def hard_negatives(vectors: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, low: tuple[int, int] = (50, 100), high: tuple[int, int] = (95, 100), scale: int = 256,
                   vec_id: str = "vec_id", label: str = "label", vector: str = "embedding") -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``: for every row whose id ``every`` divides and each of its
    first ``positives`` rows of its label, the first ``negatives`` rows of other labels whose score is between the shares ``low`` and
    ``high`` (fractions) of the positive's."""
    rows = whole_vectors(vectors, vec_id, label, vector, scale)
    anchors = materialise(rows.where(F.col("vec_id") % every == 0), "negative-anchors")
    own = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)

    open_, closed = anchors, []
    for share in POSITIVE_ROUNDS:
        least = F.lit(float("-inf")) if share is None else own * share
        found = materialise(threshold_join(rows, open_.withColumn("least", least), False, positives).select("anchor", "rank", "score", F.col("key").alias("positive"), F.col("vec_id").alias("positive_id")), "negative-positives")
        full = found.where(F.col("rank") == positives).select(F.col("anchor").alias("key"))
        if share is None:
            closed.append(found)
            break
        closed.append(found.join(full.withColumnRenamed("key", "anchor"), "anchor", "left_semi"))
        open_ = materialise(open_.join(full, "key", "left_anti"), "negative-open")
        if open_.isEmpty():
            break
    pairs = closed[0]
    for part in closed[1:]:
        pairs = pairs.unionByName(part)
    # an integer score s lies in a window if low * p <= s <= high * p; a window of a negative score is empty
    p = F.col("score").cast("decimal(20,0)")
    pairs = pairs.select("anchor", "positive", "positive_id", "score", F.ceil(p * low[0] / low[1]).cast("long").alias("low"), F.floor(p * high[0] / high[1]).cast("long").alias("high"))
    pairs = materialise(pairs.where("low <= high"), "negative-windows")

    found, open_ = [], pairs
    for share in NEGATIVE_ROUNDS:
        # the threshold is a whole number, so the lower end of the lowest window is met exactly
        floor = F.col("low") if share == 1.0 else F.greatest("low", F.floor(F.col("high") - (F.col("high").cast("double") - F.col("low")) * share))
        asked = open_.groupBy(F.col("anchor").alias("key")).agg(F.min(floor.cast("double")).alias("least"), F.collect_list(F.struct("positive", "low", "high")).alias("w"))
        asked = anchors.join(asked, "key").select("key", "label", "least", "vector", "w.positive", "w.low", "w.high")
        got = materialise(threshold_join(rows, asked, True, negatives).select("anchor", "positive", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")), "negative-found")
        if share == 1.0:
            found.append(got)
            break
        full = materialise(got.where(F.col("rank") == negatives).select("anchor", "positive"), "negative-full")
        found.append(got.join(full, ["anchor", "positive"], "left_semi"))
        open_ = materialise(open_.join(full, ["anchor", "positive"], "left_anti"), "negative-left")
        if open_.isEmpty():
            break
    mined = found[0]
    for part in found[1:]:
        mined = mined.unionByName(part)
    out = mined.join(pairs.select("anchor", "positive", "positive_id", F.col("score").alias("positive_score")), ["anchor", "positive"])
    out = out.join(anchors.select(F.col("key").alias("anchor"), F.col("vec_id").alias("anchor_id")), "anchor")
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
