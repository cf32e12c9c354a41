"""SimHash near-duplicates by the generalised pigeonhole principle.

The 64 bits are grouped into parts, correlated bits together.  Part i gets a threshold t_i with
sum(t_i + 1) = max_bits + 1, so two fingerprints within max_bits agree in some part up to t_i bits.  A part is
probed through keys that leave out t_i of its bits: values within t_i bits share a key.  Thresholds (-1: the
part is not probed) and the number of parts minimise the estimated cost by dynamic programming.

Defined results: null and empty texts have fingerprint zero, which is linked like any other; rows of equal
fingerprints are one class; a component of rows whose ids are all null has a null id; an empty table gives
no rows.  Every row comes out, repeated rows as often as they came.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_rows, materialise, text_of
from .components import components

BITS = 64
#: Cost of one probe row (shuffled and sorted) in verified pairs.
PROBE_COST = 500.0


def word_runs(data: bytes, overlap: int, size: int = 1 << 20) -> Iterator[list]:
    """The words of a text in bounded lists; each list starts with the last ``overlap`` words before it."""
    lo, tail = 0, []
    while lo < len(data):
        hi = data.find(b" ", lo + size)
        hi = len(data) if hi < 0 else hi
        words = tail + data[lo:hi].split()
        yield words
        tail = words[max(0, len(words) - overlap):] if overlap else []
        lo = hi


def fingerprint(data: bytes, shingle: int = 4, seed: int = 42) -> int:
    """The unsigned fingerprint of a text in UTF-8."""
    digest, total, count = xxhash.xxh64_intdigest, 0, np.zeros(BITS, np.int64)
    short: list = []
    for words in word_runs(data.lower(), shingle - 1):
        n = len(words) - shingle + 1
        if n <= 0:
            short = words
            continue
        joined = b" ".join(words)
        size = np.fromiter(map(len, words), np.int64, len(words))
        start = np.cumsum(size + 1) - size - 1
        ends = (start + size)[shingle - 1:].tolist()
        h = np.fromiter((digest(joined[a:b], seed) for a, b in zip(start[:n].tolist(), ends)), np.uint64, n)
        for lo in range(0, n, 1 << 15):
            bits = np.unpackbits(h[lo:lo + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            count += bits.sum(axis=0, dtype=np.uint32)
        total += n
    if not total:
        return digest(b" ".join(short), seed) if short else 0
    return int(np.packbits(2 * count > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = 4, seed: int = 42, carry: tuple = ("doc_id",)) -> DataFrame:
    """``carry`` columns and ``fp``, the fingerprint as a signed long."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(bytes(x), shingle, seed) for x in byte_rows(b.column(0))], np.uint64).view(np.int64)
            yield pa.record_batch([*b.columns[1:], pa.array(fp, pa.int64())], names=[*b.schema.names[1:], "fp"])

    rows = docs.select(text_of(docs, text).alias("text"), *[docs[c].alias(f"c{i}") for i, c in enumerate(carry)])
    kinds = ", ".join(f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(carry))
    out = rows.mapInArrow(task, ", ".join([*([kinds] if kinds else []), "fp long"]))
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)], "fp")


def bit_counts(prints: DataFrame) -> np.ndarray:
    """64 x 64 counts of fingerprints in which both bits are set, over the whole table."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS, BITS))
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False).astype("<i8")
            bits = np.unpackbits(fp.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            for lo in range(0, len(bits), 1 << 14):
                total += bits[lo:lo + (1 << 14)].T @ bits[lo:lo + (1 << 14)]
        i, j = np.indices((BITS, BITS))
        yield pa.record_batch([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(total.ravel().astype(np.int64))], names=["i", "j", "n"])

    out = np.zeros((BITS, BITS))
    for r in prints.select("fp").mapInArrow(task, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect():
        out[r.i, r.j] = r.n
    return out


def group_bits(both: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """Parts of nearly equal size; each grows by the bit most correlated with it."""
    p = np.diag(both) / n
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(both / n - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(corr, 0)
    left, out = list(range(BITS)), []
    for k in range(parts, 0, -1):
        part = [max(left, key=lambda i: (corr[i, left].sum(), -i))]
        left.remove(part[0])
        while len(part) < -(-(len(left) + len(part)) // k):
            part.append(best := max(left, key=lambda i: (corr[i, part].sum(), -i)))
            left.remove(best)
        out.append(sorted(part))
    return out


def within(differ: np.ndarray, most: int) -> np.ndarray:
    """Chances that at most 0..most of the bits differ, from each bit's chance."""
    d = np.zeros(len(differ) + 1)
    d[0] = 1
    for q in differ:
        d[1:] = d[1:] * (1 - q) + d[:-1] * q
        d[0] *= 1 - q
    return np.cumsum(d)[:most + 1]


def allocate(cost: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds with sum(t + 1) = total of the least cost; cost[i][t + 1] is that of part i at t."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for part in cost:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (c, ts) in best.items():
            for k, more in enumerate(part):
                if used + k <= total and (used + k not in step or c + more < step[used + k][0]):
                    step[used + k] = (c + more, [*ts, k - 1])
        best = step
    return best.get(total, (float("inf"), []))


def choose_parts(prints: DataFrame, n: int, max_bits: int, most_parts: int = 6) -> tuple[list[list[int]], list[int]]:
    """Bits and threshold of each part.  Pairs that agree in a whole part are counted over all rows; the
    growth of their number with the threshold follows from the bits' own chances to differ."""
    both = bit_counts(prints)
    p = np.diag(both) / n
    plans = {m: group_bits(both, n, m) for m in range(2, min(most_parts, max_bits + 2) + 1)}
    values = [F.struct(F.lit(m * 100 + i).alias("part"), part_value("fp", bits).alias("v")) for m, parts in plans.items() for i, bits in enumerate(parts)]
    sizes = prints.select(F.explode(F.array(*values)).alias("x")).groupBy("x.part", "x.v").count()
    equal = {r.part: float(r.pairs) for r in sizes.groupBy("part").agg(F.sum(F.expr("cast(count as double) * (count - 1) / 2")).alias("pairs")).collect()}
    best = (float("inf"), [], [])
    for m, parts in plans.items():
        cost = []
        for i, bits in enumerate(parts):
            near = within(2 * p[bits] * (1 - p[bits]), max_bits)
            grow = near / max(near[0], 1e-300)
            cost.append([0.0] + [PROBE_COST * n * comb(len(bits), t) + equal.get(m * 100 + i, 0.0) * grow[t] + n * n / 2 * (near[t] - near[0]) * (t > 0) for t in range(min(max_bits, len(bits) - 1) + 1)])
        total, ts = allocate(cost, max_bits + 1)
        if total < best[0]:
            best = (total, parts, ts)
    return best[1], best[2]


def mask_of(bits: list[int]) -> int:
    """The bits as a signed 64-bit mask."""
    return int(np.array([sum(1 << b for b in bits)], np.uint64).view(np.int64)[0])


def part_value(column: str, bits: list[int]):
    return F.col(column).bitwiseAND(F.lit(mask_of(bits)).cast("long"))


def probe_keys(prints: DataFrame, parts: list[list[int]], thresholds: list[int]) -> DataFrame:
    """``(mask, v, fp)``: for every part and every choice of t of its bits, the value of the others."""
    masks = [mask_of(sorted(set(bits) - set(out))) for bits, t in zip(parts, thresholds) if t >= 0 for out in combinations(bits, t)]
    keys = prints.select("fp", F.explode(F.array(*[F.lit(m).cast("long") for m in masks])).alias("mask"))
    return keys.select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("v"), "fp")


def near_pairs(keys: DataFrame, max_bits: int, block: int = 2000) -> DataFrame:
    """Links ``(a, b)`` between verified fingerprints, enough to connect all that are connected.

    Keys of more than ``block`` rows are cut into blocks, and every two blocks meet in a group of their own, so
    no group has more than about two blocks of rows.  A group gives links that span its connected sets
    instead of all its pairs."""
    sizes = keys.groupBy("mask", "v").agg(F.count("*").alias("n")).where("n > 1")
    sizes = materialise(sizes.select("mask", "v", F.ceil(F.col("n") / block).cast("int").alias("blocks")), "simhash-sizes")
    rows = keys.join(sizes, ["mask", "v"]).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select(F.xxhash64("mask", "v", F.least("own", "other"), F.greatest("own", "other")).alias("g"), (F.col("own") < F.col("other")).alias("low"), (F.col("own") > F.col("other")).alias("high"), "fp")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for b in batches:
            g, low, high, fp = (b.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            if kept is not None:
                g, low, high, fp = (np.concatenate(x) for x in zip(kept, (g, low, high, fp)))
            cut = int(np.searchsorted(g, g[-1])) if len(g) else 0  # the last group may go on
            kept = g[cut:], low[cut:], high[cut:], fp[cut:]
            if cut:
                yield links_of(g[:cut], low[:cut], high[:cut], fp[:cut], max_bits)
        if kept is not None and len(kept[0]):
            yield links_of(*kept, max_bits)

    dealt = rows.repartition("g").sortWithinPartitions("g")
    return dealt.mapInArrow(task, "a long, b long").distinct()


def links_of(g: np.ndarray, low: np.ndarray, high: np.ndarray, fp: np.ndarray, max_bits: int, small: int = 64) -> pa.RecordBatch:
    """Links of sorted groups.  Rows neither low nor high are a block met with itself."""
    fp, side = fp.astype(np.int64).view(np.uint64), high.astype(np.int8) - low.astype(np.int8)
    edge = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1], [True]]))
    size = np.diff(edge)
    a, b = [], []
    of_small = np.repeat(size <= small, size)
    for d in range(1, small):  # small groups: each row with the d-th behind it, all groups at once
        if not (size[size <= small] > d).any():
            break
        i = np.flatnonzero(of_small[:-d] & (g[:-d] == g[d:]))
        i = i[(np.bitwise_count(fp[i] ^ fp[i + d]) <= max_bits) & ((side[i] != side[i + d]) | (side[i] == 0))]
        a.append(fp[i])
        b.append(fp[i + d])
    for k in np.flatnonzero(size > small):
        x, s = fp[edge[k]:edge[k + 1]], side[edge[k]:edge[k + 1]]
        for root, members in spanning(x, s, max_bits):
            a.append(np.full(len(members), x[root]))
            b.append(x[members])
    a, b = (np.concatenate(v) if v else np.zeros(0, np.uint64) for v in (a, b))
    keep = a != b
    return pa.record_batch([pa.array(v[keep].view(np.int64)) for v in (np.minimum(a.view(np.int64), b.view(np.int64)).view(np.uint64), np.maximum(a.view(np.int64), b.view(np.int64)).view(np.uint64))], names=["a", "b"])


def spanning(x: np.ndarray, side: np.ndarray, max_bits: int) -> Iterator[tuple[int, np.ndarray]]:
    """Connected sets of one group, by breadth-first search over rows compared in blocks."""
    left = np.ones(len(x), bool)
    while left.any():
        root = int(np.argmax(left))
        left[root] = False
        front, members = np.array([root]), []
        while len(front):
            rest = np.flatnonzero(left)
            hit = np.zeros(len(rest), bool)
            for lo in range(0, len(front), 256):
                f = front[lo:lo + 256]
                near = np.bitwise_count(x[f][:, None] ^ x[rest][None, :]) <= max_bits
                hit |= (near & ((side[f][:, None] != side[rest][None, :]) | (side[f][:, None] == 0))).any(axis=0)
            front = rest[hit]
            left[front] = False
            members.append(front)
        found = np.concatenate(members)
        if len(found):
            yield root, found


def near_duplicates(docs: DataFrame, shingle: int = 4, max_bits: int = 4, seed: int = 42, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, fp, component_id`` for every row: its fingerprint and the smallest doc_id reachable over
    links of at most ``max_bits`` differing bits."""
    rows = materialise(fingerprints(docs.select(docs[doc_id].cast("long").alias("doc_id"), text_of(docs, text).alias("text")), "text", shingle, seed), "simhash")
    prints = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    n = prints.count()
    if n < 2:
        return rows.join(prints, "fp").select("doc_id", "fp", F.col("least").alias("component_id"))
    parts, thresholds = choose_parts(prints, n, max_bits)
    links = near_pairs(probe_keys(prints.select("fp"), parts, thresholds), max_bits)
    roots = materialise(components(links), "simhash-roots")
    known = materialise(prints.join(roots, prints.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "simhash-known")
    least = materialise(known.groupBy("root").agg(F.min("least").alias("component_id")), "simhash-least")
    classes = materialise(known.join(least, "root").select("fp", "component_id"), "simhash-classes")
    return rows.join(classes, "fp").select("doc_id", "fp", "component_id")
