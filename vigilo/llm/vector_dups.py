"""Near-duplicate vectors by sorted projection passes.

Every pass orders the vectors of a label by the concatenated bits of its own random hyperplanes, compares each
vector with the ``window`` before it and links verified pairs; links of all passes are united.  A pass also
measures, for each vector, how many leading bits tell its window from all other vectors of the label: a neighbour at
the threshold that shares these bits is met.  From that follows the chance that all passes so far have missed such a
neighbour.  Vectors with a chance of at most ``miss`` are settled; the others go through further rounds of
passes with wider windows, and where that would cost more than comparing all that are left of a label, they are
compared block against block.  A pair is lost only if both ends are settled without having met, so the bound holds
for crowded labels and hot groups as well.  A label that fits into one window is that window.

Windows are bounded, groups are not: the direct links of a vector are counted afterwards within its
component, so a group larger than the window loses none.  Of a large component the vectors within half the threshold's angle
of its centre link with each other by the triangle inequality, and are counted without being compared; only pairs with one
that lies farther out are, block against block.  Equal vectors of a label are one class from the start and
counted by their number.

Defined results: a vector that is null, all zero, or has a null or non-finite component, or whose label is null,
links with nothing and is its own component; vectors of different lengths don't link; repeated rows come out as
often as they came and link with each other; of a component without ids the id is null; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import acos, ceil, cos, erf, log, log2, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .components import components

SLACK = 1e-9


def unit_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of one length, and the same divided by their norms, in double precision."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    scale = np.abs(x).max(axis=1, keepdims=True)  # norms of very large or small vectors don't overflow
    scaled = x / scale
    return x, scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def linked(u: np.ndarray, v: np.ndarray, least: float) -> np.ndarray:
    """Which rows of u and v have a cosine of at least ``least``; doubtful ones are summed anew, pair by pair."""
    likeness = u @ v.T
    out = likeness >= least
    for i, j in zip(*np.nonzero(np.abs(likeness - least) < SLACK)):
        a, b = u[i], v[j]
        out[i, j] = float((a * b).sum()) / float(np.sqrt((a * a).sum()) * np.sqrt((b * b).sum())) >= least
    return out


def planes(dim: int, passes: int, bits: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, passes * bits))


def passes_for(largest: int, window: int, least: float, miss: float, fewest: int = 8) -> int:
    share = (1 - acos(least) / pi) ** max(0.0, log2(max(1, largest) / window))
    return max(fewest, ceil(log(miss) / log(max(1e-12, 1 - share))) if share < 1 else 0)


def shared_bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of equal leading bits of codes."""
    x = (a ^ b).view(np.uint64)
    high, low = np.frexp((x >> np.uint64(32)).astype(np.float64))[1], np.frexp((x & np.uint64(0xFFFFFFFF)).astype(np.float64))[1]
    return 64 - np.where(high > 0, 32 + high, low)


#: Standard normal distribution function at multiples of 1/256.
NORMAL = np.array([(1 + erf(i / 256 / sqrt(2))) / 2 for i in range(2049)])


def log_shared(u: np.ndarray, sides: np.ndarray, least: float) -> np.ndarray:
    """For each unit vector and number of leading bits, less one, the logarithm of the chance that a neighbour at the
    threshold shares them: a plane's product with the part of it that is orthogonal to the vector is standard normal."""
    far = np.abs(u @ sides) * (least / sqrt(max(1e-18, 1 - least * least)))
    return np.cumsum(np.log(NORMAL[np.minimum(far * 256, 2048).astype(np.int64)]), axis=1).astype(np.float16)


def chance_missed(code: np.ndarray, shared: np.ndarray, window: int, whole: tuple[bool, bool]) -> np.ndarray:
    """Logarithm of the chance that a neighbour at the threshold lies outside each vector's window, from a label's
    sorted codes and ``log_shared``; 0 where the window reaches over an end that is not known to be the label's."""
    n, far = len(code), window + 1
    needed = np.zeros(n, np.int64)
    if n > far:
        same = shared_bits(code[far:], code[:-far]) + 1
        needed[far:] = same
        needed[:-far] = np.maximum(needed[:-far], same)
    needed[:far] = np.maximum(needed[:far], 0 if whole[0] else 65)
    needed[-far:] = np.maximum(needed[-far:], 0 if whole[1] else 65)
    met = np.where(needed > 64, -np.inf, np.where(needed > 0, shared[np.arange(n), needed.clip(1, 64) - 1], 0.0))
    return np.log1p(-np.minimum(np.exp(met.astype(np.float64)), 1 - 1e-12))


def by_length(b: pa.RecordBatch, vectors: int) -> Iterator[pa.RecordBatch]:
    """The batch's rows, one batch for each length of vector."""
    size = b.column(vectors).value_lengths().to_numpy(zero_copy_only=False)
    kinds = np.unique(size)
    for d in kinds:
        yield b if len(kinds) == 1 else b.take(pa.array(np.flatnonzero(size == d)))


def codes(classes: DataFrame, passes: int, seed: int, bits: int = 64) -> DataFrame:
    """``pass, label, dim, code, cid, vector``: a row per class and pass.  Codes sort as unsigned numbers."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in by_length(whole, 2):
                for lo in range(0, b.num_rows, 2048):
                    part = b.slice(lo, 2048)
                    _, u = unit_rows(part.column(2))
                    side = (u @ planes(u.shape[1], passes, bits, seed) > 0).reshape(len(u), passes, bits)
                    code = (np.packbits(side, axis=2).view(">u8")[:, :, 0].astype(np.uint64) ^ np.uint64(1 << 63)).view(np.int64)
                    for p in range(passes):
                        yield pa.record_batch([pa.array(np.full(len(u), p, np.int32)), part.column(0), pa.array(np.full(len(u), u.shape[1], np.int32)), pa.array(np.ascontiguousarray(code[:, p])), part.column(1), part.column(2)],
                                              names=["pass", "label", "dim", "code", "cid", "vector"])

    kind = classes.schema["vector"].dataType.simpleString()
    return classes.select("label", "cid", "vector").mapInArrow(task, f"pass int, label string, dim int, code long, cid long, vector {kind}")


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that span what the given links connect, at most one for each node."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, label = at[:len(a)], at[len(a):], np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        before = label.copy()
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        label = label[label]
        if (label == before).all():
            keep = label != np.arange(len(nodes))
            return nodes[label[keep]], nodes[keep]


def window_links(coded: DataFrame, passes: int, seed: int, least: float, window: int, bits: int = 64) -> DataFrame:
    """Links ``(a, b)`` that span the verified pairs among each vector's ``window`` predecessors in its pass
    and label, and rows ``(a, null, missed)`` with the logarithm of the chance that the pass missed a neighbour of a.
    Partitions are ranges of the order; windows that a range's end cuts count as missed."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        old_key, old_u, old_id = None, None, None
        codes_of, ids_of, shared, first_run, sides = [], [], [], True, {}

        def measured(last: bool) -> pa.RecordBatch:
            code, cid = np.concatenate(codes_of), np.concatenate(ids_of)
            return pa.record_batch([pa.array(cid), pa.nulls(len(cid), pa.int64()), pa.array(chance_missed(code, np.concatenate(shared), window, (not first_run, not last)))], names=["a", "b", "missed"])

        for b in batches:
            keys = np.array([f"{p}|{d}|{s}" for p, d, s in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(1).to_pylist())])
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)] if len(keys) else []
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if keys[lo] != old_key:
                    if codes_of:
                        yield measured(False)
                        codes_of, ids_of, shared, first_run = [], [], [], False
                    old_u = old_id = None
                old_key = keys[lo]
                codes_of.append(b.column(3).to_numpy()[lo:hi].copy())
                ids_of.append(b.column(4).to_numpy()[lo:hi].copy())
                p, dim = b.column(0)[lo].as_py(), b.column(2)[lo].as_py()
                if dim not in sides:
                    sides[dim] = planes(dim, passes, bits, seed)
                found_a, found_b = [], []
                for at in range(lo, hi, 256):
                    part = b.slice(at, min(256, hi - at))
                    _, u = unit_rows(part.column(5))
                    shared.append(log_shared(u, sides[dim][:, p * bits:(p + 1) * bits], least))
                    cid = part.column(4).to_numpy()
                    u = u if old_u is None else np.concatenate([old_u, u])
                    cid = cid if old_id is None else np.concatenate([old_id, cid])
                    n = part.num_rows
                    first = len(u) - n
                    near = linked(u[first:], u, least)
                    gap = np.arange(first, len(u))[:, None] - np.arange(len(u))[None, :]
                    i, j = np.nonzero(near & (gap > 0) & (gap <= window))
                    if len(i):
                        x, y = stars(cid[first + i], cid[j])
                        found_a.append(x)
                        found_b.append(y)
                    old_u, old_id = u[-window:], cid[-window:]
                if found_a:
                    yield link_batch(np.concatenate(found_a), np.concatenate(found_b))
        if codes_of:
            yield measured(True)

    order = ["pass", "label", "dim", "code", "cid"]
    return coded.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(task, "a long, b long, missed double")


def link_batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.nulls(len(a), pa.float64())], names=["a", "b", "missed"])


def block_groups(rows: DataFrame, keys: list[str], block: int, columns: list[str], name: str) -> DataFrame:
    """``g, side, key`` and ``columns``: the rows of each key in blocks, every two of which meet in a group of their own.
    Rows of one block have side 0 in the group of that block alone."""
    sizes = materialise(rows.groupBy(*keys).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")), name)
    rows = rows.join(sizes, keys).withColumn("own", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    g = F.xxhash64(*keys, F.least("own", "other"), F.greatest("own", "other")).alias("g")
    rows = rows.select(g, F.signum(F.col("own") - F.col("other")).cast("int").alias("side"), F.xxhash64(F.lit(1), *keys).alias("key"), *columns)
    return rows.repartition("g").sortWithinPartitions("g")


def by_group(batches: Iterator[pa.RecordBatch], vectors: int, work: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``work`` of each group, given whole; a group's vectors of different length are given apart."""

    def group(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(parts).combine_chunks().to_batches()
        yield from by_length(whole[0], vectors)

    kept: list[pa.RecordBatch] = []
    for b in batches:
        g = b.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(g[1:] != g[:-1]) + 1).tolist(), len(g)] if len(g) else []
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            if kept and kept[0].column(0)[0].as_py() != int(g[lo]):
                yield from map(work, group(kept))
                kept = []
            kept.append(b.slice(lo, hi - lo))
    if kept:
        yield from map(work, group(kept))


def block_links(rows: DataFrame, least: float, block: int) -> DataFrame:
    """Links that span all verified pairs of ``rows(label, dim, cid, vector)`` of a label, with no pair left out."""

    def links(b: pa.RecordBatch) -> pa.RecordBatch:
        side, key, cid = (b.column(i).to_numpy() for i in range(1, 4))
        _, u = unit_rows(b.column(4))
        found = [(cid[:0], cid[:0])]
        for lo in range(0, len(cid), 512):
            s = slice(lo, lo + 512)
            meet = ((side[s][:, None] > side[None, :]) | (side[s][:, None] == 0)) & (cid[s][:, None] != cid[None, :]) & (key[s][:, None] == key[None, :])
            i, j = np.nonzero(linked(u[s], u, least) & meet)
            if len(i):
                found.append(stars(cid[lo + i], cid[j]))
        return link_batch(*map(np.concatenate, zip(*found)))

    groups = block_groups(rows, ["label", "dim"], block, ["cid", "vector"], "vector-label-blocks")
    return groups.mapInArrow(lambda batches: by_group(batches, 4, links), "a long, b long, missed double")


def all_links(classes: DataFrame, least: float, window: int, miss: float, seed: int, block: int = 4096, more: int = 8) -> DataFrame:
    """Links ``(a, b)`` that span the verified pairs of each label, but for those lost with a chance of at most ``miss``."""
    active = classes.select("label", F.size("vector").alias("dim"), "cid", "vector", F.lit(0.0).alias("missed"))
    found, spent, turn, first = None, 0, 0, window
    while True:
        sizes = materialise(active.groupBy("label", "dim").agg(F.count("*").alias("size")), "vector-labels")
        largest = sizes.agg(F.max("size")).first()[0] or 0
        whole = max(first, 8 * spent)  # what is left of a label is compared whole where passes have cost an eighth of that
        rows = active.join(sizes, ["label", "dim"])
        pairs = block_links(rows.where(F.col("size") <= whole), least, block)
        open_ = rows.where(F.col("size") > whole)
        if largest > whole:
            passes = more if turn else passes_for(largest, window, least, miss)
            pairs = pairs.unionByName(window_links(codes(open_, passes, seed + turn), passes, seed + turn, least, window))
        pairs = materialise(pairs, "vector-pairs")
        links = pairs.where("b is not null").select("a", "b")
        found = links if found is None else found.unionByName(links)
        if largest <= whole:
            return found.distinct()
        now = pairs.where("b is null").groupBy(F.col("a").alias("cid")).agg(F.sum("missed").alias("now"))
        left = open_.join(now, "cid").withColumn("missed", F.col("missed") + F.col("now")).where(F.col("missed") > log(miss))
        active = materialise(left.select("label", "dim", "cid", "vector", "missed"), "vector-open")
        spent += passes * window
        window, turn = min(4 * window, block), turn + 1


def cores(members: DataFrame, least: float, block: int) -> DataFrame:
    """``members`` with ``core``: whether the vector is one of a component of more than a block and lies so near to its
    centre that it links with all others that do."""
    size = materialise(members.groupBy("root").agg(F.count("*").alias("size")), "vector-sizes")
    large = size.where(F.col("size") > block).select("root")
    if large.isEmpty():
        return members.withColumn("core", F.lit(False))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                _, u = unit_rows(b.column(1))
                root, at = np.unique(b.column(0).to_numpy(), return_inverse=True)
                total = np.zeros((len(root), u.shape[1]))
                np.add.at(total, at, u)
                yield pa.record_batch([pa.array(np.repeat(root, u.shape[1])), pa.array(np.tile(np.arange(u.shape[1]), len(root))), pa.array(total.ravel())], names=["root", "i", "x"])

    of = members.join(large, "root", "left_semi")
    parts = of.select("root", "vector").mapInArrow(lambda batches: sums(x for b in batches for x in by_length(b, 1)), "root long, i long, x double")
    centre = parts.groupBy("root", "i").agg(F.sum("x").alias("x")).groupBy("root").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("c"))
    centre = materialise(centre.select("root", F.col("c.x").alias("centre")), "vector-centres")
    near = cos(max(0.0, acos(least) / 2 - 1e-6))

    def flags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in by_length(whole, 1):
                if b.num_rows:
                    _, u = unit_rows(b.column(1))
                    _, c = unit_rows(b.column(2))
                    yield pa.record_batch([b.column(0), pa.array((u * c).sum(axis=1) >= near)], names=["cid", "core"])

    flagged = of.join(centre.where(F.exists("centre", lambda x: x != 0)), "root").select("cid", "vector", "centre").mapInArrow(flags, "cid long, core boolean")
    flagged = materialise(flagged.where("core"), "vector-cores")
    return members.join(flagged, "cid", "left").select(*members.columns, F.coalesce("core", F.lit(False)).alias("core"))


def direct_links(members: DataFrame, least: float, block: int = 512) -> DataFrame:
    """``cid, links``: how many vectors of other classes of its component each class links with.

    ``members(root, cid, n, vector)``; components are cut into blocks, their core and the rest apart, and every two blocks but two
    of the core meet in a group of their own.  A group gives counts, not pairs."""
    def count(b: pa.RecordBatch) -> pa.RecordBatch:
        side, root, cid, n = (b.column(i).to_numpy() for i in range(1, 5))
        _, u = unit_rows(b.column(5))
        total = np.zeros(len(cid), np.int64)
        for lo in range(0, len(cid), 512):
            s = slice(lo, lo + 512)
            meet = (side[s][:, None] != side[None, :]) | (side[s][:, None] == 0)
            other = (cid[s][:, None] != cid[None, :]) & (root[s][:, None] == root[None, :])
            total[s] = (linked(u[s], u, least) & meet & other) @ n
        return pa.record_batch([pa.array(cid), pa.array(total)], names=["cid", "links"])

    rows = materialise(cores(members, least, block), "vector-members-cored")
    sizes = rows.groupBy("root").agg(F.ceil(F.count_if(~F.col("core")) / block).cast("int").alias("outer"), F.ceil(F.count_if("core") / block).cast("int").alias("inner"), F.sum(F.when(F.col("core"), F.col("n"))).alias("held"))
    rows = rows.join(materialise(sizes, "vector-blocks"), "root")
    own = F.when(F.col("core"), F.col("outer") + F.pmod(F.xxhash64("cid"), F.col("inner"))).otherwise(F.pmod(F.xxhash64("cid"), F.col("outer"))).cast("int")
    others = F.expr("slice(sequence(0, outer + inner), 1, if(core, outer, outer + inner))")  # a core meets no core
    met = rows.withColumn("own", own).withColumn("other", F.explode(others))
    g = F.xxhash64("root", F.least("own", "other"), F.greatest("own", "other")).alias("g")
    met = met.select(g, F.signum(F.col("own") - F.col("other")).cast("int").alias("side"), F.xxhash64(F.lit(1), "root").alias("key"), "cid", "n", "vector").repartition("g").sortWithinPartitions("g")
    pairs = met.mapInArrow(lambda batches: by_group(batches, 5, count), "cid long, links long")
    told = rows.where("core").select("cid", (F.col("held") - F.col("n")).alias("links"))
    return pairs.unionByName(told).groupBy("cid").agg(F.sum("links").alias("links"))


def near_duplicate_vectors(vectors: DataFrame, least: float = 0.93, window: int = 128, miss: float = 0.005, seed: int = 7, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row: its directly linked other vectors, the smallest vec_id
    reachable, and whether that is its own."""
    rows = vectors.select(vectors[vec_id].cast("long").alias("vec_id"), vectors[label].cast("string").alias("label"), vectors[vector].alias("vector"))
    sound = "label is not null and vector is not null and not exists(vector, x -> x is null or isnan(x) or abs(x) = double('infinity')) and exists(vector, x -> x <> 0)"
    h = [F.when(F.expr(sound), F.xxhash64(F.lit(i), "label", "vector")) for i in (0, 1)]
    rows = rows.select("vec_id", "label", "vector", h[0].alias("h0"), h[1].alias("h1"))
    classes = rows.where("h0 is not null").groupBy("h0", "h1").agg(F.first("label").alias("label"), F.first("vector").alias("vector"), F.min("vec_id").alias("least"), F.count("*").alias("n"))
    classes = materialise(classes.withColumn("cid", F.monotonically_increasing_id()), "vector-classes")
    roots = materialise(components(all_links(classes, least, window, miss, seed)), "vector-roots")
    members = roots.withColumnRenamed("node", "cid").join(classes.select("cid", "least", "n", "vector"), "cid")
    members = materialise(members, "vector-members")
    counts = materialise(direct_links(members.select("root", "cid", "n", "vector"), least), "vector-links")
    ids = materialise(members.groupBy("root").agg(F.min("least").alias("component_id")), "vector-components")
    known = members.select("cid", "root").join(ids, "root").join(counts, "cid").select("cid", "links", "component_id")
    known = classes.join(known, "cid", "left").select("h0", "h1", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component_id", "least").alias("component_id"))
    known = materialise(known, "vector-known")
    out = rows.select("vec_id", "h0", "h1").join(known, ["h0", "h1"], "left")
    own = F.when(F.col("h0").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.col("vec_id").eqNullSafe(own).alias("kept"))
