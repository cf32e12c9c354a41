"""Merkle dataset manifest with octopus multiproofs.

Every row is a leaf, every tree (a group of rows) hashes runs of ``ARITY`` consecutive nodes until one is left, the
subroots are the leaves of a last tree, and its root stands for the dataset.  Levels are built by grouping nodes by
their parent, so no group has more than ``ARITY`` rows.

Proofs are made by partitions of consecutive leaves.  A partition computes the smallest union of node coordinates that
its leaves' proofs need and that can't be derived from its own leaves, fetches these in one join, derives
the shared interior nodes, and expands the leaves' single proofs locally.  A partition that is a whole subtree
misses no node below its own top, so only the few levels above are joined.

Defined results: null groups are one tree, before all others; null ids stand before all others of their tree; rows of one
id follow their digests, and rows that repeat wholly come out as often as they came, each with a place of its
own; rows without an id are not tampered with; an empty table has no rows and no root.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

ARITY = 8
CHUNK = ARITY**4  # leaves of a partition
TOP = -1  # the tree of subroots
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def field(value: Column) -> Column:
    """A value as its UTF-8 byte count, a colon and itself; ``-`` for null."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(values: list[Column]) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def numbered(rows: DataFrame, group: list[str], order: list[Column], name: str) -> DataFrame:
    """``rows`` stored in ranges of (group, order), with ``idx``, the place in the group (from 0), and ``size``, the
    group's number of rows.  The order must be unique; groups may be null and of any size."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    by = [*[F.col(g).asc_nulls_first() for g in group], *order]
    pos = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    rows = materialise(rows.repartitionByRange(n, *by).sortWithinPartitions(*by).select("*", F.spark_partition_id().alias("range"), pos.alias("pos")), name)
    held = rows.groupBy("range", *group).agg(F.count("*").alias("held"), F.min("pos").alias("first"))
    earlier = Window.partitionBy(*group).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    held = held.select(F.col("range").alias("_range"), *[F.col(g).alias(f"_{g}") for g in group], "first",
                       F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("before"), F.sum("held").over(Window.partitionBy(*group)).alias("size"))
    same = F.col("range") == F.col("_range")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_{g}"))
    out = rows.join(held, same).withColumn("idx", F.col("before") + F.col("pos") - F.col("first"))
    return out.drop("range", "pos", "_range", *[f"_{g}" for g in group], "first", "before")


def levels(leaves: DataFrame) -> list[DataFrame]:
    """Tables ``(tree, level, idx, size, hash)`` of all levels, the leaves' first; ``size`` is the number of nodes of
    the tree's level, 1 at its top."""
    now = leaves.select("tree", F.lit(0).alias("level"), "idx", "size", "hash")
    out, largest = [now], leaves.agg(F.max("size")).first()[0] or 0
    while largest > 1:
        run = F.array_sort(F.collect_list(F.struct("idx", "hash")))
        joined = F.array_join(F.transform(run, lambda x: x["hash"]), "")
        up = now.where("size > 1").withColumn("parent", F.expr(f"idx div {ARITY}")).groupBy("tree", "parent").agg(F.sha2(joined, 256).alias("hash"), F.first("size").alias("size"))
        now = up.select("tree", F.lit(len(out)).alias("level"), F.col("parent").alias("idx"), F.expr(f"(size + {ARITY - 1}) div {ARITY}").alias("size"), "hash")
        now = materialise(now, "merkle-level")
        out.append(now)
        largest = -(-largest // ARITY)
    return out


@dataclass
class Manifest:
    """``leaves``: the carried columns with ``tree``, ``idx``, ``size``, ``trees`` (how many there are), ``hash``;
    ``nodes``: a table for each level of the groups' trees; ``top``: those of the tree of subroots."""
    leaves: DataFrame
    nodes: list[DataFrame]
    top: list[DataFrame]
    root: str | None


def manifest(rows: DataFrame, group: str, order: list[str], leaf: str, carry: tuple[str, ...] = ()) -> Manifest:
    """The trees of ``rows``: a tree for each value of ``group``, its leaves (the digests in ``leaf``) ordered
    by ``order``, then by digest."""
    kept = [f"c{i}" for i in range(len(carry))]
    keys = [f"o{i}" for i in range(len(order))]
    flat = rows.select(rows[group].cast("string").alias("name"), *[rows[o].alias(k) for o, k in zip(order, keys)], rows[leaf].alias("hash"), *[rows[c].alias(k) for c, k in zip(carry, kept)], F.monotonically_increasing_id().alias("row"))
    flat = materialise(flat, "merkle-rows")
    placed = numbered(flat, ["name"], [*[F.col(k).asc_nulls_first() for k in keys], F.col("hash"), F.col("row")], "merkle-order")
    groups = materialise(placed.groupBy("name").agg(F.first("size").alias("leaves")), "merkle-groups")
    trees = numbered(groups, [], [F.col("name").asc_nulls_first()], "merkle-trees").select(F.col("name").alias("_name"), F.col("idx").alias("tree"), F.col("size").alias("trees"))
    # many rows of one group meet one row of it, so adaptive execution may split them
    leaves = materialise(placed.join(trees, F.col("name").eqNullSafe(F.col("_name"))).select("tree", "trees", "idx", "size", "hash", *kept), "merkle-leaves")
    nodes = levels(leaves)
    subroots = None
    for level in nodes:
        tops = level.where("size = 1").select("tree", "hash")
        subroots = tops if subroots is None else subroots.unionByName(tops)
    count = trees.agg(F.max("trees")).first()[0] or 0
    subroots = materialise(subroots.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("idx"), F.lit(count).cast("long").alias("size"), "hash"), "merkle-subroots")
    top = levels(subroots)
    last = top[-1].where("size = 1").select("hash").first()
    return Manifest(leaves, nodes, top, last and last[0])


def run_of(parent: int, size: int) -> range:
    """The children of a parent in a level of ``size`` nodes."""
    return range(parent * ARITY, min(size, parent * ARITY + ARITY))


def missing(leaves: np.ndarray, size: int) -> list[tuple[int, int]]:
    """The smallest set of ``(level, idx)`` from which, with the given leaves themselves, the proofs of all of them
    can be told."""
    out, level, known = [], 0, np.unique(leaves)
    while size > 1:
        parents = np.unique(known // ARITY)
        wanted = (parents[:, None] * ARITY + np.arange(ARITY)).ravel()
        wanted = np.setdiff1d(wanted[wanted < size], known, assume_unique=True)
        out += [(level, i) for i in wanted.tolist()]
        known, size, level = parents, -(-size // ARITY), level + 1
    return out


def hash_of(run: list[str]) -> str:
    return sha256("".join(run).encode()).hexdigest()


class Paths:
    """Derives the inner nodes above some leaves of a tree from fetched ones, and holds each path node's siblings."""

    def __init__(self, leaves: dict[int, str], size: int, fetched: dict):
        #: Of each level, for each path node: hashes before it and after it in its run.
        self.sides: list[dict[int, tuple[str, str]]] = []
        known, level = leaves, 0
        while size > 1:
            sides, up = {}, {}
            for parent in dict.fromkeys(i // ARITY for i in known):
                children = run_of(parent, size)
                run = [known.get(i) or fetched[level, i] for i in children]
                for k, i in enumerate(children):
                    if i in known:
                        sides[i] = "".join(run[:k]), "".join(run[k + 1:])
                up[parent] = hash_of(run)
            self.sides.append(sides)
            known, size, level = up, -(-size // ARITY), level + 1
        self.subroot = next(iter(known.values()))
        #: Of each level and path node: all siblings from there to the root.
        self.above: list[dict[int, str]] = [{0: ""}]
        for sides in reversed(self.sides):
            self.above.append({i: a + b + self.above[-1][i // ARITY] for i, (a, b) in sides.items()})
        self.above.reverse()

    def siblings(self, i: int) -> str:
        return self.above[0][i]

    def fold(self, i: int, digest: str) -> str:
        """The tree's root if the leaf ``i`` were ``digest``."""
        for sides in self.sides:
            a, b = sides[i]
            digest = sha256((a + digest + b).encode()).hexdigest()
            i //= ARITY
        return digest


def prove(found: Manifest, carry: tuple[str, ...], claim: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """For every leaf: the carried columns, ``leaf``, ``subroot``, ``root``, ``proof`` (the digest of its siblings, level by
    level, left to right), ``folded`` (the root that its siblings give with the leaf that the carried column
    ``claim`` holds, or with its own where that is null) and ``verified`` (whether that is the root)."""
    kept = [f"c{i}" for i in range(len(carry))]
    leaves = found.leaves.withColumn("chunk", F.expr(f"idx div {chunk}"))

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tree, part, idx, size, trees = (b.column(i).to_numpy() for i in range(5))
            order = np.lexsort((idx, part, tree))
            tree, part, idx, size, trees = (x[order] for x in (tree, part, idx, size, trees))
            cut = np.flatnonzero(np.concatenate([[True], (tree[1:] != tree[:-1]) | (part[1:] != part[:-1])])) if len(tree) else []
            rows = []
            for lo, hi in zip(cut, [*cut[1:], len(tree)]):
                at = (int(tree[lo]), int(part[lo]))
                rows += [(*at, at[0], *x) for x in missing(idx[lo:hi], int(size[lo]))]
                rows += [(*at, TOP, *x) for x in missing(tree[lo:lo + 1], int(trees[lo]))]
            cols = [np.array([r[i] for r in rows], np.int64) for i in range(5)]
            yield pa.record_batch([pa.array(c) for c in cols], names=["tree", "chunk", "of", "level", "idx"])

    need = leaves.select("tree", "chunk", "idx", "size", "trees").mapInArrow(wanted, "tree long, chunk long, of long, level long, idx long").distinct()
    # what batches of a chunk need of each other's leaves is in the chunk itself
    own = (F.col("of") == F.col("tree")) & (F.expr(f"idx * power({ARITY}, level)") >= F.col("chunk") * chunk) & (F.expr(f"(idx + 1) * power({ARITY}, level)") <= (F.col("chunk") + 1) * chunk)
    need = need.where(~own)
    low = 0
    while chunk % ARITY ** (low + 1) == 0:
        low += 1
    tables = [*found.nodes[low:], *found.top]
    nodes = tables[0].select(F.col("tree").alias("of"), F.col("level").cast("long").alias("level"), "idx", "hash")
    for t in tables[1:]:
        nodes = nodes.unionByName(t.select(F.col("tree").alias("of"), F.col("level").cast("long").alias("level"), "idx", "hash"))
    fetched = need.join(nodes, ["of", "level", "idx"])
    none = [F.lit(None).cast(found.leaves.schema[k].dataType).alias(k) for k in kept]
    rows = fetched.select("tree", "chunk", "of", "level", "idx", "hash", F.lit(0).cast("long").alias("size"), F.lit(0).cast("long").alias("trees"), *none).unionByName(
        leaves.select("tree", "chunk", "tree", F.lit(-1).cast("long"), "idx", "hash", "size", "trees", *kept).toDF("tree", "chunk", "of", "level", "idx", "hash", "size", "trees", *kept))
    # fetched nodes come before the leaves, those of level -1, of their chunk
    rows = rows.repartition("tree", "chunk").sortWithinPartitions("tree", "chunk", F.col("level").desc(), "idx")
    at = 8 + kept.index(f"c{carry.index(claim)}") if claim else None

    def expand(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        level = whole.column(3).to_numpy()
        first = int((level >= 0).sum())
        known, tops = {}, {}
        tree = whole.column(0)[0].as_py()
        for of, at_level, i, h in zip(*(whole.column(k).slice(0, first).to_pylist() for k in (2, 3, 4, 5))):
            (tops if of == TOP else known)[at_level, i] = h
        mine = whole.slice(first)
        if not mine.num_rows:
            return
        idx, hashes = mine.column(4).to_pylist(), mine.column(5).to_pylist()
        paths = Paths(dict(zip(idx, hashes)), mine.column(6)[0].as_py(), known)
        upper = Paths({tree: paths.subroot}, mine.column(7)[0].as_py(), tops)
        above = upper.siblings(tree)
        root, claims = upper.subroot, mine.column(at).to_pylist() if at else hashes
        proof = [sha256((paths.siblings(i) + above).encode()).hexdigest() for i in idx]
        folded = [upper.fold(tree, paths.fold(i, c or h)) for i, c, h in zip(idx, claims, hashes)]
        n = len(idx)
        for lo in range(0, n, 4000):
            s = slice(lo, lo + 4000)
            size = len(idx[s])
            yield pa.record_batch([*[mine.column(8 + k).slice(lo, size) for k in range(len(kept))], mine.column(5).slice(lo, size), *[pa.array([x] * size) for x in (paths.subroot, root)],
                                   pa.array(proof[s]), pa.array(folded[s]), pa.array([f == root for f in folded[s]])], names=[*kept, "leaf", "subroot", "root", "proof", "folded", "verified"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = [], None
        for b in batches:
            if not b.num_rows:
                continue
            tree, part = b.column(0).to_numpy(), b.column(1).to_numpy()
            cut = np.flatnonzero(np.concatenate([[True], (tree[1:] != tree[:-1]) | (part[1:] != part[:-1])])).tolist()
            for lo, hi in zip(cut, [*cut[1:], len(tree)]):
                if held and key != (tree[lo], part[lo]):
                    yield from expand(held)
                    held = []
                key = tree[lo], part[lo]
                held.append(b.slice(lo, hi - lo))
        if held:
            yield from expand(held)

    kinds = [f"{k} {found.leaves.schema[k].dataType.simpleString()}" for k in kept]
    out = rows.mapInArrow(task, ", ".join([*kinds, "leaf string, subroot string, root string, proof string, folded string, verified boolean"]))
    return out.select(*[F.col(k).alias(c) for k, c in zip(kept, carry)], "leaf", "subroot", "root", "proof", "folded", "verified")


def documents_manifest(docs: DataFrame, columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), group: str = "lang", order: str = "doc_id", chunk: int = CHUNK) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof, folded, verified`` of every document.  Where 3 divides the CRC-32 of its id, the
    proof is asked with a text whose letters A-Z are lower-cased."""
    lowered = [F.translate(docs[c].cast("string"), UPPER, LOWER) if c == "text" else docs[c] for c in columns]
    tampered = F.crc32(docs[order].cast("string").cast("binary")) % 3 == 0
    rows = docs.select(docs[order].alias("id"), docs[group].alias("group"), leaf_of([docs[c] for c in columns]).alias("leaf"), F.when(tampered, leaf_of(lowered)).alias("claim"))
    found = manifest(rows, "group", ["id"], "leaf", ("id", "claim"))
    proved = prove(found, ("id", "claim"), "claim", chunk)
    return proved.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof", "folded", "verified")
