"""Best-fit packing of documents into token sequences, after a Martello-Toth reduction.

Lengths are whole numbers up to the capacity, so the packing instance is a table of at most ``capacity``
counts however many documents there are.  The plan is made on the counts: sets that provably dominate every
alternative for their largest member are fixed and taken out (the reduction), and the rest is packed
best-fit, longest first, whole runs of equal lengths at a time.  The plan is a bounded list of patterns; each
says how many sequences look like it and which ranks of each length go where.  Spark numbers the pieces within
their length (a running count over partitions) and looks their ranks up.

Defined results: a null text is empty; a document without ids still has the end id; only documents longer than
the capacity are cut; repeated rows are packed once each; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import byte_rows, materialise, text_of
from .encode import encoder

Pattern = list[tuple[int, int]]  # (length, how many in a sequence), longest first


class Reduction:
    """Takes dominating sets out of the counts, largest length first."""

    def __init__(self, counts: np.ndarray):
        self.capacity = len(counts) - 1
        self.left = counts.astype(np.int64).copy()
        self.fixed: list[tuple[int, Pattern]] = []

    def fix(self, times: int, *lengths: int) -> None:
        pattern: dict[int, int] = {}
        for length in sorted(lengths, reverse=True):
            pattern[length] = pattern.get(length, 0) + 1
        self.fixed.append((times, list(pattern.items())))
        for length, k in pattern.items():
            self.left[length] -= times * k

    def times(self, *lengths: int) -> int:
        """How often the set can be taken."""
        return int(min(self.left[x] // lengths.count(x) for x in lengths))

    def smallest(self, n: int, without: int) -> list[int]:
        """The n smallest lengths left beside one item of length ``without`` (fewer if there are fewer)."""
        out: list[int] = []
        for x in np.flatnonzero(self.left).tolist():
            out += [x] * min(n - len(out), int(self.left[x]) - (x == without))
            if len(out) >= n:
                break
        return out

    def fitting(self, room: int, taken: tuple = ()) -> int:
        """The largest length left that fits into ``room`` beside the taken ones (0: none)."""
        for x in range(min(room, self.capacity), 0, -1):
            if self.left[x] > taken.count(x):
                return x
        return 0

    def run(self) -> None:
        c = self.capacity
        if self.left[c]:
            self.fix(int(self.left[c]), c)
        for x in range(c - 1, (c - 1) // 2, -1):  # a pair that fills a sequence replaces any other set with x
            if self.left[x] and (n := self.times(x, c - x)):
                self.fix(n, x, c - x)
        for x in range(c, 0, -1):
            while self.left[x] > 0 and self.dominate(x):
                pass

    def dominate(self, x: int) -> bool:
        """Fix a set with an item of length x if some set dominates all others that hold it."""
        room, low = self.capacity - x, self.smallest(3, x)
        if not low or low[0] > room:  # nothing else fits
            self.fix(int(self.left[x]) if not low or low[0] != x else 1, x)
            return True
        most = sum(np.cumsum(low) <= room)  # how many more fit
        k = self.fitting(room, (x,))
        if most == 1:
            self.fix(self.times(x, k), x, k)
            return True
        if len(low) < 3 or sum(low) > room:  # at most two more fit
            second = self.fitting(room - k, (x, k))
            pairs_above = self.best_pair(room, x)
            if k >= pairs_above:  # one item is worth any two
                self.fix(self.times(x, k), x, k)
                return True
            if second and not self.pair_over(room, second, x):
                self.fix(self.times(x, k, second), x, k, second)
                return True
        return False

    def best_pair(self, room: int, x: int) -> int:
        """Largest sum of two items that fit together."""
        best = 0
        for a in range(min(room - 1, self.capacity), 0, -1):
            if 2 * a <= best:
                break
            if self.left[a] > (a == x):
                b = self.fitting(min(room - a, a), (x, a))
                best = max(best, a + b if b else 0)
        return best

    def pair_over(self, room: int, least: int, x: int) -> bool:
        """Whether two items, both longer than ``least``, fit together."""
        found: list[int] = []
        for a in range(least + 1, room):
            found += [a] * int(min(2, self.left[a] - (a == x)))
            if len(found) >= 2:
                return found[0] + found[1] <= room
        return False


def best_fit(counts: np.ndarray) -> list[tuple[int, Pattern]]:
    """Best-fit decreasing over counts: each run of equal lengths goes into the fullest sequences that
    have room, as many to a sequence as fit, as it would one by one."""
    capacity = len(counts) - 1
    groups: dict[int, list[tuple[int, Pattern]]] = {}
    rooms: list[int] = []  # sorted rooms that have groups

    def put(room: int, n: int, pattern: Pattern) -> None:
        if room not in groups:
            groups[room] = []
            insort(rooms, room)
        groups[room].append((n, pattern))

    for length in range(capacity, 0, -1):
        n = int(counts[length])
        while n:
            i = bisect_left(rooms, length)
            if i == len(rooms):  # new sequences
                k = capacity // length
                if n >= k:
                    put(capacity - k * length, n // k, [(length, k)])
                if n % k:
                    put(capacity - n % k * length, 1, [(length, n % k)])
                break
            room = rooms[i]
            have, pattern = groups[room].pop()
            if not groups[room]:
                del groups[room]
                rooms.pop(i)
            k = room // length
            full = min(have, n // k)
            if full:
                put(room - k * length, full, [*pattern, (length, k)])
                n -= full * k
            some = n if have > full and n < k else 0
            if some:
                put(room - some * length, 1, [*pattern, (length, some)])
                n = 0
            if have > full + bool(some):
                put(room, have - full - bool(some), pattern)
    return [g for found in groups.values() for g in found]


def plan(counts: np.ndarray) -> dict[str, np.ndarray]:
    """Where the pieces of each length go, by rank: rows ordered by (length, rank) with the first rank, how
    many go to one sequence, the first sequence and the place in it."""
    reduction = Reduction(counts)
    reduction.run()
    rows, rank, sequence = [], np.zeros(len(counts), np.int64), 0
    for n, pattern in reduction.fixed + best_fit(reduction.left):
        offset = 0
        for length, k in pattern:
            rows.append((length, rank[length], k, sequence, offset))
            rank[length] += n * k
            offset += length * k
        sequence += n
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "each", "sequence", "offset"), table.T))


def look_up(slots: dict[str, np.ndarray], length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and place of pieces given by length and rank."""
    wide = np.int64(1) << 44
    at = np.searchsorted(slots["length"] * wide + slots["rank"], length * wide + rank, side="right") - 1
    over = rank - slots["rank"][at]
    return slots["sequence"][at] + over // slots["each"][at], slots["offset"][at] + over % slots["each"][at] * length


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, blank: bool, carry: tuple) -> DataFrame:
    """Encoded documents cut to the capacity, written to the shared folder: the ``carry`` columns, ``piece``,
    ``start``, ``length``, ``ids`` (little-endian, 2 bytes each, or 4 for more than 65,536 different ids), and the piece's number among those of its length in its ``part``."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, enc, seen = TaskContext.get().partitionId(), encoder(tokenizer, blank), np.zeros(capacity + 1, np.int64)
        for b in batches:
            row, piece, start, size, number, ids, waiting = [], [], [], [], [], [], 0

            def made():
                at = (np.cumsum([0, *size]) * enc.dtype.itemsize).astype(np.int32)
                data = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(at), pa.py_buffer(np.concatenate(ids).astype(enc.dtype.newbyteorder("<")))])
                return pa.record_batch([*b.take(pa.array(row)).columns[1:], pa.array([part] * len(row), pa.int32()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                                        pa.array(size, pa.int32()), pa.array(number, pa.int64()), data],
                                       names=[*b.schema.names[1:], "part", "piece", "start", "length", "number", "ids"])

            for i, own in enumerate(enc.encode_all(map(bytes, byte_rows(b.column(0))))):
                whole = np.append(own, enc.dtype.type(end_id))
                for k, lo in enumerate(range(0, len(whole), capacity)):
                    own = whole[lo:lo + capacity]
                    row.append(i)
                    piece.append(k)
                    start.append(lo)
                    size.append(len(own))
                    number.append(int(seen[len(own)]))
                    seen[len(own)] += 1
                    ids.append(own)
                    waiting += len(own)
                    if waiting > 1 << 21:
                        yield made()
                        row, piece, start, size, number, ids, waiting = [], [], [], [], [], [], 0
            if row:
                yield made()

    rows = docs.select(text_of(docs).alias("text"), *[docs[c].alias(f"c{i}") for i, c in enumerate(carry)])
    kinds = [f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(carry)]
    return materialise(rows.mapInArrow(task, ", ".join([*kinds, "part int, piece int, start long, length int, number long, ids binary"])), "pieces")


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 2048, blank: bool = False, carry: tuple = ("doc_id",)) -> DataFrame:
    """A row per piece: the ``carry`` columns, ``piece``, ``start``, ``length``, ``ids``, ``sequence_id`` and
    ``offset``, gapless from 0 in every sequence."""
    cut = pieces(docs, tokenizer, end_id, capacity, blank, carry)
    sizes = materialise(cut.groupBy("part", "length").agg(F.count("*").alias("n")), "piece-counts")
    counts = np.zeros(capacity + 1, np.int64)
    for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `capacity` rows
        counts[r.length] = r.n
    slots = plan(counts)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = cut.join(base, ["part", "length"]).withColumn("rank", F.col("base") + F.col("number"))
    found = F.arrow_udf(lambda length, rank: _places(slots, length, rank), "sequence_id long, offset long")("length", "rank")
    kept = [F.col(f"c{i}").alias(c) for i, c in enumerate(carry)] + ["piece", "start", "length", "ids"]
    return ranked.withColumn("found", found).select(*kept, "found.sequence_id", "found.offset")


def _places(slots: dict[str, np.ndarray], length: pa.Array, rank: pa.Array) -> pa.Array:
    if not len(length):
        return pa.array([], pa.struct([("sequence_id", pa.int64()), ("offset", pa.int64())]))
    found = look_up(slots, *(x.to_numpy(zero_copy_only=False).astype(np.int64) for x in (length, rank)))
    return pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in found], ["sequence_id", "offset"])


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences: ``sequence_id``, their ``ids``, and the ``lengths`` of their pieces in order.  A sequence
    has at most the capacity's pieces."""
    parts = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "length", "ids"))).alias("p"))
    return parts.select("sequence_id", F.aggregate(F.col("p.ids"), F.lit(b""), lambda a, x: F.concat(a, x)).alias("ids"), F.col("p.length").alias("lengths"))
