"""Quality selection by importance resampling with hashed n-gram models.

Target and raw text each get a bag-of-n-grams model over ``buckets`` hashed unigrams and bigrams.  A document's
log weight is the sum of its n-grams' log ratios; with a Gumbel variable added, the k largest keys are a sample of
size k without replacement in proportion to the weights.  The raw model counts every document; the target model
counts the labelled documents given, at most ``target_rows`` of them, the ones with the smallest hash.

The k-th largest key is found exactly by counting key prefixes over the whole table, sixteen bits at a time, so
nothing is sorted or gathered.

Defined results: null and empty texts have no n-grams and weight 0; the Gumbel variable depends on the seed, the
doc_id and the text, so repeated rows share their fate; all keys equal to the k-th are taken; without target rows
all weights are 0; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_rows, materialise, text_of

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: An odd number and its inverse modulo 2**64: powers give each word the same hash wherever it stands.
BASE = 0x9E3779B97F4A7C15
BACK = pow(BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        step = np.full(1 << max(16, int(n).bit_length()), base, np.uint64)
        step[0] = 1
        _POWERS[base] = have = np.cumprod(step, dtype=np.uint64)
    return have[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and 64-bit hash of every word (white space in ASCII divides; A-Z count as a-z)."""
    raw = np.frombuffer(data.lower(), np.uint8)
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    gap = SPACE[raw]
    edge = np.diff(np.concatenate([[True], gap, [True]]).view(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    total = np.concatenate([[np.uint64(0)], np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(raw)), dtype=np.uint64)])
    return start, mixed((total[end] - total[start]) * powers(BACK, len(raw))[start])


def pieces(texts: Iterator[bytes], size: int) -> Iterator[tuple[bool, bytes, list[int], list[int]]]:
    """Texts joined to buffers of about ``size`` bytes: whether the buffer goes on with the text before, the buffer,
    the documents in it and where they start.  A longer text is cut at blanks, and its parts are alone."""
    docs, at, parts, n = [], [], [], 0
    for i, t in enumerate(texts):
        if docs and n + len(t) > size:
            yield False, b"\n".join(parts), docs, at
            docs, at, parts, n = [], [], [], 0
        lo = 0
        while len(t) > size and lo < len(t):
            hi = t.find(b" ", lo + size)
            hi = len(t) if hi < 0 else hi
            yield lo > 0, t[lo:hi], [i], [0]
            lo = hi
        if len(t) <= size:
            docs.append(i)
            at.append(n)
            parts.append(t)
            n += len(t) + 1
    if docs:
        yield False, b"\n".join(parts), docs, at


def grams(texts: Iterator[bytes], buckets: int, size: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Document and bucket of every unigram and bigram."""
    last = np.zeros(0, np.uint64)
    for more, data, docs, at in pieces(texts, size):
        start, h = word_hashes(data)
        doc = np.array(docs)[np.searchsorted(at, start, side="right") - 1] if len(start) else np.zeros(0, np.int64)
        row, owner = (np.concatenate([last, h]), np.concatenate([np.full(len(last), docs[0]), doc])) if more else (h, doc)
        with np.errstate(over="ignore"):
            pair = mixed(row[:-1] * np.uint64(3) + row[1:])
        same = owner[:-1] == owner[1:]
        last = row[-1:]
        yield np.concatenate([doc, owner[:-1][same]]), (np.concatenate([h, pair[same]]) % np.uint64(buckets)).astype(np.int64)


def gram_counts(docs: DataFrame, buckets: int) -> np.ndarray:
    """How often each bucket occurs in the whole table: partial counts in the tasks, summed by Spark."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for _, bucket in grams(map(bytes, byte_rows(b.column(0))), buckets):
                total += np.bincount(bucket, minlength=buckets)
        yield pa.record_batch([pa.array(np.flatnonzero(total)), pa.array(total[total > 0])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in docs.select(text_of(docs).alias("text")).mapInArrow(task, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most `buckets` rows
        out[r.bucket] = r.n
    return out


def log_ratios(target: np.ndarray, raw: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    if not target.sum():
        return np.zeros(len(raw))
    return np.log((target + smooth) / (target.sum() + smooth * len(raw))) - np.log((raw + smooth) / (raw.sum() + smooth * len(raw)))


def weigh(docs: DataFrame, ratios: np.ndarray, seed: int) -> DataFrame:
    """``doc_id, n_grams, log_weight, key, place``; ``place`` orders as ``key`` does."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [bytes(t) for t in byte_rows(b.column(0))]
            weight, n = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
            for doc, bucket in grams(iter(texts), len(ratios)):
                weight += np.bincount(doc, ratios[bucket], minlength=len(texts))
                n += np.bincount(doc, minlength=len(texts))
            ids = b.column(1).to_pylist()
            h = np.array([xxhash.xxh64_intdigest(b"%d|" % i if i is not None else b"|", xxhash.xxh64_intdigest(t, seed)) for i, t in zip(ids, texts)], np.uint64)
            key = weight - np.log(-np.log(((h >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)))
            bits = key.view(np.int64)
            place = np.where(bits < 0, ~bits, bits ^ np.int64(-(1 << 63))).view(np.uint64) ^ np.uint64(1 << 63)
            yield pa.record_batch([b.column(1), pa.array(n), pa.array(weight), pa.array(key), pa.array(place.view(np.int64))], names=["doc_id", "n_grams", "log_weight", "key", "place"])

    rows = docs.select(text_of(docs).alias("text"), docs["doc_id"].cast("long").alias("doc_id"))
    return rows.mapInArrow(task, "doc_id long, n_grams long, log_weight double, key double, place long")


def kth_largest(rows: DataFrame, column: str, k: int) -> int | None:
    """The k-th largest value of a long column, or None if there are fewer rows."""
    place, prefix, left = F.col(column).bitwiseXOR(F.lit(-(1 << 63)).cast("long")), 0, k  # now in the order of unsigned numbers
    for shift in (48, 32, 16, 0):
        part = rows.select(F.shiftrightunsigned(place, shift).alias("p"))
        if shift < 48:
            part = part.where(F.shiftrightunsigned("p", 16) == prefix)
        counts = sorted(((r.p, r["count"]) for r in part.groupBy("p").count().collect()), key=lambda x: x[0] & 0xFFFF, reverse=True)  # at most 65,536 rows
        for value, n in counts:
            if n >= left:
                prefix = value
                break
            left -= n
        else:
            return None
    return int(np.array([prefix & (2**64 - 1)], np.uint64).view(np.int64)[0]) ^ -(1 << 63)


def resample(docs: DataFrame, target_ids: DataFrame, share: float, buckets: int = 1 << 14, target_rows: int = 20_000, seed: int = 42) -> DataFrame:
    """The sampled documents: ``doc_id, n_grams, log_weight, key, kept`` of the round(share * rows) largest keys.

    ``target_ids(doc_id)`` names target documents; at most ``target_rows`` of them are used and sent to the tasks."""
    ids = target_ids.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    ids = materialise(ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(target_rows), "target-ids")
    target = docs.join(F.broadcast(ids), docs["doc_id"].cast("long") == ids["doc_id"], "left_semi")
    ratios = log_ratios(gram_counts(target, buckets), gram_counts(docs, buckets))
    rows = materialise(weigh(docs, ratios, seed), "weights")
    k = round(share * rows.count())
    if k <= 0:
        return rows.limit(0).select("doc_id", "n_grams", "log_weight", "key", F.lit(True).alias("kept"))
    least = kth_largest(rows, "place", k)
    kept = rows if least is None else rows.where(F.col("place") >= F.lit(least).cast("long"))
    return kept.select("doc_id", "n_grams", "log_weight", "key", F.lit(True).alias("kept"))
