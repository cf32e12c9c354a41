"""URL filter: host and path rules, and a Bloom filter cascade for all other hosts.

The cascade holds which keys of a known universe are listed.  Level 0 is a Bloom filter of the listed keys;
level 1 one of the unlisted keys of the universe that pass level 0; level 2 one of the listed keys that pass
level 1, and so on until no key passes wrongly.  A key's answer is the first level it fails, so membership is
exact for every key of the universe, and the rows that are asked need no join.

Keys are dealt to shards by hash, each of about ``shard_keys`` keys, and every shard has a cascade of its own, built in
Spark.  Rows are asked against blocks of shards of at most ``block_bytes`` together, one pass for each block, so what is
sent to the executors at once has a fixed bound.

Defined results: a null url, or one without ``://``, has empty host and path and no rule; rows come out as often
as they came; empty tables and empty lists work (nothing is listed).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule as text, and its verdict; rules are (verdict, host, path)."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the last fitting one stays
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)
        name = F.when(fits, F.lit(rule_host + rule_path)).otherwise(name)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    return name, verdict


class Bloom:
    """Bits set by ``hashes`` numbers made of two 64-bit hashes."""

    def __init__(self, bits: np.ndarray, hashes: int, level: int):
        self.bits, self.hashes, self.level = bits, hashes, level

    def places(self, a: np.ndarray, b: np.ndarray) -> Iterator[np.ndarray]:
        size = np.uint64(len(self.bits) * 8)
        with np.errstate(over="ignore"):
            step = (b ^ np.uint64((self.level * 0x9E3779B97F4A7C15) % (1 << 64))) * np.uint64(0xC2B2AE3D27D4EB4F) | np.uint64(1)
            step ^= step >> np.uint64(29)
            for k in range(self.hashes):
                x = a + np.uint64(k + 1) * step
                x ^= x >> np.uint64(32)
                yield (x * np.uint64(0x9FB21C651E98DF25) >> np.uint64(7)) % size

    @classmethod
    def of(cls, a: np.ndarray, b: np.ndarray, level: int, rate: float) -> Bloom:
        per_key = -np.log(rate) / np.log(2) ** 2
        new = cls(np.zeros(max(1, int(np.ceil(len(a) * per_key / 8))), np.uint8), max(1, round(per_key * np.log(2))), level)
        for x in new.places(a, b):
            np.bitwise_or.at(new.bits, x >> np.uint64(3), np.uint8(1) << (x & np.uint64(7)).astype(np.uint8))
        return new

    def passes(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.ones(len(a), bool)
        for x in self.places(a, b):
            out &= (self.bits[x >> np.uint64(3)] >> (x & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
        return out


def build(listed: tuple[np.ndarray, np.ndarray], others: tuple[np.ndarray, np.ndarray]) -> list[Bloom]:
    """The cascade of one shard.  The first level lets few of the many others pass; later ones halve the rest."""
    levels: list[Bloom] = []
    holds, against = listed, others
    while len(holds[0]):
        rate = min(0.5, max(1e-4, len(holds[0]) / max(1, len(against[0])) / 1.5)) if not levels else 0.5
        level = Bloom.of(*holds, len(levels), rate)
        levels.append(level)
        wrong = level.passes(*against)
        holds, against = (against[0][wrong], against[1][wrong]), holds
        if len(levels) > 200:
            raise RuntimeError("two keys have equal hashes")
    return levels


def contains(levels: list[Bloom], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact membership of keys of the universe."""
    out, open_ = np.full(len(a), len(levels) % 2 == 1), np.ones(len(a), bool)
    for k, level in enumerate(levels):
        failed = open_.copy()
        failed[open_] = ~level.passes(a[open_], b[open_])
        out[failed] = k % 2 == 1  # failing an even level: not listed; an odd one: listed
        open_ &= ~failed
    return out


def key_hashes(key: Column) -> list[Column]:
    return [F.xxhash64(F.lit(i), key).alias(f"h{i}") for i in (0, 1)]


def cascade(universe: DataFrame, listed: DataFrame, key: str = "key", shard_keys: int = 1 << 20) -> DataFrame:
    """``shard, shards, level, hashes, bits``: a cascade for each shard, exact over all keys of ``universe``.
    Null keys are left out; listed keys outside the universe are part of it."""
    keys = universe.select(F.col(key).alias("key"), F.lit(0).alias("on")).unionByName(listed.select(F.col(key).alias("key"), F.lit(1).alias("on")))
    keys = materialise(keys.where("key is not null").groupBy("key").agg(F.max("on").alias("on")).select(*key_hashes(F.col("key")), "on"), "url-keys")
    shards = max(1, -(-keys.count() // shard_keys))

    def make(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b, on = pdf["h0"].to_numpy().view(np.uint64), pdf["h1"].to_numpy().view(np.uint64), pdf["on"].to_numpy() == 1
        levels = build((a[on], b[on]), (a[~on], b[~on]))
        return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])] * len(levels), "shards": [shards] * len(levels), "level": range(len(levels)), "hashes": [x.hashes for x in levels], "bits": [x.bits.tobytes() for x in levels]})

    dealt = keys.withColumn("shard", F.pmod("h0", F.lit(shards)).cast("int")).groupBy("shard")
    return materialise(dealt.applyInPandas(make, "shard int, shards int, level int, hashes int, bits binary"), "url-cascade")


def _probe(sent, shards: int):
    """Membership of hashed keys in the shards that were sent; keys of other shards are not found."""
    def probe(h0, h1):
        a, b = (h.to_numpy(zero_copy_only=False) for h in (h0, h1))
        shard, found = a % shards, np.zeros(len(a), bool)
        a, b = a.view(np.uint64), b.view(np.uint64)
        for s in np.unique(shard).tolist():
            if s in sent.value:
                at = np.flatnonzero(shard == s)
                found[at] = contains(sent.value[s], a[at], b[at])
        return pa.array(found)
    return probe


def ask(rows: DataFrame, key: str, cascades: DataFrame, name: str = "listed", block_bytes: int = 64 << 20) -> DataFrame:
    """``rows`` with a boolean column ``name``: whether the key is listed (false for null keys)."""
    sizes = cascades.groupBy("shard", "shards").agg(F.sum(F.octet_length("bits")).alias("size")).orderBy("shard").toLocalIterator()
    blocks: list[list[int]] = []
    room, shards = 0, 1
    for r in sizes:
        shards = r.shards
        if not blocks or r.size > room:
            blocks.append([])
            room = block_bytes
        blocks[-1].append(r.shard)
        room -= r.size
    out = rows.withColumn(name, F.lit(False))
    for block in blocks:
        held: dict[int, list[Bloom]] = {}
        for r in cascades.where(F.col("shard").between(block[0], block[-1])).orderBy("shard", "level").collect():  # at most block_bytes
            held.setdefault(r.shard, []).append(Bloom(np.frombuffer(r.bits, np.uint8), r.hashes, r.level))
        sent = rows.sparkSession.sparkContext.broadcast(held)

        probe = F.arrow_udf(_probe(sent, shards), "boolean")
        out = out.withColumn(name, F.col(name) | (F.col(key).isNotNull() & probe(*key_hashes(F.col(key)))))
    return out


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], listed_hosts, block_bytes: int = 64 << 20) -> DataFrame:
    """``page_id, host, path, rule, verdict`` for every row.  ``listed_hosts`` maps the column of all distinct hosts to a
    condition, true for listed ones; the verdict is the longest rule's, else block for listed hosts, else allow."""
    rows = pages.select("page_id", host_of(F.col("url").cast("string")).alias("host"), path_of(F.col("url").cast("string")).alias("path"))
    hosts = materialise(rows.select("host").distinct(), "url-hosts")
    cascades = cascade(hosts, hosts.where(listed_hosts(F.col("host"))), "host")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    out = ask(rows, "host", cascades, "listed", block_bytes)
    return out.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"))
