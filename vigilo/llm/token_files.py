"""Token-ID output: Arrow files of fixed-size-list batches, and readers.

A shard file is an Arrow stream with its footer (the IPC file format).  Its columns are ``ids``, a
fixed-size list of ``length`` ids, and ``mask``, a fixed-size list of as many bits (false: padding).  All
batches but the last hold ``batch`` sequences, no buffer is compressed and none holds nulls, so every
sequence lies at a computed place and is read without copies through a memory map.  Beside it lies
``<shard>.docs.arrow`` with a row per document: its place in the shard and its number of tokens.

Defined results: a null text is empty and still gets the end id; documents with equal ids all come out,
in the order of their texts' hashes; null ids come first; an empty table gives no shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import byte_rows, crc32_u32, filesystem, free_name, materialise, shared_dir, text_of, write_whole
from .encode import encoder

MANIFEST = "shard int, path string, n_docs long, n_tokens long, n_sequences long"


class ShardWriter:
    """Fills sequences of ``length`` ids and writes a batch whenever ``batch`` of them are full."""

    def __init__(self, sink, dtype: np.dtype, length: int, batch: int, pad: int):
        self.length, self.batch, self.pad, self.dtype = length, batch, pad, dtype
        self.schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(dtype), length)), ("mask", pa.list_(pa.bool_(), length))])
        self.out = pa.ipc.new_file(sink, self.schema)
        self.waiting: list[np.ndarray] = []
        self.n_waiting = self.n_tokens = self.n_sequences = 0

    def add(self, ids: np.ndarray) -> int:
        """Append ids; the place of the first."""
        at = self.n_tokens
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        self.n_tokens += len(ids)
        if self.n_waiting >= self.length * self.batch:
            self._flush(False)
        return at

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.zeros(0, self.dtype)
        step = self.length * self.batch
        full = len(ids) // step * step
        for lo in range(0, full, step):
            self._write(ids[lo:lo + step], step)
        rest = ids[full:]
        if last and len(rest):
            size = -(-len(rest) // self.length) * self.length
            self._write(np.concatenate([rest, np.full(size - len(rest), self.pad, self.dtype)]), len(rest))
            rest = rest[:0]
        self.waiting, self.n_waiting = [rest], len(rest)

    def _write(self, ids: np.ndarray, real: int) -> None:
        mask = np.arange(len(ids)) < real
        self.out.write_batch(pa.record_batch([pa.FixedSizeListArray.from_arrays(pa.array(v), self.length) for v in (ids, mask)], schema=self.schema))
        self.n_sequences += len(ids) // self.length

    def close(self) -> None:
        self._flush(True)
        self.out.close()


class TokenFile:
    """Random access to a shard through a memory map (or a read buffer, for a store that has no maps)."""

    def __init__(self, uri: str):
        fs, path = filesystem(uri)
        source = pa.memory_map(path) if fs.type_name == "local" else fs.open_input_file(path)
        self.reader = pa.ipc.open_file(source)
        self.length = self.reader.schema.field("ids").type.list_size
        self.batches = self.reader.num_record_batches
        self.batch = self.reader.get_batch(0).num_rows if self.batches else 0

    def values(self, k: int) -> np.ndarray:
        """All ids of batch ``k``, as a view."""
        return self.reader.get_batch(k).column("ids").values.to_numpy(zero_copy_only=True)

    def sequence(self, i: int) -> np.ndarray:
        """Sequence ``i``, as a view."""
        return self.values(i // self.batch)[i % self.batch * self.length:][:self.length]

    def mask(self, i: int) -> np.ndarray:
        """The mask of sequence ``i``."""
        bits = self.reader.get_batch(i // self.batch).column("mask").values
        return bits.slice(i % self.batch * self.length, self.length).to_numpy(zero_copy_only=False)

    def span(self, start: int, n: int) -> np.ndarray:
        """``n`` ids from place ``start``; a view if they lie in one batch."""
        step, parts = self.batch * self.length, []
        while n > 0:
            part = self.values(start // step)[start % step:][:n]
            parts.append(part)
            start, n = start + len(part), n - len(part)
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, np.uint16)


DOCS = pa.schema([("doc_id", pa.int64()), ("place", pa.int64()), ("n_tokens", pa.int64())])


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int, length: int = 2048, batch: int = 128, blank: bool = True) -> DataFrame:
    """Encode ``docs(doc_id, text)`` in ascending doc_id order into shard files below ``folder``.

    Returns the manifest, a row per shard with its path and counts.  Rows are range-partitioned by doc_id;
    a hash of the text and the row's place break ties, so that many rows of one id spread over partitions."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, enc = TaskContext.get().partitionId(), encoder(tokenizer, blank)
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        uri, count, index = f"{folder}/shard-{shard:07d}.arrow", [0, 0, 0], []

        def write(sink):
            out = ShardWriter(sink, enc.dtype, length, batch, end_id)
            end = np.array([end_id], enc.dtype)

            def rows(b):
                place, size = [], []
                for ids in enc.encode_all(map(bytes, byte_rows(b.column(1)))):
                    place.append(out.add(ids))
                    out.add(end)
                    size.append(len(ids) + 1)
                index.append(pa.record_batch([b.column(0), pa.array(place, pa.int64()), pa.array(size, pa.int64())], schema=DOCS))

            rows(first)
            for b in batches:
                rows(b)
            out.close()
            count[:] = [sum(b.num_rows for b in index), out.n_tokens, out.n_sequences]

        def write_index(sink):
            with pa.ipc.new_file(sink, DOCS) as out:
                for b in index:
                    out.write_batch(b)

        write_whole(uri, write)
        write_whole(f"{uri[:-6]}.docs.arrow", write_index)
        yield pa.record_batch([pa.array([shard], pa.int32()), pa.array([uri]), *[pa.array([c], pa.int64()) for c in count]],
                              names=["shard", "path", "n_docs", "n_tokens", "n_sequences"])

    doc_id = F.col("doc_id").cast("long")
    rows = docs.select(doc_id.alias("doc_id"), text_of(docs).alias("text"))
    rows = rows.select("doc_id", "text", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("place"))
    dealt = rows.repartitionByRange("doc_id", "h", "place").sortWithinPartitions("doc_id", "h", "place").select("doc_id", "text")
    return materialise(dealt.mapInArrow(task, MANIFEST), "token-manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Read the shards back: a row per document with ``start`` (ids of all documents before it),
    ``n_tokens`` and ``ids_crc32``.

    The running sum is over the manifest, a row per shard; documents are read shard by shard."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                shard = TokenFile(path)
                fs, local = filesystem(f"{path[:-6]}.docs.arrow")
                with fs.open_input_file(local) as source:
                    index = pa.ipc.open_file(source)
                    for k in range(index.num_record_batches):
                        d = index.get_batch(k)
                        place, size = d.column("place").to_numpy(), d.column("n_tokens").to_numpy()
                        crc = [crc32_u32(shard.span(int(p), int(n))) for p, n in zip(place, size)]
                        yield pa.record_batch([d.column("doc_id"), pa.array(place + start), d.column("n_tokens"), pa.array(crc, pa.int64())],
                                              names=["doc_id", "start", "n_tokens", "ids_crc32"])

    total = F.coalesce(F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    n = max(1, manifest.count())
    return (manifest.select("path", total.alias("start")).repartition(n)
            .mapInArrow(task, "doc_id long, start long, n_tokens long, ids_crc32 long"))
