"""Helpers shared by the operators: tables, shared folders, guarded files."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Batches to and from Python workers of at most 8 MB or 4000 rows (a longer row is alone)."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4000")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder."""
    return scratch_path(spark, name)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` once to the shared folder and read it back.

    The copy survives lost executors, and later steps see the same rows however often they are run."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a shared folder; plain paths are local mounts."""
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def write_whole(uri: str, write: Callable) -> None:
    """Write a file under a private name and rename it, so that readers see whole files only and a
    repeated task attempt replaces the file with equal bytes."""
    fs, path = filesystem(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex[:8]}.part"
    with fs.open_output_stream(part) as sink:
        write(sink)
    fs.move(part, path)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def text_of(df: DataFrame, column: str = "text"):
    """The text column as a non-null string."""
    return F.coalesce(df[column].cast("string"), F.lit(""))


def byte_rows(array: pa.Array) -> Iterator[memoryview]:
    """The values of a string or binary column as views of Arrow's buffer; nulls are empty."""
    if isinstance(array, pa.ChunkedArray):
        for chunk in array.chunks:
            yield from byte_rows(chunk)
        return
    if not len(array):
        return
    wide = pa.types.is_large_binary(array.type) or pa.types.is_large_string(array.type)
    _, offsets, data = array.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32, len(array) + 1 + array.offset)[array.offset:].tolist()
    view = memoryview(data) if data is not None else memoryview(b"")
    for i in range(len(array)):
        yield view[at[i]:at[i + 1]]


def crc32_u32(ids: np.ndarray) -> int:
    """Unsigned CRC-32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4").tobytes())


def crc32_ids(ids: pa.Array, length: pa.Array) -> pa.Array:
    """``crc32_u32`` of ids packed in as many bytes as there are to ``length`` of them."""
    size = length.to_numpy(zero_copy_only=False).tolist()
    return pa.array([crc32_u32(np.frombuffer(x, f"<u{len(x) // n}")) for x, n in zip(byte_rows(ids), size)], pa.int64())
