"""Versioned artifacts: models, tables and plain values saved and loaded as one set.

Everything of a version is written below a folder of its own first; the version
exists from the moment its manifest, one small file with its own digest, is
whole.  A writer that dies earlier leaves no manifest, or one whose digest
doesn't fit, and readers go on with the newest whole version.  Manifests are
numbered; two writers that reach for one number are told apart by the exclusive
creation of the file, the later one takes the next number.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


@dataclass
class Artifact:
    version: int
    tables: dict[str, DataFrame]
    models: dict[str, PipelineModel]
    values: dict


def _folder(spark: SparkSession, base: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(base)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _sealed(body: str) -> str:
    return f"{body}\n{hashlib.sha256(body.encode()).hexdigest()}\n"


def children(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder; none if there is no folder."""
    fs, path = _folder(spark, folder)
    return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []


def _numbers(spark: SparkSession, base: str) -> list[int]:
    names = children(spark, f"{base}/manifests")
    return sorted(int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json") and n[9:-5].isdigit())


def _manifest(spark: SparkSession, base: str, number: int) -> dict | None:
    """The manifest, or null if it isn't whole."""
    fs, path = _folder(spark, f"{base}/manifests/manifest-{number:012d}.json")
    stream = fs.open(path)
    try:
        text = bytes(stream.readAllBytes()).decode("utf-8", "replace")
    finally:
        stream.close()
    body, _, _ = text.partition("\n")
    return json.loads(body) if text == _sealed(body) else None


def save(spark: SparkSession, base: str, tables: dict[str, DataFrame] | None = None, models: dict[str, PipelineModel] | None = None,
         values: dict | None = None) -> int:
    """Write a new version and return its number.  ``values`` must fit into JSON."""
    folder = f"{base}/parts/{uuid.uuid4().hex}"
    content = {"tables": {}, "models": {}, "values": values or {}}
    for name, df in (tables or {}).items():
        path = f"{folder}/tables/{name}"
        df.write.parquet(path)
        rows = spark.read.schema(df.schema).parquet(path).count()
        content["tables"][name] = {"path": path, "schema": df.schema.jsonValue(), "rows": rows}
    for name, model in (models or {}).items():
        path = f"{folder}/models/{name}"
        model.write().save(path)
        content["models"][name] = path
    text = _sealed(json.dumps(content, sort_keys=True))
    while True:
        number = max(_numbers(spark, base), default=0) + 1
        fs, path = _folder(spark, f"{base}/manifests/manifest-{number:012d}.json")
        try:
            stream = fs.create(path, False)
        except Py4JJavaError:
            if not fs.exists(path):
                raise
            continue  # another writer took the number
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        return number


def load(spark: SparkSession, base: str, version: int | None = None) -> Artifact:
    """The newest whole version, or the one named.  A table that lost rows since it was written is an error."""
    for number in [version] if version else reversed(_numbers(spark, base)):
        content = _manifest(spark, base, number)
        if content is None:
            continue
        tables = {}
        for name, t in content["tables"].items():
            tables[name] = spark.read.schema(T.StructType.fromJson(t["schema"])).parquet(t["path"])
            if (rows := tables[name].count()) != t["rows"]:
                raise ValueError(f"table {name} of version {number} has {rows} rows, {t['rows']} were written")
        return Artifact(number, tables, {n: PipelineModel.load(p) for n, p in content["models"].items()}, content["values"])
    raise FileNotFoundError(f"no whole artifact below {base}")
