"""A document pipeline: toxic documents go, near-duplicates go but one of each group, benchmark text goes, secrets
are blanked out, and what is left is packed into sequences.

Every stage takes all documents of the one before.  Its result is written as Parquet to the shared checkpoint folder
and read again, so a lost executor costs a stage's tasks at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilo.llm.common import bound_batches, free_name, materialise, shared_dir, table
from vigilo.llm.decontaminate import decontaminate
from vigilo.llm.queries import packed_documents
from vigilo.llm.secrets import redact
from vigilo.llm.simhash import near_duplicates
from vigilo.llm.toxicity import harmless

#: SQL can express neither the machine nor the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator scores under 0.7, learned from the stage's own documents.  Null and empty texts
    have no evidence but the bias; repeated rows are scored alike and stay or go together."""
    bound_batches(spark)
    return harmless(docs, table(spark, sf_dir, "labels"), threshold=0.7)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash group (four words, four bits) the row of the smallest doc_id; of rows that repeat this id the
    smallest by its columns.  Rows without an id rank behind all others, by a hash of their text."""
    bound_batches(spark)
    key = free_name(docs, "row_id")
    nameless = F.lit(1 << 62) + F.xxhash64(F.coalesce("text", F.lit(""))).bitwiseAND(F.lit((1 << 61) - 1))
    rows = docs.withColumn(key, F.coalesce(F.col("doc_id").cast("long"), nameless))
    found = materialise(near_duplicates(rows, shingle=4, max_bits=4, doc_id=key).select(F.col("doc_id").alias(key), "component_id"), "near-duplicates")
    # merged at every size, so that what is shuffled grows as the documents do
    own = found.where(F.col(key) == F.col("component_id")).select(key).distinct().hint("merge")
    repeated = materialise(found.groupBy(key).count().where("count > 1").select(key), "repeated-ids")
    kept = rows.join(own, key, "left_semi")
    if repeated.isEmpty():
        return kept.select(*docs.columns)
    one = kept.join(repeated, key, "left_semi").groupBy(key).agg(F.min(F.struct(*docs.columns)).alias("row"))
    return kept.join(repeated, key, "left_anti").select(*docs.columns).unionByName(one.select("row.*"))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of ten benchmark words occurs.  Null and empty texts have no words and stay; repeated
    rows stay or go together."""
    bound_batches(spark)
    return decontaminate(docs, table(spark, sf_dir, "benchmark"), window=10)


def blank_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every reported secret replaced by a mark and ``n_chars`` counted anew."""
    clean = redact(docs, mark="<secret>")
    changed = F.char_length("text").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None
    return clean if changed is None else clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(changed))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces and their places in sequences of 2048 tokens.  Null and empty texts have the end id as their
    only token; each of repeated rows has pieces of its own."""
    bound_batches(spark)
    return packed_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dup", drop_near_duplicates),
    ("benchmark_decontamination", drop_benchmark),
    ("secret_scan", blank_secrets),
    ("best_fit_packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
