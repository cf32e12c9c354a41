"""Artifacts load as a whole or not at all."""

import os

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from vigilo.operators import ml as ML
from vigilo.sources import artifact, txn_events

SF = "/root/testdata/sf0.001"
NUM, CATS = ["amount", "velocity_score"], ["location", "device_used"]


def scores(model, d):
    out = model.transform(d).select("transaction_id", vector_to_array("probability")[1].alias("p"))
    return sorted((r.transaction_id, r.p) for r in out.collect())


def test_new_session_scores_alike(spark, tmp_path):
    d = txn_events(spark, SF)
    model = Pipeline(stages=[*ML.assembler(NUM, CATS), LogisticRegression(labelCol="is_fraud", maxIter=5)]).fit(d)
    history = d.select("sender_account", *CATS).distinct()
    assert artifact.save(spark, str(tmp_path), {"history": history, "none": history.limit(0)}, {"scorer": model}, {"features": NUM + CATS}) == 1
    other = spark.newSession()
    a = artifact.load(other, str(tmp_path))
    assert a.values == {"features": NUM + CATS}
    assert a.tables["none"].count() == 0 and a.tables["none"].dtypes == history.dtypes
    assert sorted(a.tables["history"].collect()) == sorted(history.collect())
    assert scores(a.models["scorer"], txn_events(other, SF)) == scores(model, d)


def test_half_written_versions_are_not_seen(spark, tmp_path):
    base = str(tmp_path)
    with pytest.raises(FileNotFoundError):
        artifact.load(spark, base)
    d = spark.range(10)
    assert [artifact.save(spark, base, {"t": d}, values={"v": 1}), artifact.save(spark, base, {"t": d.where("id < 5")}, values={"v": 2})] == [1, 2]
    # a writer dies between two tables: nothing committed
    broken = spark.range(5).select(F.raise_error(F.lit("lost")).cast("long").alias("id"))
    with pytest.raises(Exception, match="lost"):
        artifact.save(spark, base, {"t": d, "u": broken})
    assert artifact.load(spark, base).values == {"v": 2}
    # a manifest cut short is passed over
    newest = os.path.join(base, "manifests", "manifest-000000000002.json")
    with open(newest) as f:
        text = f.read()
    with open(os.path.join(base, "manifests", "manifest-000000000003.json"), "w") as f:
        f.write(text[:-30])
    assert artifact.load(spark, base).version == 2
    assert artifact.load(spark, base, 1).tables["t"].count() == 10
    # the next writer doesn't reuse the spoilt number
    assert artifact.save(spark, base, {"t": d}) == 4
