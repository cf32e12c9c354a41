import corpus_pipeline as C
import __spark_entry__ as entry
from vigilo.llm.common import shared_dir
from vigilo.llm.simhash import fingerprint
from vigilo.llm.toxicity import fit

from .helpers import awkward, empty
from .test_decontaminate import plain as contaminated
from .test_secrets import base
from .test_simhash import linked_sets

SF001 = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    entry._prepare(spark)
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{SF001}/benchmark.parquet").select("item_id", "text").collect()]
    columns = docs.columns
    for k, (name, stage) in enumerate(C.STAGES):
        before = docs.collect()
        path = shared_dir(spark, "test-pipeline")
        stage(spark, docs, SF001).write.parquet(path)
        after = spark.read.parquet(path).collect()
        ids = {r.doc_id for r in after}
        if k == 0:
            model = fit(docs, spark.read.parquet(f"{SF001}/labels.parquet"))
            s = model.scores([(r.text or "").encode() for r in before]) if model else [0.0] * len(before)
            assert ids == {r.doc_id for r, x in zip(before, s) if x < 0.7}
        elif k == 1:
            own = linked_sets([fingerprint((r.text or "").encode()) for r in before], 4)
            groups = {}
            for r, o in zip(before, own):
                groups.setdefault(o, []).append(r.doc_id)
            assert sorted(r.doc_id for r in after) == sorted(min(g) for g in groups.values())
        elif k == 2:
            assert ids == {r.doc_id for r in before if not contaminated(r.text, items, 10)[3]}
        elif k == 3:
            assert len(after) == len(before)
            for old, new in zip(sorted(before, key=lambda r: r.doc_id), sorted(after, key=lambda r: r.doc_id)):
                assert not base(new.text) and new.n_chars == len(new.text)
                assert new.text == old.text or base(old.text) or "<secret>" in new.text
        else:
            assert {r.doc_id for r in after} == {r.doc_id for r in before}
            ends = {}
            for r in sorted(after, key=lambda r: (r.sequence_id, r.offset)):
                assert r.offset == ends.get(r.sequence_id, 0)
                ends[r.sequence_id] = r.offset + r.length
            assert max(ends.values()) <= 2048
        docs = spark.read.parquet(path)
        if k < 4:
            assert docs.columns == columns
    assert entry.queries()["pipeline"](spark, SF001).count() == len(after)


def test_stages_on_awkward_rows(spark):
    for docs in (awkward(spark), empty(spark)):
        docs = docs.withColumnRenamed("h", "lang")
        for _, stage in C.STAGES:
            out = stage(spark, docs, SF001)
            assert out.count() <= docs.count() or "piece" in out.columns
    kept = C.drop_near_duplicates(spark, awkward(spark), SF001).collect()
    # one of the four equal ones (two of id 5, one of 8 in capitals), one of five without words, and the rest
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept) == [(False, 1), (False, 5), (False, 7), (False, 9), (True, 0)]


def test_every_operator_is_registered():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted({int(n[2:].split("_")[0]) for n in names}) == list(range(1, 14)) and len(names) == 13
    assert len(C.STAGES) == 5
