"""The pipeline: stages in order, columns kept, decisions as a brute-force run makes them."""

from __future__ import annotations

import collections

import corpus_pipeline
from tests.llm.test_model_operators import expected_components
from tidemark.llm import mixing, packing, quality, toxicity
from tidemark.llm.common import materialize, read

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = read(spark, SF, "documents")
    columns, kept = docs.columns, {}
    current = docs
    for name, stage in corpus_pipeline.STAGES:
        out = materialize(stage(spark, current, SF), name)
        kept[name] = (current, out)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == columns
        current = out
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near_duplicates", "mixing", "packing"]

    labels = read(spark, SF, "labels")
    before, after = kept["toxicity"]
    rows = before.collect()
    scores = toxicity.score_texts(toxicity.fit(before, labels), [r.text for r in rows])
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r, s in zip(rows, scores, strict=True) if s < 0.5}

    before, after = kept["quality"]
    rows = before.collect()
    scores = quality.score_texts(quality.fit(before, labels), [r.text for r in rows])
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r, s in zip(rows, scores, strict=True) if s >= 0.7}

    before, after = kept["near_duplicates"]
    _, comp = expected_components({r.doc_id: r.text for r in before.collect()})
    assert sorted(r.doc_id for r in after.collect()) == sorted(set(comp.values()))

    before, after = kept["mixing"]
    want = {r.doc_id: r.copies for r in mixing.mix_report(before).collect() if r.copies}
    assert collections.Counter(r.doc_id for r in after.collect()) == want and len(want) <= before.count()

    before, after = kept["packing"]
    assert after.count() == before.count() and set(after.columns) >= {"doc_id", "bucket", "batch", "slot"}
    assert sorted(map(tuple, packing.pack(before).collect())) == sorted(map(tuple, after.collect()))


def test_different_texts_of_one_id(spark):
    """Two unlike texts under id 7 both stay; a copy of one of them under a larger id goes; null ids keep one of a group."""
    a, b = "one two three four five six seven eight", "nine ten eleven twelve thirteen fourteen fifteen"
    rows = [(7, a, "x"), (7, b, "x"), (9, a, "x"), (7, b, "x"), (None, b, "y"), (None, "a text of its own with many words", "y"), (None, "a text of its own with many words", "y"), (3, "", "z"), (3, None, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest string")
    for n in (1, 4):
        out = corpus_pipeline.drop_near_duplicates(spark, docs.repartition(n), SF)
        assert out.columns == docs.columns
        want = [(7, a, "x"), (7, b, "x"), (None, "a text of its own with many words", "y"), (3, "", "z"), (3, None, "z")]
        assert collections.Counter(map(tuple, out.collect())) == collections.Counter(want)


def test_every_stage_on_odd_and_empty_tables(spark, odd_documents, no_documents):
    for name, stage in corpus_pipeline.STAGES:
        last = name == corpus_pipeline.STAGES[-1][0]
        out = stage(spark, odd_documents, SF)
        assert out.columns[: len(odd_documents.columns)] == odd_documents.columns and (last or out.columns == odd_documents.columns)
        known = {tuple(r) for r in odd_documents.collect()}
        assert all(tuple(r)[: len(odd_documents.columns)] in known for r in out.collect())
        assert stage(spark, no_documents, SF).count() == 0, name


def test_work_tables_are_deleted(spark, tmp_path):
    """What a whole run leaves in the shared folder is its result."""
    import os

    base = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(base.removeprefix("file://")))
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    left = set(os.listdir(base.removeprefix("file://"))) - before
    assert len(left) == 1 and left.pop().startswith("pipeline-packing") and out.count() > 0


def test_whole_pipeline_on_an_empty_table(spark, no_documents, tmp_path):
    read(spark, SF, "documents").limit(0).write.parquet(f"file://{tmp_path}/documents.parquet")
    read(spark, SF, "labels").limit(0).write.parquet(f"file://{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0


def test_near_duplicates_odd(spark, odd_documents):
    out = corpus_pipeline.drop_near_duplicates(spark, odd_documents, SF)
    assert out.columns == odd_documents.columns
    assert collections.Counter(r.doc_id for r in out.collect()) == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 1, None: 1, 8: 1, 9: 1}
