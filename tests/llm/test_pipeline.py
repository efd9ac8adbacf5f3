"""The corpus pipeline on the smallest tables, stage by stage."""

import corpus_pipeline
from tidemill.llm import decontaminate, neardup, secrets


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [k for k, _ in corpus_pipeline.STAGES] == ["language_id", "jaccard_join", "decontamination", "secret_scan", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = spark.createDataFrame(stage(spark, docs, sf_dir).collect(), before.schema)
        assert docs.columns == before.columns
        rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
        if name == "jaccard_join":
            assert all(n == 0 for _, n in neardup.brute_force(rows).values())
            want = {g for g, _ in neardup.brute_force([(r["doc_id"], r["text"]) for r in before.collect()]).values()}
            assert {i for i, _ in rows} == want
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    assert decontaminate.contamination(docs, benchmark).where("size(items) > 0").count() == 0
    assert secrets.find_secrets(docs).where("size(secrets) > 0").count() == 0
    assert docs.where("n_chars <> length(text)").count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert packed.select("doc_id").distinct().count() == docs.count()
