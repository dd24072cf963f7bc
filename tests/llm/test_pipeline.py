"""The stages in their order, each on what the one before it kept."""

import corpus_pipeline

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r.doc_id for r in docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = corpus_pipeline.common.materialise(stage(spark, docs, SF), name)
        now = {r.doc_id for r in out.select("doc_id").collect()}
        assert now <= before and now and (out.columns == COLUMNS or k + 1 == len(corpus_pipeline.STAGES))
        docs, before = out, now
    assert docs.columns == ["doc_id", "n_tokens", "token_ids", "decoded"]


def test_names_of_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "simhash_near_dedup", "substring_dedup", "benchmark_decontamination", "bpe_encoding"]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.common.materialise(stage(spark, docs, SF), name)
    assert docs.count() == 0
