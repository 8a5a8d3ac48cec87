import corpus_pipeline
from quern.llm import bpe


def test_stages_and_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, left = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf).cache()
        assert docs.columns == columns, name
        assert docs.count() <= left
        left = docs.count()
    out = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert {r.doc_id for r in out.collect()} == {r.doc_id for r in docs.collect()}
    coder = bpe.codec(corpus_pipeline.public_tokenizers.path(corpus_pipeline.RANK_FILE), corpus_pipeline.public_tokenizers.PATTERN)
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert {r.doc_id: r.n_tokens for r in out.collect()} == {k: len(coder.encode_all([t])[0]) // 4 for k, t in texts.items()}
    docs.unpersist()


def test_empty_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        assert docs.count() == 0
