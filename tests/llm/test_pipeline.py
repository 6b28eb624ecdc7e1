import corpus_pipeline


def test_pipeline(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    out = corpus_pipeline.run(spark, d).collect()
    ids = [r.doc_id for r in out]
    assert len(ids) == len(set(ids)) and set(ids) <= {r.doc_id for r in docs.collect()}
    assert len(ids) > 0.8 * docs.count() and all(r.round_trip for r in out)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, d).columns == docs.columns
