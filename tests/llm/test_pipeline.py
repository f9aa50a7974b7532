import corpus_pipeline


def test_stages_keep_columns_and_work(spark, docs):
    slim = docs.select(*corpus_pipeline.COLUMNS)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        slim = spark.createDataFrame(stage(spark, slim, "").collect(), slim.schema)
        assert tuple(slim.columns) == corpus_pipeline.COLUMNS, name
        assert slim.count() > 0
    packed = corpus_pipeline.STAGES[-1][1](spark, slim, "")
    assert packed.groupBy("doc_id").count().count() == slim.select("doc_id").distinct().count()
