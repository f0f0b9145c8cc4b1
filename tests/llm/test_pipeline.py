import corpus_pipeline
from chromaloom.llm import quality
from tests.llm.cases import documents
from tests.llm.test_models import quality_rows


def test_stages_take_effect(spark, tmp_path):
    rows, labels = quality_rows(300, 7)
    passage = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    good = [r for r, m in zip(rows, labels, strict=True) if m[1]]
    extra = [(1000, good[0][1], "en", "s", 1), (1001, good[1][1] + " " + passage, "en", "s", 1), (1002, None, "en", None, None)]
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([*rows, *extra], kind)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    frames = [docs]
    for _, stage in corpus_pipeline.STAGES:
        frames.append(stage(spark, frames[-1], str(tmp_path)).cache())
    for frame in frames[1:-1]:
        assert frame.columns == docs.columns
    truth = {k: q for k, q, _ in labels}
    kept = {r.doc_id for r in frames[1].collect()}
    assert sum((k in kept) == bool(q) for k, q in truth.items()) >= 0.97 * len(truth)
    after = {r.doc_id: r.text for r in frames[4].collect()}
    assert 1000 not in after and good[0][0] in after
    assert all(passage not in (t or "") for t in after.values())
    last = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in last} == set(after) and all(r.same_text for r in last)


def test_awkward_documents(spark, tmp_path):
    docs = documents(spark)
    spark.createDataFrame([(0, 1, 0), (4, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for frame in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, frame, str(tmp_path))
            if name != "encoding":
                assert out.columns == docs.columns
            assert out.count() <= docs.count()
    assert quality.THRESHOLD == 0.3
