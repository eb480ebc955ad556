"""The pipeline's stages on odd rows: columns, order and effects."""

import corpus_pipeline

from lettermill.llm import queries


def test_stages(spark, odd, tmp_path):
    folder = str(tmp_path)
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(6, 1, 0), (9, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "suffix_dedup", "packing"]
    at = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, folder)
        assert at.columns == docs.columns
    got = corpus_pipeline.run(spark, folder)
    assert {r["doc_id"] for r in got.select("doc_id").collect()} == {r["doc_id"] for r in at.select("doc_id").collect()}


def test_every_operator_is_registered():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{k}" for k in range(1, 14)]
