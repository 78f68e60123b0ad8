import corpus_pipeline
from tests.llm import cases
from tests.llm.test_models import corpus


def test_stages(spark, tmp_path):
    rows, labels = corpus(300)
    rows += [(1000 + i, rows[i][1], *rows[i][2:]) for i in range(1, 40)]  # exact copies
    rows += [(2000 + r[0], *r[1:]) for r in cases.near_rows()] + [(3000 + r[0], *r[1:]) for r in cases.passage_rows()]
    rows += [(5000, None, None, None, None), (5001, "", "", "", 0)]
    docs = spark.createDataFrame(rows, cases.SCHEMA)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    now, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, now, str(tmp_path)).write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        seen[name] = now
        if name != "packing":
            assert now.columns == docs.columns
    toxic = {i for i, _, t in labels if t}
    kept = {r.doc_id for r in seen["toxicity"].collect()}
    assert len(toxic & kept) < 0.1 * len(toxic) and len(kept) > 0.95 * (len(rows) - len(toxic) * 1.2)
    texts = [(r.text or "").lower() for r in seen["exact_dedup"].collect()]
    assert len(texts) == len(set(texts))
    assert seen["near_dedup"].count() < seen["exact_dedup"].count()
    assert seen["repeated_substrings"].count() == seen["near_dedup"].count()
    assert {r.doc_id for r in now.select("doc_id").distinct().collect()} == {r.doc_id for r in seen["near_dedup"].collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "repeated_substrings", "packing"]
