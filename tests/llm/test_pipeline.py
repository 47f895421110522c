"""Each stage of the corpus pipeline on its own input."""

import corpus_pipeline
from tests.llm.test_docs_ops import check_packing


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    before = {r["doc_id"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        from graphloom.llm.common import written

        out = written(out)
        rows = out.collect()
        assert {r["doc_id"] for r in rows} <= before and rows
        if name == "quality classifier":
            good = [i for i, q in labels.items() if q == 1]
            assert sum(i in {r["doc_id"] for r in rows} for i in good) > 0.9 * len(good)
        if name == "line dedup":
            assert {r["doc_id"] for r in rows} == before
            assert all(r["n_chars"] == len(r["text"]) for r in rows)
        docs, before = out, {r["doc_id"] for r in rows}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs.dropDuplicates(["doc_id"]), sf).collect()
    check_packing(packed, {r["doc_id"]: r["text"] for r in docs.collect()})
    assert corpus_pipeline.run(spark, sf).count() > 0
