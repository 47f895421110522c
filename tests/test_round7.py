"""What a task holds does not grow with a table where its rows can be split."""

from pyspark.sql import functions as F

from graphloom.operators import retrieval


def test_words_of_chunks_are_ranked_in_split_tasks(spark, monkeypatch):
    plans, written = [], retrieval.written
    monkeypatch.setattr(retrieval, "written", lambda df: plans.append(df._jdf.queryExecution().toString()) or written(df))
    chunks = spark.range(40).select("id", F.concat_ws(" ", F.lit("all"), F.concat(F.lit("word"), F.col("id") % 4)).alias("content"))
    queries = spark.createDataFrame([(1, "word2 no"), (2, "ALL word3")], "query_id long, text string")
    got = sorted((r["query_id"], r["id"], r["rank"]) for r in retrieval.keyword_search(queries, chunks, 3).collect())
    assert got == [(1, 2, 1), (1, 6, 2), (1, 10, 3), (2, 0, 1), (2, 1, 2), (2, 2, 3)]
    # before: words were sorted in the tasks that the join of texts left, however large those were
    assert any("REBALANCE_PARTITIONS" in p for p in plans)
