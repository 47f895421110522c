"""Exact and approximate vector search against every pair."""

import math
import random

import pytest

from graphloom.operators import retrieval, vectorindex


def cosine(a, b):
    na, nb = math.sqrt(sum(x * x for x in a)), math.sqrt(sum(x * x for x in b))
    return round(sum(x * y for x, y in zip(a, b)) / (na * nb), 9)


def fine(v, dim):
    return v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v) and any(v)


def brute(queries, chunks, k, dim):
    out = set()
    for q, v in queries:
        if fine(v, dim):
            hits = sorted((-cosine(v, e), i) for i, e in chunks if i is not None and fine(e, dim) and cosine(v, e) > 0)[:k]
            out |= {(q, i, -s, n + 1) for n, (s, i) in enumerate(hits)}
    return out


def clustered(rnd, n, dim, centers):
    return [[c + rnd.gauss(0, 0.15) for c in centers[rnd.randrange(len(centers))]] for _ in range(n)]


@pytest.mark.parametrize("k", [1, 7])
def test_search_equals_every_pair(spark, monkeypatch, k):
    monkeypatch.setattr(vectorindex, "BLOCK", 16)
    monkeypatch.setattr(vectorindex, "PART", 2)
    monkeypatch.setattr(vectorindex, "BATCH", 5)
    rnd = random.Random(k)
    centers = [[rnd.gauss(0, 1) for _ in range(6)] for _ in range(12)]
    vectors = clustered(rnd, 400, 6, centers) + [[rnd.gauss(0, 1) for _ in range(6)] for _ in range(100)] + [centers[0]] * 150
    chunks = list(enumerate(vectors)) + [(900, None), (901, [0.0] * 6), (902, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (903, [float("nan")] * 6), (904, [1.0] * 5), (None, centers[1]), (905, [float("inf")] * 6)]
    rnd.shuffle(chunks)
    queries = [(i, v) for i, v in chunks if i is not None and i % 9 == 0] + [(2000, [-x for x in centers[0]]), (2001, [1.0])]
    c = spark.createDataFrame(chunks, "id long, embedding array<double>").repartition(5)
    q = spark.createDataFrame(queries, "query_id long, vector array<double>")
    found = retrieval.vector_search(q, c, k)
    assert {tuple(r) for r in found.select("query_id", "id", "similarity", "rank").collect()} == brute(queries, chunks, k, 6)


def test_few_cells_are_visited_where_vectors_gather(spark):
    rnd = random.Random(5)
    centers = [[rnd.gauss(0, 1) for _ in range(8)] for _ in range(30)]
    chunks = spark.createDataFrame(list(enumerate(clustered(rnd, 900, 8, [[20 * x for x in c] for c in centers]))), "id long, embedding array<double>")
    index = vectorindex.build(chunks)
    q = vectorindex.usable(chunks.where("id % 10 = 0").selectExpr("id AS query_id", "embedding"), "query_id", "embedding")
    first = vectorindex.best(vectorindex._met(vectorindex._visits(q.selectExpr("*", "0.0D AS bar"), index, 5, False), index, 5), 5)
    bars = first.where("rank = 5").selectExpr("query_id", "similarity AS bar")
    later = vectorindex._visits(q.join(bars, "query_id"), index, 5, True).selectExpr("sum(size(queries))").first()[0] or 0
    assert later < 0.25 * 90 * len(index.centroids)


def test_no_cross_join_in_plans(spark, capsys):
    c = spark.createDataFrame([(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(50)], "id long, embedding array<double>")
    q = c.where("id < 5").selectExpr("id AS query_id", "embedding AS vector")
    retrieval.vector_search(q, c, 3).explain()
    retrieval.sketch_search(q, c, 3, dims=1).explain()
    plan = capsys.readouterr().out
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_empty_inputs_and_text_keys(spark):
    c = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 1.0]), ("c", [1.0, 1.0])], "id string, embedding array<float>")
    q = spark.createDataFrame([("x", [0.5, 0.5])], "query_id string, vector array<float>")
    assert [tuple(r) for r in retrieval.vector_search(q, c, 2).orderBy("rank").select("query_id", "id", "similarity", "rank").collect()] == [("x", "b", 1.0, 1), ("x", "c", 1.0, 2)]
    assert retrieval.vector_search(q, c.where("false"), 2).count() == 0
    assert retrieval.vector_search(q.where("false"), c, 2).count() == 0


def test_recall_of_sketches(spark):
    rnd = random.Random(9)
    centers = [[rnd.gauss(0, 1) for _ in range(32)] for _ in range(6)]
    chunks = list(enumerate(clustered(rnd, 600, 32, centers)))
    queries = [(i, v) for i, v in chunks if i % 20 == 0]
    c, q = spark.createDataFrame(chunks, "id long, embedding array<double>"), spark.createDataFrame(queries, "query_id long, vector array<double>")
    want = {r[:2] for r in brute(queries, chunks, 5, 32)}
    got = {(r["query_id"], r["id"]) for r in retrieval.sketch_search(q, c, 5, over=30).collect()}
    assert len(got & want) >= 0.9 * len(want)
