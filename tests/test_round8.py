"""Odd rows against SQL, and what a step may broadcast or move."""

from collections import Counter

import duckdb
from pyspark.sql import functions as F

from graphloom import queries_text, registry  # noqa: F401
from graphloom.llm import ballhash, common
from graphloom.operators import impact, iterate, packed
from graphloom.plans import blast


def test_change_type_of_empty_texts_is_that_of_its_sql(spark, tmp_path):
    texts = ["", "a", "", None, "b", "", "", "c", None, None, "d"]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(20, "a", "y"), (None, "", "y"), (21, None, None), (22, "e", None), (23, "", None)]
    path = f"{tmp_path}/documents.parquet"
    spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1).write.parquet(path)
    got = Counter(tuple(r) for r in registry.QUERIES["c2_change_type"](spark, str(tmp_path)).select("doc_id", "change_type").collect())
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    # before: an empty text after one was deleted, and two empty ones were modified
    assert got == Counter(duck.execute(registry.ORACLES["c2_change_type"]).fetchall())


def test_near_duplicates_broadcast_nothing(spark, monkeypatch):
    plans = []
    for module in (common, ballhash):
        monkeypatch.setattr(module, "written", lambda df, w=common.written: plans.append(df._jdf.queryExecution().executedPlan().toString()) or w(df))
    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("some words of a text"), F.col("id") % 30).alias("text"))
    got = ballhash.classes(docs)
    plans.append(got._jdf.queryExecution().executedPlan().toString())
    assert got.count() == 60 and {r["component_id"] for r in got.collect()} <= set(range(30))
    kept = ballhash.one_of_each(docs)
    plans.append(kept._jdf.queryExecution().executedPlan().toString())
    # before: the 66 keys of a fingerprint were sized like the fingerprint, and sent to the driver whole
    assert any("SortMergeJoin" in p for p in plans) and not any("BroadcastExchange" in p for p in plans)


def _small_graph(spark):
    nodes = [(f"n{i}", f"/f{i % 7}.ts", ["api", "frontend", "backend"][i % 3], "class", f"N{i}") for i in range(40)]
    edges = [(f"n{i}", f"n{j}", "imports") for i in range(40) for j in (i * 3 % 11, (i * 5 + 2) % 40, 1) if i != j]
    own = [(f"c{i % 7}", f"/f{i % 7}.ts", i == 1, i == 2, i % 3 == 0, i % 3) for i in range(9)]
    classified = spark.createDataFrame(own, "id string, file_path string, is_type boolean, is_schema boolean, is_api boolean, severity int")
    return classified, spark.createDataFrame(nodes, "id string, file_path string, layer string, kind string, name string"), spark.createDataFrame(edges, "src string, dst string, kind string")


def test_propagation_sorts_no_rows_to_find_its_source(spark, monkeypatch):
    plans = []
    for module in (impact, iterate, packed):
        monkeypatch.setattr(module, "written", lambda df, w=common.written: plans.append(df._jdf.queryExecution().executedPlan().toString()) or w(df))
    found = impact.propagate(*_small_graph(spark))
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    # before: rounds and result took minima of names, for which Spark sorts all rows by their keys
    assert found.count() and not any("SortAggregate" in p for p in plans)


def test_propagation_without_source_touches_the_same(spark, monkeypatch):
    rows = lambda df: sorted(map(tuple, df.select("change_id", "id", "depth", "severity", "requires_update").collect()))
    args = _small_graph(spark)
    want = rows(impact.propagate(*args))
    full = sorted(map(tuple, impact.propagate(*args).collect()))
    assert want and rows(impact.propagate(*args, via=False)) == want
    for module in (packed, iterate):
        monkeypatch.setattr(module, "HOT", 2, raising=False)
    assert sorted(map(tuple, impact.propagate(*args).collect())) == full and rows(impact.propagate(*args, via=False)) == want


def test_members_of_plans_move_together(spark, monkeypatch):
    _, nodes, edges = _small_graph(spark)
    nodes = nodes.select("id").crossJoin(spark.range(70).withColumnRenamed("id", "grp")).where("hash(id, grp) % 3 <> 0").select("grp", "id")
    rows = lambda: sorted(((r["grp"], r["id"], r["level"], r["position"]) for r in iterate.topological_levels(nodes, edges).collect()), key=str)
    monkeypatch.setattr(packed, "WIDE", 10**6)
    want, plans = rows(), []
    monkeypatch.setattr(packed, "written", lambda df, w=common.written: plans.append(df._jdf.queryExecution().toString()) or w(df))
    for hot in (10_000, 3):
        monkeypatch.setattr(packed, "WIDE", 1)
        monkeypatch.setattr(packed, "HOT", hot)
        assert rows() == want and {r[2] for r in want} > {None, 0}
    # before: each round moved a row for each edge and block
    assert any("inline(sets" in p for p in plans)


def test_plans_tell_edges_apart_once(spark, monkeypatch):
    _, nodes, edges = _small_graph(spark)
    made = []
    monkeypatch.setattr(blast, "towards", lambda e, way: made.append(way) or iterate.towards(e, way))
    plans = spark.createDataFrame([("p", "/f1.ts"), ("q", "/f3.ts")], "plan_id string, root_file string")
    plan = blast.plan_from_files(plans, nodes, edges)
    assert made[0] == "out" and plan.where("is_root").count() == 2
    # before: every step made the edges distinct anew
    assert len(made) == 3


def test_rows_of_many_blocks_move_as_one(spark, monkeypatch):
    live = spark.range(300).select(F.lit("a").alias("node"), F.col("id").alias("block"), F.lit(None).cast("int").alias("most"), F.lit(5).cast("long").alias("bits"))
    adj, parts = spark.createDataFrame([("a", "b"), ("a", "c")], "src string, dst string"), []
    monkeypatch.setattr(packed, "union", lambda p, u=packed.union: parts.extend(p) or u(p))
    got = packed._together(live, adj, live.select(*packed.KEY, F.lit(0).cast("long").alias("c"), F.col("bits").alias("s")), None)
    assert got.where("c = 5").count() == 600 and got.where("s = 5").count() == 300
    # before: a row for every 64 blocks
    assert parts[0].count() == 2
