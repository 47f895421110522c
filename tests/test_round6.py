"""What the fifth review found, on small tables by hand."""

import re

import pytest
from pyspark.sql import functions as F

from graphloom.fixtures import view
from graphloom.operators import graph as g
from graphloom.operators import iterate as it
from graphloom.operators import packed
from graphloom.tables import BUCKETED, drop_written


@pytest.fixture
def shuffled(spark):
    """Plans as they are for large tables: no side is small enough to be broadcast."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield spark
    for k in conf:
        spark.conf.unset(k)


def _moves(rows, *columns) -> int:
    """How often a plan shuffles rows by keys that begin with one of the columns."""
    plan = rows._jdf.queryExecution().executedPlan().toString()
    return sum(c in columns for line in plan.split("\n") if "ReusedExchange" not in line for c in re.findall(r"Exchange hashpartitioning\((\w+)#", line))


def _graph(spark, sf):
    return view(spark, sf, "g_nodes"), view(spark, sf, "g_edges")


def test_induced_edges_move_once_to_each_end(shuffled, sf):
    """Edges that are made distinct where their source lies need no move of their own for it."""
    n, e = _graph(shuffled, sf)
    assert _moves(g.induced_edges(n, e), "src", "dst") == 2
    raw = e.select("src", "dst", "kind")
    assert raw.count() == raw.distinct().count()


def test_dangling_edges_move_once_to_each_end(shuffled, sf):
    n, e = _graph(shuffled, sf)
    assert _moves(g.dangling_edges(n.where("kind <> 'class'"), e), "src", "dst") == 2


def test_semantic_context_moves_edges_to_their_target_once_a_side(shuffled, sf):
    """The sets of names above need no further move, those below one by their source."""
    n, e = _graph(shuffled, sf)
    rows = g.semantic_context(n.where("layer = 'api'").select("file_path"), n, e)
    assert _moves(rows, "src", "dst", "o") == 4
    small = shuffled.createDataFrame([("a", "A", "f"), ("b", "B", "f"), ("c", "C", "h"), ("d", "C", "h")], "id string, name string, file_path string")
    edges = shuffled.createDataFrame([("a", "c", "x"), ("a", "c", "y"), ("a", "d", "x"), ("a", "z", "x"), ("c", "b", "x"), ("a", "b", "x"), ("z", "b", "x"), ("a", "a", "x")], "src string, dst string, kind string")
    got = g.semantic_context(small.where("file_path = 'f'").select("file_path"), small, edges).collect()
    assert sorted(map(tuple, got)) == [("a", ["A", "B", "C"], ["A"]), ("b", [], ["A", "C"])]


def test_rounds_move_only_what_they_found(shuffled):
    """The graph of a loop lies by the key that its rounds join on; dropping what is written takes it out of the catalog."""
    edges = shuffled.createDataFrame([(f"n{i}", f"n{i // 2}", "x") for i in range(1, 40)], "src string, dst string, kind string")
    for rows, key in ((it.towards(edges, "in"), "src"), (it.needs_of(edges, "dependencies_first"), "need")):
        front = shuffled.createDataFrame([("n1",), ("n2",)], "at string")
        met = front.join(rows, front["at"] == rows[key])
        assert _moves(met, key) == 0 and _moves(met, "at") == 1
        assert met.count() == 4  # n2 and n3 come before n1, n4 and n5 before n2
    drop_written(shuffled)
    assert not [t for t in shuffled.catalog.listTables() if t.name.startswith(BUCKETED)]


def test_rows_of_a_node_move_together(spark, monkeypatch):
    """Seeds of many blocks that meet at few nodes: the same rows whichever way they move, to crowded nodes too; a run
    of blocks moves as one row."""
    import random

    rng = random.Random(5)
    edges = spark.createDataFrame([(f"s{i}", f"m{rng.randrange(6)}") for i in range(900)] + [(f"m{rng.randrange(6)}", f"z{i % 40}") for i in range(200)] + [("z1", "m1"), ("z2", "s2")], "src string, dst string")
    seeds = spark.createDataFrame([(f"s{i}", f"s{i}") for i in range(900)], "seed string, node string")
    limit = seeds.selectExpr("seed", "CAST(substr(seed, 2) AS INT) % 3 AS max_depth")
    seen = []
    together = packed._together
    monkeypatch.setattr(packed, "_together", lambda *a: seen.append(a[3] is not None) or together(*a))
    found = []
    for wide, hot, run in ((1 << 40, 10_000, 6), (4, 10_000, 6), (1, 10, 0)):
        for name, value in (("WIDE", wide), ("HOT", hot), ("RUN", run)):
            monkeypatch.setattr(packed, name, value)
        found.append(sorted(map(tuple, it.reach(seeds, edges, "out", 2, limit).collect())))
    assert found[0] == found[1] == found[2] and len(found[0]) > 900
    assert set(seen) == {True, False}
    monkeypatch.undo()
    live = spark.range(640).selectExpr("'m' AS node", "id AS block", "CAST(NULL AS INT) AS most", "1L AS bits")
    adj = spark.createDataFrame([("m", "x"), ("m", "y")], "src string, dst string")
    none = live.where("false").selectExpr("node", "block", "most", "bits AS c", "bits AS s")
    plan = packed._together(live, adj, none, None)
    assert plan.count() == 1280 and plan.agg(F.max("block"), F.sum("c")).first()[:] == (639, 1280)
