"""Relational queries on nodes(id, kind, name, file_path, layer) and edges(src, dst, kind)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.tables import written

#: Which kind of node stands for its file.
KIND_PRIORITY = {"class": 10, "component": 9, "interface": 8, "module": 7, "function": 6, "file": 5}
#: In an exported graph, colours of nodes by layer, of edges by kind, of all others, and sizes by kind.
LAYER_COLOR = {"database": "#f43f5e", "backend": "#0ea5e9", "api": "#10b981", "frontend": "#3b82f6", "config": "#f59e0b", "infrastructure": "#06b6d4"}
EDGE_COLOR = {"imports": "#3498db", "exports": "#2ecc71", "calls": "#e74c3c", "extends": "#f39c12", "implements": "#9b59b6", "provides": "#1abc9c"}
OTHER_COLOR = "#94a3b8"
KIND_SIZE = {
    "file": 8, "class": 12, "function": 6, "interface": 10, "api_endpoint": 14, "db_table": 14, "component": 10, "module": 12, "type": 6,
    "hook": 8, "variable": 4, "constant": 4, "enum": 8, "db_column": 4, "db_relation": 6, "package": 10,
}
OTHER_SIZE = 6


def mapped(c: Column, table: dict, default) -> Column:
    """c through a small fixed table."""
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), c), F.lit(default))


def adjacency(edges: DataFrame) -> DataFrame:
    """Distinct (src, dst): parallel edges of other kinds are one."""
    return edges.select("src", "dst").distinct()


def intact_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose two ends exist."""
    ids = nodes.select("id").distinct()
    out = edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi")
    return out.join(ids.select(F.col("id").alias("dst")), "dst", "left_semi").select(*edges.columns)


induced_edges = intact_edges


def dangling_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges that miss an end, with which one is missing: src, dst or both."""
    ids = nodes.select("id").distinct()
    j = edges.join(ids.select(F.col("id").alias("src"), F.lit(1).alias("s")), "src", "left").join(ids.select(F.col("id").alias("dst"), F.lit(1).alias("t")), "dst", "left")
    missing = F.when(F.col("s").isNull() & F.col("t").isNull(), "both").when(F.col("s").isNull(), "src").when(F.col("t").isNull(), "dst")
    return j.withColumn("missing", missing).where("missing is not null").select(*edges.columns, "missing")


def neighbors(seeds: DataFrame, edges: DataFrame, direction: str = "out") -> DataFrame:
    """(seed, id): direct dependencies (out), dependents (in) or both of seeds(seed), each once."""
    adj = adjacency(edges)
    out = adj.select(F.col("src").alias("seed"), F.col("dst").alias("id"))
    back = adj.select(F.col("dst").alias("seed"), F.col("src").alias("id"))
    side = {"out": out, "in": back, "both": out.unionByName(back).distinct()}[direction]
    return side.join(seeds.select("seed").distinct(), "seed").select("seed", "id")


def incident_edges(seeds: DataFrame, edges: DataFrame, direction: str = "out") -> DataFrame:
    return edges.join(seeds.select(F.col("seed").alias({"out": "src", "in": "dst"}[direction])).distinct(), {"out": "src", "in": "dst"}[direction]).select(*edges.columns)


def edges_between(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    return edges.join(pairs.select("src", "dst").distinct(), ["src", "dst"]).select(*edges.columns)


def cross_layer_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose ends lie in different layers, with those layers."""
    s = nodes.select(F.col("id").alias("src"), F.col("layer").alias("src_layer"))
    t = nodes.select(F.col("id").alias("dst"), F.col("layer").alias("dst_layer"))
    return edges.join(s, "src").join(t, "dst").where("src_layer <> dst_layer").select("src", "dst", "kind", "src_layer", "dst_layer")


def degrees(nodes: DataFrame, edges: DataFrame, hub_above: int = 10) -> DataFrame:
    """id, in_degree, out_degree, degree (distinct neighbours each way) and is_hub for every node."""
    adj = adjacency(edges)
    both = adj.select(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(adj.select(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    d = both.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    z = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    out = nodes.select("id").join(d, "id", "left").select("id", z("in_degree"), z("out_degree"))
    return out.withColumn("degree", F.col("in_degree") + F.col("out_degree")).withColumn("is_hub", F.col("degree") > hub_above)


def most_connected(nodes: DataFrame, edges: DataFrame, n: int) -> DataFrame:
    return degrees(nodes, edges).orderBy(F.desc("degree"), "id").limit(n).select("id", "degree")


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes other than files that no edge touches."""
    used = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()
    return nodes.where("kind <> 'file'").join(used, "id", "left_anti")


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(layer, nodes, edges): a row for each layer, edges by the layer of their source, and a total row with a null layer."""
    a = nodes.groupBy("layer").agg(F.count("*").alias("nodes"), F.lit(0).cast("long").alias("edges"))
    e = edges.join(nodes.select(F.col("id").alias("src"), "layer"), "src").groupBy("layer").agg(F.lit(0).cast("long").alias("nodes"), F.count("*").alias("edges"))
    return a.unionByName(e).rollup("layer").agg(F.sum("nodes").alias("nodes"), F.sum("edges").alias("edges"))


def primary_node(nodes: DataFrame) -> DataFrame:
    """One node for each file, by the priority of its kind, then id."""
    at = Window.partitionBy("file_path").orderBy(F.desc(mapped(F.col("kind"), KIND_PRIORITY, 0)), "id")
    return nodes.withColumn("__rn", F.row_number().over(at)).where("__rn = 1").drop("__rn")


def filter_nodes(nodes: DataFrame, kind=None, layer=None, file=None, id=None) -> DataFrame:
    """Equality filters; a file matches case-insensitively with either slash."""
    for name, value in (("kind", kind), ("layer", layer), ("id", id)):
        if value is not None:
            nodes = nodes.where(F.col(name) == value)
    if file is not None:
        nodes = nodes.where(F.lower(F.replace(F.col("file_path"), F.lit("\\"), F.lit("/"))) == file.replace("\\", "/").lower())
    return nodes


def search_names(nodes: DataFrame, q: str, limit: int = 50) -> DataFrame:
    return nodes.where(F.lower("name").contains(q.lower())).orderBy("name", "id").limit(limit)


def semantic_context(files: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, dependencies, dependents): sorted names of neighbours of each node of files(file_path)."""
    own = nodes.join(files.select("file_path").distinct(), "file_path", "left_semi").select("id")
    adj, names, ids = adjacency(edges), nodes.select("id", "name"), own.distinct()
    below = adj.join(ids, adj["src"] == ids["id"], "left_semi")
    down = below.join(names, F.col("dst") == names["id"]).groupBy(F.col("src").alias("o")).agg(F.array_sort(F.collect_set("name")).alias("dependencies"))
    # names come to the edges at their source, so that one move to the target serves the choice and the sets; a semi join
    # would be made before that with the names
    above = adj.join(names, F.col("src") == names["id"]).select("dst", "name").join(ids.withColumnRenamed("id", "own"), F.col("dst") == F.col("own"))
    up = above.groupBy(F.col("dst").alias("o")).agg(F.array_sort(F.collect_set("name")).alias("dependents"))
    none = F.array().cast("array<string>")
    return own.join(down, own["id"] == down["o"], "left").drop("o").join(up, own["id"] == up["o"], "left").select("id", F.coalesce("dependencies", none).alias("dependencies"), F.coalesce("dependents", none).alias("dependents"))


def direct_impact(nodes: DataFrame, edges: DataFrame, limit: int = 10) -> DataFrame:
    """(file_path, id): the first `limit` direct dependents of each file's nodes, by id."""
    adj = adjacency(edges)
    d = nodes.select("id", "file_path").join(adj, F.col("id") == F.col("dst")).select("file_path", F.col("src").alias("id")).distinct()
    at = Window.partitionBy("file_path").orderBy("id")
    return d.withColumn("rn", F.row_number().over(at)).where(F.col("rn") <= limit).select("file_path", "id")


def graph_export(nodes: DataFrame, edges: DataFrame, max_nodes: int, layer: str | None = None, kind: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes and edges to draw of the most connected part of a filtered graph, and the statistics of the whole graph.

    Nodes: id, label, kind, layer, color, size, file_path. Edges: source, target, label, color.
    """
    chosen = filter_nodes(nodes, kind=kind, layer=layer)
    inner = induced_edges(chosen, edges)
    top = written(most_connected(chosen, inner, max_nodes))
    shown = chosen.join(top.select("id"), "id").select(
        "id", F.col("name").alias("label"), "kind", "layer", mapped(F.col("layer"), LAYER_COLOR, OTHER_COLOR).alias("color"),
        mapped(F.col("kind"), KIND_SIZE, OTHER_SIZE).alias("size"), "file_path",
    )
    # both ends of such an edge are chosen ones, so it need not be looked up among the inner edges
    lines = induced_edges(top, edges).select(
        F.col("src").alias("source"), F.col("dst").alias("target"), F.col("kind").alias("label"), mapped(F.col("kind"), EDGE_COLOR, OTHER_COLOR).alias("color")
    )
    return shown, lines, graph_stats(nodes, edges)
