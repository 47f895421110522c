"""Loops over a graph. The driver only learns whether a round found anything; every round is a written table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.graph import adjacency
from graphloom.operators.packed import crowded, numbered, packed, peeled, spread
from graphloom.operators.packed import union as _union
from graphloom.tables import bucketed, written

#: A start's number takes the low PLACE bits of a code; a row's set holds up to 1 << SETS seeds.
PLACE, SETS = 40, 10


def reach(seeds: DataFrame, edges: DataFrame, direction: str = "out", max_depth: int | None = None, limit: DataFrame | None = None) -> DataFrame:
    """(seed, node, depth): nodes within max_depth hops of each seeds(seed, node), by fewest hops; the start excluded.

    limit(seed, max_depth) bounds each seed's own depth. One search may start from several nodes of the same seed.
    """
    at = packed(seeds, limit)
    return at.unpacked(spread(at.start, towards(edges, direction), max_depth).where("depth > 0")).select("seed", "node", "depth")


@dataclass(frozen=True)
class Nearest:
    """names(g, seed) and origins(n, origin) by number; rows(node, sets, depth), where sets holds codes: g above n."""

    names: DataFrame
    origins: DataFrame
    rows: DataFrame

    def codes(self, rows: DataFrame) -> DataFrame:
        """A row for each code of rows(sets, ...): g, n and the other columns."""
        keep = [c for c in rows.columns if c != "sets"]
        one = rows.select(*keep, F.explode("sets").alias("code"))
        return one.select(*keep, F.shiftright("code", PLACE).alias("g"), F.col("code").bitwiseAND((1 << PLACE) - 1).alias("n"))


def _in_sets(rows: DataFrame) -> DataFrame:
    """(node, sets) of rows(node, code), which lie by their node."""
    return rows.groupBy("node", F.shiftright("code", PLACE + SETS)).agg(F.collect_list("code").alias("sets")).select("node", "sets")


def nearest_sets(seeds: DataFrame, edges: DataFrame, direction: str = "out", max_depth: int | None = None) -> Nearest:
    """nearest() with what a node is reached from in arrays of longs: a node's seeds go along its edges together.

    Seeds and starts are numbered in order, so that the smallest origin of a seed has its smallest code, and rounds neither
    sort nor move names. What meets at a node is told apart where the node lies; only at nodes with more than HOT edges is it
    combined before it is moved. At most 2**23 seeds and 2**40 starts.
    """
    numbers = lambda c, name: written(numbered(c.distinct().withColumn("one", F.lit(0)), "one", c.columns, name).drop("one"))
    names, origins = numbers(seeds.select("seed"), "g"), numbers(seeds.select(F.col("node").alias("origin")), "n")
    adj = towards(edges, direction)
    hot = crowded(adj)
    first = seeds.join(names, "seed").join(origins, F.col("node") == F.col("origin")).select("node", F.shiftleft("g", PLACE).bitwiseOR(F.col("n")).alias("code")).distinct()
    frontier, depth = written(_in_sets(first.repartition("node"))), 0
    layers, seen = [frontier.withColumn("depth", F.lit(0))], [frontier]
    while max_depth is None or depth < max_depth:
        depth += 1
        along = lambda to: frontier.join(to, frontier["node"] == to["src"]).select(to["dst"].alias("node"), "sets")  # noqa: B023, E731
        moved = [along(adj if hot is None else adj.join(hot, "dst", "left_anti"))]
        if hot is not None:
            warm = along(adj.join(hot, "dst", "left_semi")).select("node", F.explode("sets").alias("code"))
            warm = warm.groupBy("node", F.shiftright("code", PLACE)).agg(F.min("code").alias("code"))
            moved.append(warm.select("node", F.array("code").alias("sets")))
        rows = _union([*(m.withColumn("old", F.lit(False)) for m in moved), *(x.withColumn("old", F.lit(True)) for x in seen)])
        rows = rows.repartition("node").select("node", "old", F.explode("sets").alias("code"))
        met = rows.groupBy("node", F.shiftright("code", PLACE).alias("g")).agg(F.min("code").alias("code"), F.max("old").alias("old"))
        frontier = written(_in_sets(met.where("not old").select("node", "code")))
        if frontier.isEmpty():
            break
        layers.append(frontier.withColumn("depth", F.lit(depth)))
        seen.append(frontier)
        if len(seen) > 6:
            seen = [written(_union(seen))]
    return Nearest(names, origins, _union(layers))


def nearest(seeds: DataFrame, edges: DataFrame, direction: str = "out", max_depth: int | None = None) -> DataFrame:
    """(seed, node, depth, origin): the nodes that a seed's starts, seeds(seed, node), reach within max_depth hops, by fewest
    hops, and the start from which they are reached so, of several the smallest; the starts, depth 0, are part of it.

    One search for a seed, however many starts it has: what is nearest to a node comes through its neighbours one hop
    nearer, so a round hands the smallest origin on. Every round is a written table of its new rows.
    """
    found = nearest_sets(seeds, edges, direction, max_depth)
    return found.codes(found.rows).join(found.names, "g").join(found.origins, "n").select("seed", "node", "depth", "origin")


def towards(edges: DataFrame, direction: str) -> DataFrame:
    """Distinct (src, dst), turned round for `in`; written, dealt by src."""
    adj = adjacency(edges)
    return bucketed(adj if direction == "out" else adj.select(F.col("dst").alias("src"), F.col("src").alias("dst")), "src")


def subgraph(seeds: DataFrame, edges: DataFrame, depth: int = 3) -> DataFrame:
    """(seed, node): the start and what it reaches forward."""
    at = packed(seeds)
    # a search holds each node of a seed once, the start too
    return at.unpacked(spread(at.start, towards(edges, "out"), depth)).select("seed", "node")


def path_lengths(pairs: DataFrame, edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(src, dst, length) for pairs(src, dst): the hops of a shortest directed path, null without one of at most max_depth
    hops (of any length, by default).

    The search starts from the side with fewer different ends, 64 of them in a row, so that its rows do not grow with
    the pairs; shortest_paths, which also tells the paths, searches for each pair.
    """
    start = written(pairs.select("src", "dst").distinct())
    ends = start.agg(F.approx_count_distinct("src").alias("src"), F.approx_count_distinct("dst").alias("dst")).first()
    a, b, way = ("dst", "src", "in") if ends["dst"] <= ends["src"] else ("src", "dst", "out")
    at = packed(start.select(F.col(a).alias("seed"), F.col(a).alias("node")).distinct())
    found = spread(at.start, towards(edges, way), max_depth)
    found = found.join(start.select(F.col(b).alias("node")).distinct(), "node", "left_semi")
    rows = at.unpacked(found).select(F.col("seed").alias(a), F.col("node").alias(b), F.col("depth").alias("length"))
    return start.join(rows, ["src", "dst"], "left").select("src", "dst", "length")


def shortest_paths(pairs: DataFrame, edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(src, dst, length, path) for pairs(src, dst): a fewest-hop directed path, null without one of at most max_depth hops
    (of any length, by default).

    Of several such paths, every node but the first has the smallest predecessor. Finished pairs leave the search.
    """
    adj = written(adjacency(edges))
    start = pairs.select("src", "dst").distinct()
    frontier = written(start.select("src", "dst", F.col("src").alias("at"), F.array("src").alias("path"), F.lit(0).alias("length")))
    done, seen, depth = [frontier.where("at = dst")], [frontier.select("src", "dst", "at")], 0
    frontier = frontier.where("at <> dst")
    while max_depth is None or depth < max_depth:
        depth += 1
        step = frontier.join(adj.select(F.col("src").alias("at"), F.col("dst").alias("to")), "at")
        best = step.groupBy("src", "dst", "to").agg(F.min_by("path", "at").alias("path"))
        new = best.select("src", "dst", F.col("to").alias("at"), F.concat("path", F.array("to")).alias("path"), F.lit(depth).alias("length"))
        new = written(new.join(_union(seen), ["src", "dst", "at"], "left_anti"))
        if new.isEmpty():
            break
        hit = new.where("at = dst")
        done.append(hit)
        seen.append(new.select("src", "dst", "at"))
        frontier = new.where("at <> dst").join(hit.select("src", "dst"), ["src", "dst"], "left_anti")
    return start.join(_union(done).select("src", "dst", "length", "path"), ["src", "dst"], "left")


def topological_levels(nodes: DataFrame, edges: DataFrame, direction: str = "dependencies_first") -> DataFrame:
    """(grp, id, level, position) of nodes(grp, id) by the edges(src, dst) among each group's nodes.

    A level holds the nodes whose dependencies (or importers, for importers_first) all lie in lower levels; nodes on or
    behind cycles come last with a null level. position numbers a group's nodes by level and id.
    """
    at = packed(nodes.select(F.col("grp").alias("seed"), F.col("id").alias("node")))
    levels = peeled(at.start, needs_of(edges, direction))
    return numbered(at.unpacked(levels).select(F.col("seed").alias("grp"), F.col("node").alias("id"), "level"), "grp", [F.asc_nulls_last("level"), F.asc("id")])


def needs_of(edges: DataFrame, direction: str) -> DataFrame:
    """(node, need): what must come before a node; written, dealt by need."""
    a, b = ("src", "dst") if direction == "dependencies_first" else ("dst", "src")
    return bucketed(adjacency(edges).select(F.col(a).alias("node"), F.col(b).alias("need")), "need")


def _trimmed(edges: DataFrame) -> DataFrame:
    """Edges left when nodes without an incoming or without an outgoing edge are taken away, again and again."""
    n = edges.count()
    while n:
        ins, outs = edges.select(F.col("dst").alias("src")).distinct(), edges.select(F.col("src").alias("dst")).distinct()
        edges = written(edges.join(ins, "src", "left_semi").join(outs, "dst", "left_semi").select("src", "dst"))
        now = edges.count()
        if now == n:
            break
        n = now
    return edges


def cycles(edges: DataFrame) -> DataFrame:
    """(id, cycle) for every node on a cycle: cycle is the smallest id of its strongly connected group."""
    adj = written(adjacency(edges))
    found = [adj.where("src = dst").select(F.col("src").alias("id"), F.col("src").alias("cycle"))]
    left = _trimmed(written(adj.where("src <> dst")))
    while not left.isEmpty():
        color = written(left.select(F.col("src").alias("id")).unionByName(left.select(F.col("dst").alias("id"))).distinct().withColumn("color", F.col("id")))
        while True:  # every node takes the smallest id that reaches it
            push = left.join(color, left["src"] == color["id"]).groupBy("dst").agg(F.min("color").alias("new"))
            new = written(color.join(push, color["id"] == push["dst"], "left").select("id", F.least("color", "new").alias("color"), (F.col("new") < F.col("color")).alias("moved")))
            color = new.select("id", "color")
            if new.where("moved").isEmpty():
                break
        a, b = color.select(F.col("id").alias("src"), F.col("color").alias("ca")), color.select(F.col("id").alias("dst"), F.col("color").alias("cb"))
        inside = written(left.join(a, "src").join(b, "dst").where("ca = cb").select("src", "dst", "ca"))
        roots = color.where("id = color").select(F.col("color").alias("seed"), F.col("id").alias("node"))
        back = reach(roots, inside, "in").select("seed", "node")
        own = color.select(F.col("color").alias("seed"), F.col("id").alias("node"))
        group = written(back.join(own, ["seed", "node"], "left_semi").unionByName(roots).select(F.col("node").alias("id"), F.col("seed").alias("cycle")))
        big = group.join(group.groupBy("cycle").count().where("count > 1").select("cycle"), "cycle", "left_semi").select("id", "cycle")
        found.append(big)
        gone = group.select("id")
        rest = left.join(gone.select(F.col("id").alias("src")), "src", "left_anti").join(gone.select(F.col("id").alias("dst")), "dst", "left_anti")
        left = _trimmed(written(rest.select("src", "dst")))
    return _union(found).groupBy("id").agg(F.min("cycle").alias("cycle"))


def cycle_paths(edges: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """(cycle, length, path): a shortest cycle through the smallest node of each cyclic group, starting with that node.

    Of several the one with the smaller ids. members is what cycles(edges) gives, if it is at hand; a self-loop is a path
    of one node. The search ends when every group has its path, however long.
    """
    members = written(cycles(edges) if members is None else members)
    adj = adjacency(edges)
    a, b = members.select(F.col("id").alias("src"), "cycle"), members.select(F.col("id").alias("dst"), F.col("cycle").alias("other"))
    inside = written(adj.join(a, "src").join(b, "dst").where("cycle = other").select("cycle", "src", "dst"))
    live = written(members.select("cycle").distinct().select("cycle", F.col("cycle").alias("at"), F.array("cycle").alias("path")))
    seen, done = [live.select("cycle", "at")], []
    while not live.isEmpty():
        step = live.join(inside, (live["cycle"] == inside["cycle"]) & (live["at"] == inside["src"])).select(live["cycle"], "dst", "path")
        back = written(step.where("dst = cycle").groupBy("cycle").agg(F.min("path").alias("path")))
        done.append(back.select("cycle", F.size("path").alias("length"), "path"))
        on = step.where("dst <> cycle").join(back.select("cycle"), "cycle", "left_anti").groupBy("cycle", F.col("dst").alias("at")).agg(F.min("path").alias("path"))
        on = on.join(_union(seen), ["cycle", "at"], "left_anti")
        live = written(on.select("cycle", "at", F.concat("path", F.array("at")).alias("path")))
        seen.append(live.select("cycle", "at"))
    return _union(done) if done else live.select("cycle", F.size("path").alias("length"), "path")


def critical_paths(seeds: DataFrame, nodes: DataFrame, edges: DataFrame, most: int = 5) -> DataFrame:
    """(seed, path): the shortest backward path of at most `most` nodes to an api or frontend node, then by its ids."""
    adj = written(adjacency(edges))
    ends = nodes.where("layer in ('api', 'frontend')").select(F.col("id").alias("at"))
    live = seeds.select("seed", F.col("seed").alias("at"), F.array("seed").alias("path")).distinct()
    hits = []
    for _ in range(most - 1):
        up = live.join(adj, live["at"] == adj["dst"]).where(~F.array_contains("path", F.col("src")))
        # of several ways to one node the smallest is enough
        up = up.groupBy("seed", F.col("src").alias("to")).agg(F.min(F.concat("path", F.array("src"))).alias("path"))
        live = written(up.select("seed", F.col("to").alias("at"), "path"))
        hits.append(live.join(ends, "at", "left_semi").select("seed", "path"))
        live = live.join(hits[-1].select("seed"), "seed", "left_anti")
    found = _union(hits)
    return found.groupBy("seed").agg(F.min(F.struct(F.size("path").alias("n"), "path")).alias("p")).select("seed", F.col("p.path").alias("path"))
