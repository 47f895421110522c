"""Many searches at once: 64 seeds are the bits of a long, and a search step moves longs along edges.

A row (node, block, most, bits) says which seeds of a block have a node. Each round joins the frontier with the edges
once for 64 seeds, ORs what meets at a node before and after the shuffle, and takes away what was there before. Seeds
with the same depth limit `most` share a row. Nothing is numbered globally: a block is a run of seeds of one partition.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.tables import written

#: Seed names up to so many bytes in all go with the tasks; longer lists are joined.
NAMES_BYTES = 16 << 20
KEY = ("node", "block", "most")
#: Where a frontier has so many rows a node, a node's rows go along its edges together, up to 1 << RUN blocks in a row; but
#: not to nodes with more than HOT edges, where what meets is combined before it is moved.
WIDE, RUN, HOT = 4, 12, 10_000


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def shifted(n: str) -> Column:
    return F.expr(f"shiftleft(1L, CAST({n} AS INT))")


def places(bits: str) -> Column:
    """The numbers of the bits that are set, in order."""
    return F.expr(f"filter(sequence(0, 63), i -> getbit({bits}, i) = 1)")


@dataclass(frozen=True)
class Seeds:
    """names(block, seeds): the seeds of a block by place. start(node, block, most, bits). wide: too many names to broadcast."""

    names: DataFrame
    start: DataFrame
    wide: bool

    def named(self, rows: DataFrame) -> DataFrame:
        """rows(block, ...) with the seeds of their block beside them."""
        return rows.join(self.names if self.wide else F.broadcast(self.names), "block")

    def unpacked(self, rows: DataFrame, bits: str = "bits") -> DataFrame:
        """A row for each seed of rows(block, bits, ...): seed and the other columns."""
        keep = [c for c in rows.columns if c not in ("block", "most", bits)]
        one = self.named(rows).select(*keep, "seeds", F.explode(places(bits)).alias("place"))
        return one.select(F.element_at("seeds", F.col("place") + 1).alias("seed"), *keep)


def packed(seeds: DataFrame, limit: DataFrame | None = None) -> Seeds:
    """Packs seeds(seed, node); limit(seed, max_depth) bounds a seed's depth, and a seed without a limit is not searched."""
    own = seeds.select("seed").distinct()
    own = own.withColumn("most", F.lit(None).cast("int")) if limit is None else own.join(limit.select("seed", F.col("max_depth").alias("most")), "seed")
    order = ("most", "seed")
    n = written(own.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("n", F.monotonically_increasing_id()))
    n = n.select("seed", "most", F.shiftright("n", 6).alias("block"), F.col("n").bitwiseAND(63).alias("place"))
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("place", "seed"))), lambda x: x["seed"])
    names = written(n.groupBy("block").agg(in_order.alias("seeds")))
    size = names.agg(F.sum(F.aggregate("seeds", F.lit(0).cast("long"), lambda s, x: s + F.length(x.cast("string")) + 16))).first()[0] or 0
    start = seeds.select("seed", "node").join(n, "seed").groupBy(*KEY).agg(F.bit_or(shifted("place")).alias("bits"))
    return Seeds(names, written(start), size > NAMES_BYTES)


def _along(live: DataFrame, adj: DataFrame) -> DataFrame:
    """(node, block, most, c, s): the rows of live one edge further."""
    return live.join(adj, live["node"] == adj["src"]).select(F.col("dst").alias("node"), "block", "most", F.col("bits").alias("c"), F.lit(0).cast("long").alias("s"))


def _size(rows: DataFrame):
    """How many rows, and of about how many nodes."""
    return rows.agg(F.count("*"), F.approx_count_distinct("node")).first()


def crowded(adj: DataFrame) -> DataFrame | None:
    """(dst): nodes with more than HOT edges; there is at most one for each HOT edges, so they go with the tasks."""
    hot = written(adj.groupBy("dst").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("dst"))
    return None if hot.isEmpty() else F.broadcast(hot)


def _together(live: DataFrame, adj: DataFrame, seen: DataFrame, hot: DataFrame | None) -> DataFrame:
    """_along(live, adj) and the rows of seen, in any number of rows, where their nodes lie: a node's rows move together."""
    cool, parts = adj, []
    if hot is not None:
        cool = adj.join(hot, "dst", "left_anti")
        warm = _along(live, adj.join(hot, "dst", "left_semi")).groupBy(*KEY).agg(F.bit_or("c").alias("c"))
        parts = [warm.select("node", F.lit(False).alias("old"), F.array(F.struct("block", "most", F.col("c").alias("bits"))).alias("sets"))]
    runs = live.repartition("node").groupBy("node", F.shiftright("block", RUN)).agg(F.collect_list(F.struct("block", "most", "bits")).alias("sets"))
    parts.append(runs.join(cool, runs["node"] == cool["src"]).select(cool["dst"].alias("node"), F.lit(False).alias("old"), "sets"))
    parts.append(seen.select("node", F.lit(True).alias("old"), F.array(F.struct("block", "most", F.col("s").alias("bits"))).alias("sets")))
    # rows that lie by their node need no further move to meet by node, block and limit
    rows = union(parts).repartition("node").select("node", "old", F.inline("sets"))
    zero = F.lit(0).cast("long")
    return rows.select(*KEY, F.when(F.col("old"), zero).otherwise(F.col("bits")).alias("c"), F.when(F.col("old"), F.col("bits")).otherwise(zero).alias("s"))


def spread(start: DataFrame, adj: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(node, block, most, bits, depth): seeds by the fewest hops over adj(src, dst) in which they come to a node.

    The start, depth 0, is part of it. A block's seeds go as far as its `most`, or as max_depth where that is null. Every
    round is a written table of its new rows. Once some have gathered, rounds are merged, so each reads few tables.
    """
    frontier, depth, hot = start.select(*KEY, "bits"), 0, []
    layers, known, recent = [start.select(*KEY, "bits").withColumn("depth", F.lit(0))], None, [frontier]
    n, nodes = _size(frontier)
    while max_depth is None or depth < max_depth:
        depth += 1
        live = frontier.where(F.col("most").isNull() | (F.col("most") >= depth))
        seen = union(recent if known is None else [known, *recent]).select(*KEY, F.lit(0).cast("long").alias("c"), F.col("bits").alias("s"))
        if n >= WIDE * nodes > 0:
            hot = hot or [crowded(adj)]
            moved = _together(live, adj, seen, hot[0])
        else:
            moved = _along(live, adj).unionByName(seen)
        met = moved.groupBy(*KEY).agg(F.bit_or("c").alias("c"), F.bit_or("s").alias("s"))
        frontier = written(met.select(*KEY, F.col("c").bitwiseAND(F.bitwise_not("s")).alias("bits")).where("bits <> 0"))
        n, nodes = _size(frontier)
        if not n:
            break
        layers.append(frontier.withColumn("depth", F.lit(depth)))
        recent.append(frontier)
        if len(recent) > 6:
            known = written(union(recent if known is None else [known, *recent]).groupBy(*KEY).agg(F.bit_or("bits").alias("bits")))
            recent = []
    return union(layers)


def peeled(left: DataFrame, needs: DataFrame) -> DataFrame:
    """(node, block, bits, level) of left(node, block, bits), the members of many groups, by needs(node, need).

    In each group a level holds the members whose needs among the members lie in lower levels; those on or behind a cycle
    have a null level. A node that needs itself is on a cycle. As in spread(), a node's rows go along its edges together
    where it has many.
    """
    left, level, done, hot = left.select("node", "block", "bits"), 0, [], []
    adj = needs.select(F.col("need").alias("src"), F.col("node").alias("dst"))
    while True:
        live = left.select("node", "block", F.lit(None).cast("int").alias("most"), "bits")
        own = live.select(*KEY, F.lit(0).cast("long").alias("c"), F.col("bits").alias("s"))
        n, nodes = _size(left)
        # members that nothing needs have few rows and do not move, so half of WIDE is enough
        if 2 * n >= WIDE * nodes > 0:
            hot = hot or [crowded(adj)]
            moved = _together(live, adj, own, hot[0])
        else:
            moved = _along(live, adj).unionByName(own)
        met = moved.groupBy("node", "block").agg(F.bit_or("s").alias("own"), F.bit_or("c").alias("w")).where("own <> 0")
        step = written(met.select("node", "block", F.col("own").bitwiseAND(F.bitwise_not("w")).alias("free"), F.col("own").bitwiseAND(F.col("w")).alias("rest")))
        free = step.where("free <> 0").select("node", "block", F.col("free").alias("bits"))
        if free.isEmpty():
            break
        done.append(free.withColumn("level", F.lit(level)))
        left = step.where("rest <> 0").select("node", "block", F.col("rest").alias("bits"))
        level += 1
    return union([*done, left.withColumn("level", F.lit(None).cast("int"))])


def numbered(df: DataFrame, group: str, order: list[Column | str], name: str = "position") -> DataFrame:
    """df with the 1-based place of each row in its group by `order`, without any group in one task.

    Rows are dealt by ranges of (group, order), so a large group lies in several partitions. Each partition counts its rows
    of a group; the sums of those before it are added to the place inside the partition. Ties are numbered in any order.
    """
    at = written(df.repartitionByRange(F.col(group), *order).sortWithinPartitions(F.col(group), *order).withColumn("__part", F.spark_partition_id()).withColumn("__n", F.monotonically_increasing_id()))
    # a row for each partition that a group spans
    before = Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    runs = at.groupBy("__part", group).agg(F.min("__n").alias("__first"), F.count("*").alias("__size"))
    runs = runs.select(F.col("__part").alias("__p"), F.col(group).alias("__g"), "__first", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__sum"))
    out = at.join(runs, (at["__part"] == runs["__p"]) & at[group].eqNullSafe(runs["__g"]))
    return out.select(*df.columns, (F.col("__n") - F.col("__first") + 1 + F.col("__sum")).alias(name))
