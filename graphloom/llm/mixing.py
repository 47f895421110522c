"""Mixing sources to target weights by hierarchical budgeting, with DataFrame functions only.

Documents are leaves' tokens in a tree domain - language - source. Budgets run down the tree in proportion to weights.
A node that can't use its share, even with every epoch, leaves the rest to its siblings in proportion to theirs, and
only what all of them can't use goes to the parent's siblings; since a node's capacity is the sum of its leaves', one
capped division per level does both. Each leaf then takes whole epochs, and of its last epoch the documents with the
smallest seeded keys, as long as their tokens fit.

Texts are not shuffled: the last epoch of a leaf is described by one key, found from token sums of key ranges and,
within the one range where the budget ends, from its rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import WORD, set_aside, written


@dataclass(frozen=True)
class Mix:
    """share: of all tokens there are, the budget. weights: of nodes by name, 1 where none is given; they are relative
    among siblings. domain_rules: (pattern on source, domain), first match counts, else other_domain."""

    share: float = 0.6
    max_epochs: int = 2
    seed: int = 7
    domain_weights: dict = field(default_factory=dict)
    lang_weights: dict = field(default_factory=dict)
    source_weights: dict = field(default_factory=dict)
    domain_rules: tuple = ()
    other_domain: str = "general"
    range_rows: int = 50_000


PRODUCTION = Mix(
    domain_weights={"web": 2.0, "books": 3.0, "reference": 1.0},
    lang_weights={"en": 4.0, "de": 2.0, "fr": 2.0, "es": 1.0},
    source_weights={"src0": 0.5},
    domain_rules=(("^src[0-4]$", "web"), ("^src[5-9]$", "books"), ("^src1[0-9]$", "reference")),
)
LEVELS = ("domain", "lang", "source")
#: Parts in which the rows of each leaf are dealt where they meet it.
SHARES = 64


def _weight(name: Column, weights: dict) -> Column:
    out = F.lit(1.0)
    for k in sorted(weights):
        out = F.when(name == k, float(weights[k])).otherwise(out)
    return out


def leaf_columns(mix: Mix) -> dict[str, Column]:
    source, lang = F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit(""))
    domain = F.lit(mix.other_domain)
    for pattern, name in reversed(mix.domain_rules):
        domain = F.when(source.rlike(pattern), name).otherwise(domain)
    return {"domain": domain, "lang": lang, "source": source}


def key_of(epoch: Column | int, mix: Mix) -> Column:
    """The order of documents in an epoch of their leaf: md5 of seed, epoch and id, as 32 hex digits."""
    epoch = F.lit(epoch) if isinstance(epoch, int) else epoch
    return F.md5(F.concat_ws(":", F.lit(str(mix.seed)), epoch.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def tokens_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def divided(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """nodes(parent..., name, capacity, weight, total): adds budget, the parents' total divided by weight under capacities.

    Sorted by capacity over weight, a node is full if the level at which it fills lies under what the earlier full ones
    leave for each unit of the weight that remains; all others share that level.
    """
    order = Window.partitionBy(*parent).orderBy((F.col("capacity") / F.col("weight")), name)
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy(*parent)
    n = nodes.withColumn("__level", (F.col("total") - F.coalesce(F.sum("capacity").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    n = n.withColumn("__full", F.col("capacity") <= F.col("weight") * F.col("__level"))
    # once a node is not full, no later one is
    n = n.withColumn("__open", F.min(F.when(~F.col("__full"), F.struct(F.col("capacity") / F.col("weight"), name, "__level"))).over(whole)["__level"])
    return n.withColumn("budget", F.when(F.col("__full"), F.col("capacity")).otherwise(F.col("weight") * F.col("__open"))).drop("__level", "__full", "__open")


def budgets(slim: DataFrame, mix: Mix) -> DataFrame:
    """(domain, lang, source, tokens, rows, budget) of every leaf of slim(domain, lang, source, tokens)."""
    leaves = slim.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("rows"))
    leaves = written(leaves.withColumn("capacity", (F.col("tokens") * mix.max_epochs).cast("double")))
    weights = {"domain": mix.domain_weights, "lang": mix.lang_weights, "source": mix.source_weights}
    whole = leaves.agg(F.sum("tokens")).first()[0]
    above = None
    for depth, name in enumerate(LEVELS):
        parent = list(LEVELS[:depth])
        nodes = leaves.groupBy(*parent, name).agg(F.sum("capacity").alias("capacity")).withColumn("weight", _weight(F.col(name), weights[name]))
        if parent:
            nodes = nodes.join(above, parent)
        else:
            nodes = nodes.withColumn("total", F.lit((whole or 0) * mix.share))
        above = divided(nodes, parent or [F.lit(1)], name).select(*parent, name, F.col("budget").alias("total"))
    return leaves.join(above, list(LEVELS)).select(*LEVELS, "tokens", "rows", F.col("total").alias("budget"))


def _beside(rows: DataFrame, leaves: DataFrame, keys: Sequence[str]) -> DataFrame:
    """rows joined with their leaf, each leaf SHARES times, so that no leaf's rows meet in one task."""
    dealt = rows.withColumn("__share", F.pmod(F.xxhash64("doc_id"), F.lit(SHARES)).cast("int"))
    many = leaves.withColumn("__share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
    return dealt.join(many, [*keys, "__share"]).drop("__share")


def cuts(slim: DataFrame, mix: Mix) -> DataFrame:
    """For each leaf: whole epochs, and last_key, the greatest key of the epoch after them that is still taken (or null).

    slim: doc_id, domain, lang, source, tokens; a written table. Documents are taken in order of their keys as long as
    the sum of tokens fits; documents with equal ids have equal keys and are taken together.
    """
    b = budgets(slim, mix)
    b = b.withColumn("epochs", F.when(F.col("tokens") > 0, F.least(F.floor((F.col("budget") + 1e-6) / F.col("tokens")), F.lit(mix.max_epochs))).otherwise(0).cast("int"))
    b = b.withColumn("rest", F.floor(F.col("budget") + 1e-6) - F.col("epochs") * F.col("tokens"))
    # hex digits that deal the leaf's rows over ranges of about range_rows
    b = written(b.withColumn("digits", F.greatest(F.lit(0), F.ceil(F.log2(F.col("rows") / mix.range_rows) / 4)).cast("int")))
    rows = _beside(slim, b.where("rest > 0 and tokens > 0").select(*LEVELS, "epochs", "rest", "digits"), LEVELS)
    rows = rows.withColumn("key", key_of(F.col("epochs") + 1, mix)).withColumn("range", F.expr("substring(key, 1, digits)"))
    rows = rows.select(*LEVELS, "rest", "range", "key", "tokens")
    ranges = rows.groupBy(*LEVELS, "rest", "range").agg(F.sum("tokens").alias("n"), F.max("key").alias("top"))
    until = Window.partitionBy(*LEVELS).orderBy("range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranges = written(ranges.withColumn("sum", F.sum("n").over(until)))
    whole = ranges.where("sum <= rest").groupBy(*LEVELS).agg(F.max("top").alias("top"))
    # the first range that does not fit whole
    split = ranges.where("sum > rest").groupBy(*LEVELS).agg(F.min(F.struct("range", (F.col("rest") - F.col("sum") + F.col("n")).alias("left"))).alias("r"))
    split = split.select(*LEVELS, F.col("r.range").alias("range"), F.col("r.left").alias("left"))
    inside = rows.join(split, [*LEVELS, "range"]).groupBy(*LEVELS, "left", "key").agg(F.sum("tokens").alias("n"))
    at = Window.partitionBy(*LEVELS).orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = inside.withColumn("sum", F.sum("n").over(at)).where("sum <= left").groupBy(*LEVELS).agg(F.max("key").alias("inner"))
    ends = whole.join(inside, list(LEVELS), "full_outer").select(*LEVELS, F.greatest("top", "inner").alias("last_key"))
    return b.join(ends, list(LEVELS), "left").select(*LEVELS, "epochs", "last_key", "budget")


def slim_of(docs: DataFrame, mix: Mix) -> DataFrame:
    return docs.select("doc_id", *(c.alias(n) for n, c in leaf_columns(mix).items()), tokens_of(F.col("text")).alias("tokens"))


def _copies() -> Column:
    return F.col("__epochs") + F.when(F.col("__key") <= F.col("__last"), 1).otherwise(0)


def _with_cuts(df: DataFrame, leaves: DataFrame, mix: Mix) -> DataFrame:
    """df with the columns of its leaf's cut; df needs doc_id, and __domain, __lang, __source."""
    cut = leaves.select(*(F.col(n).alias(f"__{n}") for n in LEVELS), F.col("epochs").alias("__epochs"), F.col("last_key").alias("__last"))
    out = _beside(df, cut, [f"__{n}" for n in LEVELS])
    return out.withColumn("__key", key_of(F.col("__epochs") + 1, mix))


def selected(docs: DataFrame, mix: Mix = PRODUCTION) -> DataFrame:
    """doc_id, domain, lang, source, tokens, epoch: a row for each time a document is taken; epochs count from 1.

    tokens are words. A null text has none; documents without tokens are taken whenever their key is. Null languages
    and sources are the empty string. An empty table, or a leaf without tokens, gives no rows. Repeated rows are taken
    alike.
    """
    slim = written(slim_of(docs, mix))
    leaves = cuts(slim, mix)
    taken = _with_cuts(slim.select("doc_id", "tokens", *(F.col(n).alias(f"__{n}") for n in LEVELS)), leaves, mix)
    taken = taken.withColumn("copies", _copies()).where("copies > 0")
    return taken.select("doc_id", *(F.col(f"__{n}").alias(n) for n in LEVELS), "tokens", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("epoch"))


def mixed(docs: DataFrame, mix: Mix = PRODUCTION) -> DataFrame:
    """The rows of docs, all columns, as often as they are taken. Texts stay where they are: only leaves are joined.

    Null, empty and very long texts, null ids, languages and sources, repeated rows and an empty table are as in selected().
    Other columns may have any names.
    """
    names, docs = docs.columns, set_aside(docs, "doc_id", "text", "lang", "source")
    leaves = cuts(written(slim_of(docs, mix)), mix)
    marked = docs.withColumns({f"__{n}": c for n, c in leaf_columns(mix).items()})
    taken = _with_cuts(marked, leaves, mix).withColumn("__copies", _copies()).where("__copies > 0")
    return taken.withColumn("__epoch", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*docs.columns).toDF(*names)


def oracle(mix: Mix = PRODUCTION, source: str = "documents") -> str:
    """The same rows in DuckDB SQL."""
    case = lambda col, w: "CASE " + " ".join(f"WHEN {col} = '{k}' THEN {float(v)}" for k, v in sorted(w.items())) + " ELSE 1.0 END" if w else "1.0"
    domain = "CASE " + " ".join(f"WHEN regexp_matches(coalesce(source, ''), '{p}') THEN '{d}'" for p, d in mix.domain_rules) + f" ELSE '{mix.other_domain}' END" if mix.domain_rules else f"'{mix.other_domain}'"
    weights = (mix.domain_weights, mix.lang_weights, mix.source_weights)
    out = f"""WITH slim AS (
  SELECT doc_id, {domain} AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS tokens FROM {source}
), leaves AS (SELECT domain, lang, source, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(tokens) * {mix.max_epochs} AS DOUBLE) AS capacity FROM slim GROUP BY ALL
), l0 AS (SELECT sum(tokens) * CAST({mix.share} AS DOUBLE) AS total FROM leaves)"""
    for depth, name in enumerate(LEVELS):
        parent = list(LEVELS[:depth])
        keys = ", ".join([*parent, name])
        part = f"PARTITION BY {', '.join(parent)}" if parent else ""
        join = f"JOIN l{depth} USING ({', '.join(parent)})" if parent else "CROSS JOIN l0"
        out += f""", n{depth} AS (
  SELECT {keys}, capacity, {case(name, weights[depth])} AS weight, total FROM (SELECT {keys}, sum(capacity) AS capacity FROM leaves GROUP BY ALL) x {join}
), f{depth} AS (
  SELECT *, (total - coalesce(sum(capacity) OVER ({part} ORDER BY capacity / weight, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER ({part} ORDER BY capacity / weight, {name} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM n{depth}
), l{depth + 1} AS (
  SELECT {keys}, CASE WHEN capacity <= weight * lev THEN capacity
         ELSE weight * min_by(lev, row(capacity / weight, {name})) FILTER (NOT (capacity <= weight * lev)) OVER ({part}) END AS total FROM f{depth}
)"""
    return (
        out
        + f""", b AS (
  SELECT domain, lang, source, tokens AS size, total, CASE WHEN tokens > 0 THEN least(floor((total + 1e-6) / tokens), {mix.max_epochs}) ELSE 0 END AS epochs FROM leaves JOIN l3 USING (domain, lang, source)
), k AS (
  SELECT slim.*, size, CAST(epochs AS INTEGER) AS epochs, floor(total + 1e-6) - epochs * size AS rest,
         md5('{mix.seed}:' || CAST(CAST(epochs AS INTEGER) + 1 AS VARCHAR) || ':' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM slim JOIN b USING (domain, lang, source)
), s AS (
  SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY key RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM k
), c AS (
  SELECT *, epochs + CASE WHEN size > 0 AND rest > 0 AND upto <= rest THEN 1 ELSE 0 END AS copies FROM s
)
SELECT doc_id, domain, lang, source, tokens, CAST(unnest(range(1, copies + 1)) AS INTEGER) AS epoch FROM c WHERE copies > 0"""
    )
