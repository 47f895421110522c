"""Ordered folds of few keys: a key's rows are cut into ranges of time, each range is folded alone, and what it passes on
is a row that is composed over the ranges. No task sees more than a range, however many rows a key has."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from graphloom.tables import written

PART = "__part"


def cut(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """rows with the number of their range, ascending in `order` for each key; written. Ranges follow the partitions of a
    sort by (key, order), so a large key has many of them and each is about a partition."""
    return written(rows.repartitionByRange(key, *order).sortWithinPartitions(key, *order).withColumn(PART, F.spark_partition_id()))


def inside(order: tuple[str, ...], *key: str) -> WindowSpec:
    """A range's rows of a key up to the current one."""
    return Window.partitionBy(*key, PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


@dataclass(frozen=True)
class Fold:
    """local(rows, key, order): rows with the fold of their own range. summary(order): aggregates of a range.
    compose(sums, w): the summaries, a row for each range, with the columns `enters` that all earlier ranges of the key, w,
    pass on. finish(rows): rows with those columns taken in. drop: columns that go."""

    local: Callable[[DataFrame, tuple[str, ...], tuple[str, ...]], DataFrame]
    summary: Callable[[tuple[str, ...]], dict[str, Column]]
    compose: Callable[[DataFrame, WindowSpec], DataFrame]
    finish: Callable[[DataFrame], DataFrame]
    enters: tuple[str, ...]
    drop: tuple[str, ...] = ()


def folded(rows: DataFrame, key: tuple[str, ...], order: tuple[str, ...], *folds: Fold) -> DataFrame:
    """rows of cut() with all folds. The ranges' own folds are written once; summaries and rows are read from that table."""
    for f in folds:
        rows = f.local(rows, key, order)
    rows = written(rows)
    w = Window.partitionBy(*key).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*key, PART).agg(*(c.alias(n) for f in folds for n, c in f.summary(order).items()))
    for f in folds:
        sums = f.compose(sums, w)
    sums = sums.select(*(F.col(k).alias(f"__{k}") for k in key), F.col(PART).alias("__range"), *(n for f in folds for n in f.enters))
    same = F.col(PART) == F.col("__range")
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    out = rows.join(sums, same).drop("__range", *(f"__{k}" for k in key))
    for f in folds:
        out = f.finish(out).drop(*f.enters, *f.drop)
    return out


def sums(**values: Column) -> Fold:
    """Running sums, a column for each value; nulls count nothing."""
    so_far = lambda n, w, c: F.coalesce(F.sum(c).over(w), F.lit(0)).alias(n)
    return Fold(
        local=lambda rows, key, order: rows.select("*", *(so_far(n, inside(order, *key), v) for n, v in values.items())),
        summary=lambda order: {f"__sum_{n}": F.sum(v) for n, v in values.items()},
        compose=lambda s, w: s.select("*", *(so_far(f"__before_{n}", w, F.col(f"__sum_{n}")) for n in values)),
        finish=lambda rows: rows.withColumns({n: F.col(n) + F.col(f"__before_{n}") for n in values}),
        enters=tuple(f"__before_{n}" for n in values),
    )


def runs(hit: str, name: str) -> Fold:
    """How many rows came since the last with `hit`; 0 on such a row."""

    def local(rows: DataFrame, key: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
        rows = rows.withColumn("__hits", F.sum(F.col(hit).cast("long")).over(inside(order, *key)))
        return rows.withColumn("__run", F.sum((~F.col(hit)).cast("long")).over(inside(order, *key, "__hits")))

    def compose(s: DataFrame, w: WindowSpec) -> DataFrame:
        # tails of the earlier ranges, from the last one with a hit on
        s = s.withColumn("__tails", F.coalesce(F.sum("__end.__run").over(w), F.lit(0)))
        own = F.last(F.when(F.col("__end.__hits") > 0, F.col("__tails")), ignorenulls=True).over(w)
        return s.withColumn("__run_before", F.col("__tails") - F.coalesce(own, F.lit(0)))

    return Fold(
        local=local,
        summary=lambda order: {"__end": F.max(F.struct(*order, "__hits", "__run"))},
        compose=compose,
        finish=lambda rows: rows.withColumn(name, F.col("__run") + F.when(F.col("__hits") == 0, F.col("__run_before")).otherwise(0)),
        enters=("__run_before",),
        drop=("__hits", "__run"),
    )


def latest(value: Column, name: str) -> Fold:
    """The last value up to the row that is not null."""
    return Fold(
        local=lambda rows, key, order: rows.withColumn("__value", value).withColumn(name, F.last("__value", ignorenulls=True).over(inside(order, *key))),
        summary=lambda order: {"__set": F.max(F.when(F.col("__value").isNotNull(), F.struct(*order, "__value")))},
        compose=lambda s, w: s.withColumn("__set_before", F.last("__set.__value", ignorenulls=True).over(w)),
        finish=lambda rows: rows.withColumn(name, F.coalesce(name, "__set_before")),
        enters=("__set_before",),
        drop=("__value",),
    )


def previous(value: str, name: str) -> Fold:
    """The value of the row before."""

    def local(rows: DataFrame, key: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
        at = Window.partitionBy(*key, PART).orderBy(*order)
        return rows.withColumn(name, F.lag(value).over(at)).withColumn("__first", F.row_number().over(at) == 1)

    return Fold(
        local=local,
        summary=lambda order: {"__tail": F.max(F.struct(*order, F.col(value).alias("__last")))},
        compose=lambda s, w: s.withColumn("__last_before", F.last("__tail.__last").over(w)),
        finish=lambda rows: rows.withColumn(name, F.when(F.col("__first"), F.col("__last_before")).otherwise(F.col(name))),
        enters=("__last_before",),
        drop=("__first",),
    )
