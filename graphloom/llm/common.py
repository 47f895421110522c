"""Helpers that the text operators share: tables in the shared folder, connected components, Python batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one is set where a local session names none (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="graphloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, its lineage cut, and safe from lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/graphloom/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame) -> DataFrame:
    """df, never broadcast by a join: both sides move by its key. For tables that grow with the input: Spark sizes rows that
    an explode makes like those it reads, and a file by its packed bytes, so it may send far more than its limit."""
    return df.hint("merge")


def set_aside(docs: DataFrame, *used: str) -> DataFrame:
    """docs with all columns but the used ones under numbered names, so that none clashes with a column an operator adds."""
    return docs.toDF(*(c if c in used else f"kept_{i}" for i, c in enumerate(docs.columns)))


def in_batches(df: DataFrame, fn: Callable[[Iterator], Iterator], schema: str) -> DataFrame:
    """mapInPandas under a short name."""
    return df.mapInPandas(fn, schema)


_ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64())}


def in_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], schema: str) -> DataFrame:
    """mapInArrow of a function that makes columns by name. Arrow columns pass as they are: pandas would turn whole numbers
    beside nulls into doubles, and ids above 2**53 would change."""
    kinds = {name: _ARROW[kind] for name, kind in (field.split() for field in schema.split(", "))}

    def run(batches):
        for columns in fn(batches):
            arrays = [c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in ((columns[n], k) for n, k in kinds.items())]
            yield pa.RecordBatch.from_arrays(arrays, names=list(kinds))

    return df.mapInArrow(run, schema)


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; a null id counts as fold 0."""
    return F.coalesce(F.pmod(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")), F.lit(folds)), F.lit(0))


def _print(edges: DataFrame) -> tuple:
    """Row count and an order-free digest of an edge table."""
    h = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count("*"), F.sum(F.shiftright(h, 20)), F.bit_xor(h)).first())


def components(edges: DataFrame) -> DataFrame:
    """Connected components of (u, v) as (id, component): the smallest id reachable, for every id that has an edge.

    Alternates large-star and small-star steps until no edge changes; every round is written to the shared
    folder, and minima are combined before each shuffle, so a hub costs no more than its edges.
    Nulls and self-loops are ignored. An empty table gives an empty table.
    """
    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = written(e)
    state = _print(e)
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(dealt(low), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        near = large.join(dealt(low), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = written(near.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        now = _print(e)
        if now == state:
            break
        state = now
    return e.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("id"), "component").unionByName(
        e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )
