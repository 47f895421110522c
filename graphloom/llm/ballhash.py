"""SimHash near-duplicates by meeting in the middle.

Two fingerprints at most 3 bits apart have a point that is at most 1 bit from one and 2 bits from the other. Of any
three differing bits two lie in the same 32-bit half, so it is enough that every fingerprint emits itself, its 64
one-bit variants and its 992 variants with two bits flipped within a half. All that meet at a point are linked to its
smallest one-bit member: every member is within 3 bits of that one, so no pair needs to be listed, and nothing is
lost. At most 1057 fingerprints can meet at a point, so groups stay bounded however many documents share a text.

Fingerprints with no possible partner are left out before that: a partner has one half equal or one bit apart, which
66 keys for each fingerprint tell. The one-bit points come first, which link all within two bits; the two-bit points are
then emitted only where those keys still lead to another group, so a large group of near copies costs few rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import components, dealt, in_arrow, set_aside, written

_SEED = 42


def simhash(text: bytes, shingle: int = 3) -> int:
    """64-bit SimHash over XXH64 (seed 42) of word shingles, repeats included; bits set in over half the hashes."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # of bytes: only A-Z, and only the six ASCII white-space characters
    n = len(words)
    if not n:
        return 0
    if n < shingle:
        return xxh64_intdigest(b" ".join(words), _SEED)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    spans = zip(starts[: n - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)
    hashes = np.array([xxh64_intdigest(joined[a:b], _SEED) for a, b in spans], dtype="<u8")
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        ones += np.unpackbits(hashes[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, hash, fp) of whole texts; hash is the text's XXH64, fp the fingerprint as a signed long. A null text has
    no words: fp 0."""

    def run(batches):
        for batch in batches:
            fp = [simhash(t.encode("utf-8", "surrogatepass"), shingle) if t is not None else 0 for t in batch.column(2).to_pylist()]
            yield {"doc_id": batch.column(0), "hash": batch.column(1), "fp": np.array(fp, "<u8").view("<i8")}

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("hash"), "text")
    return in_arrow(given, run, "doc_id long, hash long, fp long")


def _half_keys(flips: bool):
    """The two halves of fp as keys, each with a bit that tells which; with their one-bit variants."""
    halves = [F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND((1 << 32) - 1).bitwiseOR(1 << 32)]
    return F.array(*halves, *([h.bitwiseXOR(1 << i) for h in halves for i in range(32)] if flips else []))


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _open(fps: DataFrame) -> DataFrame:
    """The distinct fingerprints of fps(fp, group) that share a half, or one within a bit, with one of another group."""
    own = fps.select("group", F.explode(_half_keys(False)).alias("key"))
    own = own.groupBy("key").agg(F.min("group").alias("low"), F.max("group").alias("high"))
    tried = fps.select("fp", "group", F.explode(_half_keys(True)).alias("key"))
    return tried.join(dealt(own), "key").where("low <> `group` or high <> `group`").select("fp").distinct()


def _edges(fps: DataFrame, masks: list[int], near: int) -> DataFrame:
    """(u, v) of fps(fp): what meets at a point, linked to the smallest that is there by one of the first `near` masks."""
    met = fps.select("fp", F.posexplode(F.array(*(F.lit(_signed(m)) for m in masks))).alias("i", "mask"))
    met = met.select("fp", (F.col("i") < near).alias("close"), F.col("fp").bitwiseXOR(F.col("mask")).alias("at"))
    low = F.min(F.when(F.col("close"), F.col("fp"))).over(Window.partitionBy("at"))
    return met.withColumn("low", low).where("low is not null and low <> fp").select(F.col("fp").alias("u"), F.col("low").alias("v"))


def linked(fps: DataFrame) -> DataFrame:
    """(id, component) for the distinct fingerprints fps(fp) that have another one within 3 bits.

    component is the smallest fingerprint (as a signed long) reachable over links of at most 3 bits.
    """
    likely = written(_open(fps.select("fp", F.col("fp").alias("group"))))
    near = [0, *(1 << i for i in range(64))]
    far = [(1 << i | 1 << j) << h for h in (0, 32) for i, j in combinations(range(32), 2)]
    close = written(_edges(likely, near, len(near)).distinct())
    groups = components(close)
    grouped = written(likely.join(dealt(groups), likely["fp"] == groups["id"], "left").select("fp", F.coalesce("component", "fp").alias("group")))
    apart = written(_open(grouped))
    return components(close.unionByName(_edges(apart, near + far, len(near))))


def _named(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, hash, fp, group): group is the smallest fingerprint of the class; written."""
    fps = written(fingerprints(docs, shingle))
    links = linked(fps.select("fp").distinct())
    return written(fps.join(dealt(links), fps["fp"] == links["id"], "left").select("doc_id", "hash", "fp", F.coalesce("component", "fp").alias("group")))


def classes(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) for every row: component_id is the smallest doc_id reachable by links of at most 3 bits.

    Texts without words have fingerprint zero and are linked like any other. Repeated rows and ids are kept. A null
    doc_id never names a class that has another id. A text may be of any length. An empty table gives an empty table.
    """
    named = _named(docs, shingle)
    ids = written(named.groupBy("group").agg(F.min("doc_id").alias("component_id")))
    return named.join(dealt(ids), "group").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """Of every class of similar texts one row of docs: that with the smallest doc_id, then text hash.

    Rows are told apart by doc_id and text, so different texts under one doc_id are judged one by one; of rows that share
    both one stays, whatever their other columns, which may have any names. Rows with a null doc_id stay and take no other's place. Null, empty and
    very long texts count as in classes(). An empty table gives an empty table.
    """
    rows = _named(docs, shingle).where("doc_id is not null").groupBy("group", "doc_id", "hash").agg(F.count("*").alias("n"))
    rows = written(rows)
    keep = written(rows.groupBy("group").agg(F.min(F.struct("doc_id", "hash")).alias("keep")))
    at = rows.join(dealt(keep), "group").select("doc_id", "hash", "n", (F.struct("doc_id", "hash") == F.col("keep")).alias("kept"))
    at = at.select(F.col("doc_id").alias("__id"), F.col("hash").alias("__hash"), "n", "kept")
    names, docs = docs.columns, set_aside(docs, "doc_id", "text")
    own = [F.col("doc_id") == F.col("__id"), F.col("__h") == F.col("__hash")]
    left = docs.withColumn("__h", F.xxhash64("text")).join(dealt(at.where("not kept")), own, "left_anti")
    again = written(at.where("kept and n > 1").select("__id", "__hash"))
    if not again.isEmpty():
        once = left.join(dealt(again), own, "left_semi").dropDuplicates(["doc_id", "__h"])
        left = left.join(dealt(again), own, "left_anti").unionByName(once)
    return left.select(*docs.columns).toDF(*names)
