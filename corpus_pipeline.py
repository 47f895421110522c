"""From raw documents to packed training sequences: quality, line and near-duplicate filtering, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import ballhash, binslack, fuzzylines, mixing, zipquality
from graphloom.llm.common import written
from graphloom.llm.queries import tokenizer_files


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier, fitted on labelled ones among them, does not reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return zipquality.accepted(docs, zipquality.fit(docs, labels))


def unique_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each line only where it first occurs; n_chars follows the text."""
    out = fuzzylines.deduplicated(docs)
    return out.select(*(F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns))


def one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return ballhash.one_of_each(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their leaf's budget takes them."""
    return mixing.mixed(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in sequences of at most 2048 tokens."""
    return binslack.packed(docs, **tokenizer_files())


STAGES = [
    ("quality classifier", good_documents),
    ("line dedup", unique_lines),
    ("SimHash near-dedup", one_of_each_class),
    ("mixing sources", mixed_sources),
    ("packing", packed_sequences),
]

#: Compression, fingerprints and tokenizers are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are written before the next reads them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
