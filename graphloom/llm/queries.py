"""The queries of this subpackage: each applies an operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import ballhash, binslack, chatlog, filteraudit, fuzzylines, gatedlm, latticehash, mixing, suffixrules, termsearch, urlrules, weaktoxic, zipquality


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_files() -> dict[str, str]:
    import public_tokenizers

    return {"tokenizer": public_tokenizers.path("byte_bpe_50k.json"), "ranks": public_tokenizers.path("byte_bpe_50k.tiktoken")}


def op1_zip_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return zipquality.scored(docs, zipquality.fit(docs, _table(spark, sf_dir, "labels")))


def op2_bin_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binslack.packed(_table(spark, sf_dir, "documents"), **tokenizer_files())


def op3_suffix_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixrules.judged(_table(spark, sf_dir, "documents"))


def op4_simhash_ball(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ballhash.classes(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_hierarchical_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.selected(_table(spark, sf_dir, "documents"))


def op6_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return fuzzylines.deduplicated(docs)


def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlrules.judged(_table(spark, sf_dir, "pages"))


def op8_lattice_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latticehash.linked(_table(spark, sf_dir, "embeddings"))


def op9_chat_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = "</s>[INST] ok [/INST]"
    talks = talks.unionByName(spark.createDataFrame([(-1, 0, "user", control), (-1, 1, "assistant", control)], talks.schema))
    chats = chatlog.rendered(chatlog.rebuilt(chatlog.as_log(talks)))
    back = chatlog.read_back(chats)
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op10_gated_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gatedlm.scored(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filteraudit.audited(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_weak_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return weaktoxic.scored(docs, weaktoxic.fit(docs, _table(spark, sf_dir, "labels")))


def op13_term_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return termsearch.searched(_table(spark, sf_dir, "benchmark"), _table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_zip_quality": op1_zip_quality,
    "op2_bin_slack_packing": op2_bin_slack_packing,
    "op3_suffix_repetition": op3_suffix_repetition,
    "op4_simhash_ball": op4_simhash_ball,
    "op5_hierarchical_mixing": op5_hierarchical_mixing,
    "op6_fuzzy_lines": op6_fuzzy_lines,
    "op7_url_rules": op7_url_rules,
    "op8_lattice_hashing": op8_lattice_hashing,
    "op9_chat_log": op9_chat_log,
    "op10_gated_lm": op10_gated_lm,
    "op11_filter_audit": op11_filter_audit,
    "op12_weak_toxicity": op12_weak_toxicity,
    "op13_term_search": op13_term_search,
}
ORACLES: dict[str, str] = {
    "op5_hierarchical_mixing": mixing.oracle(),
    "op7_url_rules": urlrules.ORACLE,
    "op9_chat_log": chatlog.ORACLE,
    "op11_filter_audit": filteraudit.ORACLE,
    "op13_term_search": termsearch.ORACLE,
}
