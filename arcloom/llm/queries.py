"""The registered opN_<name> queries: each applies its operator, with production
parameters, to a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from arcloom.llm import (
    bpe_automaton,
    conversation_repair,
    exact_dedup,
    imatch,
    language_id,
    line_dedup,
    main_text,
    packing,
    prefix_trie,
    simhash,
    suffix_dedup,
    token_counts,
    warc,
)
from arcloom.session import ship

CAPACITY, END, TOKEN_LIMIT = 2048, 0, 4096


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/documents.parquet")


def op1_simhash_bk_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(documents(spark, sf_dir))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_digests(documents(spark, sf_dir))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removal_digests(documents(spark, sf_dir))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir))


def op6_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_automaton.digests(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = ship(spark).read.parquet(f"{sf_dir}/pages.parquet")
    return warc.write_archive(pages).lookup(pages.select("url")).drop("url")


def op8_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.edited_likeness(documents(spark, sf_dir))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_pack(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"), CAPACITY, END)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir), tokenizer_path("piece_bpe_32k.model"), TOKEN_LIMIT)


def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract(ship(spark).read.parquet(f"{sf_dir}/pages.parquet"))


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/conversations.parquet")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(conversations(spark, sf_dir))


def op13_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair(conversations(spark, sf_dir))


def queries():
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {"op5_exact_dedup": exact_dedup.ORACLE, "op7_warc": warc.ORACLE, "op11_html_extraction": main_text.ORACLE, "op12_prefix_trie": prefix_trie.ORACLE, "op13_structure_repair": conversation_repair.ORACLE}
