"""The queries of this subpackage and, where SQL can express them, the SQL for the same rows.

Each takes a whole table and gives what its operator states for nulls, ties, repeats and empty tables. Those that write
intermediate tables write their rows too and delete the others.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontaminate, embeddings, langid, mixing, ppm, quality, ranked, sharding, simhash, substrings, trie, warc
from .common import kept_only, table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept_only(spark, lambda: mixing.op1_mixing(spark, table(spark, sf_dir, "documents")), "op1_mixing")


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept_only(spark, lambda: langid.op2_language(spark, table(spark, sf_dir, "documents")), "op2_language")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept_only(spark, lambda: decontaminate.op3_query(spark, sf_dir), "op3_decontaminate")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept_only(spark, lambda: warc.op4_warc(spark, table(spark, sf_dir, "pages")), "op4_warc")


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.op5_chat(spark, table(spark, sf_dir, "conversations"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.op6_sharding(spark, table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept_only(spark, lambda: quality.op7_quality(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")), "op7_quality")


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept_only(spark, lambda: substrings.op8_query(spark, sf_dir), "op8_substrings")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept_only(spark, lambda: simhash.op9_simhash(spark, table(spark, sf_dir, "documents")), "op9_simhash")


def op10_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept_only(spark, lambda: embeddings.op10_embeddings(spark, table(spark, sf_dir, "embeddings")), "op10_embeddings")


def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept_only(spark, lambda: trie.op11_trie(spark, table(spark, sf_dir, "conversations")), "op11_trie")


def op12_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept_only(spark, lambda: ppm.op12_ppm(spark, table(spark, sf_dir, "documents")), "op12_ppm")


def op13_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept_only(spark, lambda: ranked.op13_query(spark, sf_dir), "op13_ranked")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_mixing, op2_language, op3_decontaminate, op4_warc, op5_chat, op6_sharding, op7_quality, op8_substrings, op9_simhash, op10_embeddings, op11_trie, op12_ppm, op13_ranked)}


def oracle_sql() -> dict[str, str]:
    return {"op3_decontaminate": decontaminate.ORACLE, "op4_warc": warc.ORACLE, "op5_chat": chat.ORACLE, "op8_substrings": substrings.ORACLE, "op11_trie": trie.ORACLE, "op13_ranked": ranked.ORACLE}
