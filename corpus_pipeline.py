"""The corpus pipeline: five stages from raw documents to sharded training text.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's ``docs``. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, langid, mixing, sharding, similar
from tidemark.llm.common import kept_only, new_path, scratch, table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A text whose best language has less than this share of the evidence has no language.
LEAST_SCORE = 0.3
SHARDS = 16


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter and those in which no language stands out; a text too short for evidence stays."""
    told = langid.predict(docs.select(*COLUMNS), langid.learned(docs), with_text=True)
    return told.filter((F.col("lang_pred") != "und") & ((F.col("score") == 0) | (F.col("score") >= LEAST_SCORE))).select(*COLUMNS)


def identified(docs: DataFrame) -> DataFrame:
    """``docs`` with ``row``, an id of each row of its own, written so that every later reading finds the same ids."""
    return written(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("row")), "pipeline-rows")


def as_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, text) for operators that tell documents apart by id: the id is the row's."""
    return docs.select(F.col("row").alias("doc_id"), "text")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near duplicates: that with the smallest id, null last; of equal ids, one.

    SimHash with Golay keys proposes pairs, and five-word shingles with a Jaccard similarity of 0.8 or more link them."""
    rows = identified(docs)

    def chosen() -> DataFrame:
        named = rows.select("row", "doc_id").join(similar.similar_groups(rows.select("row", "text")), "row")
        return named.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row"))["row"].alias("kept")).select("kept")

    kept = kept_only(spark, chosen, "pipeline-kept")
    return rows.join(kept.hint("merge"), F.col("row") == F.col("kept")).select(*COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which benchmark passages make up a twentieth or more."""
    rows = identified(docs)
    found = decontaminate.op3_decontaminate(spark, as_rows(rows), table(spark, sf_dir, "benchmark"))
    bad = found.filter("contaminated").select(F.col("doc_id").alias("bad"))
    return rows.join(bad, F.col("row") == F.col("bad"), "left_anti").select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes, by row and pass over its source."""
    mixed = mixing.mixed_documents(identified(docs), "row")
    return mixed.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with shard and slot."""
    marked = docs.select(*COLUMNS, F.xxhash64("text").alias("text_hash"))
    return sharding.ring_shards(marked, "doc_id", SHARDS, ties=("n_chars", "text_hash")).drop("text_hash")


STAGES = [
    ("language_id", language_stage),
    ("simhash_near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("source_mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: SQL has no XXH64, and a learned language and a keyed permutation are beyond it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
