"""The corpus pipeline: five stages from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweft.llm import language, minhash, mixing, packing, suffix
from graphweft.llm.common import table, word_count

#: A document stays if its main language has at least this share of it.
LEAST_SHARE = 0.5
#: Similarity of five-word shingles, in percent, at which one of two documents goes.
SIMILAR = 80
#: Words of a passage that goes where it repeats.
PASSAGE = 50


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with letters whose main language has LEAST_SHARE; a missing lang is filled in."""
    found = language.detect(docs, language.train(docs), docs.columns)
    kept = found.where((F.col("lang_pred") != language.UNDEFINED) & (F.col("score") >= LEAST_SHARE))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group, with all its texts where an id has several; rows without an id all stay."""
    kept = table(minhash.components(docs.select("doc_id", "text"), SIMILAR).where("kept").select("doc_id").distinct(), "pipeline-kept")
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    once = docs.join(kept, "doc_id", "left_semi").groupBy("doc_id", "text").agg(F.min(F.struct(*rest)).alias("_rest")).select("doc_id", "text", "_rest.*")
    return once.unionByName(docs.where("doc_id is null")).select(*docs.columns)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out byte strings and passages of PASSAGE words that repeat; documents of which nothing is left go."""
    left = suffix.strip(docs, words=PASSAGE)
    return left.where("text <> ''").withColumn("n_chars", F.char_length("text").cast(dict(docs.dtypes)["n_chars"])).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    # what is taken of a row depends on its id, source and number of words alone, and each of the first two may be null
    mix = mixing.mix(docs.select("doc_id", "text", "source"), carry=("source",)).where("taken > 0")
    plan = mix.groupBy(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("size").alias("_size")).agg(F.max(F.expr("taken div size")).alias("_copies"))
    rows = docs.withColumn("_words", word_count(F.col("text")))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_source")) & (F.col("_words") == F.col("_size"))
    return rows.join(table(plan, "pipeline-mix"), same).withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in their sequences."""
    return packing.pack(docs.select("doc_id", "text"))


STAGES = [
    ("language", by_language),
    ("near_duplicates", without_near_duplicates),
    ("repeated_strings", without_repeats),
    ("mixing", mixed),
    ("packing", packed),
]

#: SQL can't express the language model or the tokenizer; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
