"""A training corpus from `documents`: language ID, exact dedup, SimHash near-dedup, substring dedup, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import drop, settled
from siltstone.llm.exact_dedup import exact_dedup, normalised
from siltstone.llm.langid import predict, train
from siltstone.llm.packing import pack
from siltstone.llm.simhash import simhash_near_dedup
from siltstone.llm.substring_dedup import substring_dedup

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Noise from which on a text is rejected: random letters of 250 bytes and more reach it, prose stays under 0.5.
REJECT = 0.85
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that the network rejects: those without a letter, and those that it takes for noise by REJECT of their
    positions' probability or more. A language that is merely unsure is no reason to lose a document."""
    learned = docs.where(F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2, F.lit(True)))
    said = predict(docs.select(*COLUMNS), train(learned), keep=COLUMNS)
    return said.where((F.col("lang_pred") != "und") & (F.col("noise") < REJECT)).select(*COLUMNS)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest doc_id stays, once if its row is repeated: then its least row."""
    kept = exact_dedup(docs).where("kept").groupBy(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha")).agg(F.count("*").alias("__rows"))
    left = docs.select(*COLUMNS, normalised("text").alias("__n")).join(kept, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.sha2("__n", 256) == F.col("__sha")))
    once = left.where("__rows = 1").select(*COLUMNS)
    return once.unionByName(left.where("__rows > 1").groupBy("__id", "__sha").agg(F.min(F.struct(*COLUMNS)).alias("row")).select("row.*"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id stays."""
    first = simhash_near_dedup(docs).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__id")).distinct()
    return docs.select(*COLUMNS).join(first, F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more that a smaller doc_id holds go; documents without one keep their texts as they are."""
    cleaned = substring_dedup(docs, texts=True, carry=("lang", "source", "n_chars"))
    return cleaned.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.when(F.col("n_removed") > 0, F.length("kept_text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType).alias("n_chars"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens in their sequences."""
    return pack(docs, TOKENIZER)


STAGES = [("language id", language), ("exact dedup", exact), ("simhash near-dedup", near), ("substring dedup", substrings), ("best-fit packing", packed)]

#: The first, third and last stages have no form in SQL; tests hold all rows of run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage. Each stage's table goes once the next one's is written; nulls, repeated rows and ties are as
    each stage's docstring and operator say, and an empty table gives an empty table."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = settled(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), f"stage{k}")
        if before is not None:
            drop(before)
        before = docs
    return docs
