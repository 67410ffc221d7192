"""Registered queries of this folder: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnlake.llm import bpe, jaccard, language, lexical, licences, mixing, oracles, orderhash, personal, repair, secrets, sentences, tokencounts, vectors
from turnlake.llm.common import table


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    return vectors.near_duplicates(rows).select("vec_id", "n_links", "component_id", "kept")


VOCABULARY = "byte_bpe_50k.tiktoken"


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ranks = bpe.read_ranks(public_tokenizers.path(VOCABULARY))
    outputs = ("n_tokens", "ids_sha256", "decoded_sha256")
    return bpe.encode(docs, ranks, public_tokenizers.PATTERN, outputs, keep=["doc_id"])


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", language.fold_of("doc_id") == 0)
    model = language.train(docs.filter("NOT held_out"))
    return language.detect(docs.select("doc_id", "text", "held_out"), model).drop("text")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text", "detections")


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text", "sanitised")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return secrets.scan(docs, secrets.train(docs)).drop("text", "masked")


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.groups(table(spark, sf_dir, "documents"))


def op9_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orderhash.fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    mixed = mixing.mix(docs, F.array("source"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "times")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    found = repair.summarise(repair.repair(repair.damage(turns)))
    every = turns.select(F.col("conv_id").alias("_id")).distinct()
    joined = every.join(found, F.col("_id").eqNullSafe(F.col("conv_id")), "left")
    nothing = {"audit": F.lit(""), "repaired_sha256": F.sha2(F.lit(""), 256)}
    return joined.select(
        F.col("_id").alias("conv_id"),
        *[F.coalesce(F.col(c), nothing.get(c, F.lit(0).cast("bigint"))).alias(c) for c in found.columns[1:]],
    )


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lexical.search(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


COUNTED_VOCABULARY = "byte_bpe_50k.json"
TOKEN_LIMIT = 1024


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    vocabulary = tokencounts.read_vocabulary(public_tokenizers.path(COUNTED_VOCABULARY))
    counted = tokencounts.count_tokens(docs, vocabulary, ("n_bytes", "n_tokens"), keep=["doc_id"])
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


QUERIES = {
    "op1_embedding_dedup": op1_embedding_dedup,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_language_id": op3_language_id,
    "op4_license_scan": op4_license_scan,
    "op5_personal_data": op5_personal_data,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_secret_scan": op7_secret_scan,
    "op8_ngram_jaccard": op8_ngram_jaccard,
    "op9_order_minhash": op9_order_minhash,
    "op10_source_mixing": op10_source_mixing,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_lexical_search": op12_lexical_search,
    "op13_token_counts": op13_token_counts,
}
ORACLES: dict[str, str] = {
    "op1_embedding_dedup": oracles.EMBEDDING_DEDUP,
    "op8_ngram_jaccard": oracles.NGRAM_JACCARD,
    "op12_lexical_search": oracles.LEXICAL_SEARCH,
}
