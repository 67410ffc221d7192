"""Preparing a corpus: language, near copies, secrets, source mix, tokens.

Each stage takes the documents its predecessor kept and returns documents; the
last returns one row of token digests per document of the mix.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnlake.llm import bpe, jaccard, language, mixing, secrets
from turnlake.llm.common import stored, table

MIN_LANGUAGE_SCORE = 0.5
SHINGLE_WORDS = 5
SIMILAR_PERCENT = 80
VOCABULARY = "byte_bpe_50k.tiktoken"
TABLE_WORDS = 200_000  # the table of words passes through the driver, which holds what the other stages left


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; the model learns from four of five labelled documents."""
    model = language.train(docs.filter(language.fold_of("doc_id") != 0))
    found = language.detect(docs, model)
    known = (F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= MIN_LANGUAGE_SCORE)
    return found.filter(known).select(*docs.columns)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id."""
    return jaccard.keep_one(docs, SHINGLE_WORDS, SIMILAR_PERCENT)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret in their text replaced by its kind."""
    masked = secrets.scan(docs, secrets.train(docs)).withColumn("text", F.col("masked"))
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.coalesce(F.length("text").cast("bigint"), F.col("n_chars")))
    return masked.select(*docs.columns)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, each as often as the mix takes it."""
    mixed = mixing.mix(docs, F.array("source")).filter("times > 0")
    repeats = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("times"))).alias("_repeat")
    return mixed.select(*docs.columns, repeats).drop("_repeat")


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the documents."""
    ranks = bpe.read_ranks(public_tokenizers.path(VOCABULARY))
    outputs = ("n_tokens", "ids_sha256", "decoded_sha256")
    return bpe.encode(docs, ranks, public_tokenizers.PATTERN, outputs, keep=["doc_id", "source"], apart=True, table_words=TABLE_WORDS)


STAGES = [
    ("language_id", language_id),
    ("ngram_jaccard", ngram_jaccard),
    ("secret_scan", secret_scan),
    ("source_mixing", source_mixing),
    ("byte_bpe", byte_bpe),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents below ``sf_dir``, each result written before the next stage reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
