"""Okapi BM25 (Robertson & Zaragoza 2009) for one query.

Query terms are counted inside each document row, so scoring needs no shuffle:
one pass yields the corpus statistics (a scalar subquery), one pass the scores,
and the top k is a per-partition heap merged at the end.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnlake.functions import text as tx
from turnlake.operators import slices

K1 = 1.2
B = 0.75
SCORE_DIGITS = 6


def _occurrences(term: str):
    return lambda word: word == F.lit(term)


def _tf(i: int) -> str:
    return f"_tf{i}"


def count_terms(docs: DataFrame, body: Column, terms: Sequence[str]) -> DataFrame:
    """Add document length and one count per query term.

    The counts come out of a one-row ``inline``, so a later condition on them is
    not pushed below it, where it would tokenise every text a second time.
    """

    def summary(words: Column) -> Column:
        return tx.bind(
            F.filter(words, lambda word: word.isin(list(terms))),
            lambda hits: F.struct(
                F.size(words).cast("bigint").alias("_dl"),
                F.size(hits).cast("bigint").alias("_n"),
                *[
                    F.size(F.filter(hits, _occurrences(term))).cast("bigint").alias(_tf(i))
                    for i, term in enumerate(terms)
                ],
            ),
        )

    return docs.select("*", F.inline(F.transform(F.array(tx.word_tokens(body)), summary)))


def merge_counts(counted: DataFrame, key: Sequence[str], terms: Sequence[str]) -> DataFrame:
    """Counts of documents stored in several rows, combined on the map side."""
    sums = [F.sum("_dl").alias("_dl"), F.sum("_n").alias("_n"), *[F.sum(_tf(i)).alias(_tf(i)) for i in range(len(terms))]]
    return counted.groupBy(*key).agg(*sums)


def corpus_statistics(counted: DataFrame, terms: Sequence[str]) -> DataFrame:
    """One row holding one struct: documents, average length, df per term."""
    return counted.agg(
        F.struct(
            F.count(F.lit(1)).cast("double").alias("n"),
            (F.sum("_dl").cast("double") / F.count(F.lit(1)).cast("double")).alias("avgdl"),
            *[F.count_if(F.col(_tf(i)) > 0).cast("double").alias(f"df{i}") for i in range(len(terms))],
        ).alias("stats")
    )


def idf(n: Column, df: Column) -> Column:
    return F.log(F.lit(1.0) + (n - df + F.lit(0.5)) / (df + F.lit(0.5)))


def saturated_tf(tf: Column, dl: Column, avgdl: Column) -> Column:
    tf, dl = tf.cast("double"), dl.cast("double")
    return tf * F.lit(K1 + 1.0) / (tf + F.lit(K1) * (F.lit(1.0 - B) + F.lit(B) * dl / avgdl))


def squash(raw: Column) -> Column:
    """Map [0, inf) to [0, 1) so that scores of different collections compare."""
    return raw / (F.lit(1.0) + raw)


def score_counted(counted: DataFrame, terms: Sequence[str]) -> DataFrame:
    """Rows with at least one query term and their ``score``."""
    if not terms:
        return counted.filter(F.lit(False)).withColumn("score", F.lit(0.0)).drop("_dl", "_n")
    # A scalar subquery in a column of its own is planned and run once.
    stats = F.col("_stats")
    raw = reduce(
        lambda a, b: a + b,
        [
            idf(stats.getField("n"), stats.getField(f"df{i}"))
            * saturated_tf(F.col(_tf(i)), F.col("_dl"), stats.getField("avgdl"))
            for i in range(len(terms))
        ],
    )
    with_stats = counted.filter(F.col("_n") > 0).withColumn("_stats", corpus_statistics(counted, terms).scalar())
    scored = with_stats.withColumn("_raw", raw).withColumn("score", F.round(squash(F.col("_raw")), SCORE_DIGITS))
    return scored.drop("_dl", "_n", "_stats", "_raw", *[_tf(i) for i in range(len(terms))])


def search(docs: DataFrame, body: Column, query: str, key: str, limit: int | None = None) -> DataFrame:
    """Documents matching the query, best first when a limit is given."""
    terms = tx.query_terms(query)
    scored = score_counted(count_terms(docs, body, terms), terms)
    if limit is None:
        return scored
    return scored.orderBy(F.desc("score"), F.asc(key)).limit(limit)


def postings(docs: DataFrame, body: Column, key: str) -> DataFrame:
    """(key, term, tf).

    Texts are distributed by document first. That is the only shuffle: the
    counts group by (key, term), which the distribution by key already serves,
    and texts take less room than the postings made of them. The number of
    tasks follows the size of the texts, so that of a task's counts does not.
    """
    return (
        docs.select(key, body.alias("_body"))
        .repartition(slices.tasks_for(slices.text_bytes(docs, body), docs.sparkSession), key)
        .select(key, F.explode(tx.word_tokens(F.col("_body"))).alias("term"))
        .groupBy(key, "term")
        .agg(F.count(F.lit(1)).alias("tf"))
    )


def document_lengths(docs: DataFrame, body: Column, key: str) -> DataFrame:
    return docs.select(key, F.size(tx.word_tokens(body)).cast("bigint").alias("dl"))


def term_statistics(postings_df: DataFrame) -> DataFrame:
    return postings_df.groupBy("term").agg(
        F.count(F.lit(1)).alias("df"), F.sum("tf").cast("bigint").alias("cf")
    )
