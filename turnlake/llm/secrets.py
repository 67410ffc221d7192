"""Secret scans: fixed patterns, and character Markov models of random strings and ordinary names.

The models are two tables of character transitions. Random strings are the
values the fixed patterns find; ordinary names are words that several sampled
documents share. A token is a secret when its transitions are, on average,
clearly more likely under the first, by the more the fewer there are. Tokens
below 12 characters are scored only beside a match of a fixed pattern, from 4
on. Everything is built-in Spark functions; the table of log-likelihood ratios
is a literal of fixed size.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnlake.llm import spans
from turnlake.llm.common import string_or_empty, without

KINDS = ("assign", "access", "hex", "markov")
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # a shorter run fails as a whole, so the length may stand in the pattern
HEX = r"[0-9a-f]{24,}"
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

FOUND = "\uE000"  # stands for the characters of base matches while tokens are sought
TOKEN = rf"[A-Za-z0-9+/_=-]{{12,}}|(?<={FOUND})[A-Za-z0-9+/_=-]{{4,}}|[A-Za-z0-9+/_=-]{{4,}}(?={FOUND})"
SYMBOLS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-."
SIDE = len(SYMBOLS) + 1  # 0 stands for any other character
RANDOM_SAMPLE = 20_000  # values the model of random strings is trained on, first in a hash order
NAME_DOCUMENTS = 500  # documents whose words train the model of ordinary names, first in a hash order
NAME_WORD = r"[A-Za-z0-9+/_=-]{5,}"
SMOOTHING = 0.5  # added to the count of each character
PRIOR = 4.0  # transitions the rate of single characters counts as
THRESHOLD = 0.1  # mean log-likelihood ratio of a transition, of a token with ENOUGH different ones
ENOUGH = 19
STEP = 0.1  # added to the threshold for each different transition a token has less
ADDED = ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "masked")


def _assigned(found: Column) -> Column:
    return F.filter(found, lambda m: F.length(F.regexp_extract(m["value"], ASSIGN, 1)) >= 6)


def base_matches(text: Column) -> list[Column]:
    """Matches of each fixed pattern."""
    low = F.lower(text)
    gate = F.lit(False)
    for word in KEYWORDS:
        gate = gate | F.contains(low, F.lit(word))
    return [
        _assigned(spans.matches(text, ASSIGN, gate)),
        spans.matches(text, ACCESS, F.contains(text, F.lit("AKIA"))),
        spans.matches(text, HEX, text.rlike(HEX)),
    ]


def _transitions(samples: DataFrame) -> dict[tuple[int, int], int]:
    """Counts of neighbouring characters in rows (value): at most SIDE squared of them."""

    pairs = samples.filter("length(value) > 1").select(
        F.explode(
            F.transform(
                F.sequence(F.lit(1), F.length("value") - 1),
                lambda i: F.struct(_place(F.col("value"), i).alias("a"), _place(F.col("value"), i + 1).alias("b")),
            )
        ).alias("t")
    )
    rows = pairs.groupBy("t.a", "t.b").count().collect()
    return {(r["a"], r["b"]): r["count"] for r in rows}


def _place(value: Column, at: Column) -> Column:
    return F.position(F.substr(value, at, F.lit(1)), F.lit(SYMBOLS))


def train(docs: DataFrame) -> list[float] | None:
    """Log-likelihood ratios of transitions, row by row; None where either class has no sample."""
    text = string_or_empty("text")
    assign, access, hexes = base_matches(text)
    values = docs.select(
        F.explode(
            F.concat(
                F.transform(assign, lambda m: F.regexp_extract(m["value"], ASSIGN, 1)),
                F.transform(access, lambda m: m["value"]),
                F.transform(hexes, lambda m: m["value"]),
            )
        ).alias("value")
    ).distinct()
    random = _transitions(values.orderBy(F.xxhash64("value"), "value").limit(RANDOM_SAMPLE))
    order = F.xxhash64("text")
    last = docs.select(order.alias("h")).orderBy("h").limit(NAME_DOCUMENTS).agg(F.max("h")).first()[0]
    # Known secrets are no names, nor is what a single document holds, as long as others hold words in common.
    plain = F.regexp_replace(text, "|".join((ASSIGN, ACCESS, HEX)), " ")
    found = F.explode(F.array_distinct(F.regexp_extract_all(plain, F.lit(NAME_WORD), F.lit(0))))
    words = docs.filter(order <= F.lit(last)).select(order.alias("h"), found.alias("value")).distinct()
    words = words.groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    names = _transitions(words.filter("n > 1")) or _transitions(words)
    if not random or not names:
        return None

    def log_rates(counts):
        """log P(b | a), drawn towards P(b) where a is rare."""
        after, single = [0.0] * SIDE, [SMOOTHING] * SIDE
        for (a, b), n in counts.items():
            after[a] += n
            single[b] += n
        whole = sum(single)
        return [
            math.log((counts.get((a, b), 0) + PRIOR * single[b] / whole) / (after[a] + PRIOR))
            for a in range(SIDE)
            for b in range(SIDE)
        ]

    return [r - n for r, n in zip(log_rates(random), log_rates(names), strict=True)]


def ratio(value: Column, model: list[float]) -> Column:
    """Mean log-likelihood ratio of the transitions of ``value``."""
    table = F.from_json(F.lit(json.dumps(model)), "array<double>")
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(value) - 1),
        F.lit(0.0),
        lambda s, i: s + F.get(table, _place(value, i) * SIDE + _place(value, i + 1)),
    )
    return total / (F.length(value) - 1)


def threshold(value: Column) -> Column:
    """Least mean ratio of a secret; repeats of a transition are no further evidence."""
    pairs = F.transform(F.sequence(F.lit(1), F.length(value) - 1), lambda i: F.substr(value, i, F.lit(2)))
    return THRESHOLD + STEP * F.greatest(F.lit(0), ENOUGH - F.size(F.array_distinct(pairs)))


def scan(docs: DataFrame, model: list[float] | None = None) -> DataFrame:
    """Documents with n_assign, n_access, n_hex, base_sha256, spans and masked.

    ``spans`` lists all spans as kind:start:end; ``masked`` is the text with
    every span replaced by its kind in brackets. Without a model (no labelled
    samples) only the fixed patterns count.

    Null text counts as empty and has no span (masked stays null). Texts of any
    length are searched whole. Equal rows get equal results, an empty table an
    empty one. Existing columns of the added names are replaced, others kept.
    """
    docs = without(docs, ADDED)
    text = string_or_empty("text")
    found = docs.withColumn("_found", F.array(*base_matches(text)))
    base = F.array_sort(F.flatten(F.array(*[spans.of_kind(F.get("_found", F.lit(k)), k) for k in range(3)])))
    found = found.withColumn("_base", base)
    added = F.array().cast(spans.SPAN)
    if model is not None:
        # What is left of a token beside a base match is scored by itself.
        left = F.when(F.size("_base") > 0, spans.blanked(text, F.col("_base"), FOUND)).otherwise(text)
        found = found.withColumn("_left", left)
        tokens = spans.matches(F.col("_left"), TOKEN, F.col("_left").rlike(TOKEN))
        added = spans.of_kind(F.filter(tokens, lambda m: ratio(m["value"], model) > threshold(m["value"])), 3)
    found = found.withColumn("_all", F.array_sort(F.concat("_base", added)))
    return found.select(
        *docs.columns,
        *[F.size(F.get("_found", F.lit(k))).cast("bigint").alias(ADDED[k]) for k in range(3)],
        F.sha2(spans.written(F.col("_base"), KINDS), 256).alias("base_sha256"),
        spans.written(F.col("_all"), KINDS).alias("spans"),
        F.when(F.col("text").isNotNull(), spans.replaced(text, F.col("_all"), KINDS)).alias("masked"),
    )
