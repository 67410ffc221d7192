"""Personal data: fixed patterns, and terms that give a protected value away.

The fixed patterns find protected values. Which terms reveal one is estimated
from the whole corpus, by distinct texts: a term is worth the information
log2(P(value | term) / P(value)) about a value, where P(value | term) is drawn
towards P(value) while counts are small. A term worth most of what the value
itself holds, -log2 P(value), is treated like the value: in each text that
holds the value, every occurrence of the term becomes a span, which sanitising
generalises to a placeholder. All of it is built-in functions, equi-joins and
aggregations with map-side combining.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnlake.llm import spans
from turnlake.llm.common import stored, string_or_empty, without

KINDS = ("email", "ip", "card", "phone", "term")
# The look-behinds and possessive counts only spare repeated attempts inside one run: a match that
# fails from the start of a run of its characters fails from every later place of that run.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"

TERM = r"[\p{L}\p{N}][\p{L}\p{M}\p{N}]++"
SHRINK = 0.5  # texts' worth of P(value) mixed into P(value | term)
DISCLOSURE = 0.9  # share of a value's information a term must carry
ADDED = ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "sanitised")


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """14 to 19 digits whose Luhn sum ends in 0."""
    digits = _digits(value)

    def add(total: Column, i: Column) -> Column:
        digit = F.substr(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = digit * 2 - F.when(digit > 4, 9).otherwise(0)
        return total + F.when(i % 2 == 1, twice).otherwise(digit)

    total = F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add)
    return F.when(F.length(digits).between(14, 19), total % 10 == 0).otherwise(False)


def base_matches(text: Column) -> list[Column]:
    """Matches of each fixed pattern."""
    phone = spans.matches(text, PHONE, F.contains(text, F.lit("+")))
    return [
        spans.matches(text, EMAIL, F.contains(text, F.lit("@"))),
        F.filter(
            spans.matches(text, IP, text.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]")),
            lambda m: m["value"].rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$"),
        ),
        F.filter(spans.matches(text, CARD, text.rlike(r"[0-9](?:[\x20-]?[0-9]){13}")), lambda m: luhn(m["value"])),
        F.filter(phone, lambda m: F.length(_digits(m["value"])).between(10, 15)),
    ]


def _terms(text: Column) -> Column:
    """Distinct lower-cased terms of a text."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.lower))


def _entity(kind: Column, value: Column) -> Column:
    """A value without the ways of writing it: case of letters, signs between the digits of cards and phones."""
    return F.when(kind >= 2, _digits(value)).otherwise(F.lower(value))


def revealing_terms(docs: DataFrame, held: DataFrame, terms: DataFrame) -> DataFrame:
    """(hash, term) where the term discloses a value the text holds.

    ``docs`` has hash and text, ``held`` the values (hash, kind, value) and
    ``terms`` the terms (hash, term) of texts that hold one, each row once.
    Copies of a text share a hash and count as one. Values that stand in the
    same texts are one entity, so a list of many values is not paired with its
    terms once for each.
    """
    texts = docs.groupBy("hash").agg(F.first("text").alias("text"))
    counts = texts.select(F.explode(_terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    known = counts.join(terms.select("term").distinct(), "term")
    total = float(docs.select("hash").distinct().count())
    places = held.groupBy("kind", "value").agg(
        F.count(F.lit(1)).alias("texts"), F.bit_xor("hash").alias("a"), F.bit_xor(F.xxhash64("hash")).alias("b")
    )
    # A term discloses where P(value | term) reaches P(value) ** (1 - DISCLOSURE).
    rate = F.col("texts") / F.lit(total)
    bar = F.pow(rate, F.lit(1 - DISCLOSURE))
    # All that tells whether an entity's term can get there: it stands in few enough texts.
    most = (F.col("texts") + SHRINK * rate) / bar - SHRINK
    entities = (
        held.join(places, ["kind", "value"])
        .filter(rate < 1)
        .select("hash", "a", "b", "texts", most.alias("most"))
        .distinct()
    )
    pairs = stored(
        entities.join(terms.join(known, "term"), "hash").filter(F.col("n") <= F.col("most")).drop("most"), "personal"
    )
    together = pairs.groupBy("a", "b", "texts", "term", "n").agg(F.count(F.lit(1)).alias("together"))
    revealing = together.filter(F.col("together") + SHRINK * rate >= bar * (F.col("n") + SHRINK))
    keys = ["a", "b", "texts", "term"]
    return pairs.join(revealing.select(keys), keys).select("hash", "term").distinct()


def scan(docs: DataFrame) -> DataFrame:
    """Documents with n_email, n_ip, n_card, n_phone, base_sha256, spans and sanitised.

    ``spans`` lists all spans as kind:start:end, kind ``term`` being those the
    corpus statistics add; ``sanitised`` is the text with every span replaced by
    its kind in brackets.

    Null text counts as empty and has no span (sanitised stays null). Texts of
    any length are searched whole. Equal rows get equal results; rows are told
    apart by doc_id and text, either of which may be null or repeated. An empty
    table gives an empty one. Columns of the added names are replaced, others kept.
    """
    docs = without(docs, ADDED)
    text = string_or_empty("text")
    keyed = docs.withColumns({"_id": F.col("doc_id"), "_hash": F.xxhash64("text")})
    found = keyed.withColumn("_found", F.array(*base_matches(text)))
    base = F.array_sort(F.flatten(F.array(*[spans.of_kind(F.get("_found", F.lit(k)), k) for k in range(4)])))
    holders = found.filter(F.exists("_found", lambda f: F.size(f) > 0)).select(
        "_id", F.col("_hash").alias("hash"), "text", "_found", base.alias("_base")
    )
    values = F.flatten(
        F.transform(
            "_found",
            lambda f, k: F.transform(f, lambda m: F.struct(k.alias("kind"), _entity(k, m["value"]).alias("value"))),
        )
    )
    held = stored(holders.select("hash", F.explode(values).alias("v")).select("hash", "v.*").distinct(), "personal")
    terms = stored(holders.select("hash", F.explode(_terms(F.col("text"))).alias("term")).distinct(), "personal")
    revealed = revealing_terms(docs.select(F.xxhash64("text").alias("hash"), text.alias("text")), held, terms)
    # Where they stand, outside the values themselves, once for all copies of a text.
    marks = F.explode(spans.matches(spans.blanked(F.col("text"), F.col("_base")), TERM)).alias("m")
    occurrences = holders.select("hash", marks).select("hash", F.lower("m.value").alias("term"), "m.start", "m.end")
    marked = (
        occurrences.distinct()
        .join(revealed, ["hash", "term"])
        .groupBy("hash")
        .agg(F.array_sort(F.collect_set(F.struct("start", F.lit(len(KINDS) - 1).alias("kind"), "end"))).alias("_terms"))
    )
    more = (
        holders.select("_id", "hash").distinct().join(marked, "hash")
        .select(F.col("_id").alias("_to"), F.col("hash").alias("_of"), "_terms")
    )

    counts = [F.size(F.get("_found", F.lit(k))).cast("bigint").alias(ADDED[k]) for k in range(4)]
    narrow = found.select(*docs.columns, "_id", "_hash", *counts, base.alias("_base"))
    same = F.col("_id").eqNullSafe(F.col("_to")) & (F.col("_hash") == F.col("_of"))
    joined = narrow.join(more, same, "left").withColumn(
        "_all", F.array_sort(F.concat("_base", F.coalesce("_terms", F.array().cast(spans.SPAN))))
    )
    return joined.select(
        *docs.columns,
        *ADDED[:4],
        F.sha2(spans.written(F.col("_base"), KINDS), 256).alias("base_sha256"),
        spans.written(F.col("_all"), KINDS).alias("spans"),
        F.when(F.col("text").isNotNull(), spans.replaced(text, F.col("_all"), KINDS)).alias("sanitised"),
    )
